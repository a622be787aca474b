"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents, so tokens are labelled first: a token of a toxic document is toxic
if its form or a prefix of it occurs in toxic documents far more often than in clean ones.
A two-state chain over lines is trained on these tokens. Forward-backward marginals of all
tokens of a text then give offending offsets, and a document's score is a logistic function
of its largest marginal and of the expected number of toxic tokens. Marginals under 0.05
count as nothing in both, by definition; so a text in which no token can reach that, whatever
its neighbours, needs no chain.

Defined results: a null, empty or word-less text scores as one without toxic tokens and has
no spans; a line of any length is one chain (only in training are lines cut into stretches of
256 tokens); repeated rows get equal rows; with no usable labels, or only one class of them,
nothing is found toxic and every score is 0; other columns are not read; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held_out
from threadloom.llm.labelled import labelled_sample

HASHED = 1 << 18
STRETCH = 256  # tokens of a line that are run through at a time
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_CHUNK = re.compile(r"\S+")


def form_of(chunk: str) -> str:
    """A token's form: lower case, without punctuation and digits at its ends."""
    low = chunk.lower()
    return low if low.isalpha() else _EDGE.sub("", low)


def traits(form: str) -> list[str]:
    """The features of a form; the first is shared by all."""
    if not form:
        return ["*"]
    return ["*", f"w{form}", f"a{form[:3]}", f"b{form[:4]}", f"c{form[:5]}", f"z{form[-3:]}"]


def places_of(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % HASHED for n in names]


def telling_traits(sample: list[tuple[int, str, int]], ratio: float = 20, least_share: float = 0.01, least: int = 3) -> set[str]:
    """Forms and prefixes at least ``ratio`` times as frequent in toxic documents as in clean ones, in enough of them.

    What stands between the same two words again and again comes from copies of a document
    and counts once.
    """
    texts, total = {(t, y) for _, t, y in sample}, [0, 0]
    for _, y in texts:
        total[y] += 1
    own = lambda f: [n for n in traits(f) if n[0] in "wbc" and len(n) > 4]
    named = lambda text: {n for f in {form_of(c) for c in text.split()} for n in own(f)}
    enough = max(least, least_share * total[1])
    toxic: Counter = Counter()
    for text, y in texts:
        if y:
            toxic.update(named(text))
    # most names are rare: they are dropped before clean texts are counted
    seen = Counter(), {n: k for n, k in toxic.items() if k >= enough}
    del toxic
    for text, y in texts:
        if not y:
            seen[0].update(n for n in named(text) if n in seen[1])
    tells = lambda n, k: k >= enough and (k + 0.5) / (total[1] + 1) >= ratio * (seen[0][n] + 0.5) / (total[0] + 1)
    between: dict[str, set[int]] = {n: set() for n, k in seen[1].items() if tells(n, k)}
    for text, y in texts:
        if y:
            forms = [form_of(c) for c in text.split()]
            for before, f, after in zip(["", *forms], forms, [*forms[1:], ""], strict=False):
                for n in own(f):
                    if n in between:
                        between[n].add(hash((before, after)))
    return {n for n, places in between.items() if tells(n, min(seen[1][n], len(places)))}


def chains(potential: np.ndarray, there: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 and of the steps between states, for a batch of chains.

    potential: exp of the emission of state 1 against state 0, by chain and position;
    there: which positions exist (a prefix of each row); move: exp of the transitions,
    with row 2 for the start. Probabilities are scaled at each position.
    """
    b, n = potential.shape
    f0, f1 = np.empty((n, b)), np.empty((n, b))
    x0, x1 = np.full(b, move[2, 0]), move[2, 1] * potential[:, 0]
    for t in range(n):
        if t:
            x0, x1 = x0 * move[0, 0] + x1 * move[1, 0], (x0 * move[0, 1] + x1 * move[1, 1]) * potential[:, t]
        s = x0 + x1
        x0, x1 = x0 / s, x1 / s
        f0[t], f1[t] = x0, x1
    y0, y1 = np.ones(b), np.ones(b)
    p1, pair = np.empty((n, b)), np.zeros((n, b, 4))
    for t in range(n - 1, -1, -1):
        z0, z1 = f0[t] * y0, f1[t] * y1
        p1[t] = z1 / (z0 + z1)
        if t:
            on = there[:, t]
            w = potential[:, t] * y1
            pair[t] = np.stack([f0[t - 1] * move[0, 0] * y0, f0[t - 1] * move[0, 1] * w, f1[t - 1] * move[1, 0] * y0, f1[t - 1] * move[1, 1] * w], 1)
            pair[t] /= pair[t].sum(1, keepdims=True)
            y0, y1 = np.where(on, move[0, 0] * y0 + move[0, 1] * w, y0), np.where(on, move[1, 0] * y0 + move[1, 1] * w, y1)
            s = y0 + y1
            y0, y1 = y0 / s, y1 / s
    return p1.T, pair.transpose(1, 0, 2)


def marginals(emissions: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Marginals of state 1 for chains of any lengths.

    All but the first token of a chain form stretches, which are run through side by side.
    The product of a stretch's steps says what it makes of the odds that come in from
    either end, so that long chains are joined exactly, a stretch at a time.
    """
    (a, c), (d, e) = move[0], move[1]
    out = [np.empty(len(x)) for x in emissions]
    parts = [(i, at, x[at : at + STRETCH]) for i, x in enumerate(emissions) for at in range(1, len(x), STRETCH)]
    first = [move[2, 1] / move[2, 0] * x[0] if len(x) else 0.0 for x in emissions]
    for i, x in enumerate(emissions):
        if len(x) == 1:
            out[i][0] = first[i] / (1 + first[i])
    before, after = np.array([first[i] for i, *_ in parts]), np.ones(len(parts))
    long = [k for k, (i, *_) in enumerate(parts) if len(emissions[i]) > STRETCH + 1]
    if long:
        steps = dict(zip(long, _products([parts[k][2] for k in long], move), strict=True))
        for k in long:  # forward, in order of a chain's stretches
            if parts[k][1] > 1:
                m, x = steps[k - 1], before[k - 1]
                before[k] = (m[0, 1] + x * m[1, 1]) / (m[0, 0] + x * m[1, 0])
        for k in reversed(long):
            if k + 1 < len(parts) and parts[k + 1][0] == parts[k][0]:
                m, y = steps[k + 1], after[k + 1]
                after[k] = (m[1, 0] + m[1, 1] * y) / (m[0, 0] + m[0, 1] * y)
    for own in _batches([p for *_, p in parts]):
        pot, there = _padded([parts[k][2] for k in own])
        odds, x, y = np.empty_like(pot), before[own], after[own]
        for t in range(len(pot)):
            x = (c + x * e) / (a + x * d) * pot[t]
            odds[t] = x
        for t in range(len(pot) - 1, -1, -1):
            odds[t] *= y
            w = pot[t] * y
            y = np.where(there[t], (d + e * w) / (a + c * w), y)
        p = (odds / (1 + odds)).T
        for r, k in enumerate(own):
            i, at, x = parts[k]
            out[i][at : at + len(x)] = p[r, : len(x)]
            if at == 1:
                q = first[i] * y[r]
                out[i][0] = q / (1 + q)
    return out


def _batches(rows: list[np.ndarray], most: int = 1024) -> Iterator[list[int]]:
    """Indices of rows, sorted by length, some at a time."""
    order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
    return (order[at : at + most] for at in range(0, len(order), most))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows as columns of an array, padded by ones, and where they are."""
    n = max(map(len, rows))
    pot, there = np.ones((len(rows), n)), np.zeros((len(rows), n), bool)
    for r, x in enumerate(rows):
        pot[r, : len(x)], there[r, : len(x)] = x, True
    return np.ascontiguousarray(pot.T), np.ascontiguousarray(there.T)


def _products(rows: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """For each stretch, the product of its steps between states, up to a factor."""
    out = [np.eye(2)] * len(rows)
    for own in _batches(rows):
        pot, there = _padded([rows[k] for k in own])
        m = np.tile(np.eye(2), (len(own), 1, 1))
        for p, on in zip(pot, there, strict=True):
            step = m @ move[:2]
            step[:, :, 1] *= p[:, None]
            m = np.where(on[:, None, None], step / step.max((1, 2), keepdims=True), m)
        for r, k in enumerate(own):
            out[k] = m[r]
    return out


class Potentials(dict):
    """exp of the emission of each chunk seen; emptied when full, so that memory stays bounded."""

    def __init__(self, weight: np.ndarray, most: int = 600_000):
        super().__init__()
        self.weight, self.most = weight.tolist(), most  # a list is faster to look up one by one

    def __missing__(self, chunk: str) -> float:
        out = math.exp(min(20.0, max(-20.0, sum(map(self.weight.__getitem__, places_of(traits(form_of(chunk))))))))
        if len(self) >= self.most:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


@dataclass
class Tagger:
    """Weights of the hashed features (state 1 against state 0), transitions, and the document logistic."""

    weight: np.ndarray
    move: np.ndarray
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Marginals under this are nothing.
    least: float = 0.05

    def __post_init__(self):
        (a, c), (d, e) = self.move[:2]
        first = self.move[2, 1] / self.move[2, 0]
        #: No marginal reaches ``least`` in a chain whose potentials all stay under this: neighbours raise odds by no more than these ratios.
        self.quiet = self.least / (1 - self.least) / (max(c / a, e / d, first) * max(d / a, e / c, 1.0))
        self.potential = Potentials(self.weight)

    def __reduce__(self):
        return Tagger, (self.weight, self.move, self.logistic, self.least)

    def tag(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Marginals of every token, by text and chain; none for texts of which all stay under ``least``."""
        look, per_text = self.potential.__getitem__, []
        for t in texts:
            loud = max(map(look, t.split()), default=0.0) >= self.quiet
            per_text.append([np.array([*map(look, line.split())]) for line in t.split("\n")] if loud else [])
        flat = iter(marginals([e for chain in per_text for e in chain], self.move))
        return [[next(flat) for _ in chain] for chain in per_text]

    def summary(self, tagged: list[np.ndarray]) -> tuple[float, float, float]:
        """1, the log odds of the largest marginal, and the log of the expected number of toxic tokens."""
        p = np.concatenate(tagged) if tagged else np.zeros(0)
        p = p[p >= self.least]
        if not len(p):
            return 1.0, -6.0, 0.0
        top = min(float(p.max()), 1 - 1e-5)
        return 1.0, float(np.log(top / (1 - top))), float(np.log1p(p.sum()))

    def score(self, tagged: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.logistic, self.summary(tagged)), -30, 30))))


def fit_tagger(sample: list[tuple[int, str, int]], passes: int = 6, batch: int = 512, rate: float = 0.3, seed: int = 3, stands_for: tuple[float, float] = (1.0, 1.0)) -> Tagger | None:
    """The chain trained on tokens that ``telling_traits`` labels, then the logistic on document labels.

    Lines with a toxic token are all used, and twice as many others; steps are scaled by
    the running size of each weight's gradients. ``stands_for``: the labelled documents that
    one of each class in the sample stands for, in the logistic.
    """
    if len({y for _, _, y in sample}) < 2:
        return None
    telling = telling_traits(sample)
    width = len(traits("word"))
    # Tokens are kept as numbers of their forms, 4 bytes each: the driver's memory holds the sample's texts and little more.
    number: dict[str, int] = {}
    places, tells = array("i"), array("b")

    def numbered(chunks: list[str]) -> np.ndarray:
        for form in (forms := [form_of(c) for c in chunks]):
            if form not in number:
                number[form] = len(number)
                names = traits(form)
                places.extend(places_of(names) + [HASHED] * (width - len(names)))
                tells.append(any(n in telling for n in names))
        return np.fromiter(map(number.__getitem__, forms), np.int32, len(forms))

    rng, with_toxic, without = np.random.default_rng(seed), [], []
    for _, text, y in sample:
        for line in text.split("\n"):
            whole = line.split()
            for at in range(0, len(whole), STRETCH):
                own = numbered(whole[at : at + STRETCH])
                (with_toxic if y and any(tells[i] for i in own) else without).append((own, y))
    some = rng.permutation(len(without))[: max(500, 2 * len(with_toxic))]
    rows = with_toxic + [without[i] for i in some]
    place, tell = np.array(places, np.int32).reshape(-1, width), np.array(tells, bool)
    del with_toxic, without, places, tells
    number.clear()
    weight, gsum = np.zeros(HASHED + 1), np.full(HASHED + 1, 1e-6)  # the last place stands for no feature
    weight[places_of(["*"])] = -2.0
    trans, tsum = np.zeros((3, 2)), np.full((3, 2), 1e-6)
    for _ in range(passes):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = sorted((rows[i] for i in order[at : at + batch]), key=lambda r: len(r[0]))
            n = len(part[-1][0])
            there, gold, spots = np.zeros((len(part), n), bool), np.zeros((len(part), n)), np.full((len(part), n, width), HASHED, np.int32)
            for r, (own, y) in enumerate(part):
                there[r, : len(own)], gold[r, : len(own)], spots[r, : len(own)] = True, tell[own] * y, place[own]
            p, pair = chains(np.where(there, np.exp(np.clip(weight[spots].sum(2), -20, 20)), 1.0), there, np.exp(trans))
            miss = np.where(there, gold - p, 0.0)
            grad = np.bincount(spots.ravel(), np.repeat(miss.ravel(), width), HASHED + 1) - 1e-3 * weight
            grad[HASHED] = 0
            g = gold.astype(int)
            want = np.bincount((g[:, :-1] * 2 + g[:, 1:])[there[:, 1:]], minlength=4).reshape(2, 2)
            got = (pair[:, 1:] * there[:, 1:, None]).sum((0, 1)).reshape(2, 2)
            first = np.array([(1 - g[:, 0]).sum() - (1 - p[:, 0]).sum(), g[:, 0].sum() - p[:, 0].sum()])
            tgrad = np.vstack([want - got, first])
            gsum += grad**2
            tsum += tgrad**2
            weight += rate * grad / np.sqrt(gsum)
            trans += 0.3 * rate * tgrad / np.sqrt(tsum)
    out = Tagger(weight[:HASHED].astype(np.float32), np.exp(trans))
    del rows, place
    out.potential.most = 50_000
    x = np.array([out.summary(m) for at in range(0, len(sample), 100) for m in out.tag([t for _, t, _ in sample[at : at + 100]])])
    out.potential = Potentials(out.weight)
    y = np.array([y for _, _, y in sample], float)
    own = np.where(y == 1, stands_for[1], stands_for[0])
    own /= own.mean()
    theta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2]) * len(y)
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        theta -= np.linalg.solve((x * (own * q * (1 - q))[:, None]).T @ x + ridge * 0.1, x.T @ (own * (q - y)) + ridge @ theta * 0.1)
    out.logistic = theta
    return out


def spans_of(text: str, tagged: list[np.ndarray], least: float = 0.5) -> list[tuple[int, int]]:
    """Character offsets of the runs of tokens of a line whose marginal reaches ``least``."""
    flags = (np.concatenate(tagged) if tagged else np.zeros(0)) >= least
    out: list[tuple[int, int]] = []  # a text of quiet tokens has no marginals
    if not flags.any():
        return out
    at, previous, base = 0, False, 0
    for line in text.split("\n"):
        previous = False
        for m in _CHUNK.finditer(line):
            if flags[at]:
                out[-1:] = [(out[-1][0], base + m.end())] if previous else [*out[-1:], (base + m.start(), base + m.end())]
            previous = bool(flags[at])
            at += 1
        base += len(line) + 1
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500, train_docs: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) and spans (offsets of toxic text).

    The tagger learns on the driver from at most ``per_class`` labelled texts a class, those
    of ``train_docs`` if given; its scores keep the mix of all usable labels. ``keep``: further columns of ``docs`` to carry along.
    """
    sample, stands_for = labelled_sample(train_docs if train_docs is not None else docs, labels, "toxic", per_class)
    model = fit_tagger(sample, stands_for=stands_for)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    carried = [c for c in keep or [] if c != "doc_id"]
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                tagged = model.tag(texts) if model else [[] for _ in texts]
                scores = [model.score(m) if model else 0.0 for m in tagged]
                spans = [[{"start": s, "end": e} for s, e in spans_of(t, m)] for t, m in zip(texts, tagged, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind), *b.columns[2:]], names=["doc_id", "_score", "_spans", *carried])

    given = docs.select("doc_id", F.col("text").alias("_text"), *carried)
    scored = given.mapInArrow(run, "doc_id long, _score double, _spans array<struct<start:int,end:int>>" + extra)
    own = [F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_spans").alias("spans")]
    return scored.select("doc_id", *own, *carried)

"""Document quality by multiple-instance learning with gated attention.

Labels mark documents; a document is a bag of passages of 64 words. Each passage is
described by shares of byte classes, word shapes and repetition, and encoded by a small
learned layer; a gated attention learned from the document labels alone weighs the
passages; the score is a logistic function of the weighted passage representation.

Defined results: a null, empty or word-less text is one empty passage and is scored like
any other; texts of any length are read whole, one passage after the other; repeated rows
get equal rows; with no usable labels every score is 0.5; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held_out
from threadloom.llm.hashing import hashes_between
from threadloom.llm.labelled import labelled_sample

PASSAGE = 64  # words
STRETCH = 1 << 20  # bytes that are counted at a time
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&|<>", "'\"()[]{}", "-_/\\@+=~^`")
_CLASS = np.full(256, len(_CLASSES), np.int64)
_CLASS[128:] = len(_CLASSES) + 1
for _i, _own in enumerate(_CLASSES):
    _CLASS[[ord(_c) for _c in _own]] = _i
K = len(_CLASSES) + 2
FEATURES = K + 9
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeats(h: np.ndarray) -> np.ndarray:
    """1.0 where a value has occurred before."""
    out = np.ones(len(h))
    if len(h):
        out[np.unique(h, return_index=True)[1]] = 0.0
    return out


def byte_counts(b: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bytes of each class in each of the ranges between neighbouring cuts; few ranges at a time."""
    out, at = np.empty((len(cuts) - 1, K)), 0
    while at < len(out):
        stop = min(len(out), max(at + 1, int(np.searchsorted(cuts, cuts[at] + STRETCH, side="right")) - 1))
        place = np.repeat(np.arange(stop - at), np.diff(cuts[at : stop + 1]))
        out[at:stop] = np.bincount(place * K + _CLASS[b[cuts[at] : cuts[stop]]], minlength=(stop - at) * K).reshape(-1, K)
        at = stop
    return out


def passages(text: str | None) -> np.ndarray:
    """Features of all passages of a whole text, a row each."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    w = len(start)
    if not w:
        out = np.zeros((1, FEATURES))
        out[0, -1] = 1.0
        return out
    n = -(-w // PASSAGE)
    of_word = np.arange(w) // PASSAGE
    sizes = np.bincount(of_word, minlength=n).astype(float)
    # each byte belongs to the passage whose first word is the last to start at or before it
    cuts = np.concatenate([[0], start[PASSAGE::PASSAGE], [len(b)]])
    counts = byte_counts(b, cuts)
    h = hashes_between(b, start, end)
    size = (end - start).astype(float)
    mean = lambda x: np.bincount(of_word, x, n) / sizes
    same = np.concatenate([[0.0], (h[1:] == h[:-1]).astype(float)])
    h3 = h[2:] * np.uint64(31) + h[1:-1] * _MIX + h[:-2] if w > 2 else h[:0]
    again = np.zeros(w)
    again[: len(h3)] = _repeats(h3)
    local = _repeats(h + of_word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    capital = (_CLASS[b[start]] == 1).astype(float)
    marked = np.isin(_CLASS[b[end - 1]], (5, 6, 7)).astype(float)
    spread = np.sqrt(np.maximum(mean(size**2) - mean(size) ** 2, 0)) / 10
    return np.column_stack([counts / np.diff(cuts)[:, None], mean(size) / 10, spread, mean(same), mean(again), mean(local), mean(capital), mean(marked), np.minimum(counts[:, 4] / sizes, 2), np.zeros(n)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Weights: passage encoder E, attention V (tanh) and U (gate) joined by a, and the classifier c."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights["E"] + self.weights["e"])

    def attend(self, h: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.weights
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * g) @ w["a"]
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        return t, g, s / np.add.reduceat(s, starts)[bag]

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 of each bag."""
        starts = np.cumsum([0, *(len(b) for b in bags)])[:-1]
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        h = self.encode(np.vstack(bags))
        *_, alpha = self.attend(h, starts, bag)
        z = np.add.reduceat(h * alpha[:, None], starts)
        return _sigmoid(z @ self.weights["c"] + self.weights["d"])


def fit_attention(bags: list[np.ndarray], y: np.ndarray, width: int = 16, gates: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 5, stands_for: tuple[float, float] = (1.0, 1.0)) -> AttentionModel:
    """Gradient steps (Adam) on the logistic loss of all bags; the gradient runs back through attention, gates and encoder.

    ``stands_for``: the labelled documents that one bag of each class stands for.
    """
    x = np.vstack(bags)
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    w = {"E": rng.normal(0, f**-0.5, (f, width)), "e": np.zeros(width), "V": rng.normal(0, 0.3, (width, gates)), "U": rng.normal(0, 0.3, (width, gates)), "a": rng.normal(0, 0.3, gates), "c": rng.normal(0, 0.3, width), "d": np.zeros(1)}
    model = AttentionModel(x.mean(0), x.std(0) + 1e-3, w)
    starts = np.cumsum([0, *(len(b) for b in bags)])[:-1]
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    norm = np.clip((x - model.mean) / model.scale, -8, 8)
    share = np.where(y == 1, stands_for[1], stands_for[0])
    share /= share.sum()
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        h = np.tanh(norm @ w["E"] + w["e"])
        t, g, alpha = model.attend(h, starts, bag)
        z = np.add.reduceat(h * alpha[:, None], starts)
        miss = (_sigmoid(z @ w["c"] + w["d"]) - y) * share
        dz = miss[:, None] * w["c"]
        dalpha = (dz[bag] * h).sum(1)
        ds = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[bag])
        dt, dg = ds[:, None] * w["a"] * g * (1 - t**2), ds[:, None] * w["a"] * t * g * (1 - g)
        dh = (dz[bag] * alpha[:, None] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        grad = {"E": norm.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ miss, "d": np.array([miss.sum()])}
        for k in w:
            own = grad[k] + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * own
            second[k] = 0.999 * second[k] + 0.001 * own**2
            w[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on).

    The model learns on the driver from at most ``per_class`` labelled texts a class; its scores
    keep the mix of all usable labels.
    """
    sample, stands_for = labelled_sample(docs, labels, "quality", per_class)
    y = np.array([y for _, _, y in sample], float)
    model = fit_attention([passages(t) for _, t, _ in sample], y, stands_for=stands_for) if len(set(y)) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                score = model.score([passages(t.as_py()) for t in b.column(1)]) if model else np.full(b.num_rows, 0.5)
                score = np.round(score, 9)  # what else is in a batch changes the last bits
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

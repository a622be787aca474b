"""Near-duplicate documents by HyperMinHash, exact in its links.

A document's set holds its distinct k-word shingles. One hash of each shingle picks one of
many buckets; a bucket keeps its minimum as a count of leading zeros and some mantissa bits
(a HyperMinHash register), and empty buckets borrow from filled ones by a fixed rule. Bands
of registers give candidates; compressed registers give a Jaccard estimate, corrected for
registers that agree by chance, which drops hopeless pairs; the rest are confirmed on the
full sets. Components of the confirmed links follow by contraction.

Groups that share a band are never expanded blindly. Documents with equal sets are one
class first. Each band group then compares its members with one hub, the member whose bands
are most shared; once those links are contracted, only pairs that lie in one band group but
in different components are left. Where both are near the hub, what each adds to the hub
tells which pairs can be linked at all; where they are far from it, pairs are checked, after
groups of more than ``crowd`` members are dealt anew by pairs of bands. So pairs in small
groups must share one of 64 bands, and those in large groups two: a pair at 0.85 fails that
with a chance of 2 in a billion and of 4 in 100 million, a pair at 0.8 with one of 8 in a
million and of 1 in 10,000.

Defined results: a null, empty or white-space-only text has an empty set and is linked
with nothing; fewer words than a shingle make one shingle; rows that repeat an id are one
document with the links of all their texts; a row with a null id takes the component of an
equal set, links nothing and is kept; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut
from threadloom.llm.hashing import BASE, hashes_between, mix

BUCKETS, ROWS = 512, 8  # registers; registers in a band
BANDS = BUCKETS // ROWS
SKETCH = 256  # registers that the estimate compares
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


_RNG = np.random.default_rng(20)
_DONORS = _RNG.integers(0, BUCKETS, (24, BUCKETS))
_RANK = _RNG.integers(0, 2**32, (BUCKETS, BUCKETS), dtype=np.uint32)

def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: maximal runs of bytes that are not white space, A-Z in lower case."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return hashes_between(raw, start, end)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * BASE + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a set: leading zeros (6 bits) and mantissa (10 bits) of each bucket's minimum."""
    bucket = (shingles >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # sorted: a bucket's first is its minimum
    low = ((shingles[first] & np.uint64((1 << 55) - 1)) >> np.uint64(2)).astype(np.float64)
    part, size = np.frexp(low)
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = ((53 - size).astype(np.uint16) << 10) | ((part * 2048).astype(np.uint16) & 1023)
    full = np.zeros(BUCKETS, bool)
    full[bucket[first]] = True
    if len(first) < BUCKETS:
        gaps, donors = np.flatnonzero(~full), np.empty(0, np.int64)
        source = np.arange(BUCKETS)
        for row in _DONORS:
            donors = row[gaps]
            ok = full[donors]
            source[gaps[ok]] = donors[ok]
            gaps = gaps[~ok]
            if not len(gaps):
                break
        if len(gaps):  # few buckets are full: each gap takes the one that it ranks least, so that one more or less seldom matters
            own = bucket[first]
            source[gaps] = own[np.argmin(_RANK[gaps[:, None], own], axis=1)]
        out = out[source]
    return out


_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_keys(regs: np.ndarray) -> np.ndarray:
    halves = regs.reshape(BANDS, ROWS).copy().view(np.uint64)
    return mix(mix(halves[:, 0] + _BAND_SALT) * BASE + halves[:, 1]).view(np.int64)


def compressed(regs: np.ndarray) -> bytes:
    """A byte a register: two bits of the leading zeros and six of the mantissa."""
    r = regs[:: BUCKETS // SKETCH]
    return (((r >> 10) & 3) << 6 | (r >> 4) & 63).astype(np.uint8).tobytes()


def _zeros(n: np.ndarray) -> np.ndarray:
    """Chances of each remainder of the leading zeros by 4 in a register of a set of n shingles.

    A bucket that isn't empty holds about max(1, n / BUCKETS) of them, and its minimum has
    z zeros if it lies between 2**-(z + 1) and 2**-z.
    """
    k = np.maximum(1.0, np.asarray(n, float) / BUCKETS)[:, None]
    edges = (1 - 0.5 ** np.arange(41)) ** k
    return np.diff(edges, axis=1).reshape(len(k), 10, 4).sum(1)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Chance that two unlike registers agree once compressed, by the sizes of their sets."""
    return (_zeros(n_a) * _zeros(n_b)).sum(1) / 64


def estimates(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from compressed registers, corrected for agreement by chance."""
    if not len(a):
        return np.zeros(0)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, SKETCH) for s in (a, b))
    same, c = (x == y).sum(1) / SKETCH, chance(n_a, n_b)
    return (same - c) / (1 - c)


def sketches(docs: DataFrame, shingle_words: int, small: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128-bit digest of the set), bands, sketch (null for up to ``small`` shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, da, db, bands, sk = [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), shingle_words)
                n.append(len(s))
                da.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
                db.append(int(np.sum(mix(s ^ BASE))) if len(s) else 0)
                regs = registers(s) if len(s) > small else None
                bands.append(None if regs is None else band_keys(regs))
                sk.append(None if regs is None else compressed(regs))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(da, np.uint64).view(np.int64)), pa.array(np.array(db, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bands, pa.list_(pa.int64())), pa.array(sk, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


#: Pairs less similar than this are only called far.
FAR = 0.2
CHUNK = 512  # members that meet a copy of their hub's text


def compared(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle_words: int, least: float) -> DataFrame:
    """Pairs (a, b) of class representatives with n_a, n_b and ``same``, the size of the intersection of their full sets.

    Pairs whose estimate is five standard errors under ``least`` stay as they are, with
    ``same`` 0: a pair at ``least`` meets that with a chance under one in a million. ``added``: the hashes of b's shingles that a lacks, in order, for pairs that
    are not far.
    """
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    sized = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # A set fills about half as many of the compared registers as it has shingles.
    error = F.sqrt(F.lit(25 * 0.25 if least < 0.5 else 25 * least * (1 - least)) / F.least(F.col("n_a") / 2, F.col("n_b") / 2, F.lit(float(SKETCH))))

    @F.pandas_udf("double")
    def similar(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(estimates(x.tolist(), y.tolist(), n.to_numpy(), m.to_numpy()))

    rated = cut(sized.select("a", "b", "n_a", "n_b", (similar("sketch_a", "sketch_b", "n_a", "n_b") >= F.lit(least) - error).alias("near")).distinct())
    own = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            sizes, same, added = [], [], []
            for i in range(batch.num_rows):
                sets = []
                for c in ("text_a", "text_b"):
                    t = batch.column(c)[i].as_py()
                    if t not in seen:
                        if len(seen) >= 32:
                            seen.clear()
                        seen[t] = shingle_set(t, shingle_words)
                    sets.append(seen[t])
                new = np.setdiff1d(sets[1], sets[0], assume_unique=True)
                sizes.append((len(sets[0]), len(sets[1])))
                same.append(len(sets[1]) - len(new))
                far = same[-1] < FAR * (len(sets[0]) + len(new))
                added.append(new[: 0 if far else None].view(np.int64))
            n_a, n_b = (pa.array([x[k] for x in sizes], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), n_a, n_b, pa.array(same, pa.int64()), pa.array(added, pa.list_(pa.int64()))], names=["a", "b", "n_a", "n_b", "same", "added"])

    schema = "a long, b long, n_a long, n_b long, same long, added array<long>"
    # A hub meets its members in chunks of about CHUNK, so that its text travels once a chunk.
    close = rated.filter("near").select("a", "b")
    chunks = close.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = close.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b").join(own("b"), "b")
    hubs = chunks.join(own("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "text_a")
    full = dealt.join(hubs, ["a", "chunk"]).select("a", "b", "text_a", "text_b").mapInArrow(run, schema)
    far = rated.filter("not near").select("a", "b", "n_a", "n_b", F.lit(0).cast("long").alias("same"), F.array().cast("array<long>").alias("added"))
    return cut(full.union(far))


def links_of(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(F.expr(f"same > 0 and 100 * same >= {percent} * (n_a + n_b - same)")).select("a", "b").distinct()


def through_hubs(stars: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of members of one star, in different components, that may reach the similarity.

    Let the hub h have n shingles and share s with a member x and t with a member y. What x
    and y share lies in h, at most min(s, t), or among the shingles that both add to h.
    They must share p / (1 + p) of their sizes, so min(s, t) leaves a number of shared
    additions to be found. Where that is none, one of them is smaller than h, as neither
    may be linked through h. Else they have one of their first additions in common, by the
    usual bound on prefixes of an order, and both have that many that others add too.
    """
    f = percent / (100 + percent)
    label = lambda c: part.select(F.col("doc_id").alias(c), F.col("component").alias(f"part_{c}"))
    spokes = stars.drop("added").join(label("a"), "a", "left").join(label("b"), "b", "left")
    spokes = spokes.select(F.col("a").alias("hub"), F.col("b").alias("v"), F.col("n_a").alias("n_hub"), F.col("n_b").alias("n"), "same", F.coalesce("part_b", "b").alias("part"), F.coalesce("part_a", "a").alias("hub_part"))
    out = F.col("part") != F.col("hub_part")
    some = spokes.groupBy("hub").agg(F.count("*").alias("members"), F.bool_or(out).alias("any_out"), F.min("n").alias("least_n")).filter("members > 1 and any_out").select("hub", "least_n")
    # ``need``: additions that x shares with any y it is linked to, at least
    need = F.greatest(F.ceil(F.lit(f) * (F.col("n") + F.greatest(F.col("least_n").cast("double"), F.col("n") * (percent / 100))) - F.col("same") - 1e-6), F.lit(0))
    spokes = cut(spokes.join(some, "hub").withColumn("need", need).filter("n - same >= need"))
    added = spokes.join(stars.select(F.col("a").alias("hub"), F.col("b").alias("v"), "added"), ["hub", "v"])
    firsts = added.select("hub", "v", "part", F.explode(F.slice("added", F.lit(1), F.size("added") - F.greatest(F.col("need"), F.lit(1)).cast("int") + 1)).alias("e"))
    mixed = lambda df: df.groupBy("hub", "e").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("hub", "e")
    firsts = cut(firsts.join(mixed(firsts), ["hub", "e"]))
    met = added.join(firsts.select("hub", "v").distinct(), ["hub", "v"], "left_semi").select("hub", "v", "part", F.explode("added").alias("e"))
    met = met.join(mixed(met), ["hub", "e"]).groupBy("hub", "v").agg(F.count("*").alias("shared"))
    able = spokes.join(met, ["hub", "v"]).filter("shared >= need").select("hub", "v", "n", "same", "n_hub", "shared")
    firsts = firsts.join(able, ["hub", "v"])
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    enough = f"least(x.same, y.same) + least(x.shared, y.shared) >= {f!r} * (x.n + y.n) - 1e-6"
    by_added = firsts.alias("x").join(firsts.alias("y"), F.expr(f"x.hub = y.hub and x.e = y.e and x.v < y.v and x.part <> y.part and {fits} and {enough}")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    held = spokes.filter(F.expr(f"100 * same >= {percent} * n"))
    small, loose = held.filter("n < n_hub"), held.filter(out)
    by_size = loose.alias("x").join(small.alias("y"), F.expr(f"x.hub = y.hub and x.part <> y.part and {fits} and least(x.same, y.same) >= {f!r} * (x.n + y.n) - 1e-6"))
    by_size = by_size.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b"))
    return by_added.union(by_size).distinct()


FEW = 200_000  # directed edges (16 bytes each) that one task joins


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, p): each vertex and the least one of its component, for edges of both directions."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    x, y = ends.reshape(2, -1)
    least = np.arange(len(ids))
    while (least[x] != least[y]).any():
        np.minimum.at(least, least[x], least[y])  # roots point at the least root next to them
        while (least[least] != least).any():
            least = least[least]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[least])], names=["a", "p"])


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): the least id that each vertex of the undirected edges (a, b) reaches.

    In each round vertices have new random ranks, each points at the one of least rank among
    its neighbours and itself, pointers are followed once, and the graph is contracted along
    them until no edge is left. Random ranks make every component shrink by a constant factor
    a round however its ids lie, so rounds grow with the logarithm of its size. All steps
    are joins on ids. Once at most ``FEW`` rows are left, one task ends what many small jobs
    would, each of which takes the driver's memory; more are never gathered.
    """
    both = cut(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.select(F.col("a").alias("doc_id")).distinct()
    steps: list[DataFrame] = []
    while left := both.count():
        if left <= FEW:
            steps.append(cut(both.coalesce(1).mapInArrow(_ended, "a long, p long")))
            break
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("r"), F.col(c).alias("p"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least("least", rank("a"))["p"].alias("p"))
        steps.append(cut(near.join(near.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))))
        to = lambda c: steps[-1].select(F.col("a").alias(c), F.col("p").alias(f"new_{c}"))
        both = cut(both.join(to("a"), "a").join(to("b"), "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).filter("a <> b").distinct())
    root = labels.withColumn("root", F.col("doc_id"))
    for n, step in enumerate(steps, 1):
        root = root.join(step.select(F.col("a").alias("root"), "p"), "root", "left").select("doc_id", F.coalesce("p", "root").alias("root"))
        root = cut(root) if n % 4 == 0 else root  # plans of many joins take the driver's memory
    root = cut(root)
    return cut(root.join(root.groupBy("root").agg(F.min("doc_id").alias("component")), "root").select("doc_id", "component"))


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, crowd: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), kept (it is that id).

    Links: 100 * intersection >= percent * union of the shingle sets. ``crowd``: band groups
    of more members that are still unlinked are dealt anew by pairs of bands.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # sets of so few shingles that one more or less breaks the threshold are linked to equal sets only
    small = -(-percent // (100 - percent)) - 1 if percent < 100 else 2**62
    made = cut(sketches(docs, shingle_words, small))  # read several times, so that texts are hashed once
    digest = ["n_shingles", "set_a", "set_b"]
    classes = cut(made.filter("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    # an id with several sets links their classes
    set_of = F.struct(*digest)
    several = made.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(set_of).alias("lo"), F.max(set_of).alias("hi")).filter("lo < hi").select("doc_id")
    several = cut(several)
    same_id = made.join(several, "doc_id", "left_semi").join(classes, digest).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    reps = made.filter("bands is not null and doc_id is not null").join(classes.select(*digest, F.col("rep").alias("doc_id")), ["doc_id", *digest], "left_semi")
    reps = cut(reps.dropDuplicates(["doc_id", *digest]).select("doc_id", "n_shingles", "bands", "sketch"))
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("v"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    member = cut(keyed.join(shared, "key"))
    texts = cut(docs.join(member.select(F.col("v").alias("doc_id")).distinct(), "doc_id", "left_semi").distinct())
    hubs = member.groupBy("v").agg(F.sum("size").alias("weight"))
    weighed = member.join(hubs, "v").select("key", "v", "weight")
    hub = weighed.groupBy("key").agg(F.max_by("v", F.struct("weight", -F.col("v"))).alias("hub"))
    stars = cut(member.join(hub, "key").select("key", F.col("hub").alias("a"), F.col("v").alias("b")).filter("a <> b"))
    stars_by_pair = compared(stars.select("a", "b").distinct(), reps, texts, shingle_words, FAR)
    links = links_of(stars_by_pair, percent)
    part = components(links if several.isEmpty() else links.union(same_id))

    # Left are pairs in one band group but in different components so far. If one of them is
    # far from the hub, the other can't be closer than ``FAR`` and the distance of a link.
    known = stars_by_pair.withColumn("j", F.col("same") / (F.col("n_a") + F.col("n_b") - F.col("same")))
    near_hub = through_hubs(known.filter(F.col("j") >= FAR), part, percent)
    distance = 1 - F.col("j")
    reach = known.filter(F.col("j") < FAR + 1 - percent / 100).select("a", "b", F.col("n_b").alias("n"), F.when(F.col("same") == 0, 1 - FAR).otherwise(distance).alias("d_from"), distance.alias("d_to"))
    loose = stars.join(reach, ["a", "b"]).withColumnRenamed("b", "v")
    placed = loose.join(part.withColumnRenamed("doc_id", "v"), "v", "left").select("key", "v", "n", "d_from", "d_to", F.coalesce("component", "v").alias("part"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("members"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("key", "members")
    left = cut(placed.join(open_keys, "key"))
    if not left.isEmpty():
        row = ["v", "n", "d_from", "d_to", "part"]
        large = left.filter(F.col("members") > crowd).select("key", *row)
        again = large.join(left.select(F.col("key").alias("second"), "v"), "v").filter("key < second").select(F.xxhash64("key", "second").alias("key"), *row)
        pool = left.filter(F.col("members") <= crowd).select("key", *row).union(again)
        # distances to the hub of linked members differ by no more than a link's distance
        gap = 1 - percent / 100 + 1e-9
        alike = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and x.d_from <= y.d_to + {gap!r} and y.d_from <= x.d_to + {gap!r}"
        near_hub = near_hub.union(pool.alias("x").join(pool.alias("y"), F.expr(f"x.key = y.key and x.v < y.v and x.part <> y.part and {alike}")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b")))
    rest = cut(near_hub.distinct())
    more = cut(links_of(compared(rest, reps, texts, shingle_words, percent / 100), percent))
    if not more.isEmpty():  # few, and only between components: these are joined, not their members
        of = lambda c: part.select(F.col("doc_id").alias(c), F.col("component").alias(f"part_{c}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
        joined = components(ends).withColumnRenamed("doc_id", "old")
        known = part.select("doc_id", F.col("component").alias("old")).join(joined, "old", "left").select("doc_id", F.coalesce("component", "old").alias("component"))
        alone = joined.join(part.select(F.col("component").alias("old")), "old", "left_anti").select(F.col("old").alias("doc_id"), "component")
        part = cut(known.union(alone))

    # Classes with over a thousandth of all rows are at most a thousand and travel by broadcast, so that no task gets a large one whole.
    label = cut(classes.join(part.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*digest, "size", F.coalesce("component", "rep").alias("component_id")))
    share = made.count() // 1000
    row = ["doc_id", "n_shingles", "component_id"]
    met = made.select("doc_id", *digest).join(F.broadcast(label.filter(F.col("size") > share).drop("size")), digest, "left")
    done = "n_shingles = 0 or component_id is not null"
    some = met.filter(f"not ({done})").drop("component_id").join(label.filter(F.col("size") <= share).drop("size"), digest, "left")
    out = met.filter(done).select(*row).union(some.select(*row)).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Exact Jaccard similarity join of documents' shingle sets, by pivots in a metric space.

Jaccard distance is a metric, so a document's distance to a pivot bounds its distance to any
other document that has been measured from there. Documents with equal sets are one class
first. Then regions are joined in two levels:

1. Pivots are sampled sets more than the radius apart. Every task holds them all as an
   inverted index, so each document's distance to every pivot is exact and costs no shuffle.
   A document lies in the Voronoi region of its nearest pivot, if within the radius. With
   ``reach`` the greatest distance of a link, it is replicated, as a guest, to each other
   region whose pivot is no farther than its own plus twice the reach, and no farther than the
   radius plus the reach. By the triangle inequality a linked pair then meets in the
   region of either one: from home p and its partner's home q follow d(y, p) <= d(x, p) +
   reach <= d(x, q) + reach <= d(y, q) + 2 reach. Members within reach of the pivot are
   linked through it; the rest are compared with members at like distances only (bands of
   the reach's width and their neighbours), by bit maps of the pivot's shingles: two can't
   share more than the common bits and the fewer of the shingles that either has besides.
2. Documents far from all pivots form the remaining region, which is cut by their rarest
   shingles: in an order of shingles that puts frequent ones last, a linked pair shares one
   of the first n - ceil(t n) + 1. Shingles are counted on one document in ``EVERY``, so that
   one that many unlike documents share comes last however few of all documents they are,
   and groups don't grow with the input. Each group of documents that share such
   a shingle takes as its pivot the member of least id, as others do that it is in, and is joined like a region:
   exact distances to the pivot for those that may be linked to it by their sizes and the
   places of what they share in the order, links through it, then pairs that may be linked
   so, whose distances, where known, differ by no more than the reach, and whose tallies of
   shingles by bins allow it. Tallies are a small part of a text, and most pairs end there.

Whatever is left is confirmed on full sets. Only pairs between components so far are left,
as components are what is asked for; none between linked ones is needed. Large regions and
groups are dealt by pairs of blocks, so that no task gets one whole.

Sample and counts fix where pivots lie and the order of shingles, hence the cost and not the
result. The sample is the ``SAMPLE`` texts least by hash, of at most ``LONGEST`` shingles each.

Defined results: a null, empty or white-space-only text has an empty set and is linked
with nothing; fewer words than a shingle make one shingle; rows that repeat an id are one
document with the links of all their texts; a row with a null id takes the component of an
equal set and links nothing; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import cut
from threadloom.llm.hashing import BASE, mix
from threadloom.llm.near_dedup import components, shingle_set

SAMPLE, LONGEST = 1024, 4096
SAFE = 1e-9  # distances are compared with so much room
BLOCK = 512  # members of a region or group that meet another block at a time
EVERY, OFTEN = 8, 3  # one document in so many is counted; a shingle in so many of those is frequent
FREQUENT = 1 << 18  # shingles that every task knows as frequent, at most: the most frequent ones
PER_BIN = 4  # shingles of a set in a bin of its tally, at most on average
CHUNK = 512  # members that meet a copy of their pivot's text
IDS = 500_000  # ids of texts to be fetched that are broadcast; more are shuffled


def radius_for(percent: int) -> float:
    """Radius of regions: half way to the distance at which a guest shares nothing with a pivot, and at most a half."""
    return min(0.5, percent / 200)


class Pivots:
    """Sampled sets as an inverted index; ``chosen`` are those that lie more than ``radius`` apart."""

    def __init__(self, sets: list[np.ndarray], radius: float) -> None:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.shingles, self.count = np.unique(flat, return_counts=True)
        self.start = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.owner = owner[order].astype(np.int32)
        self.size = np.array([len(s) for s in sets], np.int64)
        chosen = np.zeros(len(sets), bool)
        for i, s in enumerate(sets):
            same = self.common(self.places(s))
            near = 1 - same / (self.size[i] + self.size - same) <= radius
            chosen[i] = not (near & chosen).any()
        self.number = np.full(len(sets), -1, np.int64)
        self.number[chosen] = np.arange(chosen.sum())
        keep = chosen[self.owner]
        rows = np.repeat(np.arange(len(self.shingles)), self.count)[keep]
        self.owner = self.number[self.owner[keep]].astype(np.int32)
        self.start = np.searchsorted(rows, np.arange(len(self.shingles) + 1))
        self.size = self.size[chosen]
        self.sets = [s for s, c in zip(sets, chosen) if c]

    def places(self, s: np.ndarray) -> np.ndarray:
        """Place of each shingle in the index, -1 where it isn't there."""
        if not len(self.shingles):
            return np.full(len(s), -1)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, at, -1)

    def common(self, places: np.ndarray) -> np.ndarray:
        """Size of the intersection with every pivot."""
        at = places[places >= 0]
        first, n = self.start[at], self.start[at + 1] - self.start[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.owner[np.repeat(first, n) + inner], minlength=len(self.size))


def sampled(docs: DataFrame, k: int, least: int) -> list[np.ndarray]:
    """Sets of the ``SAMPLE`` distinct texts of least hash, without those under ``least`` or over ``LONGEST`` shingles."""
    some = docs.filter("text is not null").select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), k) for t in b.column(1)]
            rows = [(h.as_py(), s.tobytes()) for h, s in zip(b.column(0), sets) if least <= len(s) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], names=["h", "shingles"])

    texts = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(some), "h").groupBy("h").agg(F.min("text").alias("text"))
    rows = texts.select("h", "text").mapInArrow(run, "h long, shingles binary").collect()
    return [np.frombuffer(r["shingles"], np.uint64) for r in sorted(rows, key=lambda r: r["h"])]


def frequent(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order and in how many of the counted documents each is; at most ``FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), k).view(np.int64))], names=["shingle"])

    some = docs.filter(f"text is not null and pmod(xxhash64(doc_id, 11), {EVERY}) = 0").select("text")
    counts = cut(some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN))
    least, room = OFTEN, FREQUENT
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["n"]):
        room -= r["rows"]
        if room < 0:
            least = r["n"] + 1
            break
    found = counts.filter(F.col("n") >= least).toArrow()
    shingles, n = found.column("shingle").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def first_shingles(s: np.ndarray, seen: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Those of a set of which a linked set must have one, rarest first: by their counts in ``often``, then ``seen``, then themselves."""
    shingles, n = often
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
        counted = np.where(shingles[at] == s, n[at], 0)
    else:
        counted = np.zeros(len(s), np.int64)
    return s[np.lexsort((s, seen, counted))[: len(s) + percent * len(s) // -100 + 1]]


def tallied(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of 2**i bins by their last bits, a byte each; two to ``PER_BIN`` a bin."""
    bins = 1
    while bins * PER_BIN < len(s):
        bins *= 2
    while (n := np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)).max(initial=0) > 255:
        bins *= 2
    return n.astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes) -> int:
    """The intersection's size is at most this: in no bin do two sets share more than the fewer of their shingles."""
    a, b = sorted((np.frombuffer(t, np.uint8) for t in (x, y)), key=len)
    if len(a) < len(b):  # bins by fewer last bits
        b = b.reshape(-1, len(a)).sum(0, dtype=np.int64)
    return int(np.minimum(a, b).sum(dtype=np.int64))


def possible(pairs: DataFrame, tallies: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that may be linked by the ``tallies`` of their sets (doc_id, n, tally); others can't be."""
    side = lambda c: tallies.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tally").alias(f"tally_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = np.fromiter((most_common(x.as_py(), y.as_py()) for x, y in zip(b.column("tally_a"), b.column("tally_b"), strict=True)), np.int64, b.num_rows)
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            ok = pa.array((100 + percent) * most >= percent * n)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(ok)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "n_b", "tally_a", "tally_b").mapInArrow(run, "a long, b long")


def measured(docs: DataFrame, pivots: Pivots, often: tuple[np.ndarray, np.ndarray], k: int, percent: int, small: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (digest), regions (pivot p of m shingles, s shared, whether it is home, bits), keys and tally.

    ``keys``: the first shingles of a document that no region is home to; ``tally``: what ``tallied`` makes of its set.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pivots, often))
    reach, radius = 1 - percent / 100, radius_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, often = shared.value
        region = pa.list_(pa.struct([("p", pa.int32()), ("m", pa.int32()), ("s", pa.int32()), ("home", pa.bool_()), ("bits", pa.binary())]))
        for b in batches:
            n, da, db, regions, keys, tally = [], [], [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), k)
                n.append(len(s))
                da.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(1)))) if len(s) else 0)
                db.append(int(np.sum(mix(s ^ BASE))) if len(s) else 0)
                if len(s) <= small:
                    regions.append(None)
                    keys.append(None)
                    tally.append(None)
                    continue
                at = pivots.places(s)
                same = pivots.common(at)
                met = np.flatnonzero(same)
                far = 1 - same[met] / (len(s) + pivots.size[met] - same[met])
                home = int(np.argmin(far)) if len(met) and far.min() <= radius else -1
                limit = min(far[home] + 2 * reach, radius + reach) if home >= 0 else radius + reach
                found = []
                for i in np.flatnonzero(far <= limit + SAFE):
                    p = int(met[i])
                    bits = np.packbits(np.isin(pivots.sets[p], s, assume_unique=True)).tobytes()
                    found.append({"p": p, "m": int(pivots.size[p]), "s": int(same[p]), "home": bool(i == home), "bits": bits})
                regions.append(found)
                if home >= 0:
                    keys.append(None)
                    tally.append(None)
                    continue
                seen = np.where(at >= 0, pivots.count[at] if len(pivots.count) else 0, 0)
                keys.append(first_shingles(s, seen, often, percent).view(np.int64))
                tally.append(tallied(s))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(np.array(da, np.uint64).view(np.int64)), pa.array(np.array(db, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(regions, region), pa.array(keys, pa.list_(pa.int64())), pa.array(tally, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "regions", "keys", "tally"])

    kind = "array<struct<p:int,m:int,s:int,home:boolean,bits:binary>>"
    return docs.mapInArrow(run, f"doc_id long, n_shingles long, set_a long, set_b long, regions {kind}, keys array<long>, tally binary")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) with n_a, n_b and ``same``, the size of the intersection of their full sets; written.

    An ``a`` meets its partners in chunks of about ``CHUNK``, so that its text travels once a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, np.ndarray] = {}
            rows = []
            for i in range(batch.num_rows):
                sets = []
                for c in ("text_a", "text_b"):
                    t = batch.column(c)[i].as_py()
                    if t not in seen:
                        if len(seen) >= 32:
                            seen.clear()
                        seen[t] = shingle_set(t, k)
                    sets.append(seen[t])
                rows.append((len(sets[0]), len(sets[1]), len(np.intersect1d(sets[0], sets[1], assume_unique=True))))
            cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *cols], names=["a", "b", "n_a", "n_b", "same"])

    wanted = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = cut(texts.join(F.broadcast(wanted) if wanted.count() <= IDS else wanted, "doc_id", "left_semi"))
    own = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    pivots = chunks.join(own("a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "text_a")
    dealt = dealt.join(own("b"), "b")
    full = dealt.join(pivots.hint("merge"), ["a", "chunk"]).select("a", "b", "text_a", "text_b")
    return cut(full.mapInArrow(run, "a long, b long, n_a long, n_b long, same long"))


def able(x: str, y: str, percent: int) -> str:
    """SQL: two rows of a group may be linked, by their sizes n and the places of their first common shingle.

    Nothing before those places is shared, so what is left of either set must hold all that is.
    """
    share = f"{percent} * ({x}.n + {y}.n)"
    return " and ".join(f"{100 + percent} * ({z}.n - {z}.place) >= {share}" for z in (x, y)) + f" and {100 + percent} * least({x}.n, {y}.n) >= {share}"


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.filter(F.expr(f"same > 0 and 100 * same >= {percent} * (n_a + n_b - same)")).select("a", "b").distinct()


def region_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of one region, of different components, that may be linked.

    ``members``: p, v, n, m, s, home, bits, part and ``main``, the component of the region's pivot.
    """
    reach = 1 - percent / 100
    members = members.withColumn("far", 1 - F.col("s") / (F.col("n") + F.col("m") - F.col("s"))).withColumn("alone", F.coalesce(F.col("part") != F.col("main"), F.lit(True)))
    band, low, high = (F.floor(x / reach).cast("int") for x in (F.col("far"), F.col("far") - SAFE - reach, F.col("far") + SAFE + reach))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("v"), F.col(c)).cast("int")
    row = ["v", "n", "s", "home", "bits", "part"]
    loners = members.filter("alone").withColumn("band", band)
    # of two loners the one nearer to the pivot goes to the other's band, so loners go to no lower one
    others = members.withColumn("band", F.explode(F.sequence(F.when(F.col("alone"), band).otherwise(low), high)))
    count = lambda side: F.sum((F.col("side") == side).cast("int"))
    cells = loners.select("p", "band", F.lit(0).alias("side")).union(others.select("p", "band", F.lit(1).alias("side"))).groupBy("p", "band")
    cells = cells.agg(F.ceil(count(0) / BLOCK).cast("int").alias("loner_blocks"), F.ceil(count(1) / BLOCK).cast("int").alias("blocks"), count(1).alias("all"))
    cells = F.broadcast(cut(cells.filter("loner_blocks > 0 and all > 1")))
    loners = loners.join(cells, ["p", "band"]).withColumn("x", dealt("loner_blocks")).withColumn("y", each("blocks"))
    others = others.join(cells, ["p", "band"]).withColumn("y", dealt("blocks")).withColumn("x", each("loner_blocks"))
    key = ["p", "band", "x", "y"]
    both = loners.select(*key, F.lit(0).alias("side"), *row).union(others.select(*key, F.lit(1).alias("side"), *row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, ([], [])
        for b in batches:
            for r in b.to_pylist():
                now = (r["p"], r["band"], r["x"], r["y"])
                if now != cell:
                    yield _close(rows, percent)
                    cell, rows = now, ([], [])
                rows[r["side"]].append(r)
        yield _close(rows, percent)

    sorted_cells = both.repartition(*key).sortWithinPartitions(*key, "side")
    return sorted_cells.mapInArrow(run, "a long, b long").distinct()


def _close(rows: tuple[list[dict], list[dict]], percent: int) -> pa.RecordBatch:
    """Pairs of a cell's loners and members that the pivot's bit maps don't rule out."""
    out_a, out_b = [], []
    if rows[0] and rows[1]:
        bits, n, spare, part, v, home = [], [], [], [], [], []
        for side in rows:
            width = -(-len(side[0]["bits"]) // 8) * 8
            bits.append(np.frombuffer(b"".join(r["bits"].ljust(width, b"\0") for r in side), np.uint64).reshape(len(side), -1))
            n.append(np.array([r["n"] for r in side]))
            spare.append(np.array([r["n"] - r["s"] for r in side]))
            part.append(np.array([r["part"] for r in side]))
            v.append(np.array([r["v"] for r in side]))
            home.append(np.array([r["home"] for r in side]))
        for i in range(len(rows[0])):
            most = np.bitwise_count(bits[1] & bits[0][i]).sum(1, dtype=np.int64) + np.minimum(spare[1], spare[0][i])
            ok = ((100 + percent) * most >= percent * (n[1] + n[0][i])) & (part[1] != part[0][i]) & (home[1] | home[0][i])
            found = v[1][ok]
            out_a.append(np.minimum(found, v[0][i]))
            out_b.append(np.maximum(found, v[0][i]))
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=["a", "b"])


def group_pairs(member: DataFrame, known: DataFrame, part: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) that share one of their first shingles, of different components, that may be linked.

    ``member``: key, v, n, place and ``pivot``, a row of the group's pivot; ``known``: (a, b, n_a, n_b, same) of pivots a.
    """
    reach = 1 - percent / 100 + SAFE
    far = 1 - F.col("same") / (F.col("n_a") + F.col("n_b") - F.col("same"))
    distance = known.select(F.col("a").alias("hub"), F.col("b").alias("v"), far.alias("far"))
    rows = member.withColumn("hub", F.col("pivot.v")).drop("pivot").filter("v <> hub")
    rows = rows.join(part.withColumnRenamed("doc_id", "v"), "v", "left").withColumn("part", F.coalesce("component", "v")).drop("component")
    open_keys = rows.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("left")).filter("lo < hi").select("key", F.ceil(F.col("left") / BLOCK).cast("int").alias("blocks"))
    rows = cut(rows.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")))
    # a table broadcast by several keys takes 64 MB of the driver's heap, however small it is: such joins are merged
    rows = cut(rows.join(distance.hint("merge"), ["hub", "v"], "left"))
    cols = ["key", "v", "n", "place", "far", "part"]
    # block pairs (i <= j) of a group: each row goes to as many cells as there are blocks
    left = rows.select(*cols, F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    right = rows.select(*cols, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    met = F.expr(f"x.key = y.key and x.i = y.i and x.j = y.j and (x.i < x.j or x.v < y.v) and x.part <> y.part and coalesce(abs(x.far - y.far) <= {reach!r}, true) and {able('x', 'y', percent)}")
    return left.alias("x").join(right.alias("y").hint("merge"), met).select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct()


def jaccard_components(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (least id reachable by links).

    Links: 100 * intersection >= percent * union of the sets of ``shingle_words``-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # sets of so few shingles that one more or less breaks the threshold are linked to equal sets only
    small = -(-percent // (100 - percent)) - 1 if percent < 100 else 2**62
    pivots = Pivots(sampled(docs, shingle_words, small + 1), radius_for(percent))
    made = cut(measured(docs, pivots, frequent(docs, shingle_words), shingle_words, percent, small))
    digest = ["n_shingles", "set_a", "set_b"]
    classes = cut(made.filter("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    # an id with several sets links their classes
    set_of = F.struct(*digest)
    several = made.filter("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(set_of).alias("lo"), F.max(set_of).alias("hi")).filter("lo < hi").select("doc_id")
    several = cut(several)
    same_id = made.join(several, "doc_id", "left_semi").join(classes, digest).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    found = made.filter("doc_id is not null and (keys is not null or size(regions) > 0)")
    reps = found.join(classes.select(*digest, F.col("rep").alias("doc_id")), ["doc_id", *digest], "left_semi")
    reps = reps.dropDuplicates(["doc_id", *digest])

    # First level: regions of the sampled pivots.
    regions = cut(reps.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("n"), F.inline("regions")))
    through = regions.filter(F.expr(f"100 * s >= {percent} * (n + m - s)"))
    roots = cut(through.groupBy("p").agg(F.min("v").alias("root")))  # a row a pivot
    links = through.join(F.broadcast(roots), "p").select(F.col("v").alias("a"), F.col("root").alias("b")).filter("a <> b")

    # Second level: groups that share one of their first shingles.
    packed = F.shiftleft("n_shingles", 32) + F.col("place")  # a row of three numbers is shuffled
    keyed = reps.select("doc_id", "n_shingles", F.posexplode("keys").alias("place", "key")).select("key", F.col("doc_id").alias("v"), packed.alias("packed"))
    group = Window.partitionBy("key")
    met = keyed.withColumn("first", F.min(F.struct("v", "packed")).over(group)).withColumn("last", F.max("v").over(group)).filter("first.v < last")
    parts = lambda c: (F.shiftright(c, 32).alias("n"), F.col(c).bitwiseAND(F.lit(2**32 - 1)).alias("place"))
    member = cut(met.select("key", "v", *parts("packed"), F.struct("first.v", *parts("first.packed")).alias("pivot")))
    once = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    texts = docs if once else docs.distinct()
    stars = cut(member.alias("x").filter(F.expr(f"x.v <> x.pivot.v and {able('x', 'x.pivot', percent)}")).select(F.col("x.pivot.v").alias("a"), F.col("x.v").alias("b")).distinct())
    known = confirmed(stars, texts, shingle_words)
    links = links.union(linked(known, percent))
    part = components(links if several.isEmpty() else links.union(same_id))

    # Both levels: what isn't linked through a pivot yet.
    label = part.select(F.col("doc_id").alias("v"), F.col("component"))
    main = roots.join(label.withColumnRenamed("v", "root"), "root", "left").select("p", F.coalesce("component", "root").alias("main"))
    placed = cut(regions.join(label, "v", "left").withColumn("part", F.coalesce("component", "v")).drop("component").join(main, "p", "left"))
    tallies = reps.filter("keys is not null").select("doc_id", F.col("n_shingles").alias("n"), "tally")
    # each step is written for itself: one plan of all takes the driver's memory
    near, grouped = cut(region_pairs(placed, percent)), cut(group_pairs(member, known, part, percent))
    rest = cut(near.union(possible(grouped, tallies, percent)).distinct())
    more = linked(confirmed(rest, texts, shingle_words), percent)
    if not more.isEmpty():  # few, and only between components: these are joined, not their members
        of = lambda c: part.select(F.col("doc_id").alias(c), F.col("component").alias(f"part_{c}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
        joined = components(ends).withColumnRenamed("doc_id", "old")
        known_parts = part.select("doc_id", F.col("component").alias("old")).join(joined, "old", "left").select("doc_id", F.coalesce("component", "old").alias("component"))
        alone = joined.join(part.select(F.col("component").alias("old")), "old", "left_anti").select(F.col("old").alias("doc_id"), "component")
        part = cut(known_parts.union(alone))

    # Classes with over a thousandth of all rows are at most a thousand and travel by broadcast, so that no task gets a large one whole.
    named = cut(classes.join(part.withColumnRenamed("doc_id", "rep"), "rep", "left").select(*digest, "size", F.coalesce("component", "rep").alias("component_id")))
    share = made.count() // 1000
    row = ["doc_id", "n_shingles", "component_id"]
    large = named.filter(F.col("size") > share).select(*(F.col(c).alias(f"of_{c}") for c in digest), "component_id")
    equal = F.expr("set_a = of_set_a and ((set_b ^ of_set_b) | (n_shingles ^ of_n_shingles)) = 0")  # by one key, as above
    met = made.select("doc_id", *digest).join(F.broadcast(large), equal, "left").select("doc_id", *digest, "component_id")
    done = "n_shingles = 0 or component_id is not null"
    some = met.filter(f"not ({done})").drop("component_id").join(named.filter(F.col("size") <= share).drop("size"), digest, "left")
    return met.filter(done).select(*row).union(some.select(*row)).withColumn("component_id", F.coalesce("component_id", "doc_id"))

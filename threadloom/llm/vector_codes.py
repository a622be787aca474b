"""Vectors as codes of their nearest codebook entries, found with GNAT trees over the entries.

Components become integers, floor(4096 * x). A vector is cut into ``PARTS`` equal parts, and
each part position has a codebook of at most ``ENTRIES`` entries, fitted by rounds of nearest
assignment and floored means, all in whole numbers. A codebook is searched as a geometric
near-neighbour access tree: a node's split points divide the other entries among them by
nearness, and each split point keeps the least and greatest distance to every child's
entries. Once a query has met a node's split points, a child is left out only if its range
lies strictly farther off than the nearest entry so far; distances are roots of whole
numbers, widened by a step of rounding either way, so that nothing as near as the best is
left out. Entries are compared by whole squared distances, ties by the lower index.

A task walks the tree with all rows of a batch at once. Between rounds only sums and counts
of entries move: 128 rows a task, added up by Spark. Codebooks hold 16 numbers a component
of one vector, whatever the number of rows, and travel with the tasks.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped; a vector shorter than the longest, or whose length 8 doesn't divide, counts as
ending in zeros; rows that repeat an id stay apart (entries are taken in order of id, then of
components); a null id comes after all others; a null label is a label; fewer vectors than
entries make smaller codebooks; numbers that don't fit in 64 bits as squared distances raise
an error; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, sliced

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
SPLITS = 4  # split points of a node
BATCH = 4096
#: Differences of numbers under this, squared and added over 2**12 components, stay in 64 bits.
WIDE = 1 << 24


class Gnat:
    """A tree over the rows of ``entries``; ``nearest`` gives each query's entry and squared distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.compared = 0  # query-entry distances computed so far
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> tuple | None:
        if not len(members):
            return None
        splits, rest = members[:SPLITS], members[SPLITS:]
        far = np.stack([squared(self.entries[members], self.entries[s]) for s in splits])  # a row a split point
        owner = np.argmin(far[:, len(splits) :], axis=0) if len(rest) else np.zeros(0, int)
        groups = [np.flatnonzero(owner == k) + len(splits) for k in range(len(splits))]
        low, high = np.zeros((len(splits), len(splits))), np.zeros((len(splits), len(splits)))
        for k, g in enumerate(groups):
            for i in range(len(splits)):
                if len(g):
                    low[i, k], high[i, k] = below(far[i, g].min()), above(far[i, g].max())
        return splits, low, high, [self._node(members[g]) for g in groups]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        best = np.full(n, -1, np.int64)
        least = np.zeros(n, queries.dtype)
        self._search(self.root, queries, np.arange(n), best, least)
        return best, least

    def _search(self, node: tuple | None, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        splits, low, high, children = node
        met = []
        for s in splits:
            d = squared(queries[rows], self.entries[s])
            self.compared += len(rows)
            nearer = (best[rows] < 0) | (d < least[rows]) | ((d == least[rows]) & (s < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = s, d[nearer]
            met.append(d)
        near, far = [below(d) for d in met], [above(d) for d in met]
        for k, child in enumerate(children):
            if child is None:
                continue
            reach = above(least[rows])
            open_ = np.ones(len(rows), bool)
            for i in range(len(splits)):
                # strictly outside: every entry of the child is farther than the best
                open_ &= ~((np.nextafter(far[i] + reach, np.inf) < low[i, k]) | (np.nextafter(near[i] - reach, -np.inf) > high[i, k]))
            self._search(child, queries, rows[open_], best, least)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


def below(d2: np.ndarray) -> np.ndarray:
    """A number no greater than the root."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(np.asarray(d2, np.float64)), -np.inf), -np.inf), 0.0)


def above(d2: np.ndarray) -> np.ndarray:
    """A number no less than the root."""
    return np.nextafter(np.nextafter(np.sqrt(np.asarray(d2, np.float64)), np.inf), np.inf)


def whole(vectors: DataFrame, vector: str) -> DataFrame:
    """The usable rows with ``q``, their components as whole numbers."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.filter(usable).withColumn("q", F.transform(x, lambda c: F.floor(c * SCALE)))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) whole numbers; Python's own where differences might not fit in 64 bits."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat) == len(sizes) * width:
        out = flat.reshape(len(sizes), width)
    else:
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out if width <= 1 << 12 and (not out.size or max(out.max(), -out.min()) < WIDE) else out.astype(object)


def assigned(books: list[np.ndarray], rows: np.ndarray, trees: list[Gnat]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By part: the rows' parts, their entries and squared distances."""
    size = rows.shape[1] // PARTS
    for p, tree in enumerate(trees):
        part = rows[:, p * size : (p + 1) * size]
        if part.dtype != tree.entries.dtype:  # one of them holds large numbers
            tree = Gnat(tree.entries.astype(object))
            part = part.astype(object)
        yield part, *tree.nearest(part)


def _sums(books: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        total = [np.zeros(b.shape, object) for b in books]
        count = np.zeros((PARTS, ENTRIES), np.int64)
        for b in sliced(batches, BATCH):
            for p, (part, entry, _) in enumerate(assigned(books, _rows(b.column(0), width), trees)):
                some, at = np.unique(entry, return_inverse=True)
                sums = np.zeros((len(some), part.shape[1]), part.dtype)
                np.add.at(sums, at, part)
                total[p][some] += sums.astype(object)
                count[p] += np.bincount(entry, minlength=ENTRIES)
        rows = [(p, e, int(count[p, e]), [str(x) for x in total[p][e]]) for p in range(PARTS) for e in range(len(books[p])) if count[p, e]]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    return run


def fitted(q: DataFrame, id_column: str, width: int) -> list[np.ndarray]:
    """The codebooks after all rounds, a (entries, width / PARTS) array a part."""
    first = q.orderBy(F.col(id_column).asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()
    start = _rows(pa.array([r["q"] for r in first], pa.list_(pa.int64())), width)
    books = list(np.split(start, PARTS, axis=1))
    for _ in range(ROUNDS):
        sums = q.select("q").mapInArrow(_sums(books, width), "part int, entry int, n long, sums array<string>")
        # 16 numbers a component of one vector come back, added up in decimals
        at = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        added = at.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        new = [b.astype(object) for b in books]
        for r in added:
            new[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
        books = [b if any(abs(x) >= WIDE for x in b.flat) else b.astype(np.int64) for b in new]
    return books


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The id, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256`` of every usable vector."""
    q = cut(whole(vectors.select(F.col(id_column), F.col(vector), F.col(label)), vector).drop(vector))
    longest = q.agg(F.max(F.size("q"))).first()[0]
    width = -(-(longest or 0) // PARTS) * PARTS
    books = fitted(q, id_column, width) if longest is not None else []
    numbers = ",".join(str(int(x)) for b in books for x in b.flat)
    digest = hashlib.sha256(numbers.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for b in sliced(batches, BATCH):
            rows = _rows(b.column(2), width)
            codes, error = np.zeros((len(rows), PARTS), np.uint8), [0] * len(rows)
            for p, (_, entry, far) in enumerate(assigned(books, rows, trees)):
                codes[:, p] = entry
                error = [e + int(f) for e, f in zip(error, far)]
            flat = codes.tobytes().hex()
            text = [flat[i : i + 2 * PARTS] for i in range(0, len(flat), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=[id_column, label, "code", "error"])

    kinds = dict(q.dtypes)
    coded = cut(q.select(id_column, label, "q").mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{label}` {kinds[label]}, code string, error long"))
    by_label = cut(coded.groupBy(label).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows_of_label")))
    # Labels with over a thousandth of the rows are at most a thousand: they travel by broadcast, so that no task gets one whole.
    share = coded.count() // 1000
    same = lambda right: coded[label].eqNullSafe(right[label])
    large, small = by_label.filter(F.col("rows_of_label") > share), by_label.filter(F.col("rows_of_label") <= share)
    found = coded.join(F.broadcast(large), same(large), "inner").select(coded["*"], "label_error")
    rest = coded.join(F.broadcast(large), same(large), "left_anti").join(small, same(small), "inner").select(coded["*"], "label_error")
    return found.union(rest).select(id_column, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

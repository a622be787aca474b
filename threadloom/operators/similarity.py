"""Exact similarity search, joins and averages over embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.vectors import cosine
from threadloom.operators.rounds import written

#: Most numbers (rows times dimensions) of a side that is sent to every task, 32 MB; beyond that, both sides are joined block by block.
BROADCAST_VALUES = 4_000_000
#: Rows of a block where both sides are dealt to blocks.
BLOCK = 24_576
#: Least number of blocks of a side, on average, where all pairs of copies are asked for, so that many tasks share the rows that come out.
BLOCKS = 12
#: About as many ids of a class of equal vectors go into one row of ``bundles``.
BUNDLE = 128
#: Ids that a batch of pairs of bundles holds.
BATCH_IDS = 400_000


def top_k(df: DataFrame, query_vector: list[float] | Column, k: int, least: float = 0.0, where: Column | None = None, tie: str = "id") -> DataFrame:
    """The k rows most similar to one query vector, of those that pass the filter and the threshold.

    The filter runs before the similarity and the limit is a top-k by partition, so only
    k rows a task travel.
    """
    q = query_vector if isinstance(query_vector, Column) else F.lit([float(x) for x in query_vector])
    some = df.filter("embedding is not null") if where is None else df.filter(F.col("embedding").isNotNull() & where)
    scored = some.withColumn("similarity", F.round(cosine(F.col("embedding"), q), 6)).filter(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), tie).limit(k)


class _Side:
    """Ids, kinds and unit vectors of some rows, in double and in single precision; rows that hold no finite direction are left out."""

    def __init__(self, rows: pa.Table):
        e = rows["embedding"].combine_chunks()
        m = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(e), -1) if len(e) else np.empty((0, 1))
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n != 0)
        real = np.isfinite(m).all(axis=1)
        self.ids = rows["id"].combine_chunks().filter(pa.array(real))
        self.kinds = rows["kind"].to_numpy()[real] if "kind" in rows.column_names else np.full(int(real.sum()), "", object)
        self.vectors = m[real]
        self.low = self.vectors.astype(np.float32)

    def __len__(self) -> int:
        return len(self.vectors)

    def of_kind(self, kind: str) -> _Side:
        own, part = self.kinds == kind, object.__new__(_Side)
        part.ids, part.kinds, part.vectors, part.low = self.ids.filter(pa.array(own)), self.kinds[own], self.vectors[own], self.low[own]
        return part


def near_places(a: _Side, b: _Side, least: float, k: int | None = None, rows: int = 1024, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, similarities) of pairs that reach ``least``; with ``k`` only those no worse than the k best of each a.

    Tile by tile, so memory doesn't grow with the sides: single precision tells which pairs
    may reach the bound, within its error, and double precision decides.
    """
    slack = 1.2e-7 * a.vectors.shape[1] + 1e-6
    for at in range(0, len(a) if len(b) else 0, rows):
        own, low = a.vectors[at : at + rows], a.low[at : at + rows]
        floor, found = np.full(len(own), float(least)), (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for to in range(0, len(b), block):
            other = b.vectors[to : to + block]
            s = low @ b.low[to : to + block].T
            if k and to == 0 and k <= s.shape[1]:
                floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k] - slack)
            i, j = np.nonzero(s >= (floor - slack)[:, None])
            if len(i) * 40 > s.size:
                full = np.round(own @ other.T, 6)
                i, j = np.nonzero(full >= floor[:, None])
                x = full[i, j]
            else:
                x = np.round(np.einsum("ij,ij->i", own[i], other[j]), 6)
                reach = x >= floor[i]
                i, j, x = i[reach], j[reach], x[reach]
            if not k:
                yield at + i, to + j, x
            elif len(i):
                i, j, x = (np.concatenate(p) for p in zip(found, (i, to + j, x), strict=True))
                order = np.lexsort((-x, i))
                i, j, x = i[order], j[order], x[order]
                worst = np.arange(len(i)) - np.searchsorted(i, i) == k - 1
                floor[i[worst]] = x[worst]
                reach = x >= floor[i]
                found = i[reach], j[reach], x[reach]
        if k:
            yield at + found[0], found[1], found[2]


def _pairs(a: _Side, b: _Side, least: float, k: int | None, same: bool = False) -> Iterator[pa.RecordBatch]:
    bundled = pa.types.is_list(a.ids.type)
    sizes = [d.ids.value_lengths().to_numpy() for d in (a, b)] if bundled else None
    for i, j, x in near_places(a, b, least, k):
        if same:
            i, j, x = i[i < j], j[i < j], x[i < j]
        if not len(i):
            continue
        at = np.cumsum(sizes[0][i].astype(np.int64) + sizes[1][j]) // BATCH_IDS if bundled else np.zeros(len(i), np.int64)
        for p in np.split(np.arange(len(i)), np.flatnonzero(np.diff(at)) + 1):
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(i[p])), b.ids.take(pa.array(j[p])), pa.array(a.kinds[i[p]], pa.string()), pa.array(x[p])], names=["left_id", "right_id", "kind", "similarity"])


def classes(df: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` (id, embedding) by equal vectors (of one kind): (id, kind, embedding, size), the least id standing for its class, and (id, own): each row and who stands for it.

    What holds for a vector holds for its copies, so vectors are compared once however many
    rows share them. Rows without an embedding, or a kind where one is asked for, are in no class.
    """
    which = F.col(kind).cast("string") if kind else F.lit("")
    rows = written(df.select("id", which.alias("kind"), "embedding").filter("embedding is not null and kind is not null"))
    firsts = written(rows.groupBy("kind", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("size")).select("id", "kind", "embedding", "size"))
    return firsts, rows.join(firsts.select(F.col("id").alias("own"), "kind", "embedding"), ["kind", "embedding"]).select("id", "own")


def bundles(df: DataFrame, kind: str | None = None, once: bool = False, size: int = BUNDLE) -> DataFrame:
    """Rows of ``df`` (id, embedding) by equal vectors (of one kind), about ``size`` to a row: (id, kind, embedding), id being the list of their ids; written.

    Classes of more rows are dealt to several bundles by hash of the id, so that no row and no
    task holds a large class. ``once``: ids that come again are left out.
    """
    which = F.col(kind).cast("string") if kind else F.lit("")
    rows = df.select("id", which.alias("kind"), "embedding", F.xxhash64("embedding").alias("_h")).filter("embedding is not null and kind is not null")
    large = rows.groupBy("kind", "_h").agg(F.ceil(F.count("*") / size).alias("_parts")).filter("_parts > 1")
    dealt = rows.join(F.broadcast(large), ["kind", "_h"], "left").withColumn("_part", F.pmod(F.xxhash64("id"), F.coalesce("_parts", F.lit(1))))
    ids = F.collect_set("id") if once else F.collect_list("id")
    return written(dealt.groupBy("kind", "embedding", "_part").agg(ids.alias("id")).select("id", "kind", "embedding"))


def all_pairs(left: DataFrame, right: DataFrame | None, least: float, kind: str | None = None, once: bool = False, values: int = 0, block: int = BLOCK) -> DataFrame:
    """(x, y, kind, similarity) of all rows (id, embedding) of one kind that reach ``least``, copies written out.

    ``right`` None: pairs within ``left``, each once, x before y. Vectors are compared for
    bundles of their copies, and the ids are paired off by the task that finds two bundles
    close, as they are read: pairs are neither written nor shuffled, so disk grows with the
    rows (times the blocks of a side), not with the pairs.
    """
    a = bundles(left, kind, once)
    b = None if right is None else bundles(right, kind, once)
    few, many = sorted(d.count() for d in (a, a if b is None else b))
    even = max((few * many) ** 0.5 / BLOCKS, many / BLOCKS**2, 1)
    pairs = class_pairs(a, b, least, values=values, block=min(block, int(np.ceil(even))), kept=False)
    paired = lambda d: d.select(F.explode("left_id").alias("x"), "right_id", "kind", "similarity").select("x", F.explode("right_id").alias("y"), "kind", "similarity")
    if b is not None:
        return paired(pairs)
    own = a.select(F.col("id").alias("left_id"), F.col("id").alias("right_id"), "kind", self_similarity().alias("similarity")).filter(F.col("similarity") >= least)
    apart = paired(pairs).filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "kind", "similarity")
    return apart.unionAll(paired(own).filter("x < y"))


def class_pairs(left: DataFrame, right: DataFrame | None, least: float, k: int | None = None, values: int = BROADCAST_VALUES, block: int = BLOCK, kept: bool = True) -> DataFrame:
    """(left_id, right_id, similarity) of rows (id, kind, embedding) of one kind that reach ``least``; written.

    ``right`` None: pairs within ``left``, each once, left_id before right_id. ``k``: pairs that
    can't be among the k best of their left row may be left out. If the smaller side has no
    more than ``values`` numbers, it is sent to every task, and the other is read where it
    lies. Else rows of both are dealt to blocks of about ``block``, each pair of blocks is
    one task, and a row is sent to as many tasks as the other side has blocks. ``kept``
    False: not written but found anew whenever it is read, with the kind, in any order.
    """
    within = right is None
    ready = (lambda d: written(d.drop("kind"))) if kept else (lambda d: d)
    sides = [d.select("id", "kind", "embedding") for d in (left, left if within else right)]
    schema = f"left_id {sides[0].schema['id'].dataType.simpleString()}, right_id {sides[1].schema['id'].dataType.simpleString()}, kind string, similarity double"
    rows, dims = zip(*(d.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first() for d in sides), strict=True)
    small = int(rows[1] > rows[0]) ^ 1  # place of the smaller side
    if rows[small] * dims[small] <= values:
        sent = left.sparkSession.sparkContext.broadcast(sides[small].toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = _Side(sent.value)
            parts = {v: whole.of_kind(v) for v in set(whole.kinds)}
            for batch in batches:
                some = _Side(pa.Table.from_batches([batch]))
                for v in set(some.kinds) & set(parts):
                    pair = [some.of_kind(v), some.of_kind(v)]
                    pair[small] = parts[v]
                    yield from _pairs(*pair, least, k)

        found = sides[1 - small].mapInArrow(run, schema)
        return ready(found.filter("left_id < right_id") if within else found)

    n = [max(1, -(-r // block)) for r in rows]
    place = lambda d: F.pmod(F.xxhash64("id"), F.lit(n[d])).cast("int")
    ends = [(F.col("i"), F.lit(n[1] - 1)), (F.lit(0), F.col("j") - 1)] if within else [(F.lit(0), F.lit(n[1] - 1)), (F.lit(0), F.lit(n[0] - 1))]
    a = sides[0].withColumn("i", place(0)).withColumn("j", F.explode(F.sequence(*ends[0])))
    b = sides[1].withColumn("j", place(1)).filter(F.col("j") > 0 if within else F.lit(True)).withColumn("i", F.explode(F.sequence(*ends[1])))
    none = lambda d: F.lit(None).cast(sides[d].schema["id"].dataType)
    cells = a.select("kind", "i", "j", F.col("id").alias("left_id"), none(1).alias("right_id"), "embedding").unionAll(b.select("kind", "i", "j", none(0), "id", "embedding"))
    tasks = n[0] * n[1]
    # kinds of one pair of blocks share a task
    dealt = cells.repartitionById(tasks, F.col("i") * n[1] + F.col("j"))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        if not held:
            return
        t = pa.Table.from_batches(held)
        del held
        at, is_left = t["i"].to_numpy().astype(np.int64) * n[1] + t["j"].to_numpy(), t["left_id"].is_valid().to_numpy()
        for c in np.unique(at):
            pair = []
            for own, name in ((is_left, "left_id"), (~is_left, "right_id")):
                some = t.filter(pa.array((at == c) & own)).select(["kind", name, "embedding"]).rename_columns(["kind", "id", "embedding"])
                pair.append(_Side(some))
            same = within and c // n[1] == c % n[1]
            for v in set(pair[0].kinds):
                x = pair[0].of_kind(v)
                yield from _pairs(x, x if same else pair[1].of_kind(v), least, k, same)

    found = dealt.mapInArrow(cell, schema)
    return ready(found.withColumns({"left_id": F.least("left_id", "right_id"), "right_id": F.greatest("left_id", "right_id")}) if within and kept else found)


def similar_pairs(left: DataFrame, right: DataFrame, least: float, kind: str | None = None, k: int | None = None, **how: int) -> DataFrame:
    """(left_id, right_id, similarity) of all pairs from ``left`` and ``right`` (id, embedding) that reach ``least``.

    ``kind``: a column in which both must agree. ``k``: only the k best of each left row, ties
    by right_id. Vectors are compared by ``class_pairs``, once for all their copies.
    """
    (a, of_a), (b, of_b) = classes(left, kind), classes(right, kind)
    pairs = class_pairs(a, b, least, k, **how)
    if k:  # of a class, the k best hold no more than its first k; they are the same for all copies of the left row
        first = F.row_number().over(Window.partitionBy("own").orderBy("id"))
        of_b = of_b.withColumn("_place", first).filter(F.col("_place") <= k)
    out = pairs.withColumnRenamed("right_id", "own").join(of_b.withColumnRenamed("id", "right_id"), "own").select("left_id", "right_id", "similarity")
    out = best_per(out, "left_id", k, "right_id").drop("rank") if k else out
    return out.withColumnRenamed("left_id", "own").join(of_a.withColumnRenamed("id", "left_id"), "own").select("left_id", "right_id", "similarity")


def self_similarity() -> Column:
    """The similarity of a row's vector with its copies: 1, 0 for a zero vector, null where that is no number."""
    own = F.round(cosine(F.col("embedding"), F.col("embedding")), 6)
    return F.when(~F.isnan(own), own)


def best_per(pairs: DataFrame, key: str, k: int, tie: str) -> DataFrame:
    """The k best pairs of each key, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cross_matches(entities: DataFrame, least: float, k: int) -> DataFrame:
    """For each user entity its k most similar expert entities."""
    user = entities.filter(F.col("source_type").isin("user", "both"))
    expert = entities.filter("source_type = 'expert'")
    return best_per(similar_pairs(user, expert, least, k=k), "left_id", k, "right_id").select(F.col("left_id").alias("user_entity_id"), F.col("right_id").alias("expert_entity_id"), "similarity", "rank")


def same_type_pairs(entities: DataFrame, least: float, **how: int) -> DataFrame:
    """Pairs of entities of one type that are similar enough to be one."""
    return all_pairs(entities, None, least, "entity_type", **how).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("kind").alias("entity_type"), "similarity")


def library_matches(new: DataFrame, library: DataFrame, least: float = 0.85) -> DataFrame:
    """For each new item the most similar other library item of its type that isn't archived, if similar enough."""
    out = similar_pairs(new, library.filter("status <> 'archived'"), least, kind="item_type", k=2).filter("left_id <> right_id")
    best = best_per(out, "left_id", 1, "right_id").join(new.select(F.col("id").alias("left_id"), "item_type"), "left_id")
    return best.select(F.col("left_id").alias("new_id"), F.col("right_id").alias("item_id"), "item_type", "similarity")


def topic_filter(topics: DataFrame, library: DataFrame, least: float = 0.75) -> DataFrame:
    """Topics with their most similar library item and whether that covers them."""
    best = best_per(similar_pairs(topics, library.filter("status <> 'archived'"), least, k=1), "left_id", 1, "right_id")
    out = topics.select("id").join(best.select(F.col("left_id").alias("id"), F.col("right_id").alias("item_id"), "similarity"), "id", "left")
    return out.withColumn("covered", F.col("item_id").isNotNull())


def multi_query(messages: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """Chats that hold one of the k best messages of any query, with their best similarity and how many queries found them."""
    hits = best_per(similar_pairs(queries, messages, least, k=k), "left_id", k, "right_id")
    chats = hits.join(messages.select(F.col("id").alias("right_id"), "chat_id"), "right_id")
    return chats.groupBy("chat_id").agg(F.max("similarity").alias("best"), F.countDistinct("left_id").alias("queries"), F.count("*").alias("hits"))


def searched(df: DataFrame, queries: DataFrame, k: int, least: float = 0.0, **how: int) -> DataFrame:
    """(query_id, id, similarity, rank): for each query (id, embedding) its k most similar rows of ``df`` (id, embedding) that reach ``least``; ties go by id."""
    best = best_per(similar_pairs(queries, df, least, k=k, **how), "left_id", k, "right_id")
    return best.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "similarity", "rank")


def quotes(messages: DataFrame, queries: DataFrame, source: str, k: int, least: float = 0.0, wider: int = 3) -> DataFrame:
    """The k best messages of one source for each query, of the ``wider`` * k best of all sources: (query_id, id, text, chat_id, similarity, rank).

    Messages: (id, embedding, source, text, chat_id). As the filter comes after the search, a
    query may have fewer than k quotes, or none, though the source has more that reach ``least``.
    """
    hits = searched(messages, queries, k * wider, least).join(messages.filter(F.col("source") == source).select("id", "text", "chat_id"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", F.coalesce("text", F.lit("")).alias("text"), "chat_id", "similarity", "rank")


def sampled_messages(messages: DataFrame, queries: DataFrame, k: int, least: float, limit: int) -> DataFrame:
    """The ``limit`` messages most similar to any query, of each query's k best, one of those whose texts begin with the same 200 characters.

    (id, text, similarity); the most similar stays, the least id on ties. Messages without a text are left out.
    """
    hits = searched(messages, queries, k, least).groupBy("id").agg(F.max("similarity").alias("similarity"))
    found = hits.join(messages.select("id", "text"), "id").filter("text <> ''")
    first = F.min_by(F.struct("id", "text", "similarity"), F.struct(-F.col("similarity"), F.col("id"))).alias("first")
    return found.groupBy(F.substring("text", 1, 200)).agg(first).select("first.*").orderBy(F.desc("similarity"), "id").limit(limit)


def other_source_matches(entities: DataFrame, chosen: DataFrame, least: float = 0.75, k: int = 10) -> DataFrame:
    """Matches of chosen entities with those of the other source: (user_entity_id, expert_entity_id, similarity).

    A user entity (or one of both sources) meets the experts', and its k best stay; an expert
    entity meets all user entities, and all that reach ``least`` stay. Entities of other
    sources have no matches. Rows: (id, embedding, source_type).
    """
    user, expert = F.col("source_type").isin("user", "both"), F.col("source_type") == "expert"
    up = all_pairs(chosen.filter(expert), entities.filter(user), least, once=True)
    entities, chosen = (d.select("id", "embedding", "source_type").distinct() for d in (entities, chosen))
    down = best_per(similar_pairs(chosen.filter(user), entities.filter(expert), least, k=k), "left_id", k, "right_id")
    # pairs of two chosen entities are all in ``up``
    down = down.join(chosen.filter(expert).select(F.col("id").alias("right_id")), "right_id", "left_anti")
    as_ = lambda a, b: [F.col(a).alias("user_entity_id"), F.col(b).alias("expert_entity_id"), "similarity"]
    return down.select(*as_("left_id", "right_id")).unionAll(up.select(*as_("y", "x")))


def implemented_by_files(items: DataFrame, files: DataFrame, least: float = 0.75) -> DataFrame:
    """``items`` with status implemented and the file (implemented_source) where a file is similar enough; the first of the most similar ones.

    Files: (id, embedding), ids are paths. Items that are implemented already or have no
    embedding stay as they are, with no file.
    """
    open_ = items.filter("status is null or status <> 'implemented'").select("id", "embedding")
    best = searched(files, open_, 1, least).select(F.col("query_id").alias("id"), F.col("id").alias("implemented_source"))
    out = items.join(best, "id", "left")
    return out.withColumn("status", F.when(F.col("implemented_source").isNotNull(), "implemented").otherwise(F.col("status")))


def mean_vectors(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """The mean embedding of each key, dimension by dimension."""
    long = df.filter("embedding is not null").select(key, F.posexplode("embedding").alias("place", "x"))
    means = long.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.round("x", digits).alias("x")))).alias("e"))
    return rows.select(key, F.transform("e", lambda s: s["x"]).alias("embedding"))


def semantic_edges(conversations: DataFrame, episodes: DataFrame, least: float = 0.75, k: int = 5) -> DataFrame:
    """Edges from each conversation to its k most similar episodes, with the similarity as confidence and evidence.

    Thousandths are those next to a thousand times the double, as SQL rounds; ``round(x, 3)`` goes by its decimal digits (0.5095 is 0.509, not 0.510).
    """
    best = best_per(similar_pairs(conversations, episodes, least, k=k), "left_id", k, "right_id")
    return best.select(
        F.col("left_id").alias("source_entity_id"),
        F.col("right_id").alias("target_entity_id"),
        F.lit("SEMANTIC_MATCH").alias("relation_type"),
        F.col("similarity").alias("confidence"),
        F.concat(F.lit("Semantic similarity: "), F.format_string("%.3f", F.round(F.col("similarity") * 1000) / 1000)).alias("evidence"),
    )

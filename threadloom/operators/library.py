"""The item library: statistics, pages, merges, upserts and backfills. Writers return the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.dates import month_first, month_last
from threadloom.operators.similarity import best_per, similar_pairs


def counts_by(items: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, count) over several columns in one pass."""
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns]))
    return items.select(facets.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("count"))


def library_summary(items: DataFrame) -> DataFrame:
    """One row: totals, implemented and archived items, and the span of months."""
    seen = F.coalesce("last_seen", "first_seen")
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "implemented").alias("implemented"),
        F.count_if(F.col("status") == "archived").alias("archived"),
        F.sum("occurrence").alias("occurrences"),
        F.min(seen).alias("earliest"),
        F.max(seen).alias("latest"),
    )


def page(items: DataFrame, order: list[Column], number: int, size: int, where: Column | None = None) -> DataFrame:
    """One page of a filtered, totally ordered list; numbers below 1 and sizes outside 1 to 100 are clamped."""
    number, size = max(1, number), min(100, max(1, size))
    some = items if where is None else items.filter(where)
    return some.orderBy(*order).offset((number - 1) * size).limit(size)


def matching(items: DataFrame, text: str | None = None, item_type: str | None = None, category: str | None = None, status: str | None = "active") -> DataFrame:
    """Items whose title or description holds a text, of a type, category ('none' for none) and status; a filter of None is off."""
    out = items
    if text:
        hit = lambda c: F.contains(F.lower(c), F.lit(text.lower()))
        out = out.filter(hit("title") | hit("description"))
    if item_type:
        out = out.filter(F.col("item_type") == item_type)
    if category:
        out = out.filter(F.col("category_id").isNull() if category == "none" else F.col("category_id") == category)
    return out.filter(F.col("status") == status) if status else out


def stale(items: DataFrame, cutoff: str) -> DataFrame:
    """Items that aren't archived and were last seen before a cutoff, compared as text."""
    return items.filter((F.col("status") != "archived") & (F.col("last_seen") < cutoff))


def archive_stale(items: DataFrame, cutoff: str) -> DataFrame:
    gone = (F.col("status") != "archived") & (F.col("last_seen") < cutoff)
    return items.withColumn("status", F.when(F.coalesce(gone, F.lit(False)), "archived").otherwise(F.col("status")))


def theme_summaries(items: DataFrame, tags: int = 5, limit: int = 10) -> DataFrame:
    """The largest categories with their most frequent tags and the last month seen."""
    named = items.withColumn("category", F.coalesce("category_id", F.lit("Uncategorized")))
    sizes = named.groupBy("category").agg(F.count("*").alias("items"), F.max("last_seen").alias("last_seen"))
    counted = named.select("category", F.explode("tags").alias("tag")).groupBy("category", "tag").agg(F.count("*").alias("n"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "tag"))).filter(F.col("_r") <= tags)
    lists = best.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "tag"))), lambda x: x["tag"]), ",").alias("top_tags"))
    return sizes.join(lists, "category", "left").orderBy(F.desc("items"), "category").limit(limit)


def merged(items: DataFrame, group: str) -> DataFrame:
    """Items of a group as one: the id and texts of the most frequent, summed occurrences, the whole span, all tags sorted."""
    first = F.struct(F.coalesce("occurrence", F.lit(1)).alias("o"), (-F.col("n")).alias("k"))
    return items.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.max_by("id", first).alias("id"),
        F.max_by("title", first).alias("title"),
        F.sum(F.coalesce("occurrence", F.lit(1))).alias("occurrence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))), ",").alias("tags"),
        F.count("*").alias("merged"),
    )


def backfilled_dates(items: DataFrame) -> DataFrame:
    """Items without a start get the first day of their first month and the last day of their last."""
    none = F.col("source_start_date").isNull()
    return items.withColumns(
        {
            "source_start_date": F.when(none, month_first(F.col("first_seen"))).otherwise(F.col("source_start_date")),
            "source_end_date": F.when(none, month_last(F.col("last_seen"))).otherwise(F.col("source_end_date")),
        }
    )


def backfilled_history(items: DataFrame, history: DataFrame) -> DataFrame:
    """A first occurrence for every item that has none."""
    return items.join(history.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti").select(
        F.col("id").alias("item_id"), F.coalesce("source_start_date", month_first(F.col("first_seen"))).alias("occurred_at"), F.lit("generation").alias("source_type")
    )


def upserted(items: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """The library after a batch: matched items gain an occurrence a match and a wider span, the rest of ``new`` is added.

    matches: (new_id, item_id). Each new row counts once, so a batch that is applied to the
    same library again gives the same table.
    """
    hit = new.withColumnRenamed("id", "new_id").join(matches.select("new_id", "item_id"), "new_id")
    delta = hit.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("_more"), F.min("source_start_date").alias("_start"), F.max("source_end_date").alias("_end"), F.max("last_seen").alias("_last"))
    old = items.join(delta, "id", "left").withColumns(
        {
            "occurrence": F.col("occurrence") + F.coalesce("_more", F.lit(0)),
            "source_start_date": F.least("source_start_date", "_start"),
            "source_end_date": F.greatest("source_end_date", "_end"),
            "last_seen": F.greatest("last_seen", "_last"),
        }
    ).drop("_more", "_start", "_end", "_last")
    added = new.join(matches.select(F.col("new_id").alias("id")), "id", "left_anti").withColumn("occurrence", F.lit(1).cast(items.schema["occurrence"].dataType))
    return old.unionByName(added.select(*items.columns))


def without(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Items that aren't among the ids."""
    return items.join(ids.select("id"), "id", "left_anti")


def pruned_categories(categories: DataFrame, gone: DataFrame, drop_empty: bool) -> DataFrame:
    """Categories whose item lists no longer hold the gone ids; empty ones go on a merge and stay on a delete."""
    rest = categories.select("*", F.posexplode_outer("item_ids").alias("_at", "_id")).join(gone.select(F.col("id").alias("_id"), F.lit(True).alias("_gone")), "_id", "left")
    keys = [c for c in categories.columns if c != "item_ids"]
    kept = F.collect_list(F.when(F.col("_gone").isNull() & F.col("_id").isNotNull(), F.struct("_at", "_id")))
    out = rest.groupBy(*keys).agg(F.transform(F.array_sort(kept), lambda x: x["_id"]).alias("item_ids")).select(*categories.columns)
    return out.filter(F.size("item_ids") > 0) if drop_empty else out


def word_shifts(items: DataFrame, words: Column, recent: Column, older: Column, high: int = 3, low: int = 1, least_items: int = 10, limit: int = 5) -> DataFrame:
    """Words of titles whose count moved between two periods: declining (many before, few now) and emerging.

    Archived items don't count, and fewer than ``least_items`` others give nothing. The first
    ``limit`` are returned: declining ones before emerging ones, more frequent ones first.
    """
    live = items.filter(F.coalesce(F.col("status") != "archived", F.lit(True)))
    enough = live.agg(F.count("*").alias("_items")).filter(F.col("_items") >= least_items)
    counted = live.select(F.explode(words).alias("word"), recent.alias("_r"), older.alias("_o")).groupBy("word").agg(F.count_if("_r").alias("recent"), F.count_if("_o").alias("older"))
    shift = F.when((F.col("older") >= high) & (F.col("recent") <= low), "declining").when((F.col("recent") >= high) & (F.col("older") <= low), "emerging")
    found = counted.withColumn("shift", shift).filter("shift is not null").join(F.broadcast(enough), how="left_semi")
    return found.orderBy("shift", F.desc(F.greatest("recent", "older")), "word").limit(limit)


def corrected_first_seen(items: DataFrame, messages: DataFrame, least: float = 0.45, k: int = 20) -> DataFrame:
    """Items with ``first_seen`` (YYYY-MM) moved back to the month of the earliest of their k most similar messages.

    items: id, embedding, first_seen; messages: id, embedding, ts_ms. Only messages that
    reach ``least`` count. A missing date is set, a later one replaced, an earlier one kept;
    ``corrected`` says whether it changed. Items without an embedding or a match stay.
    """
    best = best_per(similar_pairs(items, messages, least, k=k), "left_id", k, "right_id")
    dated = best.join(messages.select(F.col("id").alias("right_id"), "ts_ms"), "right_id")
    month = dated.groupBy(F.col("left_id").alias("id")).agg(F.date_format(F.timestamp_millis(F.min("ts_ms")), "yyyy-MM").alias("_month"))
    earlier = F.col("_month").isNotNull() & (F.coalesce("first_seen", F.lit("")) == "") | (F.col("_month") < F.col("first_seen"))
    out = items.join(month, "id", "left").withColumn("corrected", F.coalesce(earlier, F.lit(False)))
    return out.withColumn("first_seen", F.when(F.col("corrected"), F.col("_month")).otherwise(F.col("first_seen"))).drop("_month")


#: Fields that an update keeps from the entry before it unless it sets them itself.
STATUS_FIELDS = ("solved", "solved_date", "solved_file", "posted", "posted_date", "posted_file")


def harmonised(bank: DataFrame, changes: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bank and the processed hashes after batches of changes, as if they were applied one after the other.

    bank: idx (gapless from 0), content, occurrence_count, last_updated, status fields.
    changes: item_hash, batch, place, action ('update' or 'new'), id, content, made_at, status
    fields. A change whose item was processed before is dropped, so a replay changes nothing.
    A new entry takes the next index, an update those that exist when it is reached; other
    ids and actions do nothing. The last update's content stays, each adds an occurrence (none
    counts as one), and a status field stays from the last version that sets it.

    Nothing is looped over: new entries get their index from counts by batch and their place
    in the batch, and an entry's versions are one aggregate.
    """
    open_ = changes.join(processed.select("item_hash").distinct(), "item_hash", "left_anti")
    base = bank.agg(F.count("*").alias("_base"))
    is_new = (F.col("action") == "new").cast("long")
    batches = open_.groupBy("batch").agg(F.sum(is_new).alias("_new"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row a batch
    starts = batches.crossJoin(F.broadcast(base)).select("batch", (F.col("_base") + F.coalesce(F.sum("_new").over(before), F.lit(0))).alias("_start"))
    within = Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = open_.join(starts, "batch").withColumn("_there", F.col("_start") + F.coalesce(F.sum(is_new).over(within), F.lit(0)))
    idx = F.when(F.col("action") == "new", F.col("_there")).when((F.col("action") == "update") & (F.col("id") >= 0) & (F.col("id") < F.col("_there")), F.col("id"))
    made = placed.withColumn("idx", idx).filter("idx is not null")
    fields = [f for f in STATUS_FIELDS if f in bank.columns]
    versions = bank.select("idx", F.struct(F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("p")).alias("at"), "content", F.coalesce("occurrence_count", F.lit(1)).cast("long").alias("n"), F.col("last_updated"), *fields)
    versions = versions.unionByName(made.select("idx", F.struct(F.col("batch").cast("long").alias("b"), F.col("place").cast("long").alias("p")).alias("at"), "content", F.lit(1).cast("long").alias("n"), F.col("made_at").alias("last_updated"), *fields))
    last = lambda c: F.max_by(c, "at").alias(c)
    kept = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    out = versions.groupBy("idx").agg(last("content"), F.sum("n").alias("occurrence_count"), last("last_updated"), *[kept(f) for f in fields])
    return out, processed.select("item_hash").union(open_.select("item_hash")).distinct()

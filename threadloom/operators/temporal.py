"""Activity over time: densities, coverage, trends, chains and context windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.dates import day_of, iso_week_label, month_first, period_label, period_start
from threadloom.operators.rounds import written


def density_by_week(messages: DataFrame) -> DataFrame:
    """ISO weeks with their distinct chats and messages."""
    week = messages.withColumn("week_start", period_start(day_of(F.col("ts_ms")), "week"))
    out = week.groupBy("week_start").agg(F.countDistinct("chat_id").alias("conversation_count"), F.count("*").alias("message_count"))
    return out.select(iso_week_label(F.col("week_start")).alias("week_label"), "week_start", F.date_add("week_start", 6).alias("week_end"), "conversation_count", "message_count")


def weeks_of_items(items: DataFrame) -> DataFrame:
    """Each item that isn't archived in every week from its start to its end; items that end before they start have none."""
    first = F.coalesce("source_start_date", month_first(F.col("first_seen")))
    last = F.coalesce("source_end_date", "source_start_date", month_first(F.col("first_seen")))
    live = items.filter("status <> 'archived'").withColumns({"_a": first, "_b": last}).filter("_a <= _b")
    weeks = F.sequence(period_start(F.col("_a"), "week"), period_start(F.col("_b"), "week"), F.expr("interval 7 days"))
    return live.withColumn("week_start", F.explode(weeks)).drop("_a", "_b")


def coverage_by_week(items: DataFrame, by_type: bool = False) -> DataFrame:
    """Distinct items that cover each week, in all or by item type."""
    keys = ["week_start", *["item_type"] * by_type]
    out = weeks_of_items(items).groupBy(*keys).agg(F.countDistinct("id").alias("item_count"))
    return out.withColumn("week_label", iso_week_label(F.col("week_start")))


def coverage_analysis(messages: DataFrame, items: DataFrame) -> DataFrame:
    """One row: the weeks of either kind as sorted lists, totals, the span, and how many items are dated."""
    memory = density_by_week(messages).agg(
        F.array_sort(F.collect_list(F.struct("week_start", "week_label", "conversation_count", "message_count"))).alias("memory_weeks"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
    )
    library = coverage_by_week(items).agg(F.array_sort(F.collect_list(F.struct("week_start", "week_label", "item_count"))).alias("library_weeks"))
    totals = items.agg(F.count("*").alias("total_items"), F.count("source_start_date").alias("items_with_dates"))
    chats = messages.agg(F.countDistinct("chat_id").alias("total_conversations"), F.min(day_of(F.col("ts_ms"))).alias("first_day"), F.max(day_of(F.col("ts_ms"))).alias("last_day"))
    return memory.crossJoin(library).crossJoin(totals).crossJoin(chats)


def coverage_gaps(messages: DataFrame, items: DataFrame, least_messages: int = 1) -> DataFrame:
    """Weeks with at least so many messages that no item covers."""
    return density_by_week(messages).filter(F.col("message_count") >= least_messages).join(coverage_by_week(items).select("week_start"), "week_start", "left_anti")


def occurrences_by_week(history: DataFrame) -> DataFrame:
    """Occurrences of items by week: generated, found again, and all."""
    week = history.withColumn("week_start", period_start(F.col("occurred_at"), "week"))
    return week.groupBy("week_start").agg(
        F.count_if(F.col("source_type") == "generation").alias("new_count"),
        F.count_if(F.col("source_type").isin("deduplication", "topic_filter")).alias("repeat_count"),
        F.count("*").alias("total_count"),
    ).withColumn("week_label", iso_week_label(F.col("week_start")))


def mentions_by_period(mentions: DataFrame, grain: str, entity_ids: list[str] | None = None) -> DataFrame:
    """Mentions of entities (all, or those given) by day, week or month."""
    some = mentions.filter(F.col("ts_ms").isNotNull())
    if entity_ids is not None:
        some = some.filter(F.col("entity_id").isin(entity_ids))
    start = some.withColumn("period_start", period_start(day_of(F.col("ts_ms")), grain))
    return start.groupBy("entity_id", "period_start").agg(F.count("*").alias("mention_count")).withColumn("period_label", period_label(F.col("period_start"), grain))


def entity_evolution(mentions: DataFrame, entity_id: str, grain: str, limit: int) -> DataFrame:
    """The newest periods of one entity."""
    return mentions_by_period(mentions, grain, [entity_id]).orderBy(F.desc("period_start")).limit(limit).select("period_label", "period_start", "mention_count")


def entities_evolution(mentions: DataFrame, entities: DataFrame, entity_ids: list[str], grain: str, limit: int) -> DataFrame:
    """The newest periods of several entities with their names: at most ``limit`` for each on average."""
    named = entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type")
    out = mentions_by_period(mentions, grain, entity_ids).join(named, "entity_id")
    return out.orderBy(F.desc("period_start"), "entity_id").limit(limit * len(entity_ids))


def evolution_matrix(mentions: DataFrame, entity_ids: list[str], grain: str) -> DataFrame:
    """A row for each period and a column for each entity; 0 where it isn't mentioned."""
    out = mentions_by_period(mentions, grain, entity_ids).groupBy("period_label").pivot("entity_id", entity_ids).agg(F.sum("mention_count"))
    return out.fillna(0).withColumnsRenamed({e: e.replace("-", "_") for e in entity_ids})


def trending(mentions: DataFrame, entities: DataFrame, as_of_ms: int, recent_months: int = 3, history_months: int = 6, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    """Entities by the change of their mentions: recent months, from the start of this one on backwards, against the months before.

    Score: the relative change in per cent; 100 for entities without history that are
    mentioned now, 0 for those never mentioned, which stay in as stable.
    """
    now = F.timestamp_millis(F.lit(as_of_ms))
    edge = lambda n: F.to_date(F.add_months(F.trunc(F.to_date(now), "month"), -n))
    day = day_of(F.col("ts_ms"))
    some = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    joined = some.join(mentions.select(F.col("entity_id").alias("id"), "ts_ms"), "id", "left")
    counted = joined.groupBy("id", "canonical_name", "entity_type").agg(
        F.count_if(day >= edge(recent_months)).alias("recent_count"),
        F.count_if((day >= edge(recent_months + history_months)) & (day < edge(recent_months))).alias("history_count"),
    )
    r, h = F.col("recent_count"), F.col("history_count")
    score = F.when(h > 0, (r - h) / h * 100).when(r > 0, 100.0).otherwise(0.0)
    direction = F.when((h > 0) & (r > h * 1.2) | (h == 0) & (r > 0), "rising").when((h > 0) & (r < h * 0.8), "declining").otherwise("stable")
    out = counted.withColumns({"trend_score": F.round(score, 6), "trend_direction": direction})
    return out.orderBy(F.when(F.col("trend_direction") == "rising", 0).otherwise(1), F.desc("trend_score"), F.desc("recent_count"), "id").limit(limit)


def activity_timeline(mentions: DataFrame, entities: DataFrame, grain: str, limit: int) -> DataFrame:
    """The newest periods: mentions, distinct entities, and entities first seen in them."""
    start = period_start(day_of(F.col("ts_ms")), grain)
    all_of = mentions.filter("ts_ms is not null").groupBy(start.alias("period_start")).agg(F.count("*").alias("mention_count"), F.countDistinct("entity_id").alias("entity_count"))
    new = entities.filter("first_seen is not null").groupBy(period_start(day_of(F.col("first_seen")), grain).alias("period_start")).agg(F.count("*").alias("new_entity_count"))
    out = all_of.join(new, "period_start", "left").fillna(0, ["new_entity_count"])
    return out.orderBy(F.desc("period_start")).limit(limit).withColumn("period_label", period_label(F.col("period_start"), grain))


def temporal_chains(conversations: DataFrame, partition: list[str], id_col: str, ts_col: str, text_col: str, max_gap_hours: int = 24) -> DataFrame:
    """Neighbours in time within a partition whose gap is positive and at most so many hours.

    The later one refers back (0.9) if its text says so, else it only follows (0.8). Rows
    without id or time take no part.
    """
    w = Window.partitionBy(*partition).orderBy(ts_col, id_col)
    known = conversations.filter(F.col(id_col).isNotNull() & F.col(ts_col).isNotNull())
    pairs = known.withColumns({"source_id": F.lag(id_col).over(w), "gap_ms": F.col(ts_col) - F.lag(ts_col).over(w)})
    back = F.lower(F.coalesce(F.col(text_col), F.lit(""))).rlike("previous|earlier|before|last time|mentioned")
    return pairs.filter((F.col("gap_ms") > 0) & (F.col("gap_ms") <= max_gap_hours * 3600000)).select(
        "source_id",
        F.col(id_col).alias("target_id"),
        F.when(back, "REFERENCED_BY").otherwise("FOLLOWED_BY").alias("relation_type"),
        F.when(back, 0.9).otherwise(0.8).alias("confidence"),
        "gap_ms",
    )


def context_windows(messages: DataFrame, hits: Column, n: int = 2) -> DataFrame:
    """For the messages that ``hits`` marks, the ids of the n before and the n after in their chat."""
    w = Window.partitionBy("chat_id").orderBy("ts_ms", "message_id")
    around = messages.withColumns({"before": F.collect_list("message_id").over(w.rowsBetween(-n, -1)), "after": F.collect_list("message_id").over(w.rowsBetween(1, n))})
    return around.filter(hits).select("message_id", "chat_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def newest_within_budget(rows: DataFrame, size: Column, order: list[Column], budget: int, partition: list[str]) -> DataFrame:
    """Rows, newest first within a partition, up to the first that would exceed the budget."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_size", F.sum(size).over(w)).filter(F.col("running_size") <= budget)


def active_periods(events: DataFrame, user: str, ts: str, gap_minutes: int) -> DataFrame:
    """Sessions: runs of a user's events with no longer gap than so many minutes."""
    w = Window.partitionBy(user).orderBy(ts)
    starts = F.when(F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) <= gap_minutes * 60_000_000, 0).otherwise(1)
    numbered = events.withColumn("_new", starts).withColumn("session", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"))


def _folded(left: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the rows that a budget admits; ``left``: what is left of it when each stretch begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, int] = dict(left)
        for b in batches:
            kept, rest = [], []
            for stretch, size in zip(b.column("_stretch").to_pylist(), b.column("_size").to_pylist(), strict=True):
                fits = now[stretch] > 0 and size <= now[stretch]
                now[stretch] -= size if fits else 0
                kept.append(fits)
                rest.append(now[stretch])
            out = b.append_column("_left", pa.array(rest, pa.int64())) if "_left" not in b.schema.names else b
            yield out.filter(pa.array(kept, pa.bool_()))

    return run


def filled_budget(rows: DataFrame, size: Column, order: list[Column], budget: int) -> DataFrame:
    """Rows in order that fit in what is left of a budget when they are reached; those that don't are passed over.

    The order must tell all rows apart; null and negative sizes count as 0, and nothing is
    taken once the budget is used up. Rows are sorted by ranges into stretches, one a task.
    The driver reads each stretch's sum and least size: a stretch is taken whole if its sum
    fits, and left out if its least size doesn't; only the others are folded row by row, one
    at a time, each handing on what it leaves. At the end all admitted stretches are
    folded once more, side by side, as it is known with how much each begins.
    """
    own = rows.withColumn("_size", F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)))
    own = written(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_stretch", F.spark_partition_id()))
    stretches = own.groupBy("_stretch").agg(F.sum("_size").alias("all"), F.min("_size").alias("least")).orderBy("_stretch").collect()
    left, begin = budget, {}
    for s in stretches:
        if left > 0 and s["least"] <= left:
            begin[s["_stretch"]] = left
            if s["all"] <= left:
                left -= s["all"]
            else:
                one = own.filter(F.col("_stretch") == s["_stretch"]).select("_stretch", "_size")
                left = one.mapInArrow(_folded({s["_stretch"]: left}), "_stretch int, _size long, _left long").agg(F.min("_left")).first()[0]
    own = own.filter(F.col("_stretch").isin(*begin)).withColumn("_left", F.lit(None).cast("long")) if begin else own.limit(0).withColumn("_left", F.lit(None).cast("long"))
    return own.mapInArrow(_folded(begin), own.schema).drop("_size", "_stretch", "_left")

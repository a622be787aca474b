"""Registered queries over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import temporal as t
from threadloom.plans.model import Model, over
from threadloom.registry import query

AS_OF_MS = 1000000000000  # 2001-09-09, near the end of the mentions
SOME = ["e-3", "e-14", "e-15", "e-92"]
_DAY = "make_timestamp(ts_ms * 1000)::DATE"
_WEEKS = f"""
, memory AS (SELECT date_trunc('week', {_DAY})::DATE AS week_start, count(DISTINCT chat_id) AS conversation_count, count(*) AS message_count FROM messages GROUP BY 1)
"""
_ITEM_WEEKS = """
, spans AS (SELECT *, coalesce(source_start_date, (first_seen || '-01')::DATE) AS a, coalesce(source_end_date, source_start_date, (first_seen || '-01')::DATE) AS b
            FROM items WHERE status <> 'archived'),
item_weeks AS (SELECT id, item_type, unnest(generate_series(date_trunc('week', a), date_trunc('week', b), INTERVAL 7 DAY))::DATE AS week_start FROM spans WHERE a <= b)
"""


@query("memory_density_by_week", over("messages", _WEEKS + "SELECT strftime(week_start, '%G-W%V') AS week_label, week_start, (week_start + 6)::DATE AS week_end, conversation_count, message_count FROM memory"))
def memory_density(spark, sf):
    return t.density_by_week(Model(spark, sf).messages())


@query("library_coverage_by_week", over("items", _ITEM_WEEKS + "SELECT week_start, strftime(week_start, '%G-W%V') AS week_label, count(DISTINCT id) AS item_count FROM item_weeks GROUP BY 1"))
def library_coverage(spark, sf):
    return t.coverage_by_week(Model(spark, sf).items())


@query("library_coverage_by_week_and_type", over("items", _ITEM_WEEKS + "SELECT week_start, item_type, strftime(week_start, '%G-W%V') AS week_label, count(DISTINCT id) AS item_count FROM item_weeks GROUP BY 1, 2"))
def library_coverage_by_type(spark, sf):
    return t.coverage_by_week(Model(spark, sf).items(), by_type=True)


@query(
    "coverage_analysis",
    over("messages items", _WEEKS + _ITEM_WEEKS + f"""
SELECT (SELECT count(*) FROM memory) AS memory_weeks, (SELECT count(DISTINCT week_start) FROM item_weeks) AS library_weeks,
       (SELECT sum(message_count)::BIGINT FROM memory) AS total_messages, (SELECT count(*) FROM items) AS total_items, (SELECT count(source_start_date) FROM items) AS items_with_dates,
       (SELECT count(DISTINCT chat_id) FROM messages) AS total_conversations, (SELECT min({_DAY}) FROM messages) AS first_day, (SELECT max({_DAY}) FROM messages) AS last_day"""),
)
def coverage_analysis(spark, sf):
    m = Model(spark, sf)
    return t.coverage_analysis(m.messages(), m.items()).withColumns({"memory_weeks": F.size("memory_weeks"), "library_weeks": F.size("library_weeks")})


@query("coverage_gaps", over("messages items", _WEEKS + _ITEM_WEEKS + """
SELECT week_start, strftime(week_start, '%G-W%V') AS week_label, (week_start + 6)::DATE AS week_end, conversation_count, message_count
FROM memory WHERE week_start NOT IN (SELECT week_start FROM item_weeks WHERE item_type = 'idea')"""))
def coverage_gaps(spark, sf):
    m = Model(spark, sf)
    return t.coverage_gaps(m.messages(), m.items().filter("item_type = 'idea'"))


@query("occurrence_trend_by_week", over("history", """
SELECT date_trunc('week', occurred_at)::DATE AS week_start, strftime(date_trunc('week', occurred_at), '%G-W%V') AS week_label, count(*) FILTER (source_type = 'generation') AS new_count,
       count(*) FILTER (source_type IN ('deduplication', 'topic_filter')) AS repeat_count, count(*) AS total_count FROM history GROUP BY 1, 2"""))
def occurrence_trend(spark, sf):
    return t.occurrences_by_week(Model(spark, sf).history())


def _label(grain: str, d: str) -> str:
    return {"day": f"strftime({d}, '%Y-%m-%d')", "week": f"strftime({d}, '%Y') || '-W' || strftime({d}, '%V')", "month": f"strftime({d}, '%Y-%m')"}[grain]


def _evolution(grain: str) -> None:
    start = f"date_trunc('{grain}', {_DAY})::DATE"

    @query(f"entity_evolution_{grain}", over("mentions", f"""
SELECT {_label(grain, 'p')} AS period_label, p AS period_start, n AS mention_count
FROM (SELECT {start} AS p, count(*) AS n FROM mentions WHERE entity_id = 'e-3' GROUP BY 1 ORDER BY p DESC LIMIT 20)"""))
    def evolution(spark, sf):
        return t.entity_evolution(Model(spark, sf).mentions(), "e-3", grain, 20)

    @query(f"activity_timeline_{grain}", over("mentions entities", f"""
SELECT p AS period_start, mention_count, entity_count, coalesce(new_entity_count, 0) AS new_entity_count, {_label(grain, 'p')} AS period_label
FROM (SELECT {start} AS p, count(*) AS mention_count, count(DISTINCT entity_id) AS entity_count FROM mentions GROUP BY 1)
LEFT JOIN (SELECT date_trunc('{grain}', make_timestamp(first_seen * 1000)::DATE)::DATE AS p, count(*) AS new_entity_count FROM entities WHERE first_seen IS NOT NULL GROUP BY 1) USING (p)
ORDER BY p DESC LIMIT 400"""))
    def timeline(spark, sf):
        m = Model(spark, sf)
        return t.activity_timeline(m.mentions(), m.entities(), grain, 400)


for _grain in ("day", "week", "month"):
    _evolution(_grain)


@query("entities_evolution", over("mentions entities", f"""
SELECT entity_id, p AS period_start, k AS mention_count, {_label('month', 'p')} AS period_label, canonical_name, entity_type
FROM (SELECT entity_id, date_trunc('month', {_DAY})::DATE AS p, count(*) AS k FROM mentions WHERE entity_id IN ('e-3', 'e-14', 'e-15', 'e-92') GROUP BY 1, 2)
JOIN entities ON id = entity_id ORDER BY p DESC, entity_id LIMIT 40"""))
def entities_evolution(spark, sf):
    m = Model(spark, sf)
    return t.entities_evolution(m.mentions(), m.entities(), SOME, "month", 10)


@query("evolution_matrix", over("mentions", f"""
SELECT {_label('month', f"date_trunc('month', {_DAY})::DATE")} AS period_label, """ + ", ".join(f"count(*) FILTER (entity_id = '{e}') AS {e.replace('-', '_')}" for e in SOME) + " FROM mentions WHERE entity_id IN ('e-3', 'e-14', 'e-15', 'e-92') GROUP BY 1"))
def evolution_matrix(spark, sf):
    return t.evolution_matrix(Model(spark, sf).mentions(), SOME, "month")


@query("trending_entities", over("mentions entities", f"""
, c AS (SELECT e.id, canonical_name, entity_type, count(*) FILTER (d >= DATE '2001-06-01') AS r, count(*) FILTER (d >= DATE '2000-12-01' AND d < DATE '2001-06-01') AS h
        FROM entities e LEFT JOIN (SELECT entity_id, {_DAY} AS d FROM mentions) ON entity_id = e.id GROUP BY ALL)
SELECT id, canonical_name, entity_type, r AS recent_count, h AS history_count, round(CASE WHEN h > 0 THEN (r - h) / h * 100 WHEN r > 0 THEN 100.0 ELSE 0.0 END, 6) AS trend_score,
       CASE WHEN (h > 0 AND r > h * 1.2) OR (h = 0 AND r > 0) THEN 'rising' WHEN h > 0 AND r < h * 0.8 THEN 'declining' ELSE 'stable' END AS trend_direction
FROM c ORDER BY (trend_direction <> 'rising'), trend_score DESC, r DESC, id LIMIT 20"""))
def trending_entities(spark, sf):
    m = Model(spark, sf)
    return t.trending(m.mentions(), m.entities(), AS_OF_MS)


@query("temporal_chains", over("messages", r"""
, c AS (SELECT chat_id, workspace, min(ts_ms) AS ts, arg_min(text, ts_ms) AS text FROM messages GROUP BY ALL),
p AS (SELECT *, lag(chat_id) OVER w AS source_id, ts - lag(ts) OVER w AS gap_ms FROM c WINDOW w AS (PARTITION BY workspace ORDER BY ts, chat_id))
SELECT source_id, chat_id AS target_id, CASE WHEN back THEN 'REFERENCED_BY' ELSE 'FOLLOWED_BY' END AS relation_type, CASE WHEN back THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence, gap_ms
FROM (SELECT *, regexp_matches(lower(coalesce(text, '')), 'previous|earlier|before|last time|mentioned') AS back FROM p) WHERE gap_ms > 0 AND gap_ms <= 48 * 3600000"""))
def temporal_chains(spark, sf):
    chats = Model(spark, sf).messages().groupBy("chat_id", "workspace").agg(F.min("ts_ms").alias("ts"), F.min_by("text", "ts_ms").alias("text"))
    return t.temporal_chains(chats, ["workspace"], "chat_id", "ts", "text", max_gap_hours=48)


@query("context_windows", over("messages", """
, w AS (SELECT *, array_agg(message_id) OVER (PARTITION BY chat_id ORDER BY ts_ms, message_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS b,
               array_agg(message_id) OVER (PARTITION BY chat_id ORDER BY ts_ms, message_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS a FROM messages)
SELECT message_id, chat_id, coalesce(array_to_string(b, ','), '') AS before, coalesce(array_to_string(a, ','), '') AS after FROM w"""))
def context_windows(spark, sf):
    return t.context_windows(Model(spark, sf).messages(), F.lit(True))


@query("size_budget_prefix", over("messages", """
SELECT message_id, workspace, running_size::BIGINT AS running_size
FROM (SELECT *, sum(length(text)) OVER (PARTITION BY workspace ORDER BY ts_ms DESC, message_id ROWS UNBOUNDED PRECEDING) AS running_size FROM messages) WHERE running_size <= 20000"""))
def size_budget(spark, sf):
    return t.newest_within_budget(Model(spark, sf).messages(), F.length("text"), [F.desc("ts_ms"), F.col("message_id")], 20000, ["workspace"]).select("message_id", "workspace", "running_size")


@query("filled_size_budget", over("messages", """
, i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts_ms DESC, message_id) AS i, message_id, length(text) AS size FROM messages),
step(i, used, took) AS (SELECT 0::BIGINT, 0::BIGINT, FALSE UNION ALL
  SELECT i.i, CASE WHEN used < 30000 AND used + size <= 30000 THEN used + size ELSE used END, used < 30000 AND used + size <= 30000 FROM step JOIN i ON i.i = step.i + 1)
SELECT message_id, size FROM step JOIN i USING (i) WHERE took"""))
def filled_budget(spark, sf):
    """The newest messages that fit in 30,000 characters, larger ones passed over."""
    m = Model(spark, sf).messages()
    return t.filled_budget(m, F.length("text"), [F.desc("ts_ms"), F.col("message_id")], 30000).select("message_id", F.length("text").alias("size"))


@query("activity_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM n GROUP BY 1, 2""")
def activity_sessions(spark, sf):
    return t.active_periods(Model(spark, sf).activity(), "user_id", "ts", 60)


@query("monthly_message_counts", over("messages", f"SELECT strftime({_DAY}, '%Y-%m') AS month, workspace, count(*) AS message_count FROM messages GROUP BY 1, 2"))
def monthly_messages(spark, sf):
    from threadloom.functions.dates import day_of, month_grain

    return Model(spark, sf).messages().groupBy(month_grain(day_of(F.col("ts_ms"))).alias("month"), "workspace").agg(F.count("*").alias("message_count"))

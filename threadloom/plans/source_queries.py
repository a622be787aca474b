"""Registered queries over sources, streams and incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans.model import Model, over
from threadloom.registry import query
from threadloom.sources import documents as docs
from threadloom.sources import logs
from threadloom.streaming import events as ev


def _event_lines(m: Model):
    """Conversations written as event lines: assistants as content blocks with a tool between, every ninth conversation's last line cut short."""
    c = m.table("conversations")
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Read").alias("name"))))
    stamp = F.date_format(F.timestamp_millis(F.lit(1704067200000) + F.col("conv_id") * 21600000 + F.col("turn") * 60000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), F.concat("conv_id", F.lit("-"), "turn").alias("uuid"), F.col("conv_id").cast("string").alias("sessionId"), F.concat(F.lit("/w/"), F.col("conv_id") % 5).alias("cwd"), F.struct(F.when(F.col("role") == "assistant", block).otherwise(F.col("text")).alias("content")).alias("message")))
    return c.select("conv_id", "turn", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), F.substring(line, 1, 30)).otherwise(line).alias("value"))


@query("event_log_messages", """
SELECT conv_id::VARCHAR AS session_id, conv_id || '-' || turn AS uuid, role AS message_type, 1704067200000 + conv_id * 21600000 + turn * 60000 AS ts_ms, '/w/' || (conv_id % 5) AS cwd,
       length(CASE WHEN role = 'assistant' THEN trim(text) || ' [Tool: Read]' ELSE trim(text) END) > 0 AS has_text
FROM conversations WHERE role IN ('user', 'assistant') AND NOT (conv_id % 9 = 0 AND turn = 0)""")
def event_log(spark, sf):
    return logs.parse_events(_event_lines(Model(spark, sf))).select("session_id", "uuid", "message_type", "ts_ms", "cwd", (F.length("text") > 0).alias("has_text"))


@query("event_log_bad_lines", "SELECT count(*) FILTER (conv_id % 9 = 0 AND turn = 0) AS bad_lines, count(*) AS lines FROM conversations")
def event_log_bad(spark, sf):
    return logs.bad_lines(_event_lines(Model(spark, sf)))


@query("event_log_sessions", """
SELECT conv_id::VARCHAR AS session_id, '/w/' || (conv_id % 5) AS workspace, count(*) AS messages, min(1704067200000 + conv_id * 21600000 + turn * 60000) AS first_ms
FROM conversations WHERE role IN ('user', 'assistant') AND NOT (conv_id % 9 = 0 AND turn = 0) GROUP BY conv_id""")
def event_log_sessions(spark, sf):
    return logs.sessions_as_conversations(logs.parse_events(_event_lines(Model(spark, sf)))).select("session_id", "workspace", "messages", "first_ms")


@query("key_value_chats", """
SELECT conv_id::VARCHAR AS chat_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS place, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS message_type,
       1700000000000 + conv_id * 1000 AS ts_ms FROM conversations WHERE trim(text) <> ''""")
def key_value_chats(spark, sf):
    """Conversations as a key-value export in two layouts: message lists, and headers with bubbles looked up by key."""
    c = Model(spark, sf).table("conversations").filter("trim(text) <> ''")
    created = F.lit(1700000000000) + F.col("conv_id") * 1000
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("type"), x["text"].alias("text")))
    lists = c.filter("conv_id % 2 = 0").groupBy("conv_id").agg(m.alias("messages")).select(F.concat(F.lit("composerData:"), "conv_id").alias("key"), F.to_json(F.struct(created.alias("createdAt"), created.alias("lastUpdatedAt"), "messages")).alias("value"))
    h = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.struct(x["turn"].cast("string").alias("bubbleId"), F.when(x["role"] == "user", 1).otherwise(2).alias("type")))
    odd = c.filter("conv_id % 2 = 1")
    heads = odd.groupBy("conv_id").agg(h.alias("h")).select(F.concat(F.lit("composerData:"), "conv_id").alias("key"), F.to_json(F.struct(created.alias("createdAt"), created.alias("lastUpdatedAt"), F.col("h").alias("fullConversationHeadersOnly"))).alias("value"))
    bubbles = odd.select(F.concat_ws(":", F.lit("bubbleId"), "conv_id", "turn").alias("key"), F.to_json(F.struct("text")).alias("value"))
    return logs.parse_key_values(lists.unionAll(heads).unionAll(bubbles)).select("chat_id", "place", "message_type", "ts_ms")


@query("packed_document_chunks")
def packed_chunks(spark, sf):
    """Documents in chunks of at most 120 words by line, tested against a plain loop."""
    d = Model(spark, sf).table("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.packed_paragraphs(d, ["doc_id"], 120).select("doc_id", "part", "words", F.md5("text").alias("text_md5"))


@query("speaker_turns", """
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chunk_index, 'Speaker ' || upper(role[1]) || role[2:] AS speaker, '00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') AS clock
FROM conversations""")
def speaker_turns(spark, sf):
    """Conversations written as transcripts and split into turns again."""
    said = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit("")), F.lit("!"))
    line = F.concat(F.lit("Speaker "), F.initcap("role"), F.lit(" (00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("):\n"), said)
    t = Model(spark, sf).table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda x: x["x"]), "\n").alias("text"))
    return docs.speaker_turns(t, "conv_id").select("conv_id", "chunk_index", "speaker", "clock")


_COUNTS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("tumbling_windows", _COUNTS)
def tumbling(spark, sf):
    return ev.tumbling_counts(Model(spark, sf).table("events"))


@query("streamed_tumbling_windows", _COUNTS)
def streamed(spark, sf):
    """The same windows by a stream over the events' files."""
    return ev.run_once(ev.tumbling_counts(ev.event_stream(spark, f"{sf}/events.parquet*"), late="365 days"), ev.work_folder(spark))


@query("sliding_windows", """
SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2""")
def sliding(spark, sf):
    return ev.tumbling_counts(Model(spark, sf).table("events"), "2 hours", slide="1 hour")


@query("session_windows", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, k""")
def sessions(spark, sf):
    return ev.session_counts(Model(spark, sf).table("events"))


@query("ingested_events", "SELECT event_id, event_type FROM events")
def ingested(spark, sf):
    """Events ingested by a stream; a second run over the same files adds nothing."""
    folder = ev.work_folder(spark)
    ev.ingest(ev.event_stream(spark, f"{sf}/events.parquet*"), folder, "event_id")
    return ev.ingest(ev.event_stream(spark, f"{sf}/events.parquet*"), folder, "event_id").select("event_id", "event_type")


@query("messages_after_marks", over("messages", """
, m AS (SELECT source, max(ts_ms) AS last_ms FROM messages WHERE vec_place % 3 = 0 AND source <> 'expert' GROUP BY 1)
SELECT message_id, x.source, ts_ms FROM messages x LEFT JOIN m USING (source) WHERE ts_ms > greatest(coalesce(last_ms, 1704600000000), 1704600000000)"""))
def after_marks(spark, sf):
    m = Model(spark, sf).messages()
    return ev.after_marks(m, ev.high_water_marks(m.filter("vec_place % 3 = 0 and source <> 'expert'")), 1704600000000).select("message_id", "source", "ts_ms")


@query("missing_long_messages", over("messages", "SELECT message_id, length(text) AS chars FROM messages WHERE length(text) > 100 AND vec_place % 3 <> 0"))
def missing_long(spark, sf):
    m = Model(spark, sf).messages()
    return ev.not_indexed(m, m.filter("vec_place % 3 = 0"), "message_id", "length(text) > 100").select("message_id", F.length("text").alias("chars"))


@query("sync_report", over("messages", """
, r AS (SELECT source, count(*) AS remote_count, max(ts_ms) AS remote_last FROM messages WHERE vec_place % 3 = 0 AND source <> 'expert' GROUP BY 1), l AS (SELECT source, count(*) AS local_count, max(ts_ms) AS local_last FROM messages GROUP BY 1)
SELECT source, local_count, local_last, coalesce(remote_count, 0) AS remote_count, remote_last, coalesce(local_count <= coalesce(remote_count, 0) OR local_last - remote_last <= 300000, FALSE) AS up_to_date FROM l LEFT JOIN r USING (source)"""))
def sync_report(spark, sf):
    m = Model(spark, sf).messages()
    return ev.sync_report(m, m.filter("vec_place % 3 = 0 and source <> 'expert'"))

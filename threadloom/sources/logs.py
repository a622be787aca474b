"""Chat logs as DataFrames: event lines, key-value exports and content blocks.

Each reader is a scan plus a parser over plain columns, so that the parser also works on
lines that come from elsewhere.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from threadloom.functions.dates import seconds_or_millis, to_millis
from threadloom.functions.text import path_from_folder

BLOCKS = "array<struct<type:string,text:string,name:string>>"
EVENT = "type string, timestamp string, uuid string, sessionId string, version string, cwd string, gitBranch string, message struct<content:string, usage:struct<input_tokens:long,output_tokens:long>>"


def block_text(content: Column) -> Column:
    """Text of a message's content: text blocks, tools by name, results left out; a plain string as it is."""
    blocks = F.from_json(content, BLOCKS)
    shown = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "tool_use")), lambda b: F.when(b["type"] == "text", b["text"]).otherwise(F.concat(F.lit("[Tool: "), F.coalesce(b["name"], F.lit("unknown")), F.lit("]"))))
    joined = F.trim(F.array_join(F.filter(shown, lambda x: x.isNotNull() & (x != "")), " "))
    return F.when(F.startswith(F.ltrim(content), F.lit("[")), F.coalesce(joined, F.lit(""))).otherwise(F.trim(content))


def parse_events(lines: DataFrame, line: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Messages of an event log: one JSON object a line.

    Only user and assistant events with text and a valid time stay; lines that are no JSON
    are dropped (``bad_lines`` counts them).
    """
    e = F.from_json(F.col(line), EVENT)
    rows = lines.select(*(keep or []), e.alias("e")).filter(F.col("e.type").isin("user", "assistant"))
    out = rows.select(
        *(keep or []),
        F.col("e.sessionId").alias("session_id"),
        F.col("e.uuid").alias("uuid"),
        F.col("e.type").alias("message_type"),
        block_text(F.col("e.message.content")).alias("text"),
        to_millis(F.col("e.timestamp")).alias("ts_ms"),
        F.col("e.cwd").alias("cwd"),
        F.col("e.gitBranch").alias("branch"),
        F.col("e.version").alias("version"),
        F.col("e.message.usage.input_tokens").alias("input_tokens"),
        F.col("e.message.usage.output_tokens").alias("output_tokens"),
    )
    return out.filter("ts_ms is not null and text is not null and text <> ''")


def bad_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """How many lines that aren't blank are no JSON objects."""
    bad = (F.trim(line) != "") & F.try_parse_json(line).isNull()
    return lines.agg(F.count_if(bad).alias("bad_lines"), F.count("*").alias("lines"))


def read_sessions(spark: SparkSession, folder: str, workspaces: list[str] | None = None) -> DataFrame:
    """Messages of all session files below a folder of {workspace}/{session}.jsonl and {workspace}/{session}/subagents/agent-*.jsonl."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    below = F.regexp_replace("file", r"^.*?" + folder.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    sub = F.rlike("file", F.lit(r"/subagents/agent-[^/]*\.jsonl$"))
    kept = lines.withColumns({"folder": F.split(below, "/")[0], "is_subagent": sub}).filter(sub | ~F.contains("file", F.lit("/subagents/")))
    out = parse_events(kept, keep=["file", "folder", "is_subagent"]).withColumn("workspace", path_from_folder(F.col("folder")))
    return out if workspaces is None else out.filter(F.col("workspace").isin(workspaces))


def sessions_as_conversations(messages: DataFrame) -> DataFrame:
    """One row a session: its first folder, span, and its messages in order."""
    m = F.array_sort(F.collect_list(F.struct("ts_ms", "uuid", "message_type", "text")))
    return messages.groupBy("session_id").agg(F.min_by("cwd", F.struct("ts_ms", "uuid")).alias("workspace"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("messages"), m.alias("conversation"))


CHAT = """struct<createdAt:long, lastUpdatedAt:long, text:string, richText:string,
 conversation:struct<messages:array<struct<type:string,text:string,timestamp:long>>>,
 conversationMap:map<string,struct<messages:array<struct<type:string,text:string,timestamp:long>>>>,
 fullConversationHeadersOnly:array<struct<bubbleId:string,type:int,text:string>>,
 messages:array<struct<type:string,text:string,timestamp:long>>, chat:struct<messages:array<struct<type:string,text:string,timestamp:long>>>>"""


def parse_key_values(kv: DataFrame) -> DataFrame:
    """Messages of a key-value export (key, value as JSON): chat_id, place, message_type, text, ts_ms.

    A chat's messages are taken from the first layout that has any: the map of
    conversations, the conversation, its headers with bubbles looked up by key, the text
    itself, the message list, the nested chat. Times that are missing are spread evenly
    between the chat's creation and its last update. Values that are no JSON are skipped.
    """
    chats = kv.filter(F.rlike("key", F.lit("^(composerData|chatData):"))).select(F.substring_index("key", ":", -1).alias("chat_id"), F.from_json("value", CHAT).alias("c")).filter("c is not null")
    listed = F.coalesce(
        F.nullif(F.flatten(F.transform(F.map_values("c.conversationMap"), lambda x: F.coalesce(x["messages"], F.array().cast("array<struct<type:string,text:string,timestamp:bigint>>")))), F.array().cast("array<struct<type:string,text:string,timestamp:bigint>>")),
        F.nullif(F.col("c.conversation.messages"), F.array().cast("array<struct<type:string,text:string,timestamp:bigint>>")),
    )
    headers = F.coalesce(F.size("c.fullConversationHeadersOnly"), F.lit(0)) > 0
    whole = F.coalesce(F.nullif("c.text", F.lit("")), rich_text(F.col("c.richText")))
    later = F.when(F.coalesce(whole, F.lit("")) != "", F.array(F.struct(F.lit("user").alias("type"), whole.alias("text"), F.col("c.createdAt").alias("timestamp")))).otherwise(F.coalesce(F.nullif(F.col("c.messages"), F.array().cast("array<struct<type:string,text:string,timestamp:bigint>>")), F.col("c.chat.messages")))
    plain = chats.filter(listed.isNotNull() | ~headers).select("chat_id", "c.createdAt", "c.lastUpdatedAt", F.posexplode(F.coalesce(listed, later)).alias("place", "m")).select("chat_id", "createdAt", "lastUpdatedAt", "place", "m.type", "m.text", "m.timestamp")
    bubble = kv.filter(F.startswith("key", F.lit("bubbleId:"))).select(F.col("key").alias("_k"), F.from_json("value", "text string, timestamp long").alias("b"))
    heads = chats.filter(listed.isNull() & headers).select("chat_id", "c.createdAt", "c.lastUpdatedAt", F.posexplode("c.fullConversationHeadersOnly").alias("place", "h"))
    looked = heads.withColumn("_k", F.concat_ws(":", F.lit("bubbleId"), "chat_id", "h.bubbleId")).join(bubble, "_k", "left")
    found = looked.select("chat_id", "createdAt", "lastUpdatedAt", "place", F.when(F.col("h.type") == 1, "user").otherwise("assistant").alias("type"), F.coalesce("b.text", "h.text").alias("text"), "b.timestamp")
    rows = plain.unionByName(found)
    n = F.count("*").over(Window.partitionBy("chat_id"))
    span = F.col("lastUpdatedAt") - F.col("createdAt")
    spread = F.when((n == 1) | (span <= 0) | span.isNull(), F.col("createdAt")).otherwise(F.col("createdAt") + F.floor(span * F.col("place") / (n - 1)).cast("long"))
    out = rows.withColumn("ts_ms", seconds_or_millis(F.coalesce("timestamp", spread)))
    return out.filter("text is not null and trim(text) <> ''").select("chat_id", "place", F.when(F.col("type").isin("user", "1"), "user").otherwise("assistant").alias("message_type"), "text", "ts_ms")


@F.pandas_udf(StringType())
def rich_text(values: pd.Series) -> pd.Series:
    """The texts of a rich text's tree, depth first through ``root`` and ``children`` only, joined by blanks.

    An object without a root is its own root.
    '' if it is no JSON object or if any text met isn't a string; texts elsewhere, as in
    attributes, don't count. The walk keeps its own stack, so depth is bounded by the text alone.
    """

    def walked(raw: str | None) -> str:
        try:
            tree = json.loads(raw or "")
            todo, out = [tree.get("root", tree)], []
        except (ValueError, AttributeError, RecursionError):
            return ""
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += reversed(node)
            elif isinstance(node, dict):
                if "text" in node:
                    out.append(node["text"])
                children = node.get("children", [])
                if not isinstance(children, (list, dict, str)):
                    return ""
                todo += reversed(list(children))
        return " ".join(out) if all(isinstance(t, str) for t in out) else ""

    return values.map(walked, na_action=None).astype(object)


def progress_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Markers such as [PHASE:x], [STAT:k=v], [PROGRESS:n], [COST:x] in a run's output, typed and in order of place."""
    marks = F.regexp_extract_all(F.col(line), F.lit(r"\[((?:PHASE|STAT|INFO|PROGRESS|COST|ERROR|WARNING):[^\]]*)\]"), 1)
    one = F.explode(marks).alias("m")
    return lines.select(*[c for c in lines.columns if c != line], one).select("*", F.substring_index("m", ":", 1).alias("kind"), F.replace(F.regexp_extract("m", r"^[A-Z]+:(.*)$", 1), F.lit("≡"), F.lit("=")).alias("content")).drop("m")

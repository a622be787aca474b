"""The data model over the fixture tables: messages, entities, mentions, relations, items and the rest.

Every view is a deterministic projection of a fixture table, written once as DataFrames
and once as SQL for the oracle, so that operators work on the model's columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_TYPES = ("tool", "pattern", "problem", "concept", "person", "project", "workflow")
RELATION_TYPES = ("SOLVES", "CAUSES", "ENABLES", "PART_OF", "USED_WITH", "ALTERNATIVE_TO", "REQUIRES", "IMPLEMENTS", "MENTIONED_BY")
SOURCES = ("editor", "terminal", "workspace_docs", "expert")
ITEM_TYPES = ("idea", "insight", "use_case")
EPOCH_MS = 1704067200000  # 2024-01-01


def pick(values: tuple[str, ...], n: Column) -> Column:
    """The value at place n modulo the number of values."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


class Model:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", "embedding", "label")

    def with_vector(self, df: DataFrame, place: Column) -> DataFrame:
        """``df`` with the embedding whose id is ``place`` modulo the number of embeddings."""
        vectors = self.vectors()
        size = vectors.agg(F.count("*").alias("_size"))
        placed = df.crossJoin(F.broadcast(size)).withColumn("_vec", F.pmod(place, F.col("_size")))
        return placed.join(vectors.select(F.col("vec_id").alias("_vec"), "embedding"), "_vec", "left").drop("_vec", "_size")

    def messages(self) -> DataFrame:
        """One row a message, without embeddings."""
        return self.table("conversations").select(
            F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("message_id"),
            "text",
            (F.lit(EPOCH_MS) + F.col("conv_id") * 21600000 + F.col("turn") * 60000).alias("ts_ms"),
            F.concat(F.lit("ws"), F.col("conv_id") % 7).alias("workspace"),
            F.concat(F.lit("chat-"), "conv_id").alias("chat_id"),
            pick(("composer", "chat"), F.col("conv_id")).alias("chat_type"),
            F.col("role").alias("message_type"),
            pick(SOURCES, F.col("conv_id")).alias("source"),
            (F.col("conv_id") * 31 + F.col("turn")).alias("vec_place"),
        )

    def embedded_messages(self) -> DataFrame:
        return self.with_vector(self.messages(), F.col("vec_place"))

    def mentions(self, tasks: int | None = None) -> DataFrame:
        """Which message mentions which entity, when, and from which source; ``tasks``: dealt to so many by ``n``, the message's number, before ids are written out."""
        lines = self.table("lineitem")
        return (lines.repartition(tasks, "l_orderkey") if tasks else lines).select(
            F.concat_ws("-", F.lit("mn"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.concat(F.lit("e-"), "l_partkey").alias("entity_id"),
            F.concat(F.lit("msg-"), "l_orderkey").alias("message_id"),
            (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).cast("long").alias("ts_ms"),
            pick(("user", "expert", "user"), F.col("l_orderkey")).alias("source"),
            *([F.col("l_orderkey").alias("n")] if tasks else []),
        )

    def entities(self) -> DataFrame:
        """Entities with counts and dates taken from their mentions."""
        named = self.table("part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("brand"))
        seen = self.mentions().groupBy("entity_id").agg(
            F.count("*").alias("mention_count"),
            F.min("ts_ms").alias("first_seen"),
            F.max("ts_ms").alias("last_seen"),
            F.count_if(F.col("source") == "user").alias("user_count"),
            F.count_if(F.col("source") == "expert").alias("expert_count"),
        )
        return named.select(
            F.concat(F.lit("e-"), "n").alias("id"),
            "n",
            "canonical_name",
            pick(ENTITY_TYPES, F.col("n")).alias("entity_type"),
            F.array(F.lower("canonical_name"), F.col("brand")).alias("aliases"),
            pick(("user", "expert", "both"), F.col("n")).alias("source_type"),
            ((F.col("n") % 10) / 10).alias("confidence"),
        ).join(seen.withColumnRenamed("entity_id", "id"), "id", "left").fillna(0, ["mention_count", "user_count", "expert_count"])

    def embedded_entities(self) -> DataFrame:
        return self.with_vector(self.entities(), F.col("n"))

    def relations(self) -> DataFrame:
        """Typed directed edges between entities that follow each other in an order."""
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("e")).groupBy("l_orderkey", "l_linenumber").agg(F.min("e").alias("e"))
        nxt = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("e").alias("f"))
        return (
            line.join(nxt, ["l_orderkey", "l_linenumber"])
            .filter("e <> f")
            .groupBy("e", "f")
            .agg(F.count("*").alias("occurrence_count"), F.min("l_orderkey").alias("o"))
            .select(
                F.concat_ws("-", F.lit("r"), "e", "f").alias("id"),
                F.concat(F.lit("e-"), "e").alias("source_entity_id"),
                F.concat(F.lit("e-"), "f").alias("target_entity_id"),
                pick(RELATION_TYPES, F.col("e") + F.col("f")).alias("relation_type"),
                F.concat(F.lit("msg-"), "o").alias("message_id"),
                "occurrence_count",
                (((F.col("e") * 7 + F.col("f")) % 11) / 10).alias("confidence"),
                pick(("user", "expert", "user"), F.col("o")).alias("source"),
            )
        )

    def items(self) -> DataFrame:
        """Library items."""
        start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 540).cast("int"))
        end = F.date_add(start, (F.col("doc_id") % 30).cast("int"))
        return self.table("documents").select(
            F.concat(F.lit("item-"), "doc_id").alias("id"),
            F.col("doc_id").alias("n"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("description"),
            pick(ITEM_TYPES, F.col("doc_id")).alias("item_type"),
            F.when(F.col("doc_id") % 10 == 0, "archived").when(F.col("doc_id") % 10 == 1, "implemented").otherwise("active").alias("status"),
            (F.col("doc_id") % 5 + 1).alias("occurrence"),
            F.when(F.col("doc_id") % 6 != 5, F.concat(F.lit("cat-"), F.col("doc_id") % 6)).alias("category_id"),
            F.when(F.col("doc_id") % 17 != 0, start).alias("source_start_date"),
            F.when(F.col("doc_id") % 17 != 0, end).alias("source_end_date"),
            F.date_format(start, "yyyy-MM").alias("first_seen"),
            F.date_format(end, "yyyy-MM").alias("last_seen"),
            F.array(F.concat(F.lit("t"), F.col("doc_id") % 4), F.concat(F.lit("u"), F.col("doc_id") % 9)).alias("tags"),
        )

    def embedded_items(self) -> DataFrame:
        return self.with_vector(self.items(), F.col("n"))

    def history(self) -> DataFrame:
        """One row for each occurrence of an item."""
        return self.items().select(F.col("id").alias("item_id"), "n", F.explode(F.sequence(F.lit(0), F.col("occurrence").cast("int") - 1)).alias("k")).select(
            "item_id",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 540 + F.col("k") * 9).cast("int")).alias("occurred_at"),
            pick(("generation", "deduplication", "topic_filter"), F.col("n") + F.col("k")).alias("source_type"),
        )

    def episodes(self) -> DataFrame:
        """Episodes with their guests."""
        return self.table("supplier").select(
            F.concat(F.lit("episode-"), "s_suppkey").alias("entity_id"),
            F.trim(F.regexp_replace(F.lower("s_name"), "[^a-z0-9]+", "-")).alias("slug"),
            F.col("s_name").alias("guest_name"),
            F.date_add(F.lit("2020-01-01").cast("date"), (F.col("s_suppkey") % 1500).cast("int")).alias("published_date"),
            F.col("s_suppkey").alias("n"),
        )

    def expert_mentions(self) -> DataFrame:
        """Chunks of episodes that mention an entity; message ids hold the episode's slug."""
        slug = self.episodes().select("n", "slug")
        docs = self.table("documents").select("doc_id", (F.col("doc_id") % 80 + 1).alias("n"))
        return docs.join(slug, "n", "left").select(
            F.concat(F.lit("x-"), "doc_id").alias("id"),
            F.concat(F.lit("expert-"), F.coalesce("slug", F.lit("no-such")), F.lit("-"), F.col("doc_id")).alias("message_id"),
            F.concat(F.lit("e-"), F.col("doc_id") + 1).alias("entity_id"),
        )

    def conversations(self) -> DataFrame:
        """One row a conversation that mentions entities: counts, first and last message, month, and day where known."""
        by = self.mentions().groupBy("message_id").agg(F.countDistinct("entity_id").alias("entity_count"), F.count("*").alias("message_count"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.min("source").alias("source_type"))
        day = F.to_date(F.timestamp_millis("first_ts"))
        return by.select(
            F.concat(F.lit("conv-"), "message_id").alias("id"),
            F.col("message_id").alias("conversation_id"),
            "entity_count",
            "message_count",
            "first_ts",
            "last_ts",
            "source_type",
            F.trunc(day, "month").alias("date_month"),
            F.when(F.substring_index("message_id", "-", -1).cast("long") % 3 != 0, day).alias("date_day"),
        )

    def activity(self) -> DataFrame:
        """Timed events of users, for day-grain and streaming operators."""
        return self.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")


#: The same views in DuckDB's SQL, by name.
SQL = {
    "messages": f"""
  SELECT 'm-' || conv_id || '-' || turn AS message_id, text, {EPOCH_MS} + conv_id * 21600000 + turn * 60000 AS ts_ms, 'ws' || (conv_id % 7) AS workspace,
         'chat-' || conv_id AS chat_id, ['composer', 'chat'][conv_id % 2 + 1] AS chat_type, role AS message_type, {_list(SOURCES)}[conv_id % 4 + 1] AS source,
         conv_id * 31 + turn AS vec_place FROM conversations""",
    "embedded_messages": """
  SELECT m.*, v.embedding FROM messages m LEFT JOIN embeddings v ON v.vec_id = m.vec_place % (SELECT count(*) FROM embeddings)""",
    "mentions": f"""
  SELECT 'mn-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'e-' || l_partkey AS entity_id,
         'msg-' || l_orderkey AS message_id, epoch_ms(l_shipdate) AS ts_ms, ['user', 'expert', 'user'][l_orderkey % 3 + 1] AS source FROM lineitem""",
    "entities": f"""
  SELECT 'e-' || n AS id, n, canonical_name, {_list(ENTITY_TYPES)}[n % 7 + 1] AS entity_type, [lower(canonical_name), brand] AS aliases,
         ['user', 'expert', 'both'][n % 3 + 1] AS source_type, (n % 10) / 10 AS confidence, coalesce(mention_count, 0) AS mention_count, first_seen, last_seen,
         coalesce(user_count, 0) AS user_count, coalesce(expert_count, 0) AS expert_count
  FROM (SELECT p_partkey AS n, p_name AS canonical_name, p_brand AS brand FROM part)
  LEFT JOIN (SELECT entity_id, count(*) AS mention_count, min(ts_ms) AS first_seen, max(ts_ms) AS last_seen, count(*) FILTER (source = 'user') AS user_count,
                    count(*) FILTER (source = 'expert') AS expert_count FROM mentions GROUP BY 1) ON entity_id = 'e-' || n""",
    "embedded_entities": """
  SELECT e.*, v.embedding FROM entities e LEFT JOIN embeddings v ON v.vec_id = e.n % (SELECT count(*) FROM embeddings)""",
    "relations": f"""
  SELECT 'r-' || e || '-' || f AS id, 'e-' || e AS source_entity_id, 'e-' || f AS target_entity_id, {_list(RELATION_TYPES)}[(e + f) % 9 + 1] AS relation_type,
         'msg-' || o AS message_id, occurrence_count, ((e * 7 + f) % 11) / 10 AS confidence, ['user', 'expert', 'user'][o % 3 + 1] AS source
  FROM (SELECT a.e, b.e AS f, count(*) AS occurrence_count, min(a.l_orderkey) AS o
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS e FROM lineitem GROUP BY 1, 2) a
        JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS e FROM lineitem GROUP BY 1, 2) b
          ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.e <> b.e GROUP BY 1, 2)""",
    "items": f"""
  SELECT 'item-' || doc_id AS id, doc_id AS n, split_part(text, chr(10), 1) AS title, text AS description, {_list(ITEM_TYPES)}[doc_id % 3 + 1] AS item_type,
         CASE doc_id % 10 WHEN 0 THEN 'archived' WHEN 1 THEN 'implemented' ELSE 'active' END AS status, doc_id % 5 + 1 AS occurrence,
         CASE WHEN doc_id % 6 <> 5 THEN 'cat-' || (doc_id % 6) END AS category_id,
         CASE WHEN doc_id % 17 <> 0 THEN s END AS source_start_date, CASE WHEN doc_id % 17 <> 0 THEN e END AS source_end_date,
         strftime(s, '%Y-%m') AS first_seen, strftime(e, '%Y-%m') AS last_seen, ['t' || (doc_id % 4), 'u' || (doc_id % 9)] AS tags
  FROM (SELECT *, DATE '2024-01-01' + (doc_id % 540)::INT AS s, DATE '2024-01-01' + (doc_id % 540)::INT + (doc_id % 30)::INT AS e FROM documents)""",
    "embedded_items": """
  SELECT i.*, v.embedding FROM items i LEFT JOIN embeddings v ON v.vec_id = i.n % (SELECT count(*) FROM embeddings)""",
    "history": """
  SELECT id AS item_id, DATE '2024-01-01' + (n % 540 + k * 9)::INT AS occurred_at, ['generation', 'deduplication', 'topic_filter'][(n + k) % 3 + 1] AS source_type
  FROM (SELECT id, n, unnest(range(occurrence)) AS k FROM items)""",
    "episodes": """
  SELECT 'episode-' || s_suppkey AS entity_id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g')) AS slug, s_name AS guest_name,
         DATE '2020-01-01' + (s_suppkey % 1500)::INT AS published_date, s_suppkey AS n FROM supplier""",
    "expert_mentions": f"""
  SELECT 'x-' || doc_id AS id, 'expert-' || coalesce(slug, 'no-such') || '-' || doc_id AS message_id, 'e-' || (doc_id + 1) AS entity_id
  FROM documents LEFT JOIN episodes ON episodes.n = doc_id % 80 + 1""",
    "convs": """
  SELECT 'conv-' || message_id AS id, message_id AS conversation_id, entity_count, message_count, first_ts, last_ts, source_type,
         date_trunc('month', make_timestamp(first_ts * 1000))::DATE AS date_month,
         CASE WHEN split_part(message_id, '-', 2)::BIGINT % 3 <> 0 THEN make_timestamp(first_ts * 1000)::DATE END AS date_day
  FROM (SELECT message_id, count(DISTINCT entity_id) AS entity_count, count(*) AS message_count, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts, min(source) AS source_type
        FROM mentions GROUP BY 1)""",
}
_NEEDS = {"embedded_messages": ["messages"], "entities": ["mentions"], "embedded_entities": ["mentions", "entities"], "embedded_items": ["items"], "history": ["items"], "expert_mentions": ["episodes"], "convs": ["mentions"]}


def over(views: str, body: str) -> str:
    """An oracle: the named views, with those that they need, before ``body`` (which may go on with ', x AS (...)')."""
    names = dict.fromkeys(n for v in views.split() for n in [*_NEEDS.get(v, []), v])
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body


def cosine_sql(a: str, b: str) -> str:
    """Cosine similarity in double precision, 0 for a zero vector."""
    return f"(CASE WHEN list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) = 0 OR list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]) = 0 THEN 0 ELSE list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]) END)"

"""Registered queries that score texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import scoring as sc
from threadloom.plans.model import EPOCH_MS, Model, over
from threadloom.registry import query


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


#: Letters beyond ASCII as a digit, which borders of words treat alike.
_PLAIN = "regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '0', 'g')"
_LOW = "lower(coalesce(text, ''))"


def _holds(words: str) -> str:
    return "(" + " OR ".join(f"contains({_LOW}, {_q(w)})" for w in words.split("|")) + ")"


_PROBLEM = _holds("problem|challenge|issue|bottleneck|pain point|struggle|difficulty|obstacle|blocker|friction|bug|error|failure|broken|slow")
_SOLUTION = _holds("solved|built|implemented|fixed|optimized|approach|pattern|technique|strategy|framework|tool|library|architecture|design|algorithm")
_COMPARE = _holds("vs|versus|compared to|alternative|instead of|trade-off|pros and cons|better than|worse than|different from|similar to")
_FRAMEWORK = _holds("framework|methodology|approach|pattern|system|model|principle|technique|strategy|method")
_TECHNICAL = f"(regexp_matches({_PLAIN}, '\\b[a-z]+[A-Z][a-zA-Z]*\\b') OR regexp_matches({_PLAIN}, '\\b[a-z]+-[a-z]+(-[a-z]+)*\\b') OR regexp_matches({_PLAIN}, '\\b[A-Z_]{{3,}}\\b') OR regexp_matches({_PLAIN}, '\\b\\w+\\.\\w+\\b'))"
_METRIC = "regexp_matches(coalesce(text, ''), '\\d+%|\\d+x|\\$\\d+|\\d+,\\d+|\\d+\\.\\d+x')"
_NAMES = f"len(list_filter(regexp_extract_all({_PLAIN}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b'), lambda n: lower(n) NOT IN ('i', 'the', 'a', 'an', 'in', 'on', 'at', 'to')))"
_QUALITY = f"""round(least(1.0, CASE WHEN {_NAMES} >= 3 THEN 0.30 ELSE 0 END + CASE WHEN {_TECHNICAL} THEN 0.15 ELSE 0 END
  + CASE WHEN {_PROBLEM} AND {_SOLUTION} THEN 0.35 WHEN {_PROBLEM} OR {_SOLUTION} THEN 0.15 ELSE 0 END + CASE WHEN {_COMPARE} THEN 0.20 ELSE 0 END
  + CASE WHEN {_METRIC} THEN 0.15 ELSE 0 END + CASE WHEN {_NAMES} >= 2 AND {_FRAMEWORK} THEN 0.10 ELSE 0 END)::DOUBLE, 6)"""


@query("chunk_quality", f"SELECT conv_id, turn, quality, quality >= 0.30 AS index FROM (SELECT *, {_QUALITY} AS quality FROM conversations)")
def chunk_quality(spark, sf):
    return sc.chunk_quality(Model(spark, sf).table("conversations")).select("conv_id", "turn", "quality", "index")


@query("chunk_quality_by_role", f"""
SELECT role, count(*) AS chunks, count(*) FILTER (quality >= 0.30) AS indexed, round(count(*) FILTER (quality >= 0.30) * 100 / count(*), 1) AS percent, round(avg(quality), 6) AS mean_quality
FROM (SELECT *, {_QUALITY} AS quality FROM conversations) GROUP BY 1""")
def chunk_quality_by_role(spark, sf):
    return sc.quality_summary(sc.chunk_quality(Model(spark, sf).table("conversations")), "role")


_SPONSOR = (
    "this episode is brought to you by|sponsored by|brought to you by|today''s sponsor|special thanks to our sponsor|check out \\w+ at|use code \\w+ for|get \\d+% off"
    "|sign up.*free trial|visit \\w+\\.com\\/\\w+|head to \\w+\\.com|go to \\w+\\.com|promo code|discount code|free trial at|links in the show notes"
).split("|")
_READ = "CASE turn % 5 WHEN 0 THEN 'This episode is brought to you by Loom. Go to loom.com, use code WARP for more. ' WHEN 1 THEN 'Get 20% off, links in the show notes. ' ELSE '' END || text"


@query("sponsor_hits", f"SELECT conv_id, turn, {' + '.join(f"regexp_matches(regexp_replace(lower(t), '[^\\x00-\\x7F]', '_', 'g'), '{p}')::INT" for p in _SPONSOR)} AS hits FROM (SELECT *, {_READ} AS t FROM conversations)")
def sponsor_hits(spark, sf):
    """Messages, some with an advertisement before them."""
    read = F.when(F.col("turn") % 5 == 0, "This episode is brought to you by Loom. Go to loom.com, use code WARP for more. ").when(F.col("turn") % 5 == 1, "Get 20% off, links in the show notes. ").otherwise("")
    return Model(spark, sf).table("conversations").select("conv_id", "turn", sc.sponsor_hits(F.concat(read, "text")).alias("hits"))


@query("validated_entities", """
WITH n AS (SELECT p_partkey AS k, p_name AS name FROM part UNION ALL SELECT p_partkey, split_part(p_name, ' ', 1) FROM part
           UNION ALL SELECT p_partkey, ['it', 'Thing', '12.5', 'We', '', 'Ab', 'data', 'a b c d e f', 'x-y', 'Loom', '--'][p_partkey % 11 + 1] FROM part),
c AS (SELECT name, ['tool', 'person', 'concept', 'pattern', 'workflow'][k // 11 % 5 + 1] AS entity_type, CASE WHEN k % 4 <> 0 THEN 'about ' || name || ' and more' ELSE 'nothing' END AS chunk FROM n),
w AS (SELECT *, lower(trim(name)) AS low, len(list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '')) AS words, regexp_matches(name, '^\\p{Lu}') AS up FROM c)
SELECT name, entity_type, reason, reason IS NULL AS valid FROM (SELECT *, CASE
  WHEN NOT contains(lower(chunk), low) THEN 'not_in_chunk'
  WHEN low IN ('thing', 'stuff', 'it', 'this', 'that', 'way', 'method', 'approach', 'process', 'system', 'solution', 'idea', 'concept', 'strategy', 'code', 'feature', 'app', 'product', 'user', 'data', 'file', 'project', 'i', 'you', 'we', 'they', 'the', 'a', 'an') THEN 'too_generic'
  WHEN words > 5 THEN 'too_long' WHEN words = 0 THEN 'empty' WHEN low IN ('i', 'you', 'we', 'they', 'it', 'this', 'that', 'the', 'a', 'an') THEN 'pronoun_or_article'
  WHEN entity_type = 'tool' AND NOT up AND NOT regexp_matches(name, '[A-Z._-]') THEN 'tool_not_proper_noun'
  WHEN entity_type = 'concept' AND length(name) < 4 AND words = 1 THEN 'concept_too_short'
  WHEN entity_type = 'concept' AND words = 1 AND NOT up AND length(name) < 6 THEN 'concept_not_substantial'
  WHEN entity_type = 'person' AND NOT up THEN 'person_not_capitalized' WHEN entity_type = 'pattern' AND words = 1 AND length(name) < 6 THEN 'pattern_not_descriptive'
  WHEN regexp_matches(name, '^[\\d\\s_.-]+$') THEN 'only_numbers_symbols' END AS reason FROM w)""")
def validated(spark, sf):
    part = Model(spark, sf).table("part")
    odd = F.array(*map(F.lit, ("it", "Thing", "12.5", "We", "", "Ab", "data", "a b c d e f", "x-y", "Loom", "--")))
    k = F.col("p_partkey")
    named = [part.select(k.alias("k"), n.alias("name")) for n in (F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.get(odd, (k % 11).cast("int")))]
    names = named[0].unionAll(named[1]).unionAll(named[2])
    kinds = F.array(*map(F.lit, ("tool", "person", "concept", "pattern", "workflow")))
    chunk = F.when(F.col("k") % 4 != 0, F.concat(F.lit("about "), "name", F.lit(" and more"))).otherwise("nothing")
    rows = names.select("name", F.get(kinds, F.expr("cast(k div 11 % 5 as int)")).alias("entity_type"), chunk.alias("chunk"))
    return sc.validated_entities(rows).select("name", "entity_type", "reason", "valid")


@query("signal_scores", over("messages", f"""
, r AS (SELECT *, CASE WHEN message_type <> lag(message_type) OVER (PARTITION BY chat_id ORDER BY ts_ms, message_id) THEN 1 ELSE 0 END AS t FROM messages),
c AS (SELECT chat_id, count(*) AS n, sum(t) AS t, sum(len(string_split(text, '```')) - 1) AS fences, sum(length(text)) + count(*) - 1 AS chars, {' + '.join(f"bool_or(contains(lower(text), '{w}'))::INT" for w in ('error', 'exception', 'failed', 'traceback', 'typeerror', 'valueerror'))} AS errors FROM r GROUP BY 1)
SELECT chat_id, n AS messages, round((least(10.0, n * 0.5) + CASE WHEN n > 1 THEN t / (n - 1) * 5 ELSE 0 END + least(5.0, fences * 0.5) + least(3.0, errors * 0.5) + least(5.0, log10(greatest(chars, 1))))::DOUBLE, 2) AS signal FROM c"""))
def signal(spark, sf):
    return sc.signal_scores(Model(spark, sf).messages())


@query("high_signal_conversations", over("messages", f"""
, c AS (SELECT chat_id, workspace, chat_type, count(*) AS messages, arg_min(text, (ts_ms, message_id)) FILTER (message_type = 'user') AS first_user_message, bool_or(contains(text, '```')) AS has_code,
  bool_or(regexp_matches(text, '^(- |\\d+\\. |# )')) AS has_structure, round(avg(length(text)), 4) AS mean_chars, sum(CASE WHEN message_type = 'user' THEN length(text) ELSE 0 END)::BIGINT AS user_chars,
  round(count(*) FILTER (message_type = 'user') / count(*), 6) AS user_ratio FROM messages WHERE ts_ms >= {EPOCH_MS} AND ts_ms < {EPOCH_MS + 20 * 86400000} GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT *, round((least(100.0, log10(greatest(user_chars, 1)) * 10) + CASE WHEN has_code OR has_structure THEN 20 ELSE 0 END - CASE WHEN messages < 4 THEN 50 ELSE 0 END - CASE WHEN user_ratio < 0.1 OR user_ratio > 0.9 THEN 20 ELSE 0 END)::DOUBLE, 6) AS score
FROM c ORDER BY score DESC, chat_id LIMIT 40"""))
def high_signal(spark, sf):
    return sc.high_signal_conversations(Model(spark, sf).messages(), EPOCH_MS, EPOCH_MS + 20 * 86400000, 40)


@query("conversation_cards", over("messages", """
, p AS (SELECT *, CASE WHEN regexp_matches(lower(text), '```|error|exception') THEN 0 WHEN message_type = 'assistant' THEN 1 ELSE 2 END AS pr FROM messages),
c AS (SELECT chat_id, coalesce(arg_min(text, (ts_ms, message_id)) FILTER (message_type = 'user'), '') AS f, arg_min(text, (pr, ts_ms, message_id)) AS b, min(ts_ms) AS ts, count(*) AS messages FROM p GROUP BY 1)
SELECT chat_id, CASE WHEN length(f) > 200 THEN left(f, 200) || '...' ELSE f END AS summary, CASE WHEN length(b) > 300 THEN left(b, 300) || '...' ELSE b END AS snippet, make_timestamp(ts * 1000)::DATE AS day, messages
FROM c ORDER BY messages DESC, chat_id LIMIT 60"""))
def cards(spark, sf):
    return sc.conversation_cards(Model(spark, sf).messages())


@query("token_estimates", over("messages", "SELECT message_id, length(text) // 4 AS by_quarter, floor(length(text) / 3.5)::BIGINT AS by_length FROM messages"))
def token_estimates(spark, sf):
    return Model(spark, sf).messages().select("message_id", tx.tokens_by_quarter(F.col("text")).alias("by_quarter"), tx.tokens_by_length(F.length("text")).alias("by_length"))


@query("cost_estimates", over("messages", """
, c AS (SELECT chat_id, ['small', 'large', 'other'][min(vec_place) % 3 + 1] AS model, sum(length(text)) AS chars, count(*) AS n FROM messages GROUP BY 1)
SELECT chat_id, model, round(((floor(chars / 3.5) + 500)::DECIMAL(14, 0) * CASE model WHEN 'small' THEN 0.15 WHEN 'large' THEN 3.0 ELSE 5.0 END::DECIMAL(6, 2) + (n * 300)::DECIMAL(14, 0) * CASE model WHEN 'small' THEN 0.6 ELSE 15.0 END::DECIMAL(6, 2)) * 0.000001::DECIMAL(7, 6), 4)::DOUBLE AS cost FROM c"""))
def costs(spark, sf):
    c = Model(spark, sf).messages().groupBy("chat_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"), F.min("vec_place").alias("k"))
    c = c.withColumn("model", F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("other")), (F.col("k") % 3 + 1).cast("int")))
    prices = spark.createDataFrame([("small", 0.15, 0.6), ("large", 3.0, 15.0)], "model string, input_price double, output_price double")
    return sc.estimated_cost(c, tx.tokens_by_length(F.col("chars")) + 500, F.col("n") * 300, prices).select("chat_id", "model", "cost")


@query("slugs", "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM supplier")
def slugs(spark, sf):
    return Model(spark, sf).table("supplier").select("s_suppkey", tx.slugify(F.col("s_name")).alias("slug"))


@query("message_identifiers", over("messages", "SELECT message_id, left(sha256(workspace || ':' || chat_id || ':' || ts_ms || ':' || left(text, 50)), 16) AS hashed_id, md5(text) AS text_md5 FROM messages"))
def identifiers(spark, sf):
    whole = F.concat_ws(":", "workspace", "chat_id", F.col("ts_ms").cast("string"), F.substring("text", 1, 50))
    return Model(spark, sf).messages().select("message_id", F.substring(F.sha2(whole, 256), 1, 16).alias("hashed_id"), F.md5("text").alias("text_md5"))


@query("documents_cut_for_embedding", """
WITH h AS (SELECT doc_id, text, left(text, 600) AS head, chr(10) || chr(10) || '[Message truncated due to length]' AS note FROM documents),
p AS (SELECT *, greatest(CASE WHEN contains(head, '.') THEN 601 - instr(reverse(rpad(head, 600, ' ')), '.') ELSE 0 END, CASE WHEN contains(head, chr(10)) THEN 601 - instr(reverse(rpad(head, 600, ' ')), chr(10)) ELSE 0 END) AS at FROM h)
SELECT doc_id, md5(CASE WHEN length(text) <= 600 THEN text WHEN "at" - 1 > 480 THEN left(head, "at") || note ELSE head || note END) AS cut_md5 FROM p""".replace(" AS at", ' AS "at"'))
def cut_documents(spark, sf):
    return Model(spark, sf).table("documents").select("doc_id", F.md5(tx.cut_for_embedding(F.col("text"), 600)).alias("cut_md5"))

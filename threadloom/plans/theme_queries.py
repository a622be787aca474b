"""Registered themes and topics, with SQL that decides row by row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import themes as t
from threadloom.operators.cluster import leader_clusters
from threadloom.plans.cluster_queries import _labels, _loop
from threadloom.plans.model import Model, over
from threadloom.registry import query

_TOPICS = """, firsts AS (SELECT chat_id, arg_min({'w': workspace, 't': chat_type, 'x': coalesce(text, '')[1:200], 'e': embedding, 'at': ts_ms}, (ts_ms, message_id)) FILTER (len(embedding) > 0) AS f, count(*) AS message_count
  FROM embedded_messages WHERE message_type = 'user' AND chat_id <> '' GROUP BY 1),
topics AS MATERIALIZED (SELECT chat_id, f.w AS workspace, f.t AS chat_type, f.x AS text, f.e AS embedding, f.at AS ts_ms, message_count FROM firsts WHERE f IS NOT NULL AND message_count >= 3)"""


@query("conversation_topics", over("embedded_messages", _TOPICS + " SELECT * EXCLUDE (embedding) FROM topics"))
def conversation_topics(spark, sf):
    return t.conversation_topics(Model(spark, sf).embedded_messages(), 3).drop("embedding")


_STOP = ", ".join(f"'{w}'" for w in t.TOPIC_STOP_WORDS)


@query("topic_cluster_titles", over("embedded_messages", f"""{_TOPICS}, v AS (SELECT chat_id AS id, embedding FROM topics), {_loop(0.3)}, {_labels('', 'similarity DESC, a')},
five AS (SELECT * FROM (SELECT cluster, text[1:100] AS text, row_number() OVER (PARTITION BY cluster ORDER BY chat_id) AS place FROM l JOIN topics ON chat_id = id) WHERE place <= 5),
raw AS (SELECT cluster, place, generate_subscripts(w, 1) AS k, regexp_replace(unnest(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word FROM (SELECT *, regexp_split_to_array(lower(text), '\\s+') AS w FROM five)),
counts AS (SELECT cluster, word, count(*) AS n, min((place, k)) AS seen FROM raw WHERE length(word) > 3 AND word NOT IN ({_STOP}) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, seen) AS r FROM counts),
names AS (SELECT cluster, string_agg(upper(word[1]) || word[2:], ' & ' ORDER BY r) AS words FROM top WHERE r <= 3 GROUP BY 1)
SELECT cluster, coalesce(words, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END) AS title FROM (SELECT cluster, text FROM five WHERE place = 1) LEFT JOIN names USING (cluster)"""))
def topic_cluster_titles(spark, sf):
    """Leader clusters of conversation topics with their titles."""
    topics = t.written(t.conversation_topics(Model(spark, sf).embedded_messages(), 3).withColumnRenamed("chat_id", "id"))
    labels = leader_clusters(topics.select("id", "embedding"), 0.3)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    return t.topic_titles(labels.join(topics.select("id", "text"), "id").select("cluster", place.alias("place"), "text"))


_CONVERSATIONS = """, cm AS MATERIALIZED (SELECT 'conv-' || concat_ws(':', coalesce(workspace, ''), coalesce(chat_id, ''), coalesce(chat_type, '')) AS id, message_id, ts_ms, message_type, coalesce(text, '') AS text, embedding FROM embedded_messages),
ce AS (SELECT id, list(x ORDER BY k) AS embedding FROM (SELECT id, k, round(avg(x), 6) AS x FROM (
  SELECT id, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM cm) GROUP BY 1, 2) GROUP BY 1),
ct AS (SELECT id, max(ts_ms) AS last_ts, coalesce(arg_max(text, (ts_ms, message_id)) FILTER (message_type = 'user'), '') AS u, coalesce(arg_max(text, (ts_ms, message_id)) FILTER (message_type = 'assistant'), '') AS a FROM cm GROUP BY 1),
cl AS (SELECT id, last_ts, trim(split_part(CASE WHEN u <> '' THEN u ELSE a END, chr(10), 1)) AS t FROM ct),
cp AS (SELECT id, string_agg(CASE WHEN length(text) > 200 THEN text[1:197] || '...' ELSE text END, chr(10) || chr(10) ORDER BY place) AS p FROM (
  SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY ts_ms DESC, message_id DESC) AS place FROM cm) WHERE place <= 3 GROUP BY 1),
ci AS MATERIALIZED (SELECT id, last_ts, CASE WHEN t = '' THEN 'Untitled Conversation' WHEN length(t) > 100 THEN t[1:97] || '...' ELSE t END AS title,
  CASE WHEN length(p) > 500 THEN p[1:497] || '...' ELSE p END AS description, embedding FROM cl JOIN ce USING (id) JOIN cp USING (id))"""


@query("conversation_items", over("embedded_messages", _CONVERSATIONS + """
, w AS (SELECT id, round(sum(x * k), 4) AS weighed FROM (SELECT id, generate_subscripts(embedding, 1) AS k, unnest(embedding) AS x FROM ci) GROUP BY 1)
SELECT id, title, description, last_ts, weighed FROM ci JOIN w USING (id)"""))
def conversation_items(spark, sf):
    """Conversations as items; the mean embedding is shown by a weighted sum of its dimensions."""
    weighed = F.round(F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b), 4)
    return t.conversation_items(Model(spark, sf).embedded_messages()).select("id", "title", "description", "last_ts", weighed.alias("weighed"))


_THEME_STOP = ", ".join(f"'{w}'" for w in t.THEME_STOP_WORDS)


def _preview(least: float) -> str:
    broad = least < 0.6
    half = "2" if broad else "ceil(least(n, 10) / 2)"
    return f"""{_CONVERSATIONS}, th AS MATERIALIZED (SELECT '0:' || id AS id, id AS item, title, embedding::FLOAT[] AS embedding FROM embedded_items WHERE len(embedding) > 0
  UNION ALL SELECT '1:' || lpad((999999999999999 - last_ts)::VARCHAR, 15, '0') || ':' || id, id, title, embedding::FLOAT[] FROM ci), {_loop(least, 'th')}, {_labels('', 'similarity DESC, a')},
mem AS MATERIALIZED (SELECT cluster, coalesce(title, '') AS title, row_number() OVER (PARTITION BY cluster ORDER BY l.id) AS place FROM l JOIN th ON th.id = l.id),
agg AS (SELECT cluster, count(*) AS n, arg_min(title, place) AS first, arg_max(title, (length(title), place)) AS longest FROM mem GROUP BY 1),
ws AS (SELECT DISTINCT ON (cluster, place, word) * FROM (SELECT cluster, place, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM (SELECT *, regexp_split_to_array(lower(title), '\\s+') AS w FROM mem WHERE place <= 10)) ORDER BY cluster, place, word, k),
counts AS (SELECT cluster, word, count(*) AS found, min((place, k)) AS seen FROM ws WHERE length(word) > 3 AND word NOT IN ({_THEME_STOP}) GROUP BY 1, 2),
top AS (SELECT cluster, word, row_number() OVER (PARTITION BY cluster ORDER BY found DESC, seen) AS r FROM counts JOIN agg USING (cluster) WHERE found >= {half}),
names AS (SELECT cluster, string_agg(replace(upper(word[1]), 'ẞ', 'SS') || word[2:], ' & ' ORDER BY r) AS words FROM top WHERE r <= 3 GROUP BY 1),
part AS (SELECT *, CASE WHEN trim(regexp_split_to_array(longest, '[:\\-–]')[1]) <> '' THEN trim(regexp_split_to_array(longest, '[:\\-–]')[1]) ELSE longest END AS p FROM agg LEFT JOIN names USING (cluster))
SELECT 'theme-' || item AS theme, CASE WHEN n = 1 THEN first WHEN words IS NOT NULL THEN CASE WHEN {broad} AND n > 10 THEN words || ' (' || n || ')' ELSE words END
  WHEN {broad} AND n > 5 THEN CASE WHEN length(p) > 35 THEN p[1:32] || '...' ELSE p END
  ELSE CASE WHEN length(first) > 40 THEN first[1:37] || '...' ELSE first END || ' (+' || (n - 1) || ')' END AS name,
  n AS item_count, row_number() OVER (ORDER BY n DESC, cluster) AS rank, n = 1 AS one_off FROM part JOIN th ON th.id = cluster"""


def _themes(spark, sf, least):
    m = Model(spark, sf)
    return t.theme_preview(m.embedded_items(), t.conversation_items(m.embedded_messages()), least)


@query("theme_preview", over("embedded_messages embedded_items", _preview(0.75)))
def theme_preview(spark, sf):
    """All themes of all items and conversations, and one-offs, at the usual threshold."""
    return _themes(spark, sf, 0.75)


@query("theme_preview_broad", over("embedded_messages embedded_items", _preview(0.35)))
def theme_preview_broad(spark, sf):
    """The same in a broad view, with other names."""
    return _themes(spark, sf, 0.35)


@query("unexplored_words", over("messages items", """
, own AS (SELECT coalesce(chat_id, 'unknown') AS chat_id, ts_ms, message_id, coalesce(text, '') AS text FROM messages WHERE source NOT IN ('expert', 'workspace_docs')),
words AS (SELECT chat_id, ts_ms, message_id, text, regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '^[^a-z]+|[^a-z]+$', '', 'g') AS word FROM own),
known AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(title), '\\s+')) AS word FROM items WHERE status <> 'archived')
SELECT upper(word[1]) || word[2:] AS topic, count(DISTINCT chat_id) AS conversation_count, CASE WHEN count(DISTINCT chat_id) >= 10 THEN 'high' ELSE 'medium' END AS severity, arg_min(text, (ts_ms, message_id))[1:100] AS sample
FROM words WHERE length(word) > 4 AND word NOT IN (FROM known) GROUP BY word HAVING count(DISTINCT chat_id) >= 5"""))
def unexplored_words(spark, sf):
    """Words of many conversations that no library title holds, all of them."""
    m = Model(spark, sf)
    return t.unexplored_words(m.messages().filter("source not in ('expert', 'workspace_docs')"), m.items(), limit=None)

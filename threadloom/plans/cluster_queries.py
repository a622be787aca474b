"""Registered clusterings over whole tables, with SQL that decides row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import cluster as cl
from threadloom.operators import similarity as s
from threadloom.plans.model import Model, cosine_sql, over
from threadloom.registry import query


def _message_vectors(m: Model):
    return m.embedded_messages().filter("message_type = 'user'").select(F.col("message_id").alias("id"), "embedding")


_USER = "v AS (SELECT message_id AS id, embedding FROM embedded_messages WHERE message_type = 'user' AND embedding IS NOT NULL)"


def _loop(least: float, source: str = "v", name: str = "") -> str:
    """Pairs, and the indices that are chosen when all are looked at in order of id; one step a row."""
    return f"""
i{name} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) AS i, id, embedding FROM {source}),
p{name} AS MATERIALIZED (SELECT a.i AS a, b.i AS b, round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS similarity FROM i{name} a JOIN i{name} b ON a.i < b.i
  WHERE round({cosine_sql('a.embedding', 'b.embedding')}, 6) >= {least}),
e{name} AS MATERIALIZED (SELECT i, coalesce(earlier, []) AS earlier FROM i{name} LEFT JOIN (SELECT b, list(a) AS earlier FROM p{name} GROUP BY 1) ON b = i),
step{name}(i, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT e.i, CASE WHEN list_has_any(e.earlier, s.chosen) THEN s.chosen ELSE list_append(s.chosen, e.i) END FROM step{name} s JOIN e{name} e ON e.i = s.i + 1),
c{name} AS MATERIALIZED (SELECT unnest(chosen) AS i FROM (SELECT arg_max(chosen, i) AS chosen FROM step{name}))"""


def _labels(name: str, order: str) -> str:
    return f"""
l{name} AS MATERIALIZED (SELECT x.id, y.id AS cluster FROM (
  SELECT i AS b, i AS a FROM c{name} UNION ALL
  SELECT b, a FROM (SELECT b, a, row_number() OVER (PARTITION BY b ORDER BY {order}) AS r FROM p{name} WHERE a IN (FROM c{name}) AND b NOT IN (FROM c{name})) WHERE r = 1)
  JOIN i{name} x ON x.i = b JOIN i{name} y ON y.i = a)"""


_LEADERS = f", {_USER}, {_loop(0.3)}, {_labels('', 'similarity DESC, a')}"
_SWEEPS = f", {_USER}, {_loop(0.3)}, {_labels('', 'a')}"
_BANDS = "CASE WHEN count(*) >= 10 THEN 'large' WHEN count(*) >= 5 THEN 'medium' WHEN count(*) >= 3 THEN 'small' ELSE 'tiny' END AS band"


@query("leader_clusters", over("embedded_messages", _LEADERS + " SELECT * FROM l"))
def leader_clusters(spark, sf):
    return cl.leader_clusters(_message_vectors(Model(spark, sf)), 0.3)


@query("sweep_clusters", over("embedded_messages", _SWEEPS + " SELECT * FROM l"))
def sweep_clusters(spark, sf):
    return cl.sweep_clusters(_message_vectors(Model(spark, sf)), 0.3)


@query("cluster_size_bands", over("embedded_messages", _LEADERS + f" SELECT cluster, count(*) AS size, {_BANDS} FROM l GROUP BY 1"))
def size_bands(spark, sf):
    return cl.cluster_sizes(leader_clusters(spark, sf))


@query("batch_without_duplicates", over("embedded_messages", f", {_USER}, {_loop(0.3)} SELECT id FROM i WHERE i IN (FROM c)"))
def batch_dedup(spark, sf):
    return cl.without_duplicates(_message_vectors(Model(spark, sf)), 0.3).select("id")


_STANDARD = """
, x AS (SELECT id, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM embedded_entities WHERE embedding IS NOT NULL),
m AS (SELECT k, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS deviation FROM x GROUP BY 1),
v AS (SELECT id, list((x - mean) / deviation ORDER BY k) AS embedding FROM x JOIN m USING (k) GROUP BY 1)"""
_DENSITY = _STANDARD + f""",
n AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id WHERE round({cosine_sql('a.embedding', 'b.embedding')}, 6) >= 0.65),
core AS MATERIALIZED (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) + 1 >= 3),
inner_ AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (FROM core) AND b IN (FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, i.b FROM reach r JOIN inner_ i ON r.b = i.a),
named AS MATERIALIZED (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1),
labels AS MATERIALIZED (SELECT id, cluster, TRUE AS core FROM named UNION ALL
  SELECT a, min(cluster), FALSE FROM n JOIN named ON named.id = b WHERE a NOT IN (FROM core) GROUP BY 1)"""


@query("density_clusters", over("embedded_entities", _DENSITY + " SELECT v.id, cluster, coalesce(core, FALSE) AS core FROM v LEFT JOIN labels USING (id)"))
def density_clusters(spark, sf):
    return cl.density_clusters(cl.standardised(Model(spark, sf).embedded_entities().select("id", "embedding")), 0.35, 3)


@query("discovered_types", over("embedded_entities", _DENSITY + """,
w AS (SELECT cluster, generate_subscripts(embedding, 1) AS k, unnest(embedding::DOUBLE[]) AS x FROM embedded_entities JOIN labels USING (id)),
c AS (SELECT cluster, k, avg(x) AS x FROM w GROUP BY ALL)
SELECT cluster, size, weighed FROM (SELECT cluster, count(*) AS size FROM labels GROUP BY 1) JOIN (SELECT cluster, round(sum(x * k), 4) AS weighed FROM c GROUP BY 1) USING (cluster)"""))
def discovered_types(spark, sf):
    """Clusters of entities; their centroids shown by a weighted sum of the dimensions."""
    found = cl.discovered_types(Model(spark, sf).embedded_entities().select("id", "embedding"), 0.35, 3)
    weighed = F.round(F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b), 4)
    return found.select("cluster", "size", weighed.alias("weighed"))


_WORDS = ", ".join(f"'{w}'" for w in cl.NAME_STOP_WORDS)
_MARKS = cl.NAME_MARKS.replace("'", "''")


@query("pattern_clusters", over("embedded_items", f""", own AS (SELECT id, title, embedding FROM embedded_items WHERE status <> 'archived' AND len(embedding) > 0), {_loop(0.4, 'own')}, {_labels('', 'a')},
top AS MATERIALIZED (SELECT cluster, count(*) AS item_count FROM l GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10),
firsts AS (SELECT * FROM (SELECT cluster, title, row_number() OVER (PARTITION BY cluster ORDER BY l.id) AS place FROM l JOIN top USING (cluster) JOIN own ON own.id = l.id) WHERE place <= 5),
raw AS (SELECT cluster, place, generate_subscripts(t, 1) AS k, regexp_replace(unnest(t), '^{_MARKS}|{_MARKS}$', '', 'g') AS word FROM (SELECT *, regexp_split_to_array(lower(title), '\\s+') AS t FROM firsts)),
counts AS (SELECT cluster, word, count(*) AS n, min((place, k)) AS first, CASE WHEN regexp_matches(word, '^[1-9][0-9]{{0,8}}$') THEN word::BIGINT ELSE 4294967296 END AS number FROM raw
  WHERE length(word) > 3 AND word NOT IN ({_WORDS}) GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, number, first) AS r FROM counts),
names AS (SELECT cluster, string_agg(upper(word[1]) || word[2:], ' & ' ORDER BY r) AS words FROM ranked WHERE r <= 3 GROUP BY 1)
SELECT cluster, coalesce(words, CASE WHEN title <> '' THEN title[1:50] ELSE 'Unknown' END) AS name, item_count, floor(item_count / (SELECT count(*) FROM own) * 1000 + 0.5) / 10 AS percentage
FROM top JOIN (SELECT cluster, title FROM firsts WHERE place = 1) USING (cluster) LEFT JOIN names USING (cluster)"""))
def pattern_clusters(spark, sf):
    return cl.pattern_clusters(Model(spark, sf).embedded_items(), 0.4, 10)


@query("memory_library_gaps", over("embedded_messages embedded_items", f"""{_LEADERS}, own AS (SELECT id, embedding FROM embedded_items WHERE status <> 'archived' AND embedding IS NOT NULL), {_loop(0.4, 'own', '2')}, {_labels('2', 'similarity DESC, a')},
t AS (SELECT cluster AS id, count(*) AS size, {_BANDS} FROM l GROUP BY 1), big AS (SELECT cluster AS id FROM l2 GROUP BY 1 HAVING count(*) >= 2),
q AS (SELECT t.id, round(max({cosine_sql('x.embedding', 'y.embedding')}), 6) AS best FROM t JOIN v x ON x.id = t.id, big JOIN own y ON y.id = big.id GROUP BY 1)
SELECT t.id, size, band, CASE WHEN best >= 0.35 THEN best END AS best, coalesce(best >= 0.35, FALSE) AS covered,
  CASE WHEN coalesce(best >= 0.35, FALSE) THEN 'none' WHEN size >= 15 THEN 'high' WHEN size >= 8 THEN 'medium' ELSE 'low' END AS severity FROM t LEFT JOIN q USING (id)"""))
def memory_library_gaps(spark, sf):
    """Clusters of messages that no cluster of two library items or more covers."""
    m = Model(spark, sf)
    topics = cl.cluster_sizes(leader_clusters(spark, sf)).withColumnRenamed("cluster", "id")
    items = m.embedded_items().filter("status <> 'archived'").select("id", "embedding")
    library = cl.cluster_sizes(cl.leader_clusters(items, 0.4)).withColumnRenamed("cluster", "id")
    vectors = lambda df, v: df.join(v.select("id", "embedding"), "id")
    pairs = s.similar_pairs(vectors(topics, _message_vectors(m)), vectors(library.filter("size >= 2"), items), 0.35)
    return cl.coverage_of_clusters(topics, library, pairs)

"""Registered queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.text import title_from_slug
from threadloom.operators import graph as g
from threadloom.plans.model import RELATION_TYPES, Model, over
from threadloom.registry import query

_ENDS = ", ends AS (SELECT source_entity_id AS entity_id, 1 AS o, 0 AS i FROM relations UNION ALL SELECT target_entity_id, 0, 1 FROM relations), degrees AS (SELECT entity_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree FROM ends GROUP BY 1)"


@query("entity_degrees", over("relations", _ENDS + " SELECT * FROM degrees"))
def entity_degrees(spark, sf):
    return g.degrees(Model(spark, sf).relations())


@query("entity_relations", over("relations entities", """
, o AS (SELECT 'out' AS direction, target_entity_id AS other_id, relation_type, occurrence_count, r.id, canonical_name AS other_name, entity_type AS other_type
        FROM relations r JOIN entities e ON e.id = target_entity_id WHERE source_entity_id = 'e-3' ORDER BY occurrence_count DESC, r.id LIMIT 20),
i AS (SELECT 'in' AS direction, source_entity_id AS other_id, relation_type, occurrence_count, r.id, canonical_name AS other_name, entity_type AS other_type
      FROM relations r JOIN entities e ON e.id = source_entity_id WHERE target_entity_id = 'e-3' ORDER BY occurrence_count DESC, r.id LIMIT 20)
SELECT * FROM o UNION ALL SELECT * FROM i"""))
def entity_relations(spark, sf):
    m = Model(spark, sf)
    return g.entity_relations(m.relations(), m.entities(), "e-3")


def _patterns(direction: str, p: str, s: str, count: str) -> None:
    @query(f"problem_solution_patterns_{direction}", over("relations entities", f"""
SELECT a.id AS problem_id, a.canonical_name AS problem, b.id AS solution_id, b.canonical_name AS solution, b.entity_type AS solution_type, {count} AS occurrences,
       least({count} / 5, 1.0)::DOUBLE AS confidence
FROM relations r JOIN entities a ON a.id = r.{p} JOIN entities b ON b.id = r.{s}
WHERE relation_type = 'SOLVES' AND a.entity_type = 'problem' AND b.entity_type IN ('tool', 'pattern') GROUP BY ALL HAVING {count} >= 1"""))
    def patterns(spark, sf):
        m = Model(spark, sf)
        return g.problem_solution_patterns(m.relations(), m.entities(), 1, direction)


_patterns("as_coded", "source_entity_id", "target_entity_id", "count(*)")
_patterns("documented", "target_entity_id", "source_entity_id", "sum(occurrence_count)::BIGINT")


@query("missing_links", over("mentions relations entities", """
, d AS (SELECT DISTINCT message_id, entity_id FROM mentions),
t AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared FROM d x JOIN d y ON x.message_id = y.message_id AND x.entity_id < y.entity_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT t.a, t.b, shared, ea.canonical_name AS a_name, ea.entity_type AS a_type, eb.canonical_name AS b_name, eb.entity_type AS b_type,
  CASE WHEN (ea.entity_type = 'problem' AND eb.entity_type IN ('tool', 'pattern')) OR (eb.entity_type = 'problem' AND ea.entity_type IN ('tool', 'pattern')) THEN 'SOLVES'
       WHEN ea.entity_type = 'tool' AND eb.entity_type = 'tool' THEN 'USED_WITH' WHEN ea.entity_type = 'pattern' AND eb.entity_type = 'pattern' THEN 'USED_WITH'
       WHEN ea.entity_type = 'concept' AND eb.entity_type IN ('tool', 'pattern') THEN 'IMPLEMENTS' ELSE 'USED_WITH' END AS suggested_relation, least(shared / 10, 1.0)::DOUBLE AS confidence
FROM t JOIN entities ea ON ea.id = t.a JOIN entities eb ON eb.id = t.b
WHERE NOT EXISTS (SELECT 1 FROM relations r WHERE least(source_entity_id, target_entity_id) = t.a AND greatest(source_entity_id, target_entity_id) = t.b)
ORDER BY shared DESC, t.a, t.b LIMIT 500"""))
def missing_links(spark, sf):
    m = Model(spark, sf)
    return g.missing_links(m.mentions(), m.relations(), m.entities(), 2, 500)


@query("entity_clusters", over("relations entities", """
, c AS (SELECT x.source_entity_id AS a, y.source_entity_id AS b, count(DISTINCT x.target_entity_id) AS shared, least(count(DISTINCT x.target_entity_id) / 10, 1.0)::DOUBLE AS strength
FROM relations x JOIN relations y ON x.target_entity_id = y.target_entity_id AND x.source_entity_id < y.source_entity_id GROUP BY 1, 2 HAVING count(DISTINCT x.target_entity_id) >= 2
ORDER BY shared DESC, a, b LIMIT 200)
SELECT c.*, x.canonical_name AS a_name, y.canonical_name AS b_name FROM c LEFT JOIN entities x ON x.id = a LEFT JOIN entities y ON y.id = b"""))
def entity_clusters(spark, sf):
    m = Model(spark, sf)
    return g.neighbour_clusters(m.relations(), m.table("part").select(F.concat(F.lit("e-"), "p_partkey").alias("id"), F.col("p_name").alias("canonical_name")), 2, 200, about=m.table("lineitem").count())


_PATHS = """
, edges AS MATERIALIZED (SELECT source_entity_id AS s, target_entity_id AS t, id, relation_type FROM relations),
away(v, d) AS (SELECT 'e-22', 0 UNION SELECT s, d + 1 FROM away JOIN edges ON t = v WHERE d < 4),
near AS MATERIALIZED (SELECT v, min(d) AS d FROM away GROUP BY 1),
p(node, path, ids, types, depth) AS (
  SELECT 'e-60', ['e-60'], []::VARCHAR[], []::VARCHAR[], 0 UNION ALL
  SELECT t, list_append(path, t), list_append(ids, id), list_append(types, relation_type), depth + 1 FROM p JOIN edges ON s = node JOIN near ON v = t
  WHERE depth + d < 5 AND node <> 'e-22' AND NOT list_contains(path, t)),
paths AS (SELECT depth, array_to_string(path, ' > ') AS path, array_to_string(ids, ' > ') AS path_relations, array_to_string(types, ' > ') AS path_relation_types
  FROM p WHERE node = 'e-22' ORDER BY depth, path, path_relation_types, path_relations LIMIT 10)
"""


@query("entity_paths", over("relations", _PATHS + "SELECT * FROM paths"))
def entity_paths(spark, sf):
    return g.shortest_paths(Model(spark, sf).relations(), "e-60", "e-22", 5, 10)


@query("entity_paths_named", over("relations entities", _PATHS + """, s AS (SELECT depth, path, unnest(string_split(path, ' > ')) AS id, generate_subscripts(string_split(path, ' > '), 1) AS k FROM (SELECT DISTINCT depth, path FROM paths))
SELECT depth, path, string_agg(coalesce(canonical_name, 'Unknown'), ' > ' ORDER BY k) AS names FROM s LEFT JOIN entities USING (id) GROUP BY 1, 2"""))
def entity_paths_named(spark, sf):
    m = Model(spark, sf)
    return g.named_path(g.shortest_paths(m.relations(), "e-60", "e-22", 5, 10), m.entities())


_AROUND = """
, both_ways AS (SELECT source_entity_id AS s, target_entity_id AS t FROM relations UNION SELECT target_entity_id, source_entity_id FROM relations),
walk(id, depth) AS (SELECT 'e-3', 0 UNION SELECT t, depth + 1 FROM walk JOIN both_ways ON s = id WHERE depth < 2),
nodes AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1 ORDER BY depth, id LIMIT 60)
"""


@query("subgraph_nodes", over("relations", _AROUND + "SELECT * FROM nodes"))
def subgraph_nodes(spark, sf):
    return g.neighbourhood(Model(spark, sf).relations(), "e-3", 2, 60)


@query("subgraph_edges", over("relations", _AROUND + """
SELECT source_entity_id, target_entity_id, relation_type, sum(occurrence_count)::BIGINT AS occurrence_count, least(sum(occurrence_count), 10) / 10 AS strength
FROM relations WHERE source_entity_id IN (SELECT id FROM nodes) AND target_entity_id IN (SELECT id FROM nodes) GROUP BY 1, 2, 3"""))
def subgraph_edges(spark, sf):
    m = Model(spark, sf)
    return g.induced_edges(m.relations(), g.neighbourhood(m.relations(), "e-3", 2, 60))


_TOP = _ENDS + """, j AS (SELECT id, canonical_name, entity_type, mention_count, coalesce(degree, 0) AS degree FROM entities LEFT JOIN degrees ON entity_id = id),
top AS (SELECT *, round(0.4 * (mention_count / (SELECT max(mention_count) FROM j)) + 0.6 * (degree / (SELECT max(degree) FROM j)), 6) AS score, round(ln(mention_count + degree + 1), 6) AS node_size FROM j ORDER BY score DESC, id LIMIT 30)
"""


@query("top_entities_nodes", over("relations entities", _TOP + "SELECT * FROM top"))
def top_nodes(spark, sf):
    m = Model(spark, sf)
    return g.top_entities(m.entities(), m.relations(), 0.4, 30)


@query("top_entities_edges", over("relations entities", _TOP + """
SELECT source_entity_id, target_entity_id, relation_type, sum(occurrence_count)::BIGINT AS occurrence_count, least(sum(occurrence_count), 10) / 10 AS strength
FROM relations WHERE source_entity_id IN (SELECT id FROM top) AND target_entity_id IN (SELECT id FROM top) GROUP BY 1, 2, 3 ORDER BY occurrence_count DESC, 1, 2, 3 LIMIT 90"""))
def top_edges(spark, sf):
    m = Model(spark, sf)
    return g.induced_edges(m.relations(), g.top_entities(m.entities(), m.relations(), 0.4, 30), 90)


@query("relations_stats", over("relations", """
SELECT relation_type, count(*) AS edges, sum(occurrence_count)::BIGINT AS occurrences, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM relations GROUP BY 1"""))
def relations_stats(spark, sf):
    return g.relation_stats(Model(spark, sf).relations())


@query("relations_with_names", over("relations entities", """
SELECT r.id, relation_type, occurrence_count, coalesce(a.canonical_name, 'Unknown') AS source_name, coalesce(b.canonical_name, 'Unknown') AS target_name
FROM relations r LEFT JOIN entities a ON a.id = source_entity_id LEFT JOIN entities b ON b.id = target_entity_id WHERE relation_type = 'USED_WITH'"""))
def relations_with_names(spark, sf):
    m = Model(spark, sf)
    name = lambda c, n: m.entities().select(F.col("id").alias(c), F.col("canonical_name").alias(n))
    r = m.relations().filter("relation_type = 'USED_WITH'").join(name("source_entity_id", "source_name"), "source_entity_id", "left").join(name("target_entity_id", "target_name"), "target_entity_id", "left")
    return r.fillna("Unknown", ["source_name", "target_name"]).select("id", "relation_type", "occurrence_count", "source_name", "target_name")


for _band, _where in (("high", "confidence >= 0.8"), ("medium", "confidence >= 0.5 AND confidence < 0.8"), ("low", "confidence < 0.5")):

    def _register(band: str, where: str) -> None:
        @query(f"entities_{band}_confidence", over("entities", f"SELECT id, canonical_name, entity_type, confidence FROM entities WHERE {where}"))
        def banded(spark, sf):
            return g.by_confidence(Model(spark, sf).entities(), band).select("id", "canonical_name", "entity_type", "confidence")

    _register(_band, _where)


@query("graph_source_filter", over("relations entities", """
, n AS (SELECT id FROM entities WHERE source_type IN ('expert', 'both'))
SELECT source_entity_id, target_entity_id, relation_type, sum(occurrence_count)::BIGINT AS occurrence_count, least(sum(occurrence_count), 10) / 10 AS strength
FROM relations WHERE source_entity_id IN (FROM n) AND target_entity_id IN (FROM n) GROUP BY 1, 2, 3"""))
def graph_source_filter(spark, sf):
    m = Model(spark, sf)
    return g.induced_edges(m.relations(), g.filtered_by_source(m.entities(), "expert"))


@query("entity_search", over("entities", """
SELECT id, canonical_name, entity_type, mention_count FROM entities WHERE canonical_name ILIKE '%AN%' ORDER BY mention_count DESC, id LIMIT 50"""))
def entity_search(spark, sf):
    return Model(spark, sf).entities().filter(F.col("canonical_name").ilike("%AN%")).orderBy(F.desc("mention_count"), "id").limit(50).select("id", "canonical_name", "entity_type", "mention_count")


@query("latest_messages", over("messages", "SELECT chat_id, message_id, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts_ms DESC, message_id) AS r FROM messages) WHERE r = 1"))
def latest_messages(spark, sf):
    """The latest message of each chat."""
    return g.latest_per_key(Model(spark, sf).messages(), "chat_id", [F.desc("ts_ms"), F.asc("message_id")]).select("chat_id", "message_id", "ts_ms")


_SYNONYMS = {"SOLVED_BY": "SOLVES", "USES": "USED_WITH"}


@query("normalised_relations", over("relations", """
, raw AS (SELECT id, trim(source_entity_id) AS subject, trim(target_entity_id) AS object, upper(regexp_replace(trim(CASE relation_type WHEN 'SOLVES' THEN 'solved by' WHEN 'CAUSES' THEN ' Uses ' ELSE lower(replace(relation_type, '_', '-')) END), '[\\s-]+', '_', 'g')) AS p,
  CASE WHEN confidence <> 0.5 THEN confidence * 2 - 0.3 END AS c FROM relations)
SELECT subject, CASE p WHEN 'SOLVED_BY' THEN 'SOLVES' WHEN 'USES' THEN 'USED_WITH' ELSE p END AS predicate, object, least(greatest(coalesce(c, 0.5), 0.0), 1.0)::DOUBLE AS confidence
FROM raw WHERE subject <> 'e-1' AND object <> 'e-1' AND p NOT IN ('REQUIRES')"""))
def normalised_relations(spark, sf):
    """Relations as an extraction may spell them, with known predicates."""
    kind = F.col("relation_type")
    spelt = F.when(kind == "SOLVES", "solved by").when(kind == "CAUSES", " Uses ").otherwise(F.lower(F.replace(kind, F.lit("_"), F.lit("-"))))
    raw = Model(spark, sf).relations().select(F.col("source_entity_id").alias("subject"), spelt.alias("predicate"), F.concat(F.lit(" "), "target_entity_id").alias("object"), F.when(F.col("confidence") != 0.5, F.col("confidence") * 2 - 0.3).alias("confidence"))
    known = tuple(t for t in RELATION_TYPES if t not in ("REQUIRES", "CAUSES"))
    return g.normalised_relations(raw, _SYNONYMS, known, ("e-1",))


@query("episode_titles", over("episodes", "SELECT entity_id, array_to_string(list_transform(string_split(slug, '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM episodes"))
def episode_titles(spark, sf):
    """Titles of episodes from their slugs."""
    return Model(spark, sf).episodes().select("entity_id", title_from_slug(F.col("slug")).alias("title"))

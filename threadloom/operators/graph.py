"""The entity graph: degrees, neighbourhoods, paths, patterns and missing links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.rounds import written


def degrees(relations: DataFrame) -> DataFrame:
    """Entities with their edges out, in and together; self-loops count on both sides."""
    ends = relations.select(F.col("source_entity_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        relations.select(F.col("target_entity_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    out = ends.groupBy("entity_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return out.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def entity_relations(relations: DataFrame, entities: DataFrame, entity_id: str, limit: int = 20) -> DataFrame:
    """The strongest edges out of and into an entity, with the other end's name."""
    name = entities.select(F.col("id").alias("other_id"), F.col("canonical_name").alias("other_name"), F.col("entity_type").alias("other_type"))

    def side(direction: str, own: str, other: str) -> DataFrame:
        some = relations.filter(F.col(own) == entity_id).select(F.lit(direction).alias("direction"), F.col(other).alias("other_id"), "relation_type", "occurrence_count", "id")
        return some.join(name, "other_id").orderBy(F.desc("occurrence_count"), "id").limit(limit)

    return side("out", "source_entity_id", "target_entity_id").unionAll(side("in", "target_entity_id", "source_entity_id"))


def problem_solution_patterns(relations: DataFrame, entities: DataFrame, least: int = 2, direction: str = "as_coded", limit: int | None = None) -> DataFrame:
    """Problems and the tools or patterns that SOLVES edges join, seen often enough.

    direction: 'as_coded' takes edges from the problem to its solution, 'documented' from
    the solution to the problem.
    """
    p, s = ("source_entity_id", "target_entity_id") if direction == "as_coded" else ("target_entity_id", "source_entity_id")
    problems = entities.filter("entity_type = 'problem'").select(F.col("id").alias("problem_id"), F.col("canonical_name").alias("problem"))
    cures = entities.filter(F.col("entity_type").isin("tool", "pattern")).select(F.col("id").alias("solution_id"), F.col("canonical_name").alias("solution"), F.col("entity_type").alias("solution_type"))
    # as coded, edges are counted; as documented, their occurrences are
    count = F.count("*") if direction == "as_coded" else F.sum("occurrence_count")
    edges = relations.filter("relation_type = 'SOLVES'").select(F.col(p).alias("problem_id"), F.col(s).alias("solution_id"), "occurrence_count")
    out = edges.join(problems, "problem_id").join(cures, "solution_id").groupBy("problem_id", "problem", "solution_id", "solution", "solution_type").agg(count.alias("occurrences"))
    out = out.filter(F.col("occurrences") >= least).withColumn("confidence", F.least(F.col("occurrences") / 5, F.lit(1.0)))
    return out if limit is None else out.orderBy(F.desc("occurrences"), "problem_id", "solution_id").limit(limit)


#: Rows of a task that pairs up members of groups, about.
PAIRED_ROWS = 500_000


def shared_pairs(rows: DataFrame, group: str, member: str, least: int, block: int = 512, about: int | None = None) -> DataFrame:
    """Pairs (a < b) of members that occur together in at least so many groups: (a, b, shared).

    A group of more than ``block`` members is dealt by pairs of blocks (i <= j): each member
    goes to as many cells as its group has blocks, and no task gets more than two blocks of
    one group. Smaller groups are one cell. Tasks grow in number with the rows, not in
    size; ``about``: how many rows there are at most, where a count is dear.
    """
    seen = rows.filter(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("g"), F.col(member).alias("m")).distinct()
    large = seen.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = seen.join(large, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("m"), F.col("blocks")).cast("int"))
    left = dealt.select("g", F.col("m").alias("x"), F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)).alias("j"))
    right = dealt.select("g", F.col("m").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"))
    # the number is given, as small partitions would be joined to tasks of many rows by their compressed size
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows.count() if about is None else about) // PAIRED_ROWS))
    left, right = (d.repartition(tasks, "g", "i", "j") for d in (left, right))
    pairs = left.join(right, ["g", "i", "j"]).filter("i < j or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def missing_links(mentions: DataFrame, relations: DataFrame, entities: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    """Entities mentioned together in enough messages that no edge joins, with a suggested relation."""
    together = shared_pairs(mentions, "message_id", "entity_id", least)
    joined = relations.select(F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b")).distinct()
    kind = lambda c: entities.select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"), F.col("entity_type").alias(f"{c}_type"))
    ta, tb = F.col("a_type"), F.col("b_type")
    suggest = (
        F.when((ta == "problem") & tb.isin("tool", "pattern") | (tb == "problem") & ta.isin("tool", "pattern"), "SOLVES")
        .when((ta == "concept") & tb.isin("tool", "pattern"), "IMPLEMENTS")
        .otherwise("USED_WITH")
    )
    out = together.join(joined, ["a", "b"], "left_anti").join(kind("a"), "a").join(kind("b"), "b")
    out = out.withColumns({"suggested_relation": suggest, "confidence": F.least(F.col("shared") / 10, F.lit(1.0))})
    return out.orderBy(F.desc("shared"), "a", "b").limit(limit)


def neighbour_clusters(relations: DataFrame, entities: DataFrame, least: int = 2, limit: int = 20, about: int | None = None) -> DataFrame:
    """Pairs of entities that point at enough common targets, with their names, and how strongly. ``about``: as many relations at most, if known."""
    out = shared_pairs(relations, "target_entity_id", "source_entity_id", least, about=about).withColumn("strength", F.least(F.col("shared") / 10, F.lit(1.0))).orderBy(F.desc("shared"), "a", "b").limit(limit)
    name = lambda c: entities.select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
    return out.join(name("a"), "a", "left").join(name("b"), "b", "left")


def shortest_paths(relations: DataFrame, source: str, target: str, max_depth: int = 5, limit: int = 10) -> DataFrame:
    """The shortest directed paths between two entities that visit none twice: (depth, path, path_relations, path_relation_types).

    Paths that differ in an edge only are different paths. Ties go by the path, its types and
    its edges. The edges are written once. Rings of entities around the target, each with its
    least distance, grow until they meet the source; paths then start from the source and
    follow only edges on which the target can still be reached in the steps left. The bound
    on the depth grows only while there are fewer paths than asked for, so that longer ones
    are never expanded in vain.
    """
    spark = relations.sparkSession
    edges = written(relations.filter("source_entity_id <> target_entity_id").select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t"), F.col("id").alias("edge"), "relation_type"))
    ring = near = spark.range(1).select(F.lit(target).alias("v"), F.lit(0).alias("d"))
    found, met = None, False
    for depth in range(1, max_depth + 1 if source != target else 1):
        ring = edges.join(ring.select(F.col("v").alias("t")), "t", "left_semi").select(F.col("s").alias("v")).distinct().join(near, "v", "left_anti")
        ring = written(ring.withColumn("d", F.lit(depth)))
        near = near.union(ring)
        met = met or not ring.filter(F.col("v") == source).isEmpty()
        if met:
            found = written(_paths_within(edges, near, source, target, depth).orderBy("depth", "path", "path_relation_types", "path_relations").limit(limit))
            if found.count() >= limit:
                break
        elif ring.isEmpty():
            break
    if found is None:
        return spark.createDataFrame([], "depth int, path string, path_relations string, path_relation_types string")
    return found


def _paths_within(edges: DataFrame, near: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    none = F.array().cast("array<string>")
    paths = edges.sparkSession.range(1).select(F.lit(source).alias("at"), F.array(F.lit(source)).alias("path"), none.alias("edges"), none.alias("types"))
    found = None
    for step in range(1, depth + 1):
        able = near.filter(F.col("d") <= depth - step).select(F.col("v").alias("t"))
        paths = paths.join(edges.withColumnRenamed("s", "at"), "at").join(able, "t", "left_semi").filter(~F.array_contains("path", F.col("t")))
        paths = paths.select(F.col("t").alias("at"), F.array_append("path", F.col("t")).alias("path"), F.array_append("edges", F.col("edge")).alias("edges"), F.array_append("types", F.col("relation_type")).alias("types"))
        done = paths.filter(F.col("at") == target).select(F.lit(step).alias("depth"), F.array_join("path", " > ").alias("path"), F.array_join("edges", " > ").alias("path_relations"), F.array_join("types", " > ").alias("path_relation_types"))
        found = done if found is None else found.union(done)
        paths = paths.filter(F.col("at") != target)
    return found


def named_path(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Paths with their entities' names in order."""
    steps = paths.select("depth", "path").distinct().select("depth", "path", F.posexplode(F.split("path", " > ")).alias("at", "id"))
    named = steps.join(entities.select("id", "canonical_name"), "id", "left")
    return named.groupBy("depth", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical_name", F.lit("Unknown")).alias("x")))), lambda x: x["x"]), " > ").alias("names"))


def neighbourhood(relations: DataFrame, centre: str, depth: int = 2, limit: int = 200) -> DataFrame:
    """Entities within so many undirected steps of a centre, nearest first, and at most ``limit`` of them."""
    both = relations.select(F.col("source_entity_id").alias("s"), F.col("target_entity_id").alias("t")).unionAll(relations.select(F.col("target_entity_id").alias("s"), F.col("source_entity_id").alias("t"))).distinct()
    seen = relations.sparkSession.range(1).select(F.lit(centre).alias("id"), F.lit(0).alias("depth"))
    ring = seen
    for d in range(1, depth + 1):
        ring = both.join(ring.select(F.col("id").alias("s")), "s").select(F.col("t").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionAll(ring)
    return seen.orderBy("depth", "id").limit(limit)


def induced_edges(relations: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with both ends among the nodes; one a pair and type, with strength from 0 to 1."""
    ids = nodes.select("id")
    own = relations.join(ids.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_semi")
    out = own.groupBy("source_entity_id", "target_entity_id", "relation_type").agg(F.sum("occurrence_count").alias("occurrence_count"))
    out = out.withColumn("strength", F.least("occurrence_count", F.lit(10)) / 10)
    return out if limit is None else out.orderBy(F.desc("occurrence_count"), "source_entity_id", "target_entity_id", "relation_type").limit(limit)


def top_entities(entities: DataFrame, relations: DataFrame, weight: float = 0.5, limit: int = 30) -> DataFrame:
    """Entities by a mix of their mentions and their degree, each over its maximum."""
    joined = entities.select("id", "canonical_name", "entity_type", "mention_count").join(degrees(relations).select(F.col("entity_id").alias("id"), "degree"), "id", "left").fillna(0, ["degree"])
    most = joined.agg(F.max("mention_count").alias("_m"), F.max("degree").alias("_d"))
    share = lambda c, top: F.when(F.col(top) > 0, F.col(c) / F.col(top)).otherwise(0.0)
    scored = joined.crossJoin(F.broadcast(most)).withColumn("score", F.round(F.lit(weight) * share("mention_count", "_m") + F.lit(1 - weight) * share("degree", "_d"), 6))
    size = F.round(F.log(F.col("mention_count") + F.col("degree") + 1), 6)
    return scored.withColumn("node_size", size).drop("_m", "_d").orderBy(F.desc("score"), "id").limit(limit)


def relation_stats(relations: DataFrame) -> DataFrame:
    """Edges, occurrences and up to three example ids by type."""
    return relations.groupBy("relation_type").agg(
        F.count("*").alias("edges"), F.sum("occurrence_count").alias("occurrences"), F.array_join(F.slice(F.array_sort(F.collect_set("id")), 1, 3), ",").alias("examples")
    )


def by_confidence(df: DataFrame, band: str, col: str = "confidence") -> DataFrame:
    """Rows of high (0.8 and up), medium (0.5 and up) or low confidence."""
    c = F.col(col)
    return df.filter({"high": c >= 0.8, "medium": (c >= 0.5) & (c < 0.8), "low": c < 0.5}[band])


def filtered_by_source(nodes: DataFrame, source: str) -> DataFrame:
    """Nodes of a source; those of both belong to either."""
    return nodes.filter(F.col("source_type").isin(source, "both"))


def normalised_relations(raw: DataFrame, synonyms: dict[str, str], known: tuple[str, ...], skip: tuple[str, ...] = ()) -> DataFrame:
    """Extracted (subject, predicate, object, confidence) with known predicates; self-loops, blanks, skipped names and unknown predicates go."""
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv]) if synonyms else F.create_map()
    predicate = F.upper(F.regexp_replace(F.trim("predicate"), r"[\s-]+", "_"))
    subject, object_ = F.trim("subject"), F.trim("object")
    out = raw.select(subject.alias("subject"), F.coalesce(F.try_element_at(table, predicate), predicate).alias("predicate"), object_.alias("object"), F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    good: Column = (F.col("subject") != "") & (F.col("object") != "") & (F.lower("subject") != F.lower("object")) & F.col("predicate").isin(*known)
    return out.filter(good & ~F.lower("subject").isin(*skip) & ~F.lower("object").isin(*skip))


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")

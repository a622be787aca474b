"""The knowledge graph's tables: statistics by source, attribution, conversations, episodes and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import expert_slug
from threadloom.operators.rounds import components, written


def graph_stats(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(metric, value): totals and entities by type."""
    totals = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("value")) for name, df in (("entities", entities), ("mentions", mentions), ("relations", relations))]
    by = entities.groupBy(F.concat(F.lit("type:"), "entity_type").alias("metric")).agg(F.count("*").alias("value"))
    return totals[0].unionAll(totals[1]).unionAll(totals[2]).unionAll(by)


def stats_for_source(entities: DataFrame, mentions: DataFrame, relations: DataFrame, source: str) -> DataFrame:
    """(metric, value) for 'user', 'expert' or 'both': totals, and entities by type.

    Entities count by their source type alone. A mention or relation counts for a user by its
    own source or that of an entity that it joins to; for an expert likewise (an unknown
    source is an expert's), but not by an entity if its own source is the user; for both
    if an entity that it joins to is of both.
    """
    own = entities.filter(F.col("source_type") == source)
    ids = own.select("id", F.lit(True).alias("_own"))
    known = entities.select("id", (F.col("source_type") == source).alias("_own"))
    given = {"user": F.col("source") == "user", "expert": F.col("source").isin("expert", "unknown"), "both": F.lit(False)}[source]
    by_entity = F.coalesce(F.col("source") != "user", F.lit(True)) if source == "expert" else F.lit(True)
    flagged = mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left")
    ends = relations.join(known.select(F.col("id").alias("source_entity_id"), F.col("_own").alias("_a")), "source_entity_id", "left").join(known.select(F.col("id").alias("target_entity_id"), F.col("_own").alias("_b")), "target_entity_id", "left")
    joined = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") | F.col("_b"))
    rows = {"entities": own, "mentions": flagged.filter(given | F.col("_own") & by_entity), "relations": ends.filter(given | joined & by_entity)}
    totals = [df.agg(F.lit(name).alias("metric"), F.count("*").alias("value")) for name, df in rows.items()]
    by = own.groupBy(F.concat(F.lit("type:"), "entity_type").alias("metric")).agg(F.count("*").alias("value"))
    return totals[0].unionAll(totals[1]).unionAll(totals[2]).unionAll(by)


def stats_by_source(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct entities, mentions and relations of each source."""
    m = mentions.groupBy("source").agg(F.countDistinct("entity_id").alias("entities"), F.count("*").alias("mentions"))
    r = relations.groupBy("source").agg(F.count("*").alias("relations"))
    return m.join(r, "source", "left").fillna(0, ["relations"])


def message_source_stats(messages: DataFrame) -> DataFrame:
    """Distinct chats and messages of each source, with the first and last time."""
    return messages.groupBy("source").agg(F.countDistinct("chat_id").alias("chats"), F.count("*").alias("messages"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def attributed(mentions: DataFrame) -> DataFrame:
    """Each entity's source by its mentions: expert, user or both."""
    expert = F.col("message_id").startswith("expert-")
    flags = mentions.groupBy("entity_id").agg(F.bool_or(expert).alias("e"), F.bool_or(~expert).alias("u"))
    return flags.select("entity_id", F.when(F.col("e") & F.col("u"), "both").when(F.col("e"), "expert").otherwise("user").alias("source_type"))


def episode_quality(expert_mentions: DataFrame, episodes: DataFrame, least_chunks: int = 167) -> DataFrame:
    """Indexed chunks of each episode against an estimate of all its chunks (three times the indexed ones, at least so many), in per cent.

    Episodes without mentions and slugs without an episode are both kept.
    """
    found = expert_mentions.withColumn("slug", expert_slug(F.col("message_id"))).filter("slug is not null").groupBy("slug").agg(F.countDistinct("message_id").alias("chunks"))
    out = episodes.select("slug", "guest_name").join(found, "slug", "full").fillna(0, ["chunks"])
    total = F.greatest(F.col("chunks") * 3, F.lit(least_chunks))
    return out.select("slug", F.coalesce("guest_name", F.initcap(F.replace("slug", F.lit("-"), F.lit(" ")))).alias("guest_name"), "chunks", total.alias("total_chunks"), F.round(F.col("chunks") * 100 / total, 1).alias("percent"))


def mention_sources(expert_mentions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Mentions with their episode where the message id names one."""
    meta = episodes.select("slug", "guest_name", "published_date")
    return expert_mentions.withColumn("slug", expert_slug(F.col("message_id"))).join(meta, "slug", "left").select("id", "entity_id", "message_id", "guest_name", "published_date")


def conversations_between(conversations: DataFrame, first: str, last: str, source: str | None = None) -> DataFrame:
    """Conversations whose day, or month where no day is known, lies in a range."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    inside = F.col("date_day").between(a, b) | F.col("date_day").isNull() & F.col("date_month").between(F.trunc(a, "month"), b)
    return conversations.filter(inside if source is None else inside & (F.col("source_type") == source))


def earliest_dates(mentions: DataFrame, conversations: DataFrame) -> DataFrame:
    """The earliest date of the conversations that mention each entity."""
    dated = conversations.select(F.col("conversation_id").alias("message_id"), F.coalesce("date_day", "date_month").alias("d"))
    return mentions.select("entity_id", "message_id").join(dated, "message_id").groupBy("entity_id").agg(F.min("d").alias("earliest"))


def with_breakdown(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with user and expert mentions counted, and the source type that these imply."""
    by = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count_if(F.col("source") == "user").alias("user"), F.count_if(F.col("source") == "expert").alias("expert"))
    out = entities.select("id", "canonical_name").join(by, "id", "left").fillna(0, ["user", "expert"])
    kind = F.when((F.col("user") > 0) & (F.col("expert") > 0), "both").when(F.col("expert") > 0, "expert").otherwise("user")
    return out.withColumn("source_type", kind)


def closed_mapping(mapping: DataFrame) -> DataFrame:
    """A (source_id, target_id) mapping with every source sent to the end of its chain.

    Pointers are doubled until none moves, so rounds are logarithmic in the longest chain.
    A source given several targets takes the least; sources whose chain runs into a ring are
    all sent to the least id that the ring's entries name.
    """
    given = written(mapping.filter("source_id <> target_id").groupBy("source_id").agg(F.min("target_id").alias("target_id")))
    ends = given.select(F.col("target_id").alias("id")).join(given.select(F.col("source_id").alias("id")), "id", "left_anti")
    parts = written(components(given.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))))
    ringed = written(parts.join(parts.join(ends, "id", "left_semi").select("component").distinct(), "component", "left_anti"))
    now = given.join(ringed.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    moving = True
    while moving:
        two = now.alias("x").join(now.alias("y"), F.expr("x.target_id = y.source_id"), "left")
        step = written(two.select("x.source_id", F.coalesce("y.target_id", "x.target_id").alias("target_id"), F.col("y.target_id").isNotNull().alias("moved")))
        now, moving = step.select("source_id", "target_id"), not step.filter("moved").isEmpty()
    return now.union(ringed.filter("id <> component").select("id", "component"))


def merged_entities(entities: DataFrame, mentions: DataFrame, relations: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after entities are merged by a (source_id, target_id) mapping; chains end in one call.

    Targets take the sources' aliases and names and their mention counts; mentions and both
    ends of relations are moved, and relations that then agree in ends, type and message
    become one: the least id, with all occurrences and the greatest confidence. Sources go.
    """
    mapping = written(closed_mapping(mapping))
    to = lambda c: mapping.select(F.col("source_id").alias(c), F.col("target_id").alias(f"_{c}"))
    moved = lambda df, c: df.join(to(c), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    given = entities.join(mapping.withColumnRenamed("source_id", "id"), "id").groupBy("target_id").agg(
        F.sum("mention_count").alias("_more"), F.flatten(F.collect_list(F.array_append("aliases", F.col("canonical_name")))).alias("_names")
    )
    rest = entities.join(mapping.select(F.col("source_id").alias("id")), "id", "left_anti").join(given.withColumnRenamed("target_id", "id"), "id", "left")
    rest = rest.withColumns({"mention_count": F.col("mention_count") + F.coalesce("_more", F.lit(0)), "aliases": F.array_sort(F.array_union("aliases", F.coalesce("_names", F.array().cast("array<string>"))))}).drop("_more", "_names")
    ends = moved(moved(relations, "source_entity_id"), "target_entity_id")
    key = ["source_entity_id", "target_entity_id", "relation_type", "message_id"]
    summed = {"occurrence_count": F.sum("occurrence_count"), "confidence": F.max("confidence")}
    others = [c for c in relations.columns if c not in key and c not in summed]
    folded = ends.groupBy(*key).agg(F.min_by(F.struct(*others), "id").alias("_first"), *[f.alias(c) for c, f in summed.items()])
    return rest, moved(mentions, "entity_id"), folded.select(*[F.col(f"_first.{c}") if c in others else F.col(c) for c in relations.columns])


def no_relations(spark: SparkSession) -> DataFrame:
    """An empty table of saved relations, known to be empty when a query is planned."""
    kinds = "id string, source_entity_id string, target_entity_id string, relation_type string, message_id string, evidence string, message_timestamp long, confidence double, occurrence_count long, first_seen long, last_seen long"
    return spark.range(1).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in kinds.split(", "))]).filter(F.lit(False))


def no_mentions(spark: SparkSession) -> DataFrame:
    """An empty table of saved mentions."""
    return spark.createDataFrame([], "id string, entity_id string, message_id string, context string, message_timestamp long")


RELATION_KEY = ["source_entity_id", "target_entity_id", "relation_type", "message_id"]


def saved_relations(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored relations with newly seen ones merged in by ends, type and message, null messages being equal.

    ``seen``: the key's columns, evidence, message_timestamp, confidence, seen_at. Each row
    adds one occurrence; a known relation keeps what it was first saved with and takes the
    latest ``seen_at`` as last_seen; a new one takes evidence (500 characters), timestamp and
    confidence (0.8 if none) of the row seen first, and its id from its key. Rows of both
    tables go into one grouping on the key, so that no relation is looked up by itself and
    none is sent twice. Where both are dealt by some of the key already, to equally many
    tasks, rows are grouped where they lie.
    """
    fields = ["id", *RELATION_KEY, "evidence", "message_timestamp", "confidence", "occurrence_count", "first_seen", "last_seen"]
    own = F.concat(F.lit("r-"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in RELATION_KEY]), 256), 1, 16))
    # an id that its key gives is made again, not sent
    kept = stored.select(*fields, F.lit(0).alias("_new"), F.col("id").eqNullSafe(own).alias("_own")).withColumn("id", F.when(~F.col("_own"), F.col("id")))
    new = seen.select(*RELATION_KEY, "evidence", "message_timestamp", "confidence", F.lit(1).cast("long").alias("occurrence_count"), F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
    both = kept.unionByName(new.withColumns({"id": F.lit(None).cast("string"), "_new": F.lit(1), "_own": F.lit(True)}))
    # stored rows before new ones, those by when they were seen
    first = F.min(F.struct("_new", "first_seen", "evidence", "message_timestamp", "confidence", "_own", "id")).alias("f")
    out = both.groupBy(*RELATION_KEY).agg(first, F.sum("occurrence_count").alias("occurrence_count"), F.max("last_seen").alias("last_seen"))
    is_new = F.col("f._new") == 1
    made = {
        "id": F.when(F.col("f._own"), own).otherwise(F.col("f.id")),
        "evidence": F.when(is_new, F.substring("f.evidence", 1, 500)).otherwise(F.col("f.evidence")),
        "confidence": F.when(is_new, F.coalesce("f.confidence", F.lit(0.8))).otherwise(F.col("f.confidence")),
        "message_timestamp": F.col("f.message_timestamp"),
        "first_seen": F.col("f.first_seen"),
    }
    return out.select(*[made[c].alias(c) if c in made else F.col(c) for c in fields])


def saved_mentions(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored mentions and newly seen ones (entity_id, message_id, context, message_timestamp), one an entity and message.

    Messages that hold a stored mention have been read before and add nothing; contexts are cut at 500 characters.
    """
    fresh = seen.join(stored.select("message_id").distinct(), "message_id", "left_anti")
    one = fresh.groupBy("entity_id", "message_id").agg(F.min(F.struct("message_timestamp", "context")).alias("f"))
    key = F.concat_ws("|", "entity_id", "message_id")
    new = one.select(F.concat(F.lit("m-"), F.substring(F.sha2(key, 256), 1, 16)).alias("id"), "entity_id", "message_id", F.substring("f.context", 1, 500).alias("context"), "f.message_timestamp")
    return stored.select(*new.columns).unionByName(new)


def resolved_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """For each extracted (name, entity_type): the entity by its name, else by an alias, else none. Least id on ties."""
    key = names.select("name", "entity_type", F.lower(F.trim("name")).alias("_k")).distinct()
    by_name = entities.groupBy(F.lower("canonical_name").alias("_k")).agg(F.min("id").alias("_by_name"))
    by_alias = entities.select("id", F.explode("aliases").alias("_a")).groupBy(F.lower("_a").alias("_k")).agg(F.min("id").alias("_by_alias"))
    out = key.join(by_name, "_k", "left").join(by_alias, "_k", "left")
    how = F.when(F.col("_by_name").isNotNull(), "name").when(F.col("_by_alias").isNotNull(), "alias").otherwise("new")
    return out.select("name", "entity_type", F.coalesce("_by_name", "_by_alias").alias("entity_id"), how.alias("matched_by"))


def orphan_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")


def without_source(entities: DataFrame, mentions: DataFrame, relations: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after all of one source is deleted: its mentions and relations, and entities that nothing mentions any more."""
    left = mentions.filter(F.col("source") != source)
    alive = left.select(F.col("entity_id").alias("id")).distinct()
    rest = entities.join(alive, "id", "left_semi")
    ends = lambda c: rest.select(F.col("id").alias(c))
    kept = relations.filter(F.col("source") != source).join(ends("source_entity_id"), "source_entity_id", "left_semi").join(ends("target_entity_id"), "target_entity_id", "left_semi")
    return rest, left, kept


def export_closure(mentions: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that exported mentions or relations refer to."""
    ids = mentions.select(F.col("entity_id").alias("id")).unionAll(relations.select(F.col("source_entity_id").alias("id"))).unionAll(relations.select(F.col("target_entity_id").alias("id"))).distinct()
    return entities.join(ids, "id", "left_semi")


def episode_edges(mentions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """New REFERENCES_EPISODE edges from an episode to each conversation about it, one a message.

    Message ids hold the episode's slug; both ends must be entities, and edges that are there
    already are left out.
    """
    found = mentions.select("message_id", expert_slug(F.col("message_id")).alias("slug")).filter("slug is not null").distinct()
    edges = found.select(F.concat(F.lit("episode-"), "slug").alias("source_entity_id"), F.concat(F.lit("conv-"), "message_id").alias("target_entity_id"), F.col("message_id").alias("source_message_id"))
    for end in ("source_entity_id", "target_entity_id"):
        edges = edges.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    there = relations.filter("relation_type = 'REFERENCES_EPISODE'").select("source_entity_id", "target_entity_id")
    new = edges.join(there, ["source_entity_id", "target_entity_id"], "left_anti")
    return new.select("source_entity_id", "target_entity_id", F.lit("REFERENCES_EPISODE").alias("relation_type"), "source_message_id", F.lit(1).cast("long").alias("occurrence_count"))


def node_dates(conversations: DataFrame, episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, date, kind) of all nodes of the graph that have a date; an entity's goes before an episode's, that before a conversation's of the same id.

    Conversations by their day, else their month, episodes by their publication, entities by
    the earliest conversation that mentions them.
    """
    dated = conversations.select("id", F.coalesce("date_day", "date_month").alias("date"), F.lit("conversation").alias("kind"), F.lit(0).alias("place"))
    published = episodes.select(F.concat(F.lit("episode-"), "slug").alias("id"), F.col("published_date").alias("date"), F.lit("episode").alias("kind"), F.lit(1).alias("place"))
    named = earliest_dates(mentions, conversations).select(F.col("entity_id").alias("id"), F.col("earliest").alias("date"), F.lit("entity").alias("kind"), F.lit(2).alias("place"))
    every = dated.unionAll(published).unionAll(named).filter("id is not null and date is not null")
    # of rows with one id and kind, the earliest
    return every.groupBy("id").agg(F.min_by(F.struct("date", "kind"), F.struct(-F.col("place"), F.col("date"))).alias("n")).select("id", "n.*")


def recent_mentions(entities: DataFrame, mentions: DataFrame, k: int = 20) -> DataFrame:
    """Entities with each of their k latest mentions (mention_id, message_id, ts_ms, rank), nulls where they have none.

    Undated mentions come first, as the latest, ties go by id. Tasks keep k rows an entity
    before any are sent.
    """
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc_nulls_first("ts_ms"), "id"))
    latest = mentions.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("entity_id").alias("id"), F.col("id").alias("mention_id"), "message_id", "ts_ms", "rank")
    shown = entities.select("id", "canonical_name", "entity_type", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return shown.join(latest, "id", "left")


def entities_by_source(entities: DataFrame, source: str | None = None, least: int = 1, limit: int | None = 100) -> DataFrame:
    """Entities of exactly one source type, or all, with at least so many mentions; those mentioned most first, ties by id."""
    some = entities.filter((F.col("mention_count") >= least) & (F.lit(True) if source is None else F.col("source_type") == source))
    out = some.select("id", "canonical_name", "entity_type", "source_type", "mention_count", F.coalesce("user_count", F.lit(0)).alias("user_mentions"), F.coalesce("expert_count", F.lit(0)).alias("expert_mentions"), "first_seen", "last_seen")
    return out if limit is None else out.orderBy(F.desc("mention_count"), "id").limit(limit)


def conversation_episodes(relations: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """(conversation_id, episode_id, guest_name, relation_type): the episodes that each conversation refers to.

    Edges lead from an episode to a conversation; their source must be an entity of type
    episode, whose id holds the slug of an episode that is known.
    """
    edges = relations.filter("relation_type = 'REFERENCES_EPISODE' and target_entity_id like 'conv-%'")
    known = entities.filter("entity_type = 'episode'").select(F.col("id").alias("source_entity_id"))
    own = edges.join(known, "source_entity_id").withColumn("slug", F.nullif(F.regexp_extract("source_entity_id", "episode-(.+)$", 1), F.lit("")))
    named = own.join(episodes.select("slug", "guest_name"), "slug")
    return named.select(F.expr("substring(target_entity_id, 6)").alias("conversation_id"), F.col("source_entity_id").alias("episode_id"), "guest_name", "relation_type")

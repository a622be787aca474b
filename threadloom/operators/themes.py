"""Themes over library items and conversations together, their names, and topics that the library lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import capital
from threadloom.operators.cluster import leader_clusters
from threadloom.operators.rounds import written
from threadloom.operators.similarity import mean_vectors


def conversation_topics(messages: DataFrame, least: int = 3) -> DataFrame:
    """Chats with at least ``least`` user messages, each shown by its first user message that has an embedding.

    (chat_id, workspace, chat_type, text, embedding, ts_ms, message_count). Messages without
    a chat don't count, chats without an embedding are left out; ties in time go by message_id.
    """
    own = messages.filter("message_type = 'user' and chat_id <> ''")
    shown = F.struct("workspace", "chat_type", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("text"), "embedding", "ts_ms")
    first = F.min_by(F.when(F.size("embedding") > 0, shown), F.when(F.size("embedding") > 0, F.struct("ts_ms", "message_id")))
    chats = own.groupBy("chat_id").agg(first.alias("first"), F.count("*").alias("message_count"))
    return chats.filter(F.col("first").isNotNull() & (F.col("message_count") >= least)).select("chat_id", "first.*", "message_count")


def _dotted(text: Column, n: int) -> Column:
    """At most n characters, the last three of them dots where something is cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def conversation_items(messages: DataFrame) -> DataFrame:
    """Conversations as items: (id, title, description, embedding, last_ts), without those that have no embedding.

    The embedding is the mean of all messages'. The title is the first line of the latest
    user message, or of the latest assistant message where that is empty; the description
    shows the three latest messages. Ties in time go by message_id.
    """
    key = F.concat_ws(":", *[F.coalesce(c, F.lit("")) for c in ("workspace", "chat_id", "chat_type")])
    own = messages.withColumn("id", F.concat(F.lit("conv-"), key))
    at = F.struct("ts_ms", "message_id")
    said = lambda role: F.coalesce(F.max_by(F.coalesce("text", F.lit("")), F.when(F.col("message_type") == role, at)), F.lit(""))
    titles = own.groupBy("id").agg(said("user").alias("user"), said("assistant").alias("assistant"), F.max("ts_ms").alias("last_ts"))
    line = F.trim(F.split_part(F.when(F.col("user") != "", F.col("user")).otherwise(F.col("assistant")), F.lit("\n"), F.lit(1)))
    titles = titles.select("id", F.when(line == "", "Untitled Conversation").otherwise(_dotted(line, 100)).alias("title"), "last_ts")
    # three rows a conversation, kept latest first by each task
    latest = own.select("id", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ts_ms"), F.desc("message_id"))).alias("place")).filter("place <= 3")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("place", _dotted(F.col("text"), 200).alias("text")))), lambda x: x["text"])
    previews = latest.groupBy("id").agg(_dotted(F.array_join(shown, "\n\n"), 500).alias("description"))
    return mean_vectors(own, "id").join(titles, "id").join(previews, "id").select("id", "title", "description", "embedding", "last_ts")


#: Words that don't name a theme.
THEME_STOP_WORDS = "the and for with that this from your about when what how into using based".split()


def theme_names(members: DataFrame, least: float) -> DataFrame:
    """(theme, name, item_count) from (theme, place, title); places order the rows of each theme.

    One item: its title. Else up to three words that occur in two of the first ten titles
    (broad view: ``least`` under 0.6, with the size where that is over ten), or in half of
    them; the first to occur on ties. Without such words: the first part of the longest title
    (the last of them on ties) of a broad theme of more than five, else the first title and
    how many more there are. A null title is empty. Of a large theme, tasks send only counts
    and ten rows each.
    """
    broad = least < 0.6
    own = members.select("theme", "place", F.coalesce("title", F.lit("")).alias("title"))
    longest = F.max_by("title", F.struct(F.length("title"), "place"))
    themes = own.groupBy("theme").agg(F.count("*").alias("n"), F.min_by("title", "place").alias("first"), longest.alias("longest"))
    firsts = own.withColumn("_rank", F.row_number().over(Window.partitionBy("theme").orderBy("place"))).filter("_rank <= 10")
    words = firsts.select("theme", "place", F.posexplode(F.array_distinct(F.split(F.lower("title"), r"\s+"))).alias("at", "word"))
    words = words.filter((F.length("word") > 3) & ~F.col("word").isin(*THEME_STOP_WORDS))
    counts = words.groupBy("theme", "word").agg(F.count("*").alias("found"), F.min(F.struct("place", "at")).alias("at"))
    half = F.lit(2) if broad else F.ceil(F.least("n", F.lit(10)) / 2)
    common = counts.join(themes.select("theme", "n"), "theme").filter(F.col("found") >= half)
    rank = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("found"), "at"))
    top = common.withColumn("rank", rank).filter("rank <= 3").withColumn("word", F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " & ")
    named = themes.join(top.groupBy("theme").agg(joined.alias("words")), "theme", "left")
    n, first = F.col("n"), F.col("first")
    sized = F.when(F.lit(broad) & (n > 10), F.concat("words", F.lit(" ("), n, F.lit(")"))).otherwise(F.col("words"))
    part = F.trim(F.split("longest", "[:\\-–]", 2)[0])
    part = _dotted(F.when(part != "", part).otherwise(F.col("longest")), 35)
    name = F.when(n == 1, first).when(F.col("words").isNotNull(), sized).when(F.lit(broad) & (n > 5), part)
    return named.select("theme", name.otherwise(F.concat(_dotted(first, 40), F.lit(" (+"), n - 1, F.lit(")"))).alias("name"), n.alias("item_count"))


def theme_preview(items: DataFrame, conversations: DataFrame, least: float = 0.75, limit: int | None = None, **how: int) -> DataFrame:
    """Themes over library items and conversations together: (theme, name, item_count, rank, one_off).

    Items (id, title, category_id, embedding) come first, by id, then conversations (as from
    ``conversation_items``), the latest first. Each joins the most similar theme by that
    theme's first member, if similar enough, else starts one. Rows without an embedding belong
    to no theme; where none has one, items are grouped by category. Ranks go by size, then by
    order. ``least`` must lie between 0.3 and 0.99.
    """
    if not 0.3 <= least <= 0.99:
        raise ValueError("the threshold must lie between 0.3 and 0.99")
    late = F.lpad((F.lit(10**15 - 1) - F.col("last_ts")).cast("string"), 15, "0")
    a = items.select(F.concat(F.lit("0:"), "id").alias("key"), "id", "title", F.coalesce("category_id", F.lit("uncategorized")).alias("category"), "embedding")
    b = conversations.select(F.concat(F.lit("1:"), late, F.lit(":"), "id").alias("key"), "id", "title", F.lit("uncategorized").alias("category"), F.col("embedding").cast(items.schema["embedding"].dataType))
    both = written(a.unionAll(b))
    placed = both.filter("size(embedding) > 0")
    if placed.isEmpty():
        members = both.select(F.col("category").alias("theme"), "key", "title")
    else:
        labels = leader_clusters(placed.select(F.col("key").alias("id"), "embedding"), least, **how).select(F.col("id").alias("key"), "cluster")
        names = both.select(F.col("key").alias("cluster"), F.concat(F.lit("theme-"), "id").alias("theme"))
        members = labels.join(names, "cluster").join(both.select("key", "title"), "key").select("theme", "key", "title")
    members = written(members.withColumnRenamed("key", "place"))
    order = members.groupBy("theme").agg(F.min("place").alias("key"))
    found = theme_names(members, least).join(order, "theme").orderBy(F.desc("item_count"), "key")
    found = found if limit is None else found.limit(limit)
    return ranked(found, [F.desc("item_count"), F.asc("key")]).select("theme", "name", "item_count", "rank", (F.col("item_count") == 1).alias("one_off"))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with a ``rank`` from 1 in the given order: sorted by ranges, numbered within, moved on by the counts of the ranges before."""
    parts = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))  # a row a range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = parts.join(F.broadcast(before.select("_part", "_first", "_before")), "_part")
    return out.withColumn("rank", F.col("_before") + F.col("_place") - F.col("_first") + 1).drop("_part", "_place", "_first", "_before")


#: Words that don't name a topic.
TOPIC_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must can i you we they "
    "it this that these those my your our their what which who whom how when where why to for with from about into through during before "
    "after above below between under again further then once here there all each few more most other some such no not only same so than "
    "too very just also now and but or if of at by in on as up out off over any"
).split()


def topic_titles(topics: DataFrame) -> DataFrame:
    """(cluster, title) from (cluster, place, text), places from 1: the three words that occur most in the first 100 characters of the first five texts.

    Words lose all but letters and digits; the first to occur goes first on ties. Without
    words: 50 characters of the first text. A null text is empty.
    """
    own = topics.filter("place <= 5").select("cluster", "place", F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("text"))
    words = own.select("cluster", "place", F.posexplode(F.split(F.lower("text"), r"\s+")).alias("at", "raw")).withColumn("word", F.regexp_replace("raw", r"[^\p{L}\p{N}]", ""))
    counts = words.filter((F.length("word") > 3) & ~F.col("word").isin(*TOPIC_STOP_WORDS)).groupBy("cluster", "word").agg(F.count("*").alias("n"), F.min(F.struct("place", "at")).alias("at"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "at"))).filter("rank <= 3")
    shown = capital(F.col("word"))
    named = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("word")))), lambda x: x["word"]), " & ").alias("words"))
    first = own.groupBy("cluster").agg(F.min_by("text", "place").alias("text"))
    plain = F.when(F.length("text") > 50, F.concat(F.substring("text", 1, 50), F.lit("..."))).otherwise(F.col("text"))
    return first.join(named, "cluster", "left").select("cluster", F.coalesce("words", plain).alias("title"))


def unexplored_words(messages: DataFrame, items: DataFrame, least: int = 5, high: int = 10, limit: int | None = 8) -> DataFrame:
    """(topic, conversation_count, severity, sample): words of many conversations that no title of an item that isn't archived holds.

    Words are over four letters, cut at both ends to a-z. The sample is the start of the first
    message (by time, then id) that holds the word. Under ten messages there are no topics;
    a message without a chat counts as of one unknown chat.
    """
    own = messages.select("message_id", "ts_ms", F.coalesce("chat_id", F.lit("unknown")).alias("chat_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own if own.limit(10).count() == 10 else own.limit(0)
    word = F.regexp_replace("raw", "^[^a-z]+|[^a-z]+$", "")
    raw = own.select("chat_id", F.struct("ts_ms", "message_id", F.substring("text", 1, 100).alias("sample")).alias("first"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("raw"))
    # one row a word and chat, then one a word: a word that all messages hold is added up in tasks first
    chats = raw.select("chat_id", "first", word.alias("word")).filter(F.length("word") > 4).groupBy("word", "chat_id").agg(F.min("first").alias("first"))
    words = chats.groupBy("word").agg(F.count("*").alias("conversation_count"), F.min("first")["sample"].alias("sample")).filter(F.col("conversation_count") >= least)
    known = items.filter("status <> 'archived'").select(F.explode(F.split(F.lower("title"), r"\s+")).alias("word")).filter(F.length("word") > 4).distinct()
    found = words.join(known, "word", "left_anti")
    severity = F.when(F.col("conversation_count") >= high, "high").otherwise("medium")
    topic = F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))
    found = found.select("word", topic.alias("topic"), "conversation_count", severity.alias("severity"), "sample")
    found = found if limit is None else found.orderBy(F.desc("conversation_count"), "word").limit(limit)
    return found.drop("word")

"""Registered queries over the item library."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import title_words
from threadloom.operators import archive
from threadloom.operators import library as lib
from threadloom.plans.model import Model, cosine_sql, over
from threadloom.registry import query

_CARD = ["id", "title", "item_type", "status", "occurrence", "last_seen"]
_COLS = ", ".join(_CARD)


def _items(spark, sf):
    return Model(spark, sf).items()


@query("library_counts", over("items", " UNION ALL ".join(f"SELECT '{c}' AS facet, coalesce({c}, 'none') AS value, count(*) AS count FROM items GROUP BY 2" for c in ("item_type", "status", "category_id"))))
def library_counts(spark, sf):
    return lib.counts_by(_items(spark, sf), ["item_type", "status", "category_id"])


@query("library_summary", over("items", """
SELECT count(*) AS total, count(*) FILTER (status = 'implemented') AS implemented, count(*) FILTER (status = 'archived') AS archived, sum(occurrence)::BIGINT AS occurrences,
       min(coalesce(last_seen, first_seen)) AS earliest, max(coalesce(last_seen, first_seen)) AS latest FROM items"""))
def library_summary(spark, sf):
    return lib.library_summary(_items(spark, sf))


@query("items_page", over("items", f"SELECT {_COLS} FROM items WHERE item_type = 'idea' ORDER BY last_seen DESC, id LIMIT 20 OFFSET 20"))
def items_page(spark, sf):
    return lib.page(_items(spark, sf), [F.desc("last_seen"), F.col("id")], 2, 20, F.col("item_type") == "idea").select(*_CARD)


@query("library_search", over("items", f"SELECT {_COLS} FROM items WHERE (contains(lower(title), 'the') OR contains(lower(description), 'the')) AND item_type = 'insight' AND status = 'active' ORDER BY occurrence DESC, id LIMIT 100"))
def library_search(spark, sf):
    return lib.matching(_items(spark, sf), "the", "insight").orderBy(F.desc("occurrence"), "id").limit(100).select(*_CARD)


@query("uncategorised_items", over("items", f"SELECT {_COLS} FROM items WHERE category_id IS NULL AND status = 'active'"))
def uncategorised(spark, sf):
    return lib.matching(_items(spark, sf), category="none").select(*_CARD)


@query("stale_items", over("items", f"SELECT {_COLS} FROM items WHERE status <> 'archived' AND last_seen < '2024-06-15T00:00:00'"))
def stale_items(spark, sf):
    return lib.stale(_items(spark, sf), "2024-06-15T00:00:00").select(*_CARD)


@query("archived_after_cleanup", over("items", "SELECT id, CASE WHEN status <> 'archived' AND last_seen < '2024-06-15T00:00:00' THEN 'archived' ELSE status END AS status FROM items"))
def archive_stale(spark, sf):
    return lib.archive_stale(_items(spark, sf), "2024-06-15T00:00:00").select("id", "status")


@query("theme_summaries", over("items", """
, n AS (SELECT *, coalesce(category_id, 'Uncategorized') AS category FROM items),
t AS (SELECT category, tag, count(*) AS k FROM (SELECT category, unnest(tags) AS tag FROM n) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k DESC, tag) AS r FROM t)
SELECT category, count(*) AS items, max(last_seen) AS last_seen, (SELECT string_agg(tag, ',' ORDER BY r) FROM r WHERE r.category = n.category AND r <= 5) AS top_tags
FROM n GROUP BY category ORDER BY items DESC, category LIMIT 10"""))
def theme_summaries(spark, sf):
    return lib.theme_summaries(_items(spark, sf))


@query("merged_items", over("items", """
, g AS (SELECT *, 'g' || (n // 3) AS grp FROM items)
SELECT grp, arg_max(id, (occurrence, -n)) AS id, arg_max(title, (occurrence, -n)) AS title, sum(occurrence)::BIGINT AS occurrence, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
       array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, count(*) AS merged FROM g GROUP BY 1"""))
def merged_items(spark, sf):
    return lib.merged(_items(spark, sf).withColumn("grp", F.concat(F.lit("g"), F.expr("n div 3"))), "grp")


@query("backfilled_source_dates", over("items", """
SELECT id, coalesce(source_start_date, (first_seen || '-01')::DATE) AS source_start_date, CASE WHEN source_start_date IS NULL THEN last_day((last_seen || '-01')::DATE) ELSE source_end_date END AS source_end_date FROM items"""))
def backfilled_dates(spark, sf):
    return lib.backfilled_dates(_items(spark, sf)).select("id", "source_start_date", "source_end_date")


@query("backfilled_history", over("items history", """
SELECT id AS item_id, coalesce(source_start_date, (first_seen || '-01')::DATE) AS occurred_at, 'generation' AS source_type
FROM items WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.item_id = items.id AND h.source_type = 'deduplication')"""))
def backfilled_history(spark, sf):
    m = Model(spark, sf)
    return lib.backfilled_history(m.items(), m.history().filter("source_type = 'deduplication'"))


@query("upserted_library", over("items", """
, new AS (SELECT 'new-' || n AS id, * EXCLUDE (id) FROM items WHERE n % 20 = 0), old AS (SELECT * FROM items WHERE n % 20 <> 0),
m AS (SELECT new.id AS new_id, old.id AS item_id FROM new JOIN old ON old.n = new.n + 1 WHERE new.n % 40 = 0),
d AS (SELECT item_id, count(*) AS k, min(new.source_start_date) AS s, max(new.source_end_date) AS e, max(new.last_seen) AS l FROM m JOIN new ON new.id = new_id GROUP BY 1)
SELECT old.id, (occurrence + coalesce(k, 0))::BIGINT AS occurrence, least(source_start_date, s) AS source_start_date, greatest(source_end_date, e) AS source_end_date, greatest(last_seen, l) AS last_seen
FROM old LEFT JOIN d ON item_id = old.id
UNION ALL SELECT id, 1, source_start_date, source_end_date, last_seen FROM new WHERE id NOT IN (SELECT new_id FROM m)"""))
def upserted_library(spark, sf):
    """Every twentieth item arrives as new; half of them match the item after them."""
    items = _items(spark, sf)
    new, old = items.filter("n % 20 = 0").withColumn("id", F.concat(F.lit("new-"), "n")), items.filter("n % 20 <> 0")
    matches = new.filter("n % 40 = 0").select(F.col("id").alias("new_id"), (F.col("n") + 1).alias("n")).join(old.select("n", F.col("id").alias("item_id")), "n").select("new_id", "item_id")
    return lib.upserted(old, new, matches).select("id", "occurrence", "source_start_date", "source_end_date", "last_seen")


_MARKS = "[.,!?;:()\\[\\]{}\"''`\\-_/\\\\]+"
_WORDS = f"""unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(title), '\\s+'), lambda w: regexp_replace(w, '^{_MARKS}|{_MARKS}$', '', 'g')), lambda w: length(w) > 3 AND w NOT IN
  ('the', 'a', 'an', 'is', 'are', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from', 'as', 'how', 'what', 'when', 'where', 'why', 'which', 'who', 'not', 'this', 'that', 'it', 'its', 'use', 'using', 'used')))) AS word"""


@query("title_word_counts", over("items", f"SELECT word, count(*) AS titles FROM (SELECT {_WORDS} FROM items) GROUP BY 1"))
def title_word_counts(spark, sf):
    return _items(spark, sf).select(F.explode(title_words(F.col("title"))).alias("word")).groupBy("word").agg(F.count("*").alias("titles"))


@query("temporal_word_shifts", over("items", f"""
, w AS (SELECT {_WORDS}, coalesce(last_seen, first_seen) AS seen FROM items WHERE status <> 'archived'),
c AS (SELECT word, count(*) FILTER (seen >= '2025-01') AS recent, count(*) FILTER (seen >= '2024-06' AND seen < '2025-01') AS older FROM w GROUP BY 1)
SELECT * FROM (SELECT *, CASE WHEN older >= 3 AND recent <= 1 THEN 'declining' WHEN recent >= 3 AND older <= 1 THEN 'emerging' END AS shift FROM c) WHERE shift IS NOT NULL
ORDER BY shift, greatest(recent, older) DESC, word LIMIT 5"""))
def temporal_shifts(spark, sf):
    seen = F.coalesce("last_seen", "first_seen")
    return lib.word_shifts(_items(spark, sf), title_words(F.col("title")), seen >= "2025-01", (seen >= "2024-06") & (seen < "2025-01"))


@query("corrected_first_seen", over("embedded_items embedded_messages", f"""
, i AS (SELECT id, embedding, CASE WHEN n % 13 <> 0 THEN first_seen END AS first_seen FROM embedded_items), m AS (SELECT message_id AS id, embedding, ts_ms FROM embedded_messages WHERE embedding IS NOT NULL),
p AS (SELECT i.id, ts_ms, row_number() OVER (PARTITION BY i.id ORDER BY round({cosine_sql('i.embedding', 'm.embedding')}, 6) DESC, m.id) AS r FROM i, m WHERE round({cosine_sql('i.embedding', 'm.embedding')}, 6) >= 0.3),
e AS (SELECT id, strftime(make_timestamp(min(ts_ms) * 1000), '%Y-%m') AS month FROM p WHERE r <= 20 GROUP BY 1)
SELECT id, CASE WHEN coalesce(month < first_seen, month IS NOT NULL) THEN month ELSE first_seen END AS first_seen, coalesce(month < first_seen, month IS NOT NULL) AS corrected FROM i LEFT JOIN e USING (id)"""))
def corrected_first_seen(spark, sf):
    """All items, every thirteenth without a date, against all messages."""
    m = Model(spark, sf)
    items = m.embedded_items().select("id", "embedding", F.expr("if(n % 13 <> 0, first_seen, null)").alias("first_seen"))
    messages = m.embedded_messages().select(F.col("message_id").alias("id"), "embedding", "ts_ms")
    return lib.corrected_first_seen(items, messages, 0.3).select("id", "first_seen", "corrected")


_CHANGES = """
, bank AS (SELECT row_number() OVER (ORDER BY n) - 1 AS idx, title AS content, CASE WHEN n % 4 <> 0 THEN occurrence END AS occurrence_count, n AS last_updated, CASE WHEN n % 3 = 0 THEN 's' || n END AS solved FROM items WHERE n < 60),
c AS (SELECT conv_id AS batch, turn AS place, CASE role WHEN 'assistant' THEN 'new' WHEN 'user' THEN 'update' ELSE 'none' END AS action, (conv_id * 31 + turn * 7) % 90 AS id, text AS content, conv_id * 100 + turn AS made_at,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 't' || turn END AS solved FROM conversations WHERE conv_id % 10 <> 9),
d AS (SELECT *, (SELECT count(*) FROM bank) + count(*) FILTER (action = 'new') OVER (ORDER BY batch, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS there FROM c),
v AS (SELECT idx, -1 AS b, -1 AS p, content, coalesce(occurrence_count, 1) AS n, last_updated, solved FROM bank UNION ALL
  SELECT CASE action WHEN 'new' THEN there ELSE id END, batch, place, content, 1, made_at, solved FROM d WHERE action = 'new' OR action = 'update' AND id < there)
SELECT idx, arg_max(content, (b, p)) AS content, sum(n)::BIGINT AS occurrence_count, arg_max(last_updated, (b, p)) AS last_updated, arg_max(solved, (b, p)) FILTER (solved IS NOT NULL) AS solved FROM v GROUP BY 1"""


@query("harmonised_bank", over("items", _CHANGES))
def harmonised_bank(spark, sf):
    """All conversations as batches of changes to a bank of 60 entries, every tenth processed before; then all of them once more, which changes nothing."""
    m = Model(spark, sf)
    own = m.items().filter("n < 60").select("n", "title", "occurrence")
    bank = own.select((F.row_number().over(Window.orderBy("n")) - 1).cast("long").alias("idx"), F.col("title").alias("content"), F.expr("if(n % 4 <> 0, occurrence, null)").alias("occurrence_count"), F.col("n").alias("last_updated"), F.expr("if(n % 3 = 0, concat('s', n), null)").alias("solved"))
    changes = m.table("conversations").select(
        F.sha2(F.concat_ws("|", "conv_id", "turn"), 256).alias("item_hash"), F.col("conv_id").alias("batch"), F.col("turn").alias("place"),
        F.expr("case role when 'assistant' then 'new' when 'user' then 'update' else 'none' end").alias("action"), F.expr("(conv_id * 31 + turn * 7) % 90").alias("id"),
        F.col("text").alias("content"), F.expr("conv_id * 100 + turn").alias("made_at"), F.expr("if((conv_id + turn) % 5 = 0, concat('t', turn), null)").alias("solved"),
    )
    first, processed = lib.harmonised(bank, changes, changes.filter("batch % 10 = 9").select("item_hash"))
    return lib.harmonised(first, changes, processed)[0]


@query("reindexed_archive", """
WITH a AS (SELECT 'f/' || source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 0),
b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'moved/' || doc_id ELSE 'f/' || source || '/' || doc_id END AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 10 <> 1),
j AS (SELECT coalesce(a.path, b.path) AS path, a.h AS old, b.h AS new FROM a FULL JOIN b ON a.path = b.path),
g AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY path) AS nth FROM j WHERE new IS NULL), n AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY path) AS nth FROM j WHERE old IS NULL)
SELECT path, sha256(path)[1:16] AS doc_id, new AS content_hash, CASE WHEN old = new THEN 1 ELSE 2 END AS version, FALSE AS deleted, CASE WHEN old = new THEN 'unchanged' ELSE 'changed' END AS action FROM j WHERE old IS NOT NULL AND new IS NOT NULL
UNION ALL SELECT n.path, sha256(coalesce(g.path, n.path))[1:16], n.new, 1, FALSE, CASE WHEN g.path IS NULL THEN 'added' ELSE 'moved' END FROM n LEFT JOIN g ON g.old = n.new AND g.nth = n.nth
UNION ALL SELECT path, sha256(path)[1:16], old, 2, TRUE, 'removed' FROM g ANTI JOIN n ON g.old = n.new AND g.nth = n.nth""")
def reindexed_archive(spark, sf):
    """The documents as files indexed once, then with some removed, added, moved and changed."""
    d = Model(spark, sf).table("documents")
    path = F.concat_ws("/", F.lit("f"), "source", "doc_id")
    first = archive.reindexed(archive.empty_index(d), d.filter("doc_id % 10 <> 0").select(path.alias("path"), F.col("text").alias("content")))
    later = d.filter("doc_id % 10 <> 1").select(
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("moved/"), "doc_id")).otherwise(path).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.expr("if(doc_id % 7 = 0, '!', '')")).alias("content")
    )
    return archive.reindexed(first.drop("action"), later)

"""Thin registered queries over the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm.bpe import round_trip_digests
from threadloom.llm.common import table, vocabulary_path
from threadloom.llm.conversation_repair import repaired_conversations
from threadloom.llm.html_extract import extract_main_text
from threadloom.llm.jaccard_join import jaccard_components
from threadloom.llm.line_dedup import drop_boilerplate
from threadloom.llm.media_webp import media_columns
from threadloom.llm.near_dedup import near_duplicates
from threadloom.llm.packing import pack
from threadloom.llm.quality_mil import score_quality
from threadloom.llm.quality_rules import quality_filter
from threadloom.llm.sharding import hilbert_shards
from threadloom.llm.toxicity_crf import score_toxicity
from threadloom.llm.vector_codes import vector_codes


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, host="source", text="text")


def op2_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), shards=8)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), capacity=4096, end_id=1)


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_filter(docs).select(*names)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle_words=5, percent=80)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_hyperminhash_dedup": op2_hyperminhash_dedup,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_attention_quality": op5_attention_quality,
    "op6_html_main_text": op6_html_main_text,
    "op7_crf_toxicity": op7_crf_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_webp_media": op10_webp_media,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_gnat_vector_codes": op13_gnat_vector_codes,
}

QUERIES["pipeline"] = pipeline

#: One round of the codebooks in SQL: nearest entries, then means of their parts; @: the round.
_ROUND = """
a@ AS MATERIALIZED (
  SELECT x.vec, x.p, x.v, min(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + b.e) AS best
  FROM part x JOIN b@ b ON x.p = b.p GROUP BY x.vec, x.p, x.v),
m@ AS MATERIALIZED (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT p, best % 16 AS e, i, sum(v[i]) AS s, count(*) AS n FROM a@, range(1, 1 + len(v)) t(i) GROUP BY ALL) GROUP BY p, e),"""

_LINKS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
"""

ORACLES: dict[str, str] = {
    "op11_jaccard_join": _LINKS
    + """
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op13_gnat_vector_codes": """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vec, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec, p, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, vec - 1 AS e, v FROM part WHERE vec <= 16),"""
    + "".join(_ROUND.replace("@", str(r)) + f"\nb{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (p, e))," for r in range(6))
    + _ROUND.replace("@", "6").split("m6 AS")[0]
    + """
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6),
coded AS (SELECT vec, string_agg(printf('%02x', (best % 16)::INT), '' ORDER BY p) AS code, sum(best // 16)::BIGINT AS error FROM a6 GROUP BY vec)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec), books""",
    "op2_hyperminhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS kept
FROM n LEFT JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, source, text, coalesce(source, chr(1)) AS host FROM documents),
lines AS (SELECT doc_id, host, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
filled AS (SELECT *, trim(line, ' ') AS key FROM lines),
bad AS (
  SELECT c.host, c.key FROM (SELECT host, key, count(DISTINCT doc_id) AS n FROM filled WHERE key <> '' GROUP BY host, key) c
  JOIN (SELECT host, count(*) AS total FROM d GROUP BY host) t USING (host) WHERE c.n >= 3 AND c.n > t.total * 0.05::DOUBLE),
marked AS (SELECT f.*, b.key IS NOT NULL AS gone FROM filled f LEFT JOIN bad b ON f.host = b.host AND f.key = b.key),
built AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS lines_in, count(*) FILTER (gone) AS lines_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, b.text, coalesce(b.lines_in, 0)::INT AS lines_in, coalesce(b.lines_dropped, 0)::INT AS lines_dropped
FROM d LEFT JOIN built b USING (doc_id)""",
    "op9_quality_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM c""",
}

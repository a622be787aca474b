"""Markdown, code comments, transcripts and generated item lists as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import cut_at_sentence

# Folders that are never read, and the marks and leaders of comments that are to do.
SKIPPED_FOLDERS = (
    "node_modules .next dist build .git __pycache__ .cache .turbo coverage .nyc_output vendor .venv venv env .env .tox eggs *.egg-info .mypy_cache .pytest_cache .ruff_cache"
    " e2e-results test-results playwright-report .vercel .netlify .amplify data"
).split()
TODO = r"(?://|#|/\*|\*|<!--)\s*(TODO|FIXME|HACK|NOTE|XXX|OPTIMIZE|WARNING)\b[:\s]*(.*)"


def read_texts(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, modified_ms, text) of the files below a folder, without those in skipped or hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    skip = "|".join(re.escape(f) for f in SKIPPED_FOLDERS)
    return files.filter(~F.rlike("path", F.lit(rf"/(?:{skip}|\.[^/]+)/"))).select("path", F.unix_millis("modificationTime").alias("modified_ms"), F.decode("content", "utf-8").alias("text"))


def markdown_documents(texts: DataFrame, least: int = 20, most: int = 6000) -> DataFrame:
    """Stripped documents of at least so many characters, cut at a sentence if longer than ``most``, with ids by path and content."""
    t = F.trim(F.col("text"))
    out = texts.withColumn("text", cut_at_sentence(t, most)).filter(F.length("text") >= least)
    short = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    return out.withColumn("message_id", F.concat(F.lit("workspace_docs:"), short(F.col("path"), 8), F.lit("_"), short(F.col("text"), 16)))


def todo_comments(texts: DataFrame, key: str = "path", around: int = 2) -> DataFrame:
    """Comments that mark work to do: (key, line, kind, note, context) with so many lines around each."""
    lines = texts.select(key, F.split("text", "\n").alias("all")).select(key, "all", F.posexplode("all").alias("at", "one"))
    hit = lines.filter(F.rlike("one", F.lit(TODO)))
    first = F.greatest(F.col("at") - around, F.lit(0))
    return hit.select(
        key,
        (F.col("at") + 1).alias("line"),
        F.regexp_extract("one", TODO, 1).alias("kind"),
        F.trim(F.regexp_extract("one", TODO, 2)).alias("note"),
        F.array_join(F.slice("all", first + 1, F.col("at") - first + around + 1), "\n").alias("context"),
    )


def todo_counts(comments: DataFrame, key: str = "path") -> DataFrame:
    return comments.groupBy(key).agg(F.count("*").alias("todo_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def front_matter(text: Column, key: str) -> Column:
    """A field of the YAML front matter between the first two '---' lines, null if there is none."""
    head = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit(""))


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*\n?", "")


def without_headings(text: Column) -> Column:
    """The text without lines that start with '#', and without white space at its ends."""
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit("#"))), "\n"), r"^\s+|\s+$", "")


# Fixed value: what begins a speaker's turn.
_TURN = r"(?mU)^([\w\s.'\-+]+?)\s*\((\d{2}:\d{2}:\d{2})\):\s*"


def speaker_turns(texts: DataFrame, key: str) -> DataFrame:
    """Turns of a transcript without its headings: (key, chunk_index, speaker, clock, text, words). Without marked turns all is one of 'Unknown' at 00:00:00; empty turns are left out."""
    given = texts.withColumn("text", without_headings(F.col("text")))
    t = F.col("text")
    speakers, clocks = (F.regexp_extract_all(t, F.lit(_TURN), k) for k in (1, 2))
    parts = F.slice(F.split(t, _TURN), 2, F.greatest(F.size(speakers), F.lit(1)))
    alone = F.array(F.struct(F.lit("Unknown").alias("who"), F.lit("00:00:00").alias("clock"), t.alias("body")))
    turns = F.when(F.size(speakers) > 0, F.arrays_zip(speakers.alias("who"), clocks.alias("clock"), parts.alias("body"))).otherwise(alone)
    words = lambda b: F.size(F.filter(F.split(b, r"\s+"), lambda w: w != ""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    kept = F.filter(turns, lambda x: words(x["body"]) > 0)
    out = given.select(key, F.posexplode(kept).alias("chunk_index", "x"))
    return out.select(key, "chunk_index", trimmed(F.col("x.who")).alias("speaker"), F.col("x.clock").alias("clock"), trimmed(F.col("x.body")).alias("text"), words(F.col("x.body")).alias("words"))


def packed_paragraphs(df: DataFrame, key: list[str], max_words: int = 600) -> DataFrame:
    """Texts split at empty lines and packed greedily into chunks of at most so many words; a longer paragraph is a chunk of its own.

    (key, part, text, words); every text has one part at least.
    """
    paragraphs = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.trim(p) != "")
    n = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    start = F.struct(F.array().cast("array<struct<t:string,n:int>>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        flush = (acc["n"] > 0) & (acc["n"] + n(p) > max_words)
        done = F.when(flush, F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n")))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(flush | (acc["n"] == 0), p).otherwise(F.concat(acc["t"], F.lit("\n\n"), p)).alias("t"), F.when(flush, n(p)).otherwise(acc["n"] + n(p)).alias("n"))

    packed = F.aggregate(paragraphs, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], F.struct(a["t"].alias("t"), a["n"].alias("n")))).otherwise(a["done"]))
    return df.select(*key, F.posexplode(packed).alias("part", "x")).select(*key, "part", F.col("x.t").alias("text"), F.col("x.n").alias("words"))


_ITEM = re.compile(r"^##\s+(?:Item|Idea|Insight|Post|Use Case)\s+(\d+):\s*(.+?)\s*$", re.M | re.I)
_FIELD = re.compile(r"^\*\*(.+?):?\*\*:?\s*(.*?)(?=^\*\*|\Z)", re.M | re.S)
_NUMBERED = re.compile(r"^\s*(\d+)[.)]\s+(.{20,})$", re.M)


def _items(text: str) -> Iterator[tuple[int, str, dict[str, str]]]:
    bare = re.sub(r"```\w*", "", text or "")
    heads = list(_ITEM.finditer(bare))
    for m, nxt in zip(heads, [*heads[1:], None], strict=False):
        body = re.split(r"^##\s", bare[m.end() : nxt.start() if nxt else len(bare)], maxsplit=1, flags=re.M)[0]
        if len(m[2]) > 3:
            yield int(m[1]), m[2], {f[1].strip().lower(): " ".join(f[2].split()) for f in _FIELD.finditer(body)}
    if not heads:
        for m in _NUMBERED.finditer(bare):
            yield int(m[1]), m[2].strip(), {}


def generated_items(texts: DataFrame, key: str) -> DataFrame:
    """Items of a generated list, '## Idea 1: title' with bold fields, else a numbered list of lines of twenty characters: (key, rank, title, fields, is_best)."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(k, n, title, fields, n == 1) for k, t in zip(b[key], b["text"], strict=True) for n, title, fields in _items(t)]
            yield pd.DataFrame(rows, columns=[key, "rank", "title", "fields", "is_best"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, rank int, title string, fields map<string,string>, is_best boolean")


def checkboxes(text: Column) -> Column:
    """(done, open, completion in per cent) of the check boxes in a markdown text."""
    done, todo = F.regexp_count(text, F.lit(r"(?im)^\s*[-*] \[x\]")), F.regexp_count(text, F.lit(r"(?m)^\s*[-*] \[ \]"))
    return F.struct(done.alias("done"), todo.alias("open"), F.when(done + todo > 0, F.round(done * 100 / (done + todo)).cast("int")).otherwise(0).alias("completion"))


def stated_cost(text: Column, items: Column) -> Column:
    """The cost that a text states, else a cent an item and five cents at least."""
    found = F.regexp_extract(text, r"(?i)estimated cost:\s*\$?([\d.]+)", 1)
    return F.coalesce(F.try_to_number(F.nullif(found, F.lit("")), F.lit("9999.999")).cast("double"), F.greatest(F.lit(0.05), items * 0.01))

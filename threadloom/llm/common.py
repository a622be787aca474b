"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words in every contract: blank and \x09 to \x0D.
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; the package that holds it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, without its lineage.

    The folder is the one in ``spark.checkpoint.dir``; a local one is made only where
    the session names none and runs on this machine alone, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``rows`` rows, so that what Python makes of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, which no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters that are not WORD_SPACE."""
    blanks = F.translate(text, WORD_SPACE, " " * len(WORD_SPACE))
    return F.array_remove(F.split(blanks, " "), "")


def held_out(doc_id: Column) -> Column:
    """Rows on which labels are never learned: crc32 of the id's decimal text, mod 4, is 2."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2


def spread_rank(df: DataFrame, key: str, order: list[str], parts: int = 1024) -> DataFrame:
    """Adds ``rank_in_key`` (0-based, gapless) and ``key_count`` per ``key``, however many rows a key has.

    A key is cut into hash buckets so that none holds more than about 1/``parts`` of all
    rows; bucket offsets come from a running sum over the bucket counts, of which there are
    at most keys + parts. ``df`` is read three times: pass a written table. Keys must be a
    bounded set (lengths, curve cells), as their counts are broadcast.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("key_count"))
    share = F.col("key_count") * F.lit(parts) / F.sum("key_count").over(Window.partitionBy())
    counts = counts.withColumn("_buckets", F.ceil(share).cast("int"))
    dealt = df.join(F.broadcast(counts), key).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets")))
    sizes = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(key, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_place", F.row_number().over(own) - 1)
    return (
        ranked.join(F.broadcast(sizes), [key, "_bucket"])
        .withColumn("rank_in_key", (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_bucket", "_buckets", "_start", "_place")
    )

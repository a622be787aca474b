"""An index of an archive's files, brought up to date by what the files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def empty_index(df: DataFrame) -> DataFrame:
    """An index without files, in the session of ``df``."""
    return df.sparkSession.createDataFrame([], "path string, doc_id string, content_hash string, version int, deleted boolean")


def reindexed(index: DataFrame, files: DataFrame) -> DataFrame:
    """The index after a scan: path, doc_id, content_hash, version, deleted and the ``action`` that led there.

    index: path, doc_id, content_hash, version, deleted; files: path, content. Changes are
    told by content, never by time. A file that holds what it held is 'unchanged', another
    content at its path 'changed' (next version). A file that is gone and a new one of equal
    content are one that 'moved': it keeps its doc_id and version, so that nothing is embedded
    again; of several, the n-th gone path in order goes with the n-th new one. Any other gone
    file is 'removed' and leaves a tombstone (next version), any other new one 'added', with
    the doc_id and next version of its path's tombstone if it has one. Tombstones not called
    back are 'kept'. A path given twice counts with its least hash; null contents are empty;
    null paths are skipped; other columns are not read. Only paths and hashes are shuffled.
    """
    now = files.filter("path is not null").groupBy("path").agg(F.min(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)).alias("new_hash"))
    rows = ["path", "doc_id", "content_hash", "version", "deleted"]
    met = index.select(*rows).join(now, "path", "full")
    dead = F.coalesce("deleted", F.lit(True))
    place = F.when(F.col("deleted").isNull() | (F.col("deleted") & F.col("new_hash").isNotNull()), "new").when(F.col("deleted"), "kept").when(F.col("new_hash").isNull(), "gone").otherwise("there")
    met = met.withColumn("place", place).withColumn("live", ~dead)

    there = met.filter("place = 'there'").withColumn("same", F.col("content_hash") == F.col("new_hash"))
    there = there.select("path", "doc_id", F.col("new_hash").alias("content_hash"), (F.col("version") + F.when(F.col("same"), 0).otherwise(1)).alias("version"), F.lit(False).alias("deleted"), F.when(F.col("same"), "unchanged").otherwise("changed").alias("action"))

    nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("path"))
    gone = met.filter("place = 'gone'").withColumn("nth", nth("content_hash"))
    new = met.filter("place = 'new'").withColumn("nth", nth("new_hash"))
    old = gone.select(F.col("content_hash").alias("new_hash"), "nth", F.col("doc_id").alias("old_id"), F.col("version").alias("old_version"))
    arrived = new.join(old, ["new_hash", "nth"], "left")
    moved = F.col("old_id").isNotNull()
    own_id = F.coalesce("old_id", "doc_id", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 16))
    arrived = arrived.select("path", own_id.alias("doc_id"), F.col("new_hash").alias("content_hash"), F.coalesce("old_version", F.col("version") + 1, F.lit(1)).alias("version"), F.lit(False).alias("deleted"), F.when(moved, "moved").otherwise("added").alias("action"))

    taken = new.select(F.col("new_hash").alias("content_hash"), "nth")
    removed = gone.join(taken, ["content_hash", "nth"], "left_anti").select("path", "doc_id", "content_hash", (F.col("version") + 1).alias("version"), F.lit(True).alias("deleted"), F.lit("removed").alias("action"))
    kept = met.filter("place = 'kept'").select(*rows, F.lit("kept").alias("action"))
    return there.union(arrived).union(removed).union(kept)


def to_embed(index: DataFrame, files: DataFrame) -> DataFrame:
    """The files of a fresh index whose contents have to be read again: those added or changed."""
    return files.join(index.filter(F.col("action").isin("added", "changed")).select("path", "doc_id", "version"), "path")

"""Event streams: windows with watermarks, idempotent ingestion and high-water marks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a local one where that is unset and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-")


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """The files of a folder or pattern as a stream, with the schema of what lies there. A single file needs a pattern too."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def tumbling_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; events later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events with gaps shorter than ``gap``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its last result: each batch replaces the table in ``folder``.

    The checkpoint beside it lets a later run go on where this one stopped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result-{batch_id % 2}")
        batch.sparkSession.createDataFrame([(batch_id % 2,)], "side int").write.mode("overwrite").parquet(f"{folder}/current")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    side = spark.read.parquet(f"{folder}/current").first()["side"]
    return spark.read.parquet(f"{folder}/result-{side}")


def ingest(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Appends rows of a stream whose key isn't in the table yet, once each; running it again adds nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = batch.sparkSession.read.parquet(f"{folder}/table").select(key)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").parquet(f"{folder}/table")

    q = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(merge).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/table")


def high_water_marks(messages: DataFrame) -> DataFrame:
    """The latest time of each source."""
    return messages.groupBy("source").agg(F.max("ts_ms").alias("last_ms"))


def after_marks(messages: DataFrame, marks: DataFrame, earliest_ms: int = 0) -> DataFrame:
    """Messages later than their source's mark, or than ``earliest_ms`` where it has none; what came late stays out."""
    joined = messages.join(marks, "source", "left")
    return joined.filter(F.col("ts_ms") > F.greatest(F.coalesce("last_ms", F.lit(earliest_ms)), F.lit(earliest_ms))).drop("last_ms")


def not_indexed(rows: DataFrame, index: DataFrame, key: str, where: str | None = None) -> DataFrame:
    """Rows, of those that a condition selects, whose key isn't in the index."""
    some = rows if where is None else rows.filter(where)
    return some.join(index.select(key), key, "left_anti")


def sync_report(local: DataFrame, remote: DataFrame, tolerance_ms: int = 300_000) -> DataFrame:
    """For each source its local and indexed counts and latest times, and whether the index is up to date."""
    side = lambda df, p: df.groupBy("source").agg(F.count("*").alias(f"{p}_count"), F.max("ts_ms").alias(f"{p}_last"))
    out = side(local, "local").join(side(remote, "remote"), "source", "full").fillna(0, ["local_count", "remote_count"])
    fresh = (F.col("local_count") <= F.col("remote_count")) | (F.col("local_last") - F.col("remote_last") <= tolerance_ms)
    return out.withColumn("up_to_date", F.coalesce(fresh, F.lit(False)))

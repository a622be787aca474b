"""Graph rounds over written tables: components, and decisions in order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, without its lineage; a local folder is made only where none is set and all runs on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of the undirected edges (a, b) reaches.

    Large-star and small-star rounds: every vertex hands its larger neighbours to its least
    one, then its smaller ones and itself. The edges become stars around the least ids in a
    logarithmic number of rounds; a round is two groupings and two joins on ids.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, mark = written(pairs), None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = written(small.distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def turned_away(edges: DataFrame) -> DataFrame:
    """(id): who is not chosen when vertices are looked at in order and each is chosen unless an earlier chosen neighbour exists.

    ``edges``: (a, b), a before b. A vertex is decided once all its earlier neighbours are:
    in each round those without an open earlier neighbour are chosen and turn their later
    neighbours away, whose own edges then bar nobody. Rounds grow with the longest chain of
    vertices that wait for each other, and only open edges are read again.
    """
    open_ = written(edges.select("a", "b").distinct())
    out = open_.select(F.col("b").alias("id")).limit(0)
    while not open_.isEmpty():
        chosen = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        away = written(open_.join(chosen, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        out = out.union(away)
        left = open_.join(chosen, "a", "left_anti").join(away.withColumnRenamed("id", "a"), "a", "left_anti")
        open_ = written(left.join(away.withColumnRenamed("id", "b"), "b", "left_anti"))
    return out

"""Bounded samples of labelled documents for the trained models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[tuple[int, str, int]], tuple[float, float]]:
    """Up to ``per_class`` (doc_id, text, label) of each class, in order of id, and what a row of each class stands for.

    Rows are chosen by a hash of the id among those that labels may be learned from, so
    the sample is the same on every run. Its ids, at most twice ``per_class``, are
    broadcast, and only the chosen texts come to the driver. A row of a class stands for as
    many usable labels as there are for each one chosen, so that weights restore the mix of
    the classes where one is cut. An id that repeats gives its least text; one that is
    labelled both ways gives a row of each class.
    """
    fit = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    fit = fit.distinct()
    counts = {r["y"]: r["count"] for r in fit.groupBy("y").count().collect()}
    some = [fit.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    rows = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()  # an id's rows may be any number
    stands_for = tuple(max(1.0, counts.get(y, 0) / per_class) for y in (0, 1))
    return sorted((r["doc_id"], r["text"] or "", r["y"]) for r in rows), stands_for

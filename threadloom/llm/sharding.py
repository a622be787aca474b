"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**bits steps; rows are ordered by the curve index of
their cell and cut into runs of equal row counts, so that a shard covers a compact box
of the metadata space and readers can skip it by its minima and maxima.

Defined results: a null text has size 1 and crc32 0; null metadata falls in step 0; ties
within a cell are ordered by a hash bucket, then id, crc32 and size, so repeated rows get
neighbouring slots; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import cut, spread_rank


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """Place of an integer point on the Hilbert curve that fills a cube of 2**bits a side."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                swap = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= swap
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            flip ^= q - 1
        q >>= 1
    x = [v ^ flip for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b & 1)
    return out


def curve_column(steps: list[Column], bits: int) -> Column:
    """Curve index of a row. The cells are few (2**(bits * dimensions)), so the rule is tabulated once."""
    side, n = 1 << bits, len(steps)
    cells = [curve_index(tuple(c >> (bits * (n - 1 - i)) & (side - 1) for i in range(n)), bits) for c in range(side**n)]
    code = F.lit(0)
    for s in steps:
        code = code * side + F.coalesce(F.least(F.greatest(s, F.lit(0)), F.lit(side - 1)), F.lit(0)).cast("int")
    return F.get(F.lit(cells), code.cast("int"))


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    Dimensions: source and lang (hashed to steps), size (its logarithm). Only these few
    numbers a row are written and shuffled, never texts. Rows are ranked within their cell
    in parallel, and cells follow each other by a running sum over their counts (at most
    2**(3 * bits)).
    """
    side = 1 << bits
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    base = cut(
        docs.select(
            "doc_id",
            size.alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            curve_column([F.pmod(F.xxhash64("source"), F.lit(side)), F.pmod(F.xxhash64("lang"), F.lit(side)), F.floor(F.log2(size)) - 6], bits).alias("curve"),
        )
    )
    ranked = spread_rank(base, "curve", ["doc_id", "text_crc32", "size"])
    cells = base.groupBy("curve").agg(F.count("*").alias("_n"))
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = ranked.join(F.broadcast(cells), "curve").withColumn("_rank", F.col("_start") + F.col("rank_in_key")).withColumn("shard", F.expr(f"cast(_rank * {shards} div _total as int)"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"cast(_rank - (shard * _total + {shards - 1}) div {shards} as long)").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )

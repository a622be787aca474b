"""Site-relative line de-duplication.

A line is boilerplate on a host when the share of the host's pages that contain it
exceeds a ratio. Lines are compared after trimming; blank lines are never boilerplate.

Defined results: a null text stays null with 0 lines; a text whose lines all go becomes
''; rows with a null host form one host; a page that repeats a line counts once; repeated
rows are pages of their own; extra columns pass through, but for ones named lines_in or
lines_dropped, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, fresh

BROADCAST = 500_000  # line keys (8 bytes each) that may travel to every machine


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate_lines(pages: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, line_key, pages_with_line, host_pages) of the lines that exceed ``ratio`` on their host.

    Keys are 64-bit hashes: a line is lost by chance only if it meets one of the at most
    (mean lines of a page / ratio) keys of its host. The count shuffles one hash a line,
    keyed by host and line, so that a host with most rows is spread over all tasks.
    """
    own = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("host_pages"))
    filled = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    keys = own.filter(F.col("text").isNotNull()).select("host", F.explode(F.array_distinct(F.transform(filled, _key))).alias("line_key"))
    counts = keys.groupBy("host", "line_key").agg(F.count("*").alias("pages_with_line")).filter(F.col("pages_with_line") >= min_pages)
    return counts.join(totals, "host").filter(F.col("pages_with_line") > F.col("host_pages") * F.lit(ratio))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, min_pages: int = 3, broadcast_keys: int = BROADCAST) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, and ``lines_in`` and ``lines_dropped``.

    ``min_pages``: a line on fewer pages of its host is never boilerplate. On a host of
    few pages each line exceeds the ratio by itself, and two copies of a page would
    make all its lines boilerplate; hence three.

    The boilerplate of a host (at most mean lines of a page / ratio) travels as one array. If
    all these arrays hold no more than ``broadcast_keys`` lines, they are sent to every
    task and texts aren't shuffled. Else pages meet them by host, and a host with more than
    a thousandth of all pages is dealt over several tasks, each with its array.
    """
    found = cut(boilerplate_lines(pages, host, text, ratio, min_pages))
    own_host, keys, salt, row = fresh(pages, "host_", "keys_", "salt_", "row_")
    arrays = found.groupBy(F.col("host").alias(own_host)).agg(F.collect_set("line_key").alias(keys), F.first("host_pages").alias(salt))
    given = pages.withColumn(own_host, F.coalesce(F.col(host).cast("string"), F.lit("\0")))
    if found.count() <= broadcast_keys:
        joined = given.join(F.broadcast(arrays.drop(salt)), own_host, "left")
    else:
        share = max(1, pages.count() // 1000)
        arrays = arrays.withColumn(salt, F.ceil(F.col(salt) / share).cast("int"))
        hot = arrays.filter(F.col(salt) > 1).select(own_host, salt)  # a thousand hosts at most
        dealt = given.join(F.broadcast(hot), own_host, "left").withColumn(salt, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(salt)), F.lit(0)))
        joined = dealt.join(arrays.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col(salt).cast("long") - 1))), [own_host, salt], "left").drop(salt)
    lines = F.split(F.col(text), "\n")
    rest = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), _key(x))))
    done = joined.withColumn(row, F.struct(lines.alias("given"), rest.alias("rest")))
    out, n = done.drop(own_host, keys), lambda c: F.coalesce(F.size(F.col(row)[c]), F.lit(0))
    null = F.col(row)["given"].isNull()
    out = out.withColumns({text: F.array_join(F.col(row)["rest"], "\n"), "lines_in": F.when(null, 0).otherwise(n("given")), "lines_dropped": F.when(null, 0).otherwise(n("given") - n("rest"))})
    return out.select(*[c for c in pages.columns if c not in ("lines_in", "lines_dropped")], "lines_in", "lines_dropped")

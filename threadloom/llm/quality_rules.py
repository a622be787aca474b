"""Document quality rules, run as a cascade ordered by rejection per cost.

The share that each rule rejects and the time it takes are estimated on a bounded sample;
the rules then run in order of rejections per second. ``passing`` is a filter a rule, each
over counts that are made above the filter before it, so the costly counts of a document
that an earlier rule rejects are never made: the order changes the work, never the verdict.
``quality_filter`` returns all counts, and so makes them all.

Defined results: a null or empty text has zero counts and fails; documents of one very
long line or word count like any other; repeated rows get equal rows; other columns are
not read and pass through, but for ones with the names of results, which are replaced; an
empty table gives no rows (its rules keep their given order).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, fresh

SYMBOLS = "[#*$%&|<>]"


def _from(items: Column, k: int) -> Column:
    """``items`` from its k-th entry on, empty where it is shorter."""
    return F.slice(items, F.lit(k), F.greatest(F.size(items) - F.lit(k - 1), F.lit(0)))


def _windows(words: Column) -> Column:
    """A hash of each window of three words; none for fewer words."""
    pairs = F.zip_with(words, _from(words, 2), lambda a, b: F.xxhash64(a, b))
    return F.slice(F.zip_with(pairs, _from(words, 3), lambda p, c: F.xxhash64(p, c)), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def with_counts(df: DataFrame, text: str = "text", only: Iterable[str] | None = None) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words of ``text`` (null: empty), or ``only`` some of them.

    n_repeat_words are the words that lie in a three-word window which occurs twice or
    more: window hashes are sorted with their positions where any repeats, equal neighbours
    mark repeated windows, and the positions that these cover are counted once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    names = fresh(df, "parts_", "words_", "lines_", "windows_", "placed_", "at_")
    parts, words, own_lines, windows, in_order, at = names
    out = df.withColumns({parts: F.split(t, r"[\x20\x09-\x0D]"), own_lines: lines})
    out = out.withColumn(words, F.array_remove(parts, ""))
    out = out.withColumn(windows, _windows(F.col(words)))
    placed = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(in_order, F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed))
    twice = F.zip_with(in_order, _from(F.col(in_order), 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn(at, F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    covered = F.aggregate(F.zip_with(at, _from(F.col(at), 2), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(t) - F.size(parts) + 1).cast("long"),
        "n_symbols": (F.size(F.split(t, SYMBOLS)) - 1).cast("long"),
        "n_lines": F.size(own_lines).cast("long"),
        "n_dup_lines": (F.size(own_lines) - F.size(F.array_distinct(own_lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    return out.withColumns({name: counts[name] for name in counts if only is None or name in only}).drop(*names)


@dataclass(frozen=True)
class Rule:
    """``fails``: condition over counts by name; true means that the document goes."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


class _Columns(dict):
    """Counts that are columns of a table; it holds those that a rule has asked for."""

    def __missing__(self, name: str) -> Column:
        self[name] = F.col(name)
        return self[name]


RULES = (
    Rule("few_words", lambda c: c["n_words"] < 50),
    Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("long_words", lambda c: c["word_chars"] > 15 * c["n_words"]),
    Rule("repeated_lines", lambda c: 100 * c["n_dup_lines"] > 50 * c["n_lines"]),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7, text: str = "text") -> list[Rule]:
    """``rules`` by rejected rows per second, measured on about ``sample_rows`` rows of ``docs``.

    The sample is drawn by a share of the row count, so its size doesn't grow with the
    input. Only the counts that a rule reads are made when it is timed; its time is the
    shorter of two runs, less that of a job which only measures the texts.
    """
    rows = docs.count()
    if not rows:
        return list(rules)
    sample = cut(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).sample(min(1.0, sample_rows / rows), seed=seed))
    counted = with_counts(sample)

    def run(fails: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = counted.agg(F.count_if(fails).alias("n")).first()["n"]
        return time.perf_counter() - began, hit

    idle = [run(F.length("text") < 0)[0] for _ in range(3)]
    rated = []
    for at, rule in enumerate(rules):
        took, hit = min(run(rule.fails(_Columns())) for _ in range(2))
        rated.append((-hit / max(took - min(idle), 1e-3), at))
    return [rules[at] for _, at in sorted(rated)]


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule in the given order that a row with counts fails, null for none."""
    out = F
    for rule in rules:
        out = out.when(rule.fails(_Columns()), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def not_failing(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass all rules, one after the other: each makes its counts only for what the earlier ones left.

    A filter must stay above its own counts and below the next: it isn't pushed past a
    column that each run may number anew.
    """
    left, counts = docs.select(F.struct(*docs.columns).alias("whole"), F.col(text).alias("text")), _Columns()
    for rule in rules:
        made = {*counts}
        passes = ~rule.fails(counts)
        counted = with_counts(left, only=counts.keys() - made).withColumn("row", F.monotonically_increasing_id())
        left = counted.filter(passes & (F.col("row") >= 0)).select("whole", "text", *counts)
    return left.select("whole.*")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects; rules run in order of rejections per second."""
    return not_failing(docs, order_rules(docs, rules, sample_rows, text=text), text)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with the counts, ``base_failed`` (first two rules) and ``kept`` (no rule fails)."""
    ordered = order_rules(docs, rules, sample_rows)
    base = RULES[0].fails(_Columns()) | RULES[1].fails(_Columns())
    # A filter on ``kept`` must stay above the counts: pushed below them, it would compute them
    # over and over. It isn't pushed past a column that each run may number anew.
    [row] = fresh(docs, "row_")
    counted = with_counts(docs).withColumn(row, F.monotonically_increasing_id())
    kept = ~base & cascade(ordered).isNull() & (F.col(row) >= 0)
    return counted.withColumns({"base_failed": base, "kept": kept}).drop(row)

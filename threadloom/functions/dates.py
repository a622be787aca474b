"""Date and time expressions. All times are UTC; weeks start on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of(ms: Column) -> Column:
    """Date of an epoch in milliseconds."""
    return F.to_date(F.timestamp_millis(ms))


def period_start(date: Column, grain: str) -> Column:
    """First day of the date's day, week or month."""
    return date if grain == "day" else F.to_date(F.date_trunc(grain, date))


def iso_week_label(date: Column) -> Column:
    """ISO year and week, as 2025-W01 for 2024-12-30."""
    return F.format_string("%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), date), F.weekofyear(date))


def calendar_week_label(date: Column) -> Column:
    """Calendar year and ISO week, as 2024-W01 for 2024-12-30."""
    return F.format_string("%04d-W%02d", F.year(date), F.weekofyear(date))


def period_label(date: Column, grain: str) -> Column:
    """Label of a period's first day: 2024-03-05, 2024-W10 (calendar year) or 2024-03."""
    return {"day": F.date_format(date, "yyyy-MM-dd"), "week": calendar_week_label(date), "month": F.date_format(date, "yyyy-MM")}[grain]


def month_grain(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_first(month: Column) -> Column:
    """First day of a text month, null for anything else."""
    return F.to_date(F.when(month.rlike(r"^\d{4}-\d{2}$"), F.concat(month, F.lit("-01"))))


def month_last(month: Column) -> Column:
    return F.last_day(month_first(month))


def to_millis(iso: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 text with Z or an offset, null if it is none."""
    return F.unix_millis(F.try_to_timestamp(iso))


def seconds_or_millis(ts: Column) -> Column:
    """Milliseconds of an epoch that may be in seconds (below 10**10)."""
    return F.when(ts < 10_000_000_000, ts * 1000).otherwise(ts)


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM:SS or MM:SS, null for anything else."""
    p = F.split(text, ":")
    three = F.element_at(p, 1).cast("int") * 3600 + F.element_at(p, 2).cast("int") * 60 + F.element_at(p, 3).cast("int")
    two = F.element_at(p, 1).cast("int") * 60 + F.element_at(p, 2).cast("int")
    return F.when(text.rlike(r"^\d+:\d{1,2}:\d{1,2}$"), three).when(text.rlike(r"^\d+:\d{1,2}$"), two)


def duration_seconds(text: Column) -> Column:
    """Seconds of a clock time or of an ISO duration such as PT1H2M3S."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(r"^PT(\d+H)?(\d+M)?(\d+S)?$"), part("H") * 3600 + part("M") * 60 + part("S")).otherwise(clock_seconds(text))

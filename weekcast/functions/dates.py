"""Saturday-week arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weekcast.constants import GRID_ANCHOR, GRID_WEEKS, NEWS_MONTHS


def saturday_of(day: Column) -> Column:
    """Saturday that ends the Sunday-to-Saturday week holding ``day``."""
    return F.date_add(day, F.lit(7) - F.dayofweek(day))


def is_saturday(day: Column) -> Column:
    return F.dayofweek(day) == 7


def is_sunday(day: Column) -> Column:
    return F.dayofweek(day) == 1


def week_number(day: Column) -> Column:
    """Whole weeks since the anchor Saturday."""
    return F.floor(F.datediff(day, F.lit(GRID_ANCHOR)) / 7).cast("int")


def on_grid(day: Column, step: int = GRID_WEEKS) -> Column:
    """True on the global every-``step``-weeks calendar, whatever a history's start."""
    return F.pmod(week_number(day), F.lit(step)) == 0


def add_weeks(day: Column, weeks: Column | int) -> Column:
    weeks = weeks if isinstance(weeks, Column) else F.lit(weeks)
    return F.date_add(day, weeks * 7)


def strict_date(text: Column) -> Column:
    """ISO calendar date, or NULL unless the text is exactly ``yyyy-MM-dd``."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def compact_date(label: Column) -> Column:
    """``yyyyMMdd`` label to DATE, NULL when it is not a real day."""
    return F.when(label.rlike(r"^\d{8}$"), F.try_to_date(label, "yyyyMMdd"))


def epoch_ms_date(ms: Column) -> Column:
    """UTC day of an epoch-milliseconds value, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))


def window_start(as_of: Column, months: int = NEWS_MONTHS) -> Column:
    """First day of the trailing calendar-month window; month ends are clipped."""
    return F.add_months(as_of, -months)

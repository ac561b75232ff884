"""Weekly panel: cleaning, week alignment, gap filling and the lagged trend join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.functions.dates import is_sunday
from weekcast.functions.numeric import finite, non_negative, positive, within_percent

PANEL_MEASURES = ("searches", "rank", "google_trend")


def clean_measures(panel: DataFrame) -> DataFrame:
    """Invalid searches, ranks and trend values become NULL, never zero."""
    rules = {"searches": non_negative, "rank": positive, "google_trend": within_percent}
    present = {name: rule(F.col(name)) for name, rule in rules.items() if name in panel.columns}
    return panel.withColumns(present)


def completed_weeks(panel: DataFrame, as_of: Column) -> DataFrame:
    """Weeks that ended strictly before ``as_of``."""
    return panel.filter(F.col("week_end") < as_of)


def gap_fill(panel: DataFrame, measures: Sequence[str] = PANEL_MEASURES) -> DataFrame:
    """Every Saturday between an ingredient's first and last week; new rows have NULL measures.

    Each row produces its own week and the missing ones up to the next row, so the calendar needs no
    join. The shuffle by ingredient is the one the feature windows use again. Weeks are unique per
    ingredient, which bounds a window partition by the calendar.
    """
    kept = [m for m in measures if m in panel.columns]
    by_week = Window.partitionBy("ingredient_id").orderBy("week_end")
    last_own = F.greatest(
        F.coalesce(F.date_sub(F.lead("week_end").over(by_week), 7), F.col("week_end")), F.col("week_end")
    )
    spans = panel.withColumn("_last_own", last_own)
    weeks = F.explode(F.sequence("week_end", "_last_own", F.expr("interval 7 days")))
    spread = spans.withColumn("_week", weeks)
    own = F.col("_week") == F.col("week_end")
    filled = spread.withColumns({m: F.when(own, F.col(m)) for m in kept})
    return filled.withColumn("week_end", F.col("_week")).select(*panel.columns)


def lag_trend(trend: DataFrame, as_of: Column, lag_weeks: int = 1) -> DataFrame:
    """Trend weeks completed before ``as_of``, then moved ``lag_weeks`` later."""
    return completed_weeks(trend, as_of).withColumn("week_end", F.date_add("week_end", 7 * lag_weeks))


def align(amazon: DataFrame, trend: DataFrame) -> DataFrame:
    """Gap-filled panel with its (already lagged) trend, in one shuffle.

    Both sources are stacked, laid out by ingredient and reduced per week; windows then cut the weeks
    outside the Amazon history and fill the missing ones. The feature windows use the same layout.
    Each source holds a week at most once, so the maximum just picks its value, and an ingredient
    never has more rows than twice its weeks.
    """
    ours = amazon.select("ingredient_id", "week_end", "searches", "rank", F.lit(True).alias("_own"))
    theirs = trend.select("ingredient_id", "week_end", F.col("value").alias("google_trend"))
    weekly = (
        ours.unionByName(theirs, allowMissingColumns=True)
        .repartition("ingredient_id")
        .groupBy("ingredient_id", "week_end")
        .agg(*[F.max(c).alias(c) for c in (*PANEL_MEASURES, "_own")])
    )
    whole = (
        Window.partitionBy("ingredient_id")
        .orderBy("week_end")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    own_week = F.when(F.col("_own"), F.col("week_end"))
    inside = weekly.withColumns({"_lo": F.min(own_week).over(whole), "_hi": F.max(own_week).over(whole)}).filter(
        "week_end between _lo and _hi"
    )
    return gap_fill(inside.drop("_lo", "_hi", "_own"))


def value_quality(raw: DataFrame) -> DataFrame:
    """Per ingredient: how many raw searches and ranks are not usable numbers."""
    return raw.groupBy("ingredient_id").agg(
        F.count_if(non_negative(F.col("searches")).isNull()).alias("invalid_search_values"),
        F.count_if(positive(F.col("rank")).isNull()).alias("invalid_rank_values"),
        F.count_if(finite(F.col("searches")).isNull()).alias("non_numeric_search_values"),
    )


def panel_quality(panel: DataFrame) -> DataFrame:
    """Per ingredient of a gap-filled panel: weeks, missing values, first and last week."""
    return panel.groupBy("ingredient_id").agg(
        F.count("*").alias("weeks"),
        F.count_if(F.col("searches").isNull()).alias("missing_amazon"),
        F.count_if(F.col("google_trend").isNull()).alias("missing_google"),
        F.min("week_end").alias("first_week"),
        F.max("week_end").alias("last_week"),
    )

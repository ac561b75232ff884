"""Past-only features, seasonal values and forward targets as window expressions.

Three base means (4, 13 and 26 weeks) are framed once; every other average is one of them read some
weeks earlier or later. All windows share one partitioning and order: one shuffle, one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.constants import HORIZONS, MIN_HISTORY
from weekcast.functions.dates import add_weeks, week_number
from weekcast.functions.hashing import is_heldout

KEYS = ("ingredient_id", "family_id", "week_end")


def _log_gap(recent: Column, older: Column) -> Column:
    return F.log1p(recent) - F.log1p(older)


def weekly_features(panel: DataFrame) -> DataFrame:
    """One row per ingredient and week of a gap-filled panel, ``eligible`` or not.

    ``eligible``: at least 104 weeks of history, all of the last 104 observed. Feature columns are
    meaningful on eligible rows; ``baseline`` is the complete 13-week mean wherever there is one.
    """
    by_week = Window.partitionBy("ingredient_id").orderBy("week_end")

    def last(weeks: int) -> Window:
        return by_week.rowsBetween(1 - weeks, Window.currentRow)

    past = by_week.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    searches, trend, strength = F.col("searches"), F.col("google_trend"), -F.ln("rank")
    framed = (
        panel.select(*KEYS, "searches", "rank", "google_trend")
        .withColumn("_week", week_number(F.col("week_end")))
        .withColumns(
            {
                "_first": F.min("_week").over(past),
                "_hole": F.max(F.when(searches.isNull(), F.col("_week"))).over(past),
                "_mean4": F.avg(searches).over(last(4)),
                "_mean13": F.when(F.count(searches).over(last(13)) == 13, F.avg(searches).over(last(13))),
                "_mean26": F.when(F.count(searches).over(last(26)) == 26, F.avg(searches).over(last(26))),
                "volatility": F.stddev_pop(F.log1p(searches)).over(last(26)),
                "_trend4": F.avg(trend).over(last(4)),
                "_trend13": F.avg(trend).over(last(13)),
                "_trend4_n": F.count(trend).over(last(4)),
                "_trend13_n": F.count(trend).over(last(13)),
                "_strength13": F.avg(strength).over(last(13)),
                "_strength13_n": F.count(strength).over(last(13)),
            }
        )
    )

    def earlier(column: str, weeks: int) -> Column:
        return F.lag(column, weeks).over(by_week)

    shifted = framed.withColumns(
        {
            "_mean13_prior": earlier("_mean13", 13),
            "_mean26_prior": earlier("_mean26", 26),
            "_mean13_year": earlier("_mean13", 52),
            "_trend13_prior": earlier("_trend13", 13),
            "_trend13_prior_n": earlier("_trend13_n", 13),
            "_strength13_prior": earlier("_strength13", 13),
            "_strength13_prior_n": earlier("_strength13_n", 13),
            # Same calendar weeks a year ago: they end 52-h weeks before the origin.
            **{f"seasonal_{h}": earlier(f"_mean{h}", 52 - h) for h in HORIZONS},
            **{f"target_{h}": F.lead(f"_mean{h}", h).over(by_week) for h in HORIZONS},
        }
    )
    gate_start = F.col("_week") - (MIN_HISTORY - 1)
    eligible = (F.col("_first") <= gate_start) & (F.col("_hole").isNull() | (F.col("_hole") < gate_start))
    google_ok = (F.col("_trend4_n") >= 3) & (F.col("_trend13_n") >= 10) & (F.col("_trend13_prior_n") >= 10)
    rank_ok = (F.col("_strength13_n") >= 10) & (F.col("_strength13_prior_n") >= 10)
    return shifted.select(
        "ingredient_id",
        "family_id",
        F.col("week_end").alias("origin"),
        eligible.alias("eligible"),
        is_heldout(F.col("family_id")).alias("heldout"),
        F.col("_mean13").alias("baseline"),
        F.log1p("_mean13").alias("level_log"),
        _log_gap(F.col("_mean4"), F.col("_mean13")).alias("short_momentum"),
        _log_gap(F.col("_mean13"), F.col("_mean13_prior")).alias("quarter_momentum"),
        _log_gap(F.col("_mean26"), F.col("_mean26_prior")).alias("halfyear_momentum"),
        _log_gap(F.col("_mean13"), F.col("_mean13_year")).alias("seasonal_momentum"),
        "volatility",
        F.coalesce(google_ok, F.lit(False)).alias("google_available"),
        F.when(google_ok, F.log1p("_trend13")).alias("google_level"),
        F.when(google_ok, _log_gap(F.col("_trend4"), F.col("_trend13"))).alias("google_short"),
        F.when(google_ok, _log_gap(F.col("_trend13"), F.col("_trend13_prior"))).alias("google_quarter"),
        F.coalesce(rank_ok, F.lit(False)).alias("rank_available"),
        F.when(rank_ok, F.col("_strength13")).alias("rank_log"),
        F.when(rank_ok, F.col("_strength13") - F.col("_strength13_prior")).alias("rank_momentum"),
        *[F.col(f"seasonal_{h}") for h in HORIZONS],
        *[F.col(f"target_{h}") for h in HORIZONS],
        *[add_weeks(F.col("week_end"), h).alias(f"target_end_{h}") for h in HORIZONS],
    )


def samples(features: DataFrame) -> DataFrame:
    """Feature rows that pass the history gate."""
    return features.filter("eligible").drop("eligible")

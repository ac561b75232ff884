"""Small, shareable summaries of a run, without its weekly history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def history_bounds(panel: DataFrame) -> DataFrame:
    """Shortest and longest history, first and last week over all ingredients."""
    per = panel.groupBy("ingredient_id").agg(
        F.count("*").alias("weeks"), F.min("week_end").alias("first"), F.max("week_end").alias("last")
    )
    return per.agg(
        F.coalesce(F.min("weeks"), F.lit(0)).alias("minimum_weeks"),
        F.coalesce(F.max("weeks"), F.lit(0)).alias("maximum_weeks"),
        F.min("first").alias("earliest_week"),
        F.max("last").alias("latest_week"),
        F.count("*").alias("ingredient_count"),
    )


def backtest_counts(backtests: DataFrame) -> DataFrame:
    return backtests.groupBy("horizon_weeks", "split", "model").agg(F.count("*").alias("n"))


def source_counts(provenance: DataFrame, quality: DataFrame) -> DataFrame:
    """Ingredients per provider: the run's own counts, or the quality rows counted when it has none.

    ``provenance``: provider, n (may be empty). ``quality``: amazon_source, amazon_provider.
    """
    own = provenance.groupBy("provider").agg(F.sum("n").alias("n"))
    provider = F.coalesce(F.nullif("amazon_source", F.lit("")), F.nullif("amazon_provider", F.lit("")))
    counted = quality.select(provider.alias("provider")).filter("provider is not null").groupBy("provider").agg(F.count("*").alias("n"))
    has_own = own.agg((F.count("*") > 0).alias("h")).scalar()
    return own.unionByName(counted.filter(~has_own))


def audit_summary(panel: DataFrame, analysis) -> dict[str, DataFrame]:
    """Tables that describe a run: bounds, sources, counts, selection and ablations."""
    providers = panel.groupBy("amazon_provider").agg(F.countDistinct("ingredient_id").alias("n")).select(
        F.col("amazon_provider").alias("provider"), "n"
    )
    return {
        "history": history_bounds(panel),
        "source_counts": providers,
        "backtest_counts": backtest_counts(analysis.long),
        "selected_models": analysis.selected,
        "paired_feature_comparisons": analysis.ablations,
    }

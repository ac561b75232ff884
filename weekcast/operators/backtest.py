"""Candidate predictions and the walk-forward backtest as one join-and-project plan.

Backtests are kept wide (one row per case, one column per model) until output: two models are
compared on matched cases by testing two columns for NULL, without self joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import (
    BASELINE,
    FEATURES,
    HORIZONS,
    MIN_HISTORY,
    MODELS,
    RIDGE_MODELS,
    SEALED_WEEKS,
)
from weekcast.functions.dates import add_weeks, on_grid
from weekcast.functions.numeric import from_log_shift
from weekcast.operators.moments import needs
from weekcast.operators.ridge import coefficient_table

CASE_KEYS = ["ingredient_id", "family_id", "origin", "target_end", "horizon_weeks"]
PREDICTIONS = {model: f"p_{model}" for model in MODELS}


def panel_bounds(panel: DataFrame) -> DataFrame:
    """One row: first week, as-of week and the first week of the sealed test."""
    return panel.agg(F.min("week_end").alias("first_week"), F.max("week_end").alias("as_of")).withColumn(
        "test_start", add_weeks(F.col("as_of"), -SEALED_WEEKS)
    )


def evaluation_origins(bounds: DataFrame) -> DataFrame:
    """Every fourth Saturday of the global calendar on which some target is already complete."""
    start = add_weeks(F.col("first_week"), MIN_HISTORY + max(HORIZONS) - 1)
    end = add_weeks(F.col("as_of"), -min(HORIZONS))
    weeks = F.when(start <= end, F.sequence(start, end, F.expr("interval 7 days")))
    return (
        bounds.select("as_of", "test_start", F.explode(weeks).alias("origin"))
        .filter(on_grid(F.col("origin")))
        .select("origin", "as_of", "test_start")
    )


def split_of(origin: Column, target_end: Column, test_start: Column) -> Column:
    """validation / sealed_test; NULL for windows that straddle the sealed boundary."""
    return F.when(target_end <= test_start, "validation").when(origin >= test_start, "sealed_test")


def evaluation_cases(samples: DataFrame, origins: DataFrame) -> DataFrame:
    """Samples at evaluation origins with a complete target, one row per horizon, with their split."""
    per_horizon = ", ".join(f"{h}, target_{h}, target_end_{h}, seasonal_{h}" for h in HORIZONS)
    # Origins: one row per four weeks of the calendar, hence always small.
    on_calendar = samples.join(F.broadcast(origins), "origin")
    return (
        on_calendar.select(
            "ingredient_id",
            "family_id",
            "heldout",
            "origin",
            "as_of",
            "test_start",
            "baseline",
            "google_available",
            "rank_available",
            *FEATURES,
            F.expr(f"stack({len(HORIZONS)}, {per_horizon}) as (horizon_weeks, actual, target_end, seasonal)"),
        )
        .filter("actual is not null and target_end <= as_of")
        .withColumn("_split", split_of(F.col("origin"), F.col("target_end"), F.col("test_start")))
        .filter("_split is not null")
        .withColumn("split", F.when(F.col("heldout"), F.concat(F.lit("group_"), "_split")).otherwise(F.col("_split")))
        .drop("_split", "as_of", "test_start")
    )


def ridge_prediction(model: str) -> Column:
    fit = F.col(f"fit_{model}")
    delta = fit["bias"]
    for i, name in enumerate(FEATURES):
        if name in RIDGE_MODELS[model]:
            delta = delta + fit["weights"][i] * F.col(name)
    return F.when(needs(model), from_log_shift(F.col("baseline"), delta))


def predict(cases: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Add one prediction column per model; NULL where the model cannot predict the case.

    The coefficient table has one row per (origin, horizon): it grows with the calendar only, and a
    join on those few keys would otherwise send a whole origin to one task. Hence the broadcast.
    """
    joined = cases.join(F.broadcast(coefficients), ["origin", "horizon_weeks"], "left")
    return joined.withColumns(
        {
            PREDICTIONS[BASELINE]: F.col("baseline"),
            PREDICTIONS["seasonal"]: F.col("seasonal"),
            **{PREDICTIONS[model]: ridge_prediction(model) for model in RIDGE_MODELS},
        }
    ).drop(*[f"fit_{model}" for model in RIDGE_MODELS])


def walk_forward(samples: DataFrame, origins: DataFrame, fits: DataFrame) -> DataFrame:
    """Wide backtest: one row per case with the predictions of every model available for it."""
    cases = evaluation_cases(samples, origins)
    return predict(cases, coefficient_table(fits, "backtest")).select(
        *CASE_KEYS, "heldout", "split", "actual", "baseline", *PREDICTIONS.values()
    )


def naive_walk_forward(samples: DataFrame, origins: DataFrame) -> DataFrame:
    """Wide backtest of the two baselines alone; the ridge columns are NULL."""
    nothing = {PREDICTIONS[model]: F.lit(None).cast("double") for model in RIDGE_MODELS}
    cases = evaluation_cases(samples, origins)
    return cases.withColumns(
        {PREDICTIONS[BASELINE]: F.col("baseline"), PREDICTIONS["seasonal"]: F.col("seasonal"), **nothing}
    ).select(*CASE_KEYS, "heldout", "split", "actual", "baseline", *PREDICTIONS.values())


def to_long(wide: DataFrame) -> DataFrame:
    """One row per case and model that predicted it."""
    pairs = ", ".join(f"'{model}', {column}" for model, column in PREDICTIONS.items())
    others = [c for c in wide.columns if c not in PREDICTIONS.values()]
    return wide.select(
        *others, F.expr(f"stack({len(PREDICTIONS)}, {pairs}) as (model, predicted)")
    ).filter("predicted is not null")


def to_wide(long: DataFrame) -> DataFrame:
    """One row per case from long backtest rows (keys, actual, baseline, model, predicted)."""
    keys = [c for c in (*CASE_KEYS, "heldout", "split") if c in long.columns]
    return long.groupBy(*keys).agg(
        F.max("actual").alias("actual"),
        F.max("baseline").alias("baseline"),
        *[F.max(F.when(F.col("model") == m, F.col("predicted"))).alias(c) for m, c in PREDICTIONS.items()],
    )

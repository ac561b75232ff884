"""Deployment forecasts, displayed backtests, diagnostics, flags and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import BASELINE, CACHE_DAYS, HORIZONS, VENDOR_B
from weekcast.functions.hashing import is_heldout
from weekcast.operators.backtest import CASE_KEYS, PREDICTIONS, predict
from weekcast.operators.evaluate import interval
from weekcast.operators.ridge import coefficient_table


def chosen_prediction(chosen: Column) -> tuple[Column, Column]:
    """(model, prediction) of the chosen model, or of the baseline where it cannot predict."""
    value = F.coalesce(*[F.when(chosen == m, F.col(c)) for m, c in PREDICTIONS.items()])
    return (
        F.when(value.isNotNull(), chosen).otherwise(F.lit(BASELINE)),
        F.coalesce(value, F.col(PREDICTIONS[BASELINE])),
    )


def forecasts(
    panel: DataFrame,
    features: DataFrame,
    bounds: DataFrame,
    fits: DataFrame,
    selected: DataFrame,
    calibrated: DataFrame,
) -> DataFrame:
    """One row per ingredient and horizon at the as-of week.

    Eligible ingredients get the chosen model (else the baseline); the others get the plain 13-week
    mean if their last 13 weeks are complete, else no prediction.
    """
    as_of = bounds.select("as_of").scalar()
    current = features.filter(F.col("origin") == as_of).drop("heldout", "family_id")
    everyone = panel.groupBy("ingredient_id").agg(F.min("family_id").alias("family_id"))
    per_horizon = ", ".join(f"{h}, seasonal_{h}" for h in HORIZONS)
    cases = everyone.join(current, "ingredient_id", "left").select(
        "*", F.expr(f"stack({len(HORIZONS)}, {per_horizon}) as (horizon_weeks, seasonal)")
    )
    # Three tables of one row per (origin,) horizon (, model): all bounded by constants.
    rated = predict(cases, coefficient_table(fits, "deploy").filter(F.col("origin") == as_of)).join(
        F.broadcast(selected.select("horizon_weeks", F.col("model").alias("chosen"))), "horizon_weeks", "left"
    )
    eligible = F.coalesce(F.col("eligible"), F.lit(False))
    chosen = F.coalesce("chosen", F.lit(BASELINE))
    model, value = chosen_prediction(chosen)
    picked = rated.select(
        "ingredient_id",
        "family_id",
        "horizon_weeks",
        "baseline",
        eligible.alias("eligible"),
        chosen.alias("chosen"),
        F.when(eligible, model).when(F.col("baseline").isNotNull(), BASELINE).alias("model"),
        F.when(eligible, value).otherwise(F.col("baseline")).alias("predicted_mean"),
    )
    ranges = F.broadcast(
        calibrated.select("horizon_weeks", "model", F.col("n").alias("_n"), "low", "high")
    )
    lower, upper = interval(F.col("predicted_mean"), F.col("low"), F.col("high"))
    eligible = F.col("eligible")
    simple = ~eligible & F.col("baseline").isNotNull()
    growth = F.when(F.col("baseline") > 0, (F.col("predicted_mean") / F.col("baseline") - 1) * 100)
    return picked.join(ranges, ["horizon_weeks", "model"], "left").select(
        "ingredient_id",
        "family_id",
        "horizon_weeks",
        "baseline",
        "predicted_mean",
        growth.alias("growth_pct"),
        F.when(eligible, lower).alias("lower"),
        F.when(eligible, upper).alias("upper"),
        "model",
        F.when(eligible & (F.col("model") != BASELINE), "ok")
        .when(F.col("model").isNotNull(), "baseline_only")
        .otherwise("insufficient_data")
        .alias("status"),
        F.when(eligible, F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("n_calibration"),
        F.when(eligible & F.col("low").isNotNull(), "empirical_80pct")
        .when(eligible, "insufficient_calibration")
        .when(simple, "insufficient_history")
        .alias("interval_status"),
        F.when(eligible & (F.col("chosen") != F.col("model")), "selected_model_unavailable")
        .when(simple, "requires_104_complete_weeks_for_model")
        .alias("fallback_reason"),
    )


def displayed_backtests(wide: DataFrame, selected: DataFrame) -> DataFrame:
    """Per ingredient, horizon and origin: the chosen model's row, else the baseline's."""
    chosen = F.broadcast(selected.select("horizon_weeks", F.col("model").alias("chosen")))  # one row per horizon
    model, value = chosen_prediction(F.col("chosen"))
    return wide.join(chosen, "horizon_weeks").select(
        *CASE_KEYS, "split", model.alias("model"), "actual", value.alias("predicted"), "baseline"
    )


def ingredient_diagnostics(panel: DataFrame, features: DataFrame, bounds: DataFrame) -> DataFrame:
    """History counts per ingredient and whether it can be forecast at the as-of week."""
    as_of = bounds.select("as_of").scalar()
    counts = panel.groupBy("ingredient_id").agg(
        F.min("family_id").alias("family_id"),
        F.min("amazon_provider").alias("amazon_provider"),
        F.count("*").alias("history_weeks"),
        F.count("searches").alias("observed_weeks"),
        F.count_if(F.col("searches").isNull()).alias("missing_weeks"),
        F.count("google_trend").alias("google_weeks"),
        F.count("rank").alias("rank_weeks"),
        F.max("week_end").alias("latest_week"),
    )
    ready = features.filter((F.col("origin") == as_of) & F.col("eligible")).select(
        "ingredient_id", F.lit(True).alias("_ready")
    )
    return (
        counts.withColumn("heldout", is_heldout(F.col("family_id")))
        .join(ready, "ingredient_id", "left")
        .withColumn("as_of_eligible", F.coalesce("_ready", F.lit(False)))
        .drop("_ready")
    )


def missing_ingredients(catalog: DataFrame, panel: DataFrame) -> DataFrame:
    """Placeholder rows for selected catalog entries without any history."""
    present = panel.select(F.col("ingredient_id").alias("id")).distinct()
    absent = catalog.filter("selected").join(present, "id", "left_anti")
    return absent.select(
        F.col("id").alias("ingredient_id"),
        F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon_weeks"),
        F.lit("insufficient_data").alias("status"),
        F.lit("no_source_data").alias("reason"),
        F.lit(0).cast("bigint").alias("history_weeks"),
    )


def decision_flags(forecast_rows: DataFrame, audit: DataFrame) -> DataFrame:
    """``has_proven_gain``: the chosen model beat the baseline on sealed cases and is in use here."""
    errors = F.broadcast(audit.select("horizon_weeks", "model_wape", "baseline_wape"))  # one row per horizon
    gain = (F.col("model_wape") < F.col("baseline_wape")) & (F.col("model") != BASELINE)
    return (
        forecast_rows.join(errors, "horizon_weeks", "left")
        .withColumn("has_proven_gain", F.coalesce(gain, F.lit(False)))
        .drop("model_wape", "baseline_wape")
    )


def analysis_warnings(
    panel: DataFrame, wide: DataFrame, audit: DataFrame, report_as_of: Column
) -> DataFrame:
    """Warning codes of a run, one row each."""
    newest = panel.agg(F.max("week_end").alias("as_of"), F.min("amazon_provider").alias("provider"))
    stale = newest.filter(F.datediff(report_as_of, "as_of") > CACHE_DAYS).select(
        F.lit("stale_data").alias("code"), F.datediff(report_as_of, "as_of").cast("string").alias("detail")
    )
    second = newest.filter(F.col("provider") == VENDOR_B).select(
        F.lit("secondary_provider_scale").alias("code"), F.col("provider").alias("detail")
    )
    empty = wide.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("no_backtests").alias("code"), F.lit(None).cast("string").alias("detail")
    )
    no_holdout = (
        panel.agg(F.bool_or(is_heldout(F.col("family_id"))).alias("any_heldout"))
        .filter("any_heldout = false")
        .select(F.lit("no_heldout_family").alias("code"), F.lit(None).cast("string").alias("detail"))
    )
    failed = audit.filter("failed_sealed_test").select(
        F.lit("chosen_model_failed_sealed_test").alias("code"),
        F.concat_ws(":", F.col("horizon_weeks").cast("string"), "chosen").alias("detail"),
    )
    return stale.unionByName(second).unionByName(empty).unionByName(no_holdout).unionByName(failed)

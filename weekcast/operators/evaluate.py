"""Metrics, matched-case comparisons, model selection, calibration and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import (
    ABLATIONS,
    BASELINE,
    HORIZONS,
    INTERVAL_QUANTILES,
    MIN_CALIBRATION,
    MIN_SELECTION_CASES,
    MIN_SELECTION_ORIGINS,
    MODELS,
    SEALED_SPLITS,
    SELECTION_GATE,
)
from weekcast.functions.numeric import direction, from_log_shift, ratio
from weekcast.operators.backtest import PREDICTIONS, to_long
from weekcast.operators.scale import exact_quantiles

METRICS = ("n", "n_origins", "mae", "wape", "rmse", "direction_accuracy", "interval_coverage", "n_intervals")


def metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error metrics of long backtest rows per group.

    Groups are few and may be arbitrarily large; rows are combined map-side per (group, origin) first.
    """
    error = F.abs(F.col("actual") - F.col("predicted"))
    hit = direction(F.col("actual"), F.col("baseline")) == direction(F.col("predicted"), F.col("baseline"))
    bounded = (F.col("lower").isNotNull() & F.col("upper").isNotNull()) if "lower" in rows.columns else F.lit(False)
    inside = (F.col("actual").between(F.col("lower"), F.col("upper"))) if "lower" in rows.columns else F.lit(False)
    per_origin = rows.groupBy(*keys, "origin").agg(
        F.count("*").alias("_n"),
        F.sum(error).alias("_abs"),
        F.sum(F.abs("actual")).alias("_actual"),
        F.sum(error * error).alias("_square"),
        F.count_if(hit).alias("_hits"),
        F.count_if(bounded).alias("_bounded"),
        F.count_if(bounded & inside).alias("_inside"),
    )
    total = per_origin.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.count("*").alias("n_origins"),
        *[F.sum(c).alias(c) for c in ("_abs", "_actual", "_square", "_hits", "_bounded", "_inside")],
    )
    return total.select(
        *keys,
        "n",
        "n_origins",
        (F.col("_abs") / F.col("n")).alias("mae"),
        ratio(F.col("_abs"), F.col("_actual")).alias("wape"),
        F.sqrt(F.col("_square") / F.col("n")).alias("rmse"),
        (F.col("_hits") / F.col("n")).alias("direction_accuracy"),
        ratio(F.col("_inside"), F.col("_bounded")).alias("interval_coverage"),
        F.col("_bounded").alias("n_intervals"),
    )


def metric_summary(long: DataFrame) -> DataFrame:
    return metrics(long, ["horizon_weeks", "split", "model"])


def ablations(wide: DataFrame) -> DataFrame:
    """Each pair of models scored on exactly the cases both predicted."""
    parts = []
    for name, (first, second) in ABLATIONS.items():
        both = F.col(PREDICTIONS[first]).isNotNull() & F.col(PREDICTIONS[second]).isNotNull()
        for model in (first, second):
            parts.append(
                F.when(
                    both,
                    F.struct(
                        F.lit(name).alias("comparison"),
                        F.lit(model).alias("model"),
                        F.col(PREDICTIONS[model]).alias("predicted"),
                    ),
                )
            )
    matched = wide.select(
        "horizon_weeks",
        "split",
        "origin",
        "actual",
        "baseline",
        F.explode(F.filter(F.array(*parts), lambda part: part.isNotNull())).alias("_part"),
    ).select("horizon_weeks", "split", "origin", "actual", "baseline", "_part.*")
    return metrics(matched, ["horizon_weeks", "split", "comparison", "model"])


def _all_models() -> Column:
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(h).alias("horizon_weeks"), F.lit(i).alias("model_order"), F.lit(m).alias("model"))
                for h in HORIZONS
                for i, m in enumerate(MODELS)
            ]
        )
    )


def model_grid(anchor: DataFrame) -> DataFrame:
    """All (horizon, model) pairs in fixed model order (12 rows)."""
    return anchor.sparkSession.range(1).select(_all_models().alias("_m")).select("_m.*")


def selection_comparison(wide: DataFrame, required: str = "ridge_amazon") -> DataFrame:
    """Every model on the common validation cases, with coverage and eligibility.

    Common cases of a horizon are those ``required`` predicted or, if it predicted none, all cases.
    Both sets are aggregated in one pass and the right one is kept.
    """
    validation = wide.filter(F.col("split") == "validation")
    has_required = F.col(PREDICTIONS[required]).isNotNull()
    sets = F.when(has_required, F.array(F.lit("all"), F.lit("common"))).otherwise(F.array(F.lit("all")))
    long = to_long(validation.withColumn("case_set", sets)).withColumn("case_set", F.explode("case_set"))
    scored = metrics(long, ["horizon_weeks", "case_set", "model"])
    size = scored.filter(F.col("model") == BASELINE).select(
        "horizon_weeks",
        "case_set",
        F.col("n").alias("n_cases"),
        F.col("n_origins").alias("case_origins"),
        F.col("wape").alias("baseline_wape"),
    )
    used = size.groupBy("horizon_weeks").agg(
        F.max_by(F.struct("case_set", "n_cases", "case_origins", "baseline_wape"), "case_set").alias("_used")
    ).select("horizon_weeks", "_used.*")
    # At most 12 rows from here on.
    grid = model_grid(wide).join(used, "horizon_weeks", "left")
    full = grid.join(
        scored.drop("n_intervals", "interval_coverage"), ["horizon_weeks", "case_set", "model"], "left"
    )
    enough = (
        (F.col("n_cases") >= MIN_SELECTION_CASES)
        & (F.col("case_origins") >= MIN_SELECTION_ORIGINS)
        & F.col("baseline_wape").isNotNull()
    )
    n = F.coalesce("n", F.lit(0))
    return full.select(
        "horizon_weeks",
        "model",
        "model_order",
        F.lit("validation").alias("split"),
        F.lit("selection_common_cases").alias("comparison"),
        F.coalesce(enough & (n == F.col("n_cases")), F.lit(False)).alias("eligible_for_selection"),
        F.coalesce(n / F.col("n_cases"), F.lit(0.0)).alias("coverage"),
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"),
        F.coalesce("case_origins", F.lit(0)).alias("n_origins"),
        "baseline_wape",
        n.alias("n"),
        "mae",
        "wape",
        "rmse",
        "direction_accuracy",
    )


def select_models(comparison: DataFrame) -> DataFrame:
    """One row per horizon: the model with the least validation WAPE past the 5 % gate, else the baseline."""
    gated = (
        F.col("eligible_for_selection")
        & (F.col("model") != BASELINE)
        & (F.col("wape") < F.col("baseline_wape"))
        & (F.col("wape") <= F.col("baseline_wape") * SELECTION_GATE)
    )
    best = F.min(F.when(gated, F.struct("wape", "model_order", "model")))
    return (
        comparison.groupBy("horizon_weeks")
        .agg(
            best.alias("_best"),
            F.max("n_cases").alias("n_cases"),
            F.max("n_origins").alias("n_origins"),
            F.max("baseline_wape").alias("baseline_wape"),
        )
        .select(
            "horizon_weeks",
            F.coalesce("_best.model", F.lit(BASELINE)).alias("model"),
            F.lit("validation").alias("selection_split"),
            "n_cases",
            "n_origins",
            "baseline_wape",
            F.coalesce("_best.wape", "baseline_wape").alias("selected_wape"),
            F.when(F.col("_best").isNotNull(), "validation_improvement").otherwise("conservative_baseline").alias("reason"),
        )
    )


def calibration(long: DataFrame) -> DataFrame:
    """Empirical 10 / 90 % quantiles of validation log residuals per (horizon, model)."""
    residuals = long.filter(F.col("split") == "validation").withColumn(
        "residual", F.log1p("actual") - F.log1p("predicted")
    )
    keys = ["horizon_weeks", "model"]
    low, high = INTERVAL_QUANTILES
    quantiles = exact_quantiles(residuals, keys, "residual", INTERVAL_QUANTILES).groupBy(*keys).agg(
        F.max(F.when(F.col("probability") == low, F.col("quantile"))).alias("low"),
        F.max(F.when(F.col("probability") == high, F.col("quantile"))).alias("high"),
    )
    counts = (
        residuals.groupBy(*keys, "origin").agg(F.count("*").alias("_n"))
        .groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("n_origins"))
    )
    enough = (F.col("n") >= MIN_CALIBRATION) & (F.col("n_origins") >= 2)
    return counts.join(quantiles, keys).select(
        *keys, "n", "n_origins", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high")
    )


def interval(prediction: Column, low: Column, high: Column) -> tuple[Column, Column]:
    return from_log_shift(prediction, low), from_log_shift(prediction, high)


def with_intervals(long: DataFrame, calibrated: DataFrame) -> DataFrame:
    """Add lower/upper to sealed rows; rows of other splits keep NULL."""
    # One row per (horizon, model): 12 at most.
    joined = long.join(
        F.broadcast(calibrated.select("horizon_weeks", "model", "low", "high")), ["horizon_weeks", "model"], "left"
    )
    lower, upper = interval(F.col("predicted"), F.col("low"), F.col("high"))
    sealed = F.col("split").isin(*SEALED_SPLITS)
    return joined.withColumn("lower", F.when(sealed, lower)).withColumn("upper", F.when(sealed, upper)).drop("low", "high")


def sealed_audit(wide: DataFrame, selected: DataFrame) -> DataFrame:
    """Chosen model against the baseline on matching sealed cases. Never used for selection."""
    chosen = F.broadcast(selected.select("horizon_weeks", F.col("model").alias("chosen")))  # one row per horizon
    prediction = F.coalesce(*[F.when(F.col("chosen") == m, F.col(c)) for m, c in PREDICTIONS.items()])
    cases = (
        wide.filter(F.col("split") == "sealed_test")
        .join(chosen, "horizon_weeks")
        .withColumn("_model", prediction)
        .filter("_model is not null")
    )
    sides = cases.select(
        "horizon_weeks", "chosen", "origin", "actual", "baseline",
        F.expr(f"stack(2, 'model', _model, 'baseline', {PREDICTIONS[BASELINE]}) as (side, predicted)"),
    )
    scored = metrics(sides, ["horizon_weeks", "chosen", "side"])

    def pick(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    per_horizon = scored.groupBy("horizon_weeks", "chosen").agg(
        pick("model", "n").alias("n_matching_cases"),
        pick("model", "wape").alias("model_wape"),
        pick("baseline", "wape").alias("baseline_wape"),
        pick("model", "mae").alias("model_mae"),
        pick("baseline", "mae").alias("baseline_mae"),
    )
    return selected.select("horizon_weeks", F.col("model").alias("chosen")).join(
        per_horizon, ["horizon_weeks", "chosen"], "left"
    ).withColumns(
        {
            "n_matching_cases": F.coalesce("n_matching_cases", F.lit(0)),
            "used_for_selection": F.lit(False),
            "failed_sealed_test": F.coalesce(
                (F.col("chosen") != BASELINE) & (F.col("model_wape") >= F.col("baseline_wape")), F.lit(False)
            ),
        }
    )

"""Walk-forward training sets as running sums of feature moments.

A ridge fit needs only counts, sums and cross products of its training rows. They are aggregated
once per label-end week (with map-side combine) and summed along the calendar, so the fits of all
origins cost one pass over the samples rather than one pass per origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.constants import FEATURES, HORIZONS, RIDGE_MODELS
from weekcast.functions.dates import on_grid

# Fixed shifts that keep sums of squares near the data's own spread; results do not depend on them.
CENTERS = {"level_log": 8.0, "rank_log": -6.0, "google_level": 3.0}

PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
X_SUMS = [f"x_{i}" for i in range(len(FEATURES))]
XX_SUMS = [f"xx_{i}_{j}" for i, j in PAIRS]
XY_SUMS = [f"xy_{i}" for i in range(len(FEATURES))]
MOMENTS = ["n", *X_SUMS, *XX_SUMS, *XY_SUMS, "y"]
COUNTERS = ["n_families", "n_origins"]


def centered(feature: str) -> Column:
    return F.coalesce(F.col(feature) - F.lit(CENTERS.get(feature, 0.0)), F.lit(0.0))


def needs(model: str) -> Column:
    """Condition on the availability flags under which ``model`` has all its features."""
    columns = RIDGE_MODELS[model]
    condition = F.lit(True)
    if "google_level" in columns:
        condition = condition & F.col("google_available")
    if "rank_log" in columns:
        condition = condition & F.col("rank_available")
    return condition


def labelled(samples: DataFrame) -> DataFrame:
    """Grid samples with a known target, one row per horizon, with label ``y``."""
    per_horizon = ", ".join(f"{h}, target_{h}, target_end_{h}" for h in HORIZONS)
    return (
        samples.filter(on_grid(F.col("origin")))
        .select(
            "ingredient_id",
            "family_id",
            "heldout",
            "origin",
            "baseline",
            "google_available",
            "rank_available",
            *FEATURES,
            F.expr(f"stack({len(HORIZONS)}, {per_horizon}) as (horizon_weeks, target, target_end)"),
        )
        .filter("target is not null")
        .withColumn("y", F.log1p("target") - F.log1p("baseline"))
    )


def _fit_tags() -> Column:
    """(scope, model) pairs a row trains: ``backtest`` leaves held-out families out, ``deploy`` takes all."""
    tags = []
    for model in RIDGE_MODELS:
        tags.append(F.when(needs(model) & ~F.col("heldout"), F.struct(F.lit("backtest").alias("scope"), F.lit(model).alias("model"))))
        tags.append(F.when(needs(model), F.struct(F.lit("deploy").alias("scope"), F.lit(model).alias("model"))))
    return F.filter(F.array(*tags), lambda tag: tag.isNotNull())


FIT_KEYS = ["scope", "horizon_weeks", "model"]


def weekly_moments(labels: DataFrame) -> DataFrame:
    """Moment sums per (scope, horizon, model) and label-end week."""
    x = [centered(name) for name in FEATURES]
    sums = [F.count("*").cast("double").alias("n")]
    sums += [F.sum(x[i]).alias(name) for i, name in enumerate(X_SUMS)]
    sums += [F.sum(x[i] * x[j]).alias(name) for (i, j), name in zip(PAIRS, XX_SUMS)]
    sums += [F.sum(x[i] * F.col("y")).alias(name) for i, name in enumerate(XY_SUMS)]
    sums += [F.sum("y").alias("y")]
    # Four availability patterns instead of four copies of every sample.
    by_pattern = labels.groupBy("horizon_weeks", "target_end", "heldout", "google_available", "rank_available").agg(*sums)
    return (
        by_pattern.withColumn("_tag", F.explode(_fit_tags()))
        .groupBy(F.col("_tag.scope").alias("scope"), "horizon_weeks", F.col("_tag.model").alias("model"), "target_end")
        .agg(*[F.sum(name).alias(name) for name in MOMENTS])
    )


def first_family_weeks(labels: DataFrame) -> DataFrame:
    """New families per (scope, horizon, model) and the week their first label matured."""
    firsts = {model: F.min(F.when(needs(model), F.col("target_end"))) for model in RIDGE_MODELS}
    per_family = labels.groupBy("horizon_weeks", "family_id").agg(
        F.bool_or("heldout").alias("heldout"), *[week.alias(model) for model, week in firsts.items()]
    )
    pairs = ", ".join(f"'{model}', {model}" for model in RIDGE_MODELS)
    long = per_family.select(
        "horizon_weeks", "heldout", F.expr(f"stack({len(RIDGE_MODELS)}, {pairs}) as (model, target_end)")
    ).filter("target_end is not null")
    # heldout counts once in deploy only; everything else in both scopes.
    scopes = F.when(F.col("heldout"), F.array(F.lit("deploy"))).otherwise(F.array(F.lit("backtest"), F.lit("deploy")))
    return (
        long.withColumn("scope", F.explode(scopes))
        .groupBy("scope", "horizon_weeks", "model", "target_end")
        .agg(F.count("*").alias("n_families"))
    )


def training_sets(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Moments and gate counts of the training rows of every wanted fit.

    ``wanted`` has scope and origin. A label belongs to an origin's training set when its last week
    is not after the origin: label weeks and origins are laid on one calendar and summed along it,
    which replaces the range join of samples and origins. The windows run over label weeks, of
    which there are only as many as the calendar has.
    """
    labels = labelled(samples)
    moments = weekly_moments(labels).withColumn("n_origins", F.lit(1)).withColumn("n_families", F.lit(0))
    families = first_family_weeks(labels)
    zero = {name: F.lit(0.0) for name in MOMENTS}
    fits = F.explode(
        F.array(*[F.struct(F.lit(h).alias("horizon_weeks"), F.lit(m).alias("model")) for h in HORIZONS for m in RIDGE_MODELS])
    )
    asked = (
        wanted.select("scope", F.col("origin").alias("week"), fits.alias("_fit"))
        .select("scope", "week", "_fit.*")
        .withColumns({**zero, "n_origins": F.lit(0), "n_families": F.lit(0), "asked": F.lit(1)})
    )
    label_weeks = moments.withColumnRenamed("target_end", "week").withColumn("asked", F.lit(0))
    family_weeks = families.withColumnRenamed("target_end", "week").withColumns(
        {**zero, "n_origins": F.lit(0), "asked": F.lit(0)}
    )
    line = label_weeks.unionByName(family_weeks).unionByName(asked)
    so_far = (
        Window.partitionBy(*FIT_KEYS)
        .orderBy("week", "asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = line.select(
        *FIT_KEYS,
        "week",
        "asked",
        *[F.sum(name).over(so_far).alias(name) for name in [*MOMENTS, *COUNTERS]],
        F.max(F.when(F.col("n") > 0, F.col("week"))).over(so_far).alias("max_label_end"),
    )
    return summed.filter("asked = 1").drop("asked").withColumnRenamed("week", "origin")


def training_audit(sets: DataFrame) -> DataFrame:
    """Diagnostics of every fit: rows, families, origins and the latest label used."""
    return sets.select(
        *FIT_KEYS,
        "origin",
        F.col("n").cast("bigint").alias("n_rows"),
        F.col("n_families").cast("bigint").alias("n_families"),
        F.col("n_origins").cast("bigint").alias("n_origins"),
        "max_label_end",
    )

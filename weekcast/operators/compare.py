"""Strictly paired comparison of two vendors' backtests.

Both runs are stacked and reduced by the six-column pairing key: one shuffle finds duplicates,
unpaired rows and pairs at once, and a heavily repeated key is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import BASELINE, COMPATIBLE_METHOD, COMPATIBLE_TOP_LEVEL, SEALED_SPLITS, VENDORS
from weekcast.functions.numeric import non_negative, ratio

PAIR_KEYS = ["ingredient_id", "horizon_weeks", "split", "origin", "target_end", "model"]
SIDES = ("primary", "secondary")
GROUP = ["horizon_weeks", "split", "model"]


def normal_provider(value: Column) -> Column:
    """Known provider in lower case, else NULL."""
    name = F.lower(F.trim(value))
    return F.when(name.isin(*VENDORS), name)


def quality_provider(current: Column, legacy: Column) -> Column:
    """Provider of a quality row from its current or legacy field; NULL when unknown or contradictory."""

    def given(column: Column) -> Column:
        return F.coalesce(F.trim(column), F.lit("")) != ""

    a, b = normal_provider(current), normal_provider(legacy)
    bad = (given(current) & a.isNull()) | (given(legacy) & b.isNull()) | F.coalesce(a != b, F.lit(False))
    return F.when(~bad, F.coalesce(a, b))


def incompatibilities(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Reasons why two runs cannot be compared; no rows means they can.

    Inputs are key/value metadata of one run each: ``provider``, the top-level fields, and
    ``methodology.<name>`` fields, values as text.
    """
    needed = [*COMPATIBLE_TOP_LEVEL, *(f"methodology.{name}" for name in COMPATIBLE_METHOD)]
    keys = primary.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, needed))).alias("key"))
    a = primary.select("key", F.col("value").alias("a"))
    b = secondary.select("key", F.col("value").alias("b"))
    compared = keys.join(a, "key", "left").join(b, "key", "left")
    fields = compared.select(
        "key", F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "different").alias("reason")
    ).filter("reason is not null")
    pair = a.filter("key = 'provider'").select("key", normal_provider(F.col("a")).alias("a")).join(
        b.filter("key = 'provider'").select("key", normal_provider(F.col("b")).alias("b")), "key", "full_outer"
    )
    providers = (
        keys.agg(F.max("key").alias("_any"))
        .join(pair.select(F.lit(True).alias("_p"), "a", "b"), F.col("_any").isNotNull(), "left")
        .select(
            F.lit("provider").alias("key"),
            F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "not_two_providers").alias("reason"),
        )
        .filter("reason is not null")
    )
    return fields.unionByName(providers)


def ingredient_identity(
    primary: DataFrame, secondary: DataFrame, primary_provider: Column, secondary_provider: Column
) -> DataFrame:
    """Status of every shared ingredient: ``eligible``, ``source_mismatch`` or ``metadata_mismatch``.

    Inputs: ingredient_id, keyword, marketplace, amazon_provider, amazon_source (from the quality rows).
    """

    def side(rows: DataFrame, mark: str) -> DataFrame:
        return rows.select(
            "ingredient_id",
            F.lower(F.trim(F.coalesce("keyword", F.lit("")))).alias(f"{mark}_keyword"),
            F.lower(F.trim(F.coalesce("marketplace", F.lit("")))).alias(f"{mark}_market"),
            quality_provider(F.col("amazon_provider"), F.col("amazon_source")).alias(f"{mark}_source"),
        )

    both = side(primary, "a").join(side(secondary, "b"), "ingredient_id")
    sources = F.coalesce(
        (F.col("a_source") == primary_provider) & (F.col("b_source") == secondary_provider), F.lit(False)
    )
    same = (
        (F.col("a_keyword") != "") & (F.col("a_keyword") == F.col("b_keyword"))
        & (F.col("a_market") != "") & (F.col("a_market") == F.col("b_market"))
    )
    return both.select(
        "ingredient_id",
        F.when(~sources, "source_mismatch").when(~same, "metadata_mismatch").otherwise("eligible").alias("status"),
    )


def comparable_models(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(horizon_weeks, model): the baseline always, the chosen model only if both runs chose it."""
    a = primary.select("horizon_weeks", F.col("model").alias("a"))
    b = secondary.select("horizon_weeks", F.col("model").alias("b"))
    shared = F.when((F.col("a") == F.col("b")) & (F.col("a") != BASELINE), F.array(F.lit(BASELINE), F.col("a")))
    return a.join(b, "horizon_weeks", "left").select(
        "horizon_weeks", F.explode(F.coalesce(shared, F.array(F.lit(BASELINE)))).alias("model")
    )


def judged_rows(backtests: DataFrame, eligible: DataFrame, models: DataFrame) -> DataFrame:
    """Sealed rows of eligible ingredients and comparable models, with ``valid``."""
    numbers = [F.col(c) for c in ("actual", "predicted", "baseline")]
    valid = F.col("origin").isNotNull() & F.col("target_end").isNotNull()
    for number in numbers:
        valid = valid & non_negative(number).isNotNull()
    return (
        backtests.filter(F.col("split").isin(*SEALED_SPLITS))
        .join(eligible.select("ingredient_id"), "ingredient_id", "left_semi")
        .join(F.broadcast(models), ["horizon_weeks", "model"], "left_semi")  # at most two rows per horizon
        .select(*PAIR_KEYS, "actual", "predicted", "baseline", valid.alias("valid"))
    )


def keyed_rows(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """One row per pairing key over both judged sides, with counts and values of each side."""
    stacked = primary.withColumn("side", F.lit("primary")).unionByName(secondary.withColumn("side", F.lit("secondary")))
    values = []
    for side in SIDES:
        mine = F.col("side") == side
        values.append(F.count_if(mine).alias(f"{side}_n"))
        values += [F.max(F.when(mine, F.col(c))).alias(f"{side}_{c}") for c in ("actual", "predicted", "baseline")]
    return stacked.filter("valid").groupBy(*PAIR_KEYS).agg(*values)


def row_audit(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Per side: invalid rows, and keys dropped because they came more than once."""
    keyed = keyed_rows(primary, secondary)
    invalid = [
        rows.agg(F.count_if(~F.col("valid")).alias("invalid_rows")).withColumn("side", F.lit(side))
        for side, rows in zip(SIDES, (primary, secondary))
    ]
    doubles = keyed.agg(*[F.count_if(F.col(f"{side}_n") > 1).alias(side) for side in SIDES]).select(
        F.expr("stack(2, 'primary', primary, 'secondary', secondary) as (side, duplicate_keys)")
    )
    return invalid[0].unionByName(invalid[1]).join(doubles, "side").select("side", "invalid_rows", "duplicate_keys")


def pairs(keyed: DataFrame) -> DataFrame:
    """Keys with exactly one row on each side."""
    return keyed.filter("primary_n = 1 and secondary_n = 1").drop("primary_n", "secondary_n")


def unpaired(keyed: DataFrame) -> DataFrame:
    """Keys only one side has (after dropping duplicated keys), per horizon, split and model."""
    one = {side: F.col(f"{side}_n") == 1 for side in SIDES}
    return keyed.groupBy(*GROUP).agg(
        F.count_if(one["primary"] & one["secondary"]).alias("n_pairs"),
        F.count_if(one["primary"] & ~one["secondary"]).alias("primary_only"),
        F.count_if(one["secondary"] & ~one["primary"]).alias("secondary_only"),
    )


def paired_metrics(paired: DataFrame) -> DataFrame:
    """Micro and macro WAPE of both sides per horizon, split and model."""
    sums = []
    for side in SIDES:
        actual, predicted = F.col(f"{side}_actual"), F.col(f"{side}_predicted")
        sums += [F.sum(F.abs(actual - predicted)).alias(f"{side}_error"), F.sum(F.abs(actual)).alias(f"{side}_total")]
    per_ingredient = paired.groupBy(*GROUP, "ingredient_id").agg(F.count("*").alias("n"), *sums)
    wape = {side: ratio(F.col(f"{side}_error"), F.col(f"{side}_total")) for side in SIDES}
    both = wape["primary"].isNotNull() & wape["secondary"].isNotNull()
    totals = per_ingredient.groupBy(*GROUP).agg(
        F.sum("n").alias("n_pairs"),
        F.count("*").alias("n_ingredients"),
        F.count_if(both).alias("macro_n_ingredients"),
        *[ratio(F.sum(f"{side}_error"), F.sum(f"{side}_total")).alias(f"{side}_wape") for side in SIDES],
        *[F.avg(F.when(both, wape[side])).alias(f"{side}_macro_wape") for side in SIDES],
    )
    origins = paired.groupBy(*GROUP, "origin").agg(F.lit(1).alias("_one")).groupBy(*GROUP).agg(F.count("*").alias("n_origins"))
    return totals.join(origins, GROUP)


def paired_series(paired: DataFrame) -> DataFrame:
    """Per ingredient: arrays by origin and WAPE of each side. A series has one entry per origin."""
    point = F.struct("origin", "target_end", *[f"{s}_{c}" for s in SIDES for c in ("actual", "predicted")])
    packed = paired.groupBy("ingredient_id", *GROUP).agg(
        F.sort_array(F.collect_list(point)).alias("_p"),
        *[
            ratio(
                F.sum(F.abs(F.col(f"{s}_actual") - F.col(f"{s}_predicted"))), F.sum(F.abs(F.col(f"{s}_actual")))
            ).alias(f"{s}_wape")
            for s in SIDES
        ],
    )
    fields = ["origin", "target_end", *[f"{s}_{c}" for s in SIDES for c in ("actual", "predicted")]]
    return packed.select(
        "ingredient_id", *GROUP, *[F.col(f"_p.{f}").alias(f"{f}s") for f in fields], *[f"{s}_wape" for s in SIDES]
    )


class Comparison:
    """Two runs compared; fails closed with ``status`` incompatible, no_pairs or ok."""

    def __init__(
        self,
        meta: tuple[DataFrame, DataFrame],
        ingredients: tuple[DataFrame, DataFrame],
        selected: tuple[DataFrame, DataFrame],
        backtests: tuple[DataFrame, DataFrame],
    ):
        self.reasons = incompatibilities(*meta)
        providers = [
            m.filter("key = 'provider'").select(normal_provider(F.col("value")).alias("p")).agg(F.max("p").alias("p")).scalar()
            for m in meta
        ]
        self.identity = ingredient_identity(*ingredients, *providers)
        self.models = comparable_models(*selected)
        blocked = self.reasons.agg((F.count("*") > 0).alias("b")).scalar()
        eligible = self.identity.filter((F.col("status") == "eligible") & ~blocked)
        self.sides = tuple(judged_rows(rows, eligible, self.models) for rows in backtests)
        self.keyed = keyed_rows(*self.sides)
        self.pairs = pairs(self.keyed)
        self.metrics = paired_metrics(self.pairs)
        self.unpaired = unpaired(self.keyed)
        self.series = paired_series(self.pairs)
        self.audit = row_audit(*self.sides)

    def status(self) -> DataFrame:
        counted = self.reasons.agg(F.count("*").alias("reasons"))
        n_pairs = self.pairs.agg(F.count("*").alias("n")).scalar()
        return counted.select(
            F.when(F.col("reasons") > 0, "incompatible").when(n_pairs == 0, "no_pairs").otherwise("ok").alias("status"),
            "reasons",
            n_pairs.alias("n_pairs"),
        )

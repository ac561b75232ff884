"""Expectations on a weekly panel; each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import MARKETPLACE, VENDORS
from weekcast.functions.dates import is_saturday
from weekcast.session import stage

REQUIRED = ("ingredient_id", "week_end", "searches")


def missing_columns(panel: DataFrame) -> list[str]:
    return [name for name in REQUIRED if name not in panel.columns]


def _violation(rows: DataFrame, rule: str, detail: Column, week: bool = True) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"),
        "ingredient_id",
        (F.col("week_end") if week else F.lit(None).cast("date")).alias("week_end"),
        detail.cast("string").alias("detail"),
    )


def row_violations(panel: DataFrame) -> DataFrame:
    """Rules of single rows, in one projection: keys, Saturdays, agreement of the two provider fields."""
    saturday = is_saturday(F.col("week_end"))
    rules = [
        ("missing_key", F.col("ingredient_id").isNull() | F.col("week_end").isNull(), F.lit(None)),
        ("week_end_not_saturday", ~saturday, F.dayofweek("week_end")),
    ]
    if {"amazon_provider", "amazon_source"} <= set(panel.columns):
        folded = [F.lower(F.coalesce(c, F.lit(""))) for c in ("amazon_provider", "amazon_source")]
        rules.append(("provider_fields_disagree", folded[0] != folded[1], F.concat_ws(",", *folded)))
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in rules]))
    found = panel.select("ingredient_id", "week_end", F.explode(broken).alias("_broken"))
    return found.select("_broken.rule", "ingredient_id", "week_end", "_broken.detail")


def duplicate_weeks(panel: DataFrame) -> DataFrame:
    counted = panel.groupBy("ingredient_id", "week_end").agg(F.count("*").alias("n")).filter("n > 1")
    return _violation(counted, "duplicate_week", F.col("n"))


def not_single_valued(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ingredients with more than one value of a column (least and greatest differ); one aggregate for all columns."""
    value = {c: F.lower(c) if c == "amazon_provider" else F.col(c) for c in columns}
    spread = panel.groupBy("ingredient_id").agg(*[x for c, v in value.items() for x in (F.min(v).alias(f"{c}_lo"), F.max(v).alias(f"{c}_hi"))])
    lo_hi = {c: (F.col(f"{c}_lo"), F.col(f"{c}_hi")) for c in columns}
    broken = [F.when(lo != hi, F.struct(F.lit(f"several_{c}").alias("rule"), F.concat_ws(",", lo, hi).alias("detail"))) for c, (lo, hi) in lo_hi.items()]
    found = spread.select("ingredient_id", F.explode(F.array_compact(F.array(*broken))).alias("_broken"))
    return found.select("_broken.rule", "ingredient_id", F.lit(None).cast("date").alias("week_end"), "_broken.detail")


def foreign_marketplace(panel: DataFrame) -> DataFrame:
    other = panel.filter(F.coalesce("marketplace", F.lit(MARKETPLACE)) != MARKETPLACE)
    found = other.groupBy("ingredient_id", "marketplace").agg(F.count("*").alias("n"))
    return _violation(found, "foreign_marketplace", F.col("marketplace"), week=False)


def panel_providers(panel: DataFrame) -> DataFrame:
    """Providers of a panel that break the one-supported-provider policy."""
    found = panel.groupBy(F.lower(F.coalesce("amazon_provider", F.lit(""))).alias("provider")).agg(F.count("*").alias("n"))
    several = found.agg((F.count("*") > 1).alias("s")).scalar()
    bad = found.filter(several | ~F.col("provider").isin(*VENDORS))
    return bad.select(
        F.lit("not_one_provider").alias("rule"),
        F.lit(None).cast("string").alias("ingredient_id"),
        F.lit(None).cast("date").alias("week_end"),
        F.col("provider").alias("detail"),
    )


def panel_violations(panel: DataFrame) -> DataFrame:
    """All expectations on one panel as a single long table; the panel is written once and read by all checks."""
    panel = stage(panel, "checked-panel")
    checks = [row_violations(panel), duplicate_weeks(panel)]
    if single := [c for c in ("family_id", "marketplace", "amazon_provider") if c in panel.columns]:
        checks.append(not_single_valued(panel, single))
    if "marketplace" in panel.columns:
        checks.append(foreign_marketplace(panel))
    if "amazon_provider" in panel.columns:
        checks.append(panel_providers(panel))
    return reduce(DataFrame.unionByName, checks)


def manifest_violations(panel_manifest: DataFrame, declared: DataFrame) -> DataFrame:
    """Fields in which a declared manifest differs from the one computed from its panel."""
    fields = ("schema_version", "amazon_provider", "provider_policy", "rows", "ingredients", "panel_fingerprint")
    texts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    found = panel_manifest.select(F.inline(F.array(*texts)))
    said = declared.select(F.inline(F.array(*texts))).withColumnRenamed("value", "declared")
    return found.join(said, "field", "left").filter(~F.col("value").eqNullSafe(F.col("declared")))


def require_valid(panel: DataFrame) -> DataFrame:
    """The panel itself, or ValueError naming the first broken expectation."""
    absent = missing_columns(panel)
    if absent:
        raise ValueError(f"panel lacks columns {absent}")
    broken = panel_violations(panel).first()
    if broken is not None:
        raise ValueError(f"panel breaks {broken['rule']}: {broken['ingredient_id']} {broken['week_end']} {broken['detail']}")
    return panel

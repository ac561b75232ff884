"""Vendor comparison, audit summary and enrichment queries: panel A against panel B, baselines only."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weekcast.operators import audit as D, compare as K
from weekcast.plans import raw_testbed as R, sql as S, testbed as T
from weekcast.plans.analysis import run_analysis
from weekcast.plans.queries_forecast import _SCORED_SQL
from weekcast.plans.registry import plain, query


def runs(spark, folder):
    return (
        run_analysis(T.panel_a(spark, folder), with_ridge=False),
        run_analysis(T.panel_b(spark, folder), with_ridge=False),
    )


def metadata(analysis, provider: str):
    """Key/value run metadata."""
    fixed = {
        "provider": F.lit(provider),
        "schema_version": F.lit("2.0"),
        "as_of": F.col("as_of").cast("string"),
        "scope": F.lit("US weekly searches"),
        "methodology.sealed_test_start": F.col("test_start").cast("string"),
    }
    from weekcast.constants import COMPATIBLE_METHOD

    for name in COMPATIBLE_METHOD:
        fixed.setdefault(f"methodology.{name}", F.lit(f"{name} v1"))
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fixed.items()]
    return analysis.bounds.select(F.inline(F.array(*pairs)))


def ingredients(panel, provider: str, second: bool):
    """Identity and source of every ingredient; some brands disagree between the two runs."""
    number = R.brand_number()
    keyword = F.lower("ingredient_id")
    if second:
        keyword = F.when(number % 12 == 5, "renamed").otherwise(F.upper(F.concat(F.lit(" "), "ingredient_id")))
    source = F.when(number % 10 == 9, "sif" if provider == "sellersprite" else "sellersprite").otherwise(provider)
    return panel.select("ingredient_id", "marketplace").distinct().select(
        "ingredient_id",
        keyword.alias("keyword"),
        "marketplace",
        F.when(number % 2 == 0, provider).alias("amazon_provider"),
        source.alias("amazon_source"),
    )


def comparison(spark, folder):
    first, second = runs(spark, folder)
    number = R.brand_number()
    # Repeated rows on the second side, unusable actuals on the first.
    repeated = second.long.filter((number % 8 == 0) & (F.col("horizon_weeks") == 13))
    damaged = first.long.withColumn(
        "actual", F.when((number == 3) & (F.col("horizon_weeks") == 26), F.lit(None)).otherwise(F.col("actual"))
    )
    return K.Comparison(
        (metadata(first, "sellersprite"), metadata(second, "sif")),
        (ingredients(first.panel, "sellersprite", False), ingredients(second.panel, "sif", True)),
        (first.selected, second.selected),
        (damaged, second.long.unionByName(repeated)),
    )


_SECOND = re.sub(r"\b(scored|size|names|compared|picked)\b", r"\1_b", _SCORED_SQL.replace("long_a", "long_b"))
_PAIRED_SQL = f"""{S.base('a', 'cases')}, {S.panel('b')}, {S.features('b')}, {S.cases('b')}, {_SCORED_SQL}, {_SECOND},
models AS (SELECT horizon_weeks, 'last13mean' AS model FROM picked UNION SELECT p.horizon_weeks, p.model FROM picked p JOIN picked_b b USING (horizon_weeks, model)),
identity AS (SELECT DISTINCT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn FROM part),
statuses AS (SELECT ingredient_id, bn, CASE WHEN bn % 10 = 9 THEN 'source_mismatch' WHEN bn % 12 = 5 THEN 'metadata_mismatch' ELSE 'eligible' END AS status FROM identity),
sealed_a AS (SELECT l.*, NOT (bn = 3 AND horizon_weeks = 26) AS valid FROM long_a l JOIN statuses USING (ingredient_id) JOIN models USING (horizon_weeks, model)
  WHERE status = 'eligible' AND split IN ('sealed_test', 'group_sealed_test')),
sealed_b AS (SELECT l.*, (bn % 8 = 0 AND horizon_weeks = 13) AS doubled FROM long_b l JOIN statuses USING (ingredient_id) JOIN models USING (horizon_weeks, model)
  WHERE status = 'eligible' AND split IN ('sealed_test', 'group_sealed_test')),
good_a AS (SELECT * FROM sealed_a WHERE valid), good_b AS (SELECT * FROM sealed_b WHERE NOT doubled),
paired AS (SELECT a.ingredient_id, a.horizon_weeks, a.split, a.origin, a.target_end, a.model, a.actual AS primary_actual, a.predicted AS primary_predicted, a.baseline AS primary_baseline,
  b.actual AS secondary_actual, b.predicted AS secondary_predicted, b.baseline AS secondary_baseline
  FROM good_a a JOIN good_b b USING (ingredient_id, horizon_weeks, split, origin, target_end, model))"""
_VALUES = ("primary_actual", "primary_predicted", "primary_baseline", "secondary_actual", "secondary_predicted", "secondary_baseline")


@query("vendor_pairs", plain(f"{_PAIRED_SQL} SELECT * FROM paired", ("origin", "target_end"), _VALUES))
def vendor_pairs(spark, folder):
    """Rows of both vendors with exactly equal keys."""
    return comparison(spark, folder).pairs


@query(
    "vendor_wape",
    plain(f"""{_PAIRED_SQL}, per AS (SELECT horizon_weeks, split, model, ingredient_id, count(*) AS n,
        sum(abs(primary_actual - primary_predicted)) AS e1, sum(primary_actual) AS t1, sum(abs(secondary_actual - secondary_predicted)) AS e2, sum(secondary_actual) AS t2 FROM paired GROUP BY 1, 2, 3, 4)
      SELECT horizon_weeks, split, model, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) AS n_ingredients, count(*) FILTER (WHERE t1 > 0 AND t2 > 0) AS macro_n_ingredients,
        sum(e1) / sum(t1) AS primary_wape, sum(e2) / sum(t2) AS secondary_wape, avg(e1 / t1) AS primary_macro_wape, avg(e2 / t2) AS secondary_macro_wape,
        (SELECT count(DISTINCT origin) FROM paired p WHERE p.horizon_weeks = per.horizon_weeks AND p.split = per.split AND p.model = per.model) AS n_origins
      FROM per GROUP BY 1, 2, 3""", (), ("primary_wape", "secondary_wape", "primary_macro_wape", "secondary_macro_wape")),
)
def vendor_wape(spark, folder):
    """Micro and macro errors of both vendors on the same windows."""
    return comparison(spark, folder).metrics


@query(
    "vendor_unpaired",
    f"""{_PAIRED_SQL}, met AS (SELECT coalesce(a.horizon_weeks, b.horizon_weeks) AS horizon_weeks, coalesce(a.split, b.split) AS split, coalesce(a.model, b.model) AS model,
        a.origin IS NOT NULL AS in_a, b.origin IS NOT NULL AS in_b, b.doubled IS NOT DISTINCT FROM true AS doubled FROM good_a a FULL JOIN sealed_b b
        ON a.ingredient_id = b.ingredient_id AND a.horizon_weeks = b.horizon_weeks AND a.split = b.split AND a.origin = b.origin AND a.target_end = b.target_end AND a.model = b.model)
      SELECT horizon_weeks, split, model, count(*) FILTER (WHERE in_a AND in_b AND NOT doubled) AS n_pairs, count(*) FILTER (WHERE in_a AND (doubled OR NOT in_b)) AS primary_only,
        count(*) FILTER (WHERE NOT in_a AND NOT doubled) AS secondary_only FROM met GROUP BY 1, 2, 3""",
)
def vendor_unpaired(spark, folder):
    """Keys that only one vendor has."""
    return comparison(spark, folder).unpaired


@query(
    "vendor_dup_drop",
    f"""{_PAIRED_SQL} SELECT 'primary' AS side, (SELECT count(*) FROM sealed_a WHERE NOT valid) AS invalid_rows, 0::BIGINT AS duplicate_keys
      UNION ALL SELECT 'secondary', 0, (SELECT count(*) FROM sealed_b WHERE doubled)""",
)
def vendor_dup_drop(spark, folder):
    """Invalid rows and repeated keys per side."""
    return comparison(spark, folder).audit


@query("vendor_identity", f"{_PAIRED_SQL} SELECT ingredient_id, status FROM statuses")
def vendor_identity(spark, folder):
    """Source and identity check of shared ingredients."""
    return comparison(spark, folder).identity


@query(
    "vendor_series",
    plain(f"""{_PAIRED_SQL} SELECT ingredient_id, horizon_weeks, split, model, string_agg(CAST(origin AS VARCHAR), ',' ORDER BY origin) AS origins,
      string_agg(CAST(target_end AS VARCHAR), ',' ORDER BY origin) AS target_ends, count(*) AS points, sum(abs(primary_actual - primary_predicted)) / sum(primary_actual) AS primary_wape,
      sum(abs(secondary_actual - secondary_predicted)) / sum(secondary_actual) AS secondary_wape, arg_max(primary_predicted, origin) AS last_primary, arg_max(secondary_predicted, origin) AS last_secondary
      FROM paired GROUP BY 1, 2, 3, 4""", (), ("primary_wape", "secondary_wape", "last_primary", "last_secondary")),
)
def vendor_series(spark, folder):
    """A10: paired series of every ingredient, in order of origin."""
    rows = comparison(spark, folder).series
    return rows.select(
        "ingredient_id", "horizon_weeks", "split", "model",
        F.array_join(F.transform("origins", lambda d: d.cast("string")), ",").alias("origins"),
        F.array_join(F.transform("target_ends", lambda d: d.cast("string")), ",").alias("target_ends"),
        F.size("origins").alias("points"),
        "primary_wape", "secondary_wape",
        F.element_at("primary_predicteds", -1).alias("last_primary"),
        F.element_at("secondary_predicteds", -1).alias("last_secondary"),
    )


@query("vendor_status", f"{_PAIRED_SQL} SELECT 'ok' AS status, 0::BIGINT AS reasons, (SELECT count(*) FROM paired) AS n_pairs")
def vendor_status(spark, folder):
    """Comparable or not."""
    return comparison(spark, folder).status()


@query(
    "run_compatibility",
    "SELECT * FROM (VALUES ('as_of', 'different'), ('provider', 'not_two_providers'), ('scope', 'missing'), ('methodology.ridge_alpha', 'different')) AS t(key, reason)",
)
def run_compatibility(spark, folder):
    """Every field in which two runs differ or that one of them lacks."""
    first, _ = runs(spark, folder)
    meta = metadata(first, "sellersprite")
    changed = meta.filter("key <> 'scope'").withColumn(
        "value",
        F.when(F.col("key") == "as_of", "2000-01-01").when(F.col("key") == "methodology.ridge_alpha", "1").otherwise(F.col("value")),
    )
    return K.incompatibilities(meta, changed)


# --- audit summary -------------------------------------------------------------------------------
@query(
    "audit_history",
    plain(f"""{S.base('a', 'panel')}, per AS (SELECT ingredient_id, count(*) AS weeks, min(week_end) AS f, max(week_end) AS l FROM panel_a GROUP BY 1)
      SELECT min(weeks) AS minimum_weeks, max(weeks) AS maximum_weeks, min(f) AS earliest_week, max(l) AS latest_week, count(*) AS ingredient_count FROM per""", ("earliest_week", "latest_week")),
)
def audit_history(spark, folder):
    """History bounds of a run."""
    return D.history_bounds(T.panel_a(spark, folder))


@query("audit_backtests", f"{S.base('a', 'cases')} SELECT horizon_weeks, split, model, count(*) AS n FROM long_a GROUP BY 1, 2, 3")
def audit_backtests(spark, folder):
    """Backtest rows by horizon, split and model."""
    return D.backtest_counts(runs(spark, folder)[0].long)


@query(
    "audit_sources",
    "SELECT CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 10 = 9 THEN 'sif' ELSE 'sellersprite' END AS provider, count(DISTINCT p_brand) AS n FROM part GROUP BY 1",
)
def audit_sources(spark, folder):
    """Ingredients per source, counted from quality rows when a run has no counts."""
    quality = ingredients(T.panel_a(spark, folder), "sellersprite", False)
    nothing = quality.select(F.col("amazon_source").alias("provider"), F.lit(1).alias("n")).filter(F.lit(False))
    return D.source_counts(nothing, quality)


@query(
    "forecast_context",
    """WITH b AS (SELECT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn, count(*) AS parts FROM part GROUP BY 1)
      SELECT ingredient_id, bn % 4 AS warnings, CASE WHEN bn % 3 = 0 THEN parts END AS context_parts, CASE WHEN bn % 5 = 0 THEN 'month ' || parts END AS snapshot_note FROM b""",
)
def forecast_context(spark, folder):
    """Quality, context files and competition snapshots next to ingredients."""
    from weekcast.sources import library as B

    number = R.brand_number()
    base = T.table(spark, folder, "part").groupBy(F.col("p_brand").alias("ingredient_id")).agg(F.count("*").alias("parts"))
    texts = base.filter(number % 3 == 0).select(F.to_json(F.struct("ingredient_id", "parts")).alias("text"))
    snapshots = base.filter(number % 5 == 0).select(
        F.to_json(F.create_map("ingredient_id", F.struct(F.concat(F.lit("month "), F.col("parts").cast("string")).alias("note")))).alias("text")
    )
    quality = base.select("ingredient_id", (number % 4).cast("bigint").alias("warnings"))
    rows = B.with_context(base.select("ingredient_id"), quality, B.auxiliary_rows(texts), B.competition_rows(snapshots))
    return rows.select(
        "ingredient_id", "warnings",
        F.get_json_object("context", "$.parts").cast("bigint").alias("context_parts"),
        F.get_json_object("recent_snapshot", "$.note").alias("snapshot_note"),
    )

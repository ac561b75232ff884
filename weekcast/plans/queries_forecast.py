"""Panel, feature, training, backtest and forecast queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.constants import ABLATIONS, FEATURES, HORIZONS, MODELS, RIDGE_MODELS
from weekcast.functions.dates import on_grid
from weekcast.functions.hashing import is_heldout
from weekcast.operators import backtest as B, features as X, forecast as Y, moments as M, panel as P
from weekcast.plans import sql as S, testbed as T
from weekcast.plans.analysis import run_analysis
from weekcast.plans.registry import plain, query

PANEL_COLUMNS = ["ingredient_id", "week_end", "searches", "rank", "google_trend"]


# --- panel ---------------------------------------------------------------------------------------
@query(
    "weekly_panel",
    plain(f"WITH {S.SALES_A} SELECT ingredient_id, week_end, searches, n_lines, rank FROM sales_a WHERE week_end < {S.AS_OF}",
          ("week_end",), ("searches", "rank")),
)
def weekly_panel(spark, folder):
    """Weekly totals by Saturday week, completed weeks only."""
    sales = P.completed_weeks(T.sales_a(spark, folder, as_of=T.AS_OF), F.lit(T.AS_OF))
    return sales.select("ingredient_id", "week_end", "searches", "n_lines", "rank")


@query(
    "panel_gapfill",
    plain(f"{S.base('a', 'panel')} SELECT ingredient_id, week_end, searches, rank FROM panel_a", ("week_end",), ("searches", "rank")),
)
def panel_gapfill(spark, folder):
    """Every week between an entity's first and last one."""
    sales = P.completed_weeks(T.sales_a(spark, folder, as_of=T.AS_OF), F.lit(T.AS_OF))
    return P.gap_fill(sales.select("ingredient_id", "week_end", "searches", "rank"))


@query(
    "trend_lag_join",
    plain(f"{S.base('a', 'panel')} SELECT * FROM panel_a", ("week_end",), ("searches", "rank", "google_trend")),
)
def trend_lag_join(spark, folder):
    """Trend of the week before, next to each panel week."""
    return T.panel_a(spark, folder).select(*PANEL_COLUMNS)


_DIRTY_SQL = f"""{S.SALES_A},
dirty AS (SELECT ingredient_id, week_end, n_lines,
  CASE n_lines % 7 WHEN 1 THEN 'Infinity' WHEN 2 THEN '-2' WHEN 3 THEN 'bad' WHEN 4 THEN NULL
       ELSE CAST(CAST(searches AS BIGINT) AS VARCHAR) END AS searches,
  CASE n_lines % 5 WHEN 1 THEN '0' WHEN 2 THEN 'NaN' ELSE CAST(CAST(rank AS BIGINT) AS VARCHAR) END AS rank
  FROM sales_a WHERE week_end < {S.AS_OF})"""


def dirty_sales(spark, folder):
    """Weekly sales as vendor text with unusable values in some weeks."""
    sales = P.completed_weeks(T.sales_a(spark, folder, as_of=T.AS_OF), F.lit(T.AS_OF))
    seven, five = F.col("n_lines") % 7, F.col("n_lines") % 5
    searches = (
        F.when(seven == 1, "Infinity").when(seven == 2, "-2").when(seven == 3, "bad")
        .when(seven == 4, F.lit(None).cast("string")).otherwise(F.col("searches").cast("bigint").cast("string"))
    )
    rank = F.when(five == 1, "0").when(five == 2, "NaN").otherwise(F.col("rank").cast("bigint").cast("string"))
    return sales.withColumns({"searches": searches, "rank": rank})


@query(
    "clean_values",
    plain(f"""WITH {_DIRTY_SQL} SELECT ingredient_id, week_end,
      CASE WHEN n_lines % 7 NOT IN (1, 2, 3, 4) THEN CAST(searches AS DOUBLE) END AS searches,
      CASE WHEN n_lines % 5 NOT IN (1, 2) THEN CAST(rank AS DOUBLE) END AS rank FROM dirty""",
          ("week_end",), ("searches", "rank")),
)
def clean_values(spark, folder):
    """unusable numbers become NULL, never zero."""
    return P.clean_measures(dirty_sales(spark, folder).drop("n_lines"))


@query(
    "data_quality",
    plain(f"""WITH {_DIRTY_SQL}, invalid AS (SELECT ingredient_id,
        count(*) FILTER (WHERE n_lines % 7 IN (1, 2, 3, 4)) AS invalid_search_values,
        count(*) FILTER (WHERE n_lines % 5 IN (1, 2)) AS invalid_rank_values,
        count(*) FILTER (WHERE n_lines % 7 IN (1, 3, 4)) AS non_numeric_search_values,
        count(*) FILTER (WHERE n_lines % 7 NOT IN (1, 2, 3, 4)) AS good,
        min(week_end) AS first_week, max(week_end) AS last_week FROM dirty GROUP BY 1)
      SELECT ingredient_id, invalid_search_values, invalid_rank_values, non_numeric_search_values,
        (last_week - first_week) // 7 + 1 AS weeks, (last_week - first_week) // 7 + 1 - good AS missing_amazon,
        first_week, last_week FROM invalid""", ("first_week", "last_week")),
)
def data_quality(spark, folder):
    """Invalid and missing values per entity."""
    raw = dirty_sales(spark, folder).drop("n_lines")
    filled = P.gap_fill(P.clean_measures(raw)).withColumn("google_trend", F.lit(None).cast("double"))
    return P.value_quality(raw).join(P.panel_quality(filled).drop("missing_google"), "ingredient_id")


# --- features ------------------------------------------------------------------------------------
def _features(spark, folder):
    return X.samples(X.weekly_features(T.panel_a(spark, folder)))


AMAZON = ["baseline", "level_log", "short_momentum", "quarter_momentum", "halfyear_momentum", "seasonal_momentum", "volatility"]
TREND = ["google_level", "google_short", "google_quarter"]
RANKS = ["rank_log", "rank_momentum"]


def _feature_sql(columns, doubles):
    return plain(f"{S.base('a', 'features')} SELECT {', '.join(columns)} FROM feat_a", ("origin",), tuple(doubles))


@query("features_amazon", _feature_sql(["ingredient_id", "origin", *AMAZON], AMAZON))
def features_amazon(spark, folder):
    """History gate, level, momenta and volatility."""
    return _features(spark, folder).select("ingredient_id", "origin", *AMAZON)


@query("features_trend", _feature_sql(["ingredient_id", "origin", "google_available", *TREND], TREND))
def features_trend(spark, folder):
    """Trend features where enough weeks are known."""
    return _features(spark, folder).select("ingredient_id", "origin", "google_available", *TREND)


@query("features_rank", _feature_sql(["ingredient_id", "origin", "rank_available", *RANKS], RANKS))
def features_rank(spark, folder):
    """Rank strength and its momentum."""
    return _features(spark, folder).select("ingredient_id", "origin", "rank_available", *RANKS)


@query("seasonal_naive", _feature_sql(["ingredient_id", "origin", "seasonal_13", "seasonal_26"], ["seasonal_13", "seasonal_26"]))
def seasonal_naive(spark, folder):
    """The same weeks one year earlier."""
    return _features(spark, folder).select("ingredient_id", "origin", "seasonal_13", "seasonal_26")


@query(
    "targets",
    plain(f"{S.base('a', 'features')} SELECT ingredient_id, origin, target_13, target_26, target_end_13, target_end_26 FROM feat_a",
          ("origin", "target_end_13", "target_end_26"), ("target_13", "target_26")),
)
def targets(spark, folder):
    """Forward means, only where the whole window is observed."""
    return _features(spark, folder).select("ingredient_id", "origin", "target_13", "target_26", "target_end_13", "target_end_26")


# --- protocol ------------------------------------------------------------------------------------
@query("family_holdout", f"SELECT p_brand AS family_id, p_type, {S.HELDOUT.format('p_brand')} AS brand_heldout, {S.HELDOUT.format('p_type')} AS type_heldout, count(*) AS n_parts FROM part GROUP BY 1, 2")
def family_holdout(spark, folder):
    """M1: stable hash hold-out of families."""
    part = T.table(spark, folder, "part")
    return part.groupBy(F.col("p_brand").alias("family_id"), "p_type").agg(F.count("*").alias("n_parts")).withColumns(
        {"brand_heldout": is_heldout(F.col("family_id")), "type_heldout": is_heldout(F.col("p_type"))}
    )


@query("calendar_origins", plain(f"{S.base('a', 'cases')} SELECT o.origin, b.as_of, b.test_start FROM origins_a o, bounds_a b", ("origin", "as_of", "test_start")))
def calendar_origins(spark, folder):
    """The global four-week calendar between first possible and last useful origin."""
    return B.evaluation_origins(B.panel_bounds(T.panel_a(spark, folder)))


@query("origin_split", plain(f"{S.base('a', 'cases')} SELECT horizon_weeks, origin, target_end, split, count(*) AS n_cases FROM cases_a GROUP BY ALL", ("origin", "target_end")))
def origin_split(spark, folder):
    """validation and sealed cases; windows across the boundary are dropped."""
    panel = T.panel_a(spark, folder)
    cases = B.evaluation_cases(X.samples(X.weekly_features(panel)), B.evaluation_origins(B.panel_bounds(panel)))
    return cases.groupBy("horizon_weeks", "origin", "target_end", "split").agg(F.count("*").alias("n_cases"))


def _train_sql(select: str) -> str:
    labels = " UNION ALL ".join(
        f"""SELECT family_id, heldout, origin, {h} AS horizon_weeks, target_end_{h} AS target_end, google_available, rank_available,
        level_log, volatility, rank_log, google_level, ln(1 + target_{h}) - ln(1 + baseline) AS y
        FROM feat_a WHERE target_{h} IS NOT NULL AND {S.GRID.format('origin')}"""
        for h in HORIZONS
    )
    return f"""{S.base('a', 'cases')},
labels AS ({labels}),
models(model, needs_google, needs_rank) AS (VALUES ('ridge_amazon', false, false), ('ridge_google', true, false),
  ('ridge_aba', false, true), ('ridge_all', true, true)),
wanted AS (SELECT 'backtest' AS scope, origin FROM origins_a UNION ALL SELECT 'deploy', as_of FROM bounds_a),
train AS (SELECT w.scope, l.horizon_weeks, m.model, w.origin AS fit_origin, l.* EXCLUDE (horizon_weeks)
  FROM wanted w JOIN labels l ON l.target_end <= w.origin AND (w.scope = 'deploy' OR NOT l.heldout)
  JOIN models m ON (l.google_available OR NOT m.needs_google) AND (l.rank_available OR NOT m.needs_rank))
{select}"""


def full(spark, folder):
    return run_analysis(T.panel_a(spark, folder))


def _training(spark, folder):
    return full(spark, folder).training


@query(
    "train_moments",
    plain(_train_sql("""SELECT scope, horizon_weeks, model, fit_origin AS origin, count(*) AS n_rows, sum(y) AS sum_y,
      sum(level_log - 8) AS sum_level, sum((level_log - 8) * (level_log - 8)) AS sum_level_sq,
      sum((level_log - 8) * volatility) AS sum_level_volatility, sum((level_log - 8) * y) AS sum_level_y,
      sum(CASE WHEN model IN ('ridge_aba', 'ridge_all') THEN volatility * (rank_log + 6) END) AS sum_volatility_rank
      FROM train GROUP BY scope, horizon_weeks, model, fit_origin"""), ("origin",),
          ("sum_y", "sum_level", "sum_level_sq", "sum_level_volatility", "sum_level_y", "sum_volatility_rank")),
)
def train_moments(spark, folder):
    """Walk-forward moments by running sums (the SQL uses the range join)."""
    at = {name: i for i, name in enumerate(FEATURES)}
    level, volatility, rank = at["level_log"], at["volatility"], at["rank_log"]
    with_rank = F.col("model").isin("ridge_aba", "ridge_all")
    return (
        _training(spark, folder)
        .filter("n > 0")
        .select(
            "scope", "horizon_weeks", "model", "origin",
            F.col("n").cast("bigint").alias("n_rows"),
            F.col("y").alias("sum_y"),
            F.col(f"x_{level}").alias("sum_level"),
            F.col(f"xx_{level}_{level}").alias("sum_level_sq"),
            F.col(f"xx_{level}_{volatility}").alias("sum_level_volatility"),
            F.col(f"xy_{level}").alias("sum_level_y"),
            F.when(with_rank, F.col(f"xx_{volatility}_{rank}")).alias("sum_volatility_rank"),
        )
    )


@query(
    "train_gates",
    plain(_train_sql("""SELECT scope, horizon_weeks, model, fit_origin AS origin, count(*) AS n_rows, count(DISTINCT family_id) AS n_families,
      count(DISTINCT origin) AS n_origins, max(target_end) AS max_label_end FROM train GROUP BY scope, horizon_weeks, model, fit_origin"""), ("origin", "max_label_end")),
)
def train_gates(spark, folder):
    """Rows, families, origins and last label of every fit."""
    return M.training_audit(_training(spark, folder)).filter("n_rows > 0")


# --- backtests -----------------------------------------------------------------------------------
LONG = ["ingredient_id", "family_id", "origin", "target_end", "horizon_weeks", "split", "model", "actual", "predicted", "baseline"]


def naive(spark, folder):
    return run_analysis(T.panel_a(spark, folder), with_ridge=False)


@query(
    "naive_backtest",
    plain(f"{S.base('a', 'cases')} SELECT {', '.join(LONG)} FROM long_a", ("origin", "target_end"), ("actual", "predicted", "baseline")),
)
def naive_backtest(spark, folder):
    """M6, M8 for the two baselines, in long form."""
    return naive(spark, folder).backtests.select(*LONG)


_CALIBRATION_SQL = """calibrated AS (SELECT horizon_weeks, model, count(*) AS n, count(DISTINCT origin) AS n_origins,
  CASE WHEN count(*) >= 20 AND count(DISTINCT origin) >= 2 THEN quantile_cont(ln(1 + actual) - ln(1 + predicted), 0.1) END AS low,
  CASE WHEN count(*) >= 20 AND count(DISTINCT origin) >= 2 THEN quantile_cont(ln(1 + actual) - ln(1 + predicted), 0.9) END AS high
  FROM long_a WHERE split = 'validation' GROUP BY 1, 2)"""
_INTERVAL_SQL = f"""{_CALIBRATION_SQL},
bounded AS (SELECT l.*,
  CASE WHEN split IN ('sealed_test', 'group_sealed_test') THEN greatest(0, exp(least(greatest(ln(1 + predicted) + low, -20), 30)) - 1) END AS lower,
  CASE WHEN split IN ('sealed_test', 'group_sealed_test') THEN greatest(0, exp(least(greatest(ln(1 + predicted) + high, -20), 30)) - 1) END AS upper
  FROM long_a l LEFT JOIN calibrated USING (horizon_weeks, model))"""


@query("calibration_quantiles", plain(f"{S.base('a', 'cases')}, {_CALIBRATION_SQL} SELECT * FROM calibrated", (), ("low", "high")))
def calibration_quantiles(spark, folder):
    """Exact residual quantiles by sketch, bracket and rank."""
    return naive(spark, folder).calibration


@query(
    "intervals",
    plain(f"{S.base('a', 'cases')}, {_INTERVAL_SQL} SELECT {', '.join(LONG)}, lower, upper FROM bounded",
          ("origin", "target_end"), ("actual", "predicted", "baseline", "lower", "upper")),
)
def intervals(spark, folder):
    """M9: empirical intervals on sealed rows only."""
    return naive(spark, folder).backtests.select(*LONG, "lower", "upper")


@query(
    "metrics_summary",
    plain(f"{S.base('a', 'cases')}, {_INTERVAL_SQL} SELECT horizon_weeks, split, model, {S.metric_columns(True)} FROM bounded GROUP BY 1, 2, 3", (), S.METRIC_DOUBLES),
)
def metrics_summary(spark, folder):
    """A3, A4: errors by horizon, split and model."""
    return naive(spark, folder).summary


_SCORED_SQL = f"""scored AS (SELECT horizon_weeks, model, {S.metric_columns()} FROM long_a WHERE split = 'validation' GROUP BY 1, 2),
size AS (SELECT horizon_weeks, n AS n_cases, n_origins AS case_origins, wape AS baseline_wape FROM scored WHERE model = 'last13mean'),
names(model, model_order) AS (VALUES {', '.join(f"('{m}', {i})" for i, m in enumerate(MODELS))}),
compared AS (SELECT z.horizon_weeks, m.model, CAST(m.model_order AS BIGINT) AS model_order, 'validation' AS split, 'selection_common_cases' AS comparison,
  (n_cases >= 20 AND case_origins >= 2 AND coalesce(s.n, 0) = n_cases) AS eligible_for_selection,
  CAST(coalesce(s.n, 0) AS DOUBLE) / n_cases AS coverage, n_cases, case_origins AS n_origins, baseline_wape,
  coalesce(s.n, 0) AS n, mae, wape, rmse, direction_accuracy
  FROM size z CROSS JOIN names m LEFT JOIN scored s ON s.horizon_weeks = z.horizon_weeks AND s.model = m.model),
picked AS (SELECT z.horizon_weeks, coalesce(arg_min(c.model, c.wape), 'last13mean') AS model, 'validation' AS selection_split,
  z.n_cases, z.case_origins AS n_origins, z.baseline_wape, coalesce(min(c.wape), z.baseline_wape) AS selected_wape,
  CASE WHEN count(c.model) > 0 THEN 'validation_improvement' ELSE 'conservative_baseline' END AS reason
  FROM size z LEFT JOIN compared c ON c.horizon_weeks = z.horizon_weeks AND c.eligible_for_selection AND c.model <> 'last13mean'
    AND c.wape < z.baseline_wape AND c.wape <= 0.95::DOUBLE * z.baseline_wape
  GROUP BY z.horizon_weeks, z.n_cases, z.case_origins, z.baseline_wape)"""


@query("selection_comparison", plain(f"{S.base('a', 'cases')}, {_SCORED_SQL} SELECT * FROM compared", (), ("coverage", "baseline_wape", "mae", "wape", "rmse", "direction_accuracy")))
def selection_comparison(spark, folder):
    """M7: every model on the common validation cases, eligible or not."""
    return naive(spark, folder).selection_comparison


@query("select_naive", plain(f"{S.base('a', 'cases')}, {_SCORED_SQL} SELECT * FROM picked", (), ("baseline_wape", "selected_wape")))
def select_naive(spark, folder):
    """M7: chosen model per horizon among the baselines."""
    return naive(spark, folder).selected


_PAIR_SQL = f"""paired AS (SELECT l.* FROM long_a l SEMI JOIN (SELECT ingredient_id, origin, horizon_weeks FROM long_a
  GROUP BY ALL HAVING count(DISTINCT model) = 2) k USING (ingredient_id, origin, horizon_weeks))"""


@query("ablation_naive", plain(f"{S.base('a', 'cases')}, {_PAIR_SQL} SELECT horizon_weeks, split, model, {S.metric_columns()} FROM paired GROUP BY 1, 2, 3", (), S.METRIC_DOUBLES))
def ablation_naive(spark, folder):
    """Two models on exactly the cases both predicted."""
    from weekcast.operators.evaluate import metrics

    both = naive(spark, folder).wide.filter("p_last13mean is not null and p_seasonal is not null")
    return metrics(B.to_long(both), ["horizon_weeks", "split", "model"])


@query(
    "sealed_audit",
    plain(f"""{S.base('a', 'cases')}, {_SCORED_SQL}, sealed AS (SELECT p.horizon_weeks, p.model AS chosen, l.actual, b.predicted AS base, l.predicted AS ours
        FROM picked p JOIN long_a l ON l.horizon_weeks = p.horizon_weeks AND l.model = p.model AND l.split = 'sealed_test'
        JOIN long_a b ON b.horizon_weeks = l.horizon_weeks AND b.ingredient_id = l.ingredient_id AND b.origin = l.origin AND b.model = 'last13mean')
      SELECT horizon_weeks, chosen, count(*) AS n_matching_cases, sum(abs(actual - ours)) / sum(actual) AS model_wape,
        sum(abs(actual - base)) / sum(actual) AS baseline_wape, avg(abs(actual - ours)) AS model_mae, avg(abs(actual - base)) AS baseline_mae,
        false AS used_for_selection, (chosen <> 'last13mean' AND sum(abs(actual - ours)) / sum(actual) >= sum(abs(actual - base)) / sum(actual)) AS failed_sealed_test
      FROM sealed GROUP BY 1, 2""", (), ("model_wape", "baseline_wape", "model_mae", "baseline_mae")),
)
def sealed_audit(spark, folder):
    """Chosen model against the baseline on matching sealed cases."""
    return naive(spark, folder).sealed_audit


@query(
    "displayed_backtests",
    plain(f"""{S.base('a', 'cases')}, {_SCORED_SQL}
      SELECT l.ingredient_id, l.family_id, l.origin, l.target_end, l.horizon_weeks, l.split, l.model, l.actual, l.predicted, l.baseline
      FROM long_a l JOIN picked p USING (horizon_weeks)
      QUALIFY row_number() OVER (PARTITION BY l.ingredient_id, l.horizon_weeks, l.origin
        ORDER BY CASE WHEN l.model = p.model THEN 0 WHEN l.model = 'last13mean' THEN 1 ELSE 2 END) = 1""",
          ("origin", "target_end"), ("actual", "predicted", "baseline")),
)
def displayed_backtests(spark, folder):
    """The chosen model's row per case, else the baseline's."""
    return naive(spark, folder).displayed.select(*LONG)


@query(
    "forecast_naive",
    plain(f"""{S.base('a', 'cases')}, {_SCORED_SQL}, {_CALIBRATION_SQL},
      recent AS (SELECT p.ingredient_id, avg(searches) AS baseline FROM panel_a p, bounds_a b
        WHERE week_end BETWEEN as_of - 84 AND as_of GROUP BY 1 HAVING count(searches) = 13),
      cur AS (SELECT f.* FROM feat_a f, bounds_a b WHERE f.origin = b.as_of),
      everyone AS (SELECT DISTINCT ingredient_id FROM panel_a),
      joined AS (SELECT e.ingredient_id, p.horizon_weeks, p.model AS chosen, cur.ingredient_id IS NOT NULL AS eligible, r.baseline,
          CASE p.horizon_weeks WHEN 13 THEN cur.seasonal_13 ELSE cur.seasonal_26 END AS seasonal
        FROM everyone e CROSS JOIN picked p LEFT JOIN cur USING (ingredient_id) LEFT JOIN recent r USING (ingredient_id)),
      used AS (SELECT *, CASE WHEN NOT eligible THEN CASE WHEN baseline IS NOT NULL THEN 'last13mean' END
            WHEN chosen = 'seasonal' AND seasonal IS NOT NULL THEN 'seasonal' ELSE 'last13mean' END AS model,
          CASE WHEN eligible AND chosen = 'seasonal' AND seasonal IS NOT NULL THEN seasonal ELSE baseline END AS predicted_mean FROM joined)
      SELECT u.ingredient_id, u.ingredient_id AS family_id, u.horizon_weeks, baseline, predicted_mean,
        CASE WHEN baseline > 0 THEN (predicted_mean / baseline - 1) * 100 END AS growth_pct,
        CASE WHEN eligible THEN greatest(0, exp(ln(1 + predicted_mean) + low) - 1) END AS lower,
        CASE WHEN eligible THEN greatest(0, exp(ln(1 + predicted_mean) + high) - 1) END AS upper, u.model,
        CASE WHEN eligible AND u.model <> 'last13mean' THEN 'ok' WHEN u.model IS NOT NULL THEN 'baseline_only' ELSE 'insufficient_data' END AS status,
        CASE WHEN eligible THEN coalesce(c.n, 0) ELSE 0 END AS n_calibration,
        CASE WHEN eligible AND low IS NOT NULL THEN 'empirical_80pct' WHEN eligible THEN 'insufficient_calibration'
             WHEN baseline IS NOT NULL THEN 'insufficient_history' END AS interval_status,
        CASE WHEN eligible AND chosen <> u.model THEN 'selected_model_unavailable'
             WHEN NOT eligible AND baseline IS NOT NULL THEN 'requires_104_complete_weeks_for_model' END AS fallback_reason
      FROM used u LEFT JOIN calibrated c ON c.horizon_weeks = u.horizon_weeks AND c.model = u.model""",
          (), ("baseline", "predicted_mean", "growth_pct", "lower", "upper")),
)
def forecast_naive(spark, folder):
    """Forecast rows with status, interval and fallback reason."""
    return naive(spark, folder).plain_forecasts


@query(
    "ingredient_diagnostics",
    plain(f"""{S.base('a', 'features')} SELECT p.ingredient_id, p.ingredient_id AS family_id, 'sellersprite' AS amazon_provider, count(*) AS history_weeks,
      count(searches) AS observed_weeks, count(*) - count(searches) AS missing_weeks, count(google_trend) AS google_weeks,
      count(rank) AS rank_weeks, max(week_end) AS latest_week, {S.HELDOUT.format('p.ingredient_id')} AS heldout,
      bool_or(f.origin IS NOT NULL) AS as_of_eligible
      FROM panel_a p LEFT JOIN (SELECT ingredient_id, origin FROM feat_a WHERE origin = (SELECT max(week_end) FROM panel_a)) f USING (ingredient_id)
      GROUP BY p.ingredient_id""", ("latest_week",)),
)
def ingredient_diagnostics(spark, folder):
    """History, missing, trend and rank weeks per entity."""
    return naive(spark, folder).diagnostics


# --- all six models ------------------------------------------------------------------------------
# The SQL builds every training set by the range join, solves each fit by Gauss-Jordan elimination in
# a recursive statement and predicts case by case. Values are compared to four decimals.
_AT = {name: i + 1 for i, name in enumerate(FEATURES)}
_MODEL_ROWS = ", ".join(
    f"({m!r}, {'google_level' in c}, {'rank_log' in c}, {[_AT[f] for f in c]})" for m, c in RIDGE_MODELS.items()
)
_RIDGE_SQL = f"""labels AS ({" UNION ALL ".join(
    f"SELECT family_id, heldout, origin, {h} AS horizon_weeks, target_end_{h} AS target_end, google_available, rank_available, "
    f"[{', '.join(FEATURES)}] AS x, ln(1 + target_{h}) - ln(1 + baseline) AS y "
    f"FROM feat_a WHERE target_{h} IS NOT NULL AND {S.GRID.format('origin')}" for h in HORIZONS)}),
models(model, needs_google, needs_rank, used) AS (VALUES {_MODEL_ROWS}),
wanted AS (SELECT 'backtest' AS scope, origin FROM origins_a UNION ALL SELECT 'deploy', as_of FROM bounds_a),
train AS (SELECT w.scope, l.horizon_weeks, m.model, w.origin AS fit_origin, l.family_id, l.origin, l.y,
    list_transform(m.used, lambda f: l.x[f]) AS xs, len(m.used) AS width
  FROM wanted w JOIN labels l ON l.target_end <= w.origin AND (w.scope = 'deploy' OR NOT l.heldout)
  JOIN models m ON (l.google_available OR NOT m.needs_google) AND (l.rank_available OR NOT m.needs_rank)),
gated AS (SELECT scope, horizon_weeks, model, fit_origin, avg(y) AS intercept FROM train GROUP BY scope, horizon_weeks, model, fit_origin
  HAVING count(*) >= 40 AND count(DISTINCT family_id) >= 4 AND count(DISTINCT origin) >= 4),
wide_rows AS (SELECT t.*, unnest(range(1, width + 1)) AS i FROM train t SEMI JOIN gated g USING (scope, horizon_weeks, model, fit_origin)),
columns_ AS (SELECT scope, horizon_weeks, model, fit_origin, i, count(*) AS n, avg(xs[i]) AS mean, stddev_pop(xs[i]) AS scale, covar_pop(xs[i], y) AS xy
  FROM wide_rows GROUP BY 1, 2, 3, 4, 5),
products AS (SELECT scope, horizon_weeks, model, fit_origin, i, j, covar_pop(xs[i], xs[j]) AS xx
  FROM (SELECT *, unnest(range(1, width + 1)) AS j FROM wide_rows) GROUP BY 1, 2, 3, 4, 5, 6),
matrix_rows AS (SELECT p.scope, p.horizon_weeks, p.model, p.fit_origin, p.i,
    list(a.n * p.xx / (a.scale * b.scale) + CASE WHEN p.i = p.j THEN 10 ELSE 0 END ORDER BY p.j) || [any_value(a.n * a.xy / a.scale)] AS r
  FROM products p JOIN columns_ a ON (a.scope, a.horizon_weeks, a.model, a.fit_origin, a.i) = (p.scope, p.horizon_weeks, p.model, p.fit_origin, p.i)
  JOIN columns_ b ON (b.scope, b.horizon_weeks, b.model, b.fit_origin, b.i) = (p.scope, p.horizon_weeks, p.model, p.fit_origin, p.j) GROUP BY 1, 2, 3, 4, 5),
steps AS (SELECT scope, horizon_weeks, model, fit_origin, 1 AS k, list(r ORDER BY i) AS m FROM matrix_rows GROUP BY 1, 2, 3, 4
  UNION ALL SELECT scope, horizon_weeks, model, fit_origin, k + 1,
    list_transform(m, lambda r, i: CASE WHEN i = k THEN piv ELSE list_transform(r, lambda v, j: v - r[k] * piv[j]) END)
  FROM (SELECT *, list_transform(m[k], lambda v: v / m[k][k]) AS piv FROM steps WHERE k <= len(m))),
solved AS (SELECT scope, horizon_weeks, model, fit_origin, list_transform(m, lambda r: r[len(m) + 1]) AS beta FROM steps WHERE k = len(m) + 1),
shape AS (SELECT scope, horizon_weeks, model, fit_origin, list(mean ORDER BY i) AS means, list(scale ORDER BY i) AS scales FROM columns_ GROUP BY 1, 2, 3, 4),
fits AS (SELECT s.*, means, scales, intercept, used, needs_google, needs_rank FROM solved s JOIN shape USING (scope, horizon_weeks, model, fit_origin)
  JOIN gated USING (scope, horizon_weeks, model, fit_origin) JOIN models USING (model))"""


def _delta(x: str) -> str:
    return (
        f"intercept + list_sum(list_transform(used, lambda f, q: ({x}[f] - means[q]) / scales[q] * beta[q]))"
    )


_SIX_SQL = f"""{_RIDGE_SQL},
case_x AS (SELECT c.*, [{', '.join('f.' + f for f in FEATURES)}] AS x, google_available, rank_available
  FROM cases_a c JOIN feat_a f ON f.ingredient_id = c.ingredient_id AND f.origin = c.origin),
six AS (SELECT ingredient_id, family_id, heldout, origin, target_end, horizon_weeks, actual, baseline, split, model, predicted FROM long_a
  UNION ALL SELECT c.ingredient_id, c.family_id, c.heldout, c.origin, c.target_end, c.horizon_weeks, c.actual, c.baseline, c.split, t.model,
    greatest(0, exp(least(greatest(ln(1 + c.baseline) + {_delta('c.x')}, -20), 30)) - 1)
  FROM case_x c JOIN fits t ON t.scope = 'backtest' AND t.fit_origin = c.origin AND t.horizon_weeks = c.horizon_weeks
    AND (c.google_available OR NOT t.needs_google) AND (c.rank_available OR NOT t.needs_rank)),
calibrated AS (SELECT horizon_weeks, model, count(*) AS n,
    CASE WHEN count(*) >= 20 AND count(DISTINCT origin) >= 2 THEN quantile_cont(ln(1 + actual) - ln(1 + predicted), 0.1) END AS low,
    CASE WHEN count(*) >= 20 AND count(DISTINCT origin) >= 2 THEN quantile_cont(ln(1 + actual) - ln(1 + predicted), 0.9) END AS high
  FROM six WHERE split = 'validation' GROUP BY 1, 2),
bounded AS (SELECT s.*, CASE WHEN split LIKE '%sealed_test' THEN greatest(0, exp(ln(1 + predicted) + low) - 1) END AS lower,
    CASE WHEN split LIKE '%sealed_test' THEN greatest(0, exp(ln(1 + predicted) + high) - 1) END AS upper FROM six s LEFT JOIN calibrated USING (horizon_weeks, model))"""

# Common cases: those ridge_amazon predicted, or all where it predicted none.
_CHOICE_SQL = f"""{_SIX_SQL},
valid AS (SELECT * FROM six WHERE split = 'validation'),
keys AS (SELECT v.horizon_weeks, ingredient_id, origin FROM valid v WHERE model = 'ridge_amazon'
  UNION ALL SELECT horizon_weeks, ingredient_id, origin FROM valid WHERE model = 'last13mean' AND horizon_weeks NOT IN (SELECT horizon_weeks FROM valid WHERE model = 'ridge_amazon')),
scored6 AS (SELECT horizon_weeks, model, count(*) AS n, count(DISTINCT origin) AS n_origins, sum(abs(actual - predicted)) / sum(actual) AS wape
  FROM valid SEMI JOIN keys USING (horizon_weeks, ingredient_id, origin) GROUP BY 1, 2),
size6 AS (SELECT horizon_weeks, n AS n_cases, n_origins, wape AS baseline_wape FROM scored6 WHERE model = 'last13mean'),
chosen6 AS (SELECT z.horizon_weeks, coalesce(arg_min(c.model, c.wape), 'last13mean') AS model, 'validation' AS selection_split, z.n_cases, z.n_origins, z.baseline_wape,
    coalesce(min(c.wape), z.baseline_wape) AS selected_wape, CASE WHEN count(c.model) > 0 THEN 'validation_improvement' ELSE 'conservative_baseline' END AS reason
  FROM size6 z LEFT JOIN scored6 c ON c.horizon_weeks = z.horizon_weeks AND c.n = z.n_cases AND z.n_cases >= 20 AND z.n_origins >= 2 AND c.model <> 'last13mean'
    AND c.wape < z.baseline_wape AND c.wape <= 0.95::DOUBLE * z.baseline_wape GROUP BY z.horizon_weeks, z.n_cases, z.n_origins, z.baseline_wape)"""


def _six(tail: str, dates=(), doubles=()) -> str:
    return four(f"{S.base('a', 'cases').replace('WITH ', 'WITH RECURSIVE ', 1)}, {tail}", dates, doubles)


def four(sql: str, dates=(), doubles=()) -> str:
    changes = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates] + [f"round(CAST({c} AS DOUBLE), 4) + 0.0 AS {c}" for c in doubles]
    return f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql}) AS answer"


def rounded(df):
    """Doubles to four decimals: two solvers agree to about twelve digits."""
    return df.withColumns({c: F.round(c, 4) for c, kind in df.dtypes if kind == "double"})


@query(
    "ridge_fits",
    _six(f"""{_RIDGE_SQL}, names AS (SELECT {list(FEATURES)!r} AS all_names),
      spread AS (SELECT scope, horizon_weeks, model, fit_origin AS origin, 10.0::DOUBLE AS alpha, intercept, all_names[used[q]] AS feature, means[q] AS scaler_mean,
        scales[q] AS scaler_scale, beta[q] AS coefficient FROM (SELECT *, unnest(range(1, len(used) + 1)) AS q FROM fits), names) SELECT * FROM spread""",
         ("origin",), ("alpha", "intercept", "scaler_mean", "scaler_scale", "coefficient")),
)
def ridge_fits(spark, folder):
    """M5, K6: fitted parameters of every walk-forward and deployment fit."""
    parts = F.arrays_zip("features", "scaler_mean", "scaler_scale", "coefficients")
    rows = full(spark, folder).fits.select("scope", "horizon_weeks", "model", "origin", "alpha", "intercept", F.inline(parts))
    return rounded(rows.withColumnsRenamed({"features": "feature", "coefficients": "coefficient"}))


@query(
    "ridge_backtest",
    _six(f"{_SIX_SQL} SELECT {', '.join(LONG)}, lower, upper FROM bounded", ("origin", "target_end"), ("actual", "predicted", "baseline", "lower", "upper")),
)
def ridge_backtest(spark, folder):
    """M6, M8: all six models, long form with intervals."""
    return rounded(full(spark, folder).backtests.select(*LONG, "lower", "upper"))


@query("ridge_summary", _six(f"{_SIX_SQL} SELECT horizon_weeks, split, model, {S.metric_columns(True)} FROM bounded GROUP BY 1, 2, 3", (), S.METRIC_DOUBLES))
def ridge_summary(spark, folder):
    """A4 over all six models."""
    return rounded(full(spark, folder).summary)


@query("ridge_selection", _six(f"{_CHOICE_SQL} SELECT * FROM chosen6", (), ("baseline_wape", "selected_wape")))
def ridge_selection(spark, folder):
    """M7 over all six models."""
    return rounded(full(spark, folder).selected)


_ABLATION_ROWS = ", ".join(f"({name!r}, {a!r}, {b!r})" for name, (a, b) in ABLATIONS.items())


@query(
    "ridge_ablations",
    _six(f"""{_SIX_SQL}, pairs(comparison, one, two) AS (VALUES {_ABLATION_ROWS}),
      matched AS (SELECT p.comparison, s.* FROM six s JOIN pairs p ON s.model IN (p.one, p.two)
        JOIN six o ON o.ingredient_id = s.ingredient_id AND o.origin = s.origin AND o.horizon_weeks = s.horizon_weeks AND o.model = CASE WHEN s.model = p.one THEN p.two ELSE p.one END)
      SELECT horizon_weeks, split, comparison, model, {S.metric_columns()} FROM matched GROUP BY 1, 2, 3, 4""", (), S.METRIC_DOUBLES),
)
def ridge_ablations(spark, folder):
    """A5: the four feature-source ablations on matched cases."""
    return rounded(full(spark, folder).ablations)


@query(
    "deploy_forecast",
    _six(f"""{_CHOICE_SQL},
      recent AS (SELECT p.ingredient_id, avg(searches) AS baseline FROM panel_a p, bounds_a b WHERE week_end BETWEEN as_of - 84 AND as_of GROUP BY 1 HAVING count(searches) = 13),
      cur AS (SELECT f.*, [{', '.join('f.' + f for f in FEATURES)}] AS x FROM feat_a f, bounds_a b WHERE f.origin = b.as_of),
      options AS (SELECT c.ingredient_id, k.horizon_weeks, k.model, CASE k.model WHEN 'last13mean' THEN c.baseline
          WHEN 'seasonal' THEN CASE k.horizon_weeks WHEN 13 THEN c.seasonal_13 ELSE c.seasonal_26 END END AS predicted FROM cur c CROSS JOIN chosen6 k WHERE k.model IN ('last13mean', 'seasonal')
        UNION ALL SELECT c.ingredient_id, k.horizon_weeks, k.model, greatest(0, exp(least(greatest(ln(1 + c.baseline) + {_delta('c.x')}, -20), 30)) - 1)
        FROM cur c CROSS JOIN chosen6 k JOIN fits t ON t.scope = 'deploy' AND t.horizon_weeks = k.horizon_weeks AND t.model = k.model
          AND (c.google_available OR NOT t.needs_google) AND (c.rank_available OR NOT t.needs_rank)),
      audit AS (SELECT k.horizon_weeks, sum(abs(s.actual - s.predicted)) / sum(s.actual) < sum(abs(s.actual - s.baseline)) / sum(s.actual) AS better
        FROM chosen6 k JOIN six s ON s.horizon_weeks = k.horizon_weeks AND s.model = k.model AND s.split = 'sealed_test' GROUP BY 1),
      joined AS (SELECT e.ingredient_id, k.horizon_weeks, k.model AS chosen, c.ingredient_id IS NOT NULL AS eligible, r.baseline, o.predicted AS own, better
        FROM (SELECT DISTINCT ingredient_id FROM panel_a) e CROSS JOIN chosen6 k LEFT JOIN cur c USING (ingredient_id) LEFT JOIN recent r USING (ingredient_id)
        LEFT JOIN options o ON o.ingredient_id = e.ingredient_id AND o.horizon_weeks = k.horizon_weeks LEFT JOIN audit a ON a.horizon_weeks = k.horizon_weeks),
      used6 AS (SELECT *, CASE WHEN eligible AND own IS NOT NULL THEN chosen WHEN baseline IS NOT NULL THEN 'last13mean' END AS model,
        CASE WHEN eligible AND own IS NOT NULL THEN own ELSE baseline END AS predicted_mean FROM joined)
      SELECT u.ingredient_id, u.ingredient_id AS family_id, u.horizon_weeks, baseline, predicted_mean, CASE WHEN baseline > 0 THEN (predicted_mean / baseline - 1) * 100 END AS growth_pct,
        CASE WHEN eligible THEN greatest(0, exp(ln(1 + predicted_mean) + low) - 1) END AS lower, CASE WHEN eligible THEN greatest(0, exp(ln(1 + predicted_mean) + high) - 1) END AS upper,
        u.model, CASE WHEN eligible AND u.model <> 'last13mean' THEN 'ok' WHEN u.model IS NOT NULL THEN 'baseline_only' ELSE 'insufficient_data' END AS status,
        CASE WHEN eligible THEN coalesce(c.n, 0) ELSE 0 END AS n_calibration,
        CASE WHEN eligible AND low IS NOT NULL THEN 'empirical_80pct' WHEN eligible THEN 'insufficient_calibration' WHEN baseline IS NOT NULL THEN 'insufficient_history' END AS interval_status,
        CASE WHEN eligible AND chosen <> u.model THEN 'selected_model_unavailable' WHEN NOT eligible AND baseline IS NOT NULL THEN 'requires_104_complete_weeks_for_model' END AS fallback_reason,
        coalesce(better AND u.model <> 'last13mean', false) AS has_proven_gain
      FROM used6 u LEFT JOIN calibrated c ON c.horizon_weeks = u.horizon_weeks AND c.model = u.model""",
         (), ("baseline", "predicted_mean", "growth_pct", "lower", "upper")),
)
def deploy_forecast(spark, folder):
    """Forecasts from fits on all families, with the gain flag."""
    return rounded(full(spark, folder).forecasts)


@query(
    "analysis_warnings",
    f"""{S.base('a', 'cases').replace('WITH ', 'WITH RECURSIVE ', 1)}, {_CHOICE_SQL},
      failed AS (SELECT k.horizon_weeks || ':' || k.model AS detail FROM chosen6 k JOIN six s ON s.horizon_weeks = k.horizon_weeks AND s.model = k.model AND s.split = 'sealed_test'
        WHERE k.model <> 'last13mean' GROUP BY k.horizon_weeks, k.model HAVING sum(abs(s.actual - s.predicted)) >= sum(abs(s.actual - s.baseline)))
      SELECT 'stale_data' AS code, CAST({S.AS_OF} + 30 - as_of AS VARCHAR) AS detail FROM bounds_a
      UNION ALL SELECT 'chosen_model_failed_sealed_test', detail FROM failed
      UNION ALL SELECT 'no_heldout_family', NULL WHERE NOT EXISTS (SELECT 1 FROM panel_a WHERE {S.HELDOUT.format('ingredient_id')})
      UNION ALL SELECT 'no_backtests', NULL WHERE NOT EXISTS (SELECT 1 FROM six)""",
)
def analysis_warnings(spark, folder):
    """Warning codes of the run, reported 30 days after the cut."""
    return full(spark, folder).warnings(F.date_add(F.lit(T.AS_OF), 30))


@query("ridge_calibration", _six(f"{_SIX_SQL} SELECT * FROM calibrated", (), ("low", "high")))
def ridge_calibration(spark, folder):
    """A6 over all six models."""
    return rounded(full(spark, folder).calibration.drop("n_origins"))


@query(
    "ridge_sealed_audit",
    _six(f"""{_CHOICE_SQL}, sealed AS (SELECT p.horizon_weeks, p.model AS chosen, l.actual, b.predicted AS base, l.predicted AS ours
        FROM chosen6 p JOIN six l ON l.horizon_weeks = p.horizon_weeks AND l.model = p.model AND l.split = 'sealed_test'
        JOIN six b ON b.horizon_weeks = l.horizon_weeks AND b.ingredient_id = l.ingredient_id AND b.origin = l.origin AND b.model = 'last13mean')
      SELECT horizon_weeks, chosen, count(*) AS n_matching_cases, sum(abs(actual - ours)) / sum(actual) AS model_wape,
        sum(abs(actual - base)) / sum(actual) AS baseline_wape, avg(abs(actual - ours)) AS model_mae, avg(abs(actual - base)) AS baseline_mae,
        false AS used_for_selection, (chosen <> 'last13mean' AND sum(abs(actual - ours)) / sum(actual) >= sum(abs(actual - base)) / sum(actual)) AS failed_sealed_test
      FROM sealed GROUP BY 1, 2""", (), ("model_wape", "baseline_wape", "model_mae", "baseline_mae")),
)
def ridge_sealed_audit(spark, folder):
    """M13 over all six models."""
    return rounded(full(spark, folder).sealed_audit)


@query(
    "ridge_displayed",
    _six(f"""{_CHOICE_SQL}
      SELECT l.ingredient_id, l.family_id, l.origin, l.target_end, l.horizon_weeks, l.split, l.model, l.actual, l.predicted, l.baseline
      FROM six l JOIN chosen6 p USING (horizon_weeks) WHERE l.model IN (p.model, 'last13mean')
      QUALIFY row_number() OVER (PARTITION BY l.ingredient_id, l.horizon_weeks, l.origin ORDER BY CASE WHEN l.model = p.model THEN 0 ELSE 1 END) = 1""",
         ("origin", "target_end"), ("actual", "predicted", "baseline")),
)
def ridge_displayed(spark, folder):
    """M12 over all six models: the chosen model's row per case, else the baseline's."""
    return rounded(full(spark, folder).displayed.select(*LONG))

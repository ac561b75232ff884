"""SQL fragments (DuckDB dialect) that the oracle statements are put together from."""

from __future__ import annotations

AS_OF = "DATE '2001-07-28'"
HORIZONS = (13, 26)


def saturday(column: str) -> str:
    return f"(CAST({column} AS DATE) + CAST(6 - dayofweek({column}) AS INTEGER))"


def rows(first: int, last: int) -> str:
    """Frame over an ingredient's weeks, offsets relative to the current week."""

    def edge(offset: int) -> str:
        if offset == 0:
            return "CURRENT ROW"
        return f"{abs(offset)} {'PRECEDING' if offset < 0 else 'FOLLOWING'}"

    return f"OVER (PARTITION BY ingredient_id ORDER BY week_end ROWS BETWEEN {edge(first)} AND {edge(last)})"


SALES_A = f"""sales_a AS (
  SELECT p_brand AS ingredient_id, {saturday('l_shipdate')} AS week_end, sum(l_quantity) AS searches,
         count(*) AS n_lines, CAST(floor(CAST(100000 AS DOUBLE) / count(*)) + 1 AS DOUBLE) AS rank
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

SALES_B = f"""sales_b AS (
  SELECT p_brand AS ingredient_id, {saturday('o_orderdate')} AS week_end,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) AS searches, count(*) AS n_lines,
         CAST(floor(CAST(100000 AS DOUBLE) / count(*)) + 1 AS DOUBLE) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def panel(side: str) -> str:
    """CTEs sales_x, trend_x, cal_x, panel_x for side a or b."""
    sales = SALES_A if side == "a" else SALES_B
    return f"""{sales},
trend_{side} AS (
  SELECT ingredient_id, week_end,
         CAST(100 AS DOUBLE) * n_lines / max(n_lines) OVER (PARTITION BY ingredient_id ORDER BY week_end) AS value
  FROM sales_{side}),
cal_{side} AS (
  SELECT ingredient_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM sales_{side} WHERE week_end < {AS_OF} GROUP BY 1),
panel_{side} AS (
  SELECT c.ingredient_id, c.week_end, s.searches, s.rank, t.value AS google_trend
  FROM cal_{side} c
  LEFT JOIN sales_{side} s ON s.ingredient_id = c.ingredient_id AND s.week_end = c.week_end
  LEFT JOIN trend_{side} t ON t.ingredient_id = c.ingredient_id AND t.week_end + 7 = c.week_end AND t.week_end < {AS_OF})"""


HELDOUT = "(CAST(concat('0x', substr(sha256({0}), 1, 8)) AS BIGINT) % 5 = 0)"


def log1p(x: str) -> str:
    return f"ln(1 + ({x}))"


def features(side: str) -> str:
    """CTE feat_x: one row per eligible ingredient and origin, straight from the definitions."""

    def mean(first: int, last: int) -> str:
        return f"avg(searches) {rows(first, last)}"

    def whole(first: int, last: int) -> str:
        width = last - first + 1
        return f"CASE WHEN count(searches) {rows(first, last)} = {width} THEN avg(searches) {rows(first, last)} END"

    google = (
        f"(count(google_trend) {rows(-3, 0)} >= 3 AND count(google_trend) {rows(-12, 0)} >= 10 "
        f"AND count(google_trend) {rows(-25, -13)} >= 10)"
    )
    ranked = f"(count(rank) {rows(-12, 0)} >= 10 AND count(rank) {rows(-25, -13)} >= 10)"

    def trend(first: int, last: int) -> str:
        return log1p(f"avg(google_trend) {rows(first, last)}")

    def strength(first: int, last: int) -> str:
        return f"avg(-ln(rank)) {rows(first, last)}"

    per_horizon = "".join(
        f""",
    {whole(-51, -(52 - h))} AS seasonal_{h}, {whole(1, h)} AS target_{h}, week_end + {7 * h} AS target_end_{h}"""
        for h in HORIZONS
    )
    return f"""feat_{side} AS (
  SELECT * EXCLUDE (observed) FROM (SELECT ingredient_id, ingredient_id AS family_id, week_end AS origin,
    {HELDOUT.format('ingredient_id')} AS heldout,
    count(searches) {rows(-103, 0)} AS observed,
    {mean(-12, 0)} AS baseline,
    {log1p(mean(-12, 0))} AS level_log,
    {log1p(mean(-3, 0))} - {log1p(mean(-12, 0))} AS short_momentum,
    {log1p(mean(-12, 0))} - {log1p(mean(-25, -13))} AS quarter_momentum,
    {log1p(mean(-25, 0))} - {log1p(mean(-51, -26))} AS halfyear_momentum,
    {log1p(mean(-12, 0))} - {log1p(mean(-64, -52))} AS seasonal_momentum,
    stddev_pop({log1p('searches')}) {rows(-25, 0)} AS volatility,
    {google} AS google_available,
    CASE WHEN {google} THEN {trend(-12, 0)} END AS google_level,
    CASE WHEN {google} THEN {trend(-3, 0)} - {trend(-12, 0)} END AS google_short,
    CASE WHEN {google} THEN {trend(-12, 0)} - {trend(-25, -13)} END AS google_quarter,
    {ranked} AS rank_available,
    CASE WHEN {ranked} THEN {strength(-12, 0)} END AS rank_log,
    CASE WHEN {ranked} THEN {strength(-12, 0)} - {strength(-25, -13)} END AS rank_momentum{per_horizon}
  FROM panel_{side}) WHERE observed = 104)"""


GRID = "((({0} - DATE '1970-01-03') // 7) % 4 = 0)"


def cases(side: str) -> str:
    """CTEs bounds_x, origins_x and cases_x (evaluation cases of the two baselines, one row per case)."""
    union = "\n  UNION ALL\n".join(
        f"""  SELECT f.ingredient_id, f.family_id, f.heldout, f.origin, target_end_{h} AS target_end, {h} AS horizon_weeks,
         target_{h} AS actual, f.baseline, seasonal_{h} AS seasonal
  FROM feat_{side} f JOIN origins_{side} USING (origin) WHERE target_{h} IS NOT NULL"""
        for h in HORIZONS
    )
    return f"""bounds_{side} AS (SELECT min(week_end) AS first_week, max(week_end) AS as_of, max(week_end) - 364 AS test_start FROM panel_{side}),
origins_{side} AS (
  SELECT origin FROM (SELECT CAST(unnest(generate_series(first_week + 7 * 129, as_of - 91, INTERVAL 7 DAY)) AS DATE) AS origin
  FROM bounds_{side}) WHERE {GRID.format('origin')}),
raw_cases_{side} AS (
{union}),
cases_{side} AS (
  SELECT c.*, CASE WHEN heldout THEN 'group_' ELSE '' END ||
         CASE WHEN target_end <= test_start THEN 'validation' WHEN origin >= test_start THEN 'sealed_test' END AS split
  FROM raw_cases_{side} c, bounds_{side}
  WHERE target_end <= as_of AND (target_end <= test_start OR origin >= test_start)),
long_{side} AS (
  SELECT * EXCLUDE (seasonal), 'last13mean' AS model, baseline AS predicted FROM cases_{side}
  UNION ALL SELECT * EXCLUDE (seasonal), 'seasonal', seasonal FROM cases_{side} WHERE seasonal IS NOT NULL)"""


def base(side: str, depth: str) -> str:
    """WITH clause down to ``panel``, ``features`` or ``cases``."""
    parts = [panel(side)]
    if depth in ("features", "cases"):
        parts.append(features(side))
    if depth == "cases":
        parts.append(cases(side))
    return "WITH " + ",\n".join(parts)


def metric_columns(intervals: bool = False) -> str:
    def sign(x: str) -> str:
        return f"(CASE WHEN {x} > 1.1::DOUBLE * baseline THEN 1 WHEN {x} < 0.9::DOUBLE * baseline THEN -1 ELSE 0 END)"

    extra = (
        "CAST(count(*) FILTER (WHERE lower IS NOT NULL AND actual BETWEEN lower AND upper) AS DOUBLE) "
        "/ nullif(count(lower), 0) AS interval_coverage, count(lower) AS n_intervals"
        if intervals
        else "CAST(NULL AS DOUBLE) AS interval_coverage, CAST(0 AS BIGINT) AS n_intervals"
    )
    return f"""count(*) AS n, count(DISTINCT origin) AS n_origins, avg(abs(actual - predicted)) AS mae,
  sum(abs(actual - predicted)) / nullif(sum(abs(actual)), 0) AS wape,
  sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
  avg(CASE WHEN {sign('actual')} = {sign('predicted')} THEN 1.0::DOUBLE ELSE 0 END) AS direction_accuracy, {extra}"""


METRIC_DOUBLES = ("mae", "wape", "rmse", "direction_accuracy", "interval_coverage")

"""Raw-file, landing and dataset queries over files written out of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.constants import VENDOR_A, VENDOR_B
from weekcast.operators import panel as P
from weekcast.operators.histories import normalize_entries, panel_entries
from weekcast.plans import raw_testbed as R, sql as S, testbed as T
from weekcast.plans.dataset import assemble_panel
from weekcast.plans.registry import plain, query
from weekcast.sources import landing as L, legacy as G
from weekcast.sources.envelopes import candidates, latest_valid

CUT = "DATE '2001-08-05'"
BN = "CAST(substr(ingredient_id, 7) AS INTEGER)"

_FILES_A = f"""brands AS (SELECT DISTINCT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn FROM part),
chosen AS (SELECT ingredient_id, bn, CASE WHEN bn % 3 = 0 THEN 1 ELSE 3 END AS copy FROM brands WHERE bn % 13 <> 12),
accepted AS (SELECT * FROM chosen WHERE bn % 11 <> 5 AND bn % 7 <> 6)"""

_PANEL_RAW = f"""{S.SALES_A}, {_FILES_A},
cal AS (SELECT ingredient_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end
  FROM sales_a JOIN accepted USING (ingredient_id) WHERE week_end < {CUT} GROUP BY 1),
trend_a AS (SELECT ingredient_id, week_end,
  CAST(100 AS DOUBLE) * n_lines / max(n_lines) OVER (PARTITION BY ingredient_id ORDER BY week_end) AS value FROM sales_a),
panel_raw AS (SELECT c.ingredient_id, c.week_end, s.searches + a.copy AS searches, s.rank,
    CASE WHEN a.bn % 5 <> 4 THEN t.value END AS google_trend
  FROM cal c JOIN accepted a USING (ingredient_id)
  LEFT JOIN sales_a s ON s.ingredient_id = c.ingredient_id AND s.week_end = c.week_end
  LEFT JOIN trend_a t ON t.ingredient_id = c.ingredient_id AND t.week_end + 7 = c.week_end AND t.week_end < {CUT})"""


def _files(spark, folder):
    return R.vendor_a_files(spark, folder).unionByName(R.trend_files(spark, folder))


def dataset(spark, folder):
    return assemble_panel(_files(spark, folder), R.catalog(spark, folder), R.RAW_AS_OF, VENDOR_A)


@query(
    "envelope_verdicts",
    plain(f"""WITH {_FILES_A}, copies(copy, place, stem, priority, snapshot) AS (VALUES
        (1, 'data/raw/sellersprite/US/', '2001-07-30-a', 0, DATE '2001-07-30'), (2, 'data/raw/US/', '2001-07-30-b', 2, DATE '2001-07-30'),
        (3, 'data/raw/sellersprite/US/', '2001-08-03', 0, DATE '2001-08-03'), (4, 'data/raw/sellersprite/US/', '2001-08-20', 0, DATE '2001-08-20'),
        (6, 'data/raw/sellersprite/US/', '2001-08-04-c', 0, DATE '2001-08-04'))
      SELECT place || ingredient_id || '/amazon/' || stem || '.json' AS path, ingredient_id, CAST(priority AS BIGINT) AS priority, snapshot,
        CASE WHEN copy = 3 AND bn % 3 = 0 THEN 'identity_mismatch' WHEN copy = 6 THEN 'provider_failure' END AS error
      FROM brands CROSS JOIN copies WHERE bn % 13 <> 12""", ("snapshot",)),
)
def envelope_verdicts(spark, folder):
    """Place, snapshot date and identity of every readable envelope."""
    found = candidates(R.vendor_a_files(spark, folder), R.catalog(spark, folder), "amazon", VENDOR_A)
    return found.select("path", "ingredient_id", "priority", "snapshot", "error")


@query(
    "latest_valid",
    plain(f"""WITH {_FILES_A} SELECT ingredient_id, 'data/raw/sellersprite/US/' || ingredient_id || '/amazon/' ||
      CASE copy WHEN 1 THEN '2001-07-30-a' ELSE '2001-08-03' END || '.json' AS path,
      CASE copy WHEN 1 THEN '2001-07-30' ELSE '2001-08-03' END AS snapshot FROM chosen"""),
)
def latest_valid_query(spark, folder):
    """Newest valid envelope per ingredient on the as-of date."""
    found = candidates(R.vendor_a_files(spark, folder), R.catalog(spark, folder), "amazon", VENDOR_A)
    return latest_valid(found.select("ingredient_id", "path", "snapshot", "priority", "error", "history"), F.lit(R.RAW_AS_OF)).select("ingredient_id", "path", "snapshot")


@query("envelope_panel", plain(f"WITH {_PANEL_RAW} SELECT ingredient_id, week_end, searches, rank, google_trend FROM panel_raw", ("week_end",), ("searches", "rank", "google_trend")))
def envelope_panel(spark, folder):
    """Raw files to the weekly panel."""
    return dataset(spark, folder).panel.select("ingredient_id", "week_end", "searches", "rank", "google_trend")


@query(
    "dataset_manifest",
    plain(f"""WITH {_PANEL_RAW} SELECT count(*) AS rows, count(DISTINCT ingredient_id) AS ingredients, min(week_end) AS first_week, max(week_end) AS last_week,
      CAST(sum(CAST(concat('0x', substr(sha256(concat_ws('|', ingredient_id, CAST(week_end AS VARCHAR),
        coalesce(CAST(CAST(searches AS DECIMAL(38,6)) AS VARCHAR), '-'), coalesce(CAST(CAST(rank AS DECIMAL(38,6)) AS VARCHAR), '-'),
        coalesce(CAST(CAST(google_trend AS DECIMAL(38,6)) AS VARCHAR), '-'))), 1, 12)) AS BIGINT)) AS VARCHAR) AS panel_fingerprint,
      '2.0' AS schema_version, {CUT} AS as_of, 'US' AS marketplace, 'sellersprite' AS amazon_provider, 'sellersprite' AS google_provider,
      'single_amazon_provider' AS provider_policy, CAST(1 AS BIGINT) AS google_lag_weeks FROM panel_raw""", ("first_week", "last_week", "as_of")),
)
def dataset_manifest(spark, folder):
    """K2, V7: counts, bounds, policy and content fingerprint of a dataset."""
    return dataset(spark, folder).manifest


@query(
    "dataset_warnings",
    f"""WITH {_FILES_A} SELECT ingredient_id, code FROM (
      SELECT ingredient_id, CASE WHEN bn % 11 = 5 THEN 'non_saturday' ELSE 'duplicate_weeks' END AS code FROM chosen WHERE bn % 11 = 5 OR bn % 7 = 6
      UNION ALL SELECT ingredient_id, 'trend_not_sunday' FROM accepted WHERE bn % 5 = 4
      UNION ALL SELECT ingredient_id, unnest(['trend_week_unconfirmed', 'revised_history', 'estimated_searches']) FROM accepted)""",
)
def dataset_warnings(spark, folder):
    """V9, K4: warning codes; a bad Amazon history drops the ingredient, a bad trend only itself."""
    return dataset(spark, folder).warnings


@query(
    "dataset_quality",
    plain(f"""WITH {_PANEL_RAW} SELECT ch.ingredient_id, count(p.week_end) FILTER (WHERE p.searches IS NULL) AS missing_amazon,
      count(p.week_end) AS weeks, count(p.week_end) FILTER (WHERE p.google_trend IS NULL) AS missing_google,
      min(p.week_end) AS first_week, max(p.week_end) AS last_week, any_value(CASE WHEN bn % 11 = 5 OR bn % 7 = 6 THEN 1 WHEN bn % 5 = 4 THEN 4 ELSE 3 END)::BIGINT AS warnings
      FROM chosen ch LEFT JOIN panel_raw p USING (ingredient_id) GROUP BY 1""", ("first_week", "last_week")),
)
def dataset_quality(spark, folder):
    """Per-ingredient quality rows, rejected ingredients included."""
    rows = dataset(spark, folder).quality
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("missing_amazon", "weeks", "missing_google")}
    return rows.withColumns(zero).select(
        "ingredient_id", "missing_amazon", "weeks", "missing_google", "first_week", "last_week", "warnings"
    )


@query(
    "input_lineage",
    f"""WITH {_FILES_A} SELECT ingredient_id, 'amazon' AS dataset, 'sellersprite' AS provider, 'sellersprite' AS source, 'aba_research_trend' AS tool,
      'data/raw/sellersprite/US/' || ingredient_id || '/amazon/' || CASE copy WHEN 1 THEN '2001-07-30-a' ELSE '2001-08-03' END || '.json' AS source_path FROM accepted
      UNION ALL SELECT ingredient_id, 'google', 'sellersprite', 'sellersprite', 'google_trend', 'data/raw/sellersprite/US/' || ingredient_id || '/google/2001-08-01.json'
      FROM accepted WHERE bn % 5 <> 4""",
)
def input_lineage(spark, folder):
    """K3: files behind the panel; the batch path and hash when there is one, else the file's own."""
    return dataset(spark, folder).inputs.filter("source_sha256 = sha256").select(
        "ingredient_id", "dataset", "provider", "source", "tool", "source_path"
    )


# --- vendor B histories --------------------------------------------------------------------------
_B_ROWS = f"""{S.SALES_B},
base AS (SELECT ingredient_id, {BN} AS bn, row_number() OVER (PARTITION BY ingredient_id ORDER BY week_end) * 10 AS pos,
  week_end - 6 AS day, CAST(searches AS BIGINT) AS volume, CAST(rank AS BIGINT) AS rank FROM sales_b WHERE week_end < {CUT}),
delivered AS (
  SELECT * FROM base
  UNION ALL SELECT ingredient_id, bn, pos + 1, day, volume, rank FROM base WHERE bn % 6 = 1 AND pos = 10
  UNION ALL SELECT ingredient_id, bn, pos - 1, day - 1, volume, rank FROM base WHERE bn % 6 = 2 AND pos = 30
  UNION ALL SELECT ingredient_id, bn, pos + 1, day, volume + 1, rank FROM base WHERE bn <= 10 AND bn % 6 = 3 AND pos = 20
  UNION ALL SELECT ingredient_id, bn, pos + 1, day + 3, volume, rank FROM base WHERE bn <= 10 AND bn % 6 = 4 AND pos = 20
  UNION ALL SELECT ingredient_id, bn, pos + 1000000, day, volume, rank FROM base WHERE bn <= 10 AND bn % 9 = 4 AND pos = 10),
near AS (SELECT *, lag(day) OVER w AS prev_day, lag(volume) OVER w AS prev_volume, lag(rank) OVER w AS prev_rank,
  lead(day) OVER w AS next_day, lead(volume) OVER w AS next_volume, lead(rank) OVER w AS next_rank
  FROM delivered WINDOW w AS (PARTITION BY ingredient_id ORDER BY pos)),
marked AS (SELECT *, prev_day > day AS backwards, dayofweek(day) = 0 AS sunday,
  coalesce(dayofweek(day) = 6 AND next_day = day + 1 AND next_volume = volume AND next_rank = rank, false) AS copy,
  coalesce(prev_day = day, false) AS repeated,
  coalesce(prev_day = day, false) AND (prev_volume <> volume OR prev_rank <> rank) AS conflict FROM near),
verdict AS (SELECT ingredient_id, bn,
  CASE WHEN bool_or(coalesce(backwards, false)) THEN 'not_ascending'
       WHEN bool_or((NOT sunday AND NOT copy) OR (sunday AND conflict)) THEN
         arg_min(CASE WHEN NOT sunday AND NOT copy THEN 'non_sunday' ELSE 'conflicting_repeat' END, pos)
           FILTER (WHERE (NOT sunday AND NOT copy) OR (sunday AND conflict))
       WHEN bn <= 10 AND bn % 6 = 5 THEN 'latest_mismatch' END AS entry_error,
  count(*) FILTER (WHERE sunday AND repeated) AS same_date_duplicates,
  count(*) FILTER (WHERE NOT sunday AND copy) AS misaligned_duplicates FROM marked GROUP BY ingredient_id, bn)"""


@query(
    "dedupe_history",
    f"""WITH {_B_ROWS} SELECT v.ingredient_id, entry_error, same_date_duplicates, misaligned_duplicates,
      CASE WHEN entry_error IS NULL THEN count(*) FILTER (WHERE sunday AND NOT repeated) ELSE 0 END AS weeks,
      CAST(CASE WHEN entry_error IS NULL THEN sum(volume) FILTER (WHERE sunday AND NOT repeated) ELSE 0 END AS BIGINT) AS total_volume
      FROM verdict v JOIN marked m USING (ingredient_id) GROUP BY v.ingredient_id, entry_error, same_date_duplicates, misaligned_duplicates""",
)
def dedupe_history(spark, folder):
    """Landing check of vendor B histories with proven duplicates removed."""
    entries = normalize_entries(R.vendor_b_entries(spark, folder))
    total = F.aggregate("history", F.lit(0).cast("bigint"), lambda acc, x: acc + x["volume"].cast("bigint"))
    return entries.select(
        "ingredient_id", "entry_error", "same_date_duplicates", "misaligned_duplicates",
        F.when(F.col("entry_error").isNull(), F.size("history")).otherwise(0).alias("weeks"),
        F.coalesce(total, F.lit(0)).alias("total_volume"),
    )


_STRICT = """firsts AS (SELECT *, row_number() OVER (PARTITION BY ingredient_id, day ORDER BY pos) AS nth,
    first_value(volume) OVER (PARTITION BY ingredient_id, day ORDER BY pos) AS first_volume FROM delivered),
unique_days AS (SELECT *, lag(day) OVER (PARTITION BY ingredient_id ORDER BY pos) AS before FROM firsts WHERE nth = 1),
strict AS (SELECT ingredient_id, CASE WHEN bool_or(dayofweek(day) <> 0) THEN 'non_sunday' WHEN bool_or(volume <> first_volume) THEN 'conflicting_repeat'
    WHEN ingredient_id IN (SELECT ingredient_id FROM unique_days WHERE before >= day) THEN 'not_ascending' END AS entry_error
  FROM firsts GROUP BY ingredient_id)"""


@query(
    "array_history",
    plain(f"WITH {_B_ROWS}, {_STRICT} SELECT u.ingredient_id, u.day + 6 AS week_end, CAST(volume AS DOUBLE) AS searches, CAST(rank AS DOUBLE) AS rank FROM unique_days u JOIN strict s USING (ingredient_id) WHERE entry_error IS NULL", ("week_end",), ("searches", "rank")),
)
def array_history(spark, folder):
    """Parallel arrays to Saturday weeks, stricter panel-time check."""
    checked = panel_entries(R.vendor_b_entries(spark, folder))  # history is NULL for rejected entries
    return P.clean_measures(checked.select("ingredient_id", F.inline("history")))


@query(
    "vendor_b_panel",
    plain(f"""WITH {_B_ROWS}, {_STRICT},
      ok AS (SELECT u.ingredient_id, u.day + 6 AS week_end, volume, rank FROM unique_days u JOIN strict s USING (ingredient_id)
        WHERE entry_error IS NULL AND u.bn % 13 <> 12),
      cal AS (SELECT ingredient_id, CAST(unnest(generate_series(min(week_end), max(week_end), INTERVAL 7 DAY)) AS DATE) AS week_end FROM ok GROUP BY 1)
      SELECT c.ingredient_id, c.week_end, CAST(volume AS DOUBLE) AS searches, CAST(rank AS DOUBLE) AS rank, CAST(NULL AS DOUBLE) AS google_trend,
        'sif' AS amazon_provider FROM cal c LEFT JOIN ok USING (ingredient_id, week_end)""", ("week_end",), ("searches", "rank", "google_trend")),
)
def vendor_b_panel(spark, folder):
    """R1-R4, R6 for vendor B files, the migration place included."""
    made = assemble_panel(R.vendor_b_files(spark, folder), R.catalog(spark, folder), R.RAW_AS_OF, VENDOR_B)
    return made.panel.select("ingredient_id", "week_end", "searches", "rank", "google_trend", "amazon_provider")


# --- landing -------------------------------------------------------------------------------------
_LANDED = """landed AS (SELECT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn,
  count(DISTINCT date_trunc('week', l_shipdate + INTERVAL 1 DAY)) AS weeks FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
judged AS (SELECT ingredient_id, bn, weeks, CASE bn % 5 WHEN 0 THEN 'provider_failure' WHEN 1 THEN 'empty_history' WHEN 2 THEN 'invalid_label'
  WHEN 3 THEN 'missing_measure' ELSE CASE WHEN bn % 7 = 6 THEN 'duplicate_label' END END AS validation_error FROM landed)"""


@query(
    "quarantine_split",
    f"""WITH {_LANDED} SELECT ingredient_id, CASE WHEN validation_error IS NULL THEN 'accepted' ELSE 'quarantined' END AS route, validation_error,
      CAST(CASE WHEN bn % 5 = 1 THEN 0 WHEN bn % 7 = 6 THEN weeks + 1 ELSE weeks END AS BIGINT) AS n_rows FROM judged""",
)
def quarantine_split(spark, folder):
    """Accepted responses apart from rejected ones, which stay whole."""
    accepted, rejected = L.split_quarantine(L.validate_vendor_a(R.landed_vendor_a(spark, folder)))
    both = accepted.withColumns({"validation_error": F.lit(None).cast("string"), "route": F.lit("accepted")}).unionByName(
        rejected.withColumn("route", F.lit("quarantined"))
    )
    return both.select("ingredient_id", "route", "validation_error", "n_rows")


@query(
    "quarantine_recovery",
    f"""WITH {_LANDED} SELECT ingredient_id AS job_id, CASE WHEN bn % 4 = 3 THEN 'not_quarantined' WHEN bn % 8 = 1 THEN 'evidence_mismatch'
      WHEN bn % 8 = 2 THEN 'hash_mismatch' WHEN validation_error IS NOT NULL THEN 'still_invalid' ELSE 'saved' END AS verdict,
      CAST(bn % 3 + 1 AS BIGINT) AS units FROM judged""",
)
def quarantine_recovery(spark, folder):
    """Quarantined responses re-validated against their job, units unchanged."""
    number = R.brand_number()
    landed = R.landed_vendor_a(spark, folder)
    request = F.to_json(F.struct(F.col("ingredient_id").alias("keyword")))
    evidence = landed.select(
        F.col("ingredient_id").alias("job_id"),
        F.lit(VENDOR_A).alias("source"),
        F.lit("aba_research_trend").alias("tool"),
        request.alias("request"),
        F.to_json(F.struct("ingredient_id", "result")).alias("envelope"),
        "result",
    )
    jobs = landed.select(
        F.col("ingredient_id").alias("id"),
        F.lit(VENDOR_A).alias("provider"),
        F.when(number % 8 == 1, "other_tool").otherwise("aba_research_trend").alias("tool"),
        request.alias("request"),
        F.when(number % 8 == 2, "0").otherwise(F.sha2(F.to_json(F.struct("ingredient_id", "result")), 256)).alias("response_sha256"),
        F.when(number % 4 == 3, "saved").otherwise("failed_invalid_response").alias("status"),
        (number % 3 + 1).alias("units"),
    )
    return L.recover_quarantined(evidence, jobs).select("job_id", "verdict", "units")


@query(
    "batch_materialize",
    f"""WITH {_B_ROWS}, batches AS (SELECT (bn - 1) // 5 AS batch_id, CASE WHEN (bn - 1) // 5 = 3 THEN 'keyword_set_mismatch' ELSE min(entry_error) END AS batch_error FROM verdict GROUP BY 1)
      SELECT v.ingredient_id, CAST(b.batch_id AS BIGINT) AS batch_id, same_date_duplicates, misaligned_duplicates, same_date_duplicates + misaligned_duplicates AS deduplicated,
        count(*) FILTER (WHERE sunday AND NOT repeated) AS weeks,
        CASE v.bn % 3 WHEN 0 THEN 'written' WHEN 1 THEN 'reused' ELSE 'conflict' END AS action
      FROM verdict v JOIN batches b ON b.batch_id = (v.bn - 1) // 5 JOIN marked m USING (ingredient_id) WHERE b.batch_error IS NULL GROUP BY v.ingredient_id, v.bn, b.batch_id, same_date_duplicates, misaligned_duplicates""",
)
def batch_materialize(spark, folder):
    """Batch answers split per keyword; equal records reused, differing ones reported."""
    batches, items = R.vendor_b_batches(spark, folder)
    records = L.keyword_records(L.batch_entries(batches), items)
    number = R.brand_number()
    stored = records.filter(number % 3 != 0).select(
        "ingredient_id", F.when(number % 3 == 1, F.col("content_sha256")).otherwise("other").alias("content_sha256")
    )
    return L.publication(records, stored).drop("content", "content_sha256", "keyword")


@query(
    "batch_verdicts",
    f"""WITH {_B_ROWS} SELECT CAST((bn - 1) // 5 AS BIGINT) AS batch_id,
      CASE WHEN (bn - 1) // 5 = 3 THEN 'keyword_set_mismatch' ELSE min(entry_error) END AS batch_error FROM verdict GROUP BY 1, (bn - 1) // 5""",
)
def batch_verdicts(spark, folder):
    """One verdict per batch answer."""
    return L.batch_entries(R.vendor_b_batches(spark, folder)[0]).groupBy("batch_id").agg(F.max("batch_error").alias("batch_error"))


# --- legacy compact entries ------------------------------------------------------------------------
_LEGACY = f"""{S.SALES_A}, {S.SALES_B},
brands AS (SELECT DISTINCT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn FROM part),
ours AS (SELECT b.ingredient_id, b.week_end, b.searches, b.rank, bn FROM sales_b b JOIN brands USING (ingredient_id) WHERE week_end <= {S.AS_OF}),
entry AS (SELECT ingredient_id, bn, CASE WHEN bn % 9 = 2 THEN 'tail_mismatch' END AS entry_error FROM brands WHERE bn % 10 <> 7),
theirs AS (SELECT ingredient_id, week_end FROM sales_a JOIN brands USING (ingredient_id) WHERE bn % 10 <> 3 AND (bn % 10 <> 4 OR week_end < DATE '1996-06-01')),
shared AS (SELECT o.* FROM ours o JOIN theirs t USING (ingredient_id, week_end) JOIN entry e USING (ingredient_id) WHERE e.entry_error IS NULL),
outcome AS (SELECT b.ingredient_id, count(s.week_end) AS overlap_weeks,
  CASE WHEN b.bn % 10 = 7 THEN 'no_entry' WHEN b.bn % 10 = 3 THEN 'no_partner_history' WHEN b.bn % 9 = 2 THEN 'tail_mismatch'
       WHEN count(s.week_end) < 104 THEN 'too_few_weeks' ELSE 'built' END AS outcome
  FROM brands b LEFT JOIN shared s USING (ingredient_id) WHERE b.bn % 13 <> 12 GROUP BY b.ingredient_id, b.bn)"""


def _legacy(spark, folder):
    """Legacy entries: one in ten without an entry, some with a wrong tail, dense ones without own dates."""
    from pyspark.sql import Window

    number = R.brand_number()
    sales = T.sales_b(spark, folder)
    weeks = sales.select("week_end").distinct()
    grid = weeks.agg(F.array_sort(F.collect_set(F.date_sub("week_end", 6).cast("string"))).alias("dates"))
    size = F.size("dates")
    row = F.struct("week_end", F.col("searches").cast("bigint").alias("v"), F.col("rank").cast("bigint").alias("r"))
    packed = sales.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).filter(number % 10 != 7)
    own = F.transform("rows", lambda x: F.date_sub(x["week_end"], 6).cast("string"))
    full = F.size("rows") == grid.select(size).scalar()
    tail = F.element_at("rows", -1)
    entries = packed.select(
        "ingredient_id",
        F.lower("ingredient_id").alias("keyword"),
        F.when(full, F.array().cast("array<string>")).otherwise(own).alias("dates"),
        F.transform("rows", lambda x: x["v"].cast("string")).alias("volumes"),
        F.transform("rows", lambda x: x["r"].cast("string")).alias("ranks"),
        F.struct(
            F.date_sub(tail["week_end"], 6).cast("string").alias("date"),
            (tail["v"] + F.when(number % 9 == 2, 1).otherwise(0)).cast("string").alias("volume"),
            tail["r"].cast("string").alias("rank"),
        ).alias("latest"),
    )
    theirs = T.sales_a(spark, folder).filter(
        (number % 10 != 3) & ((number % 10 != 4) | (F.col("week_end") < F.lit("1996-06-01").cast("date")))
    )
    return G.pair_weeks(G.checked(G.with_grid(entries, grid)), theirs, R.catalog(spark, folder), T.AS_OF)


@query(
    "week_intersection",
    plain(f"WITH {_LEGACY} SELECT s.ingredient_id, s.week_end, s.searches, s.rank FROM shared s JOIN outcome o USING (ingredient_id) WHERE o.outcome = 'built'", ("week_end",), ("searches", "rank")),
)
def week_intersection(spark, folder):
    """Exact common weeks of two vendors per ingredient."""
    return P.clean_measures(_legacy(spark, folder)[0])


@query("legacy_outcomes", f"WITH {_LEGACY} SELECT ingredient_id, overlap_weeks, outcome FROM outcome")
def legacy_outcomes(spark, folder):
    """Built or why not, per catalog entry."""
    return _legacy(spark, folder)[1]

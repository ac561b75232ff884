"""Catalog, planning, ledger, validation, publishing and streaming queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weekcast.constants import VENDOR_A, VENDOR_B
from weekcast.functions.hashing import dedupe_key
from weekcast.operators import catalog as C, ledger as G, planning as N, validate as V
from weekcast.operators.forecast import missing_ingredients
from weekcast.plans import raw_testbed as R, sql as S, testbed as T
from weekcast.plans.dataset import manifest
from weekcast.plans.registry import plain, query
from weekcast.session import work_path
from weekcast.sources import sinks
from weekcast.sources.panel_files import read_panel
from weekcast.streaming import landing as L


# --- catalog -------------------------------------------------------------------------------------
def library(spark, folder):
    """Parts as library records: decorated names, two special categories."""
    size = F.col("p_size")
    name = (
        F.when(size % 4 == 0, F.concat(F.upper("p_name"), F.lit(" (Grade "), size.cast("string"), F.lit(")")))
        .when(size % 4 == 1, F.upper("p_name"))
        .when((size % 4 == 3) & (size % 3 == 0), F.concat("p_name", F.lit(" + zinc")))
        .otherwise(F.col("p_name"))
    )
    category = F.when(F.col("p_type") == "STANDARD", "pet_health").when(F.col("p_type") == "PROMO", "delivery_innovation").otherwise(F.lower("p_type"))
    return T.table(spark, folder, "part").select(
        category.alias("category"),
        F.col("p_partkey").alias("position"),
        name.alias("name"),
        F.concat(F.lit("cn "), F.col("p_partkey").cast("string")).alias("name_cn"),
        F.array("p_brand").alias("brands"),
    )


def mappings(spark, folder):
    """Reviewed terms for names of even length, and for brands no library record answers to."""
    part = T.table(spark, folder, "part")
    names = part.select(F.col("p_name").alias("canonical")).filter(F.length("canonical") % 2 == 0)
    both = names.unionByName(part.select(F.lower("p_brand").alias("canonical"))).distinct()
    return both.select(
        "canonical",
        F.concat(F.lit("fam "), F.element_at(F.split("canonical", " "), -1)).alias("family_id"),
        F.create_map(
            F.lit(VENDOR_A), F.concat(F.lit("q "), "canonical"), F.lit(VENDOR_B), F.concat(F.lit("s "), "canonical")
        ).alias("queries"),
        F.when(F.length("canonical") % 3 == 0, "batch2").alias("review_status"),
    )


_LIBRARY_SQL = """library AS (SELECT p_partkey AS position, p_brand AS brand, 'cn ' || p_partkey AS name_cn,
    CASE p_type WHEN 'STANDARD' THEN 'pet_health' WHEN 'PROMO' THEN 'delivery_innovation' ELSE lower(p_type) END AS category,
    CASE WHEN p_size % 4 = 0 THEN upper(p_name) || ' (Grade ' || p_size || ')' WHEN p_size % 4 = 1 THEN upper(p_name)
         WHEN p_size % 4 = 3 AND p_size % 3 = 0 THEN p_name || ' + zinc' ELSE p_name END AS name FROM part),
mapping AS (SELECT canonical, 'fam ' || split_part(canonical, ' ', -1) AS family_id, 'q ' || canonical AS keyword,
    CASE WHEN length(canonical) % 3 = 0 THEN 'batch2' END AS review_status
  FROM (SELECT DISTINCT p_name AS canonical FROM part WHERE length(p_name) % 2 = 0 UNION SELECT DISTINCT lower(p_brand) FROM part)),
keyed AS (SELECT *, lower(trim(regexp_replace(name, '\\s*\\([^)]*\\)', '', 'g'))) || CASE WHEN category = 'pet_health' THEN ' (pet)' ELSE '' END AS canonical FROM library),
rolled AS (SELECT canonical, arg_min(name, position) AS name, arg_min(name_cn, position) AS name_cn,
    array_to_string(list_sort(list(DISTINCT category)), '|') AS categories, array_to_string(list_sort(list(DISTINCT brand)), '|') AS brands,
    array_to_string(list_sort(list(DISTINCT name)), '|') AS aliases,
    bool_and(category IN ('pet_health', 'delivery_innovation')) AS excluded,
    contains(canonical, '+') OR contains(canonical, '/') OR contains(canonical, 'complex') AS mixture FROM keyed GROUP BY canonical),
catalog AS (SELECT trim(regexp_replace(lower(r.canonical), '[^a-z0-9]+', '-', 'g'), '-') AS id, r.canonical,
    coalesce(m.family_id, trim(regexp_replace(lower(r.canonical), '[^a-z0-9]+', '-', 'g'), '-')) AS family_id, name, name_cn, keyword,
    categories, brands, aliases, NOT excluded AND NOT mixture AS eligible,
    CASE WHEN excluded THEN 'excluded_category' WHEN mixture THEN 'mixture' END AS exclusion_reason,
    NOT excluded AND NOT mixture AND m.canonical IS NOT NULL AS selected,
    CASE WHEN NOT excluded AND NOT mixture AND m.canonical IS NOT NULL THEN coalesce(review_status, 'reviewed_mapping') ELSE 'requires_review' END AS query_status
  FROM rolled r LEFT JOIN mapping m USING (canonical))"""


@query("catalog_rollup", f"WITH {_LIBRARY_SQL} SELECT * FROM catalog")
def catalog_rollup(spark, folder):
    """Library records rolled up by canonical name with reviewed terms."""
    built = C.build_catalog(library(spark, folder), mappings(spark, folder))
    joined = {name: F.array_join(name, "|") for name in ("categories", "brands", "aliases")}
    return built.drop("queries", "claims_verified").withColumns(joined)


@query(
    "catalog_audit",
    f"""WITH {_LIBRARY_SQL} SELECT (SELECT count(*) FROM library) AS records, (SELECT count(DISTINCT category) FROM library) AS categories,
      (SELECT count(DISTINCT lower(name)) FROM library) AS unique_names,
      (SELECT count(*) FROM (SELECT lower(name) FROM library GROUP BY 1 HAVING count(*) > 1)) AS duplicate_names,
      count(*) AS canonical_count, count(*) FILTER (WHERE selected) AS selected_count, count(*) FILTER (WHERE NOT eligible) AS excluded_count FROM catalog""",
)
def catalog_audit(spark, folder):
    """A2: counts of a catalog build."""
    rows = library(spark, folder)
    return C.library_audit(rows, C.build_catalog(rows, mappings(spark, folder)))


@query("duplicate_names", f"WITH {_LIBRARY_SQL} SELECT lower(name) AS name, count(*) AS n FROM library GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, folder):
    """A2: names given more than once."""
    return C.duplicate_names(library(spark, folder))


@query("unresolved_mappings", f"WITH {_LIBRARY_SQL} SELECT canonical FROM mapping WHERE canonical NOT IN (SELECT canonical FROM catalog)")
def unresolved_mappings(spark, folder):
    """Reviewed terms without a library entry."""
    return C.unresolved_mappings(mappings(spark, folder), C.build_catalog(library(spark, folder), mappings(spark, folder)))


@query(
    "requested_ids",
    f"""WITH {_LIBRARY_SQL}, asked AS (SELECT DISTINCT replace(p_name, ' ', '-') AS id FROM part UNION SELECT DISTINCT lower(p_brand) FROM part)
      SELECT a.id, CASE WHEN c.id IS NULL THEN 'unknown' ELSE 'unselected' END AS problem FROM asked a LEFT JOIN catalog c USING (id) WHERE c.id IS NULL OR NOT c.selected""",
)
def requested_ids(spark, folder):
    """requested ids that must stop a run."""
    part = T.table(spark, folder, "part")
    ids = part.select(F.translate("p_name", " ", "-").alias("id")).unionByName(part.select(F.lower("p_brand").alias("id")))
    return C.requested_id_problems(C.build_catalog(library(spark, folder), mappings(spark, folder)), ids)


@query(
    "catalog_top",
    f"WITH {_LIBRARY_SQL} SELECT id, name, query_status FROM catalog WHERE selected ORDER BY id <> 'urolithin-a', id LIMIT 12",
)
def catalog_top(spark, folder):
    """The first selected entries in catalog order."""
    return C.selected_items(C.build_catalog(library(spark, folder), mappings(spark, folder)), limit=12).select("id", "name", "query_status")


# --- planning ------------------------------------------------------------------------------------
def plan_items(spark, folder):
    customer = T.table(spark, folder, "customer")
    return customer.select(
        F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"),
        F.lower("c_name").alias("keyword"),
        F.create_map().cast("map<string,string>").alias("queries"),
        (F.col("c_acctbal") > 0).alias("selected"),
        "c_custkey",
    )


def plan_snapshots(spark, folder):
    key = F.col("c_custkey")
    rows = plan_items(spark, folder).select(F.col("id").alias("ingredient_id"), key)
    amazon = rows.filter(key % 4 != 0).select(
        "ingredient_id", F.lit("amazon").alias("kind"), F.lit(VENDOR_B).alias("provider"),
        F.date_sub(F.lit(T.AS_OF), (key % 15).cast("int")).alias("snapshot"),
    )
    google = rows.filter(key % 5 != 0).select(
        "ingredient_id", F.lit("google").alias("kind"), F.lit(VENDOR_A).alias("provider"),
        F.date_sub(F.lit(T.AS_OF), (key % 9).cast("int")).alias("snapshot"),
    )
    return amazon.unionByName(google).withColumn("path", F.concat_ws("/", "provider", "kind", "ingredient_id"))


def _plan(spark, folder):
    items = plan_items(spark, folder).filter("selected").drop("c_custkey")
    return N.collection_plan(items, plan_snapshots(spark, folder), F.lit(T.AS_OF), VENDOR_B)


_PLAN_SQL = f"""items AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, lower(c_name) AS keyword, c_custkey FROM customer WHERE c_acctbal > 0),
state AS (SELECT id, keyword, c_custkey, 'amazon' AS kind, 'sif' AS provider, coalesce(c_custkey % 4 <> 0 AND c_custkey % 15 < 7, false) AS hit FROM items
  UNION ALL SELECT id, keyword, c_custkey, 'google', 'sellersprite', c_custkey % 5 <> 0 AND c_custkey % 9 < 7 FROM items),
placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS position FROM state WHERE NOT hit AND kind = 'amazon'),
batches AS (SELECT position // 5 AS batch_index, count(*) AS n_items,
  '{{"country":"US","granularity":"week","keywords":[' || string_agg('"' || keyword || '"', ',' ORDER BY position) || ']}}' AS request FROM placed GROUP BY 1)"""


@query(
    "refresh_plan",
    f"""WITH {_PLAN_SQL}, jobs AS (SELECT id, kind, provider, '{{"request":{{"googleProp":"web","keyword":"' || keyword || '","marketplace":"US","monthly":false}}}}' AS request FROM state WHERE NOT hit AND kind = 'google')
      SELECT id AS ingredient_id, kind, provider, 'hit' AS action, provider || '/' || kind || '/' || id AS path, NULL AS request FROM state WHERE hit
      UNION ALL SELECT id, kind, provider, 'job', 'data/raw/sellersprite/US/' || id || '/google/2001-07-28-' || substr(sha256(request), 1, 12) || '.json', request FROM jobs""",
)
def refresh_plan(spark, folder):
    """Cache hits and per-item jobs of a refresh."""
    hits, single, _ = _plan(spark, folder)
    return hits.select("ingredient_id", "kind", "provider", F.lit("hit").alias("action"), "path", F.lit(None).cast("string").alias("request")).unionByName(
        single.select("ingredient_id", "kind", "provider", F.lit("job").alias("action"), F.col("cache_path").alias("path"), "request")
    )


@query(
    "batch_of_five",
    f"""WITH {_PLAN_SQL} SELECT CAST(batch_index AS BIGINT) AS batch_index, n_items, request, 1::BIGINT AS cost_units,
      'data/raw/sif/US/_batches/history/2001-07-28-' || substr(sha256(request), 1, 12) || '.json' AS cache_path FROM batches""",
)
def batch_of_five(spark, folder):
    """Batches of five in catalog order, by a distributed global index."""
    return _plan(spark, folder)[2].select("batch_index", "n_items", "request", "cost_units", "cache_path")


@query(
    "batch_targets",
    f"""WITH {_PLAN_SQL} SELECT CAST(position // 5 AS BIGINT) AS batch_index, id AS ingredient_id, keyword,
      'data/raw/sif/US/' || id || '/amazon/2001-07-28-' || substr(sha256('{{"country":"US","granularity":"week","keywords":["' || keyword || '"]}}'), 1, 12) || '.json' AS cache_path FROM placed""",
)
def batch_targets(spark, folder):
    """L1: where each keyword of a batch will be kept."""
    return _plan(spark, folder)[2].select("batch_index", F.inline("cache_targets"))


@query(
    "job_keys",
    f"""WITH {_PLAN_SQL} SELECT id, sha256('["sellersprite","aba_research_trend",{{"keyword":"' || keyword || '","marketplace":"US","timeGranularity":"W"}},"' || id || '"]') AS dedupe_key,
      sha256('{{"keyword":"' || keyword || '","marketplace":"US","timeGranularity":"W"}}') AS request_hash FROM items""",
)
def job_keys(spark, folder):
    """L3: request hashes and job identities."""
    request = N.amazon_request(F.col("keyword"))
    return plan_items(spark, folder).filter("selected").select(
        "id",
        dedupe_key(F.lit(VENDOR_A), F.lit("aba_research_trend"), request, F.col("id")).alias("dedupe_key"),
        F.sha2(request, 256).alias("request_hash"),
    )


# --- ledger --------------------------------------------------------------------------------------
STATUS_OF = {"signup": "reserved", "view": "saved", "click": "failed_before_send", "purchase": "failed_provider", "error": "calling"}
_STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_OF.items()) + " END"


def jobs(spark, folder):
    """Events as job records."""
    return job_rows(T.table(spark, folder, "events"))


def job_rows(events):
    status = F.lit(None).cast("string")
    for event, state in STATUS_OF.items():
        status = F.when(F.col("event_type") == event, state).otherwise(status)
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(F.col("user_id") % 2 == 0, VENDOR_A).otherwise(VENDOR_B).alias("provider"),
        F.date_format(ts, "yyyy-MM").alias("period"),
        (F.col("event_id") % 3 + 1).alias("units"),
        status.alias("status"),
        ts.alias("ts"),
        "user_id",
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.to_date(ts).cast("string")).alias("dedupe_key"),
        "event_type",
    )


def quotas(spark):
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("provider"), F.lit("2024-01").alias("period"), F.lit(a).alias("available"),
                F.lit(r).alias("reserve"), F.lit(limit).alias("project_limit"), F.lit(rate).alias("per_minute"),
            )
            for p, a, r, limit, rate in ((VENDOR_A, 9000, 500, 7500, 1), (VENDOR_B, 9000, 3000, 8000, 2))
        ]
    )
    return spark.range(1).select(F.inline(rows))


_JOBS_SQL = f"""jobs AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'sellersprite' ELSE 'sif' END AS provider, strftime(ts, '%Y-%m') AS period,
  event_id % 3 + 1 AS units, {_STATUS_SQL} AS status, ts, user_id, event_type, user_id || '|' || event_type || '|' || CAST(ts AS DATE) AS dedupe_key FROM events),
legacy AS (SELECT 'sellersprite' AS provider, period, 1 AS units, ts FROM jobs WHERE status = 'reserved'),
quota(provider, period, hard_limit, available, per_minute) AS (VALUES ('sellersprite', '2024-01', 7500, 9000, 1), ('sif', '2024-01', 6000, 9000, 2))"""


def legacy_rows(spark, folder):
    return jobs(spark, folder).filter("status = 'reserved'").select(F.lit(VENDOR_A).alias("provider"), "period", F.lit(1).alias("units"), "ts")


@query("ledger_states", f"WITH {_JOBS_SQL} SELECT provider, period, status, count(*) AS jobs, CAST(sum(units) AS BIGINT) AS units FROM jobs GROUP BY 1, 2, 3")
def ledger_states(spark, folder):
    """Jobs and units by state."""
    return G.status_rollup(jobs(spark, folder))


@query(
    "ledger_rollup",
    f"""WITH {_JOBS_SQL}, spent AS (SELECT provider, period, sum(units) AS u FROM (SELECT provider, period, units FROM jobs WHERE status <> 'failed_before_send'
        UNION ALL SELECT provider, period, units FROM legacy) GROUP BY 1, 2)
      SELECT provider, period, CAST(hard_limit AS BIGINT) AS hard_limit, CAST(u AS BIGINT) AS counted_units, CAST(greatest(0, hard_limit - u) AS BIGINT) AS remaining,
        CAST(greatest(0, available - u) AS BIGINT) AS estimated_remaining_account FROM quota JOIN spent USING (provider, period)""",
)
def ledger_rollup(spark, folder):
    """Limits, counted and remaining units."""
    return G.budgets(jobs(spark, folder), legacy_rows(spark, folder), quotas(spark))


@query(
    "rate_window",
    f"""WITH {_JOBS_SQL} SELECT id, provider, count(*) FILTER (WHERE status <> 'failed_before_send') OVER
      (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS recent FROM jobs""",
)
def rate_window(spark, folder):
    """P20: counted calls of the last 60 seconds before each call."""
    return G.recent_calls(jobs(spark, folder)).select("id", "provider", "recent")


@query(
    "job_admissibility",
    f"""WITH RECURSIVE {_JOBS_SQL}, known AS (SELECT * FROM jobs WHERE event_type IN ('view', 'click')), asked AS (SELECT * FROM jobs WHERE event_type NOT IN ('view', 'click')),
      old AS (SELECT provider, period, 1 AS units, ts FROM legacy), made AS (SELECT provider, ts FROM known WHERE status = 'saved' UNION ALL SELECT provider, ts FROM old),
      spent AS (SELECT provider, sum(units) AS u FROM (SELECT provider, period, units FROM known WHERE status = 'saved' UNION ALL SELECT provider, period, units FROM old)
        JOIN quota USING (provider, period) GROUP BY 1),
      told AS MATERIALIZED (SELECT a.*, q.hard_limit, q.per_minute, u, CASE WHEN q.period <> a.period THEN 'period_expired'
          WHEN a.dedupe_key IN (SELECT dedupe_key FROM known WHERE status = 'saved') THEN 'existing_job' END AS fixed
        FROM asked a JOIN quota q USING (provider) JOIN spent s USING (provider)),
      open AS MATERIALIZED (SELECT t.*, row_number() OVER (PARTITION BY t.provider ORDER BY ts, id) AS nth, lead(id) OVER (PARTITION BY dedupe_key ORDER BY ts, id) IS NOT NULL AS again,
          (SELECT count(*) FROM made k WHERE k.provider = t.provider AND k.ts < t.ts AND k.ts > t.ts - INTERVAL 60 SECOND) AS others FROM told t WHERE fixed IS NULL),
      walk(provider, nth, taken, near, keys, id, period, units, units_before, recent, verdict) AS (
        SELECT provider, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST([] AS TIMESTAMP[]), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR) FROM spent
        UNION ALL
        SELECT provider, nth, CASE WHEN verdict = 'admissible' THEN taken + units ELSE taken END, CASE WHEN verdict = 'admissible' THEN list_append(near, ts) ELSE near END,
          CASE WHEN verdict = 'admissible' AND again THEN list_append(keys, dedupe_key) ELSE keys END, id, period, units, taken, recent, verdict
        FROM (SELECT *, CASE WHEN list_contains(keys, dedupe_key) THEN 'existing_job' WHEN u + taken + units > hard_limit THEN 'over_limit' WHEN recent >= per_minute THEN 'over_rate' ELSE 'admissible' END AS verdict
          FROM (SELECT *, others + len(list_filter(near, lambda x: x < ts)) AS recent
            FROM (SELECT o.provider, o.nth, o.id, o.period, CAST(o.units AS BIGINT) AS units, CAST(o.ts AS TIMESTAMP) AS ts, o.dedupe_key, o.again, o.others, o.u, o.hard_limit, o.per_minute, w.taken, w.keys,
                list_filter(w.near, lambda x: x > CAST(o.ts AS TIMESTAMP) - INTERVAL 60 SECOND) AS near
              FROM walk w JOIN open o ON o.provider = w.provider AND o.nth = w.nth + 1))))
      SELECT id, provider, period, units, units_before, recent, verdict FROM walk WHERE nth > 0
      UNION ALL SELECT id, provider, period, units, NULL, NULL, fixed FROM told WHERE fixed IS NOT NULL""",
)
def job_admissibility(spark, folder):
    """L4: limit, rate, period and repeat verdict of proposed calls, made one after the other."""
    rows = jobs(spark, folder)
    known = rows.filter(F.col("event_type").isin("view", "click"))
    asked = rows.filter(~F.col("event_type").isin("view", "click")).select("id", "provider", "ts", "units", "dedupe_key")
    return G.admissibility(asked, known, legacy_rows(spark, folder), quotas(spark))




@query(
    "transition_audit",
    f"""WITH {_JOBS_SQL}, edges(source, target) AS (VALUES (NULL, 'reserved'), ('failed_before_send', 'reserved'), ('reserved', 'calling'), ('calling', 'received'), ('received', 'staged'),
        ('failed_invalid_response', 'staged'), ('staged', 'saved'), ('reserved', 'failed_before_send')
        UNION ALL SELECT source, target FROM (VALUES ('calling'), ('received'), ('staged'), ('saved')) s(source),
          (VALUES ('failed_unknown_charge'), ('failed_provider'), ('failed_invalid_response'), ('failed_storage'), ('corrupt_file')) f(target)),
      stepped AS (SELECT user_id AS job_id, id AS event_id, lag(status) OVER (PARTITION BY user_id ORDER BY ts, id) AS previous, status FROM jobs)
      SELECT s.* FROM stepped s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source IS NOT DISTINCT FROM s.previous AND e.target = s.status)""",
)
def transition_audit(spark, folder):
    """State changes a job may not make."""
    history = jobs(spark, folder).select(F.col("user_id").alias("job_id"), F.col("id").alias("event_id"), "ts", "status")
    return G.transition_violations(history).drop("ts")


@query(
    "stored_verification",
    """SELECT doc_id AS id, 'raw/' || doc_id AS destination, CASE WHEN doc_id % 10 IN (3, 7) THEN 'corrupt' ELSE 'verified' END AS outcome FROM documents""",
)
def stored_verification(spark, folder):
    """Hashes of stored content against the ledger; missing or changed files are corrupt."""
    docs = T.table(spark, folder, "documents")
    path = F.concat(F.lit("raw/"), F.col("doc_id").cast("string"))
    saved = docs.select(
        F.col("doc_id").alias("id"), path.alias("destination"), F.lit("saved").alias("status"),
        F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("response_sha256"),
    )
    files = docs.filter(F.col("doc_id") % 10 != 7).select(path.alias("path"), F.col("text").alias("content"))
    return G.verify_stored(saved, files)


# --- expectations and publishing -------------------------------------------------------------------
def faulty_panel(spark, folder):
    """Panel A with repeated weeks, shifted weeks, a foreign market and a second family."""
    panel = T.panel_a(spark, folder).withColumn("amazon_source", F.col("amazon_provider"))
    number, week = R.brand_number(), F.year("week_end")
    last = (F.col("week_end") == F.lit("2001-07-21").cast("date"))
    repeated = panel.filter((number % 5 == 1) & last)
    shifted = panel.filter((number % 5 == 2) & last).withColumn("week_end", F.date_add("week_end", 1))
    foreign = panel.filter((number % 5 == 3) & last).withColumns({"week_end": F.date_add("week_end", 7), "marketplace": F.lit("DE")})
    family = panel.filter((number % 5 == 4) & last).withColumns({"week_end": F.date_add("week_end", 7), "family_id": F.lit("zzz")})
    vendor = panel.filter((number % 5 == 0) & last).withColumns({"week_end": F.date_add("week_end", 7), "amazon_provider": F.lit("SIF")})
    out = panel
    for part in (repeated, shifted, foreign, family, vendor):
        out = out.unionByName(part)
    return out


@query(
    "panel_expectations",
    """WITH b AS (SELECT DISTINCT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS m FROM part)
      SELECT 'duplicate_week' AS rule, ingredient_id, '2001-07-21' AS week_end, '2' AS detail FROM b WHERE m = 1
      UNION ALL SELECT 'week_end_not_saturday', ingredient_id, '2001-07-22', '1' FROM b WHERE m = 2
      UNION ALL SELECT 'several_marketplace', ingredient_id, NULL, 'DE,US' FROM b WHERE m = 3
      UNION ALL SELECT 'foreign_marketplace', ingredient_id, NULL, 'DE' FROM b WHERE m = 3
      UNION ALL SELECT 'several_family_id', ingredient_id, NULL, ingredient_id || ',zzz' FROM b WHERE m = 4
      UNION ALL SELECT 'several_amazon_provider', ingredient_id, NULL, 'sellersprite,sif' FROM b WHERE m = 0
      UNION ALL SELECT 'provider_fields_disagree', ingredient_id, '2001-07-28', 'sif,sellersprite' FROM b WHERE m = 0
      UNION ALL SELECT 'not_one_provider', NULL, NULL, unnest(['sellersprite', 'sif'])""",
)
def panel_expectations(spark, folder):
    """V1-V6: rows that break a panel's contract."""
    return V.panel_violations(faulty_panel(spark, folder))


@query(
    "manifest_check",
    f"""{S.base('a', 'panel')} SELECT 'rows' AS field, CAST(count(*) AS VARCHAR) AS value, CAST(count(*) + 1 AS VARCHAR) AS declared FROM panel_a
      UNION ALL SELECT 'amazon_provider', 'sellersprite', 'sif'""",
)
def manifest_check(spark, folder):
    """V7: a declared manifest against the one computed from the panel."""
    found = manifest(T.panel_a(spark, folder), VENDOR_A, F.lit(T.AS_OF))
    return V.manifest_violations(found, found.withColumns({"rows": F.col("rows") + 1, "amazon_provider": F.lit(VENDOR_B)}))


@query(
    "missing_entities",
    """WITH b AS (SELECT DISTINCT p_brand AS id FROM part)
      SELECT 'new ' || id AS ingredient_id, unnest([13, 26])::BIGINT AS horizon_weeks, 'insufficient_data' AS status, 'no_source_data' AS reason, 0::BIGINT AS history_weeks
      FROM b WHERE CAST(substr(id, 7) AS INTEGER) % 13 <> 12""",
)
def missing_entities(spark, folder):
    """Selected catalog entries without history get placeholder forecasts."""
    known = R.catalog(spark, folder)
    both = known.unionByName(known.withColumn("id", F.concat(F.lit("new "), "id")))
    return missing_ingredients(both, T.panel_a(spark, folder))


@query(
    "panel_publish",
    plain(f"""{S.base('a', 'panel')}, {S.panel('b')} SELECT ingredient_id, week_end, searches, 'sellersprite' AS provider FROM panel_a
      UNION ALL SELECT ingredient_id, week_end, searches, 'sif' FROM panel_b""", ("week_end",), ("searches",)),
)
def panel_publish(spark, folder):
    """Both datasets published, one of them twice, and read back by partition."""
    path = work_path(spark, "panel")
    sinks.publish_panel(T.panel_a(spark, folder), path, VENDOR_A, T.AS_OF)
    sinks.publish_panel(T.panel_b(spark, folder), path, VENDOR_B, T.AS_OF)
    sinks.publish_panel(T.panel_a(spark, folder), path, VENDOR_A, T.AS_OF)
    first = read_panel(spark, path, VENDOR_A, str(T.AS_OF))
    return first.unionByName(read_panel(spark, path, VENDOR_B, str(T.AS_OF))).select("ingredient_id", "week_end", "searches", "provider")


@query(
    "latest_runs",
    """SELECT o_orderpriority AS provider, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS published_at
      FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def latest_runs(spark, folder):
    """K7: newest completed run per provider."""
    runs = T.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("provider"), F.col("o_orderkey").alias("run_id"),
        F.to_date("o_orderdate").alias("published_at"), (F.col("o_orderstatus") == "F").alias("completed"),
    )
    return sinks.latest_runs(runs)


# --- streaming -----------------------------------------------------------------------------------
def event_stream(spark, folder):
    """The events file as a stream, in the shape of ledger calls."""
    schema = T.table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return job_rows(rows).select("provider", "dedupe_key", "ts", "status")


@query("stream_dedupe", f"WITH {_JOBS_SQL} SELECT dedupe_key, provider FROM jobs GROUP BY 1, 2")
def stream_dedupe(spark, folder):
    """Every job key once, from a stream."""
    path = work_path(spark, "dedupe")
    L.run_to_table(L.first_jobs(event_stream(spark, folder)), f"{path}/out", f"{path}/check")
    return spark.read.parquet(f"{path}/out").select("dedupe_key", "provider")


@query(
    "stream_rate",
    f"""WITH {_JOBS_SQL}, spread AS (SELECT provider, ts, unnest(range(6)) AS k FROM jobs WHERE status <> 'failed_before_send'),
      windows AS (SELECT provider, (epoch_us(ts) // 10000000 - k) * 10000000 AS start_us, count(*) AS calls FROM spread GROUP BY 1, 2)
      SELECT provider, strftime(make_timestamp(start_us), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(make_timestamp(start_us + 60000000), '%Y-%m-%d %H:%M:%S') AS window_end, calls
      FROM windows WHERE start_us + 60000000 <= (SELECT max(epoch_us(ts)) - 300000000 FROM jobs)""",
)
def stream_rate(spark, folder):
    """Counted calls per minute and provider, windows closed by the watermark."""
    path = work_path(spark, "rate")
    L.run_to_table(L.call_rate(event_stream(spark, folder)), f"{path}/out", f"{path}/check")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    return spark.read.parquet(f"{path}/out").withColumns(shown)


@query(
    "stream_ingest",
    """WITH landed AS (SELECT DISTINCT p_brand AS ingredient_id, CAST(substr(p_brand, 7) AS INTEGER) AS bn FROM part)
      SELECT ingredient_id, CASE WHEN bn % 5 = 4 AND bn % 7 <> 6 THEN 'accepted' ELSE 'quarantined' END AS route,
        CASE bn % 5 WHEN 0 THEN 'provider_failure' WHEN 1 THEN 'empty_history' WHEN 2 THEN 'invalid_label' WHEN 3 THEN 'missing_measure'
          ELSE CASE WHEN bn % 7 = 6 THEN 'duplicate_label' END END AS validation_error FROM landed""",
)
def stream_ingest(spark, folder):
    """Landed files to accepted rows and quarantine, as a stream."""
    path = work_path(spark, "landing")
    landed = R.landed_vendor_a(spark, folder).select("ingredient_id", "result")
    landed.write.json(f"{path}/in")
    responses = spark.readStream.schema("ingredient_id string, result string").json(f"{path}/in")
    L.start_landing(responses, f"{path}/accepted", f"{path}/quarantine", f"{path}/check").awaitTermination()
    shape = "ingredient_id string, result string, validation_error string, batch_id int"
    good = spark.read.schema(shape).parquet(f"{path}/accepted").withColumn("route", F.lit("accepted"))
    bad = spark.read.schema(shape).parquet(f"{path}/quarantine").withColumn("route", F.lit("quarantined"))
    return good.unionByName(bad).select("ingredient_id", "route", "validation_error")

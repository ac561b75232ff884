"""Stored things: published runs, the news store, raw files on disk, panels that grow with what lands."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weekcast.constants import VENDOR_A
from weekcast.operators import news as W, panel as P
from weekcast.operators.planning import duplicate_items
from weekcast.plans import raw_testbed as R, sql as S, testbed as T
from weekcast.plans.queries_forecast import _SIX_SQL, _six, full, rounded
from weekcast.plans.queries_ingest import _B_ROWS, _FILES_A, CUT
from weekcast.plans.queries_news import _ITEMS_SQL, items
from weekcast.plans.registry import plain, query
from weekcast.session import work_path
from weekcast.sources import landing as L, legacy as G, news_store as N, versions as V
from weekcast.sources.envelopes import candidates, list_raw, read_raw
from weekcast.streaming import increments as I

FIRST, SECOND, THIRD = (dt.datetime(2001, 8, day, tzinfo=dt.timezone.utc) for day in (1, 2, 3))


@query(
    "published_run",
    _six(f"""{_SIX_SQL} SELECT 'run-2' AS run_id, CAST(12 AS BIGINT) AS n_tables, horizon_weeks, split, model, {S.metric_columns(True)} FROM bounded GROUP BY 3, 4, 5""", (), S.METRIC_DOUBLES),
)
def published_run(spark, folder):
    """K5, K7: two runs of all twelve tables are published, a third breaks while it writes; readers see the second whole."""
    path, analysis = work_path(spark, "runs"), full(spark, folder)
    tables = analysis.tables()
    V.publish(tables, path, VENDOR_A, "run-1", FIRST)
    V.publish(tables, path, VENDOR_A, "run-2", SECOND)
    broken = {**tables, "displayed": tables["displayed"].withColumn("model", F.raise_error(F.lit("lost")).cast("string"))}
    try:
        V.publish(broken, path, VENDOR_A, "run-3", THIRD)
    except PySparkException:
        pass
    seen = V.read_newest(spark, path, VENDOR_A)
    version = V.newest(spark, path).agg(F.max("version")).scalar()
    return rounded(seen["summary"]).select(version.alias("run_id"), F.lit(len(seen)).alias("n_tables"), "*")


@query(
    "news_import",
    f"""WITH {_ITEMS_SQL},
      kept AS (SELECT url, arg_max(id, item_key) AS id FROM items WHERE error IS NULL AND evidence = 'verified_primary' GROUP BY 1),
      later AS (SELECT url, arg_max(id, item_key) AS id FROM items WHERE error IS NULL AND evidence = 'unverified' GROUP BY 1)
      SELECT 'stored' AS what, 'third' AS import_name, url, coalesce(l.id, k.id) AS id, NULL AS error FROM kept k FULL JOIN later l USING (url)
      UNION ALL SELECT 'refused', 'second', item_key, NULL, error FROM items WHERE error IS NOT NULL""",
)
def news_import(spark, folder):
    """One faulty record refuses an import whole, and the stored version stays; good imports make new versions."""
    path, every = work_path(spark, "news"), items(spark, folder)
    checked = W.normalize_items(every).select("item_key", "error", F.col("evidence").alias("level"))
    good = every.join(checked.filter("error is null").select("item_key", "level"), "item_key")
    part = lambda level: good.filter(F.col("level") == level).drop("level")
    N.import_version(part("verified_primary"), path, "first", FIRST)
    N.import_version(every.filter(F.col("evidence") != "verified_primary").unionByName(every.filter(F.col("evidence") == "verified_primary")), path, "second", SECOND)
    N.import_version(part("unverified"), path, "third", THIRD)
    version = V.newest(spark, path).agg(F.max("version")).scalar()
    none = F.lit(None).cast("string")
    stored = N.stored(spark, path).select(F.lit("stored").alias("what"), version.alias("import_name"), "url", "id", none.alias("error"))
    return stored.unionByName(N.refused(spark, path).select(F.lit("refused").alias("what"), "import_name", F.col("item_key").alias("url"), none.alias("id"), "error"))


def _written(spark, folder) -> str:
    """Vendor A's files on disk, in the three places of a file and with broken ones; a few files per brand."""
    root = work_path(spark, "raw")
    files = R.vendor_a_files(spark, folder).unionByName(R.trend_files(spark, folder))
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    # The fixture alone is written file by file: 7 files for each of 25 brands, at every size of the tables.
    for row in files.toLocalIterator():
        moved = row.path.replace(f"data/raw/{VENDOR_A}/US/", "data/raw/US/").replace("2001-07-30-a", f"{VENDOR_A}/2001-07-30-a")
        out = store.create(hadoop.Path(f"{root}/{moved if row.path.endswith('-a.json') else row.path}"))
        out.write(bytearray(row.text.encode()))
        out.close()
    return root


@query(
    "raw_scan",
    plain(f"""WITH {_FILES_A}, copies(copy, place, stem, priority, snapshot) AS (VALUES
        (1, 'data/raw/US/', '/amazon/sellersprite/2001-07-30-a', 1, DATE '2001-07-30'), (2, 'data/raw/US/', '/amazon/2001-07-30-b', 2, DATE '2001-07-30'),
        (3, 'data/raw/sellersprite/US/', '/amazon/2001-08-03', 0, DATE '2001-08-03'), (6, 'data/raw/sellersprite/US/', '/amazon/2001-08-04-c', 0, DATE '2001-08-04'))
      SELECT place || ingredient_id || stem || '.json' AS path, ingredient_id, CAST(priority AS BIGINT) AS priority, snapshot,
        CASE WHEN copy = 3 AND bn % 3 = 0 THEN 'identity_mismatch' WHEN copy = 6 THEN 'provider_failure' END AS error,
        (SELECT 7 * count(*) FROM brands) AS listed, (SELECT 5 * count(*) FROM brands) AS opened
      FROM brands CROSS JOIN copies WHERE bn % 13 <> 12""", ("snapshot",)),
)
def raw_scan(spark, folder):
    """Files on disk, listed by path first; those of another kind or a later day are never opened."""
    root = _written(spark, folder)
    opened = read_raw(spark, root, VENDOR_A, "amazon", R.RAW_AS_OF)
    found = candidates(opened, R.catalog(spark, folder), "amazon", VENDOR_A)
    listed = list_raw(spark, root).agg(F.count("*")).scalar()
    return found.select(
        F.regexp_extract("path", r"(data/raw/.*)$", 1).alias("path"), "ingredient_id", "priority", "snapshot", "error",
        listed.alias("listed"), opened.agg(F.count("*")).scalar().alias("opened"),
    )


@query(
    "stream_panel",
    plain(f"""WITH {S.SALES_A}, {_FILES_A}
      SELECT ingredient_id, week_end, CAST(searches + copy AS DOUBLE) AS searches, CAST(rank AS DOUBLE) AS rank
      FROM sales_a JOIN accepted USING (ingredient_id) WHERE week_end < {CUT}""", ("week_end",), ("searches", "rank")),
)
def stream_panel(spark, folder):
    """Files that land in three micro-batches, out of order; only changed weeks come out, and the panel is the batch run's."""
    path = work_path(spark, "increments")
    files = R.vendor_a_files(spark, folder).withColumn("turn", F.pmod(F.xxhash64("path"), F.lit(3)))
    for turn in range(3):
        files.filter(F.col("turn") == turn).drop("turn").coalesce(1).write.mode("append").json(f"{path}/in")
    landed = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).json(f"{path}/in")
    found = candidates(landed, R.catalog(spark, folder), "amazon", VENDOR_A)
    changes = I.panel_changes(found, F.lit(R.RAW_AS_OF))
    query = changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    weeks = I.current_weeks(spark.read.schema(I.CHANGES).parquet(f"{path}/out"))
    return P.clean_measures(P.completed_weeks(weeks, F.lit(R.RAW_AS_OF))).select("ingredient_id", "week_end", "searches", "rank")


@query(
    "stream_batches",
    f"""WITH {_B_ROWS}, batches AS (SELECT (bn - 1) // 5 AS batch_id, CASE WHEN (bn - 1) // 5 = 3 THEN 'keyword_set_mismatch' ELSE min(entry_error) END AS batch_error FROM verdict GROUP BY 1)
      SELECT CAST(batch_id AS BIGINT) AS batch_id, v.ingredient_id, 'saved' AS route, NULL AS batch_error, count(*) FILTER (WHERE sunday AND NOT repeated) AS weeks
      FROM verdict v JOIN batches b ON b.batch_id = (v.bn - 1) // 5 JOIN marked m USING (ingredient_id) WHERE b.batch_error IS NULL GROUP BY 1, 2
      UNION ALL SELECT CAST(batch_id AS BIGINT), NULL, 'quarantined', batch_error, NULL FROM batches WHERE batch_error IS NOT NULL""",
)
def stream_batches(spark, folder):
    """Vendor B batches as they land, a micro-batch per file; split by keyword or kept whole with their error."""
    path = work_path(spark, "batches")
    batches, wanted = R.vendor_b_batches(spark, folder)
    batches.repartition(3, "batch_id").write.json(f"{path}/in")
    landed = spark.readStream.schema(batches.schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    sink = I.batch_sink(wanted, f"{path}/saved", f"{path}/bad")
    landed.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    none = F.lit(None)
    saved = spark.read.schema("batch_id int, ingredient_id string, weeks int").parquet(f"{path}/saved")
    bad = spark.read.schema("batch_id int, batch_error string").parquet(f"{path}/bad")
    return saved.select("batch_id", "ingredient_id", F.lit("saved").alias("route"), none.cast("string").alias("batch_error"), "weeks").unionByName(
        bad.select("batch_id", none.cast("string").alias("ingredient_id"), F.lit("quarantined").alias("route"), "batch_error", none.cast("int").alias("weeks"))
    )


@query("duplicate_items", "SELECT p_brand AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_items_query(spark, folder):
    """L2: ids asked for more than once, with every row of the parts as a request."""
    return duplicate_items(T.table(spark, folder, "part").select(F.col("p_brand").alias("id")))


@query("duplicate_entries", "SELECT lower(p_name) AS keyword, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_entries_query(spark, folder):
    """Legacy keywords delivered more than once, ignoring case."""
    return G.duplicate_entries(T.table(spark, folder, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("keyword")))


@query(
    "evidence_classes",
    f"""WITH {_B_ROWS} SELECT ingredient_id, CASE WHEN bn % 8 = 7 THEN 'legacy_transcribed_unverifiable' ELSE 'legacy_programmatic_compact' END AS evidence FROM (SELECT DISTINCT ingredient_id, bn FROM base)""",
)
def evidence_classes(spark, folder):
    """What stands behind a legacy entry, by its fetch time."""
    fetched = F.get_json_object("text", "$.fetched_at")
    files = R.vendor_b_files(spark, folder).select("path", G.evidence_class(fetched).alias("evidence"))
    return files.select(F.regexp_extract("path", r"(Brand#\d+)", 1).alias("ingredient_id"), "evidence")

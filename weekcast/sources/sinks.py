"""Published tables: datasets, analysis outputs, run pointers and the news store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def publish_panel(panel: DataFrame, path: str, provider: str, as_of: dt.date) -> None:
    """Write a dataset; only its own provider/as_of partition is replaced."""
    (
        panel.withColumn("provider", F.lit(provider))
        .withColumn("as_of", F.lit(as_of))
        .repartition("ingredient_id")
        .sortWithinPartitions("ingredient_id", "week_end")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("provider", "as_of")
        .parquet(path)
    )


def publish_analysis(analysis, path: str, run_id: str, tables: tuple[str, ...] | None = None) -> None:
    """Write the output tables of a run below ``path``/<table>/run_id=...; earlier runs stay."""
    for name, frame in analysis.tables().items():
        if tables is None or name in tables:
            (
                frame.withColumn("run_id", F.lit(run_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("run_id")
                .parquet(f"{path}/{name}")
            )


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to an audit table (manifests, runs, quarantine)."""
    rows.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Newest completed run per provider (runs: provider, run_id, published_at, completed)."""
    return runs.filter("completed").groupBy("provider").agg(
        F.max_by("run_id", F.struct("published_at", "run_id")).alias("run_id"), F.max("published_at").alias("published_at")
    )


def export_document(analysis) -> DataFrame:
    """Forecast rows as one JSON text per ingredient (at most one entry per horizon each)."""
    rows = analysis.forecasts
    item = F.struct(*[c for c in rows.columns if c not in ("ingredient_id", "family_id")])
    return rows.groupBy("ingredient_id").agg(F.sort_array(F.collect_list(item)).alias("forecasts")).select(
        "ingredient_id", F.to_json(F.struct("ingredient_id", "forecasts"), {"ignoreNullFields": "false"}).alias("document")
    )


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of stored files, for hashing."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

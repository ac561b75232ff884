"""The stored news as versions: an import is taken whole or refused whole."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from weekcast.operators.news import merge_store, normalize_items
from weekcast.session import stage
from weekcast.sources import versions as V

OWNER = "news"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of the newest version, or None."""
    return V.read_newest(spark, path, OWNER).get("items")


def refused(spark: SparkSession, path: str) -> DataFrame:
    """Faulty records of refused imports: import_name, item_key, error."""
    shape = "import_name string, item_key string, error string"
    there = V._there(spark, f"{path.rstrip('/')}/refused")
    return spark.read.schema(shape).parquet(f"{path.rstrip('/')}/refused") if there else spark.createDataFrame([], shape)


def import_version(incoming: DataFrame, path: str, name: str, at: dt.datetime) -> bool:
    """Merge ``incoming`` into the newest version and publish the result as version ``name``.

    Records are checked in the pass that writes them. A single faulty one refuses the import: the faulty records are
    listed with their errors, and the stored version stays the newest. Says whether the import was taken.
    """
    spark, bad = incoming.sparkSession, Observation()
    fresh = stage(normalize_items(incoming).observe(bad, F.count("error").alias("n")), "incoming-news")
    if bad.get["n"]:
        faults = fresh.filter("error is not null").select(F.lit(name).alias("import_name"), "item_key", "error")
        faults.write.mode("append").parquet(f"{path.rstrip('/')}/refused")
        return False
    before = stored(spark, path)
    V.publish({"items": merge_store(before, fresh) if before is not None else merge_store(fresh.limit(0), fresh)}, path, OWNER, name, at)
    return True

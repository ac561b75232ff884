"""Versions of sets of tables: what a version holds is seen whole or not at all.

Tables are written to places of their own, one per attempt. Then one task appends one file with a row per table to
the list of versions; it appears by a single rename, so a writer that fails before it leaves nothing that a reader
would look at. Readers take the places from that list and never look for tables themselves.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

VERSIONS = "owner string, version string, published_at timestamp, table string, place string, rows bigint"


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_attempt(tables: dict[str, DataFrame], path: str, version: str) -> list[tuple[str, str, int]]:
    """Write tables below ``path``; (name, place, rows) of each. Nothing is published yet."""
    attempt, written = uuid.uuid4().hex, []
    for name, frame in tables.items():
        place = f"{path.rstrip('/')}/tables/{name}/{version}-{attempt}"
        seen = Observation()
        frame.observe(seen, F.count("*").alias("rows")).write.parquet(place)
        written.append((name, place, seen.get["rows"]))
    return written


def commit(spark: SparkSession, path: str, owner: str, version: str, published_at: dt.datetime, written: list[tuple[str, str, int]]) -> None:
    """Publish what an attempt has written, all of it at once."""
    rows = [(owner, version, published_at, *table) for table in written]
    spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/versions")


def publish(tables: dict[str, DataFrame], path: str, owner: str, version: str, published_at: dt.datetime) -> None:
    """Write and publish one version of ``tables``; an error in any of them publishes none."""
    spark = next(iter(tables.values())).sparkSession
    commit(spark, path, owner, version, published_at, write_attempt(tables, path, version))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """One row per table of every published version."""
    listed = f"{path.rstrip('/')}/versions"
    return spark.read.schema(VERSIONS).parquet(listed) if _there(spark, listed) else spark.createDataFrame([], VERSIONS)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of each owner's newest version; of one published twice, those published last."""
    listed = versions(spark, path)
    last = listed.groupBy("owner").agg(F.max(F.struct("published_at", "version")).alias("_last"))
    return listed.join(last.select("owner", "_last.*"), ["owner", "published_at", "version"], "left_semi")


def read_newest(spark: SparkSession, path: str, owner: str) -> dict[str, DataFrame]:
    """Tables of the newest version of ``owner`` by name; empty if there is none. A version has a few tables."""
    places = newest(spark, path).filter(F.col("owner") == owner).select("table", "place").collect()
    return {row.table: spark.read.parquet(row.place) for row in places}

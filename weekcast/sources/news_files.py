"""Saved news files: a list of items, or an object with items and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekcast.operators.news import ITEM


def news_items(texts: DataFrame) -> DataFrame:
    """Documents (path, text) to items with a unique ``item_key``; a leading byte-order mark is ignored."""
    clean = F.regexp_replace("text", "^\\uFEFF", "")
    record = ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in ITEM.split(", ")))
    shape = f"array<struct<{record.replace(', ', ',')}>>"
    bare = F.from_json(clean, shape)
    inside = F.from_json(F.get_json_object(clean, "$.items"), shape)
    listed = F.when(F.substring(F.ltrim(clean), 1, 1) == "[", bare).otherwise(inside)
    return texts.select("path", F.posexplode(listed).alias("_n", "_item")).select(
        F.concat_ws("#", "path", F.lpad(F.col("_n").cast("string"), 9, "0")).alias("item_key"), "_item.*"
    )


def news_metadata(texts: DataFrame) -> DataFrame:
    """Metadata fields next to ``items``, one row per document that has any."""
    return texts.filter(F.get_json_object("text", "$.items").isNotNull()).select(
        "path",
        F.get_json_object("text", "$.schema_version").alias("schema_version"),
        F.get_json_object("text", "$.searched_at").alias("searched_at"),
        F.get_json_object("text", "$.coverage_note").alias("coverage_note"),
    )

"""Texts by doc_id and a hash, and texts that go through a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F


def text_version(text: str = "text") -> Column:
    """A hash that tells texts of the same doc_id apart."""
    return F.xxhash64(F.lit(2), F.coalesce(F.col(text).cast("string"), F.lit("")))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, version and text of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_version().alias("version"), F.col("text").cast("string").alias("text"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, version and the text as a zstandard frame."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = [press.compress(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(frames, pa.binary())], ["doc_id", "version", "packed"])

    return text_rows(docs).mapInArrow(pack, "doc_id long, version long, packed binary")


def with_texts(docs: DataFrame, by_document: DataFrame, how: str) -> DataFrame:
    """doc_id, packed text and the ``places`` that ``by_document`` (doc_id, version, places) has for each text once."""
    wanted = by_document.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "places")
    texts = packed_texts(docs)
    return texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"]) & (texts["version"] == wanted["_version"]), how).select("doc_id", "packed", "places")

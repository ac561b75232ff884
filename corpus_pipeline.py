"""From raw documents to packed training sequences, in stages that are written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcast.llm import fuzzy_lines, harmonic_packing, simhash_bytes, string_tiling, toxic_segments
from weekcast.llm.training import held_out
from weekcast.session import work_path

END_ID = 2
LEAST_TOXIC = 0.3
#: Chunks of text remembered in a Python worker; few, for executors also hold what the other stages have left.
KEEP = 80_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that aren't held out; drop documents scored as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxic_segments.learn(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    return toxic_segments.without_toxic(docs, model, LEAST_TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier line equals or nearly equals, and documents that have lost all their words by that."""
    return fuzzy_lines.deduplicated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near-duplicates."""
    return simhash_bytes.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item."""
    return string_tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, placed in sequences."""
    packed = harmonic_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, keep=KEEP)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Token ids, fitted models and signatures have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = work_path(spark, f"pipeline-{name.lower().replace(' ', '-')}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

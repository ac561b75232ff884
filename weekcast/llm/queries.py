"""The corpus operators over the given tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcast.llm import ball_codes, collocations, fuzzy_lines, harmonic_packing, link_trust, rule_cascade, simhash_bytes, string_kernel, string_tiling, substring_dedup, token_codes, toxic_segments, zstd_quality
from weekcast.llm.training import held_out
from weekcast.session import work_path

END_ID = 2


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Write all documents' token ids as directly addressable codes and read them back."""
    path = work_path(spark, "token-codes")
    token_codes.write_codes(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_codes.read_codes(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Longest fitting rule first or not, the order here doesn't matter.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op2_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Judge every page by host rules and, where none fits, by trust and distrust of its host in the link graph."""
    return link_trust.judge(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """All documents that hold most of a benchmark item's words in tiles, with the item."""
    return string_tiling.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Which lines of all documents go, because an earlier line is equal or nearly so."""
    docs = table(spark, folder, "documents")
    gone = fuzzy_lines.dropped_lines(docs)
    return gone.select("doc_id", F.size("dropped").alias("n_dropped"), F.array_join("dropped", " ").alias("dropped"))


#: A document is predicted to have label 1 from this score on.
LEAST_SCORE = 0.3


def op5_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Score all documents for toxicity by their maximum-scoring segments."""
    docs, aside = table(spark, folder, "documents"), held_out(F.col("doc_id"), 4, 2)
    model = toxic_segments.learn(docs, table(spark, folder, "labels"), ~aside)
    scored = toxic_segments.score(docs, model)
    return scored.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Predict the language of all documents by a string kernel."""
    docs, aside = table(spark, folder, "documents"), held_out(F.col("doc_id"), 4, 2)
    model = string_kernel.learn(docs, ~aside)
    return string_kernel.predict(docs, model).select("doc_id", aside.alias("held_out"), "lang_pred", "score")


def op7_zstd_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score all documents for quality by two compression dictionaries."""
    docs, aside = table(spark, folder, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = zstd_quality.learn(docs, table(spark, folder, "labels"), ~aside)
    scored = zstd_quality.score(docs, model)
    return scored.select("doc_id", aside.alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op8_simhash_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint all documents and name each one's near-duplicate component."""
    placed = simhash_bytes.components(table(spark, folder, "documents"))
    return placed.select("doc_id", simhash_bytes.hexadecimal("print").alias("fingerprint"), "component_id")


def op9_rule_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Measure all documents and keep those that pass the cascade of quality rules."""
    judged = rule_cascade.judge(table(spark, folder, "documents"))
    base = [r.rejects for r in rule_cascade.base_rules()]
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (base[0] | base[1]).alias("base_failed"), F.col("failed_rule").isNull().alias("kept")
    )


def op10_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    packed = harmonic_packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_ball_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Compress all vectors to four bytes by codebooks that are refined over metric trees."""
    coded, books = ball_codes.compress(table(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(ball_codes.books_digest(books)).alias("codebooks_sha256"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents without the passages of 35 words that the corpus repeats."""
    left = substring_dedup.deduplicated(table(spark, folder, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest collocations of each language of all documents."""
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": op1_token_codes,
    "op2_link_trust": op2_link_trust,
    "op3_string_tiling": op3_string_tiling,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_toxic_segments": op5_toxic_segments,
    "op6_string_kernel": op6_string_kernel,
    "op7_zstd_quality": op7_zstd_quality,
    "op8_simhash_bytes": op8_simhash_bytes,
    "op9_rule_cascade": op9_rule_cascade,
    "op10_harmonic_packing": op10_harmonic_packing,
    "op11_ball_codes": op11_ball_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_collocations": op13_collocations,
}
_MEASURES_SQL = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM texts),
places AS (SELECT rid, i, ws[i:i + 4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5)),
again AS (SELECT rid, i FROM places QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY rid),
measured AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals, length(t) - length(replace(t, '!', '')) AS exclamations FROM split LEFT JOIN covered USING (rid)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * capitals > 30 * word_chars OR 100 * exclamations > 10 * n_words) AS kept
FROM based"""

#: The others rest on tokenizers, fitted models, signatures or rounds; the tests compare them with brute force.
ORACLES: dict[str, str] = {"op9_rule_cascade": _MEASURES_SQL}

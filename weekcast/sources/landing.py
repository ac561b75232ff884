"""Landed vendor responses: accept or quarantine, split batches, publish once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.functions.hashing import sorted_json
from weekcast.operators.histories import keyword_set_error, normalize_entries, vendor_a_payload_error
from weekcast.sources.envelopes import SECOND_BODY

CONTENT = "content array<struct<type:string,text:string>>"


def text_body(result: Column) -> Column:
    """First JSON text block inside ``content``."""
    blocks = F.from_json(result, CONTENT)["content"]
    return F.get(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), F.lit(0))["text"]


def second_body(text: Column) -> Column:
    """Vendor B history body (JSON text): bare, or in ``data`` next to a success code; NULL on failure."""
    outer = F.from_json(text, "code string, data string")
    return F.when(outer["code"].isNull(), text).when(outer["code"].isin("OK", "0", "200"), outer["data"])


def validate_vendor_a(landed: DataFrame) -> DataFrame:
    """Add ``validation_error`` to vendor A responses (column ``result``: JSON text)."""
    body = landed.withColumn("_body", text_body(F.col("result")))
    return body.withColumn(
        "validation_error",
        F.when(F.col("_body").isNull(), "no_text_content").otherwise(vendor_a_payload_error(F.col("_body"))),
    ).drop("_body")


def split_quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined); a rejected payload is kept whole next to its error."""
    bad = F.col("validation_error").isNotNull()
    return validated.filter(~bad).drop("validation_error"), validated.filter(bad)


def batch_entries(batches: DataFrame) -> DataFrame:
    """One normalised history per keyword of every batch response, with ``batch_error``.

    ``batches``: batch_id, keywords (requested, array), result (JSON text) and anything to carry along.
    A batch is good only if its keyword set is exactly the requested one and each entry is good.
    """
    body = batches.withColumn("_text", second_body(text_body(F.col("result")))).withColumn(
        "_body", F.from_json("_text", SECOND_BODY)
    )
    sets = body.withColumn(
        "_set_error",
        F.when(F.col("_text").isNull(), "no_body").otherwise(
            keyword_set_error(F.col("keywords"), F.transform("_body.keywords", lambda e: e["keyword"]))
        ),
    )
    carried = [c for c in batches.columns if c != "result"]
    entries = normalize_entries(
        sets.select(
            *carried,
            "_set_error",
            F.coalesce("_body.country", F.lit("US")).alias("country"),
            F.coalesce("_body.granularity", F.lit("week")).alias("granularity"),
            F.explode_outer("_body.keywords").alias("_entry"),
        ).select("*", "_entry.*")
    ).drop("_entry")
    verdicts = entries.groupBy("batch_id").agg(
        F.coalesce(F.max("_set_error"), F.min("entry_error")).alias("batch_error")
    )
    return entries.drop("_set_error").join(verdicts, "batch_id")


def keyword_records(entries: DataFrame, items: DataFrame) -> DataFrame:
    """One publishable record per requested item of every good batch.

    ``items``: batch_id, id, keyword. Record content is JSON with sorted keys, so equal records have
    equal hashes.
    """
    good = entries.filter("batch_error is null").drop("keywords")
    wanted = items.select("batch_id", F.col("id").alias("ingredient_id"), F.lower("keyword").alias("_key"))
    joined = good.withColumn("_key", F.lower("keyword")).join(wanted, ["batch_id", "_key"])
    content = sorted_json(
        keyword=F.col("keyword"),
        country=F.col("country"),
        granularity=F.col("granularity"),
        dates=F.transform("history", lambda x: x["day"]),
        volumes=F.transform("history", lambda x: x["volume"]),
        ranks=F.transform("history", lambda x: x["rank"]),
    )
    return joined.select(
        "ingredient_id",
        "keyword",
        "batch_id",
        F.size("history").alias("weeks"),
        "same_date_duplicates",
        "misaligned_duplicates",
        (F.col("same_date_duplicates") + F.col("misaligned_duplicates")).alias("deduplicated"),
        content.alias("content"),
        F.sha2(content, 256).alias("content_sha256"),
    )


def publication(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``action``: ``written`` (new key), ``reused`` (same content) or ``conflict`` (other content)."""
    known = stored.select("ingredient_id", F.col("content_sha256").alias("_stored"))
    return (
        records.join(known, "ingredient_id", "left")
        .withColumn(
            "action",
            F.when(F.col("_stored").isNull(), "written")
            .when(F.col("_stored") == F.col("content_sha256"), "reused")
            .otherwise("conflict"),
        )
        .drop("_stored")
    )


def recover_quarantined(evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """Re-validate quarantined vendor A responses against their ledger job; units stay as charged.

    ``evidence``: job_id, source, tool, request, envelope (canonical JSON) and result. ``jobs``: id,
    provider, tool, request, response_sha256, status, units.
    """
    job = jobs.select(
        F.col("id").alias("job_id"),
        F.col("provider").alias("_provider"),
        F.col("tool").alias("_tool"),
        F.col("request").alias("_request"),
        F.col("response_sha256").alias("_hash"),
        F.col("status").alias("_status"),
        "units",
    )
    matched = validate_vendor_a(evidence).join(job, "job_id", "left")
    identity = (
        (F.col("source") == F.col("_provider")) & (F.col("tool") == F.col("_tool")) & (F.col("request") == F.col("_request"))
    )
    verdict = (
        F.when(F.col("_status").isNull(), "unknown_job")
        .when(F.col("_status") != "failed_invalid_response", "not_quarantined")
        .when(~F.coalesce(identity, F.lit(False)), "evidence_mismatch")
        .when(~F.coalesce(F.sha2("envelope", 256) == F.col("_hash"), F.lit(False)), "hash_mismatch")
        .when(F.col("validation_error").isNotNull(), "still_invalid")
        .otherwise("saved")
    )
    return matched.withColumn("verdict", verdict).drop("_provider", "_tool", "_request", "_hash", "_status")

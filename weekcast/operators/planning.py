"""Refresh plans: cache hits, per-item jobs and batches of five."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import BATCH_SIZE, CACHE_DAYS, MARKETPLACE, VENDOR_A, VENDOR_A_TOOLS, VENDOR_B, VENDOR_B_TOOL
from weekcast.functions.hashing import sorted_json
from weekcast.operators.catalog import catalog_order
from weekcast.operators.scale import global_index
from weekcast.sources.envelopes import query_term


def safe_component(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit("-."))


def cache_path(provider: str, item: Column, kind: Column, day: Column, request: Column) -> Column:
    """Place of a response: provider / marketplace / item / kind / day-hash."""
    return F.concat_ws(
        "/",
        F.lit(f"data/raw/{provider}/{MARKETPLACE}"),
        safe_component(item),
        safe_component(kind),
        F.concat(day.cast("string"), F.lit("-"), F.substring(F.sha2(request, 256), 1, 12), F.lit(".json")),
    )


def amazon_request(term: Column) -> Column:
    return sorted_json(keyword=term, marketplace=F.lit(MARKETPLACE), timeGranularity=F.lit("W"))


def trend_request(term: Column) -> Column:
    inner = F.struct(
        F.lit("web").alias("googleProp"), term.alias("keyword"), F.lit(MARKETPLACE).alias("marketplace"), F.lit(False).alias("monthly")
    )
    return F.to_json(F.struct(inner.alias("request")))


def batch_request(terms: Column) -> Column:
    return sorted_json(country=F.lit(MARKETPLACE), granularity=F.lit("week"), keywords=terms)


def is_fresh(snapshot: Column, as_of: Column, cache_days: int = CACHE_DAYS) -> Column:
    return F.coalesce(F.datediff(as_of, snapshot) < cache_days, F.lit(False))


def wanted_refreshes(
    items: DataFrame, snapshots: DataFrame, as_of: Column, provider: str = VENDOR_A, refresh_amazon: bool = False
) -> DataFrame:
    """Selected items x (amazon, google): cache hit or not.

    ``snapshots``: ingredient_id, kind, provider, snapshot, path of the latest valid envelopes.
    """
    kinds = F.explode(
        F.array(
            F.struct(F.lit("amazon").alias("kind"), F.lit(provider).alias("provider")),
            F.struct(F.lit("google").alias("kind"), F.lit(VENDOR_A).alias("provider")),
        )
    )
    asked = items.select("id", "keyword", "queries", "selected", kinds.alias("_k")).select("id", "keyword", "queries", "selected", "_k.*")
    known = snapshots.withColumnRenamed("ingredient_id", "id")
    hit = is_fresh(F.col("snapshot"), as_of)
    if refresh_amazon:
        hit = hit & (F.col("kind") != "amazon")
    return asked.join(known, ["id", "kind", "provider"], "left").withColumn("hit", hit)


def item_jobs(missing: DataFrame, as_of: Column) -> DataFrame:
    """One job per item and kind at vendor A."""
    term = query_term(F.col("queries"), F.col("keyword"), VENDOR_A)
    is_amazon = F.col("kind") == "amazon"
    request = F.when(is_amazon, amazon_request(term)).otherwise(trend_request(term))
    return missing.select(
        F.col("id").alias("ingredient_id"),
        term.alias("keyword"),
        "kind",
        F.lit(VENDOR_A).alias("provider"),
        F.when(is_amazon, VENDOR_A_TOOLS["amazon"]).otherwise(VENDOR_A_TOOLS["google"]).alias("tool"),
        request.alias("request"),
        F.lit(1).alias("cost_units"),
        cache_path(VENDOR_A, F.col("id"), F.col("kind"), as_of, request).alias("cache_path"),
    )


def duplicate_items(items: DataFrame) -> DataFrame:
    return items.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def batch_jobs(missing: DataFrame, as_of: Column, size: int = BATCH_SIZE) -> DataFrame:
    """Batches of at most ``size`` items in catalog order, one charged unit each."""
    placed = global_index(missing, *catalog_order())
    term = query_term(F.col("queries"), F.col("keyword"), VENDOR_B)
    # A group is one batch: never more than ``size`` rows.
    grouped = (
        placed.withColumn("batch_index", F.floor(F.col("position") / size).cast("int"))
        .groupBy("batch_index")
        .agg(F.sort_array(F.collect_list(F.struct("position", "id", term.alias("keyword")))).alias("_items"))
    )
    request = batch_request(F.transform("_items", lambda x: x["keyword"]))
    targets = F.transform(
        "_items",
        lambda x: F.struct(
            x["id"].alias("ingredient_id"),
            x["keyword"].alias("keyword"),
            cache_path(VENDOR_B, x["id"], F.lit("amazon"), as_of, batch_request(F.array(x["keyword"]))).alias("cache_path"),
        ),
    )
    return grouped.select(
        "batch_index",
        F.size("_items").alias("n_items"),
        F.lit(VENDOR_B).alias("provider"),
        F.lit(VENDOR_B_TOOL).alias("tool"),
        request.alias("request"),
        F.lit(1).alias("cost_units"),
        cache_path(VENDOR_B, F.lit("_batches"), F.lit("history"), as_of, request).alias("cache_path"),
        targets.alias("cache_targets"),
    )


def collection_plan(
    items: DataFrame, snapshots: DataFrame, as_of: Column, provider: str = VENDOR_A, refresh_amazon: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, item jobs, batch jobs) of a refresh; vendor B Amazon histories go in batches."""
    state = wanted_refreshes(items, snapshots, as_of, provider, refresh_amazon)
    hits = state.filter("hit").select(F.col("id").alias("ingredient_id"), "kind", "provider", "path")
    missing = state.filter(~F.col("hit"))
    single = item_jobs(missing.filter(F.col("provider") == VENDOR_A), as_of)
    batched = batch_jobs(missing.filter(F.col("provider") == VENDOR_B), as_of)
    return hits, single, batched

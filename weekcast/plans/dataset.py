"""From raw envelopes to the published weekly dataset of one provider."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from weekcast.constants import MARKETPLACE, VENDOR_A, VENDOR_B
from weekcast.operators import panel as P
from weekcast.operators.histories import history_problem
from weekcast.session import stage
from weekcast.sources.envelopes import candidates, latest_valid, query_term, trend_problem


class Dataset:
    """Panel, quality, lineage and manifest tables built from raw (path, text) files.

    ``catalog``: id, family_id, keyword, name_cn, queries (map) and selected. A bad Amazon history
    drops its ingredient with a warning; a bad trend history only leaves the trend NULL.
    """

    def __init__(self, raw: DataFrame, catalog: DataFrame, as_of: dt.date, provider: str = VENDOR_A):
        self.raw, self.catalog, self.provider = raw, catalog, provider
        self.cut = F.lit(as_of)

    def _latest(self, kind: str, provider: str) -> DataFrame:
        """Winning envelopes: every file is parsed once, and only keys are compared."""
        found = candidates(self.raw, self.catalog, kind, provider).filter(F.col("error").isNull() & (F.col("snapshot") <= self.cut))
        return latest_valid(stage(found, "valid-envelopes"), self.cut)

    @cached_property
    def amazon(self) -> DataFrame:
        """Chosen Amazon envelope per ingredient with ``problem``."""
        best = self._latest("amazon", self.provider)
        return stage(best.withColumn("problem", history_problem(F.col("history"), self.cut)), "amazon")

    @cached_property
    def trends(self) -> DataFrame:
        best = self._latest("google", VENDOR_A)
        return stage(best.withColumn("problem", trend_problem(F.col("items"), self.cut)), "trends")

    @cached_property
    def weekly_raw(self) -> DataFrame:
        """Completed weeks of accepted histories, values still as the vendor's text."""
        rows = self.amazon.filter("problem is null").select("ingredient_id", F.inline("history"))
        return P.completed_weeks(rows, self.cut)

    @cached_property
    def panel(self) -> DataFrame:
        items = self.trends.filter("problem is null").select("ingredient_id", F.inline("items"))
        trend = items.select(
            "ingredient_id", F.date_add("start", 6).alias("week_end"), P.within_percent(F.col("value")).alias("value")
        )
        aligned = P.align(P.clean_measures(self.weekly_raw), P.lag_trend(trend, self.cut))
        about = self.catalog.select(
            F.col("id").alias("ingredient_id"),
            "family_id",
            query_term(F.col("queries"), F.col("keyword"), self.provider).alias("keyword"),
            "name_cn",
        )
        with_trend = self.trends.select("ingredient_id", F.lit(VENDOR_A).alias("google_provider"))
        return (
            aligned.join(about, "ingredient_id")
            .join(with_trend, "ingredient_id", "left")
            .select(
                "ingredient_id",
                "family_id",
                "keyword",
                "name_cn",
                F.lit(MARKETPLACE).alias("marketplace"),
                "week_end",
                "searches",
                "rank",
                "google_trend",
                F.lit(self.provider).alias("amazon_provider"),
                F.lit(self.provider).alias("amazon_source"),
                F.coalesce("google_provider", F.lit("")).alias("google_provider"),
            )
        )

    @cached_property
    def warnings(self) -> DataFrame:
        """Warning codes per selected ingredient."""
        asked = self.catalog.filter("selected").select(F.col("id").alias("ingredient_id"))
        absent = asked.join(self.amazon, "ingredient_id", "left_anti").select(
            "ingredient_id", F.lit("missing_amazon_history").alias("code")
        )
        rejected = self.amazon.filter("problem is not null").select("ingredient_id", F.col("problem").alias("code"))
        accepted = self.amazon.filter("problem is null").select("ingredient_id")
        trend = self.trends.filter("problem is not null").join(accepted, "ingredient_id", "left_semi").select(
            "ingredient_id", F.col("problem").alias("code")
        )
        standing = ["trend_week_unconfirmed", "revised_history", "estimated_searches"]
        if self.provider == VENDOR_B:
            standing.append("secondary_provider_scale")
        always = accepted.select("ingredient_id", F.explode(F.array(*map(F.lit, standing))).alias("code"))
        values = (
            P.value_quality(self.weekly_raw)
            .filter("invalid_search_values > 0 or invalid_rank_values > 0")
            .select("ingredient_id", F.lit("invalid_values_nulled").alias("code"))
        )
        return absent.unionByName(rejected).unionByName(trend).unionByName(always).unionByName(values)

    @cached_property
    def quality(self) -> DataFrame:
        """One row per selected ingredient: value counts, weeks, chosen files and number of warnings."""
        asked = self.catalog.filter("selected").select(F.col("id").alias("ingredient_id"))
        files = self.amazon.select("ingredient_id", F.col("path").alias("amazon_cache"), F.col("fetched_at").alias("amazon_fetched_at"))
        trends = self.trends.select("ingredient_id", F.col("path").alias("google_cache"), F.col("fetched_at").alias("google_fetched_at"))
        counts = P.value_quality(self.weekly_raw).drop("non_numeric_search_values")
        warned = self.warnings.groupBy("ingredient_id").agg(F.count("*").alias("warnings"))
        rows = asked
        for part in (files, trends, counts, P.panel_quality(self.panel), warned):
            rows = rows.join(part, "ingredient_id", "left")
        return rows.withColumn("amazon_provider", F.lit(self.provider)).withColumn(
            "warnings", F.coalesce("warnings", F.lit(0))
        )

    @cached_property
    def inputs(self) -> DataFrame:
        """Lineage: every file the panel was built from, with hashes of the file and of its batch."""
        used = self.amazon.filter("problem is null").select(
            "ingredient_id", F.lit("amazon").alias("dataset"), "provider", "source", "path", "provenance", "fetched_at", "tool", "request"
        )
        trend = (
            self.trends.filter("problem is null")
            .join(used.select("ingredient_id"), "ingredient_id", "left_semi")
            .select("ingredient_id", F.lit("google").alias("dataset"), "provider", "source", "path", "provenance", "fetched_at", "tool", "request")
        )
        batch = F.from_json("provenance", "raw_batch_path string, raw_batch_sha256 string")
        hashes = self.raw.select("path", F.sha2("text", 256).alias("sha256"))
        return (
            used.unionByName(trend)
            .join(hashes, "path")
            .withColumn("_batch", batch)
            .withColumns(
                {
                    "source": F.coalesce("source", "provider"),
                    "source_path": F.coalesce("_batch.raw_batch_path", "path"),
                    "source_sha256": F.coalesce("_batch.raw_batch_sha256", "sha256"),
                }
            )
            .drop("_batch", "provenance")
        )

    @cached_property
    def manifest(self) -> DataFrame:
        return manifest(self.panel, self.provider, self.cut)


def manifest(panel: DataFrame, provider: str, as_of) -> DataFrame:
    """One row describing a published panel."""
    return panel.agg(
        F.count("*").alias("rows"),
        F.countDistinct("ingredient_id").alias("ingredients"),
        F.min("week_end").alias("first_week"),
        F.max("week_end").alias("last_week"),
        fingerprint().alias("panel_fingerprint"),
    ).withColumns(
        {
            "schema_version": F.lit("2.0"),
            "as_of": as_of,
            "marketplace": F.lit(MARKETPLACE),
            "amazon_provider": F.lit(provider),
            "google_provider": F.lit(VENDOR_A),
            "provider_policy": F.lit("single_amazon_provider"),
            "google_lag_weeks": F.lit(1),
        }
    )


def fingerprint():
    """Content hash of a panel that does not depend on row order: sum of 48-bit row hashes."""

    def number(name):
        return F.coalesce(F.col(name).cast("decimal(38,6)").cast("string"), F.lit("-"))

    text = F.concat_ws("|", "ingredient_id", F.col("week_end").cast("string"), number("searches"), number("rank"), number("google_trend"))
    head = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.sum(head).cast("string")


def assemble_panel(raw: DataFrame, catalog: DataFrame, as_of: dt.date, provider: str = VENDOR_A) -> Dataset:
    return Dataset(raw, catalog, as_of, provider)

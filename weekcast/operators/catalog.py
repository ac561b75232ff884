"""Candidate library to audited catalog: roll-up, eligibility, selection and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import (
    BRAND_OVERRIDES,
    EXCLUDED_CATEGORIES,
    MIXTURE_MARKS,
    PET_CATEGORY,
    PINNED_ID,
    VENDORS,
    VENDOR_A,
)
from weekcast.functions.text import canonical_name, family, slug


def library_key(name: Column, category: Column) -> Column:
    """Canonical name; the same substance for pets is a different search audience."""
    return F.concat(canonical_name(name), F.when(category == PET_CATEGORY, " (pet)").otherwise(""))


def unnamed_rows(library: DataFrame) -> DataFrame:
    """Library rows without a name (the build must not go on with any)."""
    return library.filter(F.coalesce(F.trim("name"), F.lit("")) == "")


def invalid_mappings(mappings: DataFrame) -> DataFrame:
    """Reviewed mappings with a blank key, family or provider term."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank(F.col("canonical")) | blank(F.col("family_id"))
    for vendor in VENDORS:
        bad = bad | blank(F.try_element_at("queries", F.lit(vendor)))
    return mappings.filter(bad)


def build_catalog(library: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per canonical ingredient.

    ``library``: category, position (of first sight), name, name_cn, brands. ``mappings``: canonical,
    family_id, queries, review_status. Sets are reduced map-side, so what is shuffled and held per
    entry is its distinct categories, aliases and brands only.
    """
    keyed = library.withColumn("canonical", library_key(F.col("name"), F.col("category")))
    rolled = (
        keyed.withColumn("_brand", F.explode_outer("brands"))
        .groupBy("canonical")
        .agg(
            F.min(F.struct("position", "name", F.coalesce("name_cn", F.lit("")).alias("name_cn"))).alias("_first"),
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.array_sort(F.collect_set("name")).alias("aliases"),
            F.array_sort(F.collect_set("_brand")).alias("brands"),
        )
    )
    mapped = rolled.join(mappings.withColumnRenamed("family_id", "_family"), "canonical", "left")
    is_mapped = F.col("queries").isNotNull()
    excluded = F.size(F.array_except("categories", F.array(*map(F.lit, EXCLUDED_CATEGORIES)))) == 0
    mixture = F.lit(False)
    for mark in MIXTURE_MARKS:
        mixture = mixture | F.contains("canonical", F.lit(mark))
    brands = F.col("brands")
    for key, fixed in BRAND_OVERRIDES.items():
        brands = F.when(F.col("canonical") == key, F.array(*map(F.lit, fixed))).otherwise(brands)
    eligible = ~excluded & ~mixture
    selected = eligible & is_mapped
    return mapped.select(
        slug(F.col("canonical")).alias("id"),
        "canonical",
        F.coalesce("_family", family(F.col("canonical"))).alias("family_id"),
        F.col("_first.name").alias("name"),
        F.col("_first.name_cn").alias("name_cn"),
        F.try_element_at("queries", F.lit(VENDOR_A)).alias("keyword"),
        F.coalesce("queries", F.create_map().cast("map<string,string>")).alias("queries"),
        "categories",
        brands.alias("brands"),
        "aliases",
        eligible.alias("eligible"),
        F.when(excluded, "excluded_category").when(mixture, "mixture").alias("exclusion_reason"),
        selected.alias("selected"),
        F.lit(False).alias("claims_verified"),
        F.when(selected, F.coalesce("review_status", F.lit("reviewed_mapping"))).otherwise("requires_review").alias("query_status"),
    )


def catalog_order() -> list[Column]:
    """Selected first, the pinned id first among them, then by id."""
    return [(~F.col("selected")).asc(), (F.col("id") != PINNED_ID).asc(), F.col("id").asc()]


def library_audit(library: DataFrame, catalog: DataFrame) -> DataFrame:
    """Counts of a build, one row."""
    records = library.agg(
        F.count("*").alias("records"),
        F.countDistinct("category").alias("categories"),
    )
    names = library.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("unique_names"), F.count_if(F.col("n") > 1).alias("duplicate_names")
    )
    entries = catalog.agg(
        F.count("*").alias("canonical_count"),
        F.count_if("selected").alias("selected_count"),
        F.count_if(~F.col("eligible")).alias("excluded_count"),
    )
    one = lambda df: [df.select(c).scalar().alias(c) for c in df.columns]
    return records.select("*", *one(names), *one(entries))


def duplicate_names(library: DataFrame) -> DataFrame:
    return library.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


def unresolved_mappings(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reviewed mappings that no library entry answers to."""
    return mappings.select("canonical").join(catalog.select("canonical"), "canonical", "left_anti")


def selected_items(catalog: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Selected entries, of the requested ids if any, in catalog order up to ``limit``."""
    rows = catalog.filter("selected")
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    return rows if limit is None else rows.orderBy(*catalog_order()).limit(limit)


def requested_id_problems(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that must stop a run: unknown, not selected, or (one row, NULL id) none at all."""
    asked = ids.select("id").distinct()
    known = catalog.select("id", "selected")
    judged = asked.join(known, "id", "left").select(
        "id", F.when(F.col("selected").isNull(), "unknown").when(~F.col("selected"), "unselected").alias("problem")
    )
    empty = asked.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(None).cast("string").alias("id"), F.lit("no_ids").alias("problem")
    )
    return judged.filter("problem is not null").unionByName(empty)

"""Scans of the candidate library, the reviewed mappings and other JSON side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LIBRARY = (
    "categories array<struct<id:string,ingredients:array<struct<name:string,nameCN:string,keyBrands:array<string>>>>>"
)
MAPPINGS = (
    "schema_version int, mappings map<string,struct<family_id:string,queries:map<string,string>,review_status:string>>"
)


def library_rows(documents: DataFrame) -> DataFrame:
    """Nested library documents to (category, position, name, name_cn, brands)."""
    categories = documents.select(F.posexplode("categories").alias("_c", "category"))
    return categories.select("_c", "category.id", F.posexplode("category.ingredients").alias("_i", "row")).select(
        F.col("id").alias("category"),
        F.struct("_c", "_i").alias("position"),
        F.col("row.name").alias("name"),
        F.col("row.nameCN").alias("name_cn"),
        F.col("row.keyBrands").alias("brands"),
    )


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return library_rows(spark.read.schema(LIBRARY).json(path, multiLine=True))


def mapping_rows(texts: DataFrame) -> DataFrame:
    """Mapping documents (column ``text``) to one row per canonical name."""
    parsed = texts.select(F.from_json("text", MAPPINGS).alias("d")).filter("d.schema_version = 1")
    return parsed.select(F.explode("d.mappings").alias("canonical", "m")).select("canonical", "m.*")


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    return mapping_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def auxiliary_rows(texts: DataFrame) -> DataFrame:
    """Context files that name an ingredient: (ingredient_id, context as JSON text)."""
    return texts.select(F.get_json_object("text", "$.ingredient_id").alias("ingredient_id"), F.col("text").alias("context")).filter(
        "ingredient_id is not null"
    )


def competition_rows(texts: DataFrame) -> DataFrame:
    """Competition snapshot map {ingredient: object} to (ingredient_id, recent_snapshot as JSON text)."""
    parsed = texts.select(F.explode(F.from_json("text", "map<string,string>")).alias("ingredient_id", "recent_snapshot"))
    return parsed


def with_context(ingredients: DataFrame, quality: DataFrame, auxiliary: DataFrame, competition: DataFrame) -> DataFrame:
    """Ingredients with their quality warnings, context file and competition snapshot, if any."""
    rows = ingredients
    for side in (quality, auxiliary, competition):
        rows = rows.join(side, "ingredient_id", "left")
    return rows

"""Driver tables in the shapes of the domain: two vendors' weekly sales, trends, items and events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weekcast.functions.dates import saturday_of
from weekcast.operators import panel as P
from weekcast.session import stage

AS_OF = dt.date(2001, 7, 28)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Output form: dates as ISO text, doubles rounded to 6 decimals without negative zero."""
    columns = []
    for name, kind in df.dtypes:
        if kind == "date":
            columns.append(F.col(name).cast("string").alias(name))
        elif kind == "double":
            columns.append((F.round(name, 6) + F.lit(0.0)).alias(name))
        elif kind == "int":
            columns.append(F.col(name).cast("bigint").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def before(rows: DataFrame, column: str, as_of: dt.date | None) -> DataFrame:
    """Rows whose week can have ended before ``as_of``; the plain comparison reaches the Parquet scan."""
    return rows if as_of is None else rows.filter(F.col(column) < F.lit(as_of).cast("timestamp_ntz"))


def sales_a(spark: SparkSession, folder: str, entity: str = "p_brand", as_of: dt.date | None = None) -> DataFrame:
    """Vendor A: quantity by ship week, with a rank that falls as the number of lines grows."""
    lines = before(table(spark, folder, "lineitem"), "l_shipdate", as_of)
    week = saturday_of(F.to_date("l_shipdate")).alias("week_end")
    if entity.startswith("p_"):
        part = table(spark, folder, "part").select("p_partkey", entity)
        lines = lines.select("l_partkey", "l_quantity", "l_shipdate").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return (
        lines.groupBy(F.col(entity).alias("ingredient_id"), week)
        .agg(F.sum("l_quantity").alias("searches"), F.count("*").alias("n_lines"))
        .withColumn("rank", (F.floor(F.lit(100000) / F.col("n_lines")) + 1).cast("double"))
    )


def sales_b(spark: SparkSession, folder: str, as_of: dt.date | None = None) -> DataFrame:
    """Vendor B: price by order week, same entities."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = before(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", as_of)
    part = table(spark, folder, "part").select("p_partkey", "p_brand")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("ingredient_id"), saturday_of(F.to_date("o_orderdate")).alias("week_end"))
        .agg(F.sum(F.floor("l_extendedprice")).cast("double").alias("searches"), F.count("*").alias("n_lines"))
        .withColumn("rank", (F.floor(F.lit(100000) / F.col("n_lines")) + 1).cast("double"))
    )


def trend(sales: DataFrame) -> DataFrame:
    """0..100 index of the weekly line count against the greatest count so far (past only)."""
    so_far = Window.partitionBy("ingredient_id").orderBy("week_end").rowsBetween(Window.unboundedPreceding, 0)
    value = F.lit(100.0) * F.col("n_lines") / F.max("n_lines").over(so_far)
    return sales.select("ingredient_id", "week_end", value.alias("value"))


def build_panel(sales: DataFrame, as_of: dt.date = AS_OF, provider: str = "sellersprite") -> DataFrame:
    """Gap-filled panel with lagged trend; every entity is its own family.

    Sales and trend both come from the weekly totals, which are staged: the lines are read once.
    """
    cut = F.lit(as_of)
    sales = stage(sales, "sales")
    amazon = P.clean_measures(P.completed_weeks(sales, cut))
    lagged = P.lag_trend(trend(sales), cut)
    aligned = P.align(amazon, lagged)
    return aligned.withColumns(
        {
            "family_id": F.col("ingredient_id"),
            "marketplace": F.lit("US"),
            "amazon_provider": F.lit(provider),
        }
    )


def panel_a(spark: SparkSession, folder: str, entity: str = "p_brand") -> DataFrame:
    return build_panel(sales_a(spark, folder, entity, AS_OF), AS_OF, "sellersprite")


def panel_b(spark: SparkSession, folder: str) -> DataFrame:
    return build_panel(sales_b(spark, folder, AS_OF), AS_OF, "sif")

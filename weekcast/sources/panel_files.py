"""Prepared weekly panels in CSV or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weekcast.constants import MARKETPLACE, VENDOR_A
from weekcast.operators.panel import clean_measures
from weekcast.operators.validate import require_valid
from weekcast.session import stage

CSV_COLUMNS = (
    "ingredient_id",
    "family_id",
    "keyword",
    "name_cn",
    "marketplace",
    "week_end",
    "searches",
    "rank",
    "google_trend",
    "amazon_provider",
    "amazon_source",
    "google_provider",
)


def prepare(panel: DataFrame, provider: str = VENDOR_A) -> DataFrame:
    """Defaults for optional columns, types and cleaned measures; NULL keys are left for validation."""
    text = {"keyword": F.lit(""), "name_cn": F.lit(""), "marketplace": F.lit(MARKETPLACE)}
    columns = {c: F.col(c) for c in panel.columns}
    for name, default in text.items():
        columns[name] = F.coalesce(columns.get(name, default), default)
    for name in ("searches", "rank", "google_trend"):
        columns.setdefault(name, F.lit(None).cast("double"))
    columns["family_id"] = F.coalesce(columns.get("family_id", F.col("ingredient_id")), F.col("ingredient_id"))
    source = columns.get("amazon_source", F.lit(provider))
    columns["amazon_provider"] = F.lower(columns.get("amazon_provider", source))
    columns["week_end"] = F.col("week_end").cast("date")
    return clean_measures(panel.select(*[value.alias(name) for name, value in columns.items()]))


def read_panel_csv(spark: SparkSession, path: str, provider: str = VENDOR_A) -> DataFrame:
    """CSV with a header in any column order; read as text, typed and staged once, then validated."""
    typed = prepare(spark.read.option("header", "true").csv(path), provider)
    return require_valid(stage(typed, "panel-csv"))


def read_panel(spark: SparkSession, path: str, provider: str | None = None, as_of: str | None = None) -> DataFrame:
    """Published Parquet panels; provider and as_of prune partitions."""
    panel = spark.read.parquet(path)
    if provider is not None:
        panel = panel.filter(F.col("provider") == provider)
    if as_of is not None:
        panel = panel.filter(F.col("as_of") == F.lit(as_of).cast("date"))
    return panel

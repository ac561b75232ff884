"""Legacy compact vendor B entries: shared date grid, duplicates, tail check, exact week pairing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.constants import MIN_OVERLAP_WEEKS
from weekcast.functions.dates import is_sunday, strict_date
from weekcast.operators.histories import same_value


def with_grid(entries: DataFrame, grid: DataFrame) -> DataFrame:
    """Entries without dates of their own take the one shared grid (a single-row table)."""
    return entries.withColumn("dates", F.coalesce(F.when(F.size("dates") > 0, F.col("dates")), grid.select("dates").scalar()))


def duplicate_entries(entries: DataFrame) -> DataFrame:
    """Keywords delivered more than once, ignoring case."""
    return entries.groupBy(F.lower("keyword").alias("keyword")).agg(F.count("*").alias("n")).filter("n > 1")


def checked(entries: DataFrame) -> DataFrame:
    """Add ``entry_error``: array lengths, tail equal to ``latest``, Sunday labels."""
    size = F.size("dates")
    tail = F.lit(-1)
    tail_ok = (
        (F.try_element_at("dates", tail) == F.col("latest.date"))
        & same_value(F.try_element_at("volumes", tail), F.col("latest.volume"))
        & same_value(F.try_element_at("ranks", tail), F.col("latest.rank"))
    )
    return entries.withColumn(
        "entry_error",
        F.when(F.col("dates").isNull() | F.col("volumes").isNull() | F.col("ranks").isNull(), "missing_arrays")
        .when((size <= 0) | (size != F.size("volumes")) | (size != F.size("ranks")), "length_mismatch")
        .when(F.col("latest").isNotNull() & ~F.coalesce(tail_ok, F.lit(False)), "tail_mismatch")
        .when(F.exists("dates", lambda d: ~F.coalesce(is_sunday(strict_date(d)), F.lit(False))), "non_sunday"),
    )


def weeks_of(entries: DataFrame, cutoff: Column) -> DataFrame:
    """Distinct weeks up to the cutoff (inclusive) of good entries; the first row of a week is kept."""
    rows = entries.filter("entry_error is null").select(
        "ingredient_id", F.posexplode(F.arrays_zip("dates", "volumes", "ranks")).alias("_pos", "_row")
    )
    dated = rows.withColumn("week_end", F.date_add(strict_date(F.col("_row.dates")), 6)).filter(F.col("week_end") <= cutoff)
    return dated.groupBy("ingredient_id", "week_end").agg(F.min_by("_row", "_pos").alias("_first")).select(
        "ingredient_id",
        "week_end",
        F.col("_first.volumes").alias("searches"),
        F.col("_first.ranks").alias("rank"),
    )


def pair_weeks(
    entries: DataFrame, other_weeks: DataFrame, catalog: DataFrame, cutoff: dt.date, min_weeks: int = MIN_OVERLAP_WEEKS
) -> tuple[DataFrame, DataFrame]:
    """(paired rows, outcome per catalog entry): only weeks both vendors have, at least ``min_weeks``.

    ``entries``: ingredient_id and checked arrays; ``other_weeks``: ingredient_id, week_end.
    """
    ours = weeks_of(entries, F.lit(cutoff))
    shared = ours.join(other_weeks.select("ingredient_id", "week_end").distinct(), ["ingredient_id", "week_end"], "left_semi")
    counts = shared.groupBy("ingredient_id").agg(F.count("*").alias("overlap_weeks"))
    partner = other_weeks.select("ingredient_id").distinct().withColumn("_partner", F.lit(True))
    known = entries.select("ingredient_id", F.lit(True).alias("_entry"), "entry_error")
    outcome = (
        catalog.filter("selected")
        .select(F.col("id").alias("ingredient_id"))
        .join(known, "ingredient_id", "left")
        .join(partner, "ingredient_id", "left")
        .join(counts, "ingredient_id", "left")
        .select(
            "ingredient_id",
            F.coalesce("overlap_weeks", F.lit(0)).alias("overlap_weeks"),
            F.when(F.col("_entry").isNull(), "no_entry")
            .when(F.col("_partner").isNull(), "no_partner_history")
            .when(F.col("entry_error").isNotNull(), F.col("entry_error"))
            .when(F.coalesce("overlap_weeks", F.lit(0)) < min_weeks, "too_few_weeks")
            .otherwise("built")
            .alias("outcome"),
        )
    )
    built = outcome.filter("outcome = 'built'").select("ingredient_id")
    return shared.join(built, "ingredient_id", "left_semi"), outcome


def evidence_class(fetched_at: Column) -> Column:
    return F.when(F.coalesce(fetched_at, F.lit("")) != "", "legacy_programmatic_compact").otherwise(
        "legacy_transcribed_unverifiable"
    )

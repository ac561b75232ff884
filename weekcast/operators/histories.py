"""Vendor history validators as array expressions.

A history is one document's arrays. It is checked and cleaned inside its row with array functions,
so validating any number of envelopes needs no shuffle, and a bad history is rejected whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.functions.dates import compact_date, is_saturday, is_sunday, strict_date
from weekcast.functions.numeric import as_number


def same_value(a: Column, b: Column) -> Column:
    """Equal as JSON scalars: both missing, equal text, or equal numbers."""
    return F.coalesce(a.eqNullSafe(b) | (as_number(a) == as_number(b)), F.lit(False))


def _same_observation(a: Column, b: Column) -> Column:
    return same_value(a["volume"], b["volume"]) & same_value(a["rank"], b["rank"])


def _parallel_rows(dates: Column, volumes: Column, ranks: Column, parse) -> Column:
    return F.transform(
        F.arrays_zip(dates.alias("d"), volumes.alias("v"), ranks.alias("r")),
        lambda x, i: F.struct(
            parse(x["d"]).alias("day"), i.alias("pos"), x["v"].alias("volume"), x["r"].alias("rank")
        ),
    )


def _with_neighbours(rows: Column) -> Column:
    """Array of (row, before, after). Shifted copies instead of look-ups keep this linear."""
    nothing = F.array(F.lit(None))
    shorter = F.greatest(F.size(rows) - 1, F.lit(0))
    before = F.concat(nothing, F.slice(rows, F.lit(1), shorter))
    after = F.concat(F.slice(rows, F.lit(2), shorter), nothing)
    return F.arrays_zip(rows.alias("row"), before.alias("before"), after.alias("after"))


def _length_problem(dates: Column, volumes: Column, ranks: Column) -> Column:
    sizes = [F.coalesce(F.size(a), F.lit(0)) for a in (dates, volumes, ranks)]
    return F.when((sizes[0] <= 0) | (sizes[1] <= 0) | (sizes[2] <= 0), "empty_array").when(
        (sizes[0] != sizes[1]) | (sizes[0] != sizes[2]), "length_mismatch"
    )


def normalize_entries(entries: DataFrame) -> DataFrame:
    """Landing check of vendor B histories, with removal of proven duplicates.

    Input columns: dates, volumes, ranks (arrays of text) and latest (struct of date, volume, rank or
    NULL). Identical repeats of a Sunday and a Saturday copy right before its Sunday are dropped and
    counted; anything else irregular gives an ``entry_error`` and rejects the entry.
    """
    d, v, r = F.col("dates"), F.col("volumes"), F.col("ranks")
    zipped = entries.withColumn("_length", _length_problem(d, v, r)).withColumn(
        "_rows", _parallel_rows(d, v, r, strict_date)
    )
    rows = F.col("_rows")

    def flag(near: Column) -> Column:
        x, before, after = near["row"], near["before"], near["after"]
        sunday = is_sunday(x["day"])
        copy = is_saturday(x["day"]) & (after["day"] == F.date_add(x["day"], 1)) & _same_observation(x, after)
        repeat = sunday & (before["day"] == x["day"])
        return F.struct(
            x["day"].alias("day"),
            x["volume"].alias("volume"),
            x["rank"].alias("rank"),
            F.coalesce(before["day"] <= x["day"], F.lit(True)).alias("ordered"),
            F.coalesce(~sunday & copy, F.lit(False)).alias("misaligned"),
            F.coalesce(repeat, F.lit(False)).alias("repeated"),
            F.when(~sunday & ~F.coalesce(copy, F.lit(False)), "non_sunday")
            .when(repeat & ~_same_observation(x, before), "conflicting_repeat")
            .alias("problem"),
        )

    flagged = zipped.withColumn("_flags", F.transform(_with_neighbours(rows), flag))
    flags = F.col("_flags")
    first_problem = F.get(F.filter(flags, lambda x: x["problem"].isNotNull()), F.lit(0))["problem"]
    kept = F.transform(
        F.filter(flags, lambda x: ~x["misaligned"] & ~x["repeated"]),
        lambda x: F.struct(x["day"].alias("day"), x["volume"].alias("volume"), x["rank"].alias("rank")),
    )
    structural = (
        F.when(F.col("_length").isNotNull(), F.col("_length"))
        .when(F.exists(rows, lambda x: x["day"].isNull()), "invalid_date")
        .when(F.exists(flags, lambda x: ~x["ordered"]), "not_ascending")
        .otherwise(first_problem)
    )
    cleaned = flagged.withColumn("_structural", structural).withColumn("history", kept)
    tail = F.try_element_at("history", F.lit(-1))
    tail_ok = (
        (tail["day"].cast("string") == F.col("latest.date"))
        & same_value(tail["volume"], F.col("latest.volume"))
        & same_value(tail["rank"], F.col("latest.rank"))
    )
    error = F.when(F.col("_structural").isNotNull(), F.col("_structural")).when(
        F.col("latest").isNotNull() & ~F.coalesce(tail_ok, F.lit(False)), "latest_mismatch"
    )
    return cleaned.withColumns(
        {
            "entry_error": error,
            "same_date_duplicates": F.size(F.filter(flags, lambda x: x["repeated"])),
            "misaligned_duplicates": F.size(F.filter(flags, lambda x: x["misaligned"])),
            "history": F.when(error.isNull(), F.col("history")),
        }
    ).drop("_length", "_rows", "_flags", "_structural")


def panel_entries(entries: DataFrame) -> DataFrame:
    """Panel-time check of vendor B histories (stricter: Sundays only) and move to Saturday week ends.

    Adds ``history`` (week_end, searches, rank) and ``entry_error``.
    """
    d, v, r = F.col("dates"), F.col("volumes"), F.col("ranks")
    zipped = entries.withColumn("_length", _length_problem(d, v, r)).withColumn(
        "_rows", _parallel_rows(d, v, r, lambda text: text.try_cast("date"))
    )
    rows = F.col("_rows")

    def flag(near: Column) -> Column:
        x, before = near["row"], near["before"]
        repeat = F.coalesce(before["day"] == x["day"], F.lit(False))
        return F.struct(
            x["day"].alias("day"),
            x["pos"].alias("pos"),
            x["volume"].alias("volume"),
            x["rank"].alias("rank"),
            repeat.alias("repeated"),
            (repeat & ~_same_observation(x, before)).alias("conflict"),
        )

    # Sorted by (day, position): repeats of a day are neighbours, its first delivery comes first.
    ordered = zipped.withColumn("_sorted", F.array_sort(rows))
    flagged = ordered.withColumn("_flags", F.transform(_with_neighbours(F.col("_sorted")), flag))
    flags = F.col("_flags")
    unique = F.filter(flags, lambda x: ~x["repeated"])
    places = F.transform(unique, lambda x: x["pos"])
    error = (
        F.when(F.col("_length").isNotNull(), F.col("_length"))
        .when(F.exists(rows, lambda x: ~F.coalesce(is_sunday(x["day"]), F.lit(False))), "non_sunday")
        .when(F.exists(flags, lambda x: x["conflict"]), "conflicting_repeat")
        .when(places != F.array_sort(places), "not_ascending")
    )
    history = F.transform(
        unique,
        lambda x: F.struct(
            F.date_add(x["day"], 6).alias("week_end"), x["volume"].alias("searches"), x["rank"].alias("rank")
        ),
    )
    return flagged.withColumn("entry_error", error).withColumn(
        "history", F.when(F.col("entry_error").isNull(), history)
    ).drop("_length", "_rows", "_sorted", "_flags")


def vendor_a_payload_error(body: Column) -> Column:
    """Landing check of a vendor A body (JSON text): first problem found, else NULL."""
    parsed = F.from_json(body, "code string, data array<map<string,string>>")
    data = parsed["data"]
    labels = F.transform(data, lambda x: F.try_element_at(x, F.lit("label")))
    return (
        F.when(parsed["code"].isNull() | (parsed["code"] != "OK"), "provider_failure")
        .when(F.coalesce(F.size(data), F.lit(0)) <= 0, "empty_history")
        .when(F.exists(labels, lambda x: ~F.coalesce(x.rlike(r"^\d{8}$"), F.lit(False))), "invalid_label")
        .when(
            F.exists(data, lambda x: ~F.map_contains_key(x, "searches") | ~F.map_contains_key(x, "rank")),
            "missing_measure",
        )
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "duplicate_label")
    )


def vendor_a_history(data: Column) -> Column:
    """Vendor A ``data`` (JSON text) as an array of (week_end, searches, rank)."""
    rows = F.from_json(data, "array<struct<label:string,searches:string,rank:string>>")
    return F.transform(
        rows,
        lambda x: F.struct(
            compact_date(x["label"]).alias("week_end"), x["searches"].alias("searches"), x["rank"].alias("rank")
        ),
    )


def history_problem(history: Column, as_of: Column) -> Column:
    """Why an Amazon history cannot enter the panel (whole ingredient), else NULL."""
    weeks = F.transform(history, lambda x: x["week_end"])
    return (
        F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, "no_rows")
        .when(F.exists(weeks, lambda w: w.isNull()), "bad_label")
        .when(F.size(F.array_distinct(weeks)) < F.size(weeks), "duplicate_weeks")
        .when(F.exists(weeks, lambda w: ~is_saturday(w)), "non_saturday")
        .when(~F.exists(weeks, lambda w: w < as_of), "no_completed_weeks")
    )


def keyword_set_error(requested: Column, returned: Column) -> Column:
    """Returned keywords must be unique and equal the requested set, ignoring case."""
    asked = F.array_distinct(F.transform(requested, F.lower))
    got = F.transform(returned, lambda k: F.lower(F.coalesce(k, F.lit(""))))
    return (
        F.when(F.coalesce(F.size(returned), F.lit(0)) <= 0, "no_histories")
        .when(F.size(F.array_distinct(got)) < F.size(got), "duplicate_keyword")
        .when(
            (F.size(F.array_except(asked, got)) > 0) | (F.size(F.array_except(got, asked)) > 0), "keyword_set_mismatch"
        )
    )

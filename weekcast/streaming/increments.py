"""A panel kept up to date as vendor files land, by its changed weeks only.

The state of an ingredient is its best file so far and that file's weeks. A better file, by snapshot, place and path as
in the batch run, changes weeks; only those come out. Files may land in any order and repeatedly: the weeks that are
valid last are those of the file that a batch run over all files picks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weekcast.operators.histories import history_problem
from weekcast.sources.landing import batch_entries, keyword_records

CHANGES = "ingredient_id string, change long, week_end date, searches string, rank string, gone boolean, snapshot date, path string"
STATE = "changes long, snapshot string, nearness int, path string, weeks string"


def _changes(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    changes, *held, known = state.get if state.exists else (0, "", 0, "", "{}")
    best, weeks = tuple(held), known
    for part in parts:
        for file in part.itertuples():
            here = (str(file.snapshot), -int(file.priority), file.path)
            if here > best:
                best, weeks = here, file.weeks
    before, after = json.loads(known), json.loads(weeks)
    moved = [(w, after.get(w)) for w in sorted({*before, *after}) if before.get(w) != after.get(w)]
    if moved:
        changes += 1
        day = lambda text: pd.Timestamp(text).date()
        rows = [(key[0], changes, day(w), *(v or (None, None)), v is None, day(best[0]), best[2]) for w, v in moved]
        yield pd.DataFrame(rows, columns=["ingredient_id", "change", "week_end", "searches", "rank", "gone", "snapshot", "path"])
    state.update((changes, *best, weeks))


def panel_changes(found: DataFrame, as_of: Column) -> DataFrame:
    """Changed weeks from a stream of checked envelopes (``envelopes.candidates``).

    A history that can't enter a panel has no weeks, as in the batch run: it takes back those of the file before.
    """
    week = lambda x: F.struct(x["week_end"].cast("string"), F.array(x["searches"], x["rank"]))
    weeks = F.when(history_problem(F.col("history"), as_of).isNotNull(), F.lit("{}")).otherwise(
        F.to_json(F.map_from_entries(F.transform("history", week)), {"ignoreNullFields": "false"})
    )
    usable = found.filter(F.col("error").isNull() & (F.col("snapshot") <= as_of)).select("ingredient_id", "snapshot", "priority", "path", weeks.alias("weeks"))
    return usable.groupBy("ingredient_id").applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def current_weeks(changes: DataFrame) -> DataFrame:
    """Weekly rows (ingredient_id, week_end, searches, rank) that are valid after all ``changes``."""
    last = F.max_by(F.struct("searches", "rank", "gone"), "change").alias("_last")
    return changes.groupBy("ingredient_id", "week_end").agg(last).select("ingredient_id", "week_end", "_last.*").filter("not gone").drop("gone")


def batch_sink(items: DataFrame, accepted_path: str, quarantine_path: str):
    """foreachBatch function for vendor B batches: records per keyword of good ones, bad ones whole with their error."""

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = batch_entries(batch)
        records = keyword_records(entries, items)
        bad = entries.groupBy("batch_id").agg(F.max("batch_error").alias("batch_error")).filter("batch_error is not null")
        for rows, path in ((records, accepted_path), (batch.join(bad, "batch_id"), quarantine_path)):
            rows.withColumn("trigger", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trigger").parquet(path)

    return write

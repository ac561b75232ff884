"""Filters over whole rows by a test of their text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def free_token_memory() -> None:
    """Let go of the chunks that a tokenizing task has left in this Python worker, for workers serve many stages."""
    if tokens := sys.modules.get("weekcast.llm.tokens"):
        tokens.forget()


def keep_rows(docs: DataFrame, make_test: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs`` whose ``text`` passes; all columns stay. The test is made once in each task. No shuffle."""
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_token_memory()
        passes = make_test()
        for batch in batches:
            yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)

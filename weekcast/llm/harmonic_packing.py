"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces of which exactly k fit, and each of its
bins takes k of them (Lee and Lee, "A simple on-line bin-packing algorithm", 1985). Since documents may be
cut, they are cut to fit the classes: into whole capacities, then into the powers of two from half the
capacity down to ``SMALLEST``, and a tail below that. Every class then holds pieces of one length, so a
piece's bin and place follow from its running number in the class alone. Tasks number their pieces
independently; only counts per task and class meet. What doesn't fill a bin (fewer than k pieces of a class)
is laid end to end, largest first, so padding is left in those few last sequences only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from weekcast.llm.tokens import KEEP, codes_for
from weekcast.session import stage

CAPACITY = 4096
SMALLEST = 64
PIECES = "part int, doc_id long, start long, length int, doc_tokens long, number long, ids binary"
RUNS = "length int, first_number long, end_number long, per_sequence long, first_sequence long, first_offset int"


def cut(n_tokens: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of a document's pieces, in order."""
    pieces, rest = [capacity] * (n_tokens // capacity), n_tokens % capacity
    size = capacity // 2
    while size >= smallest:
        if rest >= size:
            pieces.append(size)
            rest -= size
        size //= 2
    return pieces + [rest] * (rest > 0)


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int, smallest: int, keep: int, names_as_text: bool) -> Iterator[pa.RecordBatch]:
    codes, end = codes_for(tokenizer, keep, names_as_text), int(end_id).to_bytes(4, "little")
    part, numbers = TaskContext.get().partitionId(), Counter()
    schema = pa.schema(
        [("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("number", pa.int64()), ("ids", pa.binary())]
    )
    rows, held = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            code = codes.encode(text.as_py()) + end
            start = 0
            for length in cut(len(code) // 4, capacity, smallest):
                rows.append((part, doc_id, start, length, len(code) // 4, numbers[length], code[4 * start : 4 * (start + length)]))
                numbers[length] += 1
                start += length
            held += len(code)
            if held > 1 << 21:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def lay_out(totals: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of numbers per class, as in ``RUNS``: full bins first, then the rests end to end.

    ``totals`` has a count for each length, so both the input and the result are bounded by the capacity.
    """
    runs, sequence = [], 0
    for length, total in sorted(totals.items(), reverse=True):
        fit = capacity // length
        if bins := total // fit:
            runs.append((length, 0, bins * fit, fit, sequence, 0))
            sequence += bins
    place = 0
    for length, total in sorted(totals.items(), reverse=True):
        number = total // (capacity // length) * (capacity // length)
        while number < total:
            if place + length > capacity:
                sequence, place = sequence + 1, 0
            count = min(total - number, (capacity - place) // length)
            runs.append((length, number, number + count, count, sequence, place))
            number, place = number + count, place + count * length
    return runs


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, smallest: int = SMALLEST, keep: int = KEEP, names_as_text: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``start`` is the document's ids before the piece, ``ids`` little-endian unsigned 32-bit integers. A null
    text is an empty one and gives the end id alone; a repeated row is a document of its own; of other columns
    none is read. An empty table gives no pieces. ``keep`` bounds the memory of chunks in each Python worker.
    Names of special tokens in a text are these tokens, or with ``names_as_text`` ordinary text. Sequences are numbered from 0 and filled without gaps.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = stage(rows.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, capacity, smallest, keep, names_as_text), PIECES), "pieces")
    # A row per task and class: classes are fixed, tasks are splits of the input.
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")), "piece-offsets")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(lay_out(totals, capacity), RUNS)
    # At most two runs per class and one per rest sequence: bounded by the capacity.
    by_length = F.broadcast(
        runs.groupBy("length").agg(F.collect_list(F.struct("first_number", "end_number", "per_sequence", "first_sequence", "first_offset")).alias("_runs"))
    )
    number = F.col("number") + F.col("_before")
    run = F.filter("_runs", lambda r: (number >= r.first_number) & (number < r.end_number))[0]
    inside = F.col("_number") - F.col("_run.first_number")
    return (
        pieces.join(offsets, ["part", "length"])
        .join(by_length, "length")
        .select("doc_id", "start", "length", "doc_tokens", "ids", number.alias("_number"), run.alias("_run"))
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "doc_tokens",
            (F.col("_run.first_sequence") + F.floor(inside / F.col("_run.per_sequence"))).alias("sequence_id"),
            (F.col("_run.first_offset") + inside % F.col("_run.per_sequence") * F.col("length")).cast("long").alias("offset"),
            "ids",
        )
    )

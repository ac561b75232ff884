"""Token ids of documents in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a bitmap beside it
marks the ids that go on; level 1 holds the next chunk of those ids only, and so on. The place of an id's
next chunk is the number of marks before it, which a rank directory (one count per 512 bits) gives with a
look at eight words at most. Any token is read by touching one byte per level; nothing is decoded around it
(Brisaboa, Ladra and Navarro, "DACs: Bringing direct access to variable-length codes", 2013).

Documents lie in ascending order of doc_id, equal doc_ids in the order of their texts (nulls first); a null
text is an empty one. Files are segments of whole documents, about ``SEGMENT_TOKENS`` tokens each:

    magic "DAC1" | documents, tokens, levels (uint64) | doc_id int64[documents] | doc_id is null uint8[documents]
    | first token uint64[documents + 1] | per level: entries (uint64), chunks uint8[entries],
    bitmap uint64[ceil(entries / 64)], ranks uint32[ceil(entries / 512) + 1]

They are rows of an uncompressed Parquet table, so Spark's writer commits them whole or not at all, on any
store, and a task that is run again leaves no second copy. A directory with one row per part gives each
part's first token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weekcast.llm.tokens import codes_for

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1 << 18
BLOCK = 512
#: Chunks of text remembered in a Python worker, which does nothing else here.
KEEP = 800_000
SEGMENTS = "part int, number int, tokens_before long, n_docs long, n_tokens long, segment binary"
DIRECTORY = "part int, first_token long, n_tokens long"


def pack_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment of the documents' ids (little-endian unsigned 32-bit integers)."""
    values = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype="<u8")
    levels = []
    while True:
        more = values > 255
        bits = np.zeros(-(-len(values) // 64) * 8, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype="<u4") if len(more) else np.zeros(0, "<u4")
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        levels.append(
            [np.uint64(len(values)).tobytes(), values.astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        )
        if not more.any():
            break
        values = values[more] >> np.uint32(8)
    head = np.array([len(doc_ids), ends[-1], len(levels)], "<u8").tobytes()
    named = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    null = np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, named, null, ends.tobytes(), *[x for level in levels for x in level]])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        self.blob, self.at = blob, 4
        docs, self.n_tokens, levels = map(int, self._take("<u8", 3))
        ids, null = self._take("<i8", docs), self._take(np.uint8, docs)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, null, strict=True)]
        self.ends = self._take("<u8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append(
                (self._take(np.uint8, n), self._take("<u8", -(-n // 64)), self._take("<u4", -(-n // BLOCK) + 1))
            )

    def _take(self, kind, count: int) -> np.ndarray:
        found = np.frombuffer(self.blob, kind, count, self.at)
        self.at += found.nbytes
        return found

    def token(self, place: int) -> int:
        """The id at a place, from one byte per level."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for depth, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[place]) << (8 * depth)
            word, bit = divmod(place, 64)
            if not int(words[word]) >> bit & 1:
                break
            first = place // BLOCK * (BLOCK // 64)
            before = sum(int(w).bit_count() for w in words[first:word])
            place = int(ranks[place // BLOCK]) + before + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def all_tokens(self) -> np.ndarray:
        """Every id of the segment, level by level."""
        below = np.zeros(0, "<u4")
        for chunks, words, _ in reversed(self.levels):
            values = chunks.astype("<u4")
            if len(below):
                more = np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
                values[more] |= below << np.uint32(8)
            below = values
        return below


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, names_as_text: bool) -> Iterator[pa.RecordBatch]:
    codes, end = codes_for(tokenizer, KEEP, names_as_text), int(end_id).to_bytes(4, "little")
    part, number, before = TaskContext.get().partitionId(), 0, 0
    doc_ids, ids, size = [], [], 0

    def closed() -> pa.RecordBatch:
        row = (part, number, before, len(doc_ids), size, pack_segment(doc_ids, ids))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["part", "number", "tokens_before", "n_docs", "n_tokens", "segment"]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            code = codes.encode(text.as_py()) + end
            doc_ids.append(doc_id)
            ids.append(code)
            size += len(code) // 4
            if size >= SEGMENT_TOKENS:
                yield closed()
                number, before = number + 1, before + size
                doc_ids, ids, size = [], [], 0
    if doc_ids:
        yield closed()


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int, names_as_text: bool = False) -> None:
    """Encode doc_id and text of ``docs`` and write segments and directory below ``path``.

    Only doc_id and text are read, so further columns, whatever their names, don't matter. Hot doc_ids are
    spread by their texts. An empty table gives no segment and an empty directory. Names of special tokens in a text
    are these tokens, or with ``names_as_text`` ordinary text.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id", F.substring("text", 1, 64))
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(lambda rows: _segments(rows, tokenizer, end_id, names_as_text), SEGMENTS).write.option(
        "compression", "none"
    ).parquet(f"{path}/segments")
    segments = docs.sparkSession.read.schema(SEGMENTS).parquet(f"{path}/segments")
    # One row per part, and there are no more parts than shuffle partitions: one task can number them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    sizes.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first_token"), "n_tokens").write.parquet(
        f"{path}/directory"
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the global place of their first token: part, number, first_token, n_docs, n_tokens, segment."""
    directory = spark.read.schema(DIRECTORY).parquet(f"{path}/directory").select("part", F.col("first_token").alias("_first"))
    return (
        spark.read.schema(SEGMENTS)
        .parquet(f"{path}/segments")
        .join(directory, "part")
        .select("part", "number", (F.col("_first") + F.col("tokens_before")).alias("first_token"), "n_docs", "n_tokens", "segment")
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = Segment(blob.as_py())
            tokens, ends = held.all_tokens(), held.ends.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(held.doc_ids, pa.int64()),
                    pa.array(first + ends[:-1]),
                    pa.array(np.diff(ends)),
                    pa.Array.from_buffers(
                        pa.binary(), len(held.doc_ids), [None, pa.py_buffer((ends * 4).astype("<i4")), pa.py_buffer(tokens)]
                    ),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    rows = read_segments(spark, path).select("first_token", "segment")
    return rows.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def _lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, blobs, places = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
        for start, blob, wanted in zip(first, blobs, places, strict=True):
            held = Segment(blob.as_py())
            found = [held.token(p - start) for p in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(found, pa.int64())], ["place", "id"])


def look_up(spark: SparkSession, path: str, places: DataFrame, per_call: int = 10_000) -> DataFrame:
    """(place, id) for the global places in column ``place``; places outside the corpus are left out.

    Places go to their segment by a join on blocks of ``SEGMENT_TOKENS`` places, at most ``per_call`` to a
    row, so a much-asked segment is served by many tasks.
    """
    segments = read_segments(spark, path)
    block = lambda c: F.floor(c / SEGMENT_TOKENS)
    spans = segments.select("first_token", "n_tokens").withColumn(
        "block", F.explode(F.sequence(block(F.col("first_token")), block(F.col("first_token") + F.col("n_tokens") - 1)))
    )
    wanted = places.select(F.col("place").cast("long").alias("place")).distinct().withColumn("block", block(F.col("place")))
    placed = wanted.join(spans, "block").filter("place >= first_token and place < first_token + n_tokens")
    calls = placed.groupBy("first_token", F.pmod(F.xxhash64("place"), F.greatest(F.lit(1), F.floor(F.col("n_tokens") / per_call))).alias("call")).agg(
        F.collect_list("place").alias("places")
    )
    rows = calls.join(segments.select("first_token", "segment"), "first_token").select("first_token", "segment", "places")
    return rows.mapInArrow(_lookups, "place long, id long")

"""Benchmark decontamination by greedy string tiling.

A running Karp-Rabin hash over each document's words finds the grams of ``GRAM`` words it shares with
benchmark items; these seeds are grown to maximal matches. Per item the longest match is marked again and
again, as long as one of ``GRAM`` unmarked words is left on both sides (Wise, "Running Karp-Rabin matching and
greedy string tiling", 1993). Tiles don't overlap and may lie in any order, so a passage that was taken apart
and put together in another order is covered too. A document is contaminated if tiles cover at least
``LEAST`` of an item's words.

Words are runs of letters, digits and underscores, in lower case. The benchmark is sent to the tasks in parts
of at most ``PART_GRAMS`` grams, each read against all documents; there is no shuffle.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weekcast.llm.rows import keep_rows
from weekcast.session import stage

WORD = re.compile(r"\w+")
GRAM = 5
LEAST = 0.6
PART_GRAMS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, coverage double, n_tiles int, tile_words int, first_word long, last_word long"


@dataclass(frozen=True)
class Index:
    """Words of a part of the benchmark, numbered from 1; its grams in order of their hash, with item and place."""

    numbers: dict[str, int]
    items: list[np.ndarray]
    item_ids: list[int | None]
    grams: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def rolled(numbers: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all grams of a sequence, each number times a power of the base, modulo 2**64."""
    count = len(numbers) - GRAM + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    values, total = numbers.astype(np.uint64), np.zeros(count, np.uint64)
    for k in range(GRAM):
        total = total * BASE + values[k : k + count]
    return total


def index_items(items: list[tuple[int | None, str]]) -> Index:
    numbers: dict[str, int] = {}
    spelled = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in WORD.findall(t.lower())], np.int64) for _, t in items]
    hashes = [rolled(x) for x in spelled]
    grams = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes]).astype(np.int64)
    place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)]).astype(np.int64)
    order = np.argsort(grams, kind="stable")
    return Index(numbers, spelled, [i for i, _ in items], grams[order], owner[order], place[order])


def tile(document: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Tiles (place in the document, place in the item, words), longest first, from seeds (place, place).

    Ties go to the earlier place in the document, then in the item.
    """
    ready, seen = [], set()
    for p, q in sorted(seeds):
        if (p - 1, q - 1) in seen or (document[p : p + GRAM] == item[q : q + GRAM]).all():
            seen.add((p, q))
            if (p - 1, q - 1) not in seen:
                most = min(len(document) - p, len(item) - q)
                differ = np.flatnonzero(document[p : p + most] != item[q : q + most])
                heapq.heappush(ready, (-int(differ[0] if len(differ) else most), p, q))
    mine, theirs, tiles = set(), np.zeros(len(item), bool), []
    while ready:
        size, p, q = heapq.heappop(ready)
        free = np.array([p + k not in mine and not theirs[q + k] for k in range(-size)])
        if free.all():
            tiles.append((p, q, -size))
            mine.update(range(p, p - size))
            theirs[q : q - size] = True
            continue
        # Part of the match is marked already: what is left of it counts for itself.
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= GRAM:
                heapq.heappush(ready, (a - b, p + a, q + a))
    return tiles


def matches(text: str | None, index: Index, least: float) -> Iterator[tuple]:
    """(item, coverage, tiles, words in them, first and last word in the document) of items covered enough."""
    if not text or not len(index.grams):
        return
    words = WORD.findall(text.lower())
    numbers = np.fromiter(map(index.numbers.get, words, (0 for _ in words)), np.int64, len(words))
    if len(numbers) < GRAM:
        return
    gaps = np.concatenate([[0], np.cumsum(numbers == 0)])
    places = np.flatnonzero(gaps[GRAM:] == gaps[:-GRAM])  # grams of known words only
    if not len(places):
        return
    hashes = rolled(numbers)[places]
    first = np.searchsorted(index.grams, hashes)
    hit = index.grams[np.minimum(first, len(index.grams) - 1)] == hashes
    seeds = defaultdict(list)
    last = np.searchsorted(index.grams, hashes[hit], side="right")
    for p, a, b in zip(places[hit].tolist(), first[hit].tolist(), last.tolist(), strict=True):
        for k in range(a, b):
            seeds[int(index.owner[k])].append((p, int(index.place[k])))
    for owner, found in seeds.items():
        item = index.items[owner]
        tiles = tile(numbers, item, found)
        covered = sum(n for _, _, n in tiles)
        if covered and covered >= least * len(item):
            yield index.item_ids[owner], covered / len(item), len(tiles), covered, min(p for p, _, _ in tiles), max(p + n - 1 for p, _, n in tiles)


def _matches(batches: Iterator[pa.RecordBatch], index: Index, least: float) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = ["doc_id", "item_id", "coverage", "n_tiles", "tile_words", "first_word", "last_word"]
    for batch in batches:
        rows = [
            (doc_id, *found)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for found in matches(text.as_py(), index, least)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _parts(benchmark: DataFrame, part_grams: int) -> Iterator[Index]:
    """The benchmark's items (item_id, text) in parts of at most about ``part_grams`` grams, at least one part."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    part, size = [], 0
    for item in items.filter("text is not null").distinct().toLocalIterator():
        words = len(WORD.findall(item.text))
        if words < GRAM:
            continue
        if part and size + words > part_grams:
            yield index_items(part)
            part, size = [], 0
        part.append((item.item_id, item.text))
        size += words
    yield index_items(part)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, part_grams: int = PART_GRAMS) -> DataFrame:
    """Documents (doc_id, text) with the items (item_id, text) whose words their tiles cover by at least ``least``.

    One row per document row and item: doc_id, item_id, coverage, n_tiles, tile_words, first_word, last_word (word
    places in the document). Null and empty texts match nothing, and neither do items of fewer than ``GRAM`` words. A
    repeated item counts once; repeated documents give a row each. Other columns aren't read; an empty table on
    either side gives an empty result. Results of a part are written before the next part is read, so the driver
    never holds more than one part.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, held = [], None
    for index in _parts(benchmark, part_grams):
        if held is not None:
            found.append(stage(held, "tiles"))
        held = rows.mapInArrow(lambda b, index=index: _matches(b, index, least), FOUND)
    for other in found:
        held = held.unionByName(other)
    return held


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, part_grams: int = PART_GRAMS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; each part of the benchmark is one pass."""
    held = None
    for index in _parts(benchmark, part_grams):
        docs = docs if held is None else stage(held, "clean")
        held = keep_rows(docs, lambda index=index: lambda text: next(matches(text, index, least), None) is None)
    return held

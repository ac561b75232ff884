"""Passages that a corpus repeats, word for word, by compressed full-text indexes of shards.

A window is ``WINDOW`` consecutive words of one document; each word that a window covers goes if the window's words
also start anywhere else. Every window is filed under its least ``SEED``-word gram by hash, the last one of equals,
so equal windows are filed alike. Consecutive windows with the same gram make a fragment, in which no window comes
twice; fragments whose gram is nowhere else hold no repeat and are dropped before any text moves. Equal fragments
are one, with a weight. A shard takes whole groups of fragments of the same gram, builds an FM-index of them and
streams them against it: matching statistics by backward search over the wavelet matrix say how many words from
each place on are found at least twice, and where that is ``WINDOW`` or more the window is a repeat. So no shard
needs to see what another holds, and their size does not grow with the corpus. A gram with very many
different fragments is split: its windows are filed by all their words instead, and equal ones are one again.

Gram and words of a fragment are known by 64-bit hashes each, texts by doc_id and a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from weekcast.llm.byte_words import Rolling, Words, joined, mixed, portions
from weekcast.llm.fm_index import FmIndex
from weekcast.llm.rows import free_token_memory
from weekcast.llm.texts import text_rows, with_texts
from weekcast.operators.scale import spread_join
from weekcast.session import stage

WINDOW = 35
SEED = 8
BLANKS = b" \t\n\x0b\x0c\r"
#: Words in a shard's index; a shard goes on until its last gram's fragments are all there.
SHARD_WORDS = 1 << 18
#: A gram with more different fragments than this is split.
MOST_FRAGMENTS = 1 << 12
FRAGMENTS = "doc_id long, version long, seed long, digest long, start long, n int"
PIECES = "route long, piece long, weight long, n int, words binary"


def least_grams(grams: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each ``wide`` consecutive values, and its place, the last of equals."""
    values, places, have = grams, np.arange(len(grams)), 1
    while have < wide:
        step = min(have, wide - have)
        left, right = values[: len(values) - step], values[step:]
        later = right <= left
        values, places = np.where(later, right, left), np.where(later, places[step:], places[: len(places) - step])
        have += step
    return values, places


class Cutter:
    """Fragments of the windows of several texts at once."""

    def __init__(self, window: int, seed: int):
        self.window, self.seed = window, seed
        self.words, self.grams, self.stretches = Words(BLANKS, seed=11), Rolling(13), Rolling(17)

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Text number, gram hash, hash of the words, first word and number of windows of each fragment."""
        data, text_ends = joined(texts)
        starts, ends = self.words.split(data)
        hashes = self.words.hashes(data, starts, ends)
        owner = np.searchsorted(text_ends, starts, side="right")
        first_word = np.searchsorted(starts, np.concatenate([[0], text_ends[:-1]]))
        if len(starts) < self.window:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        places = np.arange(len(hashes) - self.seed + 1)
        grams = self.grams.stretches(hashes, places, places + self.seed)
        least, where = least_grams(grams, self.window - self.seed + 1)
        whole = owner[: len(least)] == owner[self.window - 1 :]
        turn = np.ones(len(least), bool)
        turn[1:] = (where[1:] != where[:-1]) | ~whole[:-1]
        begin = np.flatnonzero(turn & whole)
        stop = np.flatnonzero(turn | ~whole)
        after = np.searchsorted(stop, begin, side="right")
        finish = np.where(after < len(stop), np.append(stop, 0)[after], len(least))
        digests = self.stretches.stretches(hashes, begin, finish + self.window - 1)
        n = finish - begin
        return owner[begin], least[begin], mixed(digests + n.astype(np.uint64)), begin - first_word[owner[begin]], n


def fragments(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Fragments of all windows of ``docs``: doc_id, version, seed (gram), digest (words), start (first word), n (windows)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_token_memory()
        cutter = Cutter(window, seed)
        for rows, texts in portions(batches, 2):
            owner, gram, digest, start, n = cutter.cut(texts)
            taken = rows.select(["doc_id", "version"]).take(pa.array(owner))
            numbers = [pa.array(gram.astype(np.uint64).view(np.int64)), pa.array(digest.astype(np.uint64).view(np.int64)), pa.array(start, pa.int64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *numbers], ["doc_id", "version", "seed", "digest", "start", "n"])

    return text_rows(docs).mapInArrow(cut, FRAGMENTS)


def _extracted(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of fragments, from one document each; split ones as their single windows.

    ``wanted``: doc_id, version, seed, digest, start, n, weight, split. Output: seed, digest, shift (of the piece in
    its fragment), route, piece, weight, n, words.
    """
    places = F.collect_set(F.struct("start", "n", "seed", "digest", "weight", "split")).alias("places")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, cutter = zstandard.ZstdDecompressor(), Words(BLANKS, seed=19)
        stretch = Rolling(23)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["seed", "digest", "shift", "route", "piece", "weight", "n", "words"]
        for batch in batches:
            for packed, listed in zip(batch.column(1), batch.column(2), strict=True):
                text, rows = press.decompress(packed.as_py()), []
                data = np.frombuffer(text, np.uint8)
                starts, ends = cutter.split(data)
                hashes = None
                for p in listed.as_py():
                    first, n = p["start"], p["n"]
                    if not p["split"]:
                        rows.append((p["seed"], p["digest"], 0, p["seed"], p["digest"], p["weight"], n, text[starts[first] : ends[first + n + window - 2]]))
                        continue
                    hashes = cutter.hashes(data, starts, ends) if hashes is None else hashes
                    begins = np.arange(first, first + n)
                    codes = stretch.stretches(hashes, begins, begins + window).view(np.int64).tolist()
                    for k, code in enumerate(codes):
                        rows.append((p["seed"], p["digest"], k, code, code, p["weight"], 1, text[starts[first + k] : ends[first + k + window - 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    by_document = wanted.groupBy("doc_id", "version").agg(places)
    return with_texts(docs, by_document, "inner").mapInArrow(
        extract, "seed long, digest long, shift int, route long, piece long, weight long, n int, words binary"
    )


def _searched(batches: Iterator[pa.RecordBatch], window: int, shard_words: int) -> Iterator[pa.RecordBatch]:
    """Rows as in ``PIECES``, in order of route and piece, shard by shard; each piece's repeated windows as bits."""
    held, size, last = [], 0, None

    def shard() -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        words = [w for *_, text in held for w in (*text.split(), None)]
        ids = np.fromiter((0 if w is None else numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))
        longest = FmIndex(ids, np.array([h[2] for h in held])).matching_statistics(2)
        found = np.flatnonzero(longest >= window)
        stops = np.flatnonzero(ids == 0)
        owner = np.searchsorted(stops, found)
        begin = np.concatenate([[0], stops[:-1] + 1])
        mask = np.zeros(len(held), np.int64)
        np.bitwise_or.at(mask, owner, np.int64(1) << (found - begin[owner]))
        some = np.flatnonzero(mask)
        columns = [pa.array([held[k][0] for k in some], pa.int64()), pa.array([held[k][1] for k in some], pa.int64()), pa.array(mask[some])]
        return pa.RecordBatch.from_arrays(columns, ["route", "piece", "mask"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last == row[:2]:  # a repeated row's document gives the same piece again
                continue
            if size >= shard_words and row[0] != last[0]:
                yield shard()
                held, size = [], 0
            held.append((row[0], row[1], row[2], row[4]))
            size += row[3] + window
            last = row[:2]
    if held:
        yield shard()


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, shard_words: int = SHARD_WORDS, most_fragments: int = MOST_FRAGMENTS) -> DataFrame:
    """doc_id, version, places (set of start and mask): windows of ``docs`` that start anywhere else too.

    Bit k of a mask stands for the window that begins at word ``start`` + k. Documents without any have no row.
    """
    cut = stage(fragments(docs, window, seed), "fragments")
    seeds = stage(cut.groupBy("seed").agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated-seeds")
    occurring = stage(spread_join(cut, seeds, ["seed"], "inner", seeds, cut.count()).drop("_n"), "occurring")
    same = occurring.groupBy("seed", "digest").agg(F.count("*").alias("weight"), *[F.first(c).alias(c) for c in ("doc_id", "version", "start", "n")])
    same = stage(same, "fragment-groups")
    many = same.groupBy("seed").agg(F.count("*").alias("_kinds")).filter(F.col("_kinds") > most_fragments).select("seed", F.lit(True).alias("split"))
    pieces = stage(_extracted(docs, same.join(many, "seed", "left").fillna(False, ["split"]), window), "pieces")
    split = F.col("route") != F.col("seed")
    # Equal windows of split fragments are one; each fragment comes once, whatever row its text was read from.
    alone = pieces.filter(split).dropDuplicates(["seed", "digest", "shift"])
    alone = alone.groupBy("route", "piece").agg(F.sum("weight").alias("weight"), F.first("n").alias("n"), F.first("words").alias("words"))
    ready = pieces.filter(~split).select("route", "piece", "weight", "n", "words").unionByName(alone.select("route", "piece", "weight", "n", "words"))
    ordered = ready.repartition("route").sortWithinPartitions("route", "piece")
    masks = stage(ordered.mapInArrow(lambda b: _searched(b, window, shard_words), "route long, piece long, mask long"), "piece-masks")
    whole = pieces.filter(~split).select("route", "piece", "seed", "digest").join(masks, ["route", "piece"]).select("seed", "digest", "mask")
    members = pieces.filter(split).select("route", "piece", "seed", "digest", "shift")
    sizes = members.groupBy("route", "piece").agg(F.count("*").alias("_n"))
    parts = spread_join(members, masks, ["route", "piece"], "inner", sizes).select("seed", "digest", F.expr("shiftleft(mask, shift)").alias("mask"))
    by_fragment = stage(whole.unionByName(parts).groupBy("seed", "digest").agg(F.bit_or("mask").alias("mask")), "fragment-masks")
    weights = same.select("seed", "digest", F.col("weight").alias("_n"))
    marked = spread_join(occurring, by_fragment, ["seed", "digest"], "inner", weights)
    return marked.groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "mask")).alias("places"))


def _kept(text: bytes, places: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, of words removed, and the kept words, one blank between."""
    words = text.split()
    if not places:
        return len(words), 0, b" ".join(words)
    covered = np.zeros(len(words) + 1, np.int64)
    for p in places:
        begins = np.flatnonzero(np.unpackbits(np.array([p["mask"]], "<i8").view(np.uint8), bitorder="little")) + p["start"]
        covered[begins] += 1
        covered[begins + window] -= 1
    stay = np.cumsum(covered)[:-1] == 0
    return len(words), int(len(words) - stay.sum()), b" ".join([words[k] for k in np.flatnonzero(stay)])


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, shard_words: int = SHARD_WORDS, most_fragments: int = MOST_FRAGMENTS) -> DataFrame:
    """What is left of each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (words, one blank between).

    Windows are judged on the input. All rows stay: a null text has no words, a shorter one than a window loses
    none, and repeated rows lose all that a window covers. Further columns aren't read; an empty table gives none.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [_kept(press.decompress(p.as_py()), s.as_py(), window) for p, s in zip(batch.column(1), batch.column(2), strict=True)]
            n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    found = repeats(docs, window, seed, shard_words, most_fragments)
    return with_texts(docs, found, "left").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")

"""Collocations: phrases that are found far more often than their parts would meet by chance.

Texts are parsed prefix-free (Boucher et al., "Prefix-free parsing for building big BWTs", 2019): wherever the hash
of ``OVERLAP`` consecutive words is a multiple of ``SPACING``, one chunk ends with these words and the next begins
with them, so texts that repeat each other are cut alike and the dictionary of distinct chunks, each with the number
of its places in the parse, is smaller than the texts. All counting is done inside distinct chunks, weighted.
A phrase that begins in the last ``OVERLAP`` words of a chunk belongs to the next chunk, which holds it whole.

Phrases are counted length by length. A phrase can only be frequent if what is left without its first, and without
its last, word is; the frequent ones of each length are marked in a bitmap of fixed size by hash, and only phrases
whose parts are both marked are counted by hash on the next length. Marks that coincide cost work and change no
result, for counts go by the whole hash of 64 bits; two phrases with the same hash would count as one. With its count
each phrase gets a place, the least number of a chunk that owns it. A last pass moves only chunks with such a number
and reads each frequent phrase's words from there, so it makes a row for each, however many tasks the phrase is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.llm.byte_words import Rolling, Words, joined, mixed, portions
from weekcast.llm.rows import free_token_memory
from weekcast.session import stage

BLANKS = b" \t"
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
LEAST_COUNT = 100
#: A longer phrase hides a part of it from this percentage of the part's count on.
HIDING = 100
PER_LANG = 2000
OVERLAP = LONGEST - 1
SPACING = 40
#: Bits of a bitmap of frequent phrases: 8 MB, whatever the input.
MARK_BITS = 1 << 26
BUCKET = 1 << 15
#: Phrases held in a task before equal ones are added up.
HELD = 1 << 21
#: Chunks are numbered with so many bits; chunks of one number are read together.
PLACE_BITS = 24


def _bounds(hashes: np.ndarray, owner: np.ndarray, overlap: int, spacing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and owned words of each chunk, for words of several texts."""
    n = len(hashes)
    text_start = np.flatnonzero(np.diff(owner, prepend=-1))
    text_end = np.append(text_start[1:], n)
    windows = np.arange(max(0, n - overlap + 1))
    trigger = Rolling(29).stretches(hashes, windows, windows + overlap) % np.uint64(spacing) == 0
    begins = np.flatnonzero(trigger & (owner[: len(windows)] == owner[overlap - 1 :]) if len(windows) else trigger)
    first = np.union1d(text_start, begins)
    end_of_text = text_end[np.searchsorted(text_start, first, side="right") - 1]
    following = np.append(first[1:], n)
    last = following >= end_of_text
    return first, np.where(last, end_of_text, following + overlap), np.where(last, end_of_text, following) - first


def _parsed(batches: Iterator[pa.RecordBatch], overlap: int, spacing: int) -> Iterator[pa.RecordBatch]:
    free_token_memory()
    words = Words(BLANKS, BREAKS, seed=31)
    for rows, texts in portions(batches, 1):
        texts = [t.lower() for t in texts]
        data, text_ends = joined(texts)
        starts, ends = words.split(data)
        if not len(starts):
            continue
        owner = np.searchsorted(text_ends, starts, side="right")
        first, after, owned = _bounds(words.hashes(data, starts, ends), owner, overlap, spacing)
        whole = data.tobytes()
        chunks = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[after - 1].tolist(), strict=True)]
        langs = rows.column(0).take(pa.array(owner[first]))
        yield pa.RecordBatch.from_arrays([langs, pa.array(chunks, pa.binary()), pa.array(owned, pa.int32())], ["lang", "chunk", "owned"])


def chunks(docs: DataFrame, overlap: int = OVERLAP, spacing: int = SPACING) -> DataFrame:
    """Dictionary of distinct chunks of ``docs`` (lang, text): lang, chunk (bytes), owned (words), places."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    parsed = rows.mapInArrow(lambda b: _parsed(b, overlap, spacing), "lang string, chunk binary, owned int")
    return parsed.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("places"))


class Phrases:
    """Hashes of all phrases of the chunks in a batch, by their first word."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0).to_pylist()
        data, ends = joined(batch.column(1).to_pylist())
        self.words = Words(BLANKS, BREAKS, seed=31)
        self.data = data
        self.starts, self.ends = self.words.split(data)
        self.chunk = np.searchsorted(ends, self.starts, side="right")
        place = np.arange(len(self.starts)) - np.searchsorted(self.chunk, self.chunk)
        self.own = place < np.asarray(batch.column(2))[self.chunk]
        self.weight = np.asarray(batch.column(3))[self.chunk]
        self.piece = self.words.pieces(data, self.starts)  # chunks are apart by a break too
        hashes = self.words.hashes(data, self.starts, self.ends)
        tongue = np.array([xxhash.xxh64_intdigest((x or "").encode()) for x in self.langs], np.uint64) if self.langs else np.zeros(0, np.uint64)
        self.hashes = mixed(hashes ^ tongue[self.chunk])
        self.rolling = Rolling(37)

    def of_length(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrase of ``n`` words from each word on, and whether there is one in its piece."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.arange(m)
        return self.rolling.stretches(self.hashes, at, at + n), self.piece[:m] == self.piece[n - 1 :]

    def wanted(self, n: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of length ``n``, and where both parts, one word shorter, are marked in ``shorter``."""
        found, there = self.of_length(n)
        if n > 1 and len(found):
            part, _ = self.of_length(n - 1)
            good = marked(part, shorter)
            there &= good[: len(found)] & good[1 : len(found) + 1]
        return found, there


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(8)) & np.uint64(bits - 1)


def marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = _bit(hashes, len(bitmap) * 8)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bitmap(frame: bytes | None) -> np.ndarray | None:
    return np.frombuffer(zstandard.decompress(frame), np.uint8) if frame else None


def added_up(keys: np.ndarray, weights: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their exact sums of weights and their least places."""
    order = np.argsort(keys)
    keys, weights, places = keys[order], weights[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first), np.minimum.reduceat(places, first)


def numbered(dictionary: DataFrame) -> DataFrame:
    """``dictionary`` with a number of each chunk, ``place``, of ``PLACE_BITS`` bits."""
    return dictionary.withColumn("place", F.expr(f"shiftrightunsigned(xxhash64(lang, chunk, owned), {64 - PLACE_BITS})").cast("int"))


def _hashed(batches: Iterator[pa.RecordBatch], n: int, shared) -> Iterator[pa.RecordBatch]:
    """(phrase hash, weight, place) of phrases of ``n`` words whose parts are marked, equal ones added up as far as held."""
    shorter, held, size = _bitmap(shared.value) if shared else None, [], 0

    def closed() -> pa.RecordBatch:
        k, w, p = added_up(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(w), pa.array(p)], ["phrase", "weight", "place"])

    for batch in batches:
        for part in range(0, batch.num_rows, 4096):
            rows = batch.slice(part, 4096)
            phrases = Phrases(rows)
            found, there = phrases.wanted(n, shorter)
            there &= phrases.own[: len(found)]
            held.append((found[there], phrases.weight[: len(found)][there], np.asarray(rows.column(4))[phrases.chunk[: len(found)][there]]))
            size += int(there.sum())
            if size > HELD:
                yield closed()
                held, size = [], 0
    if size:
        yield closed()


def _marks(values: DataFrame, bits: int) -> bytes:
    """A bitmap with the bits ``bit`` of ``values`` set, as a zstandard frame."""
    bitmap = np.zeros(bits // 8, np.uint8)
    buckets = values.select((F.col("bit") / BUCKET).cast("int").alias("bucket"), "bit").groupBy("bucket")
    # At most one row of 4 KB per bucket, and there are bits / BUCKET of them.
    for row in buckets.agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("marks")).collect():
        bitmap[row.bucket * (BUCKET // 8) :][: len(row.marks)] = np.frombuffer(row.marks, np.uint8)
    return zstandard.compress(bitmap.tobytes(), 1)


def frequent_hashes(dictionary: DataFrame, least: int, longest: int, bits: int = MARK_BITS) -> list[DataFrame]:
    """For each length from 1 on the phrases of the numbered ``dictionary`` found ``least`` times: phrase (hash), weight, place.

    Bitmaps of ``bits`` bits, which mark the phrases of the length before, are broadcast as zstandard frames, small
    where few phrases are frequent and never larger than the bitmap.
    """
    spark, found, shared = dictionary.sparkSession, [], None
    for n in range(1, longest + 1):
        counted = dictionary.mapInArrow(lambda b, n=n, shared=shared: _hashed(b, n, shared), "phrase long, weight long, place int")
        sums = counted.groupBy("phrase").agg(F.sum("weight").alias("weight"), F.min("place").alias("place"))
        found.append(stage(sums.filter(F.col("weight") >= least), "frequent-hashes"))
        # The same bit as in ``_bit``, in buckets as the bitmap functions have them.
        bit = F.expr(f"shiftrightunsigned(phrase, 8) & {bits - 1}L")
        shared = spark.sparkContext.broadcast(_marks(found[-1].select(bit.alias("bit")), bits))
    return found


def _placed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Chunks whose place is marked."""
    bitmap = _bitmap(shared.value)
    for batch in batches:
        place = np.asarray(batch.column(4))
        yield batch.filter(pa.array((bitmap[place >> 3] >> (place & 7) & 1).astype(bool)))


def _worded(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """lang, phrase, words, count of the ``wanted`` phrases (words, hash, count) of chunks, each once in a portion of chunks."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    for whole_batch in batches:
        for part in range(0, whole_batch.num_rows, 4096):
            batch = whole_batch.slice(part, 4096)
            phrases = Phrases(batch)
            words, hashes, counts = map(np.asarray, batch.column(5).flatten().flatten())
            data, rows = phrases.data.tobytes(), []
            for n in range(1, longest + 1):
                here = words == n
                sought, first = np.unique(hashes[here].view(np.uint64), return_index=True)
                sums = counts[here][first]
                found, there = phrases.of_length(n)
                there &= phrases.own[: len(found)]
                seen, at = np.unique(found[there], return_index=True)
                at = np.flatnonzero(there)[at]
                slot = np.minimum(np.searchsorted(seen, sought), max(0, len(seen) - 1))
                for k in np.flatnonzero(seen[slot] == sought) if len(seen) else ():
                    begin = at[slot[k]]
                    text = b" ".join(data[phrases.starts[begin + i] : phrases.ends[begin + i]] for i in range(n))
                    rows.append((phrases.langs[phrases.chunk[begin]], text.decode("utf-8", "replace"), n, int(sums[k])))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "phrase", "words", "count"])


def read_phrases(dictionary: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, bits: int = MARK_BITS) -> DataFrame:
    """lang, phrase, words (how many) and count of all phrases of up to ``longest`` words found ``least`` times.

    A phrase comes once, or once more for each further portion of chunks that has its place by chance and holds it too.
    """
    chunks = numbered(dictionary.select("lang", "chunk", "owned", "places"))
    counts = frequent_hashes(chunks, least, longest, bits)
    wanted = counts[0].select(F.lit(1).alias("words"), "phrase", "weight", "place")
    for n, more in enumerate(counts[1:], 2):
        wanted = wanted.unionByName(more.select(F.lit(n).alias("words"), "phrase", "weight", "place"))
    shared = dictionary.sparkSession.sparkContext.broadcast(_marks(wanted.select(F.col("place").cast("long").alias("bit")), 1 << PLACE_BITS))
    near = chunks.mapInArrow(lambda b: _placed(b, shared), chunks.schema)
    lists = wanted.groupBy("place").agg(F.collect_list(F.struct("words", "phrase", "weight")).alias("wanted"))
    read = near.join(lists, "place").select("lang", "chunk", "owned", "places", "place", "wanted")
    return read.mapInArrow(lambda b: _worded(b, longest), "lang string, phrase string, words int, count long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase of two words or more: lang, phrase, words, a, l, r, n, score.

    Cuts have the score floor(1000 a n / (l r)), in decimals of 38 digits; ties go to the cut after fewer words.
    ``totals``: lang, n (all words).
    """
    split = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"), cut.alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn("right", F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "))
    part = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("count").alias(name))
    full = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # One row per lang that has a frequent phrase.
    full = full.join(totals, "lang")
    over = F.lit(1000).cast("decimal(4,0)") * _wide(F.col("a")) * F.col("n").cast("decimal(15,0)")
    score = F.call_function("div", over, _wide(F.col("l")) * _wide(F.col("r")))
    lowest = full.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n")
    best = lowest.agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    return best.select("lang", "phrase", "words", "a", "_cut.l", "_cut.r", "n", "_cut.score")


def without_parts(candidates: DataFrame, hiding: int = HIDING) -> DataFrame:
    """``candidates`` (lang, phrase, words, a, ...) but those inside a longer one that is found ``hiding`` percent as often."""
    split = F.split("phrase", " ")
    lengths = F.when(F.col("words") > 2, F.sequence(F.lit(2), F.col("words") - 1))
    inner = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(split, i, n), " "))))
    hidden = candidates.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = F.col("_longer").isNull() | (100 * F.col("_longer") < hiding * F.col("a"))
    return candidates.join(hidden, ["lang", "phrase"], "left").filter(kept).drop("_longer")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, per_lang: int = PER_LANG, spacing: int = SPACING, bits: int = MARK_BITS) -> DataFrame:
    """The ``per_lang`` phrases of each lang with the highest scores: lang, rank, phrase, a, l, r, n, score.

    Of ``docs`` only lang and text are read. A null lang is ``und``; null and empty texts have no words; a repeated
    row counts again; ties go by a, then by the phrase's bytes. An empty table, or one without a frequent phrase,
    gives no rows.
    """
    dictionary = stage(chunks(docs, OVERLAP, spacing), "chunks")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("owned") * F.col("places")).alias("n"))
    phrases = stage(read_phrases(dictionary, least, LONGEST, bits).distinct(), "phrases")
    candidates = stage(scored(phrases, totals), "candidates")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = without_parts(candidates).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= per_lang)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

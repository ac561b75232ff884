"""Near-duplicate documents by SimHash fingerprints and an inverted index over byte positions.

Two fingerprints of eight bytes that differ in at most four bits differ in at most four bytes, so at least
four positional bytes are shared; that is the guaranteed number of matches of count filtering (Li, Lu and Lu,
"Efficient merging and filtering algorithms for approximate string searches", 2008). A posting list for each
single byte would hold a share of the corpus that never falls, so the index is kept on groups of positions:
20 triples of which any four positions hold one (a Turán system). Rows with the same bytes at a triple meet;
their shared bytes are tallied, pairs with fewer than four are dropped, and the rest are verified by counting
bits.

Only distinct fingerprints are compared. Within a posting list a spanning set of links is kept, never all
pairs. A list longer than ``LONGEST_LIST`` is not compared pair by pair: two fingerprints differ in at most
four bits exactly if some word lies within two bits of both, so each is listed under the words near it and
linked to the least one listed there, which is linear in the list and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weekcast.llm.rows import free_token_memory
from weekcast.operators.components import connected_components
from weekcast.session import stage

WORDS = 4
SEED = 42
BITS = 64
MOST_BITS = 4
LEAST_BYTES = 4
LONGEST_LIST = 1 << 15
#: Runs up to this length are compared row against row at each distance.
SHORT_RUN = 24


def turan_triples() -> list[tuple[int, int, int]]:
    """20 triples of the positions 0 to 7 such that any four positions hold one."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [t for g in groups for t in combinations(g, 3)]
    for k, group in enumerate(groups):
        triples += [tuple(sorted((a, b, c))) for a, b in combinations(group, 2) for c in groups[(k + 1) % 3]]
    return sorted(triples)


#: For each value of a byte, its bits from the lowest.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and 0x09-0x0D, 0x20 only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())]  # noqa: B905
    planes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(planes[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    free_token_memory()
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "version", "print"])


def version(text: str = "text") -> Column:
    """A hash that tells texts of the same doc_id apart."""
    return F.xxhash64(F.lit(1), F.coalesce(F.col(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, version and print (the 64 bits as a signed number) of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), version().alias("version"), F.col("text").cast("string"))
    return rows.mapInArrow(_fingerprints, "doc_id long, version long, print long")


def shared_bytes(difference: np.ndarray) -> np.ndarray:
    """How many of the eight positional bytes two fingerprints share, from their XOR."""
    return (np.ascontiguousarray(difference).view(np.uint8).reshape(*difference.shape, 8) == 0).sum(axis=-1)


def linked(difference: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of pairs given by their XOR."""
    kept = shared_bytes(difference) >= LEAST_BYTES
    kept[kept] = np.bitwise_count(difference[kept]) <= MOST_BITS
    return kept


def spanning_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the pairs within ``MOST_BITS`` of the given distinct fingerprints join."""
    rest, links = prints, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = linked(rest ^ at)
            found = rest[near]
            links += [(int(at), int(x)) for x in found]
            front += list(found)
            rest = rest[~near]
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the rows (key, print) of each key, which come one after the other; (print, null) for each
    row of a list that is too long."""
    key, held, long = None, [], False

    def frame(pairs: np.ndarray) -> pa.RecordBatch:
        b = pa.array(pairs[:, 1].view(np.int64)) if pairs.shape[1] == 2 else pa.nulls(len(pairs), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), b], ["a", "b"])

    def settled(runs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Links of whole lists; the short ones all at once, at each distance in turn."""
        short = [r for r in runs if 1 < len(r) <= SHORT_RUN]
        if short:
            values = np.concatenate(short)
            owner = np.repeat(np.arange(len(short)), [len(r) for r in short])
            for apart in range(1, max(map(len, short))):
                same = np.flatnonzero(owner[apart:] == owner[:-apart])
                a, b = values[same], values[same + apart]
                near = linked(a ^ b)
                if near.any():
                    yield frame(np.column_stack([a[near], b[near]]))
        for run in runs:
            if len(run) > SHORT_RUN and (links := spanning_links(run)):
                yield frame(np.array(links, np.uint64))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        ready = []
        for start, end in zip(cuts, cuts[1:]):  # noqa: B905
            if keys[start] != key:
                if held and not long:
                    ready.append(np.concatenate(held))
                key, held, long = keys[start], [], False
            held.append(prints[start:end])
            if long or sum(map(len, held)) > LONGEST_LIST:
                yield frame(np.concatenate(held)[:, None])
                held, long = [], True
        yield from settled(ready)
    if held and not long:
        yield from settled([np.concatenate(held)])


def near_words(prints: DataFrame) -> DataFrame:
    """Links (a, b) among any number of fingerprints, by the words within two bits of them: linear, and exact."""
    ones = [1 << k for k in range(BITS)]
    masks = [0, *ones, *[a | b for a, b in combinations(ones, 2)]]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    near = prints.select("print", F.explode(F.transform(F.lit(signed), lambda m: F.col("print").bitwiseXOR(m))).alias("word"))
    least = near.groupBy("word").agg(F.min("print").alias("least"), F.max("print").alias("most")).filter("least < most")
    return near.join(least, "word").select(F.col("least").alias("a"), F.col("print").alias("b")).filter("a < b").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column print) as all pairs within four bits do."""
    byte = lambda p: F.shiftrightunsigned("print", 8 * p).bitwiseAND(255)
    keys = [
        F.lit(n * (1 << 24)) + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c)
        for n, (a, b, c) in enumerate(turan_triples())
    ]
    listed = prints.select(F.explode(F.array(*keys)).alias("key"), "print")
    # A key's rows are read one after the other, and no more than LONGEST_LIST of them are held.
    met = stage(listed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long"), "print-links")
    short = met.filter("b is not null").distinct()
    long = met.filter("b is null").select(F.col("a").alias("print")).distinct()
    return short if long.isEmpty() else short.unionByName(near_words(long))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, version, print and component_id of every row of ``docs``.

    component_id is the least doc_id that links of at most four differing bits lead to, itself included; rows with
    a null doc_id take part and are never the least unless there is no other. Texts without a word have fingerprint 0
    and link to each other. Repeated rows stay. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs), "prints")
    least = stage(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    joined = connected_components(links(least.select("print")).select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = least.join(joined, least["print"] == joined["node"], "left").select("print", "first", F.coalesce("component", "print").alias("component"))
    placed = stage(placed, "placed-prints")
    firsts = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(firsts, "component").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", "version", "print", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id; all columns stay.

    Of several texts under that doc_id the one with the least hash stays, and of equal rows one. Rows without a
    doc_id can't be named and all stay.
    """
    kept = components(docs.filter("doc_id is not null")).filter("doc_id = component_id").groupBy("doc_id").agg(F.min("version").alias("__version"))
    named = docs.filter("doc_id is not null").withColumn("__version", version())
    first = named.join(kept, ["doc_id", "__version"], "left_semi").dropDuplicates(["doc_id", "__version"]).select(*docs.columns)
    return first.unionByName(docs.filter("doc_id is null"))


def hexadecimal(value: str) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")

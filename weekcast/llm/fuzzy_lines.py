"""Fuzzy line deduplication over all documents by MinHash.

A line is compared in lower case without outer blanks, by the set of all its ``GRAM``-character shingles. Their
64-bit hashes are put in order on a circle that is cut into ``PARTS`` parts; the least hash of each part and the next
ones, ``ROWS`` in all, make the key of a band (MinHash by one permutation: of two lines' least hashes in a part, all agree
if no shingle of only one of them comes first). Lines of few shingles get further circles, each in an order of its own, as their bands overlap.
Lines that have a key in common are candidates. Candidates are verified by all their shingles, and those of at
least ``LEAST`` are linked. Star rounds over the links give components, and the first line of
each, by doc_id and line number, stays.

In a band that many lines share, not all pairs are made. A line or two lead: all that aren't in a leader's component yet
are compared with it. Then components are joined, bands that lie in one component are done with, and in the
others more lines lead, eight times as many each round, until all have led. So a band of similar lines costs one
round or two, whatever its size, and no pair of a band is left open. A large band whose lines stay in several components
compares all lines of different ones, which is as many lines as it has times those outside its largest component; but
these comparisons are of sketches, in large bands wide ones, that leave few pairs whose texts must be joined.

Lines and shingles go by 64-bit hashes; two different lines with the same hash would count as equal lines. All work is
column functions, joins and aggregates. ``bands``, ``similar_pairs`` and ``_sketched`` are the former forms in numpy, against which tests hold
the definitions; no query calls them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from weekcast.llm.byte_words import mixed
from weekcast.llm.texts import text_rows, text_version
from weekcast.operators.components import connected_components
from weekcast.operators.scale import spread_join
from weekcast.session import scratch, stage

BANDS, ROWS = 20, 6
GRAM = 5
LEAST = 0.8
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
#: Parts of a circle of shingle hashes.
PARTS = 22
#: Lines of fewer shingles than this get so many further circles.
MORE_CIRCLES = ((40, 1),)
#: Lines of a band that are compared pair by pair at once.
FEW = 8
#: Lines that lead in the first round of a band of more, at least so many and less than twice as many as a mean.
LEADERS = 2
#: How many times as many lines lead in the next round.
STEP = 8
#: Shingles whose minima are taken in one go.
BLOCK = 1 << 16
#: Numbers of 64 bits that sketch a line's shingles, by which pairs that can't be similar are left out before any text moves.
SKETCH = 4
#: Such numbers in a large band; 256 bits fill up at a few hundred differing shingles, long before 1,024 do.
WIDE = 16
#: Bits that number the lines or pairs of a block next to a shingle's hash; a block has fewer of them.
PLACE = 17

_numbers = np.random.default_rng(71)
GRAM_FACTORS = _numbers.integers(1, 1 << 62, GRAM).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ORDER_FACTORS = _numbers.integers(1, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
ORDER_SHIFTS = _numbers.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)
ROW_FACTORS = _numbers.integers(1, 1 << 62, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def comparable(line: str) -> str:
    return line.strip(" ").lower()


def line_hash(line: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))).astype(np.int64))


def shingles(line: str) -> set[str]:
    """All character shingles of a line; a shorter line is its only shingle."""
    return {line[k : k + GRAM] for k in range(max(1, len(line) - GRAM + 1))}


def jaccard(a: str, b: str) -> float:
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _blocks(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of lines in order: a 64-bit hash of each shingle, repeats included, and where each line's hashes begin."""
    sizes = np.array([max(1, len(x) - GRAM + 1) for x in lines], np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        # Line feeds, which no line holds, fill up lines shorter than a shingle.
        points = np.frombuffer(("\n" * GRAM).join([*lines[at:to], ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        wide = len(points) - GRAM + 1
        hashes = sum(points[k : k + wide] * GRAM_FACTORS[k] for k in range(GRAM))
        begins = np.concatenate([[0], np.cumsum([len(x) + GRAM for x in lines[at : to - 1]])]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes[at : to - 1])])
        yield mixed(hashes[np.arange(sizes[at:to].sum()) + np.repeat(begins - first, sizes[at:to])]), first
        at = to


def bands(lines: list[str]) -> np.ndarray:
    """Band keys, one row per line; as equal sets of shingles have equal minima, repeats within a line don't matter."""
    found = []
    for wide, first in _blocks(lines):
        hashes = (wide >> np.uint64(32)).astype(np.uint32)
        minima = np.empty((BANDS, ROWS, len(first)), np.uint64)
        for k in range(BANDS * ROWS):
            minima[k // ROWS, k % ROWS] = np.minimum.reduceat((hashes + ORDER_SHIFTS[k]) * ORDER_FACTORS[k], first)
        found.append(mixed((minima * ROW_FACTORS[None, :, None]).sum(axis=1) + np.arange(BANDS, dtype=np.uint64)[:, None]).T)
    return np.concatenate(found) if found else np.zeros((0, BANDS), np.uint64)


def _sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each line one after the other, where each line's begin, and how many it has."""
    values, counts = [], []
    for hashes, first in _blocks(lines):
        place = np.zeros(len(hashes), np.uint64)
        place[first[1:]] = 1
        # A hash keeps the bits that the line's number in its block leaves.
        held = np.sort((np.cumsum(place) << np.uint64(64 - PLACE)) | (hashes >> np.uint64(PLACE)))
        held = held[np.concatenate([[True], held[1:] != held[:-1]])]
        values.append(held & np.uint64((1 << 64 - PLACE) - 1))
        counts.append(np.bincount((held >> np.uint64(64 - PLACE)).astype(np.int64), minlength=len(first)))
    sizes = np.concatenate(counts)
    return np.concatenate(values), np.cumsum(sizes) - sizes, sizes


def similar_pairs(lines: list[str], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether lines ``a[k]`` and ``b[k]`` (places in ``lines``) have a Jaccard similarity of ``least`` or more.

    Shingles are counted by hashes of 47 bits; pairs for which up to two equal hashes of different shingles could
    matter are counted by the shingles themselves.
    """
    values, begins, sizes = _sets(lines)
    alike = np.zeros(len(a), bool)
    ends = np.cumsum(sizes[a] + sizes[b])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * BLOCK, side="right")))
        to = min(to, at + (1 << PLACE))
        which = np.concatenate([a[at:to], b[at:to]])
        n = sizes[which]
        row = np.repeat(np.arange(len(which)), n)
        taken = values[np.arange(n.sum()) + np.repeat(begins[which] - (np.cumsum(n) - n), n)]
        keys = np.sort((row % (to - at)).astype(np.uint64) << np.uint64(64 - PLACE) | taken)
        twice = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(64 - PLACE)
        both = np.bincount(twice.astype(np.int64), minlength=to - at)
        apart = both - least * (sizes[a[at:to]] + sizes[b[at:to]] - both)
        alike[at:to] = apart >= 0
        for k in np.flatnonzero(np.abs(apart) <= 2 * (1 + least)):
            x, y = shingles(lines[a[at + k]]), shingles(lines[b[at + k]])
            common = len(x & y)
            alike[at + k] = common >= least * (len(x) + len(y) - common)
        at = to
    return alike


def _sketched(batches: Iterator[pa.RecordBatch], words: int = SKETCH) -> Iterator[pa.RecordBatch]:
    """hash, number of distinct shingles and sketch of lines (hash, line)."""
    for batch in batches:
        values, begins, sizes = _sets(batch.column(1).to_pylist()) if batch.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        bit = values % np.uint64(64 * words)
        word, one = bit // np.uint64(64), np.uint64(1) << (bit % np.uint64(64))
        odd = [np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), begins).view(np.int64) for k in range(words)] if len(begins) else [begins] * words
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, odd)], ["hash", *_sketch(words)])


def _sketch(words: int) -> list[str]:
    return ["size", *(f"odd{k}" for k in range(words))]


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """hash, number of distinct shingles and sketch of ``texts`` (hash, line)."""
    held = texts.select("hash", F.explode(shingle_hashes("line")).alias("_shingle"))
    bit, word = F.expr("shiftleft(1L, int(_shingle & 63))"), F.expr(f"pmod(shiftrightunsigned(_shingle, 6), {words})")
    odd = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"odd{k}") for k in range(words)]
    return held.groupBy("hash").agg(F.count("*").alias("size"), *odd)


def _may_be_similar(least: float, words: int = SKETCH) -> Column:
    """Whether lines of the sizes ``_n`` and ``_m`` and sketches ``_p*`` and ``_q*`` can be similar; false only if they are not.

    A bit of a sketch tells whether an odd number of shingles fell on it, so two sketches differ in no more bits than
    there are shingles in one of the lines only. Nor can a line be similar to one with too many more shingles. Two coinciding
    hashes on each side do no harm.
    """
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"_p{k}").bitwiseXOR(F.col(f"_q{k}"))) for k in range(words)])
    sizes = F.least("_n", "_m") + 2 >= F.greatest("_n", "_m") * F.lit(least)
    return sizes & (bits <= (F.col("_n") + F.col("_m")) * F.lit((1 - least) / (1 + least)) + 4)


def shingle_hashes(line: str) -> Column:
    """The distinct 64-bit hashes of the shingles of a column; a shorter line is its only shingle.

    In UTF-32 all characters have four bytes, so each shingle is found at once; the text is encoded once, as the only
    element of an array, for an expression inside a lambda function is evaluated for each of its calls.
    """
    cut = f"transform(sequence(1, greatest(1, length(b) - {4 * GRAM - 1}), 4), i -> xxhash64(substr(b, i, {4 * GRAM})))"
    return F.expr(f"array_distinct(transform(array(encode({line}, 'UTF-32')), b -> {cut})[0])")


def band_rows(texts: DataFrame) -> DataFrame:
    """(key, hash) of all bands of ``texts`` (hash, line), a key once for each line."""
    held = texts.select("hash", F.sort_array(shingle_hashes("line")).alias("_held"))
    circles = [F.col("_held")]
    orders = F.array(*circles)
    for fewer, more in MORE_CIRCLES:
        circles += [F.expr(f"sort_array(transform(_held, x -> xxhash64(x, {len(circles) + k})))") for k in range(more)]
        orders = F.when(F.size("_held") < fewer, F.array(*circles)).otherwise(orders)
    circle = held.select("hash", F.posexplode(orders).alias("_circle", "_order"))
    # The bounds of the parts are sorted in, and before the k-th one there are k other bounds.
    bounds = [(k + 1) * ((1 << 64) // PARTS) - (1 << 63) for k in range(PARTS - 1)]
    held = F.sort_array(F.concat("_order", F.array(*[F.lit(b).cast("long") for b in bounds]))).alias("_bounded")
    round_ = F.expr(f"concat(_order, slice(_order, 1, {ROWS}))").alias("_round")
    circle = circle.select("hash", "_circle", held, round_)
    begins = F.array_distinct(F.array(F.lit(1).cast("long"), *[F.array_position("_bounded", F.lit(b).cast("long")) - k for k, b in enumerate(bounds)])).alias("_begins")
    keyed = circle.select("hash", "_circle", begins, "_round")
    return keyed.select("hash", F.explode(F.expr(f"array_distinct(transform(_begins, i -> xxhash64(_circle, slice(_round, int(i), {ROWS}))))")).alias("key")).select("key", "hash")


def worded_lines(docs: DataFrame) -> DataFrame:
    """doc_id, version, line_no, line in the form that is compared, and its hash, of all lines with a word."""
    lines = text_rows(docs).select("doc_id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    named = lines.filter(F.regexp_like("line", F.lit(WORD_CHARACTER))).withColumn("line", F.lower(F.trim("line")))
    return named.withColumn("hash", F.xxhash64("line"))


def shared_bands(distinct: DataFrame) -> DataFrame:
    """(key, hash) of the bands that several of the ``distinct`` lines (hash, line) share."""
    lines = F.count("*").over(Window.partitionBy("key"))
    return band_rows(distinct).withColumn("_lines", lines).filter("_lines > 1").select("key", "hash")


def _verified(pairs: DataFrame, texts: DataFrame, least: float, name: str) -> DataFrame:
    """(cu, cv) of those of ``pairs`` (u, v, cu, cv) whose lines in ``texts`` (hash, line) are similar, written."""
    side = lambda name, text: texts.select(F.col("hash").alias(name), F.col("line").alias(text))
    read = pairs.join(side("u", "_a"), "u").join(side("v", "_b"), "v")
    held = read.select("cu", "cv", shingle_hashes("_a").alias("_x"), shingle_hashes("_b").alias("_y"))
    both = held.select("cu", "cv", F.size(F.array_intersect("_x", "_y")).alias("_both"), (F.size("_x") + F.size("_y")).alias("_sizes"))
    return stage(both.filter(F.col("_both") >= F.lit(least) * (F.col("_sizes") - F.col("_both"))).select("cu", "cv"), name)


def _candidates(rest: DataFrame, least: float, words: int) -> DataFrame:
    """(u, v, cu, cv) of the pairs of this round's leaders with lines of their bands, without those that can't be similar."""
    leads = F.col("mark") % F.col("turn") == 0
    led = (F.col("before") > 0) & (F.expr("mark % if(before > 0, before, 1)") == 0)
    sketch = lambda size, odd: [F.col(c).alias(n) for c, n in zip(_sketch(words), [size, *(f"{odd}{k}" for k in range(words))], strict=True)]
    a = rest.filter(leads & ~led).select("key", F.col("hash").alias("u"), F.col("component").alias("cu"), *sketch("_n", "_p"))
    b = rest.filter(~led).select("key", F.col("hash").alias("v"), F.col("component").alias("cv"), leads.alias("_leads"), *sketch("_m", "_q"))
    pairs = a.join(b, "key").filter((F.col("cu") != F.col("cv")) & (~F.col("_leads") | (F.col("u") < F.col("v"))) & _may_be_similar(least, words))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))


def joined_lines(members: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, component) of lines with verified links, which join all similar lines of a band.

    Not each similar pair has a link of its own.

    ``members``: key, hash of lines that share a band; ``texts``: hash, line of them.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    # A line leads where its mark is a multiple of ``turn``, a power of two that falls from round to round.
    fewest = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / LEADERS))))
    turns = sizes.select("key", F.when(F.col("n") <= FEW, F.lit(1)).otherwise(fewest).cast("long").alias("turn"))
    mark = F.expr("shiftrightunsigned(xxhash64(hash), 8)")
    state = [mark.alias("mark"), F.col("turn"), F.lit(0).cast("long").alias("before"), F.col("hash").alias("component")]
    known = stage(members.join(_sketches(texts, SKETCH), "hash").join(turns, "key").select("key", "hash", *_sketch(SKETCH), *state), "band-members")
    large = known.filter("turn > 1").select("key", "hash", "mark", "turn", "before", "component")
    many = stage(texts.join(large.select("hash").distinct(), "hash", "left_semi").select("hash", "line"), "large-band-texts")
    rest = stage(large.join(_sketches(many, WIDE), "hash"), "large-band-members")
    pairs = _candidates(known.filter("turn = 1"), least, SKETCH).unionByName(_candidates(rest, least, WIDE))
    rounds = []
    while True:
        # New links join what earlier rounds have made of their ends, so a round costs what it finds.
        links = _verified(stage(pairs.distinct(), "line-pairs"), many if rounds else texts, least, "line-links").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        rounds.append(stage(connected_components(links), "joined-components"))
        large = rest.filter("turn > 1")
        if large.isEmpty():
            break
        merged = rounds[-1].select(F.col("node").alias("component"), F.col("component").alias("_into"))
        placed = spread_join(large, merged, ["component"]).withColumn("component", F.coalesce("_into", "component"))
        placed = stage(placed.select("key", "hash", *_sketch(WIDE), "mark", "turn", "component"), "placed-members")
        open_bands = placed.groupBy("key").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a < _b").select("key")
        step = F.greatest(F.lit(1).cast("long"), F.expr(f"turn div {STEP}"))
        rest = placed.join(open_bands, "key", "left_semi").select("key", "hash", *_sketch(WIDE), "mark", step.alias("turn"), F.col("turn").alias("before"), "component")
        rest = stage(rest, "band-members")
        if rest.isEmpty():
            break
        pairs = _candidates(rest, least, WIDE)
    if len(rounds) == 1:
        return rounds[0]
    chains = reduce(DataFrame.unionByName, rounds).select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stage(connected_components(chains), "joined-lines")


def dropped_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, version, dropped (ascending line numbers from 0): which lines of ``docs`` (doc_id, text) go.

    Of each component of fuzzily equal lines the first by doc_id, version and line number stays. Lines without a
    word always stay. Repeated rows are the same document and lose the same lines. Documents that lose none, null
    and empty texts have no row. A null doc_id comes after all others. No other column is read.
    """
    with scratch(docs.sparkSession) as keep:
        lines = worded_lines(docs)
        distinct = stage(lines.groupBy("hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.first("line").alias("line")), "distinct-lines")
        members = stage(shared_bands(distinct), "shared-bands")
        texts = distinct.join(members.select("hash").distinct(), "hash", "left_semi").select("hash", "line")
        joined = joined_lines(members, stage(texts, "line-texts"), least).withColumnsRenamed({"node": "_node"})
        # Only lines that have an equal or a linked one can go.
        several = distinct.join(joined, distinct["hash"] == joined["_node"], "left").filter("n > 1 or component is not null")
        several = stage(several.select("hash", "first_doc", F.coalesce("component", "hash").alias("component")), "several-lines")
        first = several.groupBy("component").agg(F.min("first_doc").alias("_first"))
        member = several.join(first, "component").select("hash", "component", "_first")
        among = stage(lines.drop("line").join(member, "hash"), "lines-among-others")
        leading = F.col("doc_id").eqNullSafe(F.col("_first"))
        place = F.struct("version", "line_no")
        inside = Window.partitionBy("doc_id", "component")
        later = among.filter(leading).withColumn("_kept", F.min(place).over(inside)).filter(place > F.col("_kept"))
        gone = among.filter(~leading).select("doc_id", "version", "line_no").unionByName(later.select("doc_id", "version", "line_no"))
        return keep(gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")), "dropped-lines")


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; all columns, in their order, and all rows stay.

    Columns of any names may be there; a text of which nothing is left becomes empty.
    """
    columns = docs.columns
    gone = dropped.select(F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.col("dropped").alias("__dropped"))
    joined = docs.join(gone, (text_version() == F.col("__version")) & docs["doc_id"].eqNullSafe(F.col("__doc")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("__dropped", i)), "\n")
    return joined.select(*[F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(rest).alias(c) if c == "text" else F.col(f"`{c}`") for c in columns])


def deduplicated(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without repeated lines, and without documents that had words and have none left.

    Where there is a column ``n_chars`` it follows the text.
    """
    gone = dropped_lines(docs, least)
    bare = docs.withColumn("__worded", F.regexp_like("text", F.lit(WORD_CHARACTER)))
    rest = without_lines(bare, gone).filter(~F.coalesce("__worded", F.lit(False)) | F.regexp_like("text", F.lit(WORD_CHARACTER))).drop("__worded")
    return rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rest

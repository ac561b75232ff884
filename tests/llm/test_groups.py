"""Near-duplicate lines and documents, benchmark tiles, link trust and quality rules against brute force."""

import re
import sys
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weekcast.llm import fuzzy_lines as L, link_trust as U, rule_cascade as Q, simhash_bytes as S, string_tiling as G, union_find as V

SPACE = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    """Rows (doc_id, text) with columns that clash with inner names."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, version int, line string")


def joined_by_hand(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# Documents


def test_turan_triples_hit_every_four_positions():
    triples = S.turan_triples()
    assert len(set(triples)) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \n\x0b\x1c\u00a0é."), max_size=40))
def test_fingerprint_by_its_definition(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(SPACE, lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    assert S.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("longest", [S.LONGEST_LIST, 8])
def test_components_equal_all_pairs(spark, monkeypatch, longest):
    """Dense clouds around a few fingerprints, exact copies, and strangers; also with lists over the limit."""
    rng = np.random.default_rng(2)
    prints = []
    for _ in range(6):
        centre = int(rng.integers(0, 2**63))
        for _ in range(40):
            flips = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            prints.append(centre ^ sum(1 << int(b) for b in flips))
    prints += [int(x) for x in rng.integers(0, 2**63, 100)] + prints[:30] + [0, 3, 3]
    values = np.array(prints, np.uint64)
    near = [(i, j) for i in range(len(values)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4)).tolist()]
    want = joined_by_hand(len(values), near)
    monkeypatch.setattr(S, "LONGEST_LIST", longest)
    if longest == 8:
        met = list(S._compare(iter([batch_of(values)])))
        assert any(b.column(1).null_count for b in met)
    rows = spark.createDataFrame(list(enumerate(values.view(np.int64).tolist())), "doc_id long, print long")
    monkeypatch.setattr(S, "fingerprints", lambda docs: docs.withColumn("version", F.lit(0)))
    got = {r["doc_id"]: r["component_id"] for r in S.components(rows).collect()}
    if longest == 8:  # workers have the module's own limit: take the links of the long way itself
        links = S.near_words(rows.select("print").distinct()).collect()
        place = {int(p): i for i, p in enumerate(values.view(np.int64).tolist())}
        same = [(i, place[int(p)]) for i, p in enumerate(values.view(np.int64).tolist())]
        assert joined_by_hand(len(values), same + [(place[a], place[b]) for a, b in map(tuple, links)]) == want
    assert [got[i] for i in range(len(values))] == want


def batch_of(values):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(values), np.int64)), pa.array(values.view(np.int64))], ["key", "print"])


def test_one_document_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(400)]
    text = " ".join(words)
    near = " ".join([*words[:200], "changed", *words[201:]])
    rows = [(5, text), (3, text.upper()), (9, near), (9, near), (11, "another text of some words here"), (12, None), (13, ""), (14, " "), (None, text), (3, text.upper())]
    got = S.one_of_each(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "version", "line"]
    ids = Counter(r["doc_id"] for r in got.collect())
    close = (S.fingerprint(text) ^ S.fingerprint(near)).bit_count() <= 4
    assert ids == Counter([3, 11, 12, None, *([] if close else [9])])
    assert S.one_of_each(frame(spark, [])).count() == 0 and S.components(frame(spark, [])).count() == 0


# Lines


def line_sets(lines):
    return [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]


def test_dropped_lines_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    rows = []
    for k in range(80):
        lines = [base[int(i)] for i in rng.integers(0, 30, 3)]
        if k % 3 == 0:
            changed = lines[0].split()
            changed[int(rng.integers(0, 60))] = "changed"
            lines[0] = " ".join(changed)
        rows.append((k, "\n".join([*lines, "", "  ", " ".join(rng.choice(words, 40)), "Short.", "short."])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Only here"), (104, "x" * 9_000 + " end"), (105, "x" * 9_000 + " fin")]
    placed = [(i, n, x.strip(" ").lower()) for i, t in rows for n, x in enumerate((t or "").split("\n")) if re.search(SPACE, x)]
    distinct = sorted({x for _, _, x in placed})
    sets = line_sets(distinct)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = dict(zip(distinct, joined_by_hand(len(distinct), near), strict=True))
    seen, want = set(), set()
    for i, n, x in placed:
        (want.add((i, n)) if root[x] in seen else seen.add(root[x]))
    got = {(r["doc_id"], n) for r in L.dropped_lines(frame(spark, rows)).collect() for n in r["dropped"]}
    assert got <= want and len(want - got) <= 0.02 * len(want)
    exact = {(i, n) for k, (i, n, x) in enumerate(placed) if x in {y for _, _, y in placed[:k]}}
    assert exact <= got and len(got) > len(exact) + 15


def test_texts_lose_their_dropped_lines(spark):
    rows = [(2, "One line of words\nsecond line here"), (1, "one line of words \n\nthird"), (3, "ONE LINE OF WORDS"), (4, None), (5, ""), (None, "third\nnew"), (6, "third\r\nthird"), (3, "ONE LINE OF WORDS"), (3, "other text")]
    docs = frame(spark, rows)
    got = sorted(((r["doc_id"] or -1, r["text"]) for r in L.deduplicated(docs).collect()), key=str)
    # Of doc 6 the first line ends in a return, which is no blank, and is no equal of "third"; it is a neighbour of none.
    assert got == sorted([(1, "one line of words \n\nthird"), (2, "second line here"), (3, "other text"), (4, None), (5, ""), (-1, "new"), (6, "third\r")], key=str)
    assert L.deduplicated(docs).columns == docs.columns
    assert L.deduplicated(frame(spark, [])).count() == 0


def test_exact_jaccard_of_short_and_long_lines():
    pairs = [("abc", "abc"), ("abcdefgh", "abcdefgx"), ("ab" * 3000, "ab" * 2000), ("é" * 7 + "abcdef", "é" * 7 + "abcdeg"), ("a", "b")]
    sets = [line_sets(p) for p in pairs]
    assert [L.jaccard(a, b) for a, b in pairs] == [pytest.approx(len(a & b) / len(a | b)) for a, b in sets]


@pytest.mark.parametrize("block", [1 << 16, 40])
def test_pairs_in_bulk_equal_sets(monkeypatch, block):
    """Random near pairs, with empty, short and repeated lines, in one block and in blocks of a line or two."""
    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(12)
    lines = ["", "a", "abcd", "abcde", "abcde" * 40, "\U0001f600" * 9 + "abc"]
    for _ in range(60):
        body = list(rng.choice(list("abcdefgh é"), rng.integers(1, 150)))
        lines.append("".join(body))
        for _ in range(int(rng.integers(0, 6))):
            body[int(rng.integers(0, len(body)))] = "ß"
        lines.append("".join(body))
    a = rng.integers(0, len(lines), 1500)
    b = np.where(rng.random(1500) < 0.5, np.minimum(a ^ 1, len(lines) - 1), rng.integers(0, len(lines), 1500))
    for least in (0.5, 0.8, 1.0):
        want = [L.jaccard(lines[x], lines[y]) >= least for x, y in zip(a, b, strict=True)]
        assert L.similar_pairs(lines, a, b, least).tolist() == want and any(want)


def test_pairs_of_too_unlike_sizes_are_not_compared(spark):
    """Equal sketches don't make a pair of 70 and 100 shingles similar; before, such pairs' texts were joined."""
    sides = [f"0L AS _{s}{k}" for s in "pq" for k in range(L.SKETCH)]
    sizes = spark.createDataFrame([(70, 100), (100, 70), (77, 100), (78, 100), (100, 80), (1, 3)], "_n long, _m long").selectExpr("*", *sides)
    assert [r.kept for r in sizes.select(L._may_be_similar(0.8).alias("kept")).collect()] == [False, False, False, True, True, True]


@pytest.mark.parametrize("few", [2, 8])
def test_all_similar_lines_of_a_band_are_joined(spark, monkeypatch, few):
    """One band holds all lines, so most of its lines are strangers to its leaders."""
    monkeypatch.setattr(L, "FEW", few)
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    groups = []
    for _ in range(4):
        ends = [text(30), text(30)]
        body = text(300)
        groups.append([body, body + ends[0], ends[1] + body, text(340)])
    lines = [x for g in groups for x in g] + [text(200) for _ in range(20)]
    hashes = {x: L.line_hash(x) for x in lines}
    members = spark.createDataFrame([(key, hashes[x]) for k, x in enumerate(lines) for key in (7, 8 + k % 2)], "key long, hash long")
    found = L.joined_lines(members, spark.createDataFrame([(h, x) for x, h in hashes.items()], "hash long, line string")).collect()
    sets, at = line_sets(lines), {hashes[x]: k for k, x in enumerate(lines)}
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) >= 8
    assert joined_by_hand(len(lines), [(at[r["node"]], at[r["component"]]) for r in found]) == joined_by_hand(len(lines), near)


def test_unlike_lines_of_a_band_are_not_paired(spark, monkeypatch):
    """Sixty lines that share half of their text share a band; only the two near ones among them are compared by text."""
    rng = np.random.default_rng(9)
    head = "".join(rng.choice(list("abcdefgh "), 60))
    lines = [head + "".join(rng.choice(list("ijklmnop "), 60)) for _ in range(60)]
    lines.append(lines[0][:-1] + "x")
    texts = spark.createDataFrame(list(enumerate(lines)), "hash long, line string")
    members = spark.createDataFrame([(7, k) for k in range(len(lines))], "key long, hash long")
    compared, verified = [], L._verified

    def counted(pairs, *others):
        compared.extend((r.u, r.v) for r in pairs.collect())
        return verified(pairs, *others)

    monkeypatch.setattr(L, "_verified", counted)
    assert {(r.node, r.component) for r in L.joined_lines(members, texts).collect()} == {(0, 0), (60, 0)}
    assert (0, 60) in compared and len(compared) < 10


def test_long_lines_of_a_large_band_that_are_little_alike_are_not_paired(spark, monkeypatch):
    """Eighty lines that share three quarters of five hundred characters: only the two near ones are compared by text."""
    rng = np.random.default_rng(19)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    head = text(400)
    lines = [head + text(130) for _ in range(80)]
    lines.append(lines[7][:-1] + "x")
    assert 0.6 < L.jaccard(lines[0], lines[1]) < 0.7
    texts = spark.createDataFrame(list(enumerate(lines)), "hash long, line string")
    members = spark.createDataFrame([(key, k) for k in range(len(lines)) for key in (7, 8)], "key long, hash long")
    compared, verified = [], L._verified

    def counted(pairs, *others):
        compared.extend((r.u, r.v) for r in pairs.collect())
        return verified(pairs, *others)

    monkeypatch.setattr(L, "_verified", counted)
    assert {(r.node, r.component) for r in L.joined_lines(members, texts).collect()} == {(7, 7), (80, 7)}
    assert (7, 80) in compared and len(compared) < 10


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abc "), min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 400), st.sampled_from(["", "x", "ab"])), max_size=25))
def test_a_sketch_never_parts_similar_lines(line, edits):
    other = line
    for at, new in edits:
        other = other[:at] + new + other[at + 1 :]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([line, other])], ["hash", "line"])
    a, b = pa.Table.from_batches(L._sketched([batch])).to_pylist()
    bits = sum(((a[f"odd{k}"] ^ b[f"odd{k}"]) & (1 << 64) - 1).bit_count() for k in range(L.SKETCH))
    apart = len(L.shingles(line) ^ L.shingles(other))
    assert bits <= apart and (bits - apart) % 2 == 0
    assert L.jaccard(line, other) < 0.8 or bits <= (a["size"] + b["size"]) * (0.2 / 1.8) + 4


def test_union_find_against_a_walk(spark, monkeypatch):
    """Stars, chains, loops and repeats, united in one block and in blocks so small that a core is left."""
    rng = np.random.default_rng(5)
    chain = [(k + 1, k) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 700)]
    loose = [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(250)]
    edges = chain + star + loose + [(7, 7), (-3, 9), (9, -3), (-3, 9)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        todo = [] if node in want else [node]
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = node
                todo += near[at]
    table = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.component for r in V.components(table).collect()} == want
    assert V.components(table.filter("u = 0")).count() == 0
    monkeypatch.setattr(V, "BLOCK", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert {r.node: r.component for r in V.components(table).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_lines_of_all_kinds_share_a_band():
    """Without blanks, of two words of which the second begins otherwise, and with letters changed all over."""
    rng = np.random.default_rng(12)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    letters, signs = "abcdefghijklmnop", [chr(0x4E00 + k) for k in range(500)]
    pairs = []
    for _ in range(100):
        sentence = text(signs, 200)
        pairs.append((sentence, sentence[:100] + "x" + sentence[101:]))
        first, second = text(letters, 60), text(letters, 40)
        pairs.append((f"{first} {second}", f"{first} {'x' + second[1:]}"))
        words = list(" ".join(text(letters, 5) for _ in range(80)))
        pairs.append(("".join(words), "".join("x" if k % 53 == 20 else c for k, c in enumerate(words))))
    sets = [line_sets(p) for p in pairs]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in sets)
    met = (L.bands([a for a, _ in pairs]) == L.bands([b for _, b in pairs])).any(axis=1)
    assert all(met[k::3].sum() >= 97 for k in range(3))


def line_frame(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "hash long, line string").coalesce(1)


def test_shingles_as_columns_are_those_by_definition(spark):
    lines = ["", "a", "abcd", "abcde", "ababababab", "ünï cödé \u4e00\u4e01\u4e02\u4e03", "\U0001f600\U0001f601 x\r\u2028y \U0001f600\U0001f601 x", "a line " * 40]
    counts = line_frame(spark, lines).select("hash", F.size(L.shingle_hashes("line")).alias("n")).collect()
    assert [r.n for r in sorted(counts)] == [len(L.shingles(x)) for x in lines]
    # Equal shingles have equal hashes, wherever they lie.
    both = line_frame(spark, ["\u4e00bcdefgh"]).select(F.size(F.array_intersect(L.shingle_hashes("line"), L.shingle_hashes("concat('\u00e9\U0001f600', line)"))).alias("n"))
    assert both.first().n == 4


@pytest.mark.parametrize("size", [16, 45, 90, 250, 900])
def test_similar_lines_share_a_band_of_columns_and_strangers_none(spark, size):
    """Of pairs just at 0.8 nearly all meet; of lines without a shingle in common none do."""
    rng = np.random.default_rng(size)
    lines, near = [], 0
    for k in range(150):
        line = [chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, size + 4)]
        other = list(line)
        while L.jaccard("".join(line), "".join(other)) >= 0.83:
            other[int(rng.integers(0, size + 4))] = "x"
        if L.jaccard("".join(line), "".join(other)) >= 0.8:
            near += 1
            lines += ["".join(line), "".join(other)]
    rows = L.band_rows(line_frame(spark, lines)).collect()
    keys = [set() for _ in lines]
    for r in rows:
        keys[r.hash].add(r.key)
    assert len(rows) == sum(map(len, keys)) <= 2 * (L.PARTS + 1) * len(lines)
    assert near == 0 or sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(near)) >= 0.95 * near
    assert not any(keys[2 * k] & keys[2 * k + 2] for k in range(near - 1))


def test_line_dedup_runs_columns_only(spark, monkeypatch):
    plans, staged = [], L.stage

    def watched(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return staged(df, name)

    for module in (L, sys.modules["weekcast.operators.components"], sys.modules["weekcast.session"]):
        monkeypatch.setattr(module, "stage", watched)
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{words} {k}\nthe same line\nown line {k * 7919}") for k in range(40)]
    left = L.deduplicated(frame(spark, rows))
    assert left.filter("text like '%word%'").count() == 1 and left.filter("text like '%the same line%'").count() == 1
    plans.append(left._jdf.queryExecution().toString())
    assert len(plans) > 8 and not [p for p in plans if "Python" in p or "Arrow" in p or "Pandas" in p]


def test_strangers_share_no_band():
    rng = np.random.default_rng(13)
    keys = L.bands(["".join(rng.choice(list("abcdefghijklmnop"), 60)) for _ in range(500)] + ["", "a", "ab"])
    assert len(np.unique(keys)) == keys.size


def test_bands_do_not_depend_on_the_other_lines(monkeypatch):
    lines = ["short", "abc", "x" * 300, "a longer line of words", "abc"]
    together = L.bands(lines)
    monkeypatch.setattr(L, "BLOCK", 8)
    assert (L.bands(lines) == together).all() and (together[1] == together[4]).all()


# Tiles


def test_tiles_by_hand():
    document = np.array([1, 2, 3, 4, 5, 6, 9, 9, 7, 8, 1, 2, 3, 4, 5, 6, 7, 8])
    item = np.array([7, 8, 1, 2, 3, 4, 5, 6, 7])
    seeds = [(p, q) for p in range(len(document) - 4) for q in range(len(item) - 4) if (document[p : p + 5] == item[q : q + 5]).all()]
    assert G.tile(document, item, seeds) == [(8, 0, 9)]
    # A taken-apart passage: two tiles in another order.
    swapped = np.concatenate([item[4:], [0], item[:4]])
    assert G.tile(swapped, item, [(0, 4)]) == [(0, 4, 5)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=5, max_size=25), st.lists(st.integers(1, 3), min_size=5, max_size=15))
def test_tiles_are_greedy(document, item):
    """As by definition: mark the longest unmarked common run, earliest first, until none of five is left."""
    d, t, mine, theirs, want = np.array(document), np.array(item), set(), set(), []
    while True:
        best = (0, 0, 0)
        for p in range(len(d)):
            for q in range(len(t)):
                n = 0
                while p + n < len(d) and q + n < len(t) and d[p + n] == t[q + n] and p + n not in mine and q + n not in theirs:
                    n += 1
                best = max(best, (n, -p, -q))
        if best[0] < 5:
            break
        n, p, q = best[0], -best[1], -best[2]
        want.append((p, q, n))
        mine.update(range(p, p + n))
        theirs.update(range(q, q + n))
    seeds = [(p, q) for p in range(len(d) - 4) for q in range(len(t) - 4) if (d[p : p + 5] == t[q : q + 5]).all()]
    assert G.tile(d, t, seeds) == want


def test_contaminated_documents(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(900)]
    items = [(k, " ".join(rng.choice(words, 30))) for k in range(20)] + [(50, "too short here"), (51, None), (52, "")]
    benchmark = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    filler = lambda n: " ".join(rng.choice(words, n))
    first, second = items[3][1].split(), items[4][1].split()
    rows = [
        (0, filler(200)),
        (1, filler(80) + " " + items[0][1].upper().replace(" ", ", ") + " " + filler(50)),
        (2, " ".join([*first[20:], filler(30), *first[:10], filler(20), *first[10:20]])),  # reordered
        (3, " ".join(second[:12])),  # less than 0.6 of it
        (4, None), (5, ""), (6, "too short here"),
        (7, filler(20_000) + " " + items[5][1]),
        (1, "another text of document one"), (None, items[6][1]),
    ]
    docs = frame(spark, rows)
    for parts in (G.PART_GRAMS, 100):
        got = G.contaminated(docs, benchmark, part_grams=parts).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 3), (7, 5), (None, 6)} and len(got) == 4
        assert {r["item_id"]: r["n_tiles"] for r in got}[3] == 3 and all(r["coverage"] == 1 for r in got)
        kept = G.clean(docs, benchmark, part_grams=parts)
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 1, 3, 4, 5, 6]) and kept.columns == docs.columns
    assert G.contaminated(docs, benchmark.limit(0)).count() == 0
    assert G.clean(docs, benchmark.limit(0)).count() == len(rows)
    assert G.contaminated(docs.limit(0), benchmark).count() == 0


# Links

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def test_longest_rule_wins(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"), "HTTP://B.Example.COM/en/?q#f": ("b.example.com", "/en/", "example.com/en/", "block"),
        "https://www.example.com/en/a": ("www.example.com", "/en/a", "www.example.com/en/", "allow"), "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "x://n.net/es/1?u=http://y.com/": ("n.net", "/es/1", "net/es/", "block"), "x://n.net/es": ("n.net", "/es", None, None), "x://notcom/": ("notcom", "/", None, None),
        "x://a.com": ("a.com", "", None, None), "x://a.com?b": ("a.com", "", None, None), "no url": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "x:///p": ("", "/p", None, None),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id long, url string")
    placed = U.ruled(pages.select("page_id", "url", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path")), RULES)
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in placed.collect()}
    assert got == cases


def ranks_by_hand(names, edges, seeds, forth, damping=0.85):
    n = len(names)
    at = {x: i for i, x in enumerate(names)}
    step, start = np.zeros((n, n)), np.array([seeds.get(x, 0) for x in names], float)
    start /= start.sum() or 1
    for (a, b), w in edges.items():
        step[(at[b], at[a]) if forth else (at[a], at[b])] += w
    sums = step.sum(axis=0)
    step = np.where(sums > 0, step / np.where(sums > 0, sums, 1), start[:, None])
    return dict(zip(names, np.linalg.solve(np.eye(n) - damping * step, (1 - damping) * start), strict=True))


def test_ranks_reach_far_hosts_among_many_seeds(spark):
    """One of 5,001 blocked hosts is linked to, by a chain of hosts; the others link nowhere."""
    seeds = spark.createDataFrame([("end", 0, 1), *[(f"s{k}", 0, 1) for k in range(5000)]], "host string, allowed int, blocked int")
    edges = spark.createDataFrame([("a", "end", 1), ("b", "a", 1), ("c", "b", 1)], "source string, target string, links int")
    ranks = {r["host"]: r["distrust"] for r in U.propagate(seeds, edges).filter("host in ('end', 'a', 'b', 'c')").collect()}
    assert ranks["a"] == pytest.approx(0.85 * ranks["end"], rel=0.01)
    assert ranks["b"] == pytest.approx(0.85 * ranks["a"], rel=0.01) and ranks["c"] == pytest.approx(0.85 * ranks["b"], rel=0.01)


def test_ranks_equal_the_linear_system(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{k}" for k in range(12)]
    edges = {(str(a), str(b)): int(rng.integers(1, 5)) for a, b in rng.choice(hosts, (30, 2)) if a != b}
    allowed, blocked = {"h1": 3, "h2": 1}, {"h5": 2, "alone": 4}
    seeds = spark.createDataFrame([(h, allowed.get(h, 0), blocked.get(h, 0)) for h in {*allowed, *blocked}], "host string, allowed long, blocked long")
    table = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "source string, target string, links long")
    names = sorted({*allowed, *blocked, *[x for e in edges for x in e]})
    trust, distrust = ranks_by_hand(names, edges, allowed, True), ranks_by_hand(names, edges, blocked, False)
    got = U.propagate(seeds, table, tolerance=1e-6).collect()
    assert {r["host"] for r in got} == set(names)
    for r in got:
        assert (r["trust"], r["distrust"]) == (pytest.approx(trust[r["host"]], abs=1e-5), pytest.approx(distrust[r["host"]], abs=1e-5))


def test_pages_without_a_rule_follow_their_links(spark):
    link = lambda *urls: "".join(f"<p><A class=x HREF='{u}'>t</a>" for u in urls)
    rows = [
        (1, "http://good.com/", link("http://friend.org/a", "/local")), (2, "http://bad.net/es/", "<a href=x>"), (3, "http://fan.org/", link("//bad.net/es/9", "https://BAD.net/")),
        (4, "http://friend.org/", None), (5, "http://stranger.org/", link("mailto:a@b")), (6, None, link("http://bad.net/es/")), (7, "http://bad.net/de/", ""), (4, "http://friend.org/", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = Counter((r["page_id"], r["verdict"], r["rule"]) for r in U.judge(pages, RULES).collect())
    assert got == Counter(
        [(1, "allow", "com/"), (2, "block", "net/es/"), (3, "block", None), (4, "allow", None), (4, "allow", None), (5, "allow", None), (6, "allow", None), (7, "block", None)]
    )
    assert U.judge(pages.limit(0), RULES).count() == 0


# Rules


def test_measures_by_hand(spark):
    rng = np.random.default_rng(9)
    texts = [None, "", " \n ", "one", "a b c d e", "a b c d e a b c d e", "a b c d e f a b c d", "x x x x x x x", "l1 a\nl1 a\n \nl1 a \nl1 a", "### $ a|b <c> é&", "word\x1cword\u00a0x y\x0bz", "tail\n", "same\n\nsame\n\nsame"]
    texts += [" ".join(rng.choice(list("abc"), n)) for n in (6, 12, 40, 3000)] + [" ".join(f"w{k}" for k in range(500)) * 2]
    got = {r["doc_id"]: r for r in Q.measure(frame(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        words = re.findall(SPACE, t or "")
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == (len(lines), len(lines) - len(set(lines)), len(covered)), t


def test_cascade_stops_at_the_first_rule_and_order_changes_no_verdict(spark):
    prose = " ".join(f"word{k} other{k}" for k in range(60))
    rows = [(1, prose), (2, prose.upper() + "!!" * 90), (3, "a b"), (4, " ".join(["** && |x|"] * 3 + [prose] * 0 + ["## $$"] * 9)), (5, None), (1, prose), (6, "\n".join(["same line of five words"] * 30))]
    docs = frame(spark, rows)
    measured, rules = Q.measure(docs), [*Q.base_rules(), *Q.further_rules()]
    for order in (rules, rules[::-1]):
        got = Counter((r["doc_id"], r["failed_rule"] is None) for r in Q.cascade(measured, order).collect())
        assert got == Counter([(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False)])
    never = Q.Rule("never", F.assert_true(F.lit(False)).isNotNull())  # fails where it is evaluated
    held = measured.filter("doc_id = 3")
    assert Q.cascade(held, [Q.base_rules()[0], never]).first()["failed_rule"] == "few words"
    ranked = Q.order_rules(measured, rules)
    gains = [share / seconds for _, share, seconds in ranked]
    assert gains == sorted(gains, reverse=True) and {r.name for r, _, _ in ranked} == {r.name for r in rules}
    assert Q.judge(docs.limit(0)).count() == 0

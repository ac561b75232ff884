"""Repeated passages, collocations and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from weekcast.llm import ball_codes as B, collocations as C, queries, substring_dedup as S
from weekcast.llm.byte_words import Words
from weekcast.llm.fm_index import FmIndex

FOLDER = "/root/testdata/sf0.001"
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), max_size=9), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 4))
def test_matching_statistics(given_sequences, least):
    sequences, weights = zip(*given_sequences, strict=True)
    ids = np.array([w for s in sequences for w in (*s, 0)])
    found = FmIndex(ids, np.array(weights)).matching_statistics(least)

    def weight(part):
        return sum(w * sum(s[i : i + len(part)] == part for i in range(len(s) - len(part) + 1)) for s, w in given_sequences)

    at = 0
    for s in sequences:
        for i in range(len(s)):
            longest = max(n for n in range(len(s) - i + 1) if n == 0 or weight(s[i : i + n]) >= least)
            assert found[at + i] == longest
        at += len(s) + 1


def test_word_hashes_do_not_depend_on_the_place():
    words = Words(b" \n")
    data = np.frombuffer(b"ab  cd ab\nabc " + b"x" * (1 << 20) + b" ab cd " + b"x" * (1 << 20), np.uint8)
    starts, ends = words.split(data)
    found = words.hashes(data, starts, ends).tolist()
    assert found[0] == found[2] == found[5] and found[1] == found[6] and found[4] == found[7] and len(set(found)) == 4


def what_is_left(rows, window):
    split = [BLANK_WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    left = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        left.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(left, key=str)


def copied_rows():
    pick = random.Random(3)
    source = [pick.choice("a b c".split()) for _ in range(60)]
    rows = [(None, None), (1, ""), (2, " \n"), (3, "x " * 50), (4, "y\tz " * 40), (5, "é ü " * 9)]
    for k in range(40):
        at = pick.randrange(50)
        words = source[at : at + pick.randrange(3, 40)]
        if pick.random() < 0.4:
            words.insert(pick.randrange(len(words)), "q")
        rows.append((k if k % 7 else None, " ".join(words)))
    return [*rows, rows[10], rows[10]]


@pytest.mark.parametrize("most_fragments", [4096, 2])
def test_repeated_passages_go(spark, most_fragments):
    rows = copied_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, places int, version string")
    found = S.deduplicated(docs, window=7, seed=3, most_fragments=most_fragments, shard_words=20).collect()
    assert sorted((tuple(r) for r in found), key=str) == what_is_left(rows, 7)


def test_no_documents_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.deduplicated(docs).collect() == []
    assert C.collocations(docs).collect() == []
    assert B.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))[0].collect() == []


def test_a_very_long_text(spark):
    words = [f"w{k % 1000}" for k in range(100_000)]
    found = S.deduplicated(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert found[0].n_words == found[0].n_removed == 100_000 and found[0].kept == ""


def test_op12_over_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in what_is_left(rows, 35)]
    assert sorted((tuple(r) for r in queries.op12_substring_dedup(spark, FOLDER).collect()), key=str) == want


def strongest(rows, least, per_lang):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts[lang].update(tuple(words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1))
    found = []
    for lang, count in counts.items():
        phrases = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in phrases.items():
            if not any(len(q) > len(p) and b >= a and inside(p, q) for q, b in phrases.items()):
                score, k = min((1000 * a * totals[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        found += [(lang, n, p.decode(), -a, lft, r, totals[lang], -s) for n, (s, a, p, lft, r) in enumerate(sorted(ranked)[:per_lang], 1)]
    return sorted(found)


def test_frequent_phrases_are_read_once(spark):
    """However many tasks hold a phrase, its words make one row; before, each task made one."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", None]), " ".join(rng.choice("ab cd, ef gh ij kl mn op".split()) for _ in range(60))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    dictionary = C.chunks(docs, spacing=5).repartition(12).cache()
    found = [tuple(r) for r in C.read_phrases(dictionary, least=8, bits=1 << 18).collect()]
    counts = Counter()
    for lang, text in rows:
        for piece in text.split(","):
            words = piece.split()
            for n in range(1, 6):
                counts.update((lang or "und", " ".join(words[i : i + n]), n) for i in range(len(words) - n + 1))
    assert sorted(found) == sorted((*k, c) for k, c in counts.items() if c >= 8)


def test_collocations(spark):
    pick = random.Random(5)
    tokens = ["x", "Y", "zz", "É", ".", "w\tw", "x  x", "!v", "\n"]
    rows = [(pick.choice([None, "a", "und", "b", ""]), " ".join(pick.choices(tokens, k=pick.randrange(60)))) for _ in range(300)]
    rows += [("a", None), (None, ""), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, places int, n int")
    found = C.collocations(docs, least=5, per_lang=50, spacing=3, bits=1 << 18).collect()
    assert sorted(tuple(r) for r in found) == strongest(rows, 5, 50)


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("a", "x y", 2, 10**12), ("a", "x", 1, 3 * 10**12), ("a", "y", 1, 10**12)], "lang string, phrase string, words int, count long")
    found = C.scored(phrases, spark.createDataFrame([("a", 10**14)], "lang string, n long")).collect()
    assert [r.score for r in found] == [1000 * 10**14 // (3 * 10**12)]


def test_op13_over_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in queries.op13_collocations(spark, FOLDER).collect()) == strongest(rows, 100, 2000)


def coded(rows, entries):
    kept = sorted((v, [math.floor(1024 * x) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e))
    points = np.array([k[1] for k in kept], np.int64)
    wide = points.shape[1] // 4
    parts = [points[:, k * wide : (k + 1) * wide] for k in range(4)]
    books = [p[:entries].copy() for p in parts]
    distances = lambda k: ((parts[k][:, None, :] - books[k][None, :, :]) ** 2).sum(axis=2)
    for _ in range(4):
        for k in range(4):
            nearest = distances(k).argmin(axis=1)
            for e in set(nearest.tolist()):
                books[k][e] = parts[k][nearest == e].sum(axis=0) // (nearest == e).sum()
    last = [distances(k) for k in range(4)]
    error = sum(d.min(axis=1) for d in last)
    of_label = Counter()
    for (_, _, lab), e in zip(kept, error.tolist(), strict=True):
        of_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return [(v, "".join(f"{d[n].argmin():02x}" for d in last), int(error[n]), of_label[lab]) for n, (v, _, lab) in enumerate(kept)], digest


def test_vector_codes_with_ties_and_faults(spark):
    pick = random.Random(1)
    single = lambda x: float(np.float32(x))
    rows = [(k, [single(pick.choice([0.0, 0.001, -0.5, 2.0, pick.random()])) for _ in range(8)], pick.choice([None, 1, 2])) for k in range(200)]
    bad = [(1000, None, 1), (1001, [1.0] * 7 + [None], 1), (1002, [math.nan] * 8, 2), (1003, [math.inf] * 8, 2), (1004, [1.0] * 3, None)]
    vectors = spark.createDataFrame([(*r, 0, "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, n int, code string").repartition(3)
    found, books = B.compress(vectors, entries=20)
    want, digest = coded(rows, 20)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found.collect()) == want
    assert B.books_digest(books) == digest


def test_very_large_components_are_measured_exactly(spark):
    rows = [(k, [1e30 * k, -3e5 * k, 1.0, 2.0], None) for k in range(5)]
    found, _ = B.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=2)
    assert [r.code for r in found.orderBy("vec_id").collect()] == ["00000000", "01000000", *["01010000"] * 3]


def test_trees_own_what_plain_search_finds():
    points = np.random.default_rng(4).integers(-40, 40, (700, 6))
    points[100:300] = points[5]
    tree = B.grow(points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(700))
    entries = points[:30]
    nearest, far, _, _ = B.assign(points, tree, entries, True)
    plain = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (nearest == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    _, _, sums, counts = B.assign(points, tree, entries, False)
    assert counts.tolist() == np.bincount(nearest, minlength=30).tolist()
    assert all((sums[e] == points[nearest == e].sum(axis=0)).all() for e in range(30))


def test_op11_over_the_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = coded(rows, 256)
    found = queries.op11_ball_codes(spark, FOLDER).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == want
    assert {r.codebooks_sha256 for r in found} == {digest}

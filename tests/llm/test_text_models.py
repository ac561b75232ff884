"""Toxic segments, the string kernel and the compression classifier: planted cases and brute force."""

import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weekcast.llm import string_kernel as K, toxic_segments as X, zstd_quality as Z
from weekcast.llm.rows import keep_rows
from weekcast.llm.training import fit_logistic, held_out, labelled_sample

SYLLABLES = ["ba", "ko", "mi", "ren", "tas", "ul", "ver", "son"]
EMPTY = [(None, None), (-1, None), (-2, ""), (-3, " \n "), (-4, "123 !?"), (5, "ba ko"), (5, "ba ko")]


def prose(rng, n=60, syllables=SYLLABLES):
    return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Rows (doc_id, text) with columns that clash with inner names."""
    return spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, y string")


def by_hand(scores):
    """Maximal scoring segments by definition: take the best segment (leftmost, then shortest), then look on both sides."""
    best = max(((sum(scores[a:b]), -a, -(b - a)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-9:
        return []
    a, b = -best[1], -best[1] - best[2]
    return by_hand(scores[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in by_hand(scores[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 6), max_size=14))
def test_maximal_segments_equal_their_definition(kinds):
    # Powers of two make sums distinct, so there are no ties.
    scores = [-0.37 if k <= 0 else k + 2.0 ** -(i + 5) for i, k in enumerate(kinds)]
    places = [i for i, k in enumerate(kinds) if k > 0]
    got = X.maximal_segments(places, [scores[i] for i in places], 0.37)
    assert [(a, b, pytest.approx(s)) for a, b, s in got] == by_hand(scores)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(600):
        words = prose(rng).split()
        bad = k % 5 == 0
        for _ in range(4 * bad):
            words.insert(int(rng.integers(0, len(words))), "vile" + str(rng.choice(SYLLABLES)))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), 1))
    docs, known = frame(spark, rows + EMPTY), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    return docs, known, dict(labels_of(labels))


def labels_of(labels):
    return [(k, y) for k, y, _ in labels]


def test_toxic_documents_are_found_with_their_passages(spark, toxic):
    docs, known, truth = toxic
    model = X.learn(docs, known, ~held_out(F.col("doc_id"), 4, 2))
    got = X.score(docs, model).withColumn("aside", held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(got) == 607 and all(0 <= r["score"] <= 1 for r in got)
    aside = [r for r in got if r["doc_id"] in truth and r["aside"]]
    assert len(aside) > 100
    wrong = [r for r in aside if (r["score"] >= 0.3) != bool(truth[r["doc_id"]])]
    assert len(wrong) <= 2
    assert all(r["passages"] for r in aside if r["score"] > 0.9)
    rest = X.without_toxic(docs, model, 0.3)
    assert rest.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in rest.collect()) == sorted(r["doc_id"] or 0 for r in got if r["score"] < 0.3)


def test_no_labels_no_texts(spark, toxic):
    docs, known, _ = toxic
    none, no_labels = docs.limit(0), known.limit(0)
    assert X.score(docs, X.learn(docs, no_labels, F.lit(True))).filter("score >= 0.3").count() == 0
    assert X.score(none, X.learn(none, known, F.lit(True))).count() == 0
    assert Z.score(docs, Z.learn(docs, no_labels, F.lit(True))).filter("score = 0.5").count() == docs.count()
    assert Z.score(none, None).count() == 0 and K.predict(none, None).count() == 0


def test_held_out_follows_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(40).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    assert spark.range(1).select(held_out(F.lit(None).cast("long"), 4, 2).alias("h")).first()["h"] is False


def test_labelled_sample_is_bounded_and_whole(spark):
    docs = frame(spark, [(k, "w" * k) for k in range(100)] + [(7, "other")] * 50)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)] + [(7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    got = labelled_sample(docs, labels, "toxic", F.col("toxic").isin(0, 1), {1: 30, 0: 100}, 20).collect()
    assert sum(r["y"] == 1 for r in got) == 30 and sum(r["y"] == 0 for r in got) == 50
    assert len({r["doc_id"] for r in got}) == 80 and all(len(r["text"]) <= 20 for r in got)


def test_languages_are_told_apart(spark):
    rng = np.random.default_rng(5)
    kinds = {"aa": ["ba", "ko", "mi"], "bb": ["ren", "tas", "ul"], "cc": ["ño", "ée", "üß"]}
    rows = [(k, prose(rng, 12, kinds[lang]), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(i, t, "aa" if i != -4 else None) for i, t in EMPTY] + [(1000, "ba KO mi " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = K.learn(docs, ~held_out(F.col("doc_id"), 4, 2))
    got = K.predict(docs, model).collect()
    truth = {k: lang for k, _, lang in rows if k is not None and 0 <= k < 180 and k != 5}
    assert len(got) == len(rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth) >= 0.98 * len(truth)
    unknown = [r for r in got if r["doc_id"] in (None, -1, -2, -3, -4)]
    assert len(unknown) == 5 and all(r["lang_pred"] == "und" and r["score"] == 0 for r in unknown)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 1000] == ["aa"]
    assert {r["lang_pred"] for r in K.predict(docs, None).collect()} == {"und"}


def test_kernel_is_the_share_of_common_grams():
    texts = ["abcab", "bcd", "xyz"]
    model = K.fit(texts, ["p", "q", "r"])
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    rows = K.presence(texts, model.features, len(model.landmarks))
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams]
    assert rows @ rows.T == pytest.approx(np.array(want), abs=1e-6)


def test_quality_by_compression(spark):
    rng = np.random.default_rng(7)
    rows = [(k, prose(rng, 80) if k % 2 else " ".join(w.upper() + "$$$" for w in prose(rng, 80).split())) for k in range(500)]
    docs = frame(spark, rows + EMPTY + [(999, prose(rng, 30_000))])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(500)], "doc_id long, quality int, toxic int")
    model = Z.learn(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    got = {r["doc_id"]: r["score"] for r in Z.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[k] >= 0.3) == bool(k % 2) for k in range(500) if k != 5) >= 490
    assert got[999] > 0.5
    assert Z.score(docs, model).count() == 508


def test_logistic_fit_recovers_a_line():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 2))
    y = rng.random(20_000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    assert fit_logistic(x, y.astype(float)) == pytest.approx([0.5, 2, -1], abs=0.1)
    assert fit_logistic(np.zeros((0, 2)), np.zeros(0)) == pytest.approx([0, 0, 0])


def test_keep_rows_keeps_columns(spark):
    docs = frame(spark, [(1, "a"), (2, None), (3, "b")])
    got = keep_rows(docs, lambda: lambda t: t is None or t == "b").collect()
    assert [(r["doc_id"], r["score"], r["y"]) for r in got] == [(2, 0.5, "x"), (3, 0.5, "x")]


def test_segments_of_many_lone_words_take_linear_time():
    """Each begins lower than all before it, so none is ever joined to another."""
    places = list(range(0, 2_000_000, 10))
    began = time.perf_counter()
    assert X.maximal_segments(places, [1.0] * len(places), 0.37) == [(p, p, pytest.approx(1.0)) for p in places]
    assert time.perf_counter() - began < 60


def test_kernel_sample_takes_repeated_rows_once(spark, monkeypatch):
    """Without an id, and copied so often that they would fill the driver."""
    taken = []
    monkeypatch.setattr(K, "fit", lambda texts, langs: taken.extend(zip(texts, langs, strict=True)))
    copies = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("always the same words").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("mot %06d", "id").alias("text"), F.lit("fr").alias("lang"))
    K.learn(copies.unionByName(others), F.lit(True), 100)
    langs = [lang for _, lang in taken]
    assert langs.count("en") == 1 and 50 < langs.count("fr") < 160

"""Toxic passages as maximum-scoring segments, and a document score by extreme-value statistics.

Each token gets the log-odds of occurring in toxic against other documents, shrunk by a Dirichlet prior; only
tokens whose log-odds are significant count (Monroe, Colaresi and Quinn, "Fightin' Words", 2008). An unknown
word takes the weight of its longest known beginning, all other words a small negative drift. A linear scan
finds all maximal scoring segments (Ruzzo and Tompa, 1999). The greatest of them follows an extreme-value law
in clean text, lambda * S - ln(K * n) (Karlin and Altschul, 1990), whose lambda and K are fitted on clean
documents; segments beyond it are significant passages, and a logistic fit turns them into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from weekcast.llm.rows import free_token_memory, keep_rows
from weekcast.llm.training import fit_logistic, labelled_sample, logistic

WORD = re.compile(r"\w+")
BEGINNINGS = (6, 5, 4)
#: Bounds of the fitted sample: documents of each class, characters of each, tokens of the model.
SAMPLE = {1: 8_000, 0: 16_000}
LONGEST = 20_000
MOST_TOKENS = 50_000
PRIOR = 0.5
LEAST_Z = 3.5
#: Less than this is a matter of language or topic, however significant.
LEAST_ODDS = 2.5
LEAST_DRIFT = 0.05
SIGNIFICANCE = 0.05
EULER = 0.5772156649015329


@dataclass(frozen=True)
class Model:
    """weights: of tokens; drift: of other words; scale, log_k: the extreme-value law; calibration: logistic weights."""

    weights: dict[str, float]
    drift: float
    scale: float = 1.0
    log_k: float = 0.0
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0)


def tokens(word: str) -> list[str]:
    """A word and its beginnings, longest first."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Weights(dict):
    """word -> weight (0.0: none), remembered for at most ``keep`` words."""

    def __init__(self, known: dict[str, float], keep: int = 100_000):
        super().__init__()
        self.known, self.keep = known, keep

    def __missing__(self, word: str) -> float:
        weight = next((self.known[t] for t in tokens(word) if t in self.known), 0.0)
        if len(self) >= self.keep:
            self.clear()
        if len(word) <= 64:
            self[word] = weight
        return weight


def maximal_segments(places: list[int], weights: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score) of a sequence in which each place not
    listed scores ``-drift``. Linear in the number of listed places; ties go to the shorter segment."""
    # First, last, sum before, sum up to the end, and the nearest earlier candidate with a lower sum before (or -1).
    found: list[tuple[int, int, float, float, int]] = []
    total, reached = 0.0, -1
    for place, weight in zip(places, weights, strict=True):
        total -= drift * (place - reached - 1)
        if weight <= 0:
            total, reached = total + weight, place
            continue
        first, left, right = place, total, total + weight
        total, reached = right, place
        k = len(found) - 1
        while True:
            # All between a candidate and the one it points to begin no lower than itself, so they are passed over.
            while k >= 0 and found[k][2] >= left:
                k = found[k][4]
            if k < 0 or found[k][3] >= right:
                break
            first, _, left, _, below = found[k]
            del found[k:]
            k = below
        found.append((first, place, left, right, k))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def scan(text: str | None, weights: Weights, model: Model) -> tuple[list[str], list[tuple[int, int, float]]]:
    """Words of a text and its maximal segments as word places."""
    words = WORD.findall(text.lower()) if text else []
    scored = np.fromiter(map(weights.__getitem__, words), float, len(words))
    places = np.flatnonzero(scored)
    return words, maximal_segments(places.tolist(), scored[places].tolist(), model.drift)


def features(n_words: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, float, int]:
    """Extreme value of the top segment, log of 1 + the summed excess of significant segments, and their number.

    A segment is significant if clean text of that length has one as good with probability ``SIGNIFICANCE`` or less.
    """
    log_n = np.log(max(n_words, 1))
    values = [model.scale * s - model.log_k - log_n for _, _, s in segments]
    least = -np.log(-np.log1p(-SIGNIFICANCE))
    beyond = [v for v in values if v >= least]
    top = max(values, default=-model.log_k - log_n)
    return float(np.clip(top, -20, 60)), float(np.log1p(sum(beyond))), len(beyond)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, toxic, others): how many documents of either kind have it; summed per batch."""
    free_token_memory()
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = set(WORD.findall(text.as_py().lower()))
            seen[y].update({t for w in words if len(w) <= 64 for t in tokens(w)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["token", "toxic", "others"]
        )


def _sample_features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights = Weights(model.weights)
    for batch in batches:
        rows = []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words, segments = scan(text.as_py(), weights, model)
            rows.append((y, len(words), max((s for _, _, s in segments), default=0.0), *features(len(words), segments, model)[:2]))
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["y", "n", "best", "top", "sum"])


def learn(docs: DataFrame, labels: DataFrame, learned: Column, sample: dict[int, int] | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows that ``learned`` allows (label ``toxic``).

    With no toxic or no other document in the sample nothing can be told apart; every score is then 0.
    """
    rows = labelled_sample(docs, labels, "toxic", learned & F.col("toxic").isin(0, 1), sample or SAMPLE, LONGEST).select("y", "text").persist()
    try:
        size = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n_toxic, n_others = size.get(1, 0), size.get(0, 0)
        if not n_toxic or not n_others:
            return Model({}, LEAST_DRIFT, calibration=(-30.0, 0.0, 0.0))
        counts = rows.mapInArrow(_counts, "token string, toxic long, others long").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("others").alias("o"))
        odds = F.log((F.col("t") + PRIOR) / (n_toxic - F.col("t") + PRIOR)) - F.log((F.col("o") + PRIOR) / (n_others - F.col("o") + PRIOR))
        z = odds / F.sqrt(1 / (F.col("t") + PRIOR) + 1 / (F.col("o") + PRIOR))
        told = counts.select("token", "t", "o", odds.alias("odds"), z.alias("z")).filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "token").limit(MOST_TOKENS).collect()
        weights = {r.token: r.odds for r in told}
        model = Model(weights, LEAST_DRIFT)
        seen = rows.mapInArrow(lambda b: _sample_features(b, model), "y long, n long, best double, top double, sum double")
        found = np.array([tuple(r) for r in seen.collect()])  # five numbers a sampled document
        clean = found[found[:, 0] == 0]
        # Clean text: each token's share of words, and the mean of lambda * S - ln n over documents.
        words = max(1.0, clean[:, 1].sum())
        pairs = [(r.odds, (r.o + PRIOR) / words) for r in told if not r.token.endswith("*")] or [(1.0, PRIOR / words)]
        s, p = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
        low, high = 1e-3, 20.0
        for _ in range(60):
            mid = (low + high) / 2
            grown = (p * np.exp(mid * s)).sum() + max(0.0, 1 - p.sum()) * np.exp(-mid * model.drift)
            low, high = (low, mid) if grown > 1 else (mid, high)
        scale = low
        log_k = float(np.mean(scale * clean[:, 2] - np.log(np.maximum(clean[:, 1], 1)))) - EULER
        model = Model(weights, model.drift, scale, log_k)
        seen = rows.mapInArrow(lambda b: _sample_features(b, model), "y long, n long, best double, top double, sum double")
        found = np.array([tuple(r) for r in seen.collect()])
    finally:
        rows.unpersist()
    # Weighted back to the classes' shares among labelled documents is not needed: the threshold is on the sample's scale.
    fitted = fit_logistic(found[:, 3:5], found[:, 0])
    return Model(weights, model.drift, scale, log_k, tuple(float(w) for w in fitted))


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    weights, calibration = Weights(model.weights), np.array(model.calibration)
    passage = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64())]))
    least = -np.log(-np.log1p(-SIGNIFICANCE))
    for batch in batches:
        values, passages = [], []
        for text in batch.column(1):
            words, segments = scan(text.as_py(), weights, model)
            values.append(features(len(words), segments, model)[:2])
            bound = (least + model.log_k + np.log(max(len(words), 1))) / model.scale
            passages.append([{"first_word": a, "last_word": b, "score": s} for a, b, s in segments if s >= bound])
        score = logistic(calibration, np.array(values).reshape(-1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(passages, passage)], ["doc_id", "score", "passages"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and significant passages (word places) of every row of ``docs`` (doc_id, text).

    Whole texts are scanned; a null or empty text has no passage and scores as clean text without words;
    repeated rows stay; other columns aren't read. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _scores(b, model), "doc_id long, score double, passages array<struct<first_word:int,last_word:int,score:double>>")


def without_toxic(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of ``docs`` that score below ``least``, with all their columns."""

    def test():
        weights, calibration = Weights(model.weights), np.array(model.calibration)

        def passes(text: str | None) -> bool:
            words, segments = scan(text, weights, model)
            return bool(logistic(calibration, np.array([features(len(words), segments, model)[:2]]))[0] < least)

        return passes

    return keep_rows(docs, test)

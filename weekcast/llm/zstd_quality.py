"""Text quality by compression: how much better does a dictionary of good texts compress it than one of bad texts?

Two zstandard dictionaries are built from excerpts of labelled good and bad texts. Every text is compressed in
blocks against both, so a long text can't outgrow the dictionaries; the difference of the compressed sizes, as
a share of their sum, is the text's value (Benedetto, Caglioti and Loreto, "Language trees and zipping", 2002).
Beside it stand the difference in the worst block and the share of bytes that is left. A logistic fit on labelled texts that weren't put into the dictionaries turns the value into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from weekcast.llm.training import fit_logistic, labelled_sample, logistic

#: Bounds of the fitted sample: documents of each class, characters of each.
SAMPLE = {1: 1_600, 0: 1_600}
LONGEST = 6_000
DICTIONARY_BYTES = 1 << 18
LEVEL = 3
BLOCK = 4_096
#: Prose keeps more than this share of its bytes.
SPARED = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    calibration: tuple[float, ...]


class Measure:
    """Compressors of one model; made anew in each task, for they can't be sent."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for content in (good, bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def values(self, text: str | None) -> tuple[float, float, float]:
        """Normalised size difference over all blocks (positive: good compresses it better), that of the worst block,
        and how far the good dictionary brings the text down, for endless repetition goes down to nothing with either."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.compressors
        g = [len(good.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)]
        b = [len(bad.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)]
        if not g:
            return 0.0, 0.0, 0.0
        worst = min((y - x) / (x + y) for x, y in zip(g, b, strict=True))
        return (sum(b) - sum(g)) / (sum(b) + sum(g)), worst, min(0.0, math.log(sum(g) / (SPARED * len(data) + 1)))


def dictionary(texts: list[str]) -> bytes:
    """A dictionary of the given texts: trained where there is enough to train on, else the texts themselves."""
    samples = [part for t in texts if (data := t.encode("utf-8", "surrogatepass")) for part in (data[i : i + BLOCK] for i in range(0, len(data), BLOCK))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def fit(texts: list[str], labels: list[int]) -> Model | None:
    """Fit on texts with labels 1 (good) and 0 (bad): three quarters make the dictionaries, the rest the calibration.

    None if either class is missing.
    """
    if len(set(labels)) < 2:
        return None
    parts = {y: [t for t, l in zip(texts, labels, strict=True) if l == y] for y in (0, 1)}
    aside = {y: max(1, len(p) // 4) for y, p in parts.items()}
    good, bad = (dictionary(parts[y][aside[y] :] or parts[y]) for y in (1, 0))
    measure = Measure(good, bad)
    seen = [(measure.values(t), y) for y in (0, 1) for t in parts[y][: aside[y]]]
    weights = fit_logistic(np.array([v for v, _ in seen]), np.array([y for _, y in seen], float), ridge=1e-4)
    return Model(good, bad, tuple(float(w) for w in weights))


def learn(docs: DataFrame, labels: DataFrame, learned: Column, sample: dict[int, int] | None = None) -> Model | None:
    """Fit on a bounded sample of the labelled rows that ``learned`` allows (label ``quality``)."""
    rows = labelled_sample(docs, labels, "quality", learned & F.col("quality").isin(0, 1), sample or SAMPLE, LONGEST)
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([r.text for r in found], [r.y for r in found])


def _scores(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    measure = Measure(model.good, model.bad) if model else None
    for batch in batches:
        if measure:
            values = np.array([measure.values(t.as_py()) for t in batch.column(1)]).reshape(-1, 3)
            score = logistic(np.array(model.calibration), values)
        else:
            score = np.full(batch.num_rows, 0.5)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (higher: better) of every row of ``docs``, from its whole text.

    A null or empty text is compressed to nothing by both and takes the score of no difference; without a model
    every score is 0.5. Repeated rows stay; other columns aren't read. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _scores(b, model), "doc_id long, score double")

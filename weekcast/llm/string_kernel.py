"""Language identification by a string kernel with Nyström landmarks.

The kernel compares two texts by the character n-grams both have: blended over lengths 1 to 3, by presence,
normalised by the size of either set (Lodhi et al., 2002; presence bits as in Ionescu and Popescu, 2014). A
set of landmark texts spans the Nyström space; kernel ridge regression, one against the rest for each
language, is solved there (Williams and Seeger, 2001). The n-grams of the landmarks are the kernel's features.
A batch of texts is scored by two matrix products: presence x landmarks, then kernel x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
TABLE_BITS = 20
#: Bounds of the fitted sample: expected documents of a language, their characters, and landmarks.
PER_LANGUAGE = 250
LONGEST = 3_000
LANDMARKS = 24
RIDGE = 1e-3


@dataclass(frozen=True)
class Model:
    """features: table slot -> feature or -1; landmarks: features x landmarks, normalised; weights: landmarks x languages."""

    languages: tuple[str, ...]
    features: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray


def slots(text: str) -> np.ndarray:
    """Table slots of all n-grams of a text, lower-cased, white space as one kind of character."""
    letters = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, code = [], np.zeros(len(letters), np.uint64)
    for n in range(3):
        if len(letters) <= n:
            break
        code = code[: len(letters) - n] * np.uint64(0x110001) + letters[n:] + np.uint64(1)
        found.append((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def presence(texts: list[str], features: np.ndarray, width: int) -> np.ndarray:
    """Texts x features: 1 where the text has the n-gram, rows scaled to length 1."""
    bits = np.zeros((len(texts), width + 1), np.float32)
    for row, text in zip(bits, texts, strict=True):
        row[features[slots(text)]] = 1  # features that no landmark has fall on the last place
    bits = bits[:, :width]
    return bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))


def fit(texts: list[str], langs: list[str]) -> Model:
    """Fit on the given texts; the landmarks are the first texts of each language."""
    languages = tuple(sorted(set(langs)))
    places = np.array([languages.index(x) for x in langs])
    marks = [i for k in range(len(languages)) for i in np.flatnonzero(places == k)[:LANDMARKS]]
    features = np.full(1 << TABLE_BITS, -1, np.int32)
    used = np.unique(np.concatenate([slots(texts[i]) for i in marks] or [np.zeros(0, np.int64)]))
    features[used] = np.arange(len(used))
    landmarks = presence([texts[i] for i in marks], features, len(used)).T
    kernel = presence(texts, features, len(used)) @ landmarks
    target = np.where(places[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs the same, however many of its texts were sampled.
    weight = (1 / np.maximum(np.bincount(places, minlength=len(languages)), 1))[places][:, None]
    inner = kernel[[*marks]]
    left = kernel.T @ (weight * kernel) + RIDGE * (inner + inner.T) / 2 + 1e-6 * np.eye(len(marks))
    weights = np.linalg.solve(left.astype(float), (kernel.T @ (weight * target)).astype(float))
    return Model(languages, features, np.ascontiguousarray(landmarks), weights.astype(np.float32))


def learn(docs: DataFrame, learned: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a sample of the rows that ``learned`` allows and that have a language; None without any.

    About ``per_language`` different rows of each language are taken by a hash of id and text, however often they are
    repeated, each by an excerpt of at most ``LONGEST`` characters, so what the driver gets is bounded by the number of
    languages.
    """
    known = docs.select("doc_id", "text", "lang").filter(learned & F.col("lang").isNotNull() & F.regexp_like("text", F.lit(r"\p{L}")))
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    shares = known.groupBy("lang").agg(F.approx_count_distinct(spot).alias("_n")).select("lang", (F.lit(float(per_language)) * (1 << 30) / F.col("_n")).alias("_most"))
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length("text") - LONGEST + 1)) + 1
    # A row per language, of which the model is made anyway: small, and without a shuffle of texts by language.
    rows = (
        known.join(F.broadcast(shares), "lang")
        .filter(spot < F.col("_most"))
        .select("lang", F.substr("text", first.cast("int"), F.lit(LONGEST)).alias("text"), spot.alias("_spot"))
        .dropDuplicates(["lang", "_spot"])
        .orderBy("_spot", "text")
        .collect()
    )
    rows = [r for r in rows if LETTER.search(r.text)]
    return fit([r.text for r in rows], [r.lang for r in rows]) if rows else None


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            told = np.array([bool(LETTER.search(t)) for t in texts])
            if model and told.any():
                kernel = presence([t for t, ok in zip(texts, told, strict=True) if ok], model.features, len(model.landmarks)) @ model.landmarks
                margins = kernel @ model.weights
                best = margins.argmax(axis=1)
                langs[told] = np.array(model.languages, object)[best]
                scores[told] = np.clip((1 + margins.max(axis=1)) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs``, from its whole text.

    A null text or one without a letter is ``und`` with score 0, and so is every text without a model. Ties go to
    the language first in order. Repeated rows stay; other columns aren't read. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda b: _predict(b, model), "doc_id long, lang_pred string, score double")

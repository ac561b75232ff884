"""Bounded labelled samples, and the small fits that calibrate a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


LONG_WORD = 8


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def by_hash(doc_id: str = "doc_id") -> list[Column]:
    """A fixed order that has nothing to do with the order of ids."""
    return [F.xxhash64(doc_id), F.col(doc_id)]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learned: Column, per_class: dict[int, int], longest: int) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class[y]`` labelled documents of each class y.

    ``learned`` says which rows of ``labels`` may be learned from. Documents are chosen by a hash of their id;
    of a document labelled both ways the larger label counts; of an id with several texts the least excerpt
    is taken, and so is one of near-copies, which show the same three least hashes of long words, for copies
    are no further evidence. A text longer than ``longest`` characters gives an excerpt that begins at a place chosen by hash,
    so the sample's size in bytes is bounded too.
    """
    known = labels.filter(learned & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = [known.filter(F.col("y") == y).orderBy(*by_hash()).limit(n) for y, n in per_class.items()]
    ids = chosen[0]
    for more in chosen[1:]:
        ids = ids.unionByName(more)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.lit(1), F.length(text) - longest + 1)) + 1
    excerpt = F.substr(text, first.cast("int"), F.lit(longest))
    # At most sum(per_class) rows of two numbers.
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min(excerpt).alias("text"))
    long = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= LONG_WORD)
    marks = F.slice(F.sort_array(F.array_distinct(F.transform(long, lambda w: F.xxhash64(w)))), 1, 3)
    own = F.when(F.size("_marks") < 3, F.col("doc_id"))
    copies = sample.withColumn("_marks", marks).groupBy("y", "_marks", own.alias("_own"))
    return copies.agg(F.min_by(F.struct("doc_id", "text"), F.xxhash64("doc_id")).alias("_one")).select("_one.doc_id", "y", "_one.text")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression by Newton steps; without rows, zeros."""
    design = np.column_stack([np.ones(len(x)), x]).astype(float)
    weights = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(weights))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (p - y) + penalty @ weights
        bend = (design.T * (p * (1 - p) + 1e-9)) @ design + penalty
        step = np.linalg.solve(bend, slope)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def logistic(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))

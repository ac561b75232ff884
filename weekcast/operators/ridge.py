"""Ridge regression on standardised features, solved from moments.

The table of fits has one row per (scope, origin, horizon, model), so its size is set by the
calendar. Its rows are spread over tasks and each task solves its own small linear systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weekcast.constants import (
    FEATURES,
    MIN_TRAIN_FAMILIES,
    MIN_TRAIN_ORIGINS,
    MIN_TRAIN_ROWS,
    RIDGE_ALPHA,
    RIDGE_MODELS,
)
from weekcast.operators.moments import CENTERS, FIT_KEYS, PAIRS, X_SUMS, XX_SUMS, XY_SUMS

FIT_SCHEMA = (
    "scope string, horizon_weeks int, model string, origin date, alpha double, features array<string>, "
    "scaler_mean array<double>, scaler_scale array<double>, coefficients array<double>, intercept double, "
    "weights array<double>, bias double"
)
SHIFT = np.array([CENTERS.get(name, 0.0) for name in FEATURES])
FLAT = 1e-12  # relative variance below which a feature counts as constant


def solve(model: str, n: float, x: np.ndarray, xx: np.ndarray, xy: np.ndarray, y: float, alpha: float = RIDGE_ALPHA):
    """Fit one model from its moments; ``weights``/``bias`` apply to raw features of all models."""
    use = [FEATURES.index(name) for name in RIDGE_MODELS[model]]
    mean, y_mean = x[use] / n, y / n
    second = xx[np.ix_(use, use)] / n
    cov = second - np.outer(mean, mean)
    var = np.diag(cov).copy()
    flat = var <= FLAT * np.maximum(np.diag(second), 1e-300)
    scale = np.sqrt(np.where(flat, 1.0, var))
    cross = (xy[use] / n - mean * y_mean) / scale
    corr = cov / np.outer(scale, scale)
    # A constant feature is exactly 0 after centring and so gets no weight.
    corr[flat, :] = corr[:, flat] = cross[flat] = 0.0
    beta = np.linalg.solve(n * corr + alpha * np.eye(len(use)), n * cross)
    raw_mean = mean + SHIFT[use]
    weights = np.zeros(len(FEATURES))
    weights[use] = beta / scale
    return {
        "features": list(RIDGE_MODELS[model]),
        "scaler_mean": raw_mean.tolist(),
        "scaler_scale": scale.tolist(),
        "coefficients": beta.tolist(),
        "intercept": float(y_mean),
        "weights": weights.tolist(),
        "bias": float(y_mean - raw_mean @ weights[use]),
    }


def _solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    width = len(FEATURES)
    for batch in batches:
        rows = []
        for fit in batch.to_dict("records"):
            xx = np.zeros((width, width))
            for (i, j), value in zip(PAIRS, fit["xx"]):
                xx[i, j] = xx[j, i] = value
            solution = solve(fit["model"], fit["n"], np.array(fit["x"]), xx, np.array(fit["xy"]), fit["y"])
            rows.append({**{k: fit[k] for k in (*FIT_KEYS, "origin")}, "alpha": RIDGE_ALPHA, **solution})
        columns = [part.split()[0] for part in FIT_SCHEMA.split(", ")]
        yield pd.DataFrame(rows, columns=columns)


def enough_training(sets: DataFrame) -> DataFrame:
    return sets.filter(
        (F.col("n") >= MIN_TRAIN_ROWS)
        & (F.col("n_families") >= MIN_TRAIN_FAMILIES)
        & (F.col("n_origins") >= MIN_TRAIN_ORIGINS)
    )


def fit_ridge(sets: DataFrame) -> DataFrame:
    """Fitted parameters of every training set that passes the gates."""
    packed = enough_training(sets).select(
        *FIT_KEYS,
        "origin",
        "n",
        "y",
        F.array(*X_SUMS).alias("x"),
        F.array(*XX_SUMS).alias("xx"),
        F.array(*XY_SUMS).alias("xy"),
    )
    return packed.mapInPandas(_solve_batches, FIT_SCHEMA)


def coefficient_table(fits: DataFrame, scope: str) -> DataFrame:
    """One row per (origin, horizon) with a nullable (bias, weights) column per ridge model."""
    packed = F.struct("bias", "weights")
    return (
        fits.filter(F.col("scope") == scope)
        .groupBy("origin", "horizon_weeks")
        .agg(*[F.max(F.when(F.col("model") == model, packed)).alias(f"fit_{model}") for model in RIDGE_MODELS])
    )

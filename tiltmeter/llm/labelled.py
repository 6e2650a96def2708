"""Labelled samples and one-dimensional calibration, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a model is fitted on, at most: those with the least hash of their id.
PER_CLASS = 4000


def fold(id_col: str, folds: int):
    """The remainder of CRC-32 of the id's decimal digits."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, folds: int, held_out: int,
    per_class: int = PER_CLASS,
) -> tuple[DataFrame, dict[int, int]]:
    """``(id, label, text)`` of a bounded sample outside the held-out fold, and all training rows of each class.

    Rows with a null id or a label other than 0 and 1 are left out; of repeated ids the larger label counts.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, folds) != held_out))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label_col).cast("int").alias("label"))
    )
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "label", "text"), counts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a stratified sample the class shares of all training rows."""
    total = max(1, counts[0] + counts[1])
    of = {c: counts[c] / total / max(1e-9, float((y == c).mean())) for c in (0, 1)}
    return np.array([of[int(c)] for c in y]) if len(y) else np.zeros(0)


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of ``y`` on ``x``, slightly shrunk so that it exists."""
    if not len(x):
        return 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(design @ theta)
        slope = design.T @ (weight * (y - p)) - 1e-3 * theta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])

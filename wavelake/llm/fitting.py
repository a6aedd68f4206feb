"""Fitting small models: a bounded labelled sample, one task that fits, helpers for calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(labels: DataFrame, rows: int, seed: str) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, label), picked by a hash of doc_id; null ids or labels don't count.

    A doc_id with several labels counts once, with the smallest.
    """
    once = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    return once.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label) of a bounded sample: small by construction, so its ids may be broadcast."""
    ids = sample.select(F.col("doc_id").alias("_id"), "label")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")


def fit_in_task(sample: DataFrame, fit: Callable[[pd.DataFrame], object]) -> object:
    """Runs ``fit`` on the whole bounded sample in one task, in order of doc_id, and returns the (small) model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=sample_columns)
        rows = rows.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)
        yield pd.DataFrame({"model": [pickle.dumps(fit(rows))]})

    sample_columns = sample.columns
    row = sample.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(row.model) if row else fit(pd.DataFrame(columns=sample_columns))  # the planner drops empty input


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def platt_scale(z: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that sigmoid(a z + b) fits the labels; Newton steps on smoothed targets."""
    positive, negative = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        gap, w = p - goal, p * (1 - p) + 1e-9
        gradient = np.array([gap @ z + 1e-3 * (a - 1), gap.sum()])
        curve = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-9]])
        step = np.linalg.solve(curve, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step heights of y over z, by pooling neighbours that are out of order: (knots, heights)."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # [sum, count, first z, last z]
    for value, label in zip(z[order], y[order], strict=True):
        if blocks and blocks[-1][3] == value:
            blocks[-1][0] += label
            blocks[-1][1] += 1
        else:
            blocks.append([float(label), 1.0, value, value])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    heights = np.array([b[0] / b[1] for b in blocks for _ in range(2)])
    return knots, heights

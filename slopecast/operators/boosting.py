"""Gradient boosting of several models on one table: each model and class is a group that holds its rows as codes.

Spark's own boosting runs a few jobs a level of every tree; here a group makes all rounds of one class against the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.operators.forests import BINS, Plan, Reading, dealt_codes, unpacked_codes


def regression_tree(codes: np.ndarray, target: np.ndarray, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """What a tree of least squares over all bins gives the rows it learns and the rows asked; codes have a row a feature."""
    slot, at = np.zeros(len(target), np.int64), np.zeros(asked.shape[1], np.int64)
    for level in range(depth):
        nodes = 1 << level
        base = slot * BINS
        cells = [base + c for c in codes]
        n, s = (np.stack([np.bincount(c, w, nodes * BINS) for c in cells]).reshape(len(codes), nodes, BINS).cumsum(axis=2) for w in (None, target))
        count, total = n[:, :, -1:], s[:, :, -1:]
        fair = (n > 0) & (n < count)
        of = lambda a, b: np.divide(a * a, b, out=np.zeros(a.shape), where=b > 0)
        gain = np.where(fair, of(s, n) + of(total - s, count - n) - of(total, count), 0.0).transpose(1, 0, 2).reshape(nodes, -1)
        best = gain.argmax(axis=1)
        feature, cut = best // BINS, np.where(gain.max(axis=1) > 1e-12, best % BINS, BINS)  # all rows stay low without a gain
        slot = slot * 2 + (codes[feature[slot], np.arange(len(slot))] > cut[slot])
        at = at * 2 + (asked[feature[at], np.arange(len(at))] > cut[at])
    n, s = np.bincount(slot, minlength=1 << depth), np.bincount(slot, target, 1 << depth)
    means = np.divide(s, n, out=np.zeros(len(s)), where=n > 0)
    return means[slot], means[at]


def margins(codes: np.ndarray, positive: np.ndarray, asked: np.ndarray, rounds: int, rate: float, depth: int) -> np.ndarray:
    """Margins of the rows asked by boosted trees of logistic loss: the first one is fitted to labels of -1 and 1 and counts in
    full, the others to the loss's gradient, and count by the rate."""
    codes, asked = np.ascontiguousarray(codes.T), np.ascontiguousarray(asked.T)
    label = np.where(positive, 1.0, -1.0)
    own, out = regression_tree(codes, label, asked, depth)
    for _ in range(rounds - 1):
        learned, given = regression_tree(codes, 4.0 * label / (1.0 + np.exp(2.0 * label * own)), asked, depth)
        own, out = own + rate * learned, out + rate * given
    return out


def boosted(df: DataFrame, plans: Sequence[Plan], readings: Sequence[Reading], rounds: int, rate: float = 0.1, depth: int = 3) -> DataFrame:
    """(model, _row, margins): for each row that asks a model, the margin of each class against the rest; df as in
    forests.dealt_codes. Rows are learned in the order of their keys, so a fit is repeatable on any cluster."""
    classes = max(len(p.weights) for p in plans)
    held, of_number = dealt_codes(df, plans, readings, classes)

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        m, k = of_number[int(frame["g"].iloc[0])]
        own, keys, y, asked, row = unpacked_codes(frame)
        order = np.lexsort((y, keys))
        found = margins(own[order], y[order] == k, asked, rounds, rate, depth) if len(own) else np.zeros(len(row))
        return pd.DataFrame({"model": np.full(len(row), m, np.int32), "_row": row, "class": np.full(len(row), k, np.int32), "margin": found})

    parts = held.groupBy("g").applyInPandas(fitted, "model int, _row long, class int, margin double")
    each = parts.groupBy("model", "_row").agg(F.sort_array(F.collect_list(F.struct("class", "margin"))).alias("all"))  # one a class
    return each.select("model", "_row", F.col("all.margin").alias("margins"))

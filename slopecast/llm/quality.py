"""Quality classifier: Naive Bayes scaled n-gram indicators, fitted by dual coordinate descent."""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slopecast.llm.common import map_batches, settle, ship, text_or_empty
from slopecast.llm.svm import fit_hinge, gram_codes, platt, sigmoid, slices

#: Byte n-grams, case kept; each width has its own range of hash codes.
WIDTHS = (1, 2, 3, 4)
BITS = 15
#: Word n-grams of one word said again: a code for each length from 2 on, and for each 32nd of the
#: text's word pairs that are such repeats.
REPEATS = 32
SHARES = 32
DIMS = (len(WIDTHS) << BITS) + REPEATS + SHARES
SMOOTHING = 1.0
COST = 1.0
#: Share of the interpolation between the fitted weights and their mean size.
BLEND = 0.25
#: Labelled documents of each class that the hinge-loss model is fitted on; the counts cover all.
SAMPLE_PER_CLASS = 1500
FOLDS = 3
THRESHOLD = 0.3


def indicators(text: str) -> np.ndarray:
    """Sorted codes of the n-grams that occur in the whole text: bytes, and words said again."""
    seen = np.zeros(DIMS, bool)
    raw = text.encode("utf-8", "surrogatepass")
    for k, width in enumerate(WIDTHS):
        for part in slices(raw, width):
            seen[gram_codes(part, width, BITS) + (k << BITS)] = True
    words = text.split()
    same = list(map(operator.eq, words, itertools.islice(words, 1, None)))
    if again := sum(same):
        longest = max(sum(run) for equal, run in itertools.groupby(same) if equal)
        base = len(WIDTHS) << BITS
        seen[base:base + min(longest, REPEATS)] = True
        seen[base + REPEATS:base + REPEATS + -(-again * SHARES // len(same))] = True
    return np.flatnonzero(seen)


def log_count_ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """log of the smoothed shares of the n-grams' document counts, class 1 over class 0."""
    p, q = positive + SMOOTHING, negative + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


@dataclass
class Model:
    """A linear score over indicators divided by the root of their number, and its logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, codes: np.ndarray) -> float:
        return float(self.weights[codes].sum() / max(1.0, np.sqrt(len(codes))) + self.bias)

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.slope * self.margin(indicators(text or "")) + self.offset))


def _fit_margin(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    scaled = [(c, ratios[c] / max(1.0, np.sqrt(len(c)))) for c in rows]
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    w = fit_hinge(scaled, signs, DIMS, COST, cost_of=0.5 / np.maximum(share, 1e-9))
    body = (1 - BLEND) * w[:-1] + BLEND * np.abs(w[:-1]).mean()
    return body * ratios, float(w[-1])


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, prior: float) -> Model:
    """Hinge-loss weights over the scaled indicators, and a curve through cross-validated margins.

    prior is the share of label 1 among all labelled rows, to which the sample is weighed. With one
    class only, or no rows, the score is the prior for every text.
    """
    if len(set(labels.tolist())) < 2:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(DIMS), 0.0, 0.0, float(np.log(p / (1 - p))))
    signs = np.where(labels == 1, 1.0, -1.0)
    fold = np.zeros(len(rows), int)
    for s in (1.0, -1.0):
        mine = np.flatnonzero(signs == s)
        fold[mine] = np.arange(len(mine)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        train = np.flatnonzero(fold != k)
        if len(set(signs[train].tolist())) < 2:
            continue
        model = Model(*_fit_margin([rows[i] for i in train], signs[train], ratios), 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margins[i] = model.margin(rows[i])
    share = (signs > 0).mean()
    weight = np.where(signs > 0, prior / share, (1 - prior) / (1 - share))
    slope, offset = platt(margins, signs > 0, weight)
    return Model(*_fit_margin(rows, signs, ratios), slope, offset)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on labelled documents for which allowed holds.

    The log-count ratios count the n-grams of every allowed labelled document, summed by task and
    code before the shuffle; the hinge-loss model sees up to `sample` documents of each class, those
    with the least id hashes. A null text is an empty one; null ids and labels other than 0 and 1 do
    not count; a document with several labels counts with each.
    """
    texts = docs.where(allowed).select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    marks = settle(marks.join(texts.select("__id"), "__id", "left_semi"), "marks")  # ids only; texts move once, below

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, DIMS + 1), np.int64)  # the last one counts documents
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[label, indicators(text.as_py())] += 1
                total[label, DIMS] += 1
        label, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(code, pa.int32()), pa.array(total[label, code], pa.int64())], names=["label", "code", "n"])

    # a merge join at every size: where few labels would be broadcast and many not, cost would jump in between
    labelled = texts.join(marks.hint("merge"), "__id")
    counts = map_batches(labelled.select("label", "text"), add, "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((2, DIMS + 1), np.int64)  # 2 x (DIMS + 1) numbers, whatever the input
    total[counts["label"], counts["code"]] = counts["n"]
    sizes = total[:, DIMS]
    total = total[:, :DIMS]

    unit = F.pmod(F.xxhash64(F.col("__id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = unit * F.when(F.col("label") == 1, int(sizes[1])).otherwise(int(sizes[0]))
    thin = marks.withColumn("unit", unit).where(share < 3.0 * sample)
    picks = thin.withColumn("place", F.row_number().over(W.partitionBy("label").orderBy("unit", "__id"))).where(F.col("place") <= sample)
    ranked = texts.join(F.broadcast(picks.drop("place")), "__id")  # at most two times `sample` ids
    ranked = ranked.groupBy("__id", "label", "unit").agg(F.min("text").alias("text"))  # a repeated id counts once here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [indicators(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["label", "unit", "codes"])

    rows = map_batches(ranked.select("label", "unit", "text"), run, "label int, unit double, codes binary").collect()
    picked = sorted(rows, key=lambda r: (r["unit"], r["label"], r["codes"]))
    prior = float(sizes[1] / sizes.sum()) if sizes.sum() else 0.5
    return fit([np.frombuffer(r["codes"], "<i4") for r in picked], np.array([r["label"] for r in picked], int), log_count_ratios(total[1], total[0]), prior)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column with the score of the whole text, 0 to 1, higher where label 1 is likelier; null is empty."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return score(F.col(text_col))

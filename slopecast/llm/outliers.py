"""Robust multivariate outliers: statistics of texts and minimum-covariance-determinant estimates a group."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import map_batches, settle, ship, text_or_empty

WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Share of a group's rows that the estimate is made from, least rows of a group with its own estimate.
COVERED, LEAST_ROWS = 0.75, 200
#: Least standard deviation of each statistic: the logarithm of the word length, and the square roots of the shares
#: of symbols, repeated lines and repeated words. Most texts have none of the latter three.
LEAST_SPREAD = (0.04, 0.1, 0.2, 0.2)
#: Words of the group's mean length that join those of a text, so that short texts do not stand out by chance.
MEAN_WORDS = 64
DIMS = len(LEAST_SPREAD)
#: Chance of a row of a normal group to be rejected.
REJECTED = 1e-6
STEPS, SETTLED = 15, 1e-3
BINS_PER_OCTAVE, OCTAVES = 16, 20
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
PARAMS = "group long, start int, centre array<double>, precision array<double>, logdet double"


def statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); lines without a word do not count."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
    order = np.argsort(rolled, kind="stable")
    same = np.diff(rolled[order]) == 0
    if not same.any():
        return 0
    # windows of equal codes are told apart by their words
    likely = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])].tolist()
    windows = [tuple(words[i:i + WINDOW]) for i in likely]
    seen = Counter(windows)
    starts = np.zeros(len(words) + 1, np.int64)
    for i, window in zip(likely, windows):
        if seen[window] > 1:
            starts[i] += 1
            starts[i + WINDOW] -= 1
    return int((np.cumsum(starts) > 0).sum())


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, text_hash, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed) a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(4).to_pylist()], np.int64).reshape(-1, 6)
            columns = [pa.array(made[:, k]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["id", "text_hash", "lang", "source", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), text.alias("text"))
    made = map_batches(source, run, "id long, text_hash long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return made.withColumn("base_failed", failed)


def _key(*names: str) -> Column:
    return F.xxhash64(F.lit(len(names)), *[x for n in names for x in (F.col(n).isNull(), F.col(n))])


def with_vectors(base: DataFrame) -> DataFrame:
    """base (settled) with `group` and the vector z0 to z3 of the rows that pass the base rules.

    A language and source of LEAST_ROWS passing rows or more is a group; the smaller ones of a language are
    one group if they have as many, else they join those of all languages, and if those are fewer still,
    the group is null and nothing is rejected.
    """
    passed = base.where(~F.col("base_failed"))
    own = passed.groupBy(_key("lang", "source").alias("pair"), _key("lang").alias("tongue")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_words").alias("words"), F.sum("word_chars").alias("chars")
    )
    own = settle(own, "groups")
    small = own.where(F.col("rows") < LEAST_ROWS)
    pooled = small.groupBy("tongue").agg(F.sum("rows").alias("pooled"))
    total = pooled.where(F.col("pooled") < LEAST_ROWS).agg(F.coalesce(F.sum("pooled"), F.lit(0)).alias("rest"))
    placed = own.join(pooled, "tongue", "left").join(F.broadcast(total))  # one row
    group = (
        F.when(F.col("rows") >= LEAST_ROWS, F.col("pair")).when(F.col("pooled") >= LEAST_ROWS, F.col("tongue"))
        .when(F.col("rest") >= LEAST_ROWS, F.lit(0).cast("long"))
    )
    placed = placed.select("pair", group.alias("group"), "words", "chars").where("group is not null")
    means = placed.groupBy("group").agg((F.sum("chars") / F.sum("words")).alias("mean"))
    placed = settle(placed.select("pair", "group").join(means, "group"), "groups")
    ratio = lambda n, of: F.sqrt(F.col(n) / F.col(of))
    vector = {
        "z0": F.log((F.col("word_chars") + MEAN_WORDS * F.col("mean")) / (F.col("n_words") + MEAN_WORDS)),
        "z1": ratio("n_symbols", "n_words"), "z2": ratio("n_dup_lines", "n_lines"), "z3": ratio("n_repeat_words", "n_words"),
    }
    joined = base.withColumn("pair", F.when(~F.col("base_failed"), _key("lang", "source"))).join(placed, "pair", "left")
    return joined.withColumns({n: F.when(F.col("group").isNotNull(), v) for n, v in vector.items()}).drop("pair", "mean")


def chi_square_share(x: float, dims: int) -> float:
    """Distribution function of chi-square for an even number of dimensions."""
    term, total = 1.0, 1.0
    for k in range(1, dims // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_limit(share: float, dims: int = DIMS) -> float:
    """The value that a share of a chi-square variable lies below."""
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, dims) < share else (low, middle)
    return (low + high) / 2


def estimate(count: float, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[list[float], list[float], float]:
    """Centre, precision matrix (upper triangle, off-diagonal doubled) and log determinant from the moments of
    the `share` of rows nearest the centre; the covariance is scaled to that of a whole normal group."""
    centre = sums / count
    cov = np.zeros((DIMS, DIMS))
    for (i, j), p in zip(PAIRS, products):
        cov[i, j] = cov[j, i] = p / count - centre[i] * centre[j]
    if share < 1:
        cov *= share / chi_square_share(chi_square_limit(share), DIMS + 2)
    cov += np.diag(np.square(LEAST_SPREAD))
    precision = np.linalg.inv(cov)
    return centre.tolist(), [float(precision[i, j] * (1 + (i != j))) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def _moments() -> list[Column]:
    sums = [F.sum(f"z{i}").alias(f"s{i}") for i in range(DIMS)]
    return [F.count(F.lit(1)).alias("rows"), *sums, *[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}{j}") for i, j in PAIRS]]


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return frame["rows"].to_numpy(float), frame[[f"s{i}" for i in range(DIMS)]].to_numpy(float), frame[[f"p{i}{j}" for i, j in PAIRS]].to_numpy(float)


def starts(rows: DataFrame) -> DataFrame:
    """PARAMS of two starts a group: medians with quartile spreads, and the moments of all rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, (count, sums, products) in enumerate(zip(*_arrays(frame))):
                quartiles = np.array([frame[f"q{i}"].iloc[k] for i in range(DIMS)])
                cov = np.square((quartiles[:, 2] - quartiles[:, 0]) / 1.349) + np.square(LEAST_SPREAD)
                diagonal = [float(1 / cov[i]) if i == j else 0.0 for i, j in PAIRS]
                group = int(frame["group"].iloc[k])
                out.append((group, 0, quartiles[:, 1].tolist(), diagonal, float(np.log(cov).sum())))
                out.append((group, 1, *estimate(count, sums, products, 1.0)))
            yield pd.DataFrame(out, columns=["group", "start", "centre", "precision", "logdet"])

    quartiles = [F.percentile_approx(f"z{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMS)]
    ship(rows.sparkSession)
    return settle(rows.groupBy("group").agg(*_moments(), *quartiles).mapInPandas(run, PARAMS), "starts")


def distance() -> Column:
    """Squared Mahalanobis distance of z0 to z3 from the centre of the joined parameters."""
    off = [F.col(f"z{i}") - F.col("centre")[i] for i in range(DIMS)]
    return reduce(lambda a, b: a + b, [F.col("precision")[k] * off[i] * off[j] for k, (i, j) in enumerate(PAIRS)])


def tightened(rows: DataFrame, params: DataFrame, within: float | None = None) -> DataFrame:
    """The estimates from the rows nearest to the present ones: the least distances that cover COVERED of a
    group, or all distances up to `within`.

    Rows are summed by group and distance bin (a sixteenth of an octave), so a hot group is pre-aggregated by
    every task, and a group's bins are a bounded table; the bin that reaches the share is taken whole.
    """
    if within is None:
        bin_of = F.floor(F.log2(F.greatest(F.col("distance"), F.lit(2.0**-OCTAVES))) * BINS_PER_OCTAVE)
    else:
        bin_of = F.floor(F.col("distance") / within)
    summed = rows.join(params, "group").withColumn("distance", distance()).groupBy(
        "group", "start", F.least(bin_of, F.lit(OCTAVES * BINS_PER_OCTAVE)).alias("bin")
    ).agg(*_moments())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        count, sums, products = _arrays(frame)
        if within is None:
            take = int(np.searchsorted(np.cumsum(count), COVERED * count.sum() - 1e-9)) + 1
        else:
            take = max(1, int((frame["bin"] <= 0).sum()))
        share = count[:take].sum() / count.sum() if within is None else chi_square_share(within, DIMS)
        found = estimate(count[:take].sum(), sums[:take].sum(axis=0), products[:take].sum(axis=0), share)
        return pd.DataFrame([(int(frame["group"].iloc[0]), int(frame["start"].iloc[0]), *found)], columns=["group", "start", "centre", "precision", "logdet"])

    ship(rows.sparkSession)
    return settle(summed.groupBy("group", "start").applyInPandas(run, PARAMS), "tightened")


def estimates(rows: DataFrame) -> DataFrame:
    """PARAMS a group: the minimum covariance determinant over two starts by concentration steps, then one
    reweighting by the rows within the 97.5 % distance."""
    params = starts(rows)
    for _ in range(2):
        params = tightened(rows, params)
    best = params.groupBy("group").agg(F.min(F.struct("logdet", "start", "centre", "precision")).alias("b"))
    params = settle(best.select("group", "b.start", "b.centre", "b.precision", "b.logdet"), "best")
    for _ in range(STEPS):
        new = tightened(rows, params)
        change = new.join(params.select("group", F.col("logdet").alias("old")), "group").agg(F.max(F.abs(F.col("logdet") - F.col("old")))).first()[0]
        params = new
        if change is None or change <= SETTLED:
            break
    return tightened(rows, params, chi_square_limit(0.975))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, text_hash, the base statistics, base_failed, distance, kept) for every row of docs.

    Rows that fail a base rule are not kept. Of the others a vector of four transformed statistics is judged
    by its squared Mahalanobis distance from the robust estimate of its language and source; above the
    1 - REJECTED limit of chi-square it is rejected. The length itself is no part of the vector. All passing
    rows take part in the estimates; a covariance has the floor LEAST_SPREAD, so a group whose statistics are
    all equal rejects no slight deviation. Null texts have no words and fail; null languages and sources are values of their
    own; repeated rows stay and count each; an empty table gives an empty table; other columns are not read.
    """
    base = settle(base_statistics(docs, id_col, text_col, lang_col, source_col), "base")
    rows = settle(with_vectors(base), "vectors")
    params = estimates(rows.where("group is not null").select("group", *[f"z{i}" for i in range(DIMS)]))
    limit = chi_square_limit(1 - REJECTED)
    tested = rows.join(params, "group", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return tested.select("id", "text_hash", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", kept.alias("kept"))


def without_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that judged keeps, with all their columns; rows equal in id, text, language and source share a verdict."""
    gone = judged(docs, id_col, text_col, lang_col, source_col).where(~F.col("kept"))
    names = lambda i, h, a, b: F.struct(F.coalesce(i.cast("string"), F.lit("-")), h, F.coalesce(F.concat(F.lit("="), a), F.lit("-")), F.coalesce(F.concat(F.lit("="), b), F.lit("-")))
    marks = settle(gone.select(names(F.col("id"), F.col("text_hash"), F.col("lang"), F.col("source")).alias("mark")).distinct(), "outliers")
    mark = names(F.col(id_col).cast("long"), F.xxhash64(text_or_empty(text_col)), F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    return docs.join(marks, mark == marks["mark"], "left_anti").select(*[docs[c] for c in docs.columns])

"""Susceptibility and risk-class models with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.functions.columns import rounded
from slopecast.operators import forests
from slopecast.operators.boosting import boosted
from slopecast.operators.forests import BINS, NODES, Forest, Plan, Reading, answered, fitted, permuted, walked
from slopecast.operators.labels import block_table, fold_of, spatial_block, stratified_split
from slopecast.operators.metrics import average_precision, class_metrics, roc_auc
from slopecast.operators.ranks import exact_quantiles, numbered, quantiles_of_counts
from slopecast.session import settle

SEED = 42
FOLDS = 5
TREES, DEPTH = 150, 16
#: Partitions that Spark's own models are fitted on, unless told: a fixed number, dealt by key, gives the same model on
#: any cluster and at any time.
FIT_PARTITIONS = 4
#: Steps of a walk to a number in use; the share of walks that need more is below 0.75 ** 48, and those keep their number.
WALK = 48
#: Fits that run at once, so that the short tail of one does not leave the cluster idle.
FITS = 4

NUMERIC = (
    "elevation_m", "slope_deg", "aspect_deg", "relief_std_5x5_m",
    "clay_percent", "sand_percent", "silt_percent", "bulk_density_kg_dm3",
)
CATEGORIES = ("soil_class", "landcover_class")
FEATURE_SETS = {
    "environment": NUMERIC,
    "environment_roads": (*NUMERIC, "distance_to_road_m", "distance_to_river_m"),
    "environment_all": (*NUMERIC, "distance_to_road_m", "distance_to_river_m", "distance_to_other_m"),
}


def spatial_folds(df: DataFrame, label: str = "label", folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add block and fold: 1-degree blocks grouped by k-means on their centroids, weighted by size.

    k-means runs on the block table, whose size is bounded by the area.
    """
    blocks = VectorAssembler(inputCols=["mean_lat", "mean_lon"], outputCol="at").transform(block_table(df, label))
    blocks = settle(blocks.withColumn("w", F.col("n_samples").cast("double")).select("block", "at", "w"))
    model = KMeans(k=folds, seed=seed, weightCol="w", featuresCol="at", predictionCol="fold", maxIter=50).fit(blocks)
    fold = model.transform(blocks).select("block", "fold")
    return df.withColumn("block", spatial_block(F.col("latitude"), F.col("longitude"))).join(fold, "block")


def fold_report(df: DataFrame) -> DataFrame:
    """Samples, labels and blocks per fold."""
    return df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"), F.count_distinct("block").alias("blocks"),
    )


class Prepared:
    """Imputation and encoding fitted on training rows only.

    Missing numbers take the exact median and missing names the most frequent one (ties: the least).
    Names are coded by frequency, then by name; a name that training did not have has no code.
    What the driver keeps is one number a column and one row a name of the fixed class lists.
    """

    def __init__(self, train: DataFrame, numeric: Sequence[str], categories: Sequence[str]):
        self.numeric, self.categories = list(numeric), list(categories)
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in self.numeric])
        long = train.select(F.explode(pairs).alias("p")).select("p.name", "p.value")
        self.medians = {r["name"]: r["median"] for r in exact_quantiles(long, ["name"], "value", {"median": 0.5}).collect()}
        self.codes = {}
        for c in self.categories:
            counts = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()
            self.codes[c] = [r[c] for r in sorted(counts, key=lambda r: (-r["n"], r[c]))]

    def transform(self, df: DataFrame) -> DataFrame:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians.get(c, 0.0))) for c in self.numeric]
        flags = []
        for c in self.categories:
            names = self.codes[c]
            flags += [(F.coalesce(F.col(c), F.lit(names[0])) == n).cast("double") for n in names]
        return df.withColumn("features", array_to_vector(F.array(*filled, *flags)))

    def positions(self, column: str) -> list[int]:
        """Where a column's values stand in the features."""
        if column in self.numeric:
            return [self.numeric.index(column)]
        before = self.categories[: self.categories.index(column)]
        start = len(self.numeric) + sum(len(self.codes[c]) for c in before)
        return list(range(start, start + len(self.codes[column])))


def dealt(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """df in a fixed number of partitions by the key's hash, in the key's order: what a repeatable fit reads."""
    return df.repartition(partitions or FIT_PARTITIONS, key).sortWithinPartitions(key)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add weight: rows over (classes x rows of the class), so that classes weigh the same."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    total = sum(counts.values())
    weight = reduce(
        lambda w, kv: w.when(F.col(label) == kv[0], total / (len(counts) * kv[1])), counts.items(), F.when(F.lit(False), 1.0)
    )
    return df.withColumn("weight", weight)


class Susceptibility:
    """Balanced forest on prepared features; score() adds the static score in [0, 1].

    key says which rows a tree gets (see forests.fitted).
    """

    def __init__(self, train: DataFrame, numeric: Sequence[str], categories: Sequence[str] = CATEGORIES,
                 trees: int = TREES, depth: int = DEPTH, key: str = "point_id"):
        self.prepared = Prepared(train, numeric, categories)
        rows = class_weights(self.prepared.transform(train)).withColumn("features", vector_to_array("features"))
        self.model: Forest = fitted(rows, key, "features", "label", "weight", trees, depth, least=2, seed=SEED)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        keep = df.columns
        rows = self.prepared.transform(df).withColumn("features", vector_to_array("features"))
        out = self.model.shares(rows, "features", "_shares")
        return out.select(*[c for c in keep if c != name], F.get("_shares", F.lit(1)).alias(name))

    def parameters(self) -> dict[str, str]:
        """Parameters of the fitted model itself, for the record."""
        return dict(self.model.told)


@dataclass
class Fit:
    """One of several models on a table: the columns that it reads, the rows that it learns and those that it scores."""

    columns: Sequence[str]
    train: Column
    asked: Column


def scored_apart(df: DataFrame, fits: Sequence[Fit], trees: int = TREES, depth: int = DEPTH, key: str = "point_id", categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """The rows of df once for each fit that they ask, with model (the number of the fit) and score, as the fit's own
    Susceptibility gives it. What is fitted on training rows is counted for all fits in the same few passes, and
    their forests are grown together (forests.answered); models of more rows than a group holds are fitted by themselves."""
    made = planned(df, fits, trees, depth, key, categories)
    if made is None:
        def alone(m: int) -> DataFrame:
            model = Susceptibility(df.filter(fits[m].train), fits[m].columns, categories, trees, depth, key)
            return model.score(df.filter(fits[m].asked)).withColumn("model", F.lit(m))

        with ThreadPool(FITS) as pool:
            return settle(reduce(DataFrame.unionByName, pool.map(alone, range(len(fits)))), "scored")
    rows, asking, plans, readings = made
    out = settle(answered(asking, plans, readings), "answers")
    return rows.drop("uses").join(out.select("_row", "model", F.get("shares", F.lit(1)).alias("score")), "_row").drop("_row")


def planned(df: DataFrame, fits: Sequence[Fit], trees: int, depth: int, key: str, categories: Sequence[str], more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, list[Plan], list[Reading]] | None:
    """The rows of df, settled, with _row and uses; the rows as forests.dealt_codes reads them, with the columns `more`; and the plan and
    the reading of each fit, counted in the same few passes. None where a model has more rows than a group holds."""
    uses = F.array(*[F.when(f.train, 1).when(f.asked, 2).otherwise(0) for f in fits])
    rows = settle(df.select("*", uses.alias("uses"), F.monotonically_increasing_id().alias("_row")), "rows")
    indices = F.array(*[F.lit(m) for m in range(len(fits))])
    each = rows.select("*", F.explode(F.filter(indices, lambda m: F.get("uses", m) > 0)).alias("model"))
    sizes = {r["model"]: r["n"] for r in each.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fit
    if max(sizes.values(), default=0) > forests.WHOLE:
        return None
    learned = each.where(F.get("uses", F.col("model")) == 1)
    numeric = list(dict.fromkeys(c for f in fits for c in f.columns))
    labels = learned.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a fit and class
    values = F.posexplode(F.array(*[F.col(c).cast("double") for c in numeric])).alias("i", "_x")
    counts = settle(learned.select("model", values).groupBy("model", "i", "_x").agg(F.count(F.lit(1)).alias("_n")), "counts")
    medians = {(r["model"], r["i"]): r["median"] for r in quantiles_of_counts(counts.where("_x is not null"), ["model", "i"], {"median": 0.5}).collect()}  # one a fit and column
    fills = F.lit([float(medians.get((m, i), 0.0)) for m in range(len(fits)) for i in range(len(numeric))])
    filled = counts.withColumn("_x", F.coalesce("_x", F.get(fills, F.col("model") * len(numeric) + F.col("i")))).groupBy("model", "i", "_x").agg(F.sum("_n").alias("_n"))
    steps = {f"q{k}": k / (BINS - 1) for k in range(BINS - 1)}
    cuts = {(r["model"], r["i"]): np.unique([r[q] for q in steps]) for r in quantiles_of_counts(filled, ["model", "i"], steps).collect()}
    names = F.posexplode(F.array(*[F.col(c).cast("string") for c in categories])).alias("i", "name")
    known: dict[tuple[int, int], list] = {}
    for r in learned.select("model", names).where("name is not null").groupBy("model", "i", "name").agg(F.count(F.lit(1)).alias("n")).collect():  # names of fixed class lists
        known.setdefault((r["model"], r["i"]), []).append((r["n"], r["name"]))
    plans, readings = [], []
    for m, f in enumerate(fits):
        own = {r["label"]: r["n"] for r in labels if r["model"] == m}
        total, weights = sum(own.values()), np.zeros(max(own, default=0) + 1)
        for label, n in own.items():
            weights[label] = total / (len(own) * n)
        told, flags = [], []
        for i in range(len(categories)):
            found = sorted(known.get((m, i), []), key=lambda x: (-x[0], x[1]))
            missing = total - sum(n for n, _ in found)  # they stand for the first name
            told.append((i, [name for _, name in found]))
            flags += [flag_quantiles(total, n + (missing if at == 0 else 0)) for at, (n, _) in enumerate(found)]
        places = [numeric.index(c) for c in f.columns]
        plans.append(Plan(trees, depth, 2, SEED, weights, [*[cuts.get((m, i), np.zeros(1)) for i in places], *flags]))
        readings.append(Reading([(i, float(medians.get((m, i), 0.0))) for i in places], told))
    x = [F.col(c).cast("double") for c in numeric]
    asking = rows.select(
        "_row", F.xxhash64(key).alias("k"), F.col("label").cast("int").alias("y"), "uses", F.array(*[F.coalesce(c, F.lit(0.0)) for c in x]).alias("x"),
        F.array(*[c.isNull() for c in x]).alias("missing"), F.array(*[F.col(c).cast("string") for c in categories]).alias("names"), *more,
    )
    return rows, asking, plans, readings


def flag_quantiles(rows: int, ones: int) -> np.ndarray:
    """What splits of a feature of 0 and 1 are chosen from: the exact quantiles, as forests.thresholds has them."""
    at = np.array([k / (BINS - 1) * (rows - 1) for k in range(BINS - 1)])
    low, high = ((f(at) >= rows - ones).astype(float) for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def cross_validated(
    df: DataFrame, feature_sets: dict[str, Sequence[str]], trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """Held-out scores (set_name, fold, label, score) of every feature set and fold, all fitted together."""
    fold = F.col("fold")
    fits = [Fit(columns, fold != f, fold == f) for columns in feature_sets.values() for f in range(FOLDS)]
    of_model = F.get(F.array(*[F.lit(name) for name in feature_sets for _ in range(FOLDS)]), F.col("model"))
    return settle(scored_apart(df, fits, trees, depth).select(of_model.alias("set_name"), "fold", "label", "score"))


def fold_metrics(scores: DataFrame, keys: Sequence[str] = ("set_name", "fold")) -> DataFrame:
    """AUC, average precision, Brier and threshold metrics per key."""
    hit, real, called = F.col("score") >= 0.5, F.col("label") == 1, F.col("score") >= 0.5
    counts = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier"),
        F.avg((hit == real).cast("double")).alias("accuracy"),
        F.count_if(called & real).alias("_tp"), F.count_if(real).alias("_p"), F.count_if(called).alias("_c"),
        F.count_if(~called & ~real).alias("_tn"), F.count_if(~real).alias("_n"),
    )
    precision = F.when(F.col("_c") > 0, F.col("_tp") / F.col("_c")).otherwise(0.0)
    recall = F.when(F.col("_p") > 0, F.col("_tp") / F.col("_p")).otherwise(0.0)
    counts = counts.withColumns({
        "precision": precision, "recall": recall,
        "balanced_accuracy": (recall + F.when(F.col("_n") > 0, F.col("_tn") / F.col("_n")).otherwise(0.0)) / 2.0,
    }).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    ).drop("_tp", "_p", "_c", "_tn", "_n")
    auc = roc_auc(scores, "label", "score", list(keys))
    ap = average_precision(scores, "label", "score", list(keys))
    return counts.join(auc, list(keys)).join(ap, list(keys))


def cv_summary(metrics: DataFrame) -> DataFrame:
    """Mean and deviation over the folds, per feature set."""
    names = ("roc_auc", "average_precision", "brier", "accuracy", "balanced_accuracy", "precision", "recall", "f1")
    return metrics.groupBy("set_name").agg(
        F.count(F.lit(1)).alias("folds"),
        *[rounded(F.avg(n)).alias(f"{n}_mean") for n in names], *[rounded(F.stddev_pop(n)).alias(f"{n}_std") for n in names],
    )


def with_deltas(summary: DataFrame, base: str) -> DataFrame:
    """Add to each feature set what its mean AUC and average precision gain over the base set."""
    own = summary.filter(F.col("set_name") == base).select(*[F.col(f"{n}_mean").alias(f"_{n}") for n in ("roc_auc", "average_precision")], F.lit(1).alias("_k"))
    joined = summary.withColumn("_k", F.lit(1)).join(F.broadcast(own), "_k")  # one row
    return joined.withColumns({f"{n}_delta": rounded(F.col(f"{n}_mean") - F.col(f"_{n}")) for n in ("roc_auc", "average_precision")}).drop("_k", "_roc_auc", "_average_precision")


def calibrated_folds(df: DataFrame, numeric: Sequence[str], trees: int = TREES, depth: int = DEPTH, inner: int = 3) -> DataFrame:
    """Brier score per spatial fold, raw and calibrated; the sigmoid (Platt scaling) is learned inside the other folds.

    It is fitted on out-of-fold scores of the training rows, so it never sees a score of a row the forest learned.
    """
    split = df.withColumn("_inner", fold_of(F.col("point_id"), inner))
    outside = [F.col("fold") != f for f in range(FOLDS)]
    fits = [Fit(numeric, outside[f] & (F.col("_inner") != g), outside[f] & (F.col("_inner") == g)) for f in range(FOLDS) for g in range(inner)]
    fits += [Fit(numeric, outside[f], F.col("fold") == f) for f in range(FOLDS)]
    scores = settle(scored_apart(split, fits, trees, depth).select("model", "fold", "label", "score"), "scores")
    as_vector = VectorAssembler(inputCols=["score"], outputCol="score_vector")
    scores = as_vector.transform(scores)

    def scored_fold(f: int) -> DataFrame:
        unseen = scores.where((F.col("model") >= f * inner) & (F.col("model") < (f + 1) * inner)).select("label", "score_vector")
        platt = LogisticRegression(labelCol="label", featuresCol="score_vector").fit(unseen)
        # the model's own formula; its function would carry the session of its summary along, which cannot always be sent
        margin = F.col("score") * float(platt.coefficients[0]) + float(platt.intercept)
        return scores.where(F.col("model") == FOLDS * inner + f).select("fold", "label", "score", (1.0 - 1.0 / (1.0 + F.exp(margin))).alias("calibrated"))

    with ThreadPool(FITS) as pool:
        scored = settle(reduce(DataFrame.unionByName, pool.map(scored_fold, range(FOLDS))))
    error = lambda c: rounded(F.avg(F.pow(F.col(c) - F.col("label"), F.lit(2.0))))
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("samples"), error("score").alias("brier_raw"), error("calibrated").alias("brier_calibrated"))


def fold_importance(df: DataFrame, numeric: Sequence[str], columns: Sequence[str], key: str, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Permutation importance on every spatial fold in turn, each by a model of the other folds; means over folds. The models
    share their passes; those of more rows than a group holds are fitted by themselves."""
    together = importance_together(df, numeric, columns, key, trees, depth)

    def drops(fold: int) -> DataFrame:
        model = Susceptibility(df.filter(F.col("fold") != fold), numeric, trees=trees, depth=depth)
        return permutation_importance(model, df.filter(F.col("fold") == fold), columns, key).withColumn("fold", F.lit(fold))

    if together is None:
        with ThreadPool(FITS) as pool:
            together = reduce(DataFrame.unionByName, pool.map(drops, range(FOLDS)))
    each = settle(together)
    return each.groupBy("feature").agg(F.count(F.lit(1)).alias("folds"), F.avg("mean_drop").alias("mean_drop"), F.stddev_pop("mean_drop").alias("std_drop"))


def importance_together(
    df: DataFrame, numeric: Sequence[str], columns: Sequence[str], key: str, trees: int, depth: int, repeats: int = 5, seed: int = SEED, categories: Sequence[str] = CATEGORIES,
) -> DataFrame | None:
    """(feature, fold, mean_drop, std_drop): permutation_importance of the models of all folds. The rows of a fold walk the trees while they
    grow (forests.permuted); the donors are those of permutation_importance. None where a model has more rows than a group holds."""
    own = F.md5(F.col(key).cast("string"))
    slices = F.conv(F.substring("_o", 1, 3), 16, 10).cast("bigint")
    rows = settle(numbered(df.withColumn("_o", own), ["fold"], slices, [F.col("_o"), F.col(key)], "_rn").drop("_o").withColumn("_rn", F.col("_rn") - 1), "numbered")
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a fold
    folds = sorted(sizes)
    donor = lambda f: F.array(*[donor_number(F.col("_rn"), sizes[f], F.lit(r), F.lit(seed)) for r in range(repeats)])
    given = reduce(lambda w, f: w.when(F.col("fold") == f, donor(f)), folds, F.when(F.lit(False), F.array().cast("array<bigint>")))
    rows = rows.withColumn("more", F.concat(F.array("_rn"), given))
    fold = F.col("fold")
    made = planned(rows, [Fit(numeric, fold != f, fold == f) for f in folds], trees, depth, key, categories, ["more"])
    if made is None:
        return None
    rows, asking, plans, readings = made
    of_feature = []
    for reading in readings:
        names = [*numeric, *[categories[i] for i, known in reading.names for _ in known]]
        of_feature.append(np.array([columns.index(c) if c in columns else len(columns) for c in names] + [len(columns)]))
    out = permuted(asking, plans, readings, of_feature).join(rows.select("_row", "label", "fold"), "_row")
    out = settle(out.select("fold", "label", "scores"), "permuted")
    long = out.select("fold", "label", F.posexplode(F.slice("scores", 2, repeats * len(columns))).alias("at", "score"))
    shuffled = roc_auc(long, "label", "score", ["fold", "at"])
    base = roc_auc(out.select("fold", "label", F.get("scores", F.lit(0)).alias("score")), "label", "score", ["fold"]).withColumnRenamed("roc_auc", "base")
    feature = F.get(F.array(*[F.lit(c) for c in columns]), (F.col("at") % len(columns)).cast("int")).alias("feature")
    drop = F.col("base") - F.col("roc_auc")
    return shuffled.join(base, "fold").groupBy(feature, "fold").agg(F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("std_drop"))


def donor_number(number: Column, rows: int, *seed: Column) -> Column:
    """A keyed bijection of the numbers 0 to rows - 1: three rounds that add a hash of one half to the other, on the
    least even number of bits that holds them, walked until the result is a number again."""
    half = max(1, ((max(1, rows - 1)).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def once(x: Column) -> Column:
        for k in range(3):
            left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
            mixed = left.bitwiseXOR(F.xxhash64(right, F.lit(k), *seed).bitwiseAND(F.lit(mask)))
            x = F.shiftleft(right, half).bitwiseOR(mixed)
        return x

    # a quarter of the numbers of that many bits at least are in use
    start = F.struct(once(number).alias("x"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.struct(F.when(s["x"] < rows, s["x"]).otherwise(once(s["x"])).alias("x")))
    return F.when(walked["x"] < rows, walked["x"]).otherwise(number)


def permutation_importance(model: Susceptibility, test: DataFrame, columns: Sequence[str], key: str, repeats: int = 5, seed: int = SEED) -> DataFrame:
    """Mean drop of AUC when one column is shuffled, over repeats.

    Rows are numbered once; the donor of a row in a repeat is the row whose number a keyed bijection gives, so
    no order is made a second time, and a row is carried once a repeat: it meets its donor's features
    in one join, and is scored with those of one column replaced in turn.
    """
    own = F.md5(F.col(key).cast("string"))
    slices = F.conv(F.substring("_o", 1, 3), 16, 10).cast("bigint")
    made = model.prepared.transform(test).select(key, "label", "features")
    rows = numbered(made.withColumn("_o", own), [], slices, [F.col("_o"), F.col(key)], "_rn")
    rows = settle(rows.drop("_o").withColumn("_rn", F.col("_rn") - 1), "numbered")
    n = rows.count()
    donors = rows.select(F.col("_rn").alias("_donor"), F.col("features").alias("_given"))
    each = rows.select("*", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat"))
    each = each.withColumn("_donor", donor_number(F.col("_rn"), n, F.col("repeat"), F.lit(seed))).join(donors, "_donor")
    both = each.select("repeat", "label", vector_to_array("features").alias("own"), vector_to_array("_given").alias("given"))
    variants = [model.prepared.positions(c) for c in columns]
    scored = walked(model.model.nodes, both, [F.col("own"), F.col("given")], "shares", variants)
    names = F.array(*[F.lit(c) for c in columns])
    long = scored.select("repeat", "label", "shares", F.posexplode(names).alias("at", "feature"))
    long = long.select("repeat", "label", "feature", F.get("shares", F.lit(model.model.classes) * F.col("at") + 1).alias("score"))
    long = settle(long, "shuffled")
    shuffled = roc_auc(long, "label", "score", ["feature", "repeat"])
    base = roc_auc(model.score(test), "label", "score").first()["roc_auc"]  # one number
    drop = F.lit(base) - F.col("roc_auc")
    return shuffled.groupBy("feature").agg(F.avg(drop).alias("mean_drop"), F.stddev_pop(drop).alias("std_drop"))


def class_forest(df: DataFrame, key: str, trees: int = 500) -> Forest:
    """Forest of full trees (as deep as Spark's own can be) for risk classes; df has features (vector), y and weight."""
    rows = df.withColumn("_features", vector_to_array("features"))
    return fitted(rows, key, "_features", "y", "weight", trees, 30, least=1, seed=SEED)


def with_classes(model: Forest, df: DataFrame) -> DataFrame:
    """Add probabilities (of each class) and prediction, the number of the likeliest class; ties: the first."""
    out = model.shares(df.withColumn("_features", vector_to_array("features")), "_features", "probabilities").drop("_features")
    return out.withColumn("prediction", likeliest("probabilities"))


def candidates(rounds: int) -> dict[str, Pipeline]:
    """The risk-class models beside the forest; Spark's boosting is binary, so it runs one against the rest."""
    return {
        "logistic": Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            LogisticRegression(labelCol="y", featuresCol="scaled", maxIter=2000),
        ]),
        "boosting": Pipeline(stages=[
            OneVsRest(
                classifier=GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, stepSize=0.1, maxDepth=3, seed=SEED),
                labelCol="y", featuresCol="features", parallelism=4,
            )
        ]),
    }


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, seed: int = SEED) -> DataFrame:
    """Add fold: the rows of each class dealt round in hashed order, so folds have the same shares."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.lit("fold"), F.col(key).cast("string")))
    hashed = df.withColumn("_h", h)
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = numbered(hashed, [label], bucket, [F.col("_h"), F.col(key)])
    return ranked.withColumn("fold", (F.col("rn") % folds).cast("int")).drop("_h", "rn")


def classed_apart(df: DataFrame, key: str, fits: Sequence[tuple[Column, Column]], trees: int, rounds: int) -> DataFrame | None:
    """The rows of df once for each fit (rows learned, rows asked) that they ask and each of the forest and the boosting, with
    model, fit and prediction; None where a fit has more rows than a group holds. All fits share their passes."""
    uses = F.array(*[F.when(train, 1).when(asked, 2).otherwise(0) for train, asked in fits])
    rows = settle(df.select("*", uses.alias("uses"), F.monotonically_increasing_id().alias("_row"), vector_to_array("features").alias("x")), "rows")
    indices = F.array(*[F.lit(m) for m in range(len(fits))])
    sizes = rows.select(F.explode(F.filter(indices, lambda m: F.get("uses", m) > 0)).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    if sizes.where(F.col("n") > forests.WHOLE).count():
        return None
    about = rows.groupBy("y").agg(F.min("weight").alias("w"), F.max(F.size("x")).alias("size")).collect()  # one row a class
    weights, size = np.zeros(int(max(r["y"] for r in about)) + 1), max(r["size"] for r in about)
    for r in about:
        weights[int(r["y"])] = r["w"]
    learned = rows.select("x", F.explode(F.filter(indices, lambda m: F.get("uses", m) == 1)).alias("m")).select("m", F.posexplode("x").alias("i", "value"))
    steps = {f"q{k}": k / (BINS - 1) for k in range(BINS - 1)}
    cuts = {(r["m"], r["i"]): np.unique([r[q] for q in steps]) for r in exact_quantiles(learned, ["m", "i"], "value", steps).collect()}  # one a fit and feature
    plans = [Plan(trees, 30, 1, SEED, weights, [cuts.get((m, i), np.zeros(1)) for i in range(size)]) for m in range(len(fits))]
    readings = [Reading([(i, 0.0) for i in range(size)], [])] * len(fits)
    asking = rows.select(
        "_row", F.xxhash64(key).alias("k"), F.col("y").cast("int").alias("y"), "uses", "x", F.transform("x", lambda v: v.isNull()).alias("missing"),
        F.array().cast("array<string>").alias("names"),
    )
    likeliest = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int").alias("prediction")
    forest = answered(asking, plans, readings).select(F.lit("random_forest").alias("model"), F.col("model").alias("fit"), "_row", likeliest("shares"))
    boost = boosted(asking, plans, readings, rounds).select(F.lit("boosting").alias("model"), F.col("model").alias("fit"), "_row", likeliest("margins"))
    return rows.drop("uses", "x").join(settle(forest.union(boost), "answers"), "_row").drop("_row")


def compare_models(df: DataFrame, key: str, classes: Sequence[str], folds: int = 3, trees: int = 500, rounds: int = 100) -> DataFrame:
    """Metrics per model on a quarter of the rows that no fit has seen, and their means over
    stratified folds of the rest; best first by the fold means of macro F1, critical recall, high
    recall, accuracy.

    df has features (vector), y (class number) and class_name; key deals the rows to the partitions of a fit.
    """
    parted = stratified_split(class_weights(df, "y"), "class_name", key)
    split = settle(stratified_folds(parted.filter("part = 'train'"), "class_name", key, folds).unionByName(
        parted.filter("part = 'test'").withColumn("fold", F.lit(-1))
    ))
    names = F.array(*[F.lit(c) for c in classes])

    models = {"random_forest": None, **candidates(rounds)}
    parts = {f: ((F.col("fold") >= 0) & (F.col("fold") != f), F.col("fold") == f) for f in (-1, *range(folds))}

    def named(out: DataFrame, name: Column, fold: Column) -> DataFrame:
        return out.select(name.alias("model"), fold.alias("fold"), "class_name", F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))

    def held_out(job: tuple[str, Pipeline | None, int]) -> DataFrame:
        name, pipe, f = job
        train, test = (split.filter(p) for p in parts[f])
        out = with_classes(class_forest(train, key, trees), test) if pipe is None else pipe.fit(dealt(train, key)).transform(test)
        return named(out, F.lit(name), F.lit(f))

    together = classed_apart(split, key, list(parts.values()), trees, rounds)
    work = [(name, pipe, f) for name, pipe in models.items() for f in parts if together is None or name == "logistic"]
    with ThreadPool(FITS) as pool:
        held = pool.map(held_out, work)
    if together is not None:
        held.append(named(together, F.col("model"), F.get(F.lit(list(parts)), F.col("fit"))))
    held = settle(reduce(DataFrame.unionByName, held))
    m = class_metrics(held, "class_name", "predicted", classes, ["model", "fold"])
    wanted = {"macro_f1": ("macro", "f1"), "critical_recall": ("Critical", "recall"), "high_recall": ("High", "recall"), "accuracy": ("all", "accuracy")}

    def mean(scope: str, metric: str, where: Column) -> Column:
        return rounded(F.avg(F.when(where & (F.col("scope") == scope) & (F.col("metric") == metric), F.col("value"))))

    wide = m.groupBy("model").agg(
        *[mean(*at, F.col("fold") >= 0).alias(name) for name, at in wanted.items()],
        *[mean(*at, F.col("fold") < 0).alias(f"holdout_{name}") for name, at in wanted.items()],
    )
    return wide.orderBy(F.desc("macro_f1"), F.desc("critical_recall"), F.desc("high_recall"), F.desc("accuracy"), "model")


def node_table(spark: SparkSession, model: Forest) -> DataFrame:
    """A fitted forest as rows (NODES): inner nodes with feature, threshold and children (low: value <= threshold),
    leaves with the shares of the classes."""
    return model.nodes.drop("gain")


def node_scores(nodes: DataFrame, rows: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, shares): mean class shares over the trees of a node table, for rows (key, features: array<double>)."""
    return walked(nodes, rows.select(key, F.col(features).alias("x")), [F.col("x")], "shares").select(key, "shares")


def importance_table(spark, names: Sequence[str], forest_model, logistic_model) -> DataFrame:
    """Impurity importance and normalised mean absolute coefficient, one row per feature."""
    impurity = forest_model.importances()
    weights = abs(logistic_model.coefficientMatrix.toArray()).mean(axis=0)
    total = weights.sum() or 1.0
    rows = [(n, float(a), float(b / total)) for n, a, b in zip(names, impurity, weights)]
    return spark.createDataFrame(rows, "feature string, impurity double, coefficient double").orderBy(F.desc("impurity"), "feature")


def fitted_score_table(df: DataFrame, learned: Column, key: str, classes: Sequence[str], keep: Sequence[str], trees: int = 500) -> DataFrame:
    """score_table of all rows of df by the class_forest of the rows learned. All rows walk the trees while they grow, in groups
    that hold them as codes, so no node is written or sent; with more rows than a group holds, the node table is made and walked."""
    rows = df.select("*", F.when(learned, 3).otherwise(2).alias("use"), F.monotonically_increasing_id().alias("_row"), vector_to_array("features").alias("x"))
    rows = settle(rows, "rows")
    train = rows.where("use = 3")
    about = train.groupBy("y").agg(F.min("weight").alias("w"), F.max(F.size("x")).alias("size")).collect()  # one row a class
    if rows.count() > forests.WHOLE or not about:
        return score_table(class_forest(df.filter(learned), key, trees), df, classes, keep)
    weights, size = np.zeros(int(max(r["y"] for r in about)) + 1), max(r["size"] for r in about)
    for r in about:
        weights[int(r["y"])] = r["w"]
    plan = Plan(trees, 30, 1, SEED, weights, forests.thresholds(train, "x", size))
    asking = rows.select(
        "_row", F.xxhash64(key).alias("k"), F.col("y").cast("int").alias("y"), F.array("use").alias("uses"), "x", F.transform("x", lambda v: v.isNull()).alias("missing"),
        F.array().cast("array<string>").alias("names"),
    )
    found = settle(answered(asking, [plan], [Reading([(i, float("nan")) for i in range(size)], [])]).select("_row", F.col("shares").alias("probabilities")), "answers")
    return tabled(rows.join(found, "_row"), classes, keep)


def score_table(model, df: DataFrame, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Class, probability per class and confidence for a whole table."""
    return tabled(with_classes(model, df), classes, keep)


def likeliest(probabilities: str) -> Column:
    """The number of the likeliest class; ties: the first."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int") - 1


def tabled(df: DataFrame, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The columns of a score table from probabilities."""
    names = F.array(*[F.lit(c) for c in classes])
    out = df.withColumn("prediction", likeliest("probabilities"))
    return out.select(
        *keep, F.element_at(names, F.col("prediction") + 1).alias("risk"),
        *[F.col("probabilities")[i].alias(f"p_{c.lower()}") for i, c in enumerate(classes)],
        F.element_at("probabilities", F.col("prediction") + 1).alias("confidence"),
    )

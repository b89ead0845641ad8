"""Model queries. A fitted model has no value that SQL could derive, so each key returns invariants of its
result, as (check, n) rows that SQL derives from the data; the same key with _rows returns the result itself."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import rounded, segment_metres
from slopecast.operators import models as op
from slopecast.operators.labels import stratified_split, uniform
from slopecast.operators.metrics import roc_auc
from slopecast.operators.spatial import code_labels, nearest_other, nearest_segment
from slopecast.plans.bindings import Tables, rnd
from slopecast.plans.registry import query
from slopecast.session import settle

# A label the environment explains in part, so that a model has something to learn.
LABEL = (
    "CASE WHEN coalesce(slope_deg, 25) + coalesce(clay_percent, 25) / 2 + coalesce(relief_std_5x5_m, 20) / 3 "
    "+ (point_id * 13 % 29) > 58 THEN 1 ELSE 0 END AS label"
)
COLUMNS = ["point_id", "latitude", "longitude", *op.NUMERIC, *op.CATEGORIES]


def samples(t: Tables) -> DataFrame:
    return code_labels(t.points).selectExpr(*COLUMNS, LABEL)


def samples_with_distances(t: Tables) -> DataFrame:
    """Samples with road, river and nearest-other-positive distances."""
    roads = t.segments.filter(F.col("road_class").isin(*fixed.ROAD_CLASSES))
    rivers = t.segments.filter(~F.col("road_class").isin(*fixed.ROAD_CLASSES))
    df = nearest_segment(samples(t), roads, ["feature_id"], segment_metres, "_road")
    df = nearest_segment(df, rivers, ["feature_id"], segment_metres, "_river")
    df = nearest_other(df, F.col("label") == 1)
    return df.withColumns({
        "distance_to_road_m": F.col("_road.distance"), "distance_to_river_m": F.col("_river.distance"),
        "distance_to_other_m": F.col("nearest_other_km") * 1000.0,
    }).drop("_road", "_river", "nearest_other_km")


_COVER = "CASE cover_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fixed.LAND_COVER.items()) + " END"
_SOIL = "CASE soil_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(fixed.SOIL_CLASSES)) + " END"
_SAMPLES = f"(SELECT *, {LABEL} FROM (SELECT point_id, {', '.join(op.NUMERIC)}, {_SOIL} AS soil_class, {_COVER} AS landcover_class FROM points))"
_PARTS = f"""(SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42-' || point_id), point_id) <= floor(count(*) OVER (PARTITION BY label) * 0.75 + 0.5)
    THEN 'train' ELSE 'test' END AS part FROM {_SAMPLES} s)"""
_CODES = ", ".join(
    f"(SELECT list({c} ORDER BY n DESC, {c}) FROM (SELECT {c}, count(*) AS n FROM parts WHERE part = 'train' AND {c} IS NOT NULL GROUP BY 1)) AS {c}_codes" for c in op.CATEGORIES
)
_HOT = [f"list_transform({c}_codes, lambda x: CAST(CASE WHEN x = {c}_value THEN 1 ELSE 0 END AS DOUBLE))" for c in op.CATEGORIES]


@query(
    "impute_encode",
    f"""WITH parts AS {_PARTS}, med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in op.NUMERIC)} FROM parts WHERE part = 'train'),
    codes AS (SELECT {_CODES}),
    filled AS (SELECT point_id, part, {', '.join(f'CAST(coalesce(p.{c}, med.{c}) AS DOUBLE) AS {c}' for c in op.NUMERIC)}, codes.*,
      {', '.join(f'coalesce(p.{c}, {c}_codes[1]) AS {c}_value' for c in op.CATEGORIES)} FROM parts p, med, codes)
    SELECT point_id, part, list_concat([{', '.join(rnd(c) for c in op.NUMERIC)}], list_concat({_HOT[0]}, {_HOT[1]})) AS features FROM filled""",
)
def impute_encode(t: Tables):
    """Every sample as an encoded vector; medians, modes and codes come from the training part only."""
    parts = settle(stratified_split(samples(t), "label", "point_id"))
    prepared = op.Prepared(parts.filter("part = 'train'"), op.NUMERIC, op.CATEGORIES)
    out = prepared.transform(parts)
    return out.select("point_id", "part", F.transform(vector_to_array("features"), lambda x: rounded(x)).alias("features"))


def as_checks(row: DataFrame) -> DataFrame:
    """One row of numbers as (check, n) rows."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n")) for c in row.columns])))


def sql_checks(source: str, **checks) -> str:
    """The same rows in SQL; whole numbers stand for themselves."""
    rows = lambda value: "" if value.isdigit() else f" FROM {source}"
    return " UNION ALL ".join(f"SELECT '{name}' AS check, CAST(({value}) AS BIGINT) AS n{rows(value)}" for name, value in checks.items())


def outside(column: str, low: float = 0.0, high: float = 1.0):
    """Rows in which a number is missing or out of range."""
    return F.count_if(F.coalesce(~F.col(column).between(low - 1e-9, high + 1e-9), F.lit(True)))


_BLOCKS = f"(SELECT *, {LABEL}, floor(latitude) || '_' || floor(longitude) AS block FROM points)"


@query("spatial_folds_rows")
def spatial_folds_rows(t: Tables):
    """Five spatial folds: samples, labels and blocks of each."""
    return op.fold_report(op.spatial_folds(samples(t)))


@query("spatial_folds", sql_checks(_BLOCKS, folds="least(5, count(DISTINCT block))", samples="count(*)", positives="sum(label)", blocks="count(DISTINCT block)", empty_folds="0"))
def spatial_folds(t: Tables):
    """Invariants of the folds: every sample in one, every block in one (its folds add up to all blocks), none empty."""
    report = spatial_folds_rows(t)
    return as_checks(report.agg(
        F.count(F.lit(1)).alias("folds"), F.sum("samples").alias("samples"), F.sum("positives").alias("positives"), F.sum("blocks").alias("blocks"), F.count_if(F.col("samples") == 0).alias("empty_folds"),
    ))


def _fitted(t: Tables):
    parts = settle(stratified_split(samples(t), "label", "point_id"))
    return parts, op.Susceptibility(parts.filter("part = 'train'"), op.NUMERIC)


@query("susceptibility_model_rows")
def susceptibility_model_rows(t: Tables):
    """Balanced forest fitted on the training part, scoring every sample."""
    parts, model = _fitted(t)
    return model.score(parts).select("point_id", "part", "label", "score")


@query("susceptibility_model", sql_checks(
    f"{_PARTS}", train="count(*) FILTER (part = 'train')", test="count(*) FILTER (part = 'test')", train_positives="coalesce(sum(label) FILTER (part = 'train'), 0)",
    scores_outside="0", unlike_the_node_table="0", learned="1",
))
def susceptibility_model(t: Tables):
    """Invariants of the fit: the split, scores in [0, 1], the same scores from the node table for every sample, and
    training samples told apart (AUC above 0.9)."""
    parts, model = _fitted(t)
    scored = settle(model.score(parts).select("point_id", "part", "label", "score"), "scores")
    features = model.prepared.transform(parts).select("point_id", vector_to_array("features").alias("features"))
    again = op.node_scores(op.node_table(t.spark, model.model), features, "point_id")
    train = F.col("part") == "train"
    counts = scored.join(again, "point_id", "left").agg(
        F.count_if(train).alias("train"), F.count_if(~train).alias("test"), F.sum(F.when(train, F.col("label")).otherwise(0)).alias("train_positives"), outside("score").alias("scores_outside"),
        F.count_if(F.coalesce(F.abs(F.col("shares")[1] - F.col("score")) > 1e-9, F.lit(True))).alias("unlike_the_node_table"),
    )
    auc = roc_auc(scored.filter(train), "label", "score").select((F.col("roc_auc") > 0.9).cast("int").alias("learned"))
    return as_checks(counts.join(auc))  # one row each


#: A fixed forest of two trees over (slope, clay): a deployed table of nodes.
FIXED_NODES = [
    (0, 0, False, 0, 25.0, 1, 2, [0.5, 0.5]), (0, 1, True, None, None, None, None, [0.875, 0.125]), (0, 2, False, 1, 30.0, 3, 4, [0.25, 0.75]),
    (0, 3, True, None, None, None, None, [0.375, 0.625]), (0, 4, True, None, None, None, None, [0.0625, 0.9375]),
    (1, 0, False, 1, 22.5, 1, 2, [0.5, 0.5]), (1, 1, True, None, None, None, None, [0.75, 0.25]), (1, 2, True, None, None, None, None, [0.25, 0.75]),
]


@query(
    "forest_node_scores",
    """SELECT point_id, ((CASE WHEN x <= 25 THEN 0.125 WHEN y <= 30 THEN 0.625 ELSE 0.9375 END) + (CASE WHEN y <= 22.5 THEN 0.25 ELSE 0.75 END)) / 2.0::DOUBLE AS score
    FROM (SELECT point_id, coalesce(slope_deg, 0) AS x, coalesce(clay_percent, 0) AS y FROM points)""",
)
def forest_node_scores(t: Tables):
    """Every point scored by a given table of nodes."""
    nodes = t.spark.createDataFrame(FIXED_NODES, op.NODES)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("slope_deg", "clay_percent")])
    return op.node_scores(nodes, t.points.select("point_id", x.alias("features")), "point_id").select("point_id", F.col("shares")[1].alias("score"))


@query("spatial_cv_rows")
def spatial_cv_rows(t: Tables):
    """Cross-validated metrics over five spatial folds, for three feature sets, and what each gains over the first."""
    df = settle(op.spatial_folds(samples_with_distances(t)))
    return op.with_deltas(op.cv_summary(op.fold_metrics(op.cross_validated(df, op.FEATURE_SETS))), "environment")


@query("spatial_cv", sql_checks(_BLOCKS, sets="3", folds="3 * least(5, count(DISTINCT block))", samples_scored="3 * count(*)", scores_outside="0", metrics_outside="0", not_above_shuffled="0", base_gains="0"))
def spatial_cv(t: Tables):
    """Invariants of the validation: each sample scored once for each feature set by a model of other folds, metrics
    in range, AUC above that of shuffled labels, and no gain of the base set over itself."""
    df = settle(op.spatial_folds(samples_with_distances(t)))
    scores = op.cross_validated(df, op.FEATURE_SETS)
    summary = op.with_deltas(op.cv_summary(op.fold_metrics(scores)), "environment")
    swapped = scores.withColumn("label", (uniform(F.col("set_name"), F.col("score").cast("string"), F.monotonically_increasing_id().cast("string")) < 0.5).cast("int"))
    noise = roc_auc(settle(swapped, "swapped"), "label", "score", ["set_name"]).withColumnRenamed("roc_auc", "noise")
    own = roc_auc(scores, "label", "score", ["set_name"]).join(noise, "set_name")
    metrics = summary.agg(
        F.count(F.lit(1)).alias("sets"), F.sum("folds").alias("folds"),
        sum((outside(f"{n}_mean") for n in ("average_precision", "brier", "accuracy", "precision", "recall", "f1")), F.lit(0)).alias("metrics_outside"),
        F.count_if((F.col("set_name") == "environment") & (F.abs("roc_auc_delta") > 1e-9)).alias("base_gains"),
    )
    counts = scores.agg(F.count(F.lit(1)).alias("samples_scored"), outside("score").alias("scores_outside"))
    above = own.agg(F.count_if(F.col("roc_auc") <= F.col("noise")).alias("not_above_shuffled"))
    return as_checks(metrics.join(counts).join(above).select("sets", "folds", "samples_scored", "scores_outside", "metrics_outside", "not_above_shuffled", "base_gains"))  # one row each


@query("sigmoid_calibration_rows")
def sigmoid_calibration_rows(t: Tables):
    """Brier score of raw and calibrated scores, per spatial fold."""
    return op.calibrated_folds(settle(op.spatial_folds(samples(t))), op.NUMERIC)


@query("sigmoid_calibration", sql_checks(_BLOCKS, folds="least(5, count(DISTINCT block))", samples="count(*)", brier_outside="0", far_worse_than_raw="0"))
def sigmoid_calibration(t: Tables):
    """Invariants of the calibration: every fold and sample, Brier scores in range, and none far above its raw one."""
    found = sigmoid_calibration_rows(t)
    return as_checks(found.agg(
        F.count(F.lit(1)).alias("folds"), F.sum("samples").alias("samples"), (outside("brier_raw") + outside("brier_calibrated")).alias("brier_outside"),
        F.count_if(F.col("brier_calibrated") > F.col("brier_raw") + 0.1).alias("far_worse_than_raw"),
    ))


@query("permutation_importance_rows")
def permutation_importance_rows(t: Tables):
    """Drop of held-out AUC per shuffled feature, over five spatial folds."""
    return op.fold_importance(settle(op.spatial_folds(samples(t))), op.NUMERIC, [*op.NUMERIC, *op.CATEGORIES], "point_id")


@query("permutation_importance", sql_checks(_BLOCKS, features=str(len(op.NUMERIC) + len(op.CATEGORIES)), folds=f"least(5, count(DISTINCT block)) * {len(op.NUMERIC) + len(op.CATEGORIES)}", drops_outside="0", informed_first="1"))
def permutation_importance(t: Tables):
    """Invariants of the importance: every feature in every fold, drops in range, and a feature that the label is made of first."""
    found = permutation_importance_rows(t)
    first = F.max_by("feature", "mean_drop").isin("slope_deg", "clay_percent", "relief_std_5x5_m")
    return as_checks(found.agg(F.count(F.lit(1)).alias("features"), F.sum("folds").alias("folds"), outside("mean_drop", -1.0).alias("drops_outside"), first.cast("int").alias("informed_first")))


CLASSES = fixed.SEVERITY_ORDER


def vectors(t: Tables) -> DataFrame:
    """Embedding rows as features with a four-class target."""
    names = F.array(*[F.lit(c) for c in CLASSES])
    df = t.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 4).alias("y"))
    return df.select("vec_id", array_to_vector("e").alias("features"), F.col("y").cast("double").alias("y"), F.element_at(names, F.col("y") + 1).alias("class_name"))


@query("risk_class_models_rows")
def risk_class_models_rows(t: Tables):
    """Forest, logistic and boosting compared by three stratified folds and a hold-out."""
    return op.compare_models(vectors(t), "vec_id", CLASSES)


_METRICS = [f"{p}{m}" for p in ("", "holdout_") for m in ("macro_f1", "critical_recall", "high_recall", "accuracy")]


@query("risk_class_models", sql_checks("", models="3", metrics_outside="0", best_is_not_first="0"))
def risk_class_models(t: Tables):
    """Invariants of the comparison: three models, all metrics in range, the best macro F1 first."""
    found = settle(risk_class_models_rows(t).withColumn("at", F.monotonically_increasing_id()), "models")
    return as_checks(found.agg(
        F.count_distinct("model").alias("models"), sum((outside(m) for m in _METRICS), F.lit(0)).alias("metrics_outside"),
        (F.min_by("macro_f1", "at") < F.max("macro_f1")).cast("int").alias("best_is_not_first"),
    ))


@query("model_importance_rows")
def model_importance_rows(t: Tables):
    """Impurity and coefficient importance of every embedding dimension."""
    df = settle(op.class_weights(vectors(t), "y"))
    rf = op.class_forest(df, "vec_id")
    lr = LogisticRegression(labelCol="y", featuresCol="features", maxIter=2000).fit(op.dealt(df, "vec_id"))
    return op.importance_table(t.spark, [f"e{i}" for i in range(rf.features)], rf, lr)


@query("model_importance", sql_checks("embeddings", features="max(len(embedding))", impurity_millionths="1000000", coefficient_millionths="1000000", negative="0"))
def model_importance(t: Tables):
    """Invariants of the importances: every dimension, both kinds add up to one, none negative."""
    found = model_importance_rows(t)
    return as_checks(found.agg(
        F.count(F.lit(1)).alias("features"), F.round(F.sum("impurity") * 1e6).alias("impurity_millionths"), F.round(F.sum("coefficient") * 1e6).alias("coefficient_millionths"),
        F.count_if((F.col("impurity") < 0) | (F.col("coefficient") < 0)).alias("negative"),
    ))


def _classified(t: Tables) -> DataFrame:
    return settle(op.class_weights(stratified_split(vectors(t), "class_name", "vec_id"), "y"))


@query("score_table_rows")
def score_table_rows(t: Tables):
    """Class, probabilities and confidence of every row; fitted on 75 % of each class."""
    return op.fitted_score_table(_classified(t), F.col("part") == "train", "vec_id", CLASSES, ["vec_id", "part", "class_name"])


_TRAIN = "(SELECT count(*) AS n, floor(count(*) * 0.75 + 0.5) AS train FROM embeddings GROUP BY label % 4)"


@query("score_table", sql_checks(_TRAIN, rows="sum(n)", train="sum(train)", probabilities_off="0", confidence_off="0", class_off="0", unlike_the_node_table="0"))
def score_table(t: Tables):
    """Invariants of the scored rows: the split, probabilities that add up to one, confidence and class of the largest
    one, and the same probabilities from the node table for every row."""
    df = _classified(t)
    model = op.class_forest(df.filter("part = 'train'"), "vec_id")
    names = [f"p_{c.lower()}" for c in CLASSES]
    scored = settle(op.score_table(model, df, CLASSES, ["vec_id", "part", "class_name"]), "scored")
    again = op.node_scores(op.node_table(t.spark, model), df.select("vec_id", vector_to_array("features").alias("features")), "vec_id")
    largest = F.greatest(*names)
    of_class = F.element_at(F.create_map(*[x for c, n in zip(CLASSES, names) for x in (F.lit(c), F.col(n))]), F.col("risk"))
    apart = [F.abs(F.col(n) - F.col("shares")[k]) for k, n in enumerate(names)]
    return as_checks(scored.join(again, "vec_id", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.abs(sum((F.col(n) for n in names), F.lit(0.0)) - 1) > 1e-9).alias("probabilities_off"),
        F.count_if(F.abs(largest - F.col("confidence")) > 1e-9).alias("confidence_off"), F.count_if(of_class < largest - 1e-9).alias("class_off"),
        F.count_if(F.coalesce(F.greatest(*apart) > 1e-9, F.lit(True))).alias("unlike_the_node_table"),
    ))

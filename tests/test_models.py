"""Invariants of the model jobs."""

from __future__ import annotations

import time
from multiprocessing.pool import ThreadPool

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from slopecast import session
from slopecast.operators import boosting, forests, labels, metrics, models
from slopecast.plans.bindings import Tables
from slopecast.plans.models import CLASSES, samples, vectors
from slopecast.session import settle
from tests.conftest import DATA

FOLDER = DATA.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def folded(spark):
    return settle(models.spatial_folds(samples(Tables(spark, FOLDER))))


def test_folds_are_disjoint_by_block(folded):
    assert folded.groupBy("block").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    for r in models.fold_report(folded).collect():
        assert r.positives > 0 and r.negatives > 0


def test_scores_beat_shuffled_labels(folded):
    scores = models.cross_validated(folded, {"environment": models.NUMERIC}, trees=20, depth=6)
    m = models.fold_metrics(scores).collect()
    assert len(m) == 5 and all(0 <= r.brier <= 1 and 0 <= r.roc_auc <= 1 for r in m)
    mean = sum(r.roc_auc for r in m) / 5
    swapped = scores.withColumn("label", (labels.uniform(F.col("score").cast("string")) < 0.5).cast("int"))
    noise = metrics.roc_auc(swapped, "label", "score").first()[0]
    assert mean > 0.6 and mean > noise + 0.05


def test_preparation_uses_training_rows_only(spark):
    schema = "elevation_m double, soil_class string"
    train = spark.createDataFrame([(1.0, "A"), (3.0, "A"), (None, None), (5.0, "B")], schema)
    p = models.Prepared(train, ["elevation_m"], ["soil_class"])
    out = p.transform(spark.createDataFrame([(None, None), (100.0, "Z")], schema)).collect()
    assert out[0].features.toArray().tolist() == [3.0, 1.0, 0.0] and out[0].soil_class is None
    assert out[1].features.toArray().tolist() == [100.0, 0.0, 0.0]


def test_parameters_are_those_of_the_model(folded):
    m = models.Susceptibility(folded, models.NUMERIC, trees=3, depth=2)
    assert m.parameters()["numTrees"] == "3" and m.parameters()["maxDepth"] == "2"


def test_score_table_probabilities(spark):
    out = entry.queries()["score_table_rows"](spark, DATA)
    total = F.col("p_low") + F.col("p_watch") + F.col("p_high") + F.col("p_critical")
    assert out.filter(F.abs(total - 1.0) > 1e-9).count() == 0
    assert out.filter(F.abs(F.greatest("p_low", "p_watch", "p_high", "p_critical") - F.col("confidence")) > 1e-9).count() == 0


def test_quota_is_exact(spark):
    out = entry.queries()["quota_allocation"](spark, FOLDER)
    assert out.agg(F.sum("quota")).first()[0] == 1000


def test_split_shares(spark):
    out = entry.queries()["stratified_split"](spark, FOLDER)
    for r in out.groupBy("label").agg(F.avg((F.col("part") == "train").cast("int")).alias("s")).collect():
        assert abs(r.s - 0.75) < 0.001


def test_fits_are_repeatable_whatever_the_order_and_partitions(spark):
    df = settle(samples(Tables(spark, DATA)))
    one = models.Susceptibility(df, models.NUMERIC, trees=4, depth=5)
    two = models.Susceptibility(df.orderBy(F.desc("point_id")).repartition(5), models.NUMERIC, trees=4, depth=5)
    assert sorted(map(str, models.node_table(spark, one.model).collect())) == sorted(map(str, models.node_table(spark, two.model).collect()))


def test_node_table_scores_like_the_model(spark):
    df = settle(samples(Tables(spark, DATA)))
    model = models.Susceptibility(df, models.NUMERIC, trees=7, depth=6)
    want = {r.point_id: r.score for r in model.score(df).collect()}
    features = model.prepared.transform(df).select("point_id", vector_to_array("features").alias("features"))
    got = {r.point_id: r.shares[1] for r in models.node_scores(models.node_table(spark, model.model), features, "point_id").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_donors_are_a_bijection(spark):
    for n in (1, 2, 7, 100, 1025, 5000):
        rows = spark.range(n).select("id", models.donor_number(F.col("id"), n, F.lit(3), F.lit(42)).alias("d")).collect()
        assert sorted(r.d for r in rows) == list(range(n))
        assert n < 100 or sum(r.d == r.id for r in rows) < n / 10


def test_forest_is_the_same_from_counts_and_from_groups(spark, monkeypatch):
    """Nodes split from counts of all rows are those that one group grows; neither needs the rows in one place."""
    df = settle(samples(Tables(spark, FOLDER)))
    table = lambda: sorted(map(str, models.node_table(spark, models.Susceptibility(df, models.NUMERIC, trees=3, depth=8).model).collect()))
    whole = table()
    monkeypatch.setattr(forests, "SMALL", 100)
    assert table() == whole and len(whole) > 60


def test_passes_over_the_trees_add_up(spark, monkeypatch):
    """The driver never holds more trees than one pass."""
    df = settle(samples(Tables(spark, DATA)))
    model = models.Susceptibility(df, models.NUMERIC, trees=5, depth=6)
    want = {r.point_id: r.score for r in model.score(df).collect()}
    monkeypatch.setattr(forests, "NODES_A_PASS", 30)
    got = {r.point_id: r.score for r in model.score(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scoring_brings_no_nodes_to_the_driver(spark, monkeypatch):
    """Trees and rows meet on the executors; the driver learns the size of each tree only."""
    df = settle(samples(Tables(spark, DATA)))
    model = models.Susceptibility(df, models.NUMERIC, trees=3, depth=5)
    monkeypatch.setattr(type(df), "toArrow", lambda self: pytest.fail("a table came to the driver"))
    assert model.score(df).where("score between 0 and 1").count() == df.count()


def test_few_rows_are_split_as_by_all_bins(monkeypatch):
    """A node of few rows takes the split that the counts of all bins give, ties included."""
    rng = np.random.default_rng(7)
    codes, y, times = rng.integers(0, 6, (400, 5)).astype(np.uint8), rng.integers(0, 3, 400), rng.integers(1, 4, 400)
    for least in (1, 2):
        plan = forests.Plan(1, 12, least, 42, np.array([1.0, 1.3, 0.7]), [np.arange(6.0)] * 5)
        few = plan.grown(0, 1, codes, y, times)
        with monkeypatch.context() as patch:
            patch.setattr(forests, "WIDTHS", ())
            every = plan.grown(0, 1, codes, y, times)
        assert few.astype(str).equals(every.astype(str)) and len(few) > 100


def test_fits_made_together_score_like_fits_made_alone(spark, folded, monkeypatch):
    """Several models on one table are fitted in the same passes, whatever each of them reads, learns and scores."""
    fold = F.col("fold")
    sets = [models.NUMERIC, models.NUMERIC[:3]]
    fits = [models.Fit(columns, fold != f, fold == f) for columns in sets for f in range(2)]
    scores = lambda: {(r.model, r.point_id): r.score for r in models.scored_apart(folded, fits, trees=5, depth=7).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(models, "Susceptibility", lambda *a, **b: pytest.fail("a model was fitted by itself"))
        together = scores()
    monkeypatch.setattr(forests, "WHOLE", 0)
    alone = scores()
    assert together.keys() == alone.keys() and len(together) > 600
    assert all(abs(together[k] - alone[k]) < 1e-12 for k in alone)


def test_importance_of_all_folds_is_that_of_each_model(spark, folded, monkeypatch):
    """Rows walk the trees while they grow, and replaced ones only from where they part; the drops are those of each model by itself."""
    columns = [*models.NUMERIC, *models.CATEGORIES]
    drops = lambda: {r.feature: (r.folds, r.mean_drop, r.std_drop) for r in models.fold_importance(folded, models.NUMERIC, columns, "point_id", 5, 7).collect()}
    with monkeypatch.context() as patch:
        patch.setattr(models, "Susceptibility", lambda *a, **b: pytest.fail("a model was fitted by itself"))
        together = drops()
    monkeypatch.setattr(forests, "WHOLE", 0)
    alone = drops()
    assert together.keys() == alone.keys() == set(columns)
    assert all(np.allclose(together[c], alone[c], atol=1e-9) for c in columns) and max(d for _, d, _ in together.values()) > 0.01


def test_a_replaced_row_walks_as_if_from_the_root():
    rng = np.random.default_rng(2)
    codes, y = rng.integers(0, 9, (500, 6)).astype(np.uint8), rng.integers(0, 2, 500)
    plan = forests.Plan(1, 9, 2, 42, np.array([1.0, 1.3]), [np.arange(9.0)] * 6)
    tree = plan.arrays(0, codes, y, np.ones(500, np.int64))
    column, donors = np.array([0, 1, 1, 2, 3, 3, 3]), rng.integers(0, 500, (500, 2))  # the last column is nobody's
    vectors = np.concatenate([codes[:, None], codes[donors]], axis=1)

    def walk(rows):
        at = np.zeros(len(rows), np.int64)
        for _ in range(12):
            at = tree.child[at] + (rows[np.arange(len(rows)), tree.feature[at]] > tree.cut[at])
        return tree.shares[at, 1]

    base, given = tree.permuted(vectors, column, 3, np.ascontiguousarray(tree.shares[:, 1]))
    assert (base == walk(codes)).all() and (base == plan.answers(0, codes, y, np.ones(500, np.int64), codes)[:, 1]).all()
    for r in range(2):
        for c in range(3):
            assert (given[:, r, c] == walk(np.where(column[:6] == c, vectors[:, r + 1], codes))).all()


def test_calibration_and_validation_fit_no_model_by_itself(folded, monkeypatch):
    """Their forests share their passes; by themselves, each took some 50 jobs."""
    monkeypatch.setattr(models, "Susceptibility", lambda *a, **b: pytest.fail("a model was fitted by itself"))
    assert models.calibrated_folds(folded, models.NUMERIC, trees=2, depth=3).count() == 5
    assert models.cross_validated(folded, {"environment": models.NUMERIC}, trees=2, depth=3).count() == folded.count()


def test_the_package_is_shipped_once(monkeypatch):
    """Fits that begin side by side register one file; Spark refuses a second one of the same name."""
    files = []

    class Context:
        applicationId = "one"

        def addPyFile(self, path):
            time.sleep(0.05)
            files.append(path)

    session_like = type("Session", (), {"sparkContext": Context()})()
    monkeypatch.setattr(session, "_shipped", set())
    with ThreadPool(4) as pool:
        pool.map(session.ship, [session_like] * 4)
    assert len(files) == 1


def test_risk_models_fitted_together_are_those_fitted_alone(spark, monkeypatch):
    """Spark's own boosting took jobs by the thousand; fitted together, no model but the logistic one is fitted by itself."""
    df = settle(models.class_weights(vectors(Tables(spark, FOLDER)), "y").withColumn("fold", (F.col("vec_id") % 3).cast("int")))
    fits = [(F.col("fold") != f, F.col("fold") == f) for f in (0, 1)]
    together = models.classed_apart(df, "vec_id", fits, 6, 3)
    got = {(r.fit, r.vec_id): r.prediction for r in together.where("model = 'random_forest'").collect()}
    want = {}
    for m, (train, asked) in enumerate(fits):
        out = models.with_classes(models.class_forest(df.where(train), "vec_id", 6), df.where(asked))
        want |= {(m, r.vec_id): r.prediction for r in out.collect()}
    assert got == want and together.where("model = 'boosting'").count() == len(want)
    monkeypatch.setattr(models, "class_forest", lambda *a, **b: pytest.fail("a forest was fitted by itself"))
    assert models.compare_models(df.drop("weight", "fold"), "vec_id", CLASSES, trees=3, rounds=2).count() == 3


def test_a_table_scored_while_its_forest_grows_is_that_of_the_node_table(spark, monkeypatch):
    """No node is written; rows that the forest learned are scored, too."""
    df = settle(models.class_weights(vectors(Tables(spark, FOLDER)), "y"))
    learned, keep = F.col("vec_id") % 4 != 0, ["vec_id", "class_name"]
    want = models.score_table(models.class_forest(df.filter(learned), "vec_id", 7), df, CLASSES, keep)
    want = {r.vec_id: r for r in want.collect()}
    with monkeypatch.context() as patch:
        patch.setattr(models, "class_forest", lambda *a, **b: pytest.fail("a node table was made"))
        got = {r.vec_id: r for r in models.fitted_score_table(df, learned, "vec_id", CLASSES, keep, 7).collect()}
    assert got.keys() == want.keys() and len(got) == df.count()
    assert all(got[k].risk == want[k].risk and np.allclose(got[k][3:], want[k][3:], atol=1e-12) for k in got)


def test_boosting_is_that_of_spark(spark):
    """The same trees as Spark's boosting where all values of the features are bins of their own."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (600, 4)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 5) * x[:, 2] + rng.normal(0, 3, 600) > 10).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "x array<double>, y int").select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("y")).coalesce(1)
    model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=8, stepSize=0.1, maxDepth=3, seed=models.SEED).fit(df)
    want = np.array([r.r for r in model.transform(df).select(vector_to_array("rawPrediction")[1].alias("r")).collect()])
    got = boosting.margins(x.astype(np.uint8), y == 1, x.astype(np.uint8), 8, 0.1, 3)
    scale = want @ got / (got @ got)  # the same up to a constant, which changes no class
    assert scale > 0 and np.allclose(want, scale * got, atol=1e-6)

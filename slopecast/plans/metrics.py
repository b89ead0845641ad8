"""Metric queries over the labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import rounded
from slopecast.operators import metrics as op
from slopecast.plans.bindings import SQL_TABLES, Tables, rnd
from slopecast.plans.registry import query


def _tier(c: str) -> str:
    return f"CASE WHEN {c} >= 0.75 THEN 'Critical' WHEN {c} >= 0.5 THEN 'High' WHEN {c} >= 0.25 THEN 'Watch' ELSE 'Low' END"


CLASSES = ["doc_id", f"{_tier('p')} AS y_class", f"{_tier('(p + p2) / 2')} AS h_class"]
SQL_TABLES["classes"] = f"SELECT {', '.join(CLASSES)} FROM scored"
_ORDER = ", ".join(f"('{c}')" for c in fixed.SEVERITY_ORDER)


@query(
    "confusion_metrics",
    f"""WITH k AS (SELECT c, (SELECT count(*) FROM classes WHERE y_class = c AND h_class = c) AS tp, (SELECT count(*) FROM classes WHERE y_class = c) AS support,
      (SELECT count(*) FROM classes WHERE h_class = c) AS called FROM (VALUES {_ORDER}) v(c)),
    m AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0.0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS r FROM k),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)
    SELECT c AS scope, 'precision' AS metric, {rnd('p')} AS value FROM f UNION ALL SELECT c, 'recall', {rnd('r')} FROM f UNION ALL SELECT c, 'f1', {rnd('f1')} FROM f
    UNION ALL SELECT 'all', 'accuracy', {rnd('sum(tp) / sum(support)')} FROM f
    UNION ALL SELECT 'macro', 'precision', {rnd('avg(p)')} FROM f UNION ALL SELECT 'macro', 'recall', {rnd('avg(r)')} FROM f UNION ALL SELECT 'macro', 'f1', {rnd('avg(f1)')} FROM f
    UNION ALL SELECT 'weighted', 'precision', {rnd('sum(p * support) / sum(support)')} FROM f UNION ALL SELECT 'weighted', 'recall', {rnd('sum(r * support) / sum(support)')} FROM f
    UNION ALL SELECT 'weighted', 'f1', {rnd('sum(f1 * support) / sum(support)')} FROM f""",
)
def confusion_metrics(t: Tables):
    out = op.class_metrics(t.scored.selectExpr(*CLASSES), "y_class", "h_class", fixed.SEVERITY_ORDER)
    return out.withColumn("value", rounded(F.col("value")))


@query(
    "confusion_matrix",
    f"""SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM classes WHERE y_class = a.c AND h_class = b.c) AS n FROM (VALUES {_ORDER}) a(c), (VALUES {_ORDER}) b(c)""",
)
def confusion_matrix(t: Tables):
    return op.confusion(t.scored.selectExpr(*CLASSES), "y_class", "h_class", fixed.SEVERITY_ORDER)


@query(
    "roc_auc_exact",
    f"""SELECT {rnd('(SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) FROM scored a, scored b WHERE a.y = 1 AND b.y = 0)')} AS roc_auc,
    {rnd('(SELECT avg(CASE WHEN a.p2 > b.p2 THEN 1.0 WHEN a.p2 = b.p2 THEN 0.5 ELSE 0.0 END) FROM scored a, scored b WHERE a.y = 1 AND b.y = 0)')} AS roc_auc_2""",
)
def roc_auc_exact(t: Tables):
    long = t.scored.select("y", F.explode(F.array(F.struct(F.lit(1).alias("w"), F.col("p").alias("s")), F.struct(F.lit(2).alias("w"), F.col("p2").alias("s")))).alias("x")).select("y", "x.*")
    out = op.roc_auc(long, "y", "s", ["w"])
    return out.agg(
        rounded(F.max(F.when(F.col("w") == 1, F.col("roc_auc")))).alias("roc_auc"),
        rounded(F.max(F.when(F.col("w") == 2, F.col("roc_auc")))).alias("roc_auc_2"),
    )


@query(
    "average_precision",
    f"""SELECT {rnd('sum(pos * tp / alln) / sum(pos)')} AS average_precision FROM (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS alln
    FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY p))""",
)
def average_precision(t: Tables):
    return op.average_precision(t.scored, "y", "p").select(rounded(F.col("average_precision")).alias("average_precision"))


@query(
    "brier_reliability",
    f"""SELECT 'brier' AS kind, 'p' AS name, count(*) AS n, {rnd('avg(pow(p - y, 2))')} AS a, CAST(NULL AS DOUBLE) AS b FROM scored
    UNION ALL SELECT 'brier', 'p2', count(*), {rnd('avg(pow(p2 - y, 2))')}, NULL FROM scored
    UNION ALL SELECT 'bin', CAST(bin AS VARCHAR), count(*), {rnd('avg(p)')}, {rnd('avg(y)')} FROM (SELECT *, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin FROM scored) GROUP BY bin""",
)
def brier_reliability(t: Tables):
    b = op.brier(t.scored, "y", ["p", "p2"]).select(
        F.lit("brier").alias("kind"), F.col("score").alias("name"), "n", rounded(F.col("brier")).alias("a"), F.lit(None).cast("double").alias("b")
    )
    r = op.reliability(t.scored, "y", "p").select(
        F.lit("bin").alias("kind"), F.col("bin").cast("string").alias("name"), "n", F.col("mean_predicted").alias("a"), F.col("fraction_positive").alias("b")
    )
    return b.unionByName(r)

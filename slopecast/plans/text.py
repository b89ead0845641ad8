"""Report-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions import text as tx
from slopecast.operators import text as op
from slopecast.plans.bindings import SQL_TABLES, Tables
from slopecast.plans.hazard import rd
from slopecast.plans.registry import query

_Q = "'([-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)\\s*([a-zA-Z°%]+)?'"
_VALUE = f"TRY_CAST(nullif(regexp_extract(trim(text), {_Q}, 1), '') AS DOUBLE)"
_UNIT = f"lower(nullif(regexp_extract(trim(text), {_Q}, 2), ''))"
_NEG = "(^|[^\\p{L}\\p{N}_])(no\\s+past|no\\s+prior|no\\s+previous|no\\s+historical|no\\s+landslide|none|false|0|absent|zero)([^\\p{L}\\p{N}_]|$)"
_POS = "(^|[^\\p{L}\\p{N}_])(occurred|previous|past|history|yes|true|documented|prior|1|present|recorded)([^\\p{L}\\p{N}_]|$)"
_FLAG = f"CASE WHEN regexp_matches(trim(lower(text)), '{_NEG}') THEN 0 WHEN regexp_matches(trim(lower(text)), '{_POS}') THEN 1 END"


@query(
    "quantity_parse",
    f"""SELECT 'line' AS kind, doc_id, line_no, {_VALUE} AS number, {_UNIT} AS unit FROM entities
    UNION ALL SELECT 'document', doc_id, NULL, {_VALUE}, CASE WHEN {_VALUE} IS NOT NULL THEN {_UNIT} END FROM documents""",
)
def quantity_parse(t: Tables):
    """First number and unit of every mention and of every whole document."""
    number, unit = tx.quantity_value(F.col("text")).alias("number"), tx.quantity_unit(F.col("text")).alias("unit")
    lines = t.entities.select(F.lit("line").alias("kind"), "doc_id", "line_no", number, unit)
    docs = t.raw("documents").select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("int").alias("line_no"), number, unit)
    return lines.unionByName(docs)


def sql_normal(src: str) -> str:
    """Adds v and w to rows with kind, x and u."""
    deg, ft = rd("degrees(atan(x / 100.0))", 2), rd("x * 0.3048", 2)
    return f"""SELECT *, CASE kind WHEN 'rain' THEN CASE WHEN u = 'cm' THEN x * 10 WHEN u = 'inches' THEN x * 25.4 WHEN u = 'm' THEN x * 1000 ELSE x END
      WHEN 'slope' THEN CASE WHEN u = '%' THEN {deg} ELSE x END
      WHEN 'elevation' THEN CASE WHEN u = 'ft' THEN {ft} WHEN u = 'km' THEN x * 1000 ELSE x END
      WHEN 'distance' THEN CASE WHEN u = 'm' THEN {rd('x / 1000.0', 4)} WHEN u = 'miles' THEN {rd('x * 1.60934', 4)} ELSE x END
      WHEN 'soil' THEN CASE WHEN u = '%' THEN {rd('x / 100.0', 4)} WHEN x BETWEEN 0 AND 1 THEN {rd('x', 4)} WHEN x > 1 AND x <= 10 THEN {rd('x / 10.0', 4)} WHEN x > 10 AND x <= 100 THEN {rd('x / 100.0', 4)} END END AS v,
      CASE WHEN x IS NULL THEN CASE WHEN kind = 'soil' THEN 'QUALITATIVE' ELSE 'NO_NUMBER' END WHEN u = 'litres' THEN 'UNKNOWN_UNIT'
      WHEN kind = 'soil' AND NOT (x BETWEEN 0 AND 100) THEN 'OUT_OF_RANGE' END AS w FROM ({src})"""


KIND = (
    "CASE lower(trim(label)) WHEN 'slope angle' THEN 'slope' WHEN 'altitude' THEN 'elevation' WHEN 'distance' THEN 'distance' "
    "WHEN 'soil risk' THEN 'soil' ELSE 'rain' END"
)


@query(
    "unit_normalize",
    f"""SELECT doc_id, line_no, kind, v AS normal, w AS warning FROM ({sql_normal(f"SELECT doc_id, line_no, {KIND} AS kind, {_VALUE} AS x, {_UNIT} AS u FROM entities WHERE label <> 'historical landslide'")})""",
)
def unit_normalize(t: Tables):
    q = t.entities.filter("label <> 'historical landslide'").selectExpr("doc_id", "line_no", f"{KIND} AS kind", "text")
    n = tx.normal_quantity(F.col("kind"), tx.quantity_value(F.col("text")), tx.quantity_unit(F.col("text")))
    return q.withColumn("n", n).select("doc_id", "line_no", "kind", F.col("n.value").alias("normal"), F.col("n.warning").alias("warning"))


@query("negation_flag", f"SELECT doc_id, {_FLAG} AS flag FROM documents UNION ALL SELECT -1 - doc_id, {_FLAG} FROM entities")
def negation_flag(t: Tables):
    """Statement of a past landslide in every whole document and every mention."""
    docs = t.raw("documents").select("doc_id", tx.landslide_flag(F.col("text")).alias("flag"))
    lines = t.entities.select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), tx.landslide_flag(F.col("text")).alias("flag"))
    return docs.unionByName(lines)


_FEATURE = {
    "24-hour rainfall": "rainfall_24h", "rainfall": "generic", "3-day rainfall": "rainfall_3d", "weekly rainfall": "rainfall_7d", "slope angle": "slope",
    "altitude": "elevation", "historical landslide": "historical_landslide", "distance": "distance_to_landslide", "soil risk": "soil_risk",
}
_FIRST = f"""SELECT doc_id, lower(trim(label)) AS label, text, {KIND} AS kind, {_VALUE} AS x, {_UNIT} AS u FROM entities
    QUALIFY row_number() OVER (PARTITION BY doc_id, lower(trim(label)) ORDER BY line_no, text) = 1"""
_PIVOT = ", ".join(
    f"max(CASE WHEN label = '{lab}' THEN v END) AS {f}, max(CASE WHEN label = '{lab}' THEN w END) AS w_{f}, max(CASE WHEN label = '{lab}' THEN 1 END) AS has_{f}"
    for lab, f in _FEATURE.items() if f != "historical_landslide"
)
SQL_TABLES["ent_wide"] = f"""SELECT doc_id, {_PIVOT}, max(CASE WHEN label = 'historical landslide' THEN {_FLAG} END) AS said_label FROM ({sql_normal(_FIRST)}) GROUP BY doc_id"""
SQL_TABLES["ent_feat"] = f"""SELECT e.doc_id, CASE WHEN unplaced AND daily THEN generic ELSE rainfall_24h END AS rainfall_24h, rainfall_3d, rainfall_7d, slope, elevation,
    CAST(coalesce(said_label, said) AS DOUBLE) AS historical_landslide, distance_to_landslide, soil_risk, unplaced AND NOT daily AS ambiguous,
    {', '.join(f'w_{f}' for f in fixed.FEATURES if f != 'historical_landslide')} FROM
    (SELECT w.*, has_rainfall_24h IS NULL AND generic IS NOT NULL AS unplaced, coalesce(lower(d.text) LIKE '%24-hour%' OR lower(d.text) LIKE '%24 hour%' OR lower(d.text) LIKE '%daily%', false) AS daily,
      {_FLAG.replace('(text)', '(d.text)')} AS said FROM ent_wide w LEFT JOIN documents d USING (doc_id)) e"""
_GONE = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in fixed.FEATURES) + ")"


def _bad(n, lo, hi) -> str:
    if lo is None:
        return f"CASE WHEN {n} NOT IN (0, 1) THEN 'NOT_ALLOWED:{n}' END"
    return f"CASE WHEN {n} < {lo} THEN 'BELOW_MIN:{n}' WHEN {n} > {hi} THEN 'ABOVE_MAX:{n}' END"


_BROKEN = ", ".join(_bad(*f) for f in fixed.FEATURE_LIMITS)
_COMPLETE = " AND ".join(f"{f} IS NOT NULL" for f in fixed.FEATURES)
_WARN = ", ".join(f"w_{f} || ':{f}'" for f in fixed.FEATURES if f != "historical_landslide")


@query(
    "entity_to_feature",
    f"""SELECT doc_id, {', '.join(fixed.FEATURES)}, {_GONE} AS missing, {_COMPLETE} AND concat_ws(',', {_BROKEN}) = '' AS prediction_ready,
    concat_ws(',', {_WARN}, CASE WHEN ambiguous THEN 'AMBIGUOUS_RAINFALL' END, CASE WHEN {_COMPLETE} THEN nullif(concat_ws(',', {_BROKEN}), '') END) AS warnings FROM ent_feat""",
)
def entity_to_feature(t: Tables):
    out = op.entity_features(t.entities, t.raw("documents").select("doc_id", "text"))
    return out.select(
        "doc_id", *fixed.FEATURES, F.array_join("missing_features", ",").alias("missing"), "prediction_ready",
        F.array_join("warnings", ",").alias("warnings"),
    )

"""Label-construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast.functions.columns import rounded
from slopecast.operators import labels as op
from slopecast.plans.bindings import SQL_TABLES, Tables, rnd, sql_haversine
from slopecast.plans.registry import query
from slopecast.plans.spatial import INSIDE_SQL

LABEL = "CASE WHEN event_no % 10 < 3 THEN 1 ELSE 0 END AS label"


def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


SQL_TABLES["cand"] = f"""SELECT q.state, q.quota, d.draw, b.x0 + (b.xm - b.x0) * {_u("'42'", 'q.state', 'CAST(d.draw AS VARCHAR)', "'lon'")} AS longitude,
    b.y0 + (b.ym - b.y0) * {_u("'42'", 'q.state', 'CAST(d.draw AS VARCHAR)', "'lat'")} AS latitude
    FROM (SELECT inside_state AS state, count(*) AS quota FROM ({INSIDE_SQL}) GROUP BY 1) q
    JOIN (SELECT state, min(lon) AS x0, max(lon) AS xm, min(lat) AS y0, max(lat) AS ym FROM vertices GROUP BY state) b ON b.state = q.state
    JOIN (SELECT unnest(range(1, (SELECT 3 * count(*) + 1 FROM points))) AS draw) d ON d.draw <= 3 * q.quota"""
_CP = sql_haversine("c.latitude", "c.longitude", "p.latitude", "p.longitude")
NEGATIVE_SQL = f"""SELECT state, draw, {rnd('latitude')} AS latitude, {rnd('longitude')} AS longitude, rn AS candidate_no FROM
    (SELECT c.*, row_number() OVER (PARTITION BY state ORDER BY draw) AS rn FROM cand c
      WHERE (SELECT count(*) FROM edges e WHERE e.state = c.state AND (e.y1 > c.latitude) <> (e.y2 > c.latitude)
        AND c.longitude < e.x1 + (c.latitude - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)) % 2 = 1
      AND NOT EXISTS (SELECT 1 FROM points p WHERE {_CP} <= 1.0)) WHERE rn <= quota"""


@query("negative_candidates", NEGATIVE_SQL)
def negative_candidates(t: Tables):
    """Candidates away from the positive points, as many per state as there are positives."""
    out = op.negative_candidates(t.points, t.vertices)
    return out.withColumns({"latitude": rounded(F.col("latitude")), "longitude": rounded(F.col("longitude"))})


@query(
    "quota_allocation",
    """SELECT state, members, CAST(raw + CASE WHEN row_number() OVER (ORDER BY members DESC, state) = 1 THEN 1000 - sum(raw) OVER () ELSE 0 END AS BIGINT) AS quota FROM
    (SELECT raw_state AS state, count(*) AS members, CAST(floor(count(*) * 1000.0 / (SELECT count(*) FROM inventory) + 0.5) AS BIGINT) AS raw FROM inventory GROUP BY 1)""",
)
def quota_allocation(t: Tables):
    return op.quota_allocation(t.inventory.select(F.col("raw_state").alias("state")), "state", 1000)


@query(
    "stratified_bootstrap",
    f"""WITH r AS (SELECT label, event_no, row_number() OVER (PARTITION BY label ORDER BY event_no) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT event_no, {LABEL} FROM inventory)),
    d AS (SELECT label, n, unnest(range(0, (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM inventory))) AS draw FROM (SELECT DISTINCT label, n FROM r))
    SELECT d.label, d.draw, r.event_no FROM d JOIN r ON r.label = d.label AND r.rn = 1 + CAST(floor({_u("'42'", 'CAST(d.label AS VARCHAR)', 'CAST(d.draw AS VARCHAR)')} * d.n) AS BIGINT)""",
)
def stratified_bootstrap(t: Tables):
    return op.stratified_bootstrap(t.inventory.selectExpr("event_no", LABEL), "label", "event_no")


@query(
    "stratified_split",
    f"""SELECT event_no, label, CASE WHEN rn <= floor(n * 0.75 + 0.5) THEN 'train' ELSE 'test' END AS part FROM
    (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || event_no), event_no) AS rn, count(*) OVER (PARTITION BY label) AS n
     FROM (SELECT event_no, {LABEL} FROM inventory))""",
)
def stratified_split(t: Tables):
    return op.stratified_split(t.inventory.selectExpr("event_no", LABEL), "label", "event_no")


@query(
    "spatial_blocks",
    f"""SELECT 'B_' || CAST(floor(latitude) AS BIGINT) || '_' || CAST(floor(longitude) AS BIGINT) AS block, count(*) AS n_samples, count(*) FILTER (label = 1) AS pos_count,
    count(*) FILTER (label = 0) AS neg_count, {rnd('avg(latitude)')} AS mean_lat, {rnd('avg(longitude)')} AS mean_lon FROM (SELECT latitude, longitude, {LABEL} FROM inventory) GROUP BY 1""",
)
def spatial_blocks(t: Tables):
    return op.mean_columns(op.block_table(t.inventory.selectExpr("latitude", "longitude", LABEL)))


@query(
    "label_balance",
    f"""SELECT state, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
    count(*) FILTER (label = 1) <> count(*) FILTER (label = 0) AS imbalanced FROM (SELECT raw_state AS state, {LABEL} FROM inventory) GROUP BY state""",
)
def label_balance(t: Tables):
    return op.label_balance(t.inventory.selectExpr("raw_state AS state", LABEL), "state", "label")


@query("stable_sample_order", f"SELECT event_no, raw_state AS state, {LABEL} FROM inventory ORDER BY label DESC, state, event_no")
def stable_sample_order(t: Tables):
    return op.stable_order(t.inventory.selectExpr("event_no", "raw_state AS state", LABEL), "label", "state", "event_no")

"""Terrain queries on the bound elevation grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import rounded
from slopecast.operators import terrain as op
from slopecast.plans.bindings import SQL_TABLES, Tables, rnd
from slopecast.plans.hazard import rd
from slopecast.plans.registry import query

STEP = 1.0 / 3600.0
DY = STEP * fixed.METRES_PER_DEGREE


def dx():
    """Cell width at the row's latitude; row 0 lies at 27 degrees north."""
    return F.cos(F.radians(27.0 - F.col("grid_row") * STEP)) * (STEP * fixed.METRES_PER_DEGREE)


def stencil(t: Tables):
    return op.stencil(t.grid, dx(), F.lit(DY))


_NINE = ", ".join(
    f"max(CASE WHEN dr = {i} AND dc = {j} THEN n.elev END) AS y{i + 2}{j + 2}" for i in (-1, 0, 1) for j in (-1, 0, 1)
)
SQL_TABLES["nine"] = f"""SELECT g.grid_row, g.grid_col, g.elev, {_NINE}, count(*) - count(n.elev) AS gaps
    FROM grid g, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc), grid n
    WHERE n.grid_row = least((SELECT max(grid_row) FROM grid), greatest(0, g.grid_row + dr)) AND n.grid_col = least(99, greatest(0, g.grid_col + dc)) GROUP BY ALL"""
SQL_TABLES["five"] = """SELECT g.grid_row, g.grid_col, count(n.elev) AS valid, count(n.grid_row) AS cells, avg(n.elev) AS mean5, stddev_pop(n.elev) AS std5
    FROM grid g, (VALUES (-2), (-1), (0), (1), (2)) a(dr), (VALUES (-2), (-1), (0), (1), (2)) b(dc), grid n
    WHERE n.grid_row = g.grid_row + dr AND n.grid_col = g.grid_col + dc GROUP BY ALL"""
_Z = ", ".join(f"coalesce(y{i}{j}, elev) AS z{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
_DXS, _DYS = "(cos(radians(27.0 - grid_row / 3600.0)) * (111320.0 / 3600.0))", "(111320.0 / 3600.0)"
SQL_TABLES["relief"] = f"""SELECT *, degrees(atan(sqrt(p * p + q * q))) AS slope, p * p + q * q AS g FROM (SELECT *,
    ((z13 + 2 * z23 + z33) - (z11 + 2 * z21 + z31)) / (8 * dx) AS p, ((z11 + 2 * z12 + z13) - (z31 + 2 * z32 + z33)) / (8 * dy) AS q
    FROM (SELECT nine.*, valid, cells, mean5, std5, {_Z}, {_DXS.replace('grid_row', 'nine.grid_row')} AS dx, {_DYS} AS dy FROM nine JOIN five ON nine.grid_row = five.grid_row AND nine.grid_col = five.grid_col))"""
_R, _T = "((z21 - 2 * z22 + z23) / (dx * dx))", "((z12 - 2 * z22 + z32) / (dy * dy))"
_S = "((z13 + z31 - z11 - z33) / (4 * dx * dy))"
SQL_TABLES["curved"] = f"""SELECT *, CASE WHEN elev IS NULL THEN NULL WHEN g > 1e-8 THEN -(p * p * {_R} + 2 * p * q * {_S} + q * q * {_T}) / (g * pow(1 + g, 1.5)) * 100 ELSE 0.0 END AS prof,
    CASE WHEN elev IS NULL THEN NULL WHEN g > 1e-8 THEN -(q * q * {_R} - 2 * p * q * {_S} + p * p * {_T}) / pow(g, 1.5) * 100 ELSE 0.0 END AS plan FROM relief"""
_TRI = "sqrt((" + " + ".join(f"pow(z{i}{j} - z22, 2)" for i in (1, 2, 3) for j in (1, 2, 3) if (i, j) != (2, 2)) + ") / 8)"
SQL_TABLES["placed"] = f"""SELECT *, CASE WHEN tpi < -5 THEN 'Valley Bottom / Deep Hollow' WHEN tpi < -1 THEN 'Foot-Slope / Toe Cut'
    WHEN tpi <= 1 THEN CASE WHEN slope > 10 THEN 'Mid-Slope' ELSE 'Flat Valley Terrace' END WHEN tpi <= 5 THEN 'Upper Slope / Shoulder' WHEN tpi > 5 THEN 'Ridge / Crest' END AS slope_position
    FROM (SELECT *, CASE WHEN elev IS NOT NULL THEN {_TRI} END AS tri, elev - mean5 AS tpi FROM curved)"""


@query(
    "slope_aspect",
    f"""SELECT grid_row, grid_col, CASE WHEN elev IS NOT NULL THEN {rnd('slope')} END AS slope_deg,
    CASE WHEN elev IS NOT NULL AND NOT (p = 0 AND q = 0) THEN {rnd('CASE WHEN atan2(-p, -q) < 0 THEN degrees(atan2(-p, -q)) + 360 ELSE degrees(atan2(-p, -q)) END')} END AS aspect_deg,
    CASE WHEN elev IS NULL THEN 'NODATA' WHEN cells < 25 OR gaps > 0 OR valid < 13 THEN 'PARTIAL_WINDOW' ELSE 'OK' END AS terrain_quality FROM relief""",
)
def slope_aspect(t: Tables):
    return op.slope_aspect(stencil(t)).select(
        "grid_row", "grid_col", rounded(F.col("slope_deg")).alias("slope_deg"), rounded(F.col("aspect_deg")).alias("aspect_deg"), "terrain_quality"
    )


@query(
    "local_relief",
    f"SELECT grid_row, grid_col, CASE WHEN elev IS NOT NULL AND valid >= 13 THEN {rnd('std5')} END AS relief_std_5x5_m FROM relief",
)
def local_relief(t: Tables):
    return op.local_relief(stencil(t)).select("grid_row", "grid_col", rounded(F.col("relief_std_5x5_m")).alias("relief_std_5x5_m"))


@query(
    "curvature",
    f"""SELECT grid_row, grid_col, {rnd('prof')} AS profile_curvature, {rnd('plan')} AS plan_curvature, CASE WHEN elev IS NULL THEN NULL
    WHEN plan < -0.05 AND prof < -0.05 THEN 'Concave-Convergent (Hollow / Extreme Accumulation Risk)' WHEN plan < -0.05 AND prof > 0.05 THEN 'Convex-Convergent (Channeled Drainage)'
    WHEN plan > 0.05 AND prof < -0.05 THEN 'Concave-Divergent (Decelerating Dispersal)' WHEN plan > 0.05 AND prof > 0.05 THEN 'Convex-Divergent (Shedding Ridge / Stable)'
    WHEN plan < -0.05 THEN 'Convergent (Gully Channel)' WHEN plan > 0.05 THEN 'Divergent (Nose / Ridge)' WHEN prof < -0.05 THEN 'Concave (Decelerating Slope)'
    WHEN prof > 0.05 THEN 'Convex (Accelerating Slope)' ELSE 'Planar (Uniform Slope)' END AS curvature_class FROM curved""",
)
def curvature(t: Tables):
    return op.curvature(stencil(t)).select(
        "grid_row", "grid_col", rounded(F.col("profile_curvature")).alias("profile_curvature"),
        rounded(F.col("plan_curvature")).alias("plan_curvature"), "curvature_class",
    )


@query(
    "ruggedness_position",
    f"SELECT grid_row, grid_col, {rnd('tri')} AS tri_m, {rnd('tpi')} AS tpi_m, slope_position FROM placed",
)
def ruggedness_position(t: Tables):
    return op.ruggedness_position(op.slope_aspect(stencil(t))).select(
        "grid_row", "grid_col", rounded(F.col("tri_m")).alias("tri_m"), rounded(F.col("tpi_m")).alias("tpi_m"), "slope_position"
    )


@query(
    "wetness_multiplier",
    f"""SELECT grid_row, grid_col, CASE WHEN elev IS NOT NULL THEN {rnd('ln(greatest(dx, dx * greatest(0.5, 1.0 - least(2.0, greatest(-2.0, plan)) * 0.3)) / tan(greatest(radians(0.5), radians(slope))))')} END AS topographic_wetness_index,
    CASE WHEN elev IS NOT NULL THEN {rd("least(1.5, greatest(0.8, 1.0 + CASE WHEN slope >= 25 THEN 0.15 ELSE 0.0 END + CASE WHEN plan < -0.05 THEN 0.15 ELSE 0.0 END + CASE WHEN prof < -0.05 THEN 0.1 ELSE 0.0 END + CASE WHEN slope_position IN ('Foot-Slope / Toe Cut', 'Valley Bottom / Deep Hollow') THEN 0.1 ELSE 0.0 END))", 2)} END AS terrain_multiplier FROM placed""",
)
def wetness_multiplier(t: Tables):
    return op.terrain(t.grid, dx(), F.lit(DY)).select(
        "grid_row", "grid_col", rounded(F.col("topographic_wetness_index")).alias("topographic_wetness_index"), "terrain_multiplier"
    )


@query(
    "bilinear_resample",
    f"""SELECT point_id, CASE WHEN count(g.elev) = 4 THEN {rnd('sum(w * g.elev)')} END AS interpolated FROM
    (SELECT point_id, fr + a AS r, fc + b AS c, CASE WHEN a = 1 THEN y - fr ELSE 1 - (y - fr) END * CASE WHEN b = 1 THEN x - fc ELSE 1 - (x - fc) END AS w FROM
      (SELECT point_id, (30.0 - latitude) / 0.1 AS y, (longitude - 88.0) / 0.1 AS x, CAST(floor((30.0 - latitude) / 0.1) AS BIGINT) AS fr, CAST(floor((longitude - 88.0) / 0.1) AS BIGINT) AS fc FROM points),
      (VALUES (0), (1)) va(a), (VALUES (0), (1)) vb(b)) k LEFT JOIN grid g ON g.grid_row = k.r AND g.grid_col = k.c GROUP BY point_id""",
)
def bilinear_resample(t: Tables):
    return op.bilinear(t.points, t.grid, fixed.LAT_MAX, fixed.LON_MIN, 0.1).select(
        "point_id", rounded(F.col("interpolated")).alias("interpolated")
    )


@query(
    "grid_stats",
    f"""SELECT CAST(floor(grid_row / 50) AS BIGINT) AS tile_row, CAST(floor(grid_col / 50) AS BIGINT) AS tile_col, {rnd('min(elev)')} AS min_elev, {rnd('max(elev)')} AS max_elev,
    {rnd('avg(elev)')} AS mean_elev, {rnd('max(elev) - min(elev)')} AS relief, count(elev) AS valid_cells, count(*) - count(elev) AS nodata_cells FROM grid GROUP BY 1, 2""",
)
def grid_stats(t: Tables):
    keys = [F.floor(F.col("grid_row") / 50).alias("tile_row"), F.floor(F.col("grid_col") / 50).alias("tile_col")]
    out = op.grid_stats(t.grid, keys)
    return out.withColumns({c: rounded(F.col(c)) for c in ("min_elev", "max_elev", "mean_elev", "relief")})


@query(
    "grid_downsample",
    f"SELECT CAST(floor(grid_row / 10) AS BIGINT) AS out_row, CAST(floor(grid_col / 10) AS BIGINT) AS out_col, {rnd('avg(elev)')} AS elev, count(elev) AS valid_cells FROM grid GROUP BY 1, 2",
)
def grid_downsample(t: Tables):
    return op.downsample(t.grid, 10).withColumn("elev", rounded(F.col("elev")))

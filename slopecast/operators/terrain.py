"""Terrain attributes of elevation grids held as rows (grid_row, grid_col, elev)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.functions.columns import clamp, rounded

MIN_VALID_5X5 = 13
REACH = 2
#: Cells that a task of the stencil has, about.
CELLS = 32_768


def neighbourhood(grid: DataFrame, keys: Sequence[str] = (), block: int = 256) -> DataFrame:
    """Add n_<dr>_<dc> for dr, dc in -2..2: NULL outside the grid, else a struct with z (NULL = no data).

    The grid is dealt once, in square blocks with a margin of two cells, and both window passes, along the rows of a
    block and down its columns, run inside that exchange. A window group is one line of a block,
    however wide or high the grid is; only the margin is copied. The number of tasks follows the cells, as narrow
    rows come in and wide ones go out: by the bytes that are dealt, too many rows would share a task.
    """
    tasks = max(1, math.ceil(grid.count() / CELLS))
    cell = F.when(F.col("grid_row").isNotNull(), F.struct(F.col("elev").alias("z")))
    r, c = F.col("grid_row"), F.col("grid_col")

    def homes(at: Column) -> Column:
        return F.array_distinct(F.array(F.floor((at - REACH) / block), F.floor(at / block), F.floor((at + REACH) / block)))

    both = F.flatten(F.transform(homes(r), lambda i: F.transform(homes(c), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    dealt = grid.select(*keys, "grid_row", "grid_col", "elev", F.explode(both).alias("_b"))
    dealt = dealt.select(*keys, "grid_row", "grid_col", "elev", F.col("_b.i").alias("_bi"), F.col("_b.j").alias("_bj")).repartition(tasks, *keys, "_bi", "_bj")
    along = Window.partitionBy(*keys, "_bi", "_bj", "grid_row").orderBy("grid_col")
    down = Window.partitionBy(*keys, "_bi", "_bj", "grid_col").orderBy("grid_row")

    def beside(k: int) -> Column:
        shift = F.lag if k < 0 else F.lead
        # with gaps the wanted column may be one of the nearer entries
        options = [shift(F.struct(c.alias("at"), cell.alias("c")), j).over(along) for j in range(abs(k), 0, -1)]
        return F.coalesce(*[F.when(o["at"] == c + k, o["c"]) for o in options])

    wide = dealt.withColumn(
        "_line", F.struct(cell.alias("p0"), *[beside(k).alias(f"{'m' if k < 0 else 'p'}{abs(k)}") for k in (-2, -1, 1, 2)])
    )

    def above(k: int) -> Column:
        if k == 0:
            return F.col("_line")
        shift = F.lag if k < 0 else F.lead
        options = [shift(F.struct(r.alias("at"), F.col("_line").alias("l")), j).over(down) for j in range(abs(k), 0, -1)]
        return F.coalesce(*[F.when(o["at"] == r + k, o["l"]) for o in options])

    wide = wide.withColumns({f"_l{k}": above(k) for k in range(-REACH, REACH + 1)})
    wide = wide.filter((F.col("_bi") == F.floor(r / block)) & (F.col("_bj") == F.floor(c / block)))
    names = {-2: "m2", -1: "m1", 0: "p0", 1: "p1", 2: "p2"}
    return wide.select(
        *keys, "grid_row", "grid_col", "elev",
        *[F.col(f"_l{dr}")[names[dc]].alias(n_name(dr, dc)) for dr in names for dc in names],
    )


def n_name(dr: int, dc: int) -> str:
    return f"n_{dr}_{dc}".replace("-", "m")


def _at(dr: int, dc: int) -> Column:
    """Value of a 3 x 3 neighbour: the edge repeats outward, no data takes the centre value."""
    own = F.coalesce(
        F.col(n_name(dr, dc)), F.col(n_name(0, dc)) if dr else F.col(n_name(dr, 0)), F.col(n_name(dr, 0)), F.col(n_name(0, 0))
    )
    return F.coalesce(own["z"], F.col("elev"))


def stencil(grid: DataFrame, dx: Column, dy: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Add the 3 x 3 values z11..z33, Horn gradients p and q, and 5 x 5 sums."""
    df = neighbourhood(grid, keys).withColumns({"dx": dx, "dy": dy})
    df = df.withColumns({f"z{i + 2}{j + 2}": _at(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)})
    cells = [F.col(n_name(i, j)) for i in range(-2, 3) for j in range(-2, 3)]
    inner = [F.col(n_name(i, j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    off = [c["z"] - F.col("elev") for c in cells]
    z = {k: F.col(f"z{k}") for k in ("11", "12", "13", "21", "22", "23", "31", "32", "33")}

    def add(parts: list[Column]) -> Column:
        total = parts[0]
        for x in parts[1:]:
            total = total + x
        return total

    valid = add([c["z"].isNotNull().cast("int") for c in cells])
    out = df.withColumns({
        "p": ((z["13"] + 2.0 * z["23"] + z["33"]) - (z["11"] + 2.0 * z["21"] + z["31"])) / (8.0 * F.col("dx")),
        "q": ((z["11"] + 2.0 * z["12"] + z["13"]) - (z["31"] + 2.0 * z["32"] + z["33"])) / (8.0 * F.col("dy")),
        "valid_5x5": valid,
        "mean_off": add([F.coalesce(o, F.lit(0.0)) for o in off]) / valid,
        "sq_off": add([F.coalesce(o * o, F.lit(0.0)) for o in off]) / valid,
        "at_edge": ~add([c.isNotNull().cast("int") for c in cells]).eqNullSafe(25),
        "gap_3x3": add([(c.isNotNull() & c["z"].isNull()).cast("int") for c in inner]) > 0,
    })
    return out.drop(*[n_name(i, j) for i in range(-2, 3) for j in range(-2, 3)])


def slope_aspect(st: DataFrame) -> DataFrame:
    """Slope, aspect (NULL on flat ground) and window quality from stencil()."""
    seen = F.col("elev").isNotNull()
    p, q = F.col("p"), F.col("q")
    turn = F.degrees(F.atan2(-p, -q))
    turn = F.when(turn < 0, turn + 360.0).otherwise(turn)
    return st.withColumns({
        "slope_deg": F.when(seen, F.degrees(F.atan(F.sqrt(p * p + q * q)))),
        "aspect_deg": F.when(seen & ~((p == 0) & (q == 0)), F.when(turn >= 360.0, 0.0).otherwise(turn)),
        "terrain_quality": F.when(~seen, "NODATA").when(
            F.col("at_edge") | F.col("gap_3x3") | (F.col("valid_5x5") < MIN_VALID_5X5), "PARTIAL_WINDOW"
        ).otherwise("OK"),
    })


def local_relief(st: DataFrame) -> DataFrame:
    """Population deviation of the valid 5 x 5 cells; NULL below 13 of them."""
    var = F.greatest(F.lit(0.0), F.col("sq_off") - F.col("mean_off") * F.col("mean_off"))
    return st.withColumn(
        "relief_std_5x5_m", F.when(F.col("elev").isNotNull() & (F.col("valid_5x5") >= MIN_VALID_5X5), F.sqrt(var))
    )


FLAT = 1e-8


def curvature(st: DataFrame) -> DataFrame:
    """Profile and plan curvature (rad per 100 m) and their class, bands at 0.05."""
    z = {k: F.col(f"z{k}") for k in ("11", "12", "13", "21", "22", "23", "31", "32", "33")}
    dx, dy, p, q = F.col("dx"), F.col("dy"), F.col("p"), F.col("q")
    r = (z["21"] - 2.0 * z["22"] + z["23"]) / (dx * dx)
    t = (z["12"] - 2.0 * z["22"] + z["32"]) / (dy * dy)
    s = (z["13"] + z["31"] - z["11"] - z["33"]) / (4.0 * dx * dy)
    g = p * p + q * q
    seen = F.col("elev").isNotNull()
    profile = -(p * p * r + 2.0 * p * q * s + q * q * t) / (g * F.pow(1.0 + g, F.lit(1.5))) * 100.0
    plan = -(q * q * r - 2.0 * p * q * s + p * p * t) / F.pow(g, F.lit(1.5)) * 100.0
    st = st.withColumns({
        "profile_curvature": F.when(seen, F.when(g > FLAT, profile).otherwise(0.0)),
        "plan_curvature": F.when(seen, F.when(g > FLAT, plan).otherwise(0.0)),
    })
    conv, div = F.col("plan_curvature") < -0.05, F.col("plan_curvature") > 0.05
    conc, conx = F.col("profile_curvature") < -0.05, F.col("profile_curvature") > 0.05
    return st.withColumn(
        "curvature_class",
        F.when(seen, F.when(conv & conc, "Concave-Convergent (Hollow / Extreme Accumulation Risk)")
        .when(conv & conx, "Convex-Convergent (Channeled Drainage)")
        .when(div & conc, "Concave-Divergent (Decelerating Dispersal)")
        .when(div & conx, "Convex-Divergent (Shedding Ridge / Stable)")
        .when(conv, "Convergent (Gully Channel)").when(div, "Divergent (Nose / Ridge)")
        .when(conc, "Concave (Decelerating Slope)").when(conx, "Convex (Accelerating Slope)")
        .otherwise("Planar (Uniform Slope)")),
    )


def ruggedness_position(st: DataFrame) -> DataFrame:
    """Ruggedness (rms of the eight differences), position index and slope position; needs slope_deg."""
    seen = F.col("elev").isNotNull()
    squares = [(F.col(f"z{i}{j}") - F.col("z22")) * (F.col(f"z{i}{j}") - F.col("z22")) for i in (1, 2, 3) for j in (1, 2, 3) if (i, j) != (2, 2)]
    total = squares[0]
    for x in squares[1:]:
        total = total + x
    st = st.withColumns({"tri_m": F.when(seen, F.sqrt(total / 8.0)), "tpi_m": F.when(seen, -F.col("mean_off"))})
    tpi = F.col("tpi_m")
    return st.withColumn(
        "slope_position",
        F.when(tpi < -5.0, "Valley Bottom / Deep Hollow").when(tpi < -1.0, "Foot-Slope / Toe Cut")
        .when(tpi <= 1.0, F.when(F.col("slope_deg") > 10.0, "Mid-Slope").otherwise("Flat Valley Terrace"))
        .when(tpi <= 5.0, "Upper Slope / Shoulder").when(tpi > 5.0, "Ridge / Crest"),
    )


def wetness_multiplier(st: DataFrame) -> DataFrame:
    """Wetness index and terrain risk multiplier, after curvature and ruggedness_position."""
    seen = F.col("elev").isNotNull()
    steep = F.greatest(F.radians(F.lit(0.5)), F.radians("slope_deg"))
    gather = F.greatest(F.lit(0.5), 1.0 - clamp(F.col("plan_curvature"), -2.0, 2.0) * 0.3)
    area = F.greatest(F.col("dx"), F.col("dx") * gather)
    toe = F.col("slope_position").isin("Foot-Slope / Toe Cut", "Valley Bottom / Deep Hollow")
    factor = (
        1.0 + F.when(F.col("slope_deg") >= 25.0, 0.15).otherwise(0.0) + F.when(F.col("plan_curvature") < -0.05, 0.15).otherwise(0.0)
        + F.when(F.col("profile_curvature") < -0.05, 0.10).otherwise(0.0) + F.when(toe, 0.10).otherwise(0.0)
    )
    return st.withColumns({
        "topographic_wetness_index": F.when(seen, F.log(area / F.tan(steep))),
        "terrain_multiplier": F.when(seen, rounded(clamp(factor, 0.80, 1.50), 2)),
    })


def terrain(grid: DataFrame, dx: Column, dy: Column, keys: Sequence[str] = ()) -> DataFrame:
    """All attributes from one stencil."""
    return wetness_multiplier(ruggedness_position(curvature(local_relief(slope_aspect(stencil(grid, dx, dy, keys))))))


def grid_stats(grid: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Range, mean, relief, valid and no-data cells per tile."""
    return grid.groupBy(*keys).agg(
        F.min("elev").alias("min_elev"), F.max("elev").alias("max_elev"), F.avg("elev").alias("mean_elev"),
        (F.max("elev") - F.min("elev")).alias("relief"), F.count("elev").alias("valid_cells"),
        F.count_if(F.col("elev").isNull()).alias("nodata_cells"),
    )


def downsample(grid: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Coarser grid by block means (no bilinear filter)."""
    return grid.groupBy(
        *keys, F.floor(F.col("grid_row") / factor).alias("out_row"), F.floor(F.col("grid_col") / factor).alias("out_col")
    ).agg(F.avg("elev").alias("elev"), F.count("elev").alias("valid_cells"))


def bilinear(points: DataFrame, grid: DataFrame, north: float, west: float, step: float) -> DataFrame:
    """Interpolate the grid at each point from its four surrounding cells.

    Cell (r, c) sits at (north - r * step, west + c * step). NULL when a corner is absent or has no data.
    """
    y, x = (north - F.col("latitude")) / step, (F.col("longitude") - west) / step
    fy, fx = y - F.floor(y), x - F.floor(x)
    corners = [
        F.struct((F.floor(y) + a).alias("r"), (F.floor(x) + b).alias("c"),
                 ((fy if a else 1.0 - fy) * (fx if b else 1.0 - fx)).alias("w"))
        for a in (0, 1) for b in (0, 1)
    ]
    spread = points.select("point_id", F.explode(F.array(*corners)).alias("_k"))
    g = grid.select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), F.col("elev").alias("_z"))
    hit = spread.join(g, (F.col("_k.r") == F.col("_r")) & (F.col("_k.c") == F.col("_c")), "left")
    return hit.groupBy("point_id").agg(
        F.when(F.count("_z") == 4, F.sum(F.col("_k.w") * F.col("_z"))).alias("interpolated")
    )

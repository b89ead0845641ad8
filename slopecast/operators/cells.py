"""Cells of several sizes: a place index that is split only where it is crowded.

Level 0 covers the globe with cells of COARSE_DEG; a cell of level k is split into 4 x 4 cells of level
k + 1. Pairs of point cells and item cells are followed from the coarsest level down, with lower and upper
distance bounds between the boxes, and only those go further down that crowded cells make worth it. No
step lists pairs of places, and a place far from crowds stays with wide cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import degrees_for_km, haversine_km
from slopecast.session import settle

COARSE_DEG = 64.0
#: A cell with more distinct places, or more segments, than this is crowded.
CELL_ITEMS, CELL_SEGMENTS = 8, 64
#: Pairs of cells that a search may start from, and places of a key that are compared without any cells.
FIRST_PAIRS, FEW = 16_384, 128
#: Places of a cell that are compared one by one on the rim of a radius.
RIM_ITEMS = 64
#: The finest level; its cells are 0.00024 degrees wide, about 27 m.
FINEST = 9
KM_PER_DEG = fixed.METRES_PER_DEGREE / 1000.0
#: The last level at which segments are placed in all cells that they pass.
PLAIN = 4
#: Bounds are widened by this share, far more than rounding takes.
SLACK = 1e-6


def level_size(level: int) -> float:
    return COARSE_DEG / 4**level


def cell_of(c: Column, level: int) -> Column:
    return F.floor(c / level_size(level))


def on_globe(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90.0, 90.0) & F.col(lon).between(-180.0, 180.0)


def place_levels(lat: Column, lon: Column, depth: int) -> Column:
    """Array of (level, i, j): the cells of a place at all levels down to depth."""
    return F.array(*[F.struct(F.lit(k).alias("level"), cell_of(lat, k).alias("i"), cell_of(lon, k).alias("j")) for k in range(depth + 1)])


def walked(y1: Column, x1: Column, y2: Column, x2: Column, size: float, margin: float = 0.0, shift: float = 0.0, within: tuple[Column, Column] | None = None) -> Column:
    """Array of (i, j): the cells that a segment passes, row by row, or comes within margin degrees of.

    In each row of cells the segment is cut at the row's edges, so a long diagonal has about as many cells as it
    crosses and not those of its bounding box. Cell lines lie at multiples of size, plus shift. within
    is the parent cell (i, j) of cells four times as wide that the walk stays in.
    """
    margin += 1e-9
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    left, right = F.least(x1, x2), F.greatest(x1, x2)

    def index(c: Column) -> Column:
        return F.floor((c - shift) / size)

    def steps(first: Column, last: Column, parent: Column | None) -> Column:
        if parent is not None:
            first, last = F.greatest(first, parent * 4), F.least(last, parent * 4 + 3)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def x_at(y: Column) -> Column:
        return F.when(y1 == y2, x1).otherwise(x1 + (y - y1) / F.when(y1 == y2, F.lit(1.0)).otherwise(y2 - y1) * (x2 - x1))

    def row(i: Column) -> Column:
        bottom = F.greatest(low, F.least(high, i * size + shift - margin))
        top = F.greatest(low, F.least(high, (i + 1) * size + shift + margin))
        a, b = x_at(bottom), x_at(top)
        flat = y1 == y2
        first = F.greatest(left, F.when(flat, left).otherwise(F.least(a, b))) - margin
        last = F.least(right, F.when(flat, right).otherwise(F.greatest(a, b))) + margin
        return F.transform(steps(index(first), index(last), within[1] if within else None), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(steps(index(low - margin), index(high + margin), within[0] if within else None), row))


def unfolded(df: DataFrame) -> DataFrame:
    """df, whose rows an explode has multiplied, for a join that sorts: the planner takes their size before the explode,
    and would send all of them through the driver as a broadcast."""
    return df.hint("merge")


def placed(items: DataFrame, cells: Column) -> DataFrame:
    """items once for each of its cells (level, i, j), with level, ii and ij."""
    at = items.select("*", F.explode(cells).alias("c"))
    return at.select(*items.columns, F.col("c.level").alias("level"), F.col("c.i").alias("ii"), F.col("c.j").alias("ij"))


def item_cells(at: DataFrame, second: Column, keys: Sequence[str] = (), crowd: int | None = None) -> tuple[DataFrame, int, dict[int, int]]:
    """(*keys, level, ii, ij, items, second) of all cells of placed items, settled; the level at which no cell is
    crowded (or the finest there is); and the cells of each level. second is a sum over the items of a cell."""
    counts = settle(at.groupBy(*keys, "level", "ii", "ij").agg(F.count(F.lit(1)).alias("items"), second.alias("second")), "cells")
    levels = {r["level"]: r for r in counts.groupBy("level").agg(F.max("items").alias("most"), F.count(F.lit(1)).alias("cells")).collect()}  # one row a level
    depth = next((k for k in sorted(levels) if levels[k]["most"] <= (crowd or CELL_ITEMS)), max(levels, default=0))
    return counts, depth, {k: r["cells"] for k, r in levels.items()}


def placed_segments(segments: DataFrame, plain: int = PLAIN) -> DataFrame:
    """Segments (y1, x1, y2, x2) once for each cell that they pass, with level, ii, ij; settled.

    One that reaches beyond 180 degrees is also placed a turn of the globe back. All cells down to the level
    `plain`, and below it those inside crowded cells, level by level, so that a long segment is not cut
    into fine pieces where nothing else is.
    """
    y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))

    def cells(level: int, within: tuple[Column, Column] | None = None) -> Column:
        size = level_size(level)
        first, last = math.floor(-180.0 / size), math.floor(180.0 / size)
        inside = F.filter(walked(y1, x1, y2, x2, size, within=within), lambda c: c["j"].between(first, last))
        return F.transform(inside, lambda c: F.struct(F.lit(level).alias("level"), c["i"].alias("i"), c["j"].alias("j")))

    turn = F.explode(F.array_compact(F.array(F.lit(0.0), F.when(F.greatest(x1, x2) > 180, -360.0), F.when(F.least(x1, x2) < -180, 360.0))))
    rest = [c for c in segments.columns if c not in ("x1", "x2")]
    turned = segments.select(*rest, "x1", "x2", turn.alias("turn")).select(*rest, (x1 + F.col("turn")).alias("x1"), (x2 + F.col("turn")).alias("x2"))
    out = settle(placed(turned, F.concat(*[cells(k) for k in range(plain + 1)])), "segments")
    newest = out.where(F.col("level") == plain)
    for level in range(plain, FINEST):
        crowded = settle(newest.groupBy("ii", "ij").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL_SEGMENTS).select("ii", "ij"), "crowded")
        if crowded.isEmpty():
            break
        inside = newest.drop("level").join(crowded, ["ii", "ij"], "left_semi").withColumnsRenamed({"ii": "_pi", "ij": "_pj"})
        newest = settle(placed(inside, cells(level + 1, (F.col("_pi"), F.col("_pj")))).drop("_pi", "_pj"), "segments")
        out = out.unionByName(newest)
    return out


def box_bounds(planar: bool = False) -> tuple[Column, Column]:
    """Least and greatest distance in km between a place of the box (pi, pj) of `level` and one of (ii, ij) of
    `il`. Great-circle, or with planar=True in the plane around the first place; longitudes are a circle."""
    return _bounds(*_box("pi", "pj", "level"), planar)


def place_bounds(lat: Column, lon: Column, planar: bool = False) -> tuple[Column, Column]:
    """The same between a place and the places of the box (ii, ij) of `il`."""
    return _bounds(lat, lat, lon, lon, planar)


def _box(i: str, j: str, level: str) -> tuple[Column, Column, Column, Column]:
    """South, north, west and east of a cell."""
    size = F.lit(COARSE_DEG) / F.pow(F.lit(4.0), F.col(level))
    south, north = F.greatest(F.col(i) * size, F.lit(-90.0)), F.least((F.col(i) + 1) * size, F.lit(90.0))
    return south, north, F.col(j) * size, (F.col(j) + 1) * size


def _bounds(south: Column, north: Column, west: Column, east: Column, planar: bool) -> tuple[Column, Column]:
    isouth, inorth, iwest, ieast = _box("ii", "ij", "il")
    zero = F.lit(0.0)
    gap_i = F.greatest(isouth - north, south - inorth, zero)
    span_i = F.greatest(north, inorth) - F.least(south, isouth)
    apart = F.greatest(iwest - east, west - ieast, zero)
    across = F.greatest(east, ieast) - F.least(west, iwest)
    gap_j = F.least(apart, F.greatest(360.0 - across, zero))
    span_j = F.least(across, F.lit(180.0), F.greatest(360.0 - apart, zero))

    def far(a: Column, b: Column) -> Column:  # least cosine of a latitude in the box
        return F.cos(F.radians(F.greatest(F.abs(a), F.abs(b))))

    def near(a: Column, b: Column) -> Column:  # greatest one
        return F.when((a <= 0) & (b >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(a), F.abs(b)))))

    if planar:
        low = KM_PER_DEG * F.sqrt(gap_i * gap_i + F.pow(gap_j * far(south, north), F.lit(2.0)))
        high = KM_PER_DEG * F.sqrt(span_i * span_i + F.pow(span_j * near(south, north), F.lit(2.0)))
    else:
        def arc(di: Column, dj: Column, cosines: Column) -> Column:
            a, b = F.sin(F.radians(di) / 2.0), F.sin(F.radians(F.least(dj, F.lit(180.0))) / 2.0)
            return 2.0 * fixed.EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + cosines * b * b)))

        low = arc(gap_i, gap_j, far(south, north) * far(isouth, inorth))
        high = arc(F.least(span_i, F.lit(180.0)), span_j, near(south, north) * near(isouth, inorth))
    return low * (1 - SLACK) - 1e-9, high * (1 + SLACK) + 1e-9


def _up(c: str, by: int = 4) -> Column:
    return F.floor(F.col(c) / by)


def point_cells(sites: DataFrame, depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, level, pi, pj): the cells that hold points, at every level down to depth; sites has _lat and _lon."""
    cells = placed(sites.select(*keys, "_lat", "_lon"), place_levels(F.col("_lat"), F.col("_lon"), depth))
    return settle(cells.select(*keys, "level", F.col("ii").alias("pi"), F.col("ij").alias("pj")).distinct(), "point-cells")


def first_pairs(points: DataFrame, items: DataFrame, depth: int, item_levels: dict[int, int], keys: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """All pairs of point cells and item cells (of the same keys) of one level, and that level: the finest for
    which their number is surely FIRST_PAIRS or less (the cells of level 0 are 24 at most, for each key). item_levels
    has the number of item cells of the levels at which all items are placed."""
    levels = {r["level"]: r["n"] for r in points.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a level
    start = max((k for k in range(depth + 1) if k in item_levels and levels.get(k, 0) * item_levels[k] <= FIRST_PAIRS), default=0)
    pc = points.where(F.col("level") == start).select(*keys, "level", "pi", "pj", F.lit(start).alias("il"))
    ic = items.where(F.col("level") == start).select(*keys, F.col("level").alias("il"), "ii", "ij", "items", "second")
    return pc.join(ic, [*keys, "il"]), start


def finer(pairs: DataFrame, level: int, points: DataFrame, items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The pairs one level down: the parts of the point cell with the parts of the item cell, or with the item cell
    itself where it was not split. Other columns of pairs are kept."""
    cell = points.where(F.col("level") == level + 1).select(*keys, F.col("pi").alias("fi"), F.col("pj").alias("fj"), _up("pi").alias("pi"), _up("pj").alias("pj"))
    own = ("il", "ii", "ij", "items", "second")
    part = items.where(F.col("level") == level + 1).select(
        *keys, F.lit(level).alias("il"), _up("ii").alias("ii"), _up("ij").alias("ij"), F.struct(F.lit(level + 1).alias("il"), "ii", "ij", "items", "second").alias("part"),
    )
    rest = [c for c in pairs.columns if c not in (*keys, "level", "pi", "pj", *own)]
    down = pairs.drop("level").join(cell, [*keys, "pi", "pj"]).join(part, [*keys, "il", "ii", "ij"], "left")
    return down.select(
        *keys, F.lit(level + 1).alias("level"), F.col("fi").alias("pi"), F.col("fj").alias("pj"),
        *[F.coalesce(F.col(f"part.{c}"), F.col(c)).alias(c) for c in own], *rest,
    )


def nearest_pairs(points: DataFrame, items: DataFrame, depth: int, item_levels: dict[int, int], exclude_self: bool, planar: bool = False, crowd: int | None = None) -> DataFrame:
    """(level, pi, pj, il, ii, ij, best): for each point its cell at one level, and the item cells that can hold its nearest,
    which is at most best km from any place of the point cell (NULL: not known).

    At each level the greatest distance to a cell that surely holds an item bounds the nearest one of all
    places of the point cell, and of its parts. A point cell stops where none of its item cells is crowded.
    """
    box = lambda c: F.floor(F.col(c) / F.pow(F.lit(4.0), F.col("level") - F.col("il")))
    own = (box("pi") == F.col("ii")) & (box("pj") == F.col("ij"))
    need = F.when(own, 2).otherwise(1) if exclude_self else F.lit(1)
    pairs, start = first_pairs(points, items, depth, item_levels)
    pairs = pairs.withColumn("best", F.lit(None).cast("double"))
    per_cell = Window.partitionBy("pi", "pj")  # rows bounded by the candidates of one cell
    low, high = box_bounds(planar)
    done = None
    for level in range(start, depth + 1):
        pairs = pairs.withColumns({"low": low, "high": F.when(F.col("second") >= need, high)})
        pairs = pairs.withColumn("best", F.least("best", F.min("high").over(per_cell))).where("best is null or low <= best").drop("low", "high")
        if level == depth:
            open_ = F.lit(False)
        else:
            open_ = F.max(F.col("items") > (crowd or CELL_ITEMS)).over(per_cell)
        pairs = pairs.withColumn("open", open_)
        if start < level < depth:  # the first lists are small, the last one is used once
            pairs = settle(pairs, "pairs")
        stay = pairs.where("not open").select("level", "pi", "pj", "il", "ii", "ij", "best")
        done = stay if done is None else done.union(stay)
        if level < depth:
            pairs = finer(pairs.where("open").drop("open"), level, points, items)
    return done


def count_within(points: DataFrame, items: DataFrame, radii: Sequence[float], key: str) -> DataFrame:
    """(key, _lat, _lon, w0, w1, ...) of points (key, _lat, _lon), distinct: how many items of the same key lie within
    each radius in km; items are (key, _ilat, _ilon, _n), distinct places with their numbers of rows.

    A pair of a point cell and an item cell that lies wholly within a radius is counted from the cell's sum, one
    wholly outside is dropped, and only pairs on a rim go down. Places are compared with places in cells
    of RIM_ITEMS at most (or the finest), on a rim. Keys with FEW places are compared as they are.
    """
    narrow = points.select(key, "_lat", "_lon")
    few = items.groupBy(key).agg(F.count(F.lit(1)).alias("places")).where(F.col("places") <= FEW).select(key)
    few = settle(few, "few")
    crowd = items.join(few, key, "left_anti")
    sums, depth, item_levels = item_cells(placed(crowd, place_levels(F.col("_ilat"), F.col("_ilon"), FINEST)), F.sum("_n"), [key], RIM_ITEMS)
    cells = point_cells(narrow.join(crowd.select(key).distinct(), key, "left_semi"), depth, [key])
    low, high = box_bounds()
    pairs, start = first_pairs(cells, sums, depth, item_levels, [key])
    pairs = pairs.withColumns({f"in{k}": F.lit(False) for k in range(len(radii))})
    whole = rim = None
    for level in range(start, depth + 1):
        pairs = settle(pairs.withColumns({"low": low, "high": high}).where(F.col("low") <= max(radii)), "pairs")
        new = {f"w{k}": F.when(~F.col(f"in{k}") & (F.col("high") <= r), F.col("second")).otherwise(F.lit(0)) for k, r in enumerate(radii)}
        counted = pairs.where(F.col("high") <= max(radii)).select(key, "level", "pi", "pj", *[v.alias(n) for n, v in new.items()])
        whole = counted if whole is None else whole.union(counted)
        on_rim = [(~F.col(f"in{k}")) & (F.col("low") <= r) & (F.col("high") > r) for k, r in enumerate(radii)]
        left = pairs.where(reduce(Column.__or__, on_rim)).withColumns({f"in{k}": F.col(f"in{k}") | (F.col("high") <= r) for k, r in enumerate(radii)}).drop("low", "high")
        small = (F.col("items") <= RIM_ITEMS) if level < depth else F.lit(True)
        stay = left.where(small).select(key, "level", "pi", "pj", "il", "ii", "ij", *[f"in{k}" for k in range(len(radii))])
        rim = stay if rim is None else rim.union(stay)
        if level < depth:
            pairs = finer(left.where(~small), level, cells, sums, [key])
    whole = whole.groupBy(key, "level", "pi", "pj").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(radii))])

    place = placed(narrow, place_levels(F.col("_lat"), F.col("_lon"), depth)).withColumnsRenamed({"ii": "pi", "ij": "pj"})
    wide = placed(crowd, place_levels(F.col("_ilat"), F.col("_ilon"), depth)).withColumnRenamed("level", "il")
    d = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_ilat"), F.col("_ilon"))

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.withColumn("d", d).where(F.col("d") <= max(radii))
        return near.select(key, "_lat", "_lon", *[F.when(~F.col(f"in{k}") & (F.col("d") <= r), F.col("_n")).otherwise(F.lit(0)).alias(f"w{k}") for k, r in enumerate(radii)])

    beside = degrees_for_km(max(radii))
    direct = narrow.join(items.join(few, key), key).where(F.abs(F.col("_lat") - F.col("_ilat")) <= beside).withColumns({f"in{k}": F.lit(False) for k in range(len(radii))})
    parts = unfolded(place).join(whole, [key, "level", "pi", "pj"]).select(key, "_lat", "_lon", *[f"w{k}" for k in range(len(radii))])
    parts = parts.union(compared(unfolded(place).join(rim, [key, "level", "pi", "pj"]).join(unfolded(wide), [key, "il", "ii", "ij"]))).union(compared(direct))
    return parts.groupBy(key, "_lat", "_lon").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(len(radii))])

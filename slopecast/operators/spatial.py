"""Spatial joins as equi-joins on grid cells.

Everything works on distinct coordinates first, so copies of one place cost one row. No join
lists all pairs: cells that cannot hold the answer are pruned on cell lists (see cells).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import degrees_for_km, haversine_km, literal_map
from slopecast.operators.cells import (
    CELL_SEGMENTS, COARSE_DEG, FINEST, PLAIN, count_within, item_cells, nearest_pairs, on_globe, place_levels, place_bounds, placed, placed_segments, point_cells, unfolded,
)
from slopecast.session import settle

def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _distinct_sites(points: DataFrame) -> DataFrame:
    """Distinct coordinates on the globe with their number of rows."""
    return (
        points.filter(on_globe("latitude", "longitude"))
        .groupBy(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )


def _nearest(
    points: DataFrame, items: DataFrame, sure: Column, distance: Column, pick: Sequence[str], name: str,
    exclude_self: bool = False, condition: Column | None = None, planar: bool = False, crowd: int | None = None, whole: int = FINEST,
) -> DataFrame:
    """points with the struct (distance, *pick) of the nearest placed item; sure counts the items of a cell that
    surely have a place inside it, whole is the last level at which all items are placed."""
    counts, depth, levels = item_cells(items, sure, crowd=crowd)
    levels = {k: n for k, n in levels.items() if k <= whole}
    sites = settle(_distinct_sites(points), "sites")
    found = nearest_pairs(point_cells(sites, depth), counts, depth, levels, exclude_self, planar, crowd)
    here = placed(sites.select("_lat", "_lon"), place_levels(F.col("_lat"), F.col("_lon"), depth)).withColumnsRenamed({"ii": "pi", "ij": "pj"})
    there = items.where(F.col("level") <= depth).withColumnRenamed("level", "il")
    # what is far for the place itself, not only for some place of its cell, meets no items
    close = place_bounds(F.col("_lat"), F.col("_lon"), planar)[0] <= F.col("best")
    asked = here.join(found, ["level", "pi", "pj"]).where(F.col("best").isNull() | close).select("_lat", "_lon", "il", "ii", "ij")
    near = asked.join(there, ["il", "ii", "ij"])
    if condition is not None:
        near = near.filter(condition)
    # one row per distinct place; written once, since callers use the joined points more than once
    best = settle(near.groupBy("_lat", "_lon").agg(F.min(F.struct(distance.alias("distance"), *pick)).alias(name)), "nearest")
    return points.join(
        best, (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), "left"
    ).drop("_lat", "_lon")


def nearest_site(points: DataFrame, sites: DataFrame, pick: Sequence[str], name: str = "nearest") -> DataFrame:
    """Add the exact great-circle nearest site as a struct (distance, *pick), however far it is.

    Both sides have latitude and longitude; rows off the globe take no part. Equal distances are
    settled by the order of pick. Cells are small only where the sites are dense.
    """
    items = sites.select(
        *pick, F.col("latitude").alias("_ilat"), F.col("longitude").alias("_ilon")
    ).filter(on_globe("_ilat", "_ilon"))
    # sites at one place: only the first can win
    items = items.groupBy("_ilat", "_ilon").agg(F.min(F.struct(*pick)).alias("_p")).select("_ilat", "_ilon", "_p.*")
    d = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_ilat"), F.col("_ilon"))
    return _nearest(points, placed(items, place_levels(F.col("_ilat"), F.col("_ilon"), FINEST)), F.count(F.lit(1)), d, pick, name)


def nearest_other(points: DataFrame, positive: Column) -> DataFrame:
    """Distance in km to the nearest other positive point.

    A positive ignores itself but not a second positive at its place (distance 0); a negative
    takes the plain nearest positive.
    """
    pos = (
        points.filter(positive & on_globe("latitude", "longitude"))
        .groupBy(F.col("latitude").alias("_ilat"), F.col("longitude").alias("_ilon"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    d = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_ilat"), F.col("_ilon"))
    other = (F.col("_lat") != F.col("_ilat")) | (F.col("_lon") != F.col("_ilon"))
    marked = points.withColumn("_positive", positive)
    items = placed(pos, place_levels(F.col("_ilat"), F.col("_ilon"), FINEST))
    out = _nearest(marked, items, F.count(F.lit(1)), d, ["_ilat"], "_other", exclude_self=True, condition=other)
    here = pos.select(F.col("_ilat").alias("_hlat"), F.col("_ilon").alias("_hlon"), "_copies")
    out = out.join(here, (F.col("latitude") == F.col("_hlat")) & (F.col("longitude") == F.col("_hlon")), "left")
    own = F.when(F.col("_positive"), 1).otherwise(0)
    return out.withColumn(
        "nearest_other_km",
        F.when(F.coalesce("_copies", F.lit(0)) > own, F.lit(0.0)).otherwise(F.col("_other.distance")),
    ).drop("_positive", "_other", "_hlat", "_hlon", "_copies")


def nearest_segment(
    points: DataFrame, segments: DataFrame, pick: Sequence[str], measure: Callable[..., Column], name: str = "nearest",
) -> DataFrame:
    """Add the nearest polyline segment as a struct (distance, *pick); measure gives metres.

    A segment takes the shorter way between its ends, across 180 degrees if need be, and is placed in the cells
    that it passes, not in those of its bounding box; cells are small only where segments are dense.
    """
    y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))
    turned = F.when(x2 - x1 > 180, x2 - 360).when(x1 - x2 > 180, x2 + 360).otherwise(x2)
    ends = [F.col(c).isNotNull() for c in ("y1", "x1", "y2", "x2")]
    items = segments.select(*pick, "y1", "x1", "y2", turned.alias("x2")).filter(reduce(Column.__and__, ends))
    # of equal segments only the first can win
    items = items.groupBy("y1", "x1", "y2", "x2").agg(F.min(F.struct(*pick)).alias("_p")).select("_p.*", "y1", "x1", "y2", "x2")
    size = F.lit(COARSE_DEG) / F.pow(F.lit(4.0), F.col("level"))
    end = lambda y, x: (F.col("ii") == F.floor(y / size)) & (F.col("ij") == F.floor(x / size))
    # the point's turn of the globe that is nearest to the segment's middle
    turns = F.rint((F.col("_lon") - (x1 + x2) / 2) / 360.0) * 360.0
    d = measure(F.col("_lat"), F.col("_lon"), y1, x1 + turns, y2, x2 + turns)
    return _nearest(points, placed_segments(items), F.count_if(end(y1, x1) | end(y2, x2)), d, pick, name, planar=True, crowd=CELL_SEGMENTS, whole=PLAIN)


#: Pairs of places that are compared one by one, for each place, before cells are counted from their sums.
PAIRS_A_PLACE = 4096


def radius_cell(lat: Column, lon: Column, km: float) -> Column:
    """Cell (i, j) of a place for radius joins; longitudes are a circle of whole cells."""
    size = degrees_for_km(km)
    count = max(1, int(360.0 / size))
    return F.struct(_cell(lat, size).alias("i"), F.pmod(F.floor((lon + 180.0) * (count / 360.0)), F.lit(count)).alias("j"))


def radius_reach(lat: Column, lon: Column, km: float) -> Column:
    """Array of all radius_cell cells that can hold a place within km.

    The circle around a place spans asin(sin(km) / cos(latitude)) of longitude, all of it where the
    circle holds a pole.
    """
    size = degrees_for_km(km)
    count = max(1, int(360.0 / size))
    arc = km / fixed.EARTH_RADIUS_KM
    pole = F.abs(lat) + size >= 90.0
    reach = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(arc, math.pi / 2))) / F.cos(F.radians(lat))))) * 1.001)
    first = F.floor((lon - reach + 180.0) * (count / 360.0))
    last = F.least(F.floor((lon + reach + 180.0) * (count / 360.0)), first + (count - 1))
    rows = F.sequence(_cell(lat - size, size), _cell(lat + size, size))
    return F.flatten(F.transform(rows, lambda i: F.transform(
        F.sequence(first, last), lambda j: F.struct(i.alias("i"), F.pmod(j, F.lit(count)).alias("j"))
    )))


def pairs_near(rows: DataFrame, keys: Sequence[str], reach: int = 9) -> float:
    """Bound of the pairs a row that a join of each key with `reach` neighbouring ones makes: a product of two
    keys' rows is at most the mean of their squares. One pass, without the neighbours."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("n").alias("rows")).first()
    return reach * (n["squares"] or 0) / max(1, n["rows"] or 0)


def within_radius(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Per distinct point place: how many sites lie within km, and the nearest of them.

    Pairs are counted, not listed. Where cells of the radius hold few places, those are compared; where the join
    could make more than PAIRS_A_PLACE pairs a place, cells wholly within km are counted from their
    sums (cells.count_within); both ways give the same rows. Returns (latitude, longitude, n_within,
    nearest_km). Holds at every latitude and across 180 degrees.
    """
    there = (
        sites.filter(on_globe("latitude", "longitude")).groupBy(F.col("latitude").alias("_ilat"), F.col("longitude").alias("_ilon"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    own = radius_cell(F.col("_lat"), F.col("_lon"), km)
    here = _distinct_sites(points).drop("_rows").withColumns({"pi": own["i"], "pj": own["j"]})
    spread = there.withColumn("_a", F.explode(radius_reach(F.col("_ilat"), F.col("_ilon"), km))).select("_ilat", "_ilon", "_n", F.col("_a.i").alias("pi"), F.col("_a.j").alias("pj"))
    at = radius_cell(F.col("_ilat"), F.col("_ilon"), km)
    both = here.select("pi", "pj").unionAll(there.select(at["i"].alias("pi"), at["j"].alias("pj")))
    if pairs_near(both, ["pi", "pj"]) > PAIRS_A_PLACE:
        return _within_by_sums(here, there, sites, km)
    d = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_ilat"), F.col("_ilon"))
    return (
        here.join(unfolded(spread), ["pi", "pj"]).withColumn("_d", d).filter(F.col("_d") <= km)
        .groupBy(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"))
        .agg(F.sum("_n").alias("n_within"), F.min("_d").alias("nearest_km"))
    )


def _within_by_sums(here: DataFrame, there: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    key = F.lit("").alias("_key")
    counts = count_within(here.select(key, "_lat", "_lon"), settle(there.select(key, "_ilat", "_ilon", "_n"), "sites"), [km], "_key")
    counts = settle(counts.where("w0 > 0").select(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("w0").alias("n_within")), "counted")
    near = nearest_site(counts, sites.select("latitude", "longitude", F.lit(0).alias("_any")), ["_any"], "_near")
    return near.select("latitude", "longitude", "n_within", F.col("_near.distance").alias("nearest_km"))


def nearest_radar(points: DataFrame) -> DataFrame:
    """Add the nearest of the fixed radar sites, its distance and whether it is in range."""
    options = F.array(*[
        F.struct(
            haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)).alias("km"),
            F.lit(i).alias("i"), F.lit(name).alias("name"), F.lit(reach).alias("reach"),
        )
        for i, (name, lat, lon, reach) in enumerate(fixed.RADARS)
    ])
    return points.withColumn("_r", F.array_min(options)).withColumns({
        "radar_name": F.col("_r.name"), "radar_km": F.col("_r.km"),
        "radar_in_range": F.col("_r.km") <= F.col("_r.reach"),
    }).drop("_r")


def corridor_match(points: DataFrame, corridors: DataFrame, reach: float = 0.10) -> DataFrame:
    """Add the first corridor, in corridor order, of the asked sector or within reach degrees.

    points has sector; corridors has corridor_order, corridor, corridor_sector, latitude, longitude.
    Pairs of points and corridors are not listed: of a sector, of one place and of a cell only the first corridor
    counts. The cells within two steps of a place's cell are wholly in reach; of the further ones only
    corridors that come before the first of those are compared with the places.
    """
    size = reach / 4 * (1 + 1e-9)  # a little more, so that rounding moves no place of the reach beyond four steps
    finite = (F.abs("latitude") < float("inf")) & (F.abs("longitude") < float("inf"))
    first = F.min(F.struct("corridor_order", "corridor"))

    def around(steps: Sequence[tuple[int, int]]) -> Column:
        return F.explode(F.array(*[F.struct((F.col("_i") + a).alias("_i"), (F.col("_j") + b).alias("_j")) for a, b in steps])).alias("_a")

    def places(df: DataFrame, lat: str, lon: str, *aggs: Column) -> DataFrame:
        at = df.filter(finite).groupBy(F.col("latitude").alias(lat), F.col("longitude").alias(lon))
        return (at.agg(*aggs) if aggs else at.agg(F.count(F.lit(1)).alias("_rows"))).withColumns({"_i": _cell(F.col(lat), size), "_j": _cell(F.col(lon), size)})

    block = [(a, b) for a in range(-4, 5) for b in range(-4, 5)]
    sites = settle(places(corridors, "_clat", "_clon", first.alias("_f")), "corridors")
    cells = sites.groupBy("_i", "_j").agg(F.min("_f").alias("_f"))
    sure = cells.select("_f", around([s for s in block if max(map(abs, s)) <= 2])).groupBy("_a").agg(F.min("_f").alias("_sure"))
    sure = settle(sure.select("_a._i", "_a._j", "_sure"), "sure")
    rim = sites.select("_f", "_clat", "_clon", around([s for s in block if max(map(abs, s)) > 2])).select("_f", "_clat", "_clon", "_a._i", "_a._j")
    rim = rim.join(sure, ["_i", "_j"], "left").filter(F.col("_sure").isNull() | (F.col("_f") < F.col("_sure"))).drop("_sure")
    here = places(points, "_lat", "_lon").drop("_rows")
    near = here.join(unfolded(rim), ["_i", "_j"]).filter((F.abs(F.col("_clat") - F.col("_lat")) < reach) & (F.abs(F.col("_clon") - F.col("_lon")) < reach))
    hits = near.select("_lat", "_lon", "_f").union(here.join(sure, ["_i", "_j"]).select("_lat", "_lon", "_sure"))
    hits = hits.groupBy("_lat", "_lon").agg(F.min("_f").alias("_near"))
    named = corridors.groupBy(F.col("corridor_sector").alias("sector")).agg(first.alias("_named"))
    out = points.join(named, "sector", "left").join(hits, (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), "left")
    return out.select(*points.columns, F.least("_named", "_near")["corridor"].alias("corridor"))


def sample_grid(
    points: DataFrame, grid: DataFrame, north: float, west: float, step: float, scale: float = 1.0,
    nodata: float | None = None, tile_rows: int | None = None, value: str = "elev",
) -> DataFrame:
    """Add the grid value under each point as sampled; no cell, or the NODATA code, is NULL.

    grid has grid_row and grid_col counted from the north-west corner. With tile_rows the grid comes
    in square tiles of that many rows, told by (tile_row, tile_col), with grid_row and grid_col
    counted inside the tile.
    """
    row, col = F.floor((north - F.col("latitude")) / step), F.floor((F.col("longitude") - west) / step)
    known = F.lit(True) if nodata is None else F.col(value) != nodata
    keys = {"_row": (F.col("grid_row"), row), "_col": (F.col("grid_col"), col)}
    if tile_rows:
        keys = {
            "_tile_row": (F.col("tile_row"), F.floor(row / tile_rows)), "_tile_col": (F.col("tile_col"), F.floor(col / tile_rows)),
            "_row": (F.col("grid_row"), F.pmod(row, F.lit(tile_rows))), "_col": (F.col("grid_col"), F.pmod(col, F.lit(tile_rows))),
        }
    g = grid.select(*[own.alias(k) for k, (own, _) in keys.items()], F.when(known, F.col(value) / scale).alias("sampled"))
    return points.join(g, [at == F.col(k) for k, (_, at) in keys.items()], "left").drop(*keys)


def code_labels(df: DataFrame) -> DataFrame:
    """Add soil and land-cover names; unknown codes give NULL and a quality flag."""
    soil, cover = literal_map(dict(enumerate(fixed.SOIL_CLASSES))), literal_map(fixed.LAND_COVER)
    out = df.withColumns({
        "soil_class": F.try_element_at(soil, F.col("soil_code").cast("int")),
        "landcover_class": F.try_element_at(cover, F.col("cover_code").cast("int")),
    })
    return out.withColumns({
        "soil_quality": F.when(F.col("soil_class").isNull(), "PARTIAL").otherwise("OK"),
        "lulc_quality": F.when(F.col("landcover_class").isNull(), "NODATA").otherwise("OK"),
    })

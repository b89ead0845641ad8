"""Spatial queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import haversine_km, metres_between, rounded, segment_metres, tile_name
from slopecast.operators import outlines
from slopecast.operators import spatial as op
from slopecast.operators.ranks import exact_quantiles
from slopecast.plans.bindings import Tables, rnd, sql_haversine
from slopecast.plans.registry import query

PS = sql_haversine("p.latitude", "p.longitude", "s.latitude", "s.longitude")
NEAREST_SQL = f"""SELECT p.point_id, s.site_no, s.station_key, s.station, s.state, s.district, {PS} AS km FROM points p, stations s
    QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY {PS}, s.site_no) = 1"""
PICK = ["site_no", "station_key", "station", "state", "district"]


def points_with_station(t: Tables):
    return op.nearest_site(t.points, t.stations, PICK)


@query("nearest_station", f"SELECT point_id, site_no, station, {rnd('km')} AS distance_km FROM ({NEAREST_SQL})")
def nearest_station(t: Tables):
    return points_with_station(t).select(
        "point_id", "nearest.site_no", "nearest.station", rounded(F.col("nearest.distance")).alias("distance_km")
    )


@query(
    "within_radius_join",
    f"""SELECT p.point_id, count(s.site_no) AS n_within, {rnd(f'min({PS})')} AS nearest_km
    FROM points p LEFT JOIN stations s ON {PS} <= 50 GROUP BY p.point_id""",
)
def within_radius_join(t: Tables):
    """Stations within 50 km of each point, counted."""
    near = op.within_radius(t.points, t.stations, fixed.MAX_STATION_KM)
    return t.points.join(near, ["latitude", "longitude"], "left").select(
        "point_id", F.coalesce("n_within", F.lit(0)).alias("n_within"), rounded(F.col("nearest_km")).alias("nearest_km")
    )


INSIDE_SQL = """SELECT point_id, min(state) AS inside_state FROM (SELECT p.point_id, e.state FROM points p JOIN edges e
    ON (e.y1 > p.latitude) <> (e.y2 > p.latitude)
    AND p.longitude < e.x1 + (p.latitude - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1)
    GROUP BY p.point_id, e.state HAVING count(*) % 2 = 1) GROUP BY point_id"""


@query("point_in_polygon", f"SELECT p.point_id, inside_state FROM points p LEFT JOIN ({INSIDE_SQL}) i USING (point_id)")
def point_in_polygon(t: Tables):
    return outlines.state_of_point(t.points, t.vertices).select("point_id", "inside_state")


_T = "greatest(0.0, least(1.0, ((p.longitude - e.x1) * (e.x2 - e.x1) + (p.latitude - e.y1) * (e.y2 - e.y1)) / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2))))"
EDGE_DEG = f"sqrt(pow(e.x1 + {_T} * (e.x2 - e.x1) - p.longitude, 2) + pow(e.y1 + {_T} * (e.y2 - e.y1) - p.latitude, 2))"
BORDER_SQL = f"""SELECT p.point_id, min(e.state) AS border_state FROM points p JOIN edges e ON {EDGE_DEG} < 0.01
    WHERE p.point_id NOT IN (SELECT point_id FROM ({INSIDE_SQL})) GROUP BY p.point_id"""


@query("border_tolerance", f"SELECT point_id, border_state || ' (Border)' AS state FROM ({BORDER_SQL})")
def border_tolerance(t: Tables):
    """Points outside every outline but within 0.01 degrees of one."""
    placed = outlines.border_state(outlines.state_of_point(t.points, t.vertices), t.vertices)
    return placed.filter("border_state is not null").select(
        "point_id", F.concat("border_state", F.lit(" (Border)")).alias("state")
    )


@query(
    "domain_status",
    f"""SELECT p.point_id, CASE WHEN p.latitude > 90 THEN 'INVALID_COORDINATES' WHEN i.inside_state IS NOT NULL THEN 'INSIDE'
    WHEN b.border_state IS NOT NULL THEN 'BORDER' ELSE 'OUTSIDE_SUPPORTED_DOMAIN' END AS status,
    coalesce(i.inside_state, b.border_state || ' (Border)') AS state,
    CASE WHEN p.latitude > 90 THEN 'Invalid latitude' WHEN i.inside_state IS NULL AND b.border_state IS NULL THEN 'Outside the supported domain' END AS message
    FROM (SELECT point_id, latitude FROM points UNION ALL SELECT -1 - point_id, latitude + 90 FROM points) p
    LEFT JOIN ({INSIDE_SQL}) i USING (point_id) LEFT JOIN ({BORDER_SQL}) b USING (point_id)""",
)
def domain_status(t: Tables):
    """Status of every point, and of the same points moved to an impossible latitude."""
    p = t.points.select("point_id", "latitude", "longitude")
    moved = p.select((F.lit(-1) - F.col("point_id")).alias("point_id"), (F.col("latitude") + 90).alias("latitude"), "longitude")
    return outlines.domain_status(p.unionByName(moved), t.vertices).select("point_id", "status", "state", "message")


POSITIVES = "SELECT event_no, site_no, latitude, longitude, event_no % 2 = 0 AS positive FROM inventory"


@query(
    "knn_self_excluded",
    f"""WITH ev AS ({POSITIVES}), sp AS (SELECT site_no, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
      count(*) FILTER (positive) AS n_pos FROM ev GROUP BY site_no),
    near AS (SELECT p.site_no, min({PS}) AS km FROM sp p JOIN sp s ON s.n_pos > 0 AND s.site_no <> p.site_no GROUP BY p.site_no)
    SELECT e.event_no, {rnd('CASE WHEN sp.n_pos > CASE WHEN e.positive THEN 1 ELSE 0 END THEN 0.0 ELSE near.km END')} AS nearest_other_km
    FROM ev e JOIN sp USING (site_no) JOIN near USING (site_no)""",
)
def knn_self_excluded(t: Tables):
    """Distance to the nearest other positive event; positives ignore themselves."""
    ev = t.inventory.select("event_no", "latitude", "longitude")
    out = op.nearest_other(ev, F.col("event_no") % 2 == 0)
    return out.select("event_no", rounded(F.col("nearest_other_km")).alias("nearest_other_km"))


_KX = "(111320.0 * cos(radians(p.latitude)))"
_AX, _AY = f"((s.x1 - p.longitude) * {_KX})", "((s.y1 - p.latitude) * 111320.0)"
_DX, _DY = f"((s.x2 - s.x1) * {_KX})", "((s.y2 - s.y1) * 111320.0)"
_L2 = f"({_DX} * {_DX} + {_DY} * {_DY})"
_TT = f"(CASE WHEN {_L2} > 0 THEN greatest(0.0, least(1.0, -({_AX} * {_DX} + {_AY} * {_DY}) / {_L2})) ELSE 0.0 END)"
SEG_M = f"sqrt(pow({_AX} + {_TT} * {_DX}, 2) + pow({_AY} + {_TT} * {_DY}, 2))"


@query(
    "nearest_segment",
    f"""SELECT p.point_id, floor(min({SEG_M}) * 1e2 + 0.5) / 1e2 AS distance_to_road_m FROM points p, segments s
    WHERE s.road_class NOT IN ('footway', 'steps') GROUP BY p.point_id""",
)
def nearest_segment(t: Tables):
    """Distance in metres to the nearest road of a listed class."""
    roads = t.segments.filter(F.col("road_class").isin(*fixed.ROAD_CLASSES))
    return op.nearest_segment(t.points, roads, ["feature_id"], segment_metres).select(
        "point_id", rounded(F.col("nearest.distance"), 2).alias("distance_to_road_m")
    )


@query(
    "nearest_radar",
    f"""SELECT p.point_id, s.name AS radar_name, {rnd(PS)} AS radar_km, {PS} <= s.reach AS radar_in_range FROM points p,
    (VALUES {', '.join(f"({i}, '{n}', {a}, {o}, {r})" for i, (n, a, o, r) in enumerate(fixed.RADARS))}) s(i, name, latitude, longitude, reach)
    QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY {PS}, s.i) = 1""",
)
def nearest_radar(t: Tables):
    return op.nearest_radar(t.points).select(
        "point_id", "radar_name", rounded(F.col("radar_km")).alias("radar_km"), "radar_in_range"
    )


@query(
    "raster_point_sample",
    f"""SELECT point_id, CASE WHEN g.elev <> 0 THEN {rnd('g.elev / 10.0')} END AS sampled FROM points LEFT JOIN grid g
    ON g.grid_row = CAST(floor((30.0 - latitude) / 0.1) AS BIGINT) AND g.grid_col = CAST(floor((longitude - 88.0) / 0.1) AS BIGINT)""",
)
def raster_point_sample(t: Tables):
    """The grid, cut into tiles of eight rows and columns with a NODATA code, under each point."""
    tiles = t.grid.select(
        F.floor(F.col("grid_row") / 8).alias("tile_row"), F.floor(F.col("grid_col") / 8).alias("tile_col"),
        (F.col("grid_row") % 8).alias("grid_row"), (F.col("grid_col") % 8).alias("grid_col"), "elev",
    )
    return op.sample_grid(t.points, tiles, fixed.LAT_MAX, fixed.LON_MIN, 0.1, 10.0, nodata=0.0, tile_rows=8).select(
        "point_id", rounded(F.col("sampled")).alias("sampled")
    )


TILE_SQL = "'N' || lpad(CAST(CAST(floor(latitude) AS BIGINT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor(longitude) AS BIGINT) AS VARCHAR), 3, '0')"


@query(
    "tile_keys",
    f"""SELECT point_id, {TILE_SQL} AS tile_1deg, 'N' || lpad(CAST(CAST(floor(latitude / 3) AS BIGINT) * 3 AS VARCHAR), 2, '0')
    || 'E' || lpad(CAST(CAST(floor(longitude / 3) AS BIGINT) * 3 AS VARCHAR), 3, '0') AS tile_3deg FROM points""",
)
def tile_keys(t: Tables):
    return t.points.select(
        "point_id", tile_name(F.col("latitude"), F.col("longitude")).alias("tile_1deg"),
        tile_name(F.col("latitude"), F.col("longitude"), 3).alias("tile_3deg"),
    )


@query(
    "tile_coverage",
    f"""SELECT p.tile, count(*) AS n_points, p.tile IN (SELECT {TILE_SQL} FROM stations WHERE state <> 'ASIA') AS covered
    FROM (SELECT {TILE_SQL} AS tile FROM points) p GROUP BY p.tile""",
)
def tile_coverage(t: Tables):
    """Required tiles, the points on each, and whether the tile is available."""
    name = tile_name(F.col("latitude"), F.col("longitude")).alias("tile")
    have = t.stations.filter("state <> 'ASIA'").select(name).distinct().withColumn("_have", F.lit(True))
    need = t.points.groupBy(name).agg(F.count(F.lit(1)).alias("n_points"))
    return need.join(have, "tile", "left").select("tile", "n_points", F.coalesce("_have", F.lit(False)).alias("covered"))


@query(
    "tile_coverage_by_state",
    f"""SELECT nation_no, count(*) AS total, count(*) FILTER (c) AS covered, count(*) FILTER (NOT c) AS outside FROM
    (SELECT nation_no, {TILE_SQL} IN (SELECT {TILE_SQL} FROM stations WHERE state <> 'ASIA') AS c FROM points) GROUP BY nation_no""",
)
def tile_coverage_by_state(t: Tables):
    name = tile_name(F.col("latitude"), F.col("longitude")).alias("tile")
    have = t.stations.filter("state <> 'ASIA'").select(name).distinct().withColumn("_have", F.lit(True))
    hit = t.points.select("nation_no", name).join(have, "tile", "left")
    return hit.groupBy("nation_no").agg(
        F.count(F.lit(1)).alias("total"), F.count("_have").alias("covered"),
        F.count_if(F.col("_have").isNull()).alias("outside"),
    )


SECTOR = "CASE WHEN point_id % 7 = 0 THEN concat('sector', cast(point_id % 130 as string)) ELSE NULL END AS sector"


@query(
    "corridor_match",
    f"""SELECT p.point_id, s.station AS corridor FROM (SELECT point_id, latitude, longitude, {SECTOR} FROM points) p
    LEFT JOIN stations s ON p.sector = 'sector' || s.site_no OR (abs(s.latitude - p.latitude) < 0.10 AND abs(s.longitude - p.longitude) < 0.10)
    QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY s.site_no) = 1""",
)
def corridor_match(t: Tables):
    p = t.points.selectExpr("point_id", "latitude", "longitude", SECTOR)
    c = t.stations.select(
        F.col("site_no").alias("corridor_order"), F.col("station").alias("corridor"),
        F.concat(F.lit("sector"), F.col("site_no").cast("string")).alias("corridor_sector"), "latitude", "longitude",
    )
    return op.corridor_match(p, c).select("point_id", "corridor")


@query(
    "haversine_km",
    f"""SELECT p.point_id, {rnd(sql_haversine('p.latitude', 'p.longitude', 'v.lat', 'v.lon'))} AS km FROM points p
    JOIN nation n ON n.n_nationkey = p.nation_no JOIN vertices v ON v.state = n.n_name AND v.seq = 0""",
)
def haversine(t: Tables):
    """Great-circle distance from each point to the first corner of its nation's outline."""
    corner = t.vertices.filter("seq = 0").join(t.raw("nation"), F.col("state") == F.col("n_name"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return t.points.join(corner, F.col("nation_no") == F.col("n_nationkey")).select("point_id", rounded(km).alias("km"))


@query(
    "metric_plane",
    """SELECT p.point_id, floor(sqrt(pow((v.lat - p.latitude) * 111320.0, 2) + pow((v.lon - p.longitude) * 111320.0 * cos(radians(p.latitude)), 2)) * 1e2 + 0.5) / 1e2 AS metres
    FROM points p JOIN nation n ON n.n_nationkey = p.nation_no JOIN vertices v ON v.state = n.n_name AND v.seq = 0""",
)
def metric_plane(t: Tables):
    corner = t.vertices.filter("seq = 0").join(t.raw("nation"), F.col("state") == F.col("n_name"))
    m = metres_between(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return t.points.join(corner, F.col("nation_no") == F.col("n_nationkey")).select("point_id", rounded(m, 2).alias("metres"))


SOIL_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(fixed.SOIL_CLASSES))
COVER_VALUES = ", ".join(f"({i}, '{n}')" for i, n in fixed.LAND_COVER.items())


@query(
    "code_labels",
    f"""SELECT point_id, a.n AS soil_class, b.n AS landcover_class, CASE WHEN a.n IS NULL THEN 'PARTIAL' ELSE 'OK' END AS soil_quality,
    CASE WHEN b.n IS NULL THEN 'NODATA' ELSE 'OK' END AS lulc_quality FROM points LEFT JOIN (VALUES {SOIL_VALUES}) a(c, n) ON a.c = soil_code
    LEFT JOIN (VALUES {COVER_VALUES}) b(c, n) ON b.c = cover_code""",
)
def code_labels(t: Tables):
    return op.code_labels(t.points).select("point_id", "soil_class", "landcover_class", "soil_quality", "lulc_quality")


QUANTS = {"p25": 0.25, "median": 0.5, "p75": 0.75}


@query(
    "distance_distribution",
    f"""WITH n AS ({NEAREST_SQL}), g AS (SELECT 'ALL' AS grp, km FROM n UNION ALL SELECT 'nation_' || nation_no, km FROM n JOIN points USING (point_id))
    SELECT grp, count(*) AS n, {rnd('min(km)')} AS min_km, {rnd('quantile_cont(km, 0.25)')} AS p25, {rnd('quantile_cont(km, 0.5)')} AS median,
    {rnd('quantile_cont(km, 0.75)')} AS p75, {rnd('avg(km)')} AS mean_km, {rnd('max(km)')} AS max_km, {rnd('stddev_pop(km)')} AS std_km,
    count(*) FILTER (km <= 10) AS le_10, count(*) FILTER (km <= 25) AS le_25, count(*) FILTER (km <= 50) AS le_50,
    count(*) FILTER (km > 50) AS gt_50, count(*) FILTER (km > 100) AS gt_100 FROM g GROUP BY grp""",
)
def distance_distribution(t: Tables):
    """Nearest-station distances, overall and per nation."""
    near = points_with_station(t).select("nation_no", F.col("nearest.distance").alias("km"))
    both = near.select(
        F.explode(F.array(F.lit("ALL"), F.concat(F.lit("nation_"), F.col("nation_no").cast("string")))).alias("grp"), "km"
    )
    stats = both.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("km")).alias("min_km"), rounded(F.avg("km")).alias("mean_km"),
        rounded(F.max("km")).alias("max_km"), rounded(F.stddev_pop("km")).alias("std_km"),
        *[F.count_if(F.col("km") <= x).alias(f"le_{x}") for x in (10, 25, 50)],
        *[F.count_if(F.col("km") > x).alias(f"gt_{x}") for x in (50, 100)],
    )
    q = exact_quantiles(both, ["grp"], "km", QUANTS)
    return stats.join(q.select("grp", *[rounded(F.col(c)).alias(c) for c in QUANTS]), "grp")


@query(
    "boundary_validity",
    f"""SELECT n_name AS state, count(*) AS negatives, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
    {rnd('count(*) FILTER (ok) / count(*) * 100.0')} AS valid_pct FROM (SELECT n.n_name, coalesce(i.inside_state = n.n_name, false) AS ok
    FROM points p JOIN nation n ON n.n_nationkey = p.nation_no LEFT JOIN ({INSIDE_SQL}) i USING (point_id)) GROUP BY n_name""",
)
def boundary_validity(t: Tables):
    """Per claimed state: how many points really lie inside its outline."""
    claimed = outlines.state_of_point(t.points, t.vertices).join(t.raw("nation"), F.col("nation_no") == F.col("n_nationkey"))
    ok = F.coalesce(F.col("inside_state") == F.col("n_name"), F.lit(False))
    return claimed.groupBy(F.col("n_name").alias("state")).agg(
        F.count(F.lit(1)).alias("negatives"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"),
        rounded(F.avg(ok.cast("double")) * 100.0).alias("valid_pct"),
    )

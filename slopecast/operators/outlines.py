"""Outlines of states: which one holds a place, and which one's border is near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.operators.cells import FINEST, level_size, on_globe, walked
from slopecast.session import settle

#: Cell lines lie this far off whole numbers, so that they do not run along borders drawn at round degrees.
SHIFT = 3.14159e-5
#: Level of the widest outline cells (0.25 degrees), and the edges of all outlines that crowd a cell.
WIDEST, CELL_EDGES = 4, 64


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Vertex rows (state, seq, lon, lat) to closed edges."""
    ring = Window.partitionBy("state").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        "state", F.col("lon").alias("x1"), F.col("lat").alias("y1"),
        F.coalesce(F.lead("lon").over(ring), F.first("lon").over(whole)).alias("x2"),
        F.coalesce(F.lead("lat").over(ring), F.first("lat").over(whole)).alias("y2"),
    )


def _line(index: Column, size: float) -> Column:
    return index * size + SHIFT


def _index(c: Column, size: float) -> Column:
    return F.floor((c - SHIFT) / size)


def _crossings(edges: Column, x: Column, y: Column, east: Column, south: Column) -> Column:
    """Edges crossed on the way from (x, y) east to the cell's east line and along it to the cell's south-east corner."""

    def crossed(e: Column) -> Column:
        flat = (e["y1"] > y) != (e["y2"] > y)
        at_x = e["x1"] + (y - e["y1"]) / (e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
        steep = (e["x1"] > east) != (e["x2"] > east)
        at_y = e["y1"] + (east - e["x1"]) / (e["x2"] - e["x1"]) * (e["y2"] - e["y1"])
        return F.when(flat, ((x < at_x) & ~(east < at_x)).cast("int")).otherwise(0) + F.when(steep, ((south < at_y) & ~(y < at_y)).cast("int")).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(e))


def _corners_inside(edges: DataFrame, size: float) -> DataFrame:
    """(state, i, j) of the cells whose south-east corner lies inside an outline.

    Each edge crosses the cell lines of its height once; between two crossings of a line the parity does not change. A
    window group is one outline's columns on one line.
    """
    y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))
    first, last = _index(F.least(y1, y2), size), _index(F.greatest(y1, y2), size) + 1
    at = edges.select("*", F.explode(F.sequence(first, last)).alias("i")).withColumn("line", _line(F.col("i"), size))
    at = at.where((F.col("y1") > F.col("line")) != (F.col("y2") > F.col("line")))
    cross = F.col("x1") + (F.col("line") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    columns = at.groupBy("state", "i", _index(cross, size).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("state", "i").orderBy(F.col("col").desc())
    east = columns.select("state", "i", "col", F.sum("n").over(line).alias("crossed"), F.lead("col").over(line).alias("west"))
    return east.where("crossed % 2 = 1 and west is not null").select("state", "i", F.explode(F.expr("sequence(west, col - 1)")).alias("j"))


def outline_cells(vertices: DataFrame) -> tuple[DataFrame, int]:
    """(level, i, j, outlines) and the finest level in use: every cell that an outline touches or covers, once.

    outlines has, for each state of the cell, whether its south-east corner is inside, and the state's edges in the cell.
    A cell with more than CELL_EDGES edges of all outlines together is split into 4 x 4, level by level, so a place meets
    a bounded number of edges however many or finely drawn the outlines are; a cell without edges needs none.
    """
    edge = F.struct("y1", "x1", "y2", "x2")
    edges = polygon_edges(vertices).where("y1 is not null and x1 is not null and y2 is not null and x2 is not null")
    none = F.array().cast("array<struct<y1:double,x1:double,y2:double,x2:double>>")

    def pieces(rows: DataFrame, level: int, within=None) -> DataFrame:
        y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))
        cells = walked(y1, x1, y2, x2, level_size(level), shift=SHIFT, within=within)
        return rows.select("state", "y1", "x1", "y2", "x2", F.explode(cells).alias("c")).groupBy("state", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.collect_list(edge).alias("edges"))

    corners = _corners_inside(edges, level_size(WIDEST)).withColumn("inside", F.lit(1))
    cells = pieces(edges, WIDEST).join(corners, ["state", "i", "j"], "full").select("state", "i", "j", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("edges", none).alias("edges"))
    done, level = None, WIDEST
    while True:
        cells = settle(cells, "outline-cells")
        crowded = cells.groupBy("i", "j").agg(F.sum(F.size("edges")).alias("n")).where(F.col("n") > CELL_EDGES).select("i", "j")
        if level == FINEST or crowded.isEmpty():
            stay = cells.withColumn("level", F.lit(level))
            done = stay if done is None else done.unionByName(stay)
            break
        crowded = settle(crowded, "crowded")
        stay = cells.join(crowded, ["i", "j"], "left_anti").withColumn("level", F.lit(level))
        done = stay if done is None else done.unionByName(stay)
        parents = cells.join(crowded, ["i", "j"], "left_semi")
        wide, narrow = level_size(level), level_size(level + 1)
        parts = F.array(*[F.struct((F.col("i") * 4 + a).alias("i"), (F.col("j") * 4 + b).alias("j")) for a in range(4) for b in range(4)])
        each = parents.select("*", F.explode(parts).alias("c"))
        x, y = _line(F.col("c.j") + 1, narrow), _line(F.col("c.i"), narrow)
        crossed = _crossings(F.col("edges"), x, y, _line(F.col("j") + 1, wide), _line(F.col("i"), wide))
        # named first: beside an alias i, a lambda function would read i as that alias
        inside = each.withColumn("now", (F.col("inside") + crossed) % 2).select("state", "c.i", "c.j", F.col("now").alias("inside"))
        apart = parents.select("state", F.col("i").alias("_i"), F.col("j").alias("_j"), F.explode("edges").alias("e")).select("state", "_i", "_j", "e.*")
        y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))
        fine = walked(y1, x1, y2, x2, narrow, shift=SHIFT, within=(F.col("_i"), F.col("_j")))
        fine = apart.select("state", "y1", "x1", "y2", "x2", F.explode(fine).alias("c")).groupBy("state", F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.collect_list(edge).alias("edges"))
        cells = inside.join(fine, ["state", "i", "j"], "left").where("inside = 1 or edges is not null").select("state", "i", "j", "inside", F.coalesce("edges", none).alias("edges"))
        level += 1
    one = done.groupBy("level", "i", "j").agg(F.collect_list(F.struct("state", "inside", "edges")).alias("outlines"))
    return one, level


def state_of_point(points: DataFrame, outlines: DataFrame | tuple[DataFrame, int]) -> DataFrame:
    """Add the state whose outline contains the point (NULL outside; the first by name of several).

    outlines are vertices (state, seq, lon, lat), or what outline_cells makes of them. A place is looked up in the one cell that holds it. From there it takes the way to the cell's
    south-east corner, whose side is known, and counts the edges that it crosses, all of which lie in the cell.
    """
    cells, deepest = outlines if isinstance(outlines, tuple) else outline_cells(outlines)
    lat, lon = F.col("_lat"), F.col("_lon")
    at = F.array(*[F.struct(F.lit(k).alias("level"), _index(lat, level_size(k)).alias("i"), _index(lon, level_size(k)).alias("j")) for k in range(WIDEST, deepest + 1)])
    sites = points.filter(on_globe("latitude", "longitude")).select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).distinct()
    met = sites.select("_lat", "_lon", F.explode(at).alias("c")).select("_lat", "_lon", "c.*").join(cells, ["level", "i", "j"])
    size = F.lit(level_size(0)) / F.pow(F.lit(4.0), F.col("level"))
    east, south = (F.col("j") + 1) * size + SHIFT, F.col("i") * size + SHIFT
    holding = F.filter("outlines", lambda o: (o["inside"] + _crossings(o["edges"], lon, lat, east, south)) % 2 == 1)
    inside = met.select("_lat", "_lon", F.array_min(F.transform(holding, lambda o: o["state"])).alias("inside_state")).where("inside_state is not null")
    return points.join(
        inside, (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), "left"
    ).drop("_lat", "_lon")


def degrees_to_segment(lat: Column, lon: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Plain distance in degrees from a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(
        length2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - x1) * dx + (lat - y1) * dy) / length2))
    ).otherwise(F.lit(0.0))
    ex, ey = x1 + t * dx - lon, y1 + t * dy - lat
    return F.sqrt(ex * ex + ey * ey)


def border_state(points: DataFrame, vertices: DataFrame, tolerance: float = 0.01, size: float = 0.0625) -> DataFrame:
    """For points outside every outline: the state whose border is closer than tolerance degrees.

    points needs inside_state; adds border_state and border_deg. Edges are met in the cells that they
    come within tolerance of.
    """
    out = points.filter("inside_state is null").filter(on_globe("latitude", "longitude"))
    y1, x1, y2, x2 = (F.col(c) for c in ("y1", "x1", "y2", "x2"))
    e = polygon_edges(vertices).select("*", F.explode(walked(y1, x1, y2, x2, size, margin=tolerance)).alias("c"))
    e = e.select("state", "y1", "x1", "y2", "x2", "c.i", "c.j")
    lat, lon = F.col("_lat"), F.col("_lon")
    sites = out.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).distinct()
    near = (
        sites.withColumns({"i": F.floor(lat / size), "j": F.floor(lon / size)}).join(e, ["i", "j"])
        .withColumn("_d", degrees_to_segment(lat, lon, y1, x1, y2, x2))
        .filter(F.col("_d") < tolerance)
        .groupBy("_lat", "_lon")
        .agg(F.min(F.struct("state", "_d")).alias("_s"))
    )
    return points.join(
        near, (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")), "left"
    ).withColumns({"border_state": F.col("_s.state"), "border_deg": F.col("_s._d")}).drop("_lat", "_lon", "_s")


def domain_status(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Status, state and message per location: bad range, inside, border or outside."""
    placed = border_state(state_of_point(points, vertices), vertices)
    lat, lon = F.col("latitude"), F.col("longitude")
    bad_lat, bad_lon = ~lat.between(-90, 90), ~lon.between(-180, 180)
    bad = F.coalesce(bad_lat | bad_lon, F.lit(True))
    state = F.when(~bad, F.coalesce("inside_state", F.concat("border_state", F.lit(" (Border)"))))
    return placed.withColumn("state", state).withColumns({
        "status": F.when(bad, "INVALID_COORDINATES").when(F.col("inside_state").isNotNull(), "INSIDE")
        .when(F.col("border_state").isNotNull(), "BORDER").otherwise("OUTSIDE_SUPPORTED_DOMAIN"),
        "message": F.when(bad_lat, "Invalid latitude").when(bad_lon, "Invalid longitude").when(bad, "Missing coordinates")
        .when(F.col("state").isNull(), "Outside the supported domain"),
    })

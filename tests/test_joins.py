"""Spatial, as-of and ranking jobs against brute force, with crowded and copied places."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from slopecast.functions.columns import segment_metres
from slopecast.operators import cells, events, labels, metrics, outlines, ranks, spatial
from slopecast.operators.asof import asof
from slopecast.session import settle


def km(a, b):
    dlat, dlon = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlon / 2) ** 2
    return 12742.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def places(n, seed, crowd=0.33):
    """A third of the places crowd one spot; some sit on cell corners and the northern edge."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i < n * crowd:
            out.append((25.0 + rng.random() * 0.01, 92.0 + rng.random() * 0.01))
        elif i % 7 == 0:
            out.append((float(rng.randint(22, 30)), float(rng.randint(88, 98))))
        else:
            out.append((21.5 + rng.random() * 8.5, 88.0 + rng.random() * 10.0))
    return out


def frame(spark, pts, key):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], f"{key} int, latitude double, longitude double")


@pytest.mark.parametrize("crowd", [1, 4, 32])
def test_nearest_site_is_exact(spark, monkeypatch, crowd):
    monkeypatch.setattr(cells, "CELL_ITEMS", crowd)
    pts, sites = places(150, 1), places(40, 2) + [(25.0, 92.0), (25.0, 92.0)]
    out = spatial.nearest_site(frame(spark, pts, "point_id"), frame(spark, sites, "site_no"), ["site_no"])
    for r in out.collect():
        d, i = min((km(pts[r.point_id], s), j) for j, s in enumerate(sites))
        assert abs(r.nearest.distance - d) < 1e-9 and r.nearest.site_no == i


def test_far_sites_and_null_places(spark):
    pts = [(21.5, 88.0), (30.0, 98.0), (-40.0, 60.0)]
    sites = [(29.99, 97.99), (10.0, 70.0)]
    p = frame(spark, pts, "point_id").unionByName(spark.createDataFrame([(9, None, 90.0)], "point_id int, latitude double, longitude double"))
    out = {r.point_id: r.nearest for r in spatial.nearest_site(p, frame(spark, sites, "site_no"), ["site_no"]).collect()}
    assert out[9] is None
    for i, a in enumerate(pts):
        assert abs(out[i].distance - min(km(a, s) for s in sites)) < 1e-9


def test_nearest_other_counts_copies(spark):
    pts = places(120, 3) + [(27.0, 95.0), (27.0, 95.0), (22.0, 89.0)]
    pos = [i % 2 == 0 for i in range(len(pts))]
    pos[-3] = pos[-2] = pos[-1] = True
    df = frame(spark, pts, "id").withColumn("positive", F.element_at(F.array(*[F.lit(x) for x in pos]), F.col("id") + 1))
    out = spatial.nearest_other(df, F.col("positive"))
    for r in out.collect():
        d = min(km(pts[r.id], q) for j, q in enumerate(pts) if pos[j] and j != r.id)
        assert abs(r.nearest_other_km - d) < 1e-9


@pytest.mark.parametrize("most", [spatial.PAIRS_A_PLACE, 0])
def test_within_radius(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "PAIRS_A_PLACE", most)
    pts, sites = places(100, 4), places(60, 5)
    got = {(r.latitude, r.longitude): r for r in spatial.within_radius(frame(spark, pts, "id"), frame(spark, sites, "s"), 50.0).collect()}
    for p in pts:
        near = [km(p, s) for s in sites if km(p, s) <= 50.0]
        assert (p in got) == bool(near)
        if near:
            assert got[p].n_within == len(near) and abs(got[p].nearest_km - min(near)) < 1e-9


def metres(p, s):
    kx, ky = 111320.0 * math.cos(math.radians(p[0])), 111320.0
    ax, ay, bx, by = (s[1] - p[1]) * kx, (s[0] - p[0]) * ky, (s[3] - p[1]) * kx, (s[2] - p[0]) * ky
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = 0.0 if l2 == 0 else max(0.0, min(1.0, -(ax * dx + ay * dy) / l2))
    return math.hypot(ax + t * dx, ay + t * dy)


def test_nearest_segment_with_long_segments(spark):
    rng = random.Random(6)
    segs = [(a, b, a + rng.uniform(-2, 2), b + rng.uniform(-2, 2)) for a, b in places(30, 7)] + [(26.0, 90.0, 26.0, 90.0)]
    pts = places(80, 8)
    sdf = spark.createDataFrame([(i, *s) for i, s in enumerate(segs)], "fid int, y1 double, x1 double, y2 double, x2 double")
    out = spatial.nearest_segment(frame(spark, pts, "id"), sdf, ["fid"], segment_metres)
    for r in out.collect():
        assert abs(r.nearest.distance - min(metres(pts[r.id], s) for s in segs)) < 1e-6


def test_outline_and_border(spark):
    v = [("A", 0, 90.0, 25.0), ("A", 1, 92.0, 25.0), ("A", 2, 91.0, 26.0), ("A", 3, 92.0, 27.0), ("A", 4, 90.0, 27.0)]
    vdf = spark.createDataFrame(v, "state string, seq int, lon double, lat double")
    pts = [(26.0, 90.5), (26.0, 91.5), (25.5, 89.995), (25.5, 89.98), (95.0, 91.0)]
    got = {r.id: (r.status, r.state) for r in outlines.domain_status(frame(spark, pts, "id"), vdf).collect()}
    assert got == {0: ("INSIDE", "A"), 1: ("OUTSIDE_SUPPORTED_DOMAIN", None), 2: ("BORDER", "A (Border)"),
                   3: ("OUTSIDE_SUPPORTED_DOMAIN", None), 4: ("INVALID_COORDINATES", None)}


@pytest.mark.parametrize("direction", ["nearest", "backward"])
def test_asof(spark, direction):
    rng = random.Random(9)
    base = datetime(2024, 1, 1)
    # one key holds most rows; some readings share an instant; gaps span several buckets
    reads = [("hot" if rng.random() < 0.7 else rng.choice("ab"), base + timedelta(minutes=rng.randint(0, 600) * 15), i) for i in range(400)]
    asks = [(rng.choice(["hot", "a", "b", "none"]), base + timedelta(minutes=rng.randint(-500, 10000))) for _ in range(200)]
    r = spark.createDataFrame(reads, "k string, ts timestamp, rid int")
    q = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "qid int, k string, at timestamp")
    out = {x.qid: x.obs for x in asof(q, r, "k", "at", "ts", ["rid"], direction=direction, bucket_hours=6).collect()}
    for i, (k, at) in enumerate(asks):
        options = [(abs(at - t), t, rid) for kk, t, rid in reads if kk == k and (direction == "nearest" or t <= at)]
        want = min(options)[2] if options else None
        assert (out[i].rid if out[i] else None) == want


def test_running_totals_and_numbers(spark):
    rng = random.Random(10)
    rows = [(rng.choice("xy") if i % 3 else "x", rng.randint(0, 500), rng.randint(0, 9), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, v int, i int")
    out = ranks.running_totals(df, ["g"], F.floor(F.col("o") / 20), [F.col("o"), F.col("i")], {"c": F.col("v"), "n": F.lit(1)}).toPandas()
    want = pd.DataFrame(rows, columns=list("govi")).sort_values(["g", "o", "i"])
    want["c"] = want.groupby("g").v.cumsum()
    want["n"] = want.groupby("g").cumcount() + 1
    got = out.sort_values(["g", "o", "i"]).reset_index(drop=True)
    assert (got[["i", "c", "n"]].values == want[["i", "c", "n"]].values).all()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(50, 20, 300), np.full(200, 7.25), [1e6]])
    pdf = pd.DataFrame({"g": ["a"] * 300 + ["b"] * 201, "x": values})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("b", None), ("c", None)], "g string, x double"))
    out = {r.g: r for r in ranks.exact_quantiles(df, ["g"], "x", {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    assert set(out) == {"a", "b"}
    for g in "ab":
        for n, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            assert out[g][n] == pytest.approx(np.quantile(pdf[pdf.g == g].x, q))


def test_metrics_by_hand(spark):
    y, h = list("LLWHCC"), list("LWWHCH")
    df = spark.createDataFrame(list(zip(y, h)), "y string, h string")
    got = {(r.scope, r.metric): r.value for r in metrics.class_metrics(df, "y", "h", list("LWHC")).collect()}
    assert got[("all", "accuracy")] == pytest.approx(4 / 6) and got[("C", "recall")] == 0.5
    m = {(r.actual, r.predicted): r.n for r in metrics.confusion(df, "y", "h", list("LWHC")).collect()}
    assert m[("C", "H")] == 1 and m[("H", "C")] == 0 and sum(m.values()) == 6


def test_auc_and_precision_with_ties(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(auc)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if y and s >= t)
        ap += sum(1 for y, s in rows if y and s == t) * tp / sum(1 for _, s in rows if s >= t)
    assert metrics.average_precision(df, "y", "s").first()[0] == pytest.approx(ap / len(pos))


@pytest.mark.parametrize("most", [events.PAIRS_A_PLACE, 0])
def test_pair_review_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(events, "PAIRS_A_PLACE", most)  # 0: from the sums of cells
    rng = random.Random(13)
    spots = places(40, 14)
    rows = []
    for i in range(180):
        a, b = spots[rng.randrange(len(spots))]
        rows.append((i, a, b, 100 + (0 if rng.random() < 0.33 else rng.randint(0, 40)), rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "event_no int, latitude double, longitude double, day int, district string")
    got = {r.event_no: r for r in events.pair_review(df, "event_no", "day", "district").collect()}
    for i, a, b, d, own in rows:
        want = dict(reactivation=0, ward_cluster=0, corridor_cluster=0, independent=0, high_similarity=0, moderate_similarity=0, low_similarity=0)
        for j, c, e, f, other in rows:
            if i == j:
                continue
            x, gap = km((a, b), (c, e)), abs(d - f)
            if x <= 50 or gap <= 2:
                alike = own is not None and own == other
                want["high_similarity" if x < 1 else "moderate_similarity" if alike else "low_similarity"] += 1
                if x < 0.05 and gap > 0:
                    want["reactivation"] += 1
                elif x < 1 and gap == 0:
                    want["ward_cluster"] += 1
                elif x <= 50 and gap == 0:
                    want["corridor_cluster"] += 1
                else:
                    want["independent"] += 1
        assert {k: got[i][k] for k in want} == want


def test_rows_that_an_explode_multiplies_are_not_broadcast(spark):
    """Each place stands in nine cells or more, which the planner's sizes leave out."""
    rows = [(a, b, "x", day, 1) for day, (a, b) in enumerate(places(40, 14))]
    place_day = settle(spark.createDataFrame(rows, "_lat double, _lon double, _dist string, _day int, _n long"))
    place = place_day.groupBy("_lat", "_lon", "_dist").agg(F.sum("_n").alias("_n"))
    near = spatial.within_radius(*[settle(table_of(spark, places(40, seed))) for seed in (14, 15)], 50.0)
    for df in (*events._partners_by_pairs(place, place_day, 50.0, 2), near):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_a_place_meets_only_cells_near_itself(spark):
    """Cells that are near to some place of its cell, but far from the place itself, are left out before items are met."""
    here, there = places(300, 31), places(900, 32)
    at = spark.createDataFrame(there, "_ilat double, _ilon double").distinct()
    items = settle(cells.placed(at, cells.place_levels(F.col("_ilat"), F.col("_ilon"), cells.FINEST)))
    counts, depth, levels = cells.item_cells(items, F.count(F.lit(1)))
    sites = settle(spark.createDataFrame(here, "_lat double, _lon double").distinct())
    found = cells.nearest_pairs(cells.point_cells(sites, depth), counts, depth, levels, False)
    at_cells = cells.placed(sites, cells.place_levels(F.col("_lat"), F.col("_lon"), depth)).withColumnsRenamed({"ii": "pi", "ij": "pj"})
    met = settle(at_cells.join(found, ["level", "pi", "pj"]))
    close = met.where(F.col("best").isNull() | (cells.place_bounds(F.col("_lat"), F.col("_lon"))[0] <= F.col("best")))
    assert close.count() < 0.8 * met.count()
    own = close.drop("level").join(items.withColumnRenamed("level", "il"), ["il", "ii", "ij"]).collect()
    best = {}
    for r in own:
        best[r._lat, r._lon] = min(best.get((r._lat, r._lon), 1e9), km((r._lat, r._lon), (r._ilat, r._ilon)))
    assert len(best) == sites.count() and all(d == pytest.approx(min(km(p, q) for q in there)) for p, d in best.items())


def table_of(spark, rows, names="point_id int, latitude double, longitude double"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], names)


def test_nearest_at_any_distance_and_across_180(spark):
    far = spatial.nearest_site(table_of(spark, [(0.1, 0.1)]), table_of(spark, [(0.1, 150.0)], "site int, latitude double, longitude double"), ["site"])
    assert far.first().nearest.distance == pytest.approx(16667.9, abs=1.0)
    near = spatial.nearest_site(table_of(spark, [(25.0, 179.9)]), table_of(spark, [(25.0, -179.9), (25.0, 170.0)], "site int, latitude double, longitude double"), ["site"])
    assert near.first().nearest.site == 0 and near.first().nearest.distance == pytest.approx(20.16, abs=0.1)


def test_nearest_over_the_globe_against_all_pairs(spark):
    rng = random.Random(11)
    spot = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    points, sites = [spot() for _ in range(120)] + [(90.0, 10.0), (-90.0, 0.0), (0.0, 180.0)], [spot() for _ in range(40)] + [(0.0, -180.0)]

    got = spatial.nearest_site(table_of(spark, points), table_of(spark, sites, "site int, latitude double, longitude double"), ["site"]).collect()
    for r in got:
        assert r.nearest.distance == pytest.approx(min(km(points[r.point_id], s) for s in sites), abs=1e-3)


def test_radius_at_high_latitudes(spark):
    rng = random.Random(12)
    for lat, lon in ((70.0, 20.0), (70.0, 180.0), (89.9, 0.0), (-60.0, -179.95)):
        spots = [(min(90.0, lat + rng.uniform(-0.6, 0.6)), (lon + rng.uniform(-3, 3) + 180) % 360 - 180) for _ in range(80)]
        got = spatial.within_radius(table_of(spark, [(lat, lon)]), table_of(spark, spots, "site int, latitude double, longitude double"), 50.0).first()

        assert got.n_within == sum(km((lat, lon), s) <= 50.0 for s in spots)


def city(rng, n, spread=0.05):
    """A dense city, and a few places far around it."""
    return [(25.0 + rng.gauss(0, spread), 91.0 + rng.gauss(0, spread)) for _ in range(n)] + [(22.0 + 0.5 * i, 89.0 + 0.7 * (i % 9)) for i in range(16)]


def test_cells_are_split_where_crowded(spark):
    rng = random.Random(13)
    spots = city(rng, 3000, 0.02)
    sites = table_of(spark, spots, "site int, latitude double, longitude double")
    at = cells.placed(sites, cells.place_levels(F.col("latitude"), F.col("longitude"), cells.FINEST))
    counts, depth, levels = cells.item_cells(at, F.count(F.lit(1)))
    assert 6 <= depth < cells.FINEST and counts.where(F.col("level") == depth).agg(F.max("items")).first()[0] <= cells.CELL_ITEMS
    points = [(25.0 + rng.uniform(-0.3, 0.5), 91.0 + rng.uniform(-0.3, 0.5)) for _ in range(60)] + [(22.1, 89.1), (10.0, 70.0)]
    here = table_of(spark, points)
    lone = here.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    pairs = cells.nearest_pairs(cells.point_cells(lone, depth), counts, depth, levels, False)
    # far places stop at a wide cell, those in the city go down; every key of the last join holds few items
    met = pairs.join(counts.withColumnRenamed("level", "il"), ["il", "ii", "ij"])
    assert met.agg(F.max("items")).first()[0] <= cells.CELL_ITEMS
    assert len({r.level for r in pairs.select("level").distinct().collect()}) > 1
    for r in spatial.nearest_site(here, sites, ["site"]).collect():
        assert r.nearest.distance == pytest.approx(min(km(points[r.point_id], b) for b in spots), abs=1e-9)


def test_radius_counts_of_a_dense_city(spark):
    rng = random.Random(14)
    spots = city(rng, 100_000)  # 10 ** 10 pairs, nearly all pairs lie within the radius
    df = spark.createDataFrame(pd.DataFrame(spots, columns=["latitude", "longitude"]))
    got = {(r.latitude, r.longitude): r for r in spatial.within_radius(df, df, 50.0).collect()}
    lat, lon = np.radians([s[0] for s in spots]), np.radians([s[1] for s in spots])
    for i in [*range(0, 100_000, 2503), *range(100_000, 100_016)]:
        h = np.sin((lat - lat[i]) / 2) ** 2 + np.cos(lat) * math.cos(lat[i]) * np.sin((lon - lon[i]) / 2) ** 2
        far = 12742.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))
        assert got[spots[i]].n_within == int((far <= 50.0).sum())
        assert got[spots[i]].nearest_km == 0.0


@pytest.mark.parametrize("crowd", [1, 32])
def test_counts_within_radii_and_keys(spark, monkeypatch, crowd):
    monkeypatch.setattr(cells, "RIM_ITEMS", crowd)
    monkeypatch.setattr(cells, "FEW", crowd)
    rng = random.Random(15)
    spots = [(rng.choice("ab"), *s) for s in {*places(150, 16), *city(rng, 80, 0.3)}]
    items = spark.createDataFrame([(*s, 1 + i % 3) for i, s in enumerate(spots)], "k string, _ilat double, _ilon double, _n bigint")
    radii = [0.5, 20.0, 50.0]
    got = {(r.k, r._lat, r._lon): r for r in cells.count_within(spark.createDataFrame(spots, "k string, _lat double, _lon double"), items, radii, "k").collect()}
    for k, a, b in spots:
        for w, r in enumerate(radii):
            want = sum(1 + i % 3 for i, (kk, c, d) in enumerate(spots) if kk == k and km((a, b), (c, d)) <= r)
            assert got[k, a, b][f"w{w}"] == want


def ring_of(rng, n, lat, lon, size):
    """A star-shaped outline with n corners."""
    return [(lat + size * rng.uniform(0.3, 1.0) * math.sin(2 * math.pi * i / n), lon + size * rng.uniform(0.3, 1.0) * math.cos(2 * math.pi * i / n)) for i in range(n)]


def inside_of(ring, lat, lon):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1):
            odd = not odd
    return odd


@pytest.mark.parametrize("crowd", [4, 64])
def test_outlines_against_crossing_counts(spark, monkeypatch, crowd):
    monkeypatch.setattr(outlines, "CELL_EDGES", crowd)
    rng = random.Random(17)
    rings = {f"S{k:02}": ring_of(rng, n, 24 + 0.7 * (k % 4), 90 + 0.6 * (k // 4), size) for k, (n, size) in enumerate([(5, 0.8), (40, 1.2), (400, 0.6), (2000, 1.0), (3, 0.01), (12, 3.0), (30, 0.2), (7, 0.5)])}
    rings["T0"] = [(25.0, 91.0), (25.0, 92.0), (26.0, 92.0), (26.0, 91.0)]  # along whole degrees
    rings["T1"] = [(89.0, -179.0), (89.0, 179.0), (-89.0, 179.0), (-89.0, -179.0)]  # over nearly the whole globe
    corners = [(s, i, lon, lat) for s, ring in rings.items() for i, (lat, lon) in enumerate(ring)]
    vertices = spark.createDataFrame(corners, "state string, seq int, lon double, lat double").repartition(3)
    points = [(rng.uniform(22, 30), rng.uniform(88, 95)) for _ in range(1500)]
    points += [(lat + rng.uniform(-1e-4, 1e-4), lon + rng.uniform(-1e-4, 1e-4)) for lat, lon in rng.sample(rings["S03"], 200) + rings["T0"]]
    points += [(rng.choice([25.0, 25.25, 25.5]), rng.choice([91.0, 91.5, 92.25])) for _ in range(20)] + [(0.0, 0.0), (89.5, 0.0), (95.0, 0.0)]
    cut = outlines.outline_cells(vertices)
    most = cut[0].select(F.expr("aggregate(outlines, 0, (n, o) -> n + size(o.edges))").alias("n"), "level").where(F.col("level") < cells.FINEST).agg(F.max("n")).first()[0]
    assert most <= crowd and cut[1] > outlines.WIDEST
    for r in outlines.state_of_point(table_of(spark, points), cut).collect():
        lat, lon = points[r.point_id]
        assert r.inside_state == min((s for s, ring in rings.items() if abs(lat) <= 90 and inside_of(ring, lat, lon)), default=None)


def test_segments_across_180_and_long_ones(spark):
    rng = random.Random(18)
    segs = [(10.0, 179.0, 12.0, -179.0), (-20.0, -179.9, -20.0, -179.9), (0.0, -100.0, 5.0, 40.0)] + [(25 + 0.001 * i, 91 + 0.001 * (i % 20), 25.001 + 0.001 * i, 91.002) for i in range(300)]
    sdf = spark.createDataFrame([(i, *s) for i, s in enumerate(segs)], "fid int, y1 double, x1 double, y2 double, x2 double")
    points = [(11.0, 179.9), (11.0, -179.9), (-20.0, 179.9), (2.0, 0.0), (25.05, 91.01), (60.0, -179.0)] + [(25 + rng.random() * 0.3, 91 + rng.random() * 0.03) for _ in range(60)]
    at = cells.placed_segments(sdf.select("fid", "y1", "x1", "y2", F.when(F.col("fid") == 0, 181.0).otherwise(F.col("x2")).alias("x2")))
    long_ = at.where("fid = 2 and level = 4").count()
    assert 560 <= long_ <= 620  # the cells of 0.25 degrees that it crosses, not the 11 760 of its box
    turned = [(y1, x1, y2, x2 + (360 if x1 - x2 > 180 else 0)) for y1, x1, y2, x2 in segs]
    for r in spatial.nearest_segment(table_of(spark, points), sdf, ["fid"], segment_metres).collect():
        lat, lon = points[r.point_id]
        want = min(metres((lat, lon), (y1, x1 + t, y2, x2 + t)) for y1, x1, y2, x2 in turned for t in (-360, 0, 360))
        assert r.nearest.distance == pytest.approx(want, abs=1e-6)


def narrow_outline(spark):
    """A thin diagonal: little of its box is inside."""
    ring = [(0.0, 0.0), (1.0, 1.0), (1.0, 1.02), (0.0, 0.02)]
    return spark.createDataFrame([("S", i, x, y) for i, (x, y) in enumerate(ring)], "state string, seq int, lon double, lat double")


def test_negatives_are_drawn_until_the_quota_is_full(spark):
    positives = table_of(spark, [(0.01 + 0.004 * i, 0.004 * i) for i in range(200)])
    got = labels.negative_candidates(positives, narrow_outline(spark), exclusion_km=0.05).collect()
    assert len(got) == 200 and len({r.draw for r in got}) == 200 and {r.candidate_no for r in got} == set(range(1, 201))
    again = labels.negative_candidates(positives, narrow_outline(spark), exclusion_km=0.05, first_draws=40).collect()
    assert sorted(got) == sorted(again)
    with pytest.raises(ValueError, match="of 200 candidates"):
        labels.negative_candidates(positives, narrow_outline(spark), exclusion_km=0.05, max_draws=5)


def test_bootstrap_tasks_follow_the_table(spark):
    rows = spark.range(5 * labels.TASK_ROWS).selectExpr("id AS event_no", "cast(id % 2 as int) AS label")
    assert labels.stratified_bootstrap(rows, "label", "event_no").rdd.getNumPartitions() == 5


def test_first_corridor_against_all_pairs(spark):
    rng = random.Random(21)
    spot = lambda: (22 + rng.randrange(600) / 1000, 90 + rng.randrange(600) / 1000)
    lines = [(i, f"c{i}", f"s{i}", *spot()) for i in rng.sample(range(200), 200)] + [(500, "none", None, None, None), (501, "late", "s3", 22.0, 90.0)]
    points = [(i, *spot(), rng.choice([None, None, "s3", "s150", "other"])) for i in range(400)] + [(900, None, None, "s7"), (901, None, 90.0, None), (902, float("nan"), 90.0, None)]
    got = spatial.corridor_match(
        spark.createDataFrame(points, "point_id int, latitude double, longitude double, sector string"),
        spark.createDataFrame(lines, "corridor_order int, corridor string, corridor_sector string, latitude double, longitude double"),
    )
    found = {r.point_id: r.corridor for r in got.collect()}
    near = lambda a, b: None not in (a, b) and abs(a - b) < 0.10
    for i, lat, lon, sector in points:
        hits = [(k, name) for k, name, s, a, b in lines if (sector is not None and s == sector) or (near(a, lat) and near(b, lon))]
        assert found.pop(i) == (min(hits)[1] if hits else None)
    assert not found


def test_corridors_of_a_crowded_cell_are_not_paired_with_its_points(spark):
    crowd = spark.range(2000).selectExpr("cast(id as int) AS point_id", "22 + id % 40 / 1000d AS latitude", "90 + id % 50 / 1000d AS longitude", "cast(null as string) AS sector")
    lines = crowd.selectExpr("point_id AS corridor_order", "cast(point_id as string) AS corridor", "'s' AS corridor_sector", "latitude", "longitude")
    seen = Observation("pairs")
    kind = type(crowd)
    joined = kind.join

    def counted(self, other, *rest):
        out = joined(self, other, *rest)
        return out.observe(seen, F.count(F.lit(1)).alias("n")) if "_clat" in out.columns and "_lat" in out.columns else out

    kind.join = counted
    try:
        assert spatial.corridor_match(crowd, lines).filter("corridor = '0'").count() == 2000
    finally:
        kind.join = joined
    assert seen.get["n"] <= 2000


def test_equal_segments_are_placed_once(spark, monkeypatch):
    rows = [(k, 22.0, 90.0, 22.05, 90.05) for k in (7, 3, 9)] + [(1, 23.0, 91.0, 23.01, 91.0)]
    segments = spark.createDataFrame(rows, "feature_id int, y1 double, x1 double, y2 double, x2 double")
    placed, own = [], spatial.placed_segments
    monkeypatch.setattr(spatial, "placed_segments", lambda items: placed.append(items.count()) or own(items))
    points = spark.createDataFrame([(1, 22.02, 90.03)], "point_id int, latitude double, longitude double")
    assert spatial.nearest_segment(points, segments, ["feature_id"], segment_metres).first().nearest.feature_id == 3
    assert placed == [2]

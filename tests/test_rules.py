"""Literal cases of the rule engines."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions import ground, hazard
from slopecast.functions import text as tx
from slopecast.functions.columns import normal_name, number_or_null, rounded
from slopecast.functions.rainfall import rainfall_class
from slopecast.operators import quality, ranks, terrain
from slopecast.operators.text import entity_features

RAIN_SCHEMA = "rainfall_1h double, rainfall_24h double, rainfall_3d double, rainfall_7d double, quality string, status string"


def trigger(spark, *row):
    df = spark.createDataFrame([row], RAIN_SCHEMA)
    return hazard.rain_trigger(df).first()


def codes(row, name="trigger_reasons"):
    return [r["code"] for r in row[name]]


def test_trigger_normal(spark):
    r = trigger(spark, 5.0, 15.0, 30.0, 50.0, "GOOD", "OK")
    assert r.trigger_level == "NORMAL" and 0 <= r.trigger_score < 0.40 and codes(r) == []


def test_trigger_high(spark):
    r = trigger(spark, 45.0, 120.0, 250.0, 350.0, "GOOD", "OK")
    assert r.trigger_level == "HIGH" and 0.70 <= r.trigger_score <= 1.0
    assert codes(r) == [f"RAINFALL_{w}_HIGH_THRESHOLD" for w in ("1H", "24H", "3D", "7D")]
    assert list(r.breached_windows) == ["1H:HIGH", "24H:HIGH", "3D:HIGH", "7D:HIGH"]


@pytest.mark.parametrize(
    ("quality_", "status", "level", "code"),
    [
        ("MISSING", "MISSING", "NO_DATA", "RAINFALL_DATA_MISSING"),
        ("NO_RELIABLE_STATION", "NO_RELIABLE_LOCAL_STATION", "NO_DATA", "RAINFALL_NO_RELIABLE_STATION"),
        ("STALE", "STALE", "NORMAL", "RAINFALL_DATA_STALE"),
        ("PARTIAL", "OK", "NORMAL", "RAINFALL_DATA_PARTIAL"),
    ],
)
def test_trigger_quality(spark, quality_, status, level, code):
    r = trigger(spark, 5.0, 10.0, None, None, quality_, status)
    assert r.trigger_level == level and code in codes(r)
    assert (r.trigger_score is None) == (level == "NO_DATA")
    assert r.is_stale == (quality_ == "STALE")


def test_missing_is_not_zero(spark):
    r = trigger(spark, None, None, None, None, "GOOD", "OK")
    assert r.trigger_level == "NORMAL" and r.trigger_score == 0.0
    classes = spark.createDataFrame([(None,), (0.0,), (-1.0,), (10.0,), (60.0,), (150.0,)], "x double")
    got = [x[0] for x in classes.select(rainfall_class(F.col("x"))).collect()]
    assert got == ["MISSING", "ZERO", "INVALID_NEGATIVE", "VALID", "HIGH_REVIEW", "EXTREME_REVIEW"]


def test_risk_matrix(spark):
    pairs = [(a, b) for a in fixed.RISK_MATRIX for b in ("NORMAL", "WATCH", "HIGH", "NO_DATA")] + [("ODD", "HIGH")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.level for r in df.select("a", "b", hazard.risk_level(F.col("a"), F.col("b")).alias("level")).collect()}
    for a, b in pairs[:-1]:
        assert got[(a, b)] == fixed.RISK_MATRIX[a][b]
    assert got[("ODD", "HIGH")] == "WATCH"


def test_fusion_score(spark):
    df = spark.createDataFrame(
        [(0.60, "HIGH", "WATCH", 0.40), (0.60, "HIGH", "NO_DATA", None)],
        "static_score double, tier string, trigger_level string, trigger_score double",
    ).withColumn("trigger_reasons", F.array(hazard.reason("X", "x")))
    a, b = hazard.fuse(df).orderBy(F.desc_nulls_last("trigger_score")).collect()
    assert a.fusion_score == 0.5 and a.scoring_mode.startswith("DUAL")
    assert b.fusion_score == 0.6 and b.scoring_mode.startswith("STATIC")
    assert "STATIC_HIGH_SUSCEPTIBILITY_RAINFALL_UNOBSERVED" in codes(b, "reasons")


SOIL = "clay_percent double, sand_percent double, bulk_density_kg_dm3 double, slope_deg double, rainfall_24h double, rainfall_3d double, rainfall_7d double, topographic_wetness_index double"


def test_soil_dry_and_wet(spark):
    df = spark.createDataFrame(
        [(25.0, 45.0, 1.30, 20.0, 0.0, 0.0, 0.0, 4.0), (32.0, 35.0, 1.25, 35.0, 140.0, 260.0, 400.0, 6.2)], SOIL
    )
    dry, wet = ground.soil_state(df).orderBy("rainfall_24h").collect()
    assert dry.saturation_ratio < 0.50 and dry.pore_pressure_kpa == 0 and dry.factor_of_safety > 1.30
    assert dry.stability_status == "GEOTECHNICALLY_STABLE" and dry.liquefaction_risk == "MINIMAL"
    assert wet.saturation_ratio >= 0.70 and wet.pore_pressure_kpa > 0
    assert wet.saturation_state in ("HIGH_PORE_PRESSURE", "CRITICAL_SATURATION")


HUMAN = (
    "case string, slope_deg double, landcover_class string, slope_position string, cut_slope_deg double, road_cut_present boolean, "
    "unsupported_excavation boolean, drainage_blocked boolean, deforestation_observed boolean, has_retaining_wall boolean, "
    "cohesion_kpa double, friction_deg double, pore_pressure_kpa double"
)


def test_slope_modification(spark):
    base = ("Tree cover", "Mid-Slope")
    no = False
    rows = [
        ("plain", 25.0, *base, None, no, no, no, no, no, 14.0, 30.0, 0.0),
        ("cut", 28.0, *base, 65.0, True, no, no, no, no, 14.0, 30.0, 0.0),
        ("walled", 28.0, *base, 65.0, True, no, no, no, True, 14.0, 30.0, 0.0),
        ("drain", 25.0, *base, None, no, no, True, no, no, 14.0, 30.0, 0.0),
        ("bare", 25.0, *base, None, no, no, no, True, no, 14.0, 30.0, 0.0),
    ]
    got = {r.case: r for r in ground.slope_modification(spark.createDataFrame(rows, HUMAN)).collect()}
    assert got["plain"].hazard_multiplier == 1.0 and got["plain"].stability_verdict == "STABLE"
    assert got["cut"].cut_severity == "SEVERE" and got["cut"].hazard_multiplier >= 1.40
    assert got["drain"].surcharge_kpa == 3.5 and got["bare"].root_cohesion_kpa == 0
    assert got["walled"].modified_fos > got["cut"].modified_fos


def test_local_rain(spark):
    schema = "rainfall_1h double, rainfall_24h double, slope_deg double, aspect_deg double, elevation_m double, plan_curvature double"
    df = spark.createDataFrame(
        [(25.0, 70.0, 30.0, 200.0, 1200.0, 0.0), (25.0, 70.0, 30.0, 20.0, 1200.0, 0.0), (45.0, 140.0, 30.0, 200.0, 1200.0, 0.0)], schema
    )
    wind, lee, burst = hazard.cloudburst(hazard.orographic_rain(df)).collect()
    assert wind.orographic_factor > 1.05 and lee.orographic_factor < 1.0
    assert burst.cloudburst and burst.reflectivity_dbz >= 48 and burst.idf_breached and burst.regime == "CLOUDBURST_TORRENT"


def grid_frame(spark, rows):
    return spark.createDataFrame(
        [(r, c, None if z is None else float(z)) for r, line in enumerate(rows) for c, z in enumerate(line)],
        "grid_row bigint, grid_col bigint, elev double",
    )


def test_plane_is_planar(spark):
    rise = 30.0 * math.tan(math.radians(30.0))
    plane = [[1000.0 - rise * r for _ in range(7)] for r in range(7)]
    out = terrain.terrain(grid_frame(spark, plane), F.lit(30.0), F.lit(30.0)).filter("grid_row = 3 and grid_col = 3").first()
    assert abs(out.slope_deg - 30.0) < 1e-9 and abs(out.aspect_deg - 180.0) < 1e-9
    assert abs(out.profile_curvature) < 0.05 and abs(out.plan_curvature) < 0.05
    assert out.curvature_class.startswith("Planar") and out.terrain_quality == "OK"


def test_bowl_multiplier(spark):
    out = terrain.terrain(grid_frame(spark, [[120, 115, 120], [110, 100, 110], [105, 95, 105]]), F.lit(30.0), F.lit(30.0))
    assert out.filter("grid_row = 1 and grid_col = 1").first().terrain_multiplier >= 1.0


def test_stencil_does_not_depend_on_blocks(spark):
    rows = [[(r * 7 + c * 13) % 50 for c in range(9)] for r in range(23)]
    g = grid_frame(spark, rows)
    one = terrain.neighbourhood(g, block=1000).orderBy("grid_row", "grid_col").collect()
    cut = terrain.neighbourhood(g, block=4).orderBy("grid_row", "grid_col").collect()
    assert one == cut


def test_quantities(spark):
    df = spark.createDataFrame([("182 mm",), ("38.5 degrees",), ("850m",), ("invalid text",)], "t string")
    got = [tuple(r) for r in df.select(tx.quantity_value(F.col("t")), tx.quantity_unit(F.col("t"))).collect()]
    assert got == [(182.0, "mm"), (38.5, "degrees"), (850.0, "m"), (None, None)]


@pytest.mark.parametrize(
    ("kind", "text", "value"),
    [("rain", "18.2 cm", 182.0), ("rain", "2 in", 50.8), ("elevation", "1000 ft", 304.8), ("elevation", "1.5 km", 1500.0),
     ("distance", "800 m", 0.8), ("soil", "70%", 0.7), ("soil", "high", None)],
)
def test_units(spark, kind, text, value):
    df = spark.createDataFrame([(kind, text)], "k string, t string")
    n = df.select(tx.normal_quantity(F.col("k"), tx.quantity_value(F.col("t")), tx.quantity_unit(F.col("t"))).alias("n")).first().n
    assert n["value"] == pytest.approx(value) if value is not None else n["value"] is None and n["warning"] == "QUALITATIVE"


def test_negation(spark):
    df = spark.createDataFrame(
        [("No prior landslide recorded in the area",), ("Slide occurred near site in 2010",), ("Site visited by team",)], "t string"
    )
    assert [r[0] for r in df.select(tx.landslide_flag(F.col("t"))).collect()] == [0, 1, None]


def test_full_payload_is_ready(spark):
    rows = [
        (1, 1, "24-hour rainfall", "182 mm"), (1, 2, "3-day rainfall", "310 mm"), (1, 3, "7-day rainfall", "520 mm"), (1, 4, "slope", "38 degrees"),
        (1, 5, "elevation", "850 m"), (1, 6, "historical landslide", "occurred in 2010"), (1, 7, "distance to landslide", "0.8 km"), (1, 8, "soil risk", "0.7"),
        (2, 1, "rainfall", "50 mm"),
    ]
    out = {r.doc_id: r for r in entity_features(spark.createDataFrame(rows, "doc_id bigint, line_no int, label string, text string")).collect()}
    assert out[1].prediction_ready and out[1].missing_features == [] and out[1].rainfall_24h == 182.0
    assert not out[2].prediction_ready and out[2].rainfall_24h is None and "AMBIGUOUS_RAINFALL" in out[2].warnings


def test_one_violation_per_broken_field(spark):
    good = (100.0, 200.0, 300.0, 30.0, 800.0, 1.0, 2.0, 0.5)
    bad = {"rainfall_24h": -1.0, "slope": 91.0, "elevation": 9001.0, "historical_landslide": 2.0, "soil_risk": float("nan"), "rainfall_7d": float("inf"), "distance_to_landslide": None}
    rows = [(0, *good)]
    for i, (name, v) in enumerate(bad.items(), 1):
        row = list(good)
        row[fixed.FEATURES.index(name)] = v
        rows.append((i, *row))
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{f} double" for f in fixed.FEATURES))
    got = sorted((r.id, r.field) for r in quality.rule_violations(df, ["id"]).collect())
    assert got == sorted((i, n) for i, n in enumerate(bad, 1))


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("  arunachal \r\n pradesh ", "-12%"), (None, "1,234"), ("x", "12d")], "s string, n string")
    got = [tuple(r) for r in df.select(normal_name(F.col("s")), number_or_null(F.col("n"))).collect()]
    assert got == [("ARUNACHAL PRADESH", -12.0), (None, 1234.0), ("X", None)]


def test_rounding_keeps_large_and_special_values(spark):
    values = [3e15, float("inf"), float("-inf"), 1.00005, -2.5, None, 123456789012.34567, 9.3e14]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v")).alias("x")).collect()]
    assert got == [3e15, float("inf"), float("-inf"), 1.0001, -2.5, None, 123456789012.3457, 9.3e14]


def test_quantile_plans_do_not_grow_with_the_list(spark):
    """31 quantiles are found by the same aggregates as two, and are those of linear interpolation."""
    values = [(k * 37 % 101) * 1.5 for k in range(57)] + [3.0] * 9
    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in values], "g string, v double")
    wanted = {f"q{i}": i / 30 for i in range(31)}
    found = ranks.exact_quantiles(df, ["g"], "v", wanted)
    few = ranks.exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9})
    maxima = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("max(")
    assert maxima(found) == maxima(few)
    rows = found.collect()
    assert {r.g for r in rows} == {"a", None}
    for r in rows:
        for name, q in wanted.items():
            assert r[name] == pytest.approx(statistics_of(values, q), abs=1e-9)


def statistics_of(values, q):
    ordered, pos = sorted(values), q * (len(values) - 1)
    low = int(pos)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (pos - low)

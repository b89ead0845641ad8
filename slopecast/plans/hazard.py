"""Hazard queries: soil, slope, rain trigger, fusion and the assessment chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions import ground, hazard
from slopecast.functions.columns import rounded
from slopecast.operators import assessment as op
from slopecast.operators import telemetry
from slopecast.operators.asof import asof
from slopecast.operators.outlines import state_of_point
from slopecast.operators.spatial import code_labels
from slopecast.plans.bindings import SQL_TABLES, Tables, dbl, rnd, sql_haversine
from slopecast.plans.registry import query
from slopecast.plans.spatial import COVER_VALUES, INSIDE_SQL, NEAREST_SQL, SOIL_VALUES
from slopecast.plans.telemetry import features

# Rain and quality per point, so that every branch of the rules is met.
WEATHER = [
    "CASE WHEN point_id % 17 = 0 THEN NULL ELSE (point_id * 11 % 600) / 10e0 END AS rainfall_1h",
    "CASE WHEN point_id % 19 = 0 THEN NULL ELSE (point_id * 13 % 1400) / 10e0 END AS rainfall_24h",
    "CASE WHEN point_id % 23 = 0 THEN NULL ELSE (point_id * 29 % 2600) / 10e0 END AS rainfall_3d",
    "CASE WHEN point_id % 29 = 0 THEN NULL ELSE (point_id * 31 % 4000) / 10e0 END AS rainfall_7d",
    "CASE point_id % 8 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'NO_RELIABLE_STATION' WHEN 2 THEN 'STALE' "
    "WHEN 3 THEN 'PARTIAL' ELSE 'GOOD' END AS quality",
    "CASE point_id % 8 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'NO_RELIABLE_LOCAL_STATION' WHEN 2 THEN 'STALE' ELSE 'OK' END AS status",
]
SQL_TABLES["labelled"] = (
    "SELECT p.*, a.n AS soil_class, b.n AS landcover_class, CASE WHEN static_score >= 0.75 THEN 'VERY_HIGH' "
    "WHEN static_score >= 0.5 THEN 'HIGH' WHEN static_score >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM points p "
    f"LEFT JOIN (VALUES {SOIL_VALUES}) a(c, n) ON a.c = soil_code LEFT JOIN (VALUES {COVER_VALUES}) b(c, n) ON b.c = cover_code"
)
SQL_TABLES["weather"] = f"SELECT *, {', '.join(WEATHER)} FROM labelled"


def weather(t: Tables):
    p = code_labels(t.points).withColumn("tier", hazard.susceptibility_tier(F.col("static_score")))
    return p.selectExpr("*", *WEATHER)


def rd(x: str, digits: int) -> str:
    return f"(floor(floor(({x}) * 1e8 + 0.5) / 1e8 * 1e{digits} + 0.5) / 1e{digits})"


def sql_soil(src: str) -> str:
    a = f"""SELECT *, coalesce(clay_percent, 25.0) AS v_clay, coalesce(sand_percent, 40.0) AS v_sand, coalesce(bulk_density_kg_dm3, 1.3) AS v_bd,
        radians(greatest(0.1, least(89.0, coalesce(slope_deg, 15.0)))) AS v_beta, greatest(0.0, coalesce(rainfall_24h, 0.0)) AS v_r1 FROM ({src})"""
    a = f"SELECT *, greatest(v_r1, coalesce(rainfall_3d, v_r1)) AS v_r3 FROM ({a})"
    a = f"SELECT *, greatest(v_r3, coalesce(rainfall_7d, v_r3)) AS v_r7, greatest(0.25, least(0.7, 1.0 - v_bd / 2.65)) AS porosity FROM ({a})"
    a = f"""SELECT *, {rd('greatest(0.5, least(120.0, 10.0 * exp(0.03 * v_sand - 0.04 * v_clay)))', 2)} AS ksat_mm_hr,
        (v_r1 * 0.9 + (v_r3 - v_r1) * 0.4 + (v_r7 - v_r3) * 0.15) * greatest(0.8, least(1.8, 1.0 + (coalesce(topographic_wetness_index, 4.0) - 4.0) * 0.1)) AS v_re FROM ({a})"""
    a = f"SELECT *, {rd('greatest(0.15, least(1.0, 0.28 + v_clay / 100.0 * 0.15 + v_re / (1.2 * porosity * 1000.0)))', 3)} AS saturation_ratio FROM ({a})"
    a = f"""SELECT *, CASE WHEN saturation_ratio > 0.65 THEN {rd('(saturation_ratio - 0.65) / 0.35 * 9.81 * 1.2 * cos(v_beta) * cos(v_beta)', 2)} ELSE 0.0 END AS pore_pressure_kpa,
        {rd('greatest(2.0, least(35.0, 5.0 + 0.35 * v_clay))', 1)} AS cohesion_kpa,
        {rd('greatest(18.0, least(42.0, 24.0 + 0.22 * v_sand - 0.12 * v_clay))', 1)} AS friction_deg, v_bd * 9.81 + porosity * 9.81 AS v_w FROM ({a})"""
    a = f"""SELECT *, {rd('least(5.0, greatest(0.2, (cohesion_kpa + greatest(0.0, v_w * 1.2 * cos(v_beta) * cos(v_beta) - pore_pressure_kpa) * tan(radians(friction_deg))) / greatest(0.5, v_w * 1.2 * sin(v_beta) * cos(v_beta))))', 2)} AS factor_of_safety FROM ({a})"""
    return f"""SELECT *, CASE WHEN saturation_ratio >= 0.85 THEN 'CRITICAL_SATURATION' WHEN saturation_ratio >= 0.65 THEN 'HIGH_PORE_PRESSURE'
        WHEN saturation_ratio >= 0.4 THEN 'MODERATE_MOISTURE' ELSE 'DRY_STABLE' END AS saturation_state,
        CASE WHEN saturation_ratio >= 0.85 THEN 'HIGH' WHEN saturation_ratio >= 0.65 THEN 'ELEVATED' WHEN saturation_ratio >= 0.4 THEN 'LOW' ELSE 'MINIMAL' END AS liquefaction_risk,
        CASE WHEN factor_of_safety <= 1.0 THEN 'ACTIVE_FAILURE_IMMINENT' WHEN factor_of_safety <= 1.3 THEN 'MARGINALLY_STABLE_WATCH' ELSE 'GEOTECHNICALLY_STABLE' END AS stability_status,
        {rd('3.5 + 32.0 * saturation_ratio * porosity + 15.0 * (saturation_ratio * porosity) * (saturation_ratio * porosity)', 1)} AS dielectric_constant,
        {rd('-18.0 + 11.5 * saturation_ratio', 1)} AS backscatter_db FROM ({a})"""


def sql_human(src: str) -> str:
    a = f"""SELECT *, coalesce(slope_deg, 20.0) AS h_nat, (road_cut_present OR unsupported_excavation) AS is_cut,
        CAST(CASE WHEN deforestation_observed THEN 0.0 WHEN landcover_class LIKE 'Tree%' THEN 10.0 WHEN landcover_class = 'Shrubland' THEN 4.0
        WHEN landcover_class = 'Grassland' THEN 2.0 WHEN landcover_class = 'Cropland' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS root_cohesion_kpa FROM ({src})"""
    a = f"""SELECT *, CASE WHEN is_cut THEN coalesce(cut_slope_deg, least(75.0, h_nat + 25.0)) ELSE h_nat END AS effective_slope_deg FROM ({a})"""
    a = f"""SELECT *, radians(effective_slope_deg) AS h_b, CASE WHEN is_cut AND effective_slope_deg >= 60 THEN 'SEVERE' WHEN is_cut THEN 'MODERATE'
        WHEN slope_position IN ('Foot-Slope / Toe Cut', 'Valley Bottom / Deep Hollow') AND h_nat >= 20 THEN 'POTENTIAL_TOE_EXPOSURE' ELSE 'NONE' END AS cut_severity FROM ({a})"""
    a = f"""SELECT *, {rd("greatest(0.7, least(2.5, 1.0 + CASE cut_severity WHEN 'SEVERE' THEN 0.45 WHEN 'MODERATE' THEN 0.25 ELSE 0.0 END + CASE WHEN drainage_blocked THEN 0.3 ELSE 0.0 END + CASE WHEN deforestation_observed THEN 0.2 ELSE 0.0 END - CASE WHEN has_retaining_wall THEN 0.35 ELSE 0.0 END))", 2)} AS hazard_multiplier,
        {rd('least(5.0, greatest(0.15, (cohesion_kpa + root_cohesion_kpa + greatest(0.0, 18.5 * 1.2 * cos(h_b) * cos(h_b) - (pore_pressure_kpa + CASE WHEN drainage_blocked THEN 3.5 ELSE 0.0 END)) * tan(radians(friction_deg)) + CASE WHEN has_retaining_wall THEN 12.0 ELSE 0.0 END) / greatest(0.5, 18.5 * 1.2 * sin(h_b) * cos(h_b))))', 2)} AS modified_fos FROM ({a})"""
    return f"""SELECT *, CASE WHEN modified_fos <= 1.0 THEN 'CRITICAL_INSTABILITY' WHEN modified_fos <= 1.3 THEN 'MARGINAL_EQUILIBRIUM' ELSE 'STABLE' END AS stability_verdict,
        coalesce(nullif(concat_ws(',', CASE WHEN is_cut AND NOT has_retaining_wall THEN 'BUILD_RETAINING_WALL' END, CASE WHEN drainage_blocked THEN 'CLEAR_DRAINAGE' END,
        CASE WHEN deforestation_observed OR root_cohesion_kpa < 3 THEN 'PLANT_DEEP_ROOTS' END, CASE WHEN modified_fos <= 1 THEN 'RESTRICT_AND_EVACUATE' END), ''), 'ROUTINE_INSPECTION') AS advice FROM ({a})"""


def sql_micro(src: str) -> str:
    a = f"""SELECT *, greatest(0.0, coalesce(rainfall_1h, 0.0)) AS m_r1, greatest(0.0, least(89.0, coalesce(slope_deg, 15.0))) AS m_s,
        cos(radians(coalesce(aspect_deg, 180.0) - 200.0)) AS m_f, least(1.5, greatest(0.0, coalesce(elevation_m, 500.0)) / 1200.0) AS m_l FROM ({src})"""
    a = f"""SELECT *, greatest(m_r1, coalesce(rainfall_24h, 0.0)) AS m_r24,
        {rd('greatest(0.8, least(1.45, CASE WHEN m_f > 0.3 AND m_s > 12 THEN 1.0 + m_f * sin(radians(m_s)) * m_l * 0.45 WHEN m_f < -0.3 AND m_s > 15 THEN greatest(0.82, 1.0 - abs(m_f) * 0.18) ELSE 1.0 END))', 2)} AS orographic_factor,
        CASE WHEN m_f > 0.3 AND m_s > 12 THEN 'OROGRAPHIC_WINDWARD_AMPLIFIED' WHEN m_f < -0.3 AND m_s > 15 THEN 'OROGRAPHIC_LEEWARD_SHADOW' ELSE 'NORMAL_CONVECTIVE' END AS m_regime FROM ({a})"""
    a = f"SELECT *, {rd('m_r1 * orographic_factor', 2)} AS micro_1h, {rd('m_r24 * orographic_factor', 2)} AS micro_24h FROM ({a})"
    a = f"SELECT *, {rd('least(65.0, greatest(10.0, 10.0 * log10(200.0 * pow(greatest(0.1, micro_1h), 1.6))))', 1)} AS reflectivity_dbz FROM ({a})"
    a = f"""SELECT *, micro_1h >= 40 OR reflectivity_dbz >= 48 AS cloudburst, micro_1h >= 14.82 OR micro_24h >= 103 AS idf_breached,
        {rd('0.7 * micro_1h * greatest(1.0, 5.0 * (1.0 - least(1.0, coalesce(plan_curvature, 0.0) * 0.2))) / 360.0', 3)} AS peak_runoff_m3s FROM ({a})"""
    return f"SELECT *, CASE WHEN cloudburst THEN 'CLOUDBURST_TORRENT' ELSE m_regime END AS regime FROM ({a})"


def sql_trigger(src: str, factor: str = "1.0") -> str:
    wins = [("1h", 20, 40), ("24h", 50, 100), ("3d", 100, 200), ("7d", 150, 300)]
    hi = " OR ".join(f"coalesce(rainfall_{w} >= {b} * {factor}, false)" for w, a, b in wins)
    wa = " OR ".join(f"coalesce(rainfall_{w} >= {a} * {factor}, false)" for w, a, b in wins)
    ratio = "greatest(" + ", ".join(f"CASE WHEN rainfall_{w} >= 0 THEN rainfall_{w} / ({b} * {factor}) END" for w, a, b in wins) + ")"
    a = f"""SELECT *, CASE WHEN quality IN ('NO_RELIABLE_STATION', 'MISSING') OR status = 'NO_RELIABLE_LOCAL_STATION' THEN 'NO_DATA'
        WHEN {hi} THEN 'HIGH' WHEN {wa} THEN 'WATCH' ELSE 'NORMAL' END AS trigger_level, {ratio} AS t_ratio FROM ({src})"""
    codes = ", ".join(
        f"CASE WHEN rainfall_{w} >= {b} * {factor} THEN 'RAINFALL_{w.upper()}_HIGH_THRESHOLD' WHEN rainfall_{w} >= {a_} * {factor} THEN 'RAINFALL_{w.upper()}_WATCH_THRESHOLD' END"
        for w, a_, b in wins
    )
    broken = ", ".join(
        f"CASE WHEN rainfall_{w} >= {b} * {factor} THEN '{w.upper()}:HIGH' WHEN rainfall_{w} >= {a_} * {factor} THEN '{w.upper()}:WATCH' END" for w, a_, b in wins
    )
    return f"""SELECT *, CASE WHEN trigger_level = 'NO_DATA' THEN NULL WHEN t_ratio IS NULL THEN 0.0
        WHEN trigger_level = 'HIGH' THEN {rd('least(1.0, 0.7 + least(0.3, (t_ratio - 1.0) * 0.15))', 4)}
        WHEN trigger_level = 'WATCH' THEN {rd('0.4 + least(0.29, (t_ratio - 0.5) * 0.58)', 4)} ELSE {rd('least(0.39, t_ratio * 0.78)', 4)} END AS trigger_score,
        CASE WHEN trigger_level = 'NO_DATA' THEN CASE WHEN quality = 'NO_RELIABLE_STATION' THEN 'RAINFALL_NO_RELIABLE_STATION' ELSE 'RAINFALL_DATA_MISSING' END
        ELSE concat_ws('; ', {codes}, CASE WHEN quality = 'STALE' THEN 'RAINFALL_DATA_STALE' END, CASE WHEN quality = 'PARTIAL' THEN 'RAINFALL_DATA_PARTIAL' END) END AS trigger_codes,
        CASE WHEN trigger_level = 'NO_DATA' THEN '' ELSE concat_ws(',', {broken}) END AS breached,
        trigger_level <> 'NO_DATA' AND quality = 'STALE' AS is_stale FROM ({a})"""


MATRIX_VALUES = ", ".join(f"('{a}', '{b}', '{r}')" for a, row in fixed.RISK_MATRIX.items() for b, r in row.items())


def sql_fuse(src: str) -> str:
    return f"""SELECT s.*, coalesce(m.r, 'WATCH') AS risk_level,
        CASE WHEN trigger_score IS NOT NULL THEN {rd('greatest(0.0, least(1.0, 0.5 * static_score + 0.5 * trigger_score))', 4)} ELSE {rd('static_score', 4)} END AS fusion_score,
        CASE WHEN trigger_score IS NOT NULL THEN 'DUAL_LAYER_WEIGHTED_SYNTHESIS' ELSE 'STATIC_BASELINE_ONLY_RAINFALL_UNOBSERVED' END AS scoring_mode,
        concat_ws('; ', 'STATIC_' || tier || '_SUSCEPTIBILITY', CASE WHEN trigger_level <> 'NO_DATA' THEN 'RAINFALL_' || trigger_level || '_TRIGGER' END,
        CASE WHEN trigger_level = 'NO_DATA' AND tier IN ('HIGH', 'VERY_HIGH') THEN 'STATIC_' || tier || '_SUSCEPTIBILITY_RAINFALL_UNOBSERVED' END, nullif(trigger_codes, '')) AS reason_text
        FROM ({src}) s LEFT JOIN (VALUES {MATRIX_VALUES}) m(a, b, r) ON m.a = tier AND m.b = trigger_level"""


W = "SELECT * FROM weather"


@query(
    "soil_hydrology",
    f"SELECT point_id, {rnd('porosity')} AS porosity, ksat_mm_hr, saturation_ratio FROM ({sql_soil(W)})",
)
def soil_hydrology(t: Tables):
    return ground.soil_hydrology(weather(t)).select(
        "point_id", rounded(F.col("porosity")).alias("porosity"), "ksat_mm_hr", "saturation_ratio"
    )


@query(
    "pore_pressure_fos",
    f"SELECT point_id, pore_pressure_kpa, cohesion_kpa, friction_deg, factor_of_safety FROM ({sql_soil(W)})",
)
def pore_pressure_fos(t: Tables):
    return ground.pore_pressure(ground.soil_hydrology(weather(t))).select(
        "point_id", "pore_pressure_kpa", "cohesion_kpa", "friction_deg", "factor_of_safety"
    )


STATES = ["saturation_state", "liquefaction_risk", "stability_status", "dielectric_constant", "backscatter_db"]


@query("stability_states", f"SELECT point_id, {', '.join(STATES)} FROM ({sql_soil(W)})")
def stability_states(t: Tables):
    return ground.soil_state(weather(t)).select("point_id", *STATES)


HUMAN = ["is_cut", "cut_severity", "root_cohesion_kpa", "hazard_multiplier", "modified_fos", "stability_verdict"]


@query(
    "slope_modification",
    f"SELECT point_id, {', '.join(HUMAN)}, {rd('effective_slope_deg', 1)} AS effective_slope_deg, advice FROM ({sql_human(sql_soil(W))})",
)
def slope_modification(t: Tables):
    return ground.slope_modification(ground.soil_state(weather(t))).select(
        "point_id", *HUMAN, rounded(F.col("effective_slope_deg"), 1).alias("effective_slope_deg"),
        F.array_join("recommendations", ",").alias("advice"),
    )


@query("orographic_rain", f"SELECT point_id, orographic_factor, m_regime AS regime, micro_1h, micro_24h FROM ({sql_micro(W)})")
def orographic_rain(t: Tables):
    return hazard.orographic_rain(weather(t)).select("point_id", "orographic_factor", "regime", "micro_1h", "micro_24h")


BURST = ["reflectivity_dbz", "cloudburst", "idf_breached", "peak_runoff_m3s", "regime"]


@query("cloudburst_idf_runoff", f"SELECT point_id, {', '.join(BURST)} FROM ({sql_micro(W)})")
def cloudburst_idf_runoff(t: Tables):
    return hazard.cloudburst(hazard.orographic_rain(weather(t))).select("point_id", *BURST)


@query("rain_trigger", f"SELECT point_id, trigger_level, trigger_score, trigger_codes, breached, is_stale FROM ({sql_trigger(W)})")
def rain_trigger(t: Tables):
    return hazard.rain_trigger(weather(t)).select(
        "point_id", "trigger_level", "trigger_score", hazard.codes(F.col("trigger_reasons")).alias("trigger_codes"),
        F.array_join("breached_windows", ",").alias("breached"), "is_stale",
    )


@query("risk_fusion", f"SELECT point_id, tier, trigger_level, risk_level, fusion_score, scoring_mode, reason_text FROM ({sql_fuse(sql_trigger(W))})")
def risk_fusion(t: Tables):
    return hazard.fuse(hazard.rain_trigger(weather(t))).select(
        "point_id", "tier", "trigger_level", "risk_level", "fusion_score", "scoring_mode",
        hazard.codes(F.col("reasons")).alias("reason_text"),
    )


@query("susceptibility_tier", "SELECT point_id, tier FROM labelled")
def susceptibility_tier(t: Tables):
    return t.points.select("point_id", hazard.susceptibility_tier(F.col("static_score")).alias("tier"))


MISSING_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in hazard.COMPLETENESS) + ")"
MISSING_N = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in hazard.COMPLETENESS)


@query(
    "feature_completeness",
    f"SELECT point_id, {MISSING_SQL} AS missing, CASE WHEN {MISSING_N} = 0 THEN 'OK' WHEN {MISSING_N} <= 4 THEN 'PARTIAL' ELSE 'INVALID' END AS quality_status FROM labelled",
)
def feature_completeness(t: Tables):
    return hazard.feature_completeness(code_labels(t.points)).select(
        "point_id", F.array_join("missing_features", ",").alias("missing"), "quality_status"
    )


REASON_SQL = """coalesce(nullif(concat_ws('; ', CASE WHEN slope_deg >= 25 THEN 'TERRAIN_STEEP_SLOPE' END, CASE WHEN relief_std_5x5_m >= 25 THEN 'HIGH_LOCAL_RELIEF' END,
    CASE WHEN aspect_deg BETWEEN 90 AND 270 THEN 'SOUTH_FACING_ASPECT_SIGNAL' END, CASE WHEN elevation_m >= 1500 THEN 'HIGH_ELEVATION_SIGNAL' END,
    CASE WHEN landcover_class IN ('Bare / sparse vegetation', 'Grassland') THEN 'LOW_CANOPY_VEGETATION_SIGNAL' END, CASE WHEN clay_percent >= 30 THEN 'FINE_SOIL_TEXTURE_SIGNAL' END,
    CASE WHEN curvature_class LIKE '%Concave-Convergent%' THEN 'MICRO_CONVERGENT_HOLLOW' WHEN curvature_class LIKE '%Convergent%' THEN 'MICRO_CONVERGENT_CHANNEL' END,
    CASE WHEN slope_position IN ('Foot-Slope / Toe Cut', 'Valley Bottom / Deep Hollow') THEN 'VILLAGE_TOE_SLOPE_ZONE' END,
    CASE WHEN topographic_wetness_index >= 5.5 THEN 'HIGH_TOPOGRAPHIC_WETNESS' END,
    CASE WHEN saturation_state IN ('CRITICAL_SATURATION', 'HIGH_PORE_PRESSURE') THEN 'SOIL_SATURATION_WARNING' END,
    CASE WHEN factor_of_safety <= 1.3 THEN 'LIMIT_EQUILIBRIUM_SLOPE_WARNING' END), ''), 'MODERATE_BASELINE_SIGNAL')"""


@query("reason_codes_static", f"SELECT point_id, {REASON_SQL} AS codes FROM ({sql_soil(W)})")
def reason_codes_static(t: Tables):
    return hazard.static_reasons(ground.soil_state(weather(t))).select("point_id", hazard.codes(F.col("reason_codes")).alias("codes"))


@query(
    "code_list_join",
    "SELECT user_id, string_agg(event_type, '; ' ORDER BY event_type) AS codes FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id",
)
def code_list_join(t: Tables):
    """Distinct codes per key in one text; the sets are as small as the code list."""
    return t.raw("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("codes"))


IMPORTANCE = {
    "rainfall_24h": 0.25, "rainfall_7d": 0.20, "slope": 0.15, "rainfall_3d": 0.12,
    "soil_risk": 0.10, "distance_to_landslide": 0.08, "historical_landslide": 0.05, "elevation": 0.05,
}
FACTOR_SQL = [
    ("very_high_rainfall_24h", "rainfall_24h", "rainfall_24h >= 100"), ("high_rainfall_24h", "rainfall_24h", "rainfall_24h >= 50 AND rainfall_24h < 100"),
    ("very_high_rainfall_7d", "rainfall_7d", "rainfall_7d >= 500"), ("high_rainfall_7d", "rainfall_7d", "rainfall_7d >= 250 AND rainfall_7d < 500"),
    ("high_rainfall_3d", "rainfall_3d", "rainfall_3d >= 200"), ("steep_slope", "slope", "slope >= 30"), ("moderate_slope", "slope", "slope >= 20 AND slope < 30"),
    ("historical_landslide_present", "historical_landslide", "historical_landslide = 1"), ("near_historical_landslide", "distance_to_landslide", "distance_to_landslide <= 2"),
    ("high_soil_risk", "soil_risk", "soil_risk >= 0.6"), ("moderate_soil_risk", "soil_risk", "soil_risk >= 0.4 AND soil_risk < 0.6"),
    ("low_rainfall_stable", "rainfall_24h", "rainfall_24h < 30 AND rainfall_7d < 100"), ("gentle_slope_stable", "slope", "slope < 15"),
]
_BY_WEIGHT = sorted(FACTOR_SQL, key=lambda r: (-IMPORTANCE[r[1]], r[1], r[0]))
_FIRED = ", ".join(f"CASE WHEN {cond} THEN '{c}' END" for c, _, cond in _BY_WEIGHT)


@query(
    "topk_factors",
    f"""SELECT doc_id, line_no, coalesce(array_to_string(list_slice(list_filter([{_FIRED}], lambda x: x IS NOT NULL), 1, 5), ','), '') AS codes
    FROM feature_rows""",
)
def topk_factors(t: Tables):
    """Up to five fired rules per row by importance; a per-row sort, nothing is shuffled."""
    f = hazard.contributing_factors(t.feature_rows, IMPORTANCE)
    return f.select("doc_id", "line_no", F.array_join(F.transform("factors", lambda x: x["code"]), ",").alias("codes"))


SQL_TABLES["near"] = NEAREST_SQL
OBS_SQL = f"""SELECT p.point_id, n.station_key, f.* EXCLUDE (station_key), epoch_us(f.ts) AS t_us FROM points p JOIN near n USING (point_id)
    JOIN tele_feat f ON f.station_key = n.station_key
    QUALIFY row_number() OVER (PARTITION BY p.point_id ORDER BY abs(epoch_us(f.ts) - p.query_us), epoch_us(f.ts), f.reading_id, f.copy_no) = 1"""
SQL_TABLES["obs"] = OBS_SQL


@query(
    "asof_observation",
    f"SELECT p.point_id, o.reading_id, o.t_us, {rd('abs(p.query_us - o.t_us) / 3600000000.0', 2)} AS age_hours, {rd('abs(p.query_us - o.t_us) / 3600000000.0', 2)} > 6 AS stale FROM points p LEFT JOIN obs o USING (point_id)",
)
def asof_observation(t: Tables):
    """Reading nearest in time at the point's nearest station, with its age."""
    near = op.nearest_site(t.points, t.stations, op.STATION_PICK).withColumn("station_key", F.col("nearest.station_key"))
    hit = asof(near, features(t), "station_key", "query_ts", "ts", ["reading_id", "copy_no"])
    age = rounded(F.abs(F.col("query_us") - F.col("obs._t")) / 3.6e9, 2)
    return hit.select("point_id", "obs.reading_id", F.col("obs._t").alias("t_us"), age.alias("age_hours"), (age > 6).alias("stale"))


@query(
    "asof_backward",
    """SELECT p.point_id, max(epoch_us(f.ts)) AS t_us FROM points p JOIN near n USING (point_id)
    LEFT JOIN tele_feat f ON f.station_key = n.station_key AND epoch_us(f.ts) <= p.query_us GROUP BY p.point_id""",
)
def asof_backward(t: Tables):
    """Last reading at or before the query time: no later reading is looked at."""
    near = op.nearest_site(t.points, t.stations, op.STATION_PICK).withColumn("station_key", F.col("nearest.station_key"))
    hit = asof(near, features(t), "station_key", "query_ts", "ts", ["reading_id", "copy_no"], direction="backward")
    return hit.select("point_id", F.col("obs._t").alias("t_us"))


def _far(x: str) -> str:
    return f"CASE WHEN n.km <= 50 THEN {x} END"


SQL_TABLES["resolved"] = f"""SELECT *, CASE WHEN km > 50 THEN 'NO_RELIABLE_LOCAL_STATION' WHEN reading_id IS NULL THEN 'MISSING' WHEN age_hours > 6 THEN 'STALE'
    WHEN rq = 'MISSING' OR (rainfall_1h IS NULL AND rainfall_24h IS NULL AND rainfall_3d IS NULL AND rainfall_7d IS NULL) THEN 'MISSING' ELSE 'OK' END AS status,
    CASE WHEN km > 50 THEN 'NO_RELIABLE_STATION' WHEN reading_id IS NULL THEN 'MISSING' WHEN age_hours > 6 THEN 'STALE'
    WHEN rq = 'MISSING' OR (rainfall_1h IS NULL AND rainfall_24h IS NULL AND rainfall_3d IS NULL AND rainfall_7d IS NULL) THEN 'MISSING'
    WHEN coverage_24h < 0.75 OR thin OR rq IN ('HIGH_REVIEW', 'EXTREME_REVIEW') THEN 'PARTIAL' ELSE 'GOOD' END AS quality
    FROM (SELECT p.point_id, n.station_key, n.station, n.km, n.state AS station_state, n.district AS station_district, {rd('n.km', 2)} AS distance_km, o.reading_id,
      {_far('o.t_us')} AS obs_us, {_far(rd('abs(p.query_us - o.t_us) / 3600000000.0', 2))} AS age_hours,
      {', '.join(_far(rd(f'o.rainfall_{w}', 2)) + f' AS rainfall_{w}' for w in hazard.WINDOWS)}, {_far(rd('o.coverage_24h', 2))} AS coverage_24h,
      o.missing_24h AS thin, o.rainfall_quality AS rq, CASE WHEN n.km > 50 THEN 'NO_LOCAL_DATA' ELSE 'CWC' END AS source
      FROM points p JOIN near n USING (point_id) LEFT JOIN obs o USING (point_id))"""
RESOLVED = ["point_id", "station", "distance_km", "obs_us", "age_hours", *op.RAIN, "coverage_24h", "status", "quality", "source"]


def observed(t: Tables):
    return op.resolve_observation(t.points, t.stations, features(t))


@query("observation_resolution", f"SELECT {', '.join(RESOLVED)} FROM resolved")
def observation_resolution(t: Tables):
    return observed(t).select(*RESOLVED)


FEED = [
    "point_id", "query_us - (point_id % 9) * 900000000 AS feed_us", "(point_id * 11 % 300) / 10e0 AS rainfall_1h",
    "(point_id * 13 % 900) / 10e0 AS rainfall_24h", "(point_id * 17 % 1500) / 10e0 AS rainfall_3d", "(point_id * 19 % 2500) / 10e0 AS rainfall_7d",
]
SQL_TABLES["feed"] = f"SELECT {', '.join(FEED)} FROM points WHERE nation_no < 13"


@query(
    "source_priority_resolution",
    f"""SELECT point_id, source, CASE source WHEN 'NO_LOCAL_DATA' THEN 'NO_RELIABLE_LOCAL_STATION' ELSE 'OK' END AS status,
    CASE source WHEN 'CWC' THEN quality WHEN 'POINT_FEED' THEN 'REALTIME_API' WHEN 'DISTRICT_DAILY' THEN 'DISTRICT_FALLBACK' ELSE 'NO_RELIABLE_STATION' END AS quality,
    {', '.join(f"CASE source WHEN 'CWC' THEN r_{w} WHEN 'POINT_FEED' THEN f_{w}" + (" WHEN 'DISTRICT_DAILY' THEN " + rd('daily_actual', 2) if w == '24h' else '') + f" END AS rainfall_{w}" for w in hazard.WINDOWS)},
    source IN ('DISTRICT_DAILY', 'NO_LOCAL_DATA') AS fallback_engaged
    FROM (SELECT r.point_id, r.quality, {', '.join(f'r.rainfall_{w} AS r_{w}, f.rainfall_{w} AS f_{w}' for w in hazard.WINDOWS)}, d.daily_actual,
      CASE WHEN r.status = 'OK' THEN 'CWC' WHEN abs(p.query_us - f.feed_us) / 3600000000.0 <= 1 THEN 'POINT_FEED' WHEN d.daily_actual IS NOT NULL THEN 'DISTRICT_DAILY' ELSE 'NO_LOCAL_DATA' END AS source
      FROM resolved r JOIN points p USING (point_id) LEFT JOIN feed f USING (point_id)
      LEFT JOIN district_day d ON d.state = r.station_state AND d.district = r.station_district AND d.day = CAST(floor(p.query_us / 86400000000.0) AS BIGINT))""",
)
def source_priority_resolution(t: Tables):
    """Station, else fresh point feed, else district total, else nothing."""
    feed = t.points.filter("nation_no < 13").selectExpr(*FEED)
    return op.source_priority(observed(t), feed, t.district_day).select(
        "point_id", "source", "status", "quality", *op.RAIN, "fallback_engaged"
    )


SQL_TABLES["assess_in"] = f"""SELECT l.*, r.station, r.distance_km, {', '.join('r.' + c for c in op.RAIN)}, r.status, r.quality, r.source, i.inside_state
    FROM labelled l JOIN resolved r USING (point_id) LEFT JOIN ({INSIDE_SQL}) i USING (point_id)"""
SQL_TABLES["assessed"] = sql_fuse(sql_trigger(sql_human(sql_soil(sql_micro("SELECT * FROM assess_in")))))
DYNAMIC_SQL = """concat_ws('; ', """ + REASON_SQL + """, CASE WHEN cloudburst THEN 'DWR_CLOUDBURST_DETECTED' WHEN orographic_factor >= 1.15 THEN 'OROGRAPHIC_PRECIPITATION_AMPLIFICATION' END,
    CASE WHEN pore_pressure_kpa > 1 THEN 'DYNAMIC_PORE_PRESSURE_ACCUMULATION' END, CASE WHEN factor_of_safety <= 1.2 THEN 'LIMIT_EQUILIBRIUM_SLOPE_INSTABILITY' END)"""
ASSESSED = [
    "point_id", "static_score", "tier", "station", "distance_km", "quality", "rainfall_24h", "orographic_factor", "regime", "saturation_ratio",
    "factor_of_safety", "modified_fos", "stability_verdict", "trigger_level", "trigger_score", "risk_level", "fusion_score", "scoring_mode",
]


def assessed(t: Tables):
    placed = state_of_point(observed(t), t.vertices).withColumnRenamed("inside_state", "domain_state")
    return op.assess(placed).withColumn("in_domain", F.col("domain_state").isNotNull())


@query("assessment", f"SELECT {', '.join(ASSESSED)}, inside_state AS domain_state, {DYNAMIC_SQL} AS profile_codes, reason_text AS risk_codes FROM assessed")
def assessment(t: Tables):
    """Profile, rainfall, micro-climate, soil, human factors, trigger and fusion for every point."""
    return assessed(t).select(
        *ASSESSED, "domain_state", hazard.codes(F.col("reason_codes")).alias("profile_codes"), hazard.codes(F.col("reasons")).alias("risk_codes")
    )


@query(
    "flatten_assessment",
    f"""SELECT point_id, latitude, longitude, coalesce(inside_state, 'OUTSIDE_NER') AS state, CASE WHEN ok THEN static_score END AS susceptibility_score,
    CASE WHEN ok THEN tier ELSE 'OUTSIDE_DOMAIN' END AS susceptibility_category, CASE WHEN ok THEN source END AS rainfall_source,
    CASE WHEN ok THEN station END AS rainfall_station, CASE WHEN ok THEN distance_km END AS rainfall_distance_km,
    {', '.join(f'CASE WHEN ok THEN {c} END AS {c}' for c in op.RAIN)}, CASE WHEN ok THEN quality ELSE 'OUTSIDE_DOMAIN' END AS rainfall_quality,
    CASE WHEN ok THEN trigger_level ELSE 'NO_DATA' END AS rainfall_trigger_level, CASE WHEN ok THEN trigger_codes ELSE 'OUTSIDE_DOMAIN' END AS rainfall_trigger_reasons,
    CASE WHEN ok THEN risk_level ELSE 'UNKNOWN' END AS risk_level, CASE WHEN ok THEN fusion_score END AS operational_fusion_score,
    CASE WHEN ok THEN reason_text ELSE 'Location outside domain' END AS risk_reasons FROM (SELECT *, inside_state IS NOT NULL AS ok FROM assessed)""",
)
def flatten_assessment(t: Tables):
    """Nested assessment records to flat rows, with defaults outside the domain."""
    return op.flatten(op.nested(assessed(t)))


# The minimal chain: latest reading per station, a score from the station number, fused and ordered.
def board(t: Tables):
    last = telemetry.latest_per_station(features(t))
    score = F.split("station_key", "::")[1].cast("double") / 10.0 + 0.05
    nothing = F.coalesce(*op.RAIN).isNull()
    quality = (
        F.when((F.col("rainfall_quality") == "MISSING") | nothing, "MISSING")
        .when(F.col("missing_24h") | F.col("rainfall_quality").isin("HIGH_REVIEW", "EXTREME_REVIEW"), "PARTIAL").otherwise("GOOD")
    )
    df = last.withColumns({
        "static_score": score, "quality": quality,
        "status": F.when(quality == "MISSING", "MISSING").otherwise("OK"),
    }).withColumn("tier", hazard.susceptibility_tier(F.col("static_score")))
    return hazard.fuse(hazard.rain_trigger(df))


SQL_TABLES["board"] = sql_fuse(sql_trigger("""SELECT *, CASE WHEN quality = 'MISSING' THEN 'MISSING' ELSE 'OK' END AS status,
    CASE WHEN static_score >= 0.75 THEN 'VERY_HIGH' WHEN static_score >= 0.5 THEN 'HIGH' WHEN static_score >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM
    (SELECT *, CAST(split_part(station_key, '::', 2) AS DOUBLE) / 10.0 + 0.05 AS static_score,
    CASE WHEN rainfall_quality = 'MISSING' OR coalesce(rainfall_1h, rainfall_24h, rainfall_3d, rainfall_7d) IS NULL THEN 'MISSING'
    WHEN missing_24h OR rainfall_quality IN ('HIGH_REVIEW', 'EXTREME_REVIEW') THEN 'PARTIAL' ELSE 'GOOD' END AS quality FROM tele_feat
    QUALIFY row_number() OVER (PARTITION BY station_key ORDER BY ts DESC, reading_id DESC, copy_no DESC) = 1)"""))
BOARD = ["station_key", "station", "static_score", "tier", "rainfall_24h", "quality", "trigger_level", "trigger_score", "risk_level", "fusion_score"]


@query("risk_board", f"SELECT {', '.join(BOARD)} FROM board ORDER BY fusion_score DESC, station_key LIMIT 20")
def risk_board(t: Tables):
    """The 20 most urgent stations by ordering score."""
    return op.risk_board(board(t), 20, "station_key").select(*BOARD)


FACTORS = [0.5, 0.75, 1.0, 1.25, 1.5]
SWEEP_IN = f"""SELECT event_no, least(grid_rainfall_mm / {dbl('10')}, {dbl('45')}) AS rainfall_1h, grid_rainfall_mm AS rainfall_24h, grid_rainfall_mm * {dbl('1.5')} AS rainfall_3d,
    grid_rainfall_mm * 2 AS rainfall_7d, 'GOOD' AS quality, 'OK' AS status, (event_no % 100) / {dbl('100')} AS static_score FROM inventory"""
_TIERED = f"SELECT *, CASE WHEN static_score >= 0.75 THEN 'VERY_HIGH' WHEN static_score >= 0.5 THEN 'HIGH' WHEN static_score >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM ({SWEEP_IN})"


@query(
    "threshold_sweep",
    f"""SELECT set_id, trigger_level, risk_level, count(*) AS n FROM (
    {sql_fuse(sql_trigger(f"SELECT * FROM ({_TIERED}), (VALUES ('x0.5', 0.5), ('x0.75', 0.75), ('x1', 1.0), ('x1.25', 1.25), ('x1.5', 1.5)) f(set_id, fac)", 'CAST(fac AS DOUBLE)'))}) GROUP BY ALL""",
)
def threshold_sweep(t: Tables):
    """Trigger and risk counts of all events under five threshold sets."""
    ev = t.inventory.select(
        "event_no", F.least(F.col("grid_rainfall_mm") / 10.0, F.lit(45.0)).alias("rainfall_1h"),
        F.col("grid_rainfall_mm").alias("rainfall_24h"), (F.col("grid_rainfall_mm") * 1.5).alias("rainfall_3d"),
        (F.col("grid_rainfall_mm") * 2).alias("rainfall_7d"), F.lit("GOOD").alias("quality"), F.lit("OK").alias("status"),
        ((F.col("event_no") % 100) / 100.0).alias("static_score"),
    ).withColumn("tier", hazard.susceptibility_tier(F.col("static_score")))
    return op.threshold_sweep(ev, FACTORS)

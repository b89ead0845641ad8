"""Soil moisture, slope stability and human changes of a slope, as columns.

Every function takes a table with the documented columns and adds its results, one select per
dependent step, so the whole chain stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.functions.columns import clamp, rounded

WATER_KN = 9.81
SOIL_DEPTH_M = 1.2
SOIL_UNIT_KN = 18.5
TOE_POSITIONS = ("Foot-Slope / Toe Cut", "Valley Bottom / Deep Hollow")


def _or(c: str, default: float) -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def soil_hydrology(df: DataFrame, depth: float = SOIL_DEPTH_M) -> DataFrame:
    """Porosity, conductivity and saturation ratio.

    Needs clay_percent, sand_percent, bulk_density_kg_dm3, rainfall_24h/3d/7d and
    topographic_wetness_index. NULL inputs take the documented defaults; a longer rain window is
    never below a shorter one.
    """
    clay, sand = _or("clay_percent", 25.0), _or("sand_percent", 40.0)
    r24 = F.greatest(F.lit(0.0), _or("rainfall_24h", 0.0))
    r3d = F.greatest(r24, F.coalesce("rainfall_3d", r24))
    r7d = F.greatest(r3d, F.coalesce("rainfall_7d", r3d))
    wet = clamp(1.0 + (_or("topographic_wetness_index", 4.0) - 4.0) * 0.10, 0.8, 1.8)
    recharge = (r24 * 0.90 + (r3d - r24) * 0.40 + (r7d - r3d) * 0.15) * wet
    return df.withColumns({
        "porosity": clamp(1.0 - _or("bulk_density_kg_dm3", 1.30) / 2.65, 0.25, 0.70),
        "ksat_mm_hr": rounded(clamp(10.0 * F.exp(0.03 * sand - 0.04 * clay), 0.5, 120.0), 2),
        "recharge_mm": recharge,
    }).withColumn(
        "saturation_ratio",
        rounded(
            clamp(0.28 + clay / 100.0 * 0.15 + F.col("recharge_mm") / (depth * F.col("porosity") * 1000.0), 0.15, 1.0), 3
        ),
    )


def pore_pressure(df: DataFrame, depth: float = SOIL_DEPTH_M) -> DataFrame:
    """Pore pressure, strength and the infinite-slope factor of safety, after soil_hydrology."""
    clay, sand = _or("clay_percent", 25.0), _or("sand_percent", 40.0)
    beta = F.radians(clamp(_or("slope_deg", 15.0), 0.1, 89.0))
    weight = _or("bulk_density_kg_dm3", 1.30) * WATER_KN + F.col("porosity") * WATER_KN
    water = (F.col("saturation_ratio") - 0.65) / 0.35 * WATER_KN * depth * F.cos(beta) * F.cos(beta)
    df = df.withColumns({
        "pore_pressure_kpa": F.when(F.col("saturation_ratio") > 0.65, rounded(water, 2)).otherwise(F.lit(0.0)),
        "cohesion_kpa": rounded(clamp(5.0 + 0.35 * clay, 2.0, 35.0), 1),
        "friction_deg": rounded(clamp(24.0 + 0.22 * sand - 0.12 * clay, 18.0, 42.0), 1),
        "_beta": beta, "_weight": weight,
    })
    beta, weight = F.col("_beta"), F.col("_weight")
    normal = F.greatest(F.lit(0.0), weight * depth * F.cos(beta) * F.cos(beta) - F.col("pore_pressure_kpa"))
    resist = F.col("cohesion_kpa") + normal * F.tan(F.radians("friction_deg"))
    drive = F.greatest(F.lit(0.5), weight * depth * F.sin(beta) * F.cos(beta))
    return df.withColumn("factor_of_safety", rounded(clamp(resist / drive, 0.20, 5.0), 2)).drop("_beta", "_weight")


def stability_states(df: DataFrame) -> DataFrame:
    """Classes and synthetic radar response, after pore_pressure."""
    s, fos = F.col("saturation_ratio"), F.col("factor_of_safety")
    moisture = s * F.col("porosity")

    def by_saturation(critical: str, high: str, moderate: str, dry: str) -> Column:
        return F.when(s >= 0.85, critical).when(s >= 0.65, high).when(s >= 0.40, moderate).otherwise(dry)

    return df.withColumns({
        "saturation_state": by_saturation("CRITICAL_SATURATION", "HIGH_PORE_PRESSURE", "MODERATE_MOISTURE", "DRY_STABLE"),
        "liquefaction_risk": by_saturation("HIGH", "ELEVATED", "LOW", "MINIMAL"),
        "stability_status": F.when(fos <= 1.00, "ACTIVE_FAILURE_IMMINENT")
        .when(fos <= 1.30, "MARGINALLY_STABLE_WATCH").otherwise("GEOTECHNICALLY_STABLE"),
        "dielectric_constant": rounded(3.5 + 32.0 * moisture + 15.0 * moisture * moisture, 1),
        "backscatter_db": rounded(-18.0 + 11.5 * s, 1),
    })


def soil_state(df: DataFrame) -> DataFrame:
    return stability_states(pore_pressure(soil_hydrology(df)))


def slope_modification(df: DataFrame, depth: float = SOIL_DEPTH_M) -> DataFrame:
    """Effect of cuts, drains, clearing and walls.

    Needs slope_deg, landcover_class, slope_position, cut_slope_deg, the five flags, and
    cohesion_kpa, friction_deg, pore_pressure_kpa.
    """
    natural = _or("slope_deg", 20.0)

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    cut = flag("road_cut_present") | flag("unsupported_excavation")
    blocked, bare, wall = flag("drainage_blocked"), flag("deforestation_observed"), flag("has_retaining_wall")
    cover = F.lower(F.coalesce("landcover_class", F.lit("")))
    roots = (
        F.when(bare, 0.0).when(cover.contains("tree") | cover.contains("forest"), 10.0).when(cover.contains("shrub"), 4.0)
        .when(cover.contains("grass"), 2.0).when(cover.contains("cropland"), 1.0).otherwise(0.0)
    )
    steep = F.when(
        cut, F.when(F.col("cut_slope_deg") > 0, F.col("cut_slope_deg")).otherwise(F.least(F.lit(75.0), natural + 25.0))
    ).otherwise(natural)
    df = df.withColumns({
        "is_cut": cut, "effective_slope_deg": steep, "root_cohesion_kpa": roots,
        "surcharge_kpa": F.when(blocked, 3.5).otherwise(0.0),
    })
    steep = F.col("effective_slope_deg")
    toe = F.coalesce(F.col("slope_position").isin(*TOE_POSITIONS), F.lit(False)) & (natural >= 20.0)
    severity = (
        F.when(cut & (steep >= 60.0), "SEVERE").when(cut, "MODERATE").when(toe, "POTENTIAL_TOE_EXPOSURE").otherwise("NONE")
    )
    multiplier = (
        1.0
        + F.when(cut & (steep >= 60.0), 0.45).when(cut, 0.25).otherwise(0.0)
        + F.when(blocked, 0.30).otherwise(0.0) + F.when(bare, 0.20).otherwise(0.0) - F.when(wall, 0.35).otherwise(0.0)
    )
    beta = F.radians(steep)
    stress = SOIL_UNIT_KN * depth * F.cos(beta) * F.cos(beta)
    normal = F.greatest(F.lit(0.0), stress - (_or("pore_pressure_kpa", 0.0) + F.col("surcharge_kpa")))
    resist = (
        _or("cohesion_kpa", 12.0) + F.col("root_cohesion_kpa")
        + normal * F.tan(F.radians(_or("friction_deg", 30.0))) + F.when(wall, 12.0).otherwise(0.0)
    )
    drive = F.greatest(F.lit(0.5), SOIL_UNIT_KN * depth * F.sin(beta) * F.cos(beta))
    df = df.withColumns({
        "cut_severity": severity,
        "hazard_multiplier": rounded(clamp(multiplier, 0.70, 2.50), 2),
        "modified_fos": rounded(clamp(resist / drive, 0.15, 5.0), 2),
        "wall_status": F.when(wall, "ENGINEERED_RETAINING_WALL").when(cut, "UNSUPPORTED_EXCAVATION").otherwise("NATURAL_SLOPE"),
        "drainage_condition": F.when(blocked, "BLOCKED_CONCENTRATED_RUNOFF").otherwise("NORMAL_SURFACE_DRAINAGE"),
    })
    fos = F.col("modified_fos")
    advice = F.array_compact(F.array(
        F.when(cut & ~wall, "BUILD_RETAINING_WALL"), F.when(blocked, "CLEAR_DRAINAGE"),
        F.when(bare | (F.col("root_cohesion_kpa") < 3.0), "PLANT_DEEP_ROOTS"), F.when(fos <= 1.0, "RESTRICT_AND_EVACUATE"),
    ))
    return df.withColumns({
        "stability_verdict": F.when(fos <= 1.0, "CRITICAL_INSTABILITY").when(fos <= 1.30, "MARGINAL_EQUILIBRIUM").otherwise("STABLE"),
        "recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("ROUTINE_INSPECTION"))),
    })

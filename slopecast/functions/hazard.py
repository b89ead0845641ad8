"""Local rain amplification, rain trigger, susceptibility and fusion, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import clamp, literal_map, rounded

WIND_DEG = 200.0
WINDOWS = ("1h", "24h", "3d", "7d")
TIERS = ("LOW", "MODERATE", "HIGH", "VERY_HIGH")


def orographic_rain(df: DataFrame) -> DataFrame:
    """Windward and leeward factor, regime and the locally effective rain.

    Needs rainfall_1h, rainfall_24h, slope_deg, aspect_deg and elevation_m; only NULL takes a
    default (an aspect of exactly 0 stays north).
    """
    r1 = F.greatest(F.lit(0.0), F.coalesce("rainfall_1h", F.lit(0.0)))
    r24 = F.greatest(r1, F.coalesce("rainfall_24h", F.lit(0.0)))
    slope = clamp(F.coalesce("slope_deg", F.lit(15.0)), 0.0, 89.0)
    facing = F.cos(F.radians(F.coalesce("aspect_deg", F.lit(180.0)) - WIND_DEG))
    lift = F.least(F.lit(1.5), F.greatest(F.lit(0.0), F.coalesce("elevation_m", F.lit(500.0))) / 1200.0)
    windward, leeward = (facing > 0.3) & (slope > 12.0), (facing < -0.3) & (slope > 15.0)
    factor = (
        F.when(windward, 1.0 + facing * F.sin(F.radians(slope)) * lift * 0.45)
        .when(leeward, F.greatest(F.lit(0.82), 1.0 - F.abs(facing) * 0.18))
        .otherwise(1.0)
    )
    return df.withColumns({
        "orographic_factor": rounded(clamp(factor, 0.80, 1.45), 2),
        "regime": F.when(windward, "OROGRAPHIC_WINDWARD_AMPLIFIED").when(leeward, "OROGRAPHIC_LEEWARD_SHADOW").otherwise("NORMAL_CONVECTIVE"),
        "_r1": r1, "_r24": r24,
    }).withColumns({
        "micro_1h": rounded(F.col("_r1") * F.col("orographic_factor"), 2),
        "micro_24h": rounded(F.col("_r24") * F.col("orographic_factor"), 2),
    }).drop("_r1", "_r24")


def cloudburst(df: DataFrame) -> DataFrame:
    """Reflectivity, cloudburst, intensity-duration breach and peak runoff, after orographic_rain."""
    rate = F.greatest(F.lit(0.1), F.col("micro_1h"))
    dbz = rounded(clamp(10.0 * F.log10(200.0 * F.pow(rate, F.lit(1.6))), 10.0, 65.0), 1)
    area = F.greatest(F.lit(1.0), 5.0 * (1.0 - F.least(F.lit(1.0), F.coalesce("plan_curvature", F.lit(0.0)) * 0.2)))
    return df.withColumn("reflectivity_dbz", dbz).withColumns({
        "cloudburst": (F.col("micro_1h") >= 40.0) | (F.col("reflectivity_dbz") >= 48.0),
        "idf_breached": (F.col("micro_1h") >= 14.82) | (F.col("micro_24h") >= 103.0),
        "peak_runoff_m3s": rounded(0.70 * F.col("micro_1h") * area / 360.0, 3),
    }).withColumn("regime", F.when(F.col("cloudburst"), "CLOUDBURST_TORRENT").otherwise(F.col("regime")))


def literal_thresholds() -> dict[str, tuple[Column, Column]]:
    return {w: (F.lit(a), F.lit(b)) for w, (a, b) in fixed.RAIN_THRESHOLDS.items()}


def reason(code: Column | str, text: Column | str) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(code.alias("code"), text.alias("description"))


def rain_trigger(df: DataFrame, thresholds: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Trigger level, score, reasons and breached windows.

    Needs rainfall_1h, rainfall_24h, rainfall_3d, rainfall_7d, quality and status. A stale
    reading still counts and is only tagged; an unobserved place gives NO_DATA and no score.
    """
    thresholds = thresholds or literal_thresholds()
    quality = F.coalesce("quality", F.lit("MISSING"))
    unobserved = quality.isin("NO_RELIABLE_STATION", "MISSING") | F.coalesce(
        F.col("status") == "NO_RELIABLE_LOCAL_STATION", F.lit(False)
    )
    high, watch, ratios, reasons, breached = [], [], [], [], []
    for w in WINDOWS:
        value, (low, top) = F.col(f"rainfall_{w}"), thresholds[w]
        seen = value.isNotNull() & (value >= 0)
        is_high, is_watch = seen & (value >= top), seen & (value >= low) & (value < top)
        label = w.upper()
        high.append(is_high)
        watch.append(is_watch)
        ratios.append(F.when(seen, value / top))
        amount = F.format_string("%s rainfall %.1f mm", F.lit(label), value)
        reasons.append(
            F.when(is_high, reason(f"RAINFALL_{label}_HIGH_THRESHOLD", F.concat(amount, F.lit(" reached the high threshold"))))
            .when(is_watch, reason(f"RAINFALL_{label}_WATCH_THRESHOLD", F.concat(amount, F.lit(" reached the watch threshold"))))
        )
        breached.append(F.when(is_high, f"{label}:HIGH").when(is_watch, f"{label}:WATCH"))
    any_high = high[0] | high[1] | high[2] | high[3]
    any_watch = watch[0] | watch[1] | watch[2] | watch[3]
    df = df.withColumns({
        "trigger_level": F.when(unobserved, "NO_DATA").when(any_high, "HIGH").when(any_watch, "WATCH").otherwise("NORMAL"),
        "_ratio": F.greatest(*ratios),
    })
    ratio, level = F.col("_ratio"), F.col("trigger_level")
    score = (
        F.when(level == "NO_DATA", F.lit(None).cast("double"))
        .when(ratio.isNull(), F.lit(0.0))
        .when(level == "HIGH", rounded(F.least(F.lit(1.0), 0.70 + F.least(F.lit(0.30), (ratio - 1.0) * 0.15))))
        .when(level == "WATCH", rounded(0.40 + F.least(F.lit(0.29), (ratio - 0.5) * 0.58)))
        .otherwise(rounded(F.least(F.lit(0.39), ratio * 0.78)))
    )
    tags = [
        F.when(quality == "STALE", reason("RAINFALL_DATA_STALE", "Observation is older than the freshness limit")),
        F.when(quality == "PARTIAL", reason("RAINFALL_DATA_PARTIAL", "Window coverage below 75 % or under review")),
    ]
    no_data = F.array(
        F.when(quality == "NO_RELIABLE_STATION", reason("RAINFALL_NO_RELIABLE_STATION", "No reliable station within reach"))
        .otherwise(reason("RAINFALL_DATA_MISSING", "Rainfall missing or unrecorded"))
    )
    return df.withColumns({
        "trigger_score": score,
        "trigger_reasons": F.when(level == "NO_DATA", no_data).otherwise(F.array_compact(F.array(*reasons, *tags))),
        "breached_windows": F.when(level == "NO_DATA", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*breached))),
        "is_stale": (level != "NO_DATA") & (quality == "STALE"),
    }).drop("_ratio")


def susceptibility_tier(score: Column) -> Column:
    return F.when(score >= 0.75, "VERY_HIGH").when(score >= 0.50, "HIGH").when(score >= 0.25, "MODERATE").otherwise("LOW")


def risk_level(tier: Column, level: Column) -> Column:
    """Matrix lookup; pairs the matrix does not know give WATCH."""
    matrix = literal_map({f"{a}|{b}": r for a, row in fixed.RISK_MATRIX.items() for b, r in row.items()})
    return F.coalesce(F.try_element_at(matrix, F.concat_ws("|", tier, level)), F.lit("WATCH"))


def fuse(df: DataFrame) -> DataFrame:
    """Risk level, ordering score, mode, action and reasons, after rain_trigger.

    Needs static_score and tier. The score orders places; it is not a probability.
    """
    tier, level, trig = F.upper("tier"), F.col("trigger_level"), F.col("trigger_score")
    both = rounded(clamp(0.5 * F.col("static_score") + 0.5 * trig, 0.0, 1.0))
    unseen = F.when(
        (level == "NO_DATA") & tier.isin("HIGH", "VERY_HIGH"),
        reason(F.concat(F.lit("STATIC_"), tier, F.lit("_SUSCEPTIBILITY_RAINFALL_UNOBSERVED")), "Static tier stands although rain is unobserved"),
    )
    own = F.array_compact(F.array(
        reason(F.concat(F.lit("STATIC_"), tier, F.lit("_SUSCEPTIBILITY")), F.concat(tier, F.lit(" static susceptibility"))),
        F.when(level != "NO_DATA", reason(F.concat(F.lit("RAINFALL_"), level, F.lit("_TRIGGER")), F.concat(level, F.lit(" rainfall trigger")))),
        unseen,
    ))
    actions = literal_map(fixed.RISK_ACTIONS)
    return df.withColumns({
        "risk_level": risk_level(tier, level),
        "fusion_score": F.when(trig.isNotNull(), both).otherwise(rounded(F.col("static_score"))),
        "scoring_mode": F.when(trig.isNotNull(), "DUAL_LAYER_WEIGHTED_SYNTHESIS").otherwise("STATIC_BASELINE_ONLY_RAINFALL_UNOBSERVED"),
        "reasons": F.concat(own, F.col("trigger_reasons")),
    }).withColumn("action", F.try_element_at(actions, F.col("risk_level")))


COMPLETENESS = (
    "elevation_m", "slope_deg", "aspect_deg", "relief_std_5x5_m", "clay_percent",
    "sand_percent", "silt_percent", "bulk_density_kg_dm3", "soil_class", "landcover_class",
)


def feature_completeness(df: DataFrame) -> DataFrame:
    """Names of missing model inputs and the quality class that follows."""
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in COMPLETENESS]))
    return df.withColumn("missing_features", gone).withColumn(
        "quality_status",
        F.when(F.size("missing_features") == 0, "OK").when(F.size("missing_features") <= 4, "PARTIAL").otherwise("INVALID"),
    )


def static_reasons(df: DataFrame) -> DataFrame:
    """Reason codes of the static profile; a profile without any takes the baseline code."""
    hollow = F.col("curvature_class").contains("Concave-Convergent")
    rules = [
        (F.col("slope_deg") >= 25.0, "TERRAIN_STEEP_SLOPE", "Steep slope"),
        (F.col("relief_std_5x5_m") >= 25.0, "HIGH_LOCAL_RELIEF", "Rough local relief"),
        (F.col("aspect_deg").between(90.0, 270.0), "SOUTH_FACING_ASPECT_SIGNAL", "Faces the moist side"),
        (F.col("elevation_m") >= 1500.0, "HIGH_ELEVATION_SIGNAL", "Montane elevation"),
        (F.col("landcover_class").isin("Bare / sparse vegetation", "Grassland"), "LOW_CANOPY_VEGETATION_SIGNAL", "Weak root cohesion"),
        (F.col("clay_percent") >= 30.0, "FINE_SOIL_TEXTURE_SIGNAL", "Fine soil texture"),
        (hollow, "MICRO_CONVERGENT_HOLLOW", "Convergent hollow"),
        (~hollow & F.col("curvature_class").contains("Convergent"), "MICRO_CONVERGENT_CHANNEL", "Convergent channel"),
        (F.col("slope_position").isin("Foot-Slope / Toe Cut", "Valley Bottom / Deep Hollow"), "VILLAGE_TOE_SLOPE_ZONE", "Toe of a slope"),
        (F.col("topographic_wetness_index") >= 5.5, "HIGH_TOPOGRAPHIC_WETNESS", "High wetness index"),
        (F.col("saturation_state").isin("CRITICAL_SATURATION", "HIGH_PORE_PRESSURE"), "SOIL_SATURATION_WARNING", "Soil close to saturation"),
        (F.col("factor_of_safety") <= 1.30, "LIMIT_EQUILIBRIUM_SLOPE_WARNING", "Low factor of safety"),
    ]
    fired = F.array_compact(F.array(*[F.when(c, reason(code, text)) for c, code, text in rules]))
    base = F.array(reason("MODERATE_BASELINE_SIGNAL", "No single strong signal"))
    return df.withColumn("reason_codes", F.when(F.size(fired) > 0, fired).otherwise(base))


def codes(reasons: Column) -> Column:
    """The codes of a reason list in one text."""
    return F.array_join(F.transform(reasons, lambda r: r["code"]), "; ")


def factor_rules() -> list[tuple[str, str, Column]]:
    """(code, feature, condition) of the contributing-factor rules."""
    r24, r3d, r7d = F.col("rainfall_24h"), F.col("rainfall_3d"), F.col("rainfall_7d")
    slope, soil = F.col("slope"), F.col("soil_risk")
    return [
        ("very_high_rainfall_24h", "rainfall_24h", r24 >= 100.0),
        ("high_rainfall_24h", "rainfall_24h", (r24 >= 50.0) & (r24 < 100.0)),
        ("very_high_rainfall_7d", "rainfall_7d", r7d >= 500.0),
        ("high_rainfall_7d", "rainfall_7d", (r7d >= 250.0) & (r7d < 500.0)),
        ("high_rainfall_3d", "rainfall_3d", r3d >= 200.0),
        ("steep_slope", "slope", slope >= 30.0),
        ("moderate_slope", "slope", (slope >= 20.0) & (slope < 30.0)),
        ("historical_landslide_present", "historical_landslide", F.col("historical_landslide") == 1),
        ("near_historical_landslide", "distance_to_landslide", F.col("distance_to_landslide") <= 2.0),
        ("high_soil_risk", "soil_risk", soil >= 0.6),
        ("moderate_soil_risk", "soil_risk", (soil >= 0.4) & (soil < 0.6)),
        ("low_rainfall_stable", "rainfall_24h", (r24 < 30.0) & (r7d < 100.0)),
        ("gentle_slope_stable", "slope", slope < 15.0),
    ]


def contributing_factors(df: DataFrame, importance: dict[str, float], limit: int = 5) -> DataFrame:
    """Add factors: the fired rules by importance (descending), feature and code; at most limit."""
    fired = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(-float(importance.get(feat, 0.0))).alias("o"), F.lit(feat).alias("feature"), F.lit(code).alias("code")))
        for code, feat, cond in factor_rules()
    ]))
    return df.withColumn("factors", F.transform(F.slice(F.array_sort(fired), 1, limit), lambda x: F.struct(x["code"], x["feature"], (-x["o"]).alias("importance"))))

"""Whole-table risk assessment: observation, fallback sources, physics, trigger and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions import ground, hazard
from slopecast.functions.columns import HOUR_US, rounded
from slopecast.operators.asof import asof
from slopecast.operators.spatial import code_labels, nearest_radar, nearest_site

STATION_PICK = ["site_no", "station_key", "station", "state", "district"]
RAIN = [f"rainfall_{w}" for w in hazard.WINDOWS]
COVER = ["coverage_24h", "coverage_3d", "coverage_7d"]
OBS_PICK = ["reading_id", "copy_no", *RAIN, *COVER, "missing_24h", "rainfall_quality", "state", "district"]


def resolve_observation(
    points: DataFrame, stations: DataFrame, feat: DataFrame,
    max_km: float = fixed.MAX_STATION_KM, max_age: float = fixed.MAX_AGE_HOURS, direction: str = "nearest",
) -> DataFrame:
    """The observation that stands for each (point, query_ts), with status and quality.

    Nearest station, then its reading nearest in time. A station beyond max_km never speaks for a
    point, a reading older than max_age hours is STALE, a missing amount stays NULL.
    """
    near = nearest_site(points, stations, STATION_PICK)
    near = near.withColumns({
        "station_key": F.col("nearest.station_key"), "station": F.col("nearest.station"),
        "_km": F.col("nearest.distance"),
        "_station_state": F.col("nearest.state"), "_station_district": F.col("nearest.district"),
    }).drop("nearest")
    hit = asof(near, feat, "station_key", "query_ts", "ts", OBS_PICK, "obs", direction)
    far = F.col("_km") > max_km
    age = rounded(F.abs(F.unix_micros("query_ts") - F.col("obs._t")) / float(HOUR_US), 2)
    hit = hit.withColumns({
        "distance_km": rounded(F.col("_km"), 2),
        "obs_us": F.when(~far, F.col("obs._t")),
        "age_hours": F.when(~far, age),
        **{c: F.when(~far, rounded(F.col(f"obs.{c}"), 2)) for c in (*RAIN, *COVER)},
        "_q": F.upper("obs.rainfall_quality"),
        "state": F.when(~far, F.col("obs.state")), "district": F.when(~far, F.col("obs.district")),
    })
    no_value = F.col("rainfall_1h").isNull() & F.col("rainfall_24h").isNull() & F.col("rainfall_3d").isNull() & F.col("rainfall_7d").isNull()
    partial = (
        F.coalesce(F.col("coverage_24h") < fixed.MIN_COVERAGE, F.lit(False)) | F.coalesce("obs.missing_24h", F.lit(False))
        | F.col("_q").isin("HIGH_REVIEW", "EXTREME_REVIEW")
    )

    def verdict(far_: str, none: str, stale: str, missing: str, part: str, good: str) -> Column:
        return (
            F.when(far, far_).when(F.col("obs").isNull(), none).when(F.col("age_hours") > max_age, stale)
            .when((F.col("_q") == "MISSING") | no_value, missing).when(partial, part).otherwise(good)
        )

    return hit.withColumns({
        "status": verdict("NO_RELIABLE_LOCAL_STATION", "MISSING", "STALE", "MISSING", "OK", "OK"),
        "quality": verdict("NO_RELIABLE_STATION", "MISSING", "STALE", "MISSING", "PARTIAL", "GOOD"),
        "source": F.when(far, "NO_LOCAL_DATA").otherwise("CWC"),
    }).drop("obs", "_q", "_km")


def source_priority(
    observed: DataFrame, feed: DataFrame, district_day: DataFrame,
    max_feed_age: float = 1.0, estimate_windows: bool = False,
) -> DataFrame:
    """Replace unusable observations by the first source that has one.

    Order: usable station, fresh point feed, district daily total of the station's district,
    nothing. The feed has point_id, feed_us and the four windows. Windows the district total does
    not measure stay NULL unless estimate_windows is set, and are then tagged as estimates.
    """
    f = feed.select(
        "point_id", F.col("feed_us"), F.struct(*RAIN).alias("_feed")
    )
    d = district_day.select(
        F.col("state").alias("_station_state"), F.col("district").alias("_station_district"), F.col("day").alias("_day"),
        F.col("daily_actual").alias("_daily"),
    )
    df = observed.join(f, "point_id", "left").withColumn("_day", F.unix_date(F.to_date("query_ts")))
    df = df.join(d, ["_station_state", "_station_district", "_day"], "left")
    fresh = F.col("_feed").isNotNull() & (
        F.abs(F.unix_micros("query_ts") - F.col("feed_us")) / float(HOUR_US) <= max_feed_age
    )
    choice = (
        F.when((F.col("status") == "OK"), "CWC").when(fresh, "POINT_FEED").when(F.col("_daily").isNotNull(), "DISTRICT_DAILY")
        .otherwise("NO_LOCAL_DATA")
    )
    df = df.withColumn("_choice", choice)
    daily = F.col("_daily")
    guess = {"rainfall_1h": daily / 24.0, "rainfall_24h": daily, "rainfall_3d": daily * 2.5, "rainfall_7d": daily * 4.5}
    values = {}
    for c in RAIN:
        from_district = rounded(guess[c], 2) if estimate_windows or c == "rainfall_24h" else F.lit(None).cast("double")
        values[c] = (
            F.when(F.col("_choice") == "CWC", F.col(c)).when(F.col("_choice") == "POINT_FEED", F.col(f"_feed.{c}"))
            .when(F.col("_choice") == "DISTRICT_DAILY", from_district)
        )
    picked = F.col("_choice")
    return df.withColumns(values).withColumns({
        "source": picked,
        "status": F.when(picked == "NO_LOCAL_DATA", "NO_RELIABLE_LOCAL_STATION").otherwise("OK"),
        "quality": F.when(picked == "CWC", F.col("quality")).when(picked == "POINT_FEED", "REALTIME_API")
        .when(picked == "DISTRICT_DAILY", "DISTRICT_FALLBACK_ESTIMATED" if estimate_windows else "DISTRICT_FALLBACK")
        .otherwise("NO_RELIABLE_STATION"),
        "is_realtime": picked.isin("CWC", "POINT_FEED"),
        "fallback_engaged": picked.isin("DISTRICT_DAILY", "NO_LOCAL_DATA"),
    }).drop("_choice", "_daily", "_day", "_feed", "feed_us")


def assess(observed: DataFrame) -> DataFrame:
    """From an observation per location to the fused risk, in one plan.

    Needs the location columns, static_score, and the columns of resolve_observation.
    """
    df = code_labels(observed).withColumn("tier", hazard.susceptibility_tier(F.col("static_score")))
    df = nearest_radar(hazard.cloudburst(hazard.orographic_rain(df)))
    df = ground.slope_modification(ground.soil_state(df))
    df = hazard.static_reasons(hazard.feature_completeness(df))
    dynamic = F.array_compact(F.array(
        F.when(F.col("cloudburst"), hazard.reason("DWR_CLOUDBURST_DETECTED", "Extreme convective cell"))
        .when(F.col("orographic_factor") >= 1.15, hazard.reason("OROGRAPHIC_PRECIPITATION_AMPLIFICATION", "Windward uplift")),
        F.when(F.col("pore_pressure_kpa") > 1.0, hazard.reason("DYNAMIC_PORE_PRESSURE_ACCUMULATION", "Positive pore pressure")),
        F.when(F.col("factor_of_safety") <= 1.20, hazard.reason("LIMIT_EQUILIBRIUM_SLOPE_INSTABILITY", "Close to failure equilibrium")),
    ))
    df = df.withColumn("reason_codes", F.concat("reason_codes", dynamic))
    return hazard.fuse(hazard.rain_trigger(df))


def nested(df: DataFrame) -> DataFrame:
    """One struct per location, in the shape of an assessment record."""
    return df.select(
        "point_id",
        F.when(F.col("in_domain"), "SUCCESS").otherwise("OUTSIDE_SUPPORTED_DOMAIN").alias("status"),
        F.struct("latitude", "longitude", F.col("domain_state").alias("state")).alias("location"),
        F.when(F.col("in_domain"), F.struct(
            F.col("static_score").alias("score"), F.col("tier").alias("category"), "quality_status",
            F.struct("slope_deg", "elevation_m", "aspect_deg").alias("terrain"),
            F.struct("saturation_ratio", "pore_pressure_kpa", "factor_of_safety", "saturation_state").alias("soil"),
            F.struct("hazard_multiplier", "modified_fos", "stability_verdict", "recommendations").alias("human"),
            "reason_codes",
        )).alias("static_susceptibility"),
        F.when(F.col("in_domain"), F.struct("source", "station", "distance_km", *RAIN, "quality", "status")).alias("rainfall"),
        F.when(F.col("in_domain"), F.struct(
            "trigger_level", "trigger_score", "trigger_reasons", "breached_windows"
        )).alias("rainfall_trigger"),
        F.when(F.col("in_domain"), F.struct("risk_level", "fusion_score", "scoring_mode", "reasons", "action")).alias("risk"),
    )


def flatten(df: DataFrame) -> DataFrame:
    """Nested assessments to flat batch rows; locations outside the domain get fixed defaults."""

    def ok(c: Column, other: str | None = None) -> Column:
        good = F.col("status") == "SUCCESS"
        return F.when(good, c).otherwise(F.lit(other)) if other is not None else F.when(good, c)

    return df.select(
        "point_id", "location.latitude", "location.longitude", F.coalesce("location.state", F.lit("OUTSIDE_NER")).alias("state"),
        F.col("static_susceptibility.score").alias("susceptibility_score"),
        ok(F.col("static_susceptibility.category"), "OUTSIDE_DOMAIN").alias("susceptibility_category"),
        F.col("rainfall.source").alias("rainfall_source"), F.col("rainfall.station").alias("rainfall_station"),
        F.col("rainfall.distance_km").alias("rainfall_distance_km"), *[F.col(f"rainfall.{c}").alias(c) for c in RAIN],
        ok(F.col("rainfall.quality"), "OUTSIDE_DOMAIN").alias("rainfall_quality"),
        ok(F.col("rainfall_trigger.trigger_level"), "NO_DATA").alias("rainfall_trigger_level"),
        ok(hazard.codes(F.col("rainfall_trigger.trigger_reasons")), "OUTSIDE_DOMAIN").alias("rainfall_trigger_reasons"),
        ok(F.col("risk.risk_level"), "UNKNOWN").alias("risk_level"),
        F.col("risk.fusion_score").alias("operational_fusion_score"),
        ok(hazard.codes(F.col("risk.reasons")), "Location outside domain").alias("risk_reasons"),
    )


def risk_board(scored: DataFrame, n: int, key: str) -> DataFrame:
    """The n most urgent rows by ordering score."""
    return scored.orderBy(F.desc_nulls_last("fusion_score"), key).limit(n)


def threshold_sweep(events: DataFrame, factors: list[float]) -> DataFrame:
    """Trigger and risk counts of the events under scaled threshold sets.

    Each row meets the handful of literal sets by explode; only counts are shuffled.
    """
    sets = F.array(*[
        F.struct(F.lit(f"x{f:g}").alias("set_id"), *[
            F.lit(x * f).alias(f"{w}_{side}")
            for w, lo_hi in fixed.RAIN_THRESHOLDS.items() for side, x in zip(("watch", "high"), lo_hi)
        ])
        for f in factors
    ])
    df = events.withColumn("_s", F.explode(sets))
    limits = {w: (F.col(f"_s.{w}_watch"), F.col(f"_s.{w}_high")) for w in fixed.RAIN_THRESHOLDS}
    out = hazard.fuse(hazard.rain_trigger(df, limits))
    return out.groupBy(F.col("_s.set_id").alias("set_id"), "trigger_level", "risk_level").agg(F.count(F.lit(1)).alias("n"))

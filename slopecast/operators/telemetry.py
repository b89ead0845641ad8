"""Cleaning, windows and daily totals of rain-gauge telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import DAY_US, HOUR_US, rounded
from slopecast.functions.rainfall import finite, ingested, quality_flag, rainfall_class

STATION_TIME = ["station_key", "ts"]
SOURCE_ORDER = ["reading_id", "copy_no"]
#: Type that amounts are summed in.
AMOUNT = "decimal(38, 18)"


def usable_rows(tele: DataFrame) -> DataFrame:
    """Rows fit for feature building (see rainfall.ingested)."""
    return ingested(tele)


def collision_audit(tele: DataFrame) -> DataFrame:
    """Station and time pairs reported more than once."""
    return (
        tele.groupBy(*STATION_TIME)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .filter("row_count > 1")
    )


def collision_variation(tele: DataFrame) -> DataFrame:
    """Distinct amounts per station and time, NULL counted as an amount of its own."""
    return (
        tele.groupBy(*STATION_TIME, "rainfall_1h")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*STATION_TIME)
        .agg(F.count(F.lit(1)).alias("value_count"), F.sum("n").alias("row_count"))
        .withColumn("timestamp_collision", F.col("value_count") > 1)
    )


def dedup_measurements(tele: DataFrame) -> DataFrame:
    """Keep the first row, in source order, of every (station, time, amount).

    An aggregate instead of a ranked window: copies shrink before the shuffle.
    """
    payload = [c for c in tele.columns if c not in (*STATION_TIME, "rainfall_1h")]
    order = [*SOURCE_ORDER, *[c for c in payload if c not in SOURCE_ORDER]]
    return (
        tele.groupBy(*STATION_TIME, "rainfall_1h")
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(*STATION_TIME, "rainfall_1h", "_first.*")
        .select(*tele.columns)
    )


def trailing_rain(
    tele: DataFrame,
    expected: dict[str, float] | None = None,
    slice_days: int = 7,
) -> DataFrame:
    """Trailing 24 h, 3 d and 7 d totals per reading, with coverage and the 75 % gate.

    Windows are (t - w, t]. A reading adds its amount at t and takes it back at t + w, so all three
    totals are running sums over one sort: the work stays linear however densely a station
    reports. A station is cut into time slices, so that one busy station is not one task; amounts
    still standing at the end of a slice are carried into the next one. Amounts are summed as
    decimals of 18 places, so totals are exact and do not depend on the summing order; NaN, infinities
    and amounts of more than 10 ** 20 mm count as missing.
    """
    expected = expected or fixed.EXPECTED_HOURS
    spans = {label: hours * HOUR_US for label, hours in fixed.WINDOW_HOURS.items()}
    slice_us = slice_days * DAY_US
    if slice_us < max(spans.values()):
        raise ValueError("a slice must be at least as long as the longest window")
    df = tele.select(
        "station_key", F.unix_micros("ts").alias("_t"), finite(F.col("rainfall_1h")).try_cast(AMOUNT).alias("_v"),
        F.struct(*tele.columns).alias("_row"),
    )
    t, v = F.col("_t"), F.col("_v")
    own = F.floor(t / slice_us)
    nothing, zero = F.lit(0).cast(AMOUNT), F.lit(0).cast("bigint")

    def change(at, slice_, amounts, counts, is_row=False):
        return F.struct(
            slice_.alias("slice"), at.alias("at"), F.lit(is_row).alias("is_row"),
            *[a.alias(f"mm_{w}") for w, a in zip(spans, amounts)], *[c.alias(f"n_{w}") for w, c in zip(spans, counts)],
        )

    one = F.lit(1).cast("bigint")
    changes = [change(t, own, [F.coalesce(v, nothing)] * 3, [F.when(v.isNotNull(), one).otherwise(zero)] * 3, True)]
    for w, span in spans.items():
        changes.append(change(
            t + span, F.floor((t + span) / slice_us),
            [-v if x == w else nothing for x in spans], [-one if x == w else zero for x in spans],
        ))
    standing = [F.floor((t + span) / slice_us) > own for span in spans.values()]
    carried = F.when(standing[-1], change(
        (own + 1) * slice_us - 1, own + 1,
        [F.when(k, v).otherwise(nothing) for k in standing], [F.when(k, one).otherwise(zero) for k in standing],
    ))
    # a missing amount changes no total, so it only stands for its own row
    events = F.when(v.isNull(), F.array(changes[0])).otherwise(F.array_compact(F.array(*changes, carried)))
    flow = df.select("station_key", "_row", F.explode(events).alias("_e")).select(
        "station_key", "_e.*", F.when(F.col("_e.is_row"), F.col("_row")).alias("_row")
    )
    line = Window.partitionBy("station_key", "slice").orderBy("at")
    so_far = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {"timestamp_collision": F.count("_row").over(line.rangeBetween(Window.currentRow, Window.currentRow)) > 1}
    for w in spans:
        obs = F.sum(f"n_{w}").over(so_far)
        cols[f"rainfall_{w}_sum"] = F.when(obs > 0, rounded(F.sum(f"mm_{w}").over(so_far).cast("double")))
        cols[f"rainfall_obs_{w}"] = obs
        cols[f"coverage_{w}"] = F.least(obs / F.lit(float(expected[w])), F.lit(1.0))
    wide = flow.withColumns(cols).filter("is_row").select("_row.*", *cols)
    gates = {}
    for label in fixed.WINDOW_HOURS:
        cover = F.col(f"coverage_{label}")
        gates[f"missing_{label}"] = cover < fixed.MIN_COVERAGE
        gates[f"rainfall_{label}"] = F.when(cover >= fixed.MIN_COVERAGE, F.col(f"rainfall_{label}_sum"))
    wide = wide.withColumns(gates)
    return wide.withColumns(
        {
            "rainfall_quality": rainfall_class(F.col("rainfall_1h")),
            "quality_flag": quality_flag(
                F.col("rainfall_1h"), F.col("timestamp_collision"), F.col("missing_24h")
            ),
        }
    )


def build_features(tele: DataFrame, expected: dict[str, float] | None = None) -> DataFrame:
    """Raw telemetry to the feature table: filter, collapse repeats, windows, flags."""
    return trailing_rain(dedup_measurements(usable_rows(tele)), expected)


FEATURE_COLUMNS = [
    "station_key", "station", "state", "district", "latitude", "longitude", "ts",
    "rainfall_1h", "rainfall_24h", "rainfall_3d", "rainfall_7d",
    "rainfall_24h_sum", "rainfall_3d_sum", "rainfall_7d_sum",
    "rainfall_obs_24h", "rainfall_obs_3d", "rainfall_obs_7d",
    "coverage_24h", "coverage_3d", "coverage_7d",
    "missing_24h", "missing_3d", "missing_7d",
    "rainfall_quality", "timestamp_collision", "quality_flag", "source_file", "source_period",
]


def latest_per_station(feat: DataFrame) -> DataFrame:
    """Newest dated reading of every station; undated rows never win."""
    dated = feat.filter(F.col("ts").isNotNull())
    rest = [c for c in dated.columns if c not in ("station_key", "ts", *SOURCE_ORDER)]
    return (
        dated.groupBy("station_key")
        .agg(F.max(F.struct("ts", *SOURCE_ORDER, *rest)).alias("_last"))
        .select("station_key", "_last.*")
    )


def station_day(feat: DataFrame) -> DataFrame:
    """Per (state, station, date): totals, best windows, worst coverage, first attributes.

    A day without any amount keeps a NULL total: missing is not zero.
    """
    order = F.struct("ts", *SOURCE_ORDER)

    def first(c: str):
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)

    return (
        feat.withColumn("date", F.to_date("ts"))
        .groupBy("state", "station", "date")
        .agg(
            first("station_key"), first("district"), first("latitude"), first("longitude"),
            first("rainfall_quality"), first("quality_flag"), first("source_file"), first("source_period"),
            rounded(F.sum("rainfall_1h")).alias("rainfall_mm"),
            F.count("rainfall_1h").alias("valid_readings"),
            *[F.max(f"rainfall_{w}_sum").alias(f"rainfall_{w}_sum") for w in fixed.WINDOW_HOURS],
            *[F.max(f"rainfall_{w}").alias(f"rainfall_{w}") for w in fixed.WINDOW_HOURS],
            *[F.max(f"rainfall_obs_{w}").alias(f"rainfall_obs_{w}") for w in fixed.WINDOW_HOURS],
            *[F.min(f"coverage_{w}").alias(f"coverage_{w}") for w in fixed.WINDOW_HOURS],
            *[F.bool_or(f"missing_{w}").alias(f"missing_{w}") for w in fixed.WINDOW_HOURS],
        )
    )


def state_day_means(district_day: DataFrame) -> DataFrame:
    """Unweighted means of the district values per state and day."""
    return district_day.groupBy("state", "day").agg(
        rounded(F.avg("daily_actual")).alias("state_actual"),
        rounded(F.avg("daily_normal")).alias("state_normal"),
        rounded(F.avg("daily_departure_pct")).alias("state_departure_pct"),
    )


def enrich_with_state_day(daily: DataFrame, district_day: DataFrame) -> DataFrame:
    """Station days LEFT JOIN state days on (state, date); the right side is unique by grouping."""
    means = state_day_means(district_day).withColumn("date", F.date_from_unix_date("day")).drop("day")
    return daily.join(means, ["state", "date"], "left").withColumns(
        {
            "rainfall_data_status": F.when(F.col("state_actual").isNotNull(), "CWC_PLUS_IMD").otherwise("CWC_ONLY"),
            "integration_level": F.lit("STATE_DATE"),
        }
    )


def macro_context(obs: DataFrame, district_day: DataFrame) -> DataFrame:
    """Official context of an observation: its district and day, else its state and day, else NULL.

    obs needs state, district and day (days since 1970).
    """
    fields = ["daily_actual", "daily_normal", "daily_departure_pct", "category"]
    by_district = district_day.select(
        "state", "district", "day", F.struct(F.lit("DISTRICT").alias("scope"), *fields).alias("_d")
    )
    by_state = state_day_means(district_day).select(
        "state", "day",
        F.struct(
            F.lit("STATE").alias("scope"), F.col("state_actual").alias("daily_actual"),
            F.col("state_normal").alias("daily_normal"),
            F.col("state_departure_pct").alias("daily_departure_pct"),
            F.lit(None).cast("string").alias("category"),
        ).alias("_s"),
    )
    return (
        obs.join(by_district, ["state", "district", "day"], "left")
        .join(by_state, ["state", "day"], "left")
        .withColumn("macro", F.coalesce("_d", "_s"))
        .withColumn("integration_level", F.concat(F.col("macro.scope"), F.lit("_DATE")))
        .drop("_d", "_s")
    )

"""Streaming queries: each runs its stream to the end of the input and reads back what it wrote."""

from __future__ import annotations

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.functions import hazard
from slopecast.functions.columns import rounded
from slopecast.plans.bindings import Tables, rnd, telemetry_of
from slopecast.plans.hazard import sql_fuse, sql_trigger
from slopecast.plans.registry import query
from slopecast.session import scratch_path
from slopecast.streaming import jobs


@contextmanager
def state_store(spark):
    """Stateful Python processors need the RocksDB store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, jobs.ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def finished(t: Tables, out: DataFrame, label: str, python_state: bool = False) -> DataFrame:
    path = scratch_path(t.spark, label)
    with state_store(t.spark) if python_state else nullcontext():
        jobs.run_to_end(out, f"{path}/rows", f"{path}/checkpoint")
    return t.spark.read.schema(out.schema).parquet(f"{path}/rows")


MARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM tele_ok)"


@query("stream_telemetry_ingest", "SELECT reading_id, copy_no, station_key, epoch_us(ts) AS t_us, rainfall_1h FROM tele_ok")
def stream_telemetry_ingest(t: Tables):
    out = jobs.ingest(t.tele_stream())
    return finished(t, out, "ingest").select("reading_id", "copy_no", "station_key", F.unix_micros("ts").alias("t_us"), "rainfall_1h")


@query("stream_dedup", "SELECT DISTINCT station_key, epoch_us(ts) AS t_us, rainfall_1h FROM tele_ok")
def stream_dedup(t: Tables):
    out = jobs.dedup(jobs.ingest(t.tele_stream())).select("station_key", "ts", "rainfall_1h")
    return finished(t, out, "dedup").select("station_key", F.unix_micros("ts").alias("t_us"), "rainfall_1h")


@query(
    "stream_station_day",
    f"""SELECT station_key, epoch_us(date_trunc('day', ts)) AS day_us, {rnd('sum(rainfall_1h)')} AS rainfall_mm, count(rainfall_1h) AS valid_readings
    FROM tele_ok GROUP BY station_key, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {MARK}""",
)
def stream_station_day(t: Tables):
    out = finished(t, jobs.station_day(jobs.ingest(t.tele_stream())), "days")
    return out.select("station_key", F.unix_micros("day_start").alias("day_us"), rounded(F.col("rainfall_mm")).alias("rainfall_mm"), "valid_readings")


SLIDING = ((24, 6), (72, 20), (168, 46))


@query(
    "stream_sliding_rain",
    " UNION ALL ".join(
        f"""SELECT station_key, {h} AS hours, end_us, {rnd('sum(rainfall_1h)')} AS rainfall_sum, count(rainfall_1h) AS rainfall_obs,
        {rnd(f'least(count(rainfall_1h) / {x}.0, 1.0)')} AS coverage FROM (SELECT *, unnest(range(hour_us + 3600000000, hour_us + {h + 1} * 3600000000, 3600000000)) AS end_us
        FROM (SELECT station_key, rainfall_1h, epoch_us(date_trunc('hour', ts)) AS hour_us FROM tele_ok)) WHERE end_us <= epoch_us({MARK}) GROUP BY station_key, end_us"""
        for h, x in SLIDING
    ),
)
def stream_sliding_rain(t: Tables):
    """Hour-aligned sliding totals of 24, 72 and 168 hours, closed windows only, from one stream."""
    out = finished(t, jobs.sliding_rain(jobs.ingest(t.tele_stream()), dict(SLIDING)), "sliding", python_state=True)
    return out.select(
        "station_key", "hours", F.unix_micros("window_end").alias("end_us"), rounded(F.col("rainfall_sum")).alias("rainfall_sum"),
        "rainfall_obs", rounded(F.col("coverage")).alias("coverage"),
    )


@query(
    "stream_latest_freshness",
    f"""SELECT station_key, 'STALE' AS kind, t + 21600000 AS t_ms FROM (SELECT station_key, t, lead(t) OVER (PARTITION BY station_key ORDER BY t) AS nxt
    FROM (SELECT DISTINCT station_key, epoch_us(ts) // 1000 AS t FROM tele_ok)) WHERE nxt > t + 21600000 OR (nxt IS NULL AND t + 21600000 <= epoch_ms({MARK}))""",
)
def stream_latest_freshness(t: Tables):
    """A STALE event whenever a station has been silent for six hours."""
    return finished(t, jobs.freshness(jobs.ingest(t.tele_stream())), "freshness", python_state=True)


def places(t: Tables) -> DataFrame:
    score = F.split("station_key", "::")[1].cast("double") / 10.0 + 0.05
    p = t.stations.select("station_key", F.col("site_no").alias("place_id")).withColumn("static_score", score)
    return p.withColumn("tier", hazard.susceptibility_tier(F.col("static_score")))


#: Readings that the synthetic stations should deliver in a window.
EXPECTED = {"24h": 6.0, "3d": 20.0, "7d": 46.0}
_HOURS = {"24h": 24, "3d": 72, "7d": 168}
_OVER = {w: f"OVER (PARTITION BY station_key ORDER BY hour_us RANGE BETWEEN {h - 1} * 3600000000 PRECEDING AND CURRENT ROW)" for w, h in _HOURS.items()}
_WINDOWS = f"""SELECT station_key, hour_us + 3600000000 AS at_us, {rnd('mm')} AS rainfall_1h,
    {", ".join(f"CASE WHEN obs_{w} >= {x * 0.75} THEN {rnd(f'mm_{w}')} END AS rainfall_{w}" for w, x in EXPECTED.items())},
    CASE WHEN mm IS NULL THEN 'MISSING' WHEN {" OR ".join(f"obs_{w} < {x * 0.75}" for w, x in EXPECTED.items())} THEN 'PARTIAL' ELSE 'GOOD' END AS quality,
    CASE WHEN mm IS NULL THEN 'MISSING' ELSE 'OK' END AS status
    FROM (SELECT *, {", ".join(f"sum(mm) {o} AS mm_{w}, sum(obs) {o} AS obs_{w}" for w, o in _OVER.items())}
      FROM (SELECT station_key, epoch_us(date_trunc('hour', ts)) AS hour_us, sum(rainfall_1h) AS mm, count(rainfall_1h) AS obs FROM tele_ok GROUP BY 1, 2))
    WHERE hour_us + 3600000000 <= epoch_us({MARK})"""
_SCORED = sql_fuse(sql_trigger(f"""SELECT r.*, s.place_id, s.static_score, CASE WHEN s.static_score >= 0.75 THEN 'VERY_HIGH' WHEN s.static_score >= 0.5 THEN 'HIGH' WHEN s.static_score >= 0.25 THEN 'MODERATE' ELSE 'LOW' END AS tier
    FROM ({_WINDOWS}) r JOIN (SELECT station_key, site_no AS place_id, CAST(split_part(station_key, '::', 2) AS DOUBLE) / 10.0 + 0.05 AS static_score FROM stations) s USING (station_key)"""))


@query(
    "stream_static_join",
    f"SELECT station_key, at_us, place_id, rainfall_24h, rainfall_7d, trigger_level, trigger_score, risk_level, fusion_score FROM ({_SCORED})",
)
def stream_static_join(t: Tables):
    """Every closed hour with a reading, triggered on four windows, for every place of its station."""
    out = jobs.score_stream(jobs.ingest(t.tele_stream()), places(t), EXPECTED)
    scored = finished(t, out.select("station_key", "at", "place_id", "rainfall_24h", "rainfall_7d", "trigger_level", "trigger_score", "risk_level", "fusion_score"), "scored", python_state=True)
    return scored.withColumn("at_us", F.unix_micros("at")).drop("at")


@query(
    "stream_alerts",
    f"""SELECT station_key, place_id, at_us AS t_us, risk_level FROM (SELECT *, lag(risk_level) OVER (PARTITION BY station_key, place_id ORDER BY at_us) AS before
    FROM ({_SCORED})) WHERE risk_level IN ('HIGH', 'CRITICAL') AND risk_level IS DISTINCT FROM before""",
)
def stream_alerts(t: Tables):
    """One row whenever a place enters HIGH or CRITICAL."""
    return finished(t, jobs.place_alerts(jobs.ingest(t.tele_stream()), places(t), EXPECTED), "alerts", python_state=True)


@query(
    "stream_late_data",
    """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM tele_ok WHERE reading_id % 10 <> 7)
    SELECT CASE WHEN reading_id % 10 = 7 AND ts < (SELECT mark FROM m) THEN 'late' ELSE 'on_time' END AS side, count(*) AS n, max(epoch_us(ts)) AS newest_us FROM tele_ok GROUP BY 1""",
)
def stream_late_data(t: Tables):
    """Deliver the events in two parts; what the second part brings too late is kept aside and counted."""
    path = scratch_path(t.spark, "late")
    events = t.spark.read.parquet(f"{t.folder}/events.parquet")
    held_back = F.col("event_id") % 10 == 7
    for part, rows in (("a", events.filter(~held_back)), ("b", events.filter(held_back))):
        rows.write.parquet(f"{path}/in/part={part}")
        stream = t.spark.readStream.schema(events.schema).parquet(f"{path}/in/part=*")
        jobs.split_late(jobs.ingest(telemetry_of(stream)), f"{path}/out", f"{path}/checkpoint")
    rows = t.spark.read.parquet(f"{path}/out/rows")
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("ts")).alias("newest_us"))

"""Telemetry queries: scans, cleaning, windows, daily totals, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast.functions.columns import rounded
from slopecast.functions.rainfall import in_domain, rainfall_class
from slopecast.operators import telemetry as op
from slopecast.plans.bindings import Tables, registered_sources, rnd
from slopecast.plans.registry import query
from slopecast.session import scratch_path
from slopecast.sources import readers, sinks

# The bound stations report about 6.7 times a day instead of hourly.
EXPECTED = {"24h": 6, "3d": 20, "7d": 46}

def us():
    """Instant in microseconds."""
    return F.unix_micros("ts").alias("t_us")


def features(t: Tables):
    return op.build_features(t.tele, EXPECTED)


@query(
    "telemetry_scan",
    """SELECT station, state, district, latitude, longitude, epoch_us(date_trunc('second', ts)) AS t_us, rainfall_1h,
    source_period FROM tele""",
)
def telemetry_scan(t: Tables):
    """Write the telemetry as raw export files in period folders, then scan them."""
    path = scratch_path(t.spark, "telemetry")
    text = F.lit(None).cast("string")
    given = {
        "SlNo": F.col("reading_id").cast("string"), "Station": F.col("station"), "State": F.col("state"),
        "District": F.col("district"), "Latitude": F.col("latitude").cast("string"),
        "Longitude": F.col("longitude").cast("string"),
        "Data Acquisition Time": F.date_format("ts", "dd-MM-yyyy HH:mm:ss"),
        "Telemetry Hourly Rainfall (mm)": F.col("rainfall_1h").cast("string"),
    }
    raw = t.tele.select(
        *[given.get(h, text).alias(h) for h in readers.TELEMETRY_COLUMNS],
        F.regexp_replace("source_period", "_source$", "").alias("period"),
    )
    for period in ("2021_2025", "2026_2030"):
        raw.filter(F.col("period") == period).drop("period").write.csv(f"{path}/{period}", header=True)
    return readers.read_telemetry(t.spark, path).select(
        "station", "state", "district", "latitude", "longitude",
        F.unix_micros("timestamp").alias("t_us"), "rainfall_1h", "source_period",
    )


@query(
    "exact_file_dedup",
    """SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY sha256(text)) AS original,
    doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS is_copy FROM documents""",
)
def exact_file_dedup(t: Tables):
    """Byte-identical documents: the smallest id of equal contents is the original."""
    hashed = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return readers.mark_copies(hashed, "doc_id", "sha256")


@query(
    "district_daily_scan",
    """SELECT state, district, CAST(strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS VARCHAR) AS date,
    actual AS daily_actual, normal AS daily_normal,
    floor((actual - normal) / normal * 100 + 0.5) AS daily_departure_pct FROM district_reports""",
)
def district_daily_scan(t: Tables):
    """Write district reports under awkward headers, then scan them."""
    path = scratch_path(t.spark, "district")
    pct = F.floor((F.col("actual") - F.col("normal")) / F.col("normal") * 100 + 0.5)
    t.district_reports.select(
        F.col("state").alias("State"), F.col("district").alias(" District"),
        F.date_format(F.date_from_unix_date("day"), "dd-MM-yyyy").alias("Date"),
        F.col("actual").cast("string").alias("Daily\nActual"), F.col("normal").cast("string").alias("Daily\n Normal"),
        F.concat(pct.cast("string"), F.lit("%")).alias("Daily Departure\nPer"),
    ).write.csv(path, header=True, quoteAll=True)
    return readers.read_district_days(t.spark, path).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "inventory_scan",
    f"""SELECT event_id AS feature_id, raw_state AS state, {rnd('latitude')} AS latitude, {rnd('longitude')} AS longitude,
    CASE event_no % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'MultiPolygon' WHEN 3 THEN 'LineString' WHEN 4 THEN 'MultiLineString' ELSE 'MultiPoint' END AS geometry_type FROM inventory""",
)
def inventory_scan(t: Tables):
    """Write the inventory as feature collections (one collection per 500 events) of six geometry
    types around the events' positions, then scan them."""
    path = scratch_path(t.spark, "inventory")
    lon, lat = F.col("longitude"), F.col("latitude")

    def line(*steps):
        return F.array(*[F.array(lon + dx, lat + dy) for dx, dy in steps])

    def square(r):
        return line((-r, -r), (r, -r), (r, r), (-r, r), (-r, -r))

    def box(dx):
        return line((dx - 0.01, -0.01), (dx + 0.01, -0.01), (dx + 0.01, 0.01), (dx - 0.01, 0.01), (dx - 0.01, -0.01))

    shapes = [
        ("Point", F.array(lon, lat)), ("Polygon", F.array(square(0.03), F.reverse(square(0.01)))),
        ("MultiPolygon", F.array(F.array(box(-0.05)), F.array(box(0.05)))), ("LineString", line((-0.02, 0), (0.02, 0))),
        ("MultiLineString", F.array(line((-0.02, 0.01), (0.02, 0.01)), line((-0.02, -0.01), (0.02, -0.01)))), ("MultiPoint", line((-0.01, -0.02), (0.01, 0.02))),
    ]
    kind, coordinates = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, shape) in enumerate(shapes):
        here = F.col("event_no") % 6 == k
        kind, coordinates = F.when(here, name).otherwise(kind), F.when(here, F.to_json(shape)).otherwise(coordinates)
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}"))
    props = F.when(
        F.col("event_no") % 3 == 0,
        F.to_json(F.create_map(F.lit("State"), F.col("raw_state"), F.lit("Latitude"), lat.cast("string"),
                               F.lit("Longitude"), lon.cast("string"))),
    ).otherwise(F.to_json(F.create_map(F.lit("State"), F.col("raw_state"))))
    feature = F.concat(F.lit('{"id":"'), F.col("event_id"), F.lit('","geometry":'), geometry,
                       F.lit(',"properties":'), props, F.lit("}"))
    (
        t.inventory.select(F.floor(F.col("event_no") / 500).alias("part"), feature.alias("f"))
        .groupBy("part")
        .agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
        .select("value")
        .write.text(path)
    )
    got = readers.read_inventory(t.spark, path, multi_line=False)
    return got.select(
        "feature_id", "state", rounded(F.col("latitude")).alias("latitude"),
        rounded(F.col("longitude")).alias("longitude"), "geometry_type",
    )


@query(
    "nested_json_scan",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def nested_json_scan(t: Tables):
    """Typed fields out of a JSON text column."""
    return t.raw("events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query(
    "tile_payload_scan",
    f"SELECT grid_row // 4 AS tile, grid_row % 4 AS cell_row, grid_col AS cell_col, {rnd('elev')} AS elev FROM grid",
)
def tile_payload_scan(t: Tables):
    """Tiles of four grid rows as nested JSON payloads with a flat array, read back to one row per cell."""
    cells = F.transform(
        F.array_sort(F.collect_list(F.struct("grid_row", "grid_col", "elev"))), lambda c: c["elev"]
    )
    payload = (
        t.grid.groupBy(F.floor(F.col("grid_row") / 4).alias("tile"))
        .agg(cells.alias("elevations"), (F.max("grid_col") + 1).alias("width"))
        .select(F.to_json(F.struct("tile", "width", "elevations")).alias("j"))
    )
    return readers.read_tile_cells(payload, "j").select(
        "tile", "cell_row", F.col("cell_col").cast("bigint").alias("cell_col"), rounded(F.col("elev")).alias("elev")
    )


@query(
    "feature_sink",
    """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n_rows, count(rainfall_24h) AS n_usable
    FROM tele_feat GROUP BY 1""",
)
def feature_sink(t: Tables):
    """Write the feature table partitioned by date, then count what was written."""
    path = scratch_path(t.spark, "features")
    feat = features(t).withColumn("date", F.to_date("ts"))
    sinks.write_features(feat, path, op.FEATURE_COLUMNS)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("rainfall_24h").alias("n_usable")
    )


@query(
    "run_report",
    """SELECT *, rows_in - rows_usable AS removed, rows_usable - rows_kept AS collapsed FROM
    (SELECT count(*) AS rows_in, count(*) FILTER (ts IS NULL) AS undated, count(*) FILTER (rainfall_1h < 0) AS negative,
      count(*) FILTER (rainfall_1h IS NULL) AS missing, count(DISTINCT source_file) AS files FROM tele),
    (SELECT count(*) AS rows_usable FROM tele_ok),
    (SELECT count(*) AS rows_kept, count(DISTINCT station_key) AS stations, count(DISTINCT state) AS states,
      epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM tele_dedup)""",
)
def run_report(t: Tables):
    ok = op.usable_rows(t.tele)
    return sinks.run_report(t.tele, ok, op.dedup_measurements(ok))


@query(
    "provenance_register",
    f"""SELECT source_id, count(*) AS n_events, source_id IN ('SRC_O', 'SRC_F') AS registered, min(event_day) AS first_day, max(event_day) AS last_day,
    {rnd('count(DISTINCT event_day) / (max(event_day) - min(event_day) + 1)')} AS day_coverage,
    CAST(sum(CAST('0x' || substr(md5(event_id), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM inventory GROUP BY 1""",
)
def provenance_register(t: Tables):
    """Every event source: its event count, whether the register knows it, its days and the share of them with an event, and a
    checksum of its event ids that does not depend on their order."""
    register = registered_sources(t).withColumn("known", F.lit(True))
    used = sinks.source_coverage(t.inventory, "source_id", "event_id", "event_day")
    return used.join(register, "source_id", "left").select(
        "source_id", "n_events", F.coalesce("known", F.lit(False)).alias("registered"), "first_day", "last_day", "day_coverage", "checksum"
    )


@query(
    "bbox_filter",
    """SELECT reading_id, copy_no, latitude, longitude FROM tele
    WHERE latitude BETWEEN 21.5 AND 30 AND longitude BETWEEN 88 AND 98""",
)
def bbox_filter(t: Tables):
    return t.tele.filter(in_domain(F.col("latitude"), F.col("longitude"))).select(
        "reading_id", "copy_no", "latitude", "longitude"
    )


@query("usable_rows", "SELECT reading_id, copy_no, epoch_us(ts) AS t_us, rainfall_1h FROM tele_ok")
def usable_rows(t: Tables):
    return op.usable_rows(t.tele).select("reading_id", "copy_no", us(), "rainfall_1h")


@query(
    "rainfall_class",
    """SELECT reading_id, copy_no, CASE WHEN rainfall_1h IS NULL THEN 'MISSING' WHEN rainfall_1h < 0 THEN 'INVALID_NEGATIVE'
    WHEN rainfall_1h > 100 THEN 'EXTREME_REVIEW' WHEN rainfall_1h > 50 THEN 'HIGH_REVIEW'
    WHEN rainfall_1h > 0 THEN 'VALID' ELSE 'ZERO' END AS rainfall_quality FROM tele""",
)
def rainfall_classes(t: Tables):
    return t.tele.select("reading_id", "copy_no", rainfall_class(F.col("rainfall_1h")).alias("rainfall_quality"))


@query("quality_flag", "SELECT reading_id, copy_no, timestamp_collision, quality_flag FROM tele_feat")
def quality_flags(t: Tables):
    return features(t).select("reading_id", "copy_no", "timestamp_collision", "quality_flag")


@query(
    "temporal_slice",
    """SELECT reading_id, copy_no, epoch_us(ts) AS t_us FROM tele
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""",
)
def temporal_slice(t: Tables):
    """Half-open interval of days."""
    return t.tele.filter("ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13'").select(
        "reading_id", "copy_no", us()
    )


@query(
    "collision_audit",
    "SELECT station_key, epoch_us(ts) AS t_us, count(*) AS row_count FROM tele_ok GROUP BY ALL HAVING count(*) > 1",
)
def collision_audit(t: Tables):
    return op.collision_audit(op.usable_rows(t.tele)).select("station_key", us(), "row_count")


@query(
    "collision_value_variation",
    """SELECT station_key, epoch_us(ts) AS t_us, count(DISTINCT rainfall_1h) + max(CASE WHEN rainfall_1h IS NULL THEN 1 ELSE 0 END)
    AS value_count, count(*) AS row_count,
    count(DISTINCT rainfall_1h) + max(CASE WHEN rainfall_1h IS NULL THEN 1 ELSE 0 END) > 1 AS timestamp_collision
    FROM tele_ok GROUP BY station_key, ts""",
)
def collision_value_variation(t: Tables):
    return op.collision_variation(op.usable_rows(t.tele)).select(
        "station_key", us(), "value_count", "row_count", "timestamp_collision"
    )


@query(
    "measurement_dedup",
    "SELECT reading_id, copy_no, station_key, epoch_us(ts) AS t_us, rainfall_1h, source_file FROM tele_dedup",
)
def measurement_dedup(t: Tables):
    return op.dedup_measurements(op.usable_rows(t.tele)).select(
        "reading_id", "copy_no", "station_key", us(), "rainfall_1h", "source_file"
    )


@query(
    "trailing_rain",
    """SELECT reading_id, copy_no, rainfall_24h_sum, rainfall_3d_sum, rainfall_7d_sum, rainfall_obs_24h, rainfall_obs_3d,
    rainfall_obs_7d FROM tele_feat""",
)
def trailing_rain(t: Tables):
    return features(t).select(
        "reading_id", "copy_no", "rainfall_24h_sum", "rainfall_3d_sum", "rainfall_7d_sum",
        "rainfall_obs_24h", "rainfall_obs_3d", "rainfall_obs_7d",
    )


@query(
    "coverage_gate",
    f"""SELECT reading_id, copy_no, {rnd('coverage_24h')} AS coverage_24h, {rnd('coverage_3d')} AS coverage_3d,
    {rnd('coverage_7d')} AS coverage_7d, missing_24h, missing_3d, missing_7d, rainfall_24h, rainfall_3d, rainfall_7d
    FROM tele_feat""",
)
def coverage_gate(t: Tables):
    return features(t).select(
        "reading_id", "copy_no", *[rounded(F.col(f"coverage_{w}")).alias(f"coverage_{w}") for w in EXPECTED],
        *[f"missing_{w}" for w in EXPECTED], *[f"rainfall_{w}" for w in EXPECTED],
    )


@query(
    "latest_per_station",
    """SELECT station_key, epoch_us(ts) AS t_us, rainfall_1h, rainfall_24h, quality_flag FROM tele_feat
    QUALIFY row_number() OVER (PARTITION BY station_key ORDER BY ts DESC, reading_id DESC, copy_no DESC) = 1""",
)
def latest_per_station(t: Tables):
    return op.latest_per_station(features(t)).select("station_key", us(), "rainfall_1h", "rainfall_24h", "quality_flag")


STATION_DAY_SQL = f"""SELECT state, station, strftime(ts, '%Y-%m-%d') AS date, CAST(ts AS DATE) - DATE '1970-01-01' AS day,
    first(station_key ORDER BY ts, reading_id, copy_no) AS station_key,
    first(district ORDER BY ts, reading_id, copy_no) AS district,
    first(latitude ORDER BY ts, reading_id, copy_no) AS latitude,
    first(quality_flag ORDER BY ts, reading_id, copy_no) AS quality_flag,
    {rnd('sum(rainfall_1h)')} AS rainfall_mm, count(rainfall_1h) AS valid_readings,
    max(rainfall_24h_sum) AS rainfall_24h_sum, max(rainfall_7d) AS rainfall_7d, max(rainfall_obs_3d) AS rainfall_obs_3d,
    min(coverage_24h) AS coverage_24h, bool_or(missing_24h) AS missing_24h FROM tele_feat GROUP BY 1, 2, 3, 4"""


@query("station_day", f"SELECT * EXCLUDE (day, coverage_24h), {rnd('coverage_24h')} AS coverage_24h FROM ({STATION_DAY_SQL})")
def station_day(t: Tables):
    return op.station_day(features(t)).select(
        "state", "station", F.date_format("date", "yyyy-MM-dd").alias("date"), "station_key", "district", "latitude",
        "quality_flag", "rainfall_mm", "valid_readings", "rainfall_24h_sum", "rainfall_7d", "rainfall_obs_3d",
        rounded(F.col("coverage_24h")).alias("coverage_24h"), "missing_24h",
    )


MEANS_SQL = (
    f"SELECT state, day, {rnd('avg(daily_actual)')} AS state_actual, {rnd('avg(daily_normal)')} AS state_normal, "
    f"{rnd('avg(daily_departure_pct)')} AS state_departure_pct FROM district_day GROUP BY state, day"
)


@query("state_day_means", MEANS_SQL)
def state_day_means(t: Tables):
    return op.state_day_means(t.district_day)


@query(
    "state_day_enrichment",
    f"""SELECT d.state, d.station, d.date, d.rainfall_mm, m.state_actual, m.state_normal, m.state_departure_pct,
    CASE WHEN m.state_actual IS NOT NULL THEN 'CWC_PLUS_IMD' ELSE 'CWC_ONLY' END AS rainfall_data_status,
    'STATE_DATE' AS integration_level
    FROM ({STATION_DAY_SQL}) d LEFT JOIN ({MEANS_SQL}) m ON d.state = m.state AND d.day = m.day""",
)
def state_day_enrichment(t: Tables):
    return op.enrich_with_state_day(op.station_day(features(t)), t.district_day).select(
        "state", "station", F.date_format("date", "yyyy-MM-dd").alias("date"), "rainfall_mm", "state_actual",
        "state_normal", "state_departure_pct", "rainfall_data_status", "integration_level",
    )


@query(
    "macro_context_fallback",
    f"""SELECT d.state, d.station, d.date, CASE WHEN x.district IS NOT NULL THEN 'DISTRICT' WHEN m.state IS NOT NULL THEN 'STATE' END AS scope,
    CASE WHEN x.district IS NOT NULL THEN x.daily_actual ELSE m.state_actual END AS daily_actual,
    CASE WHEN x.district IS NOT NULL THEN x.category END AS category,
    CASE WHEN x.district IS NOT NULL THEN 'DISTRICT_DATE' WHEN m.state IS NOT NULL THEN 'STATE_DATE' END AS integration_level
    FROM ({STATION_DAY_SQL}) d
    LEFT JOIN district_day x ON x.state = d.state AND x.district = d.district AND x.day = d.day
    LEFT JOIN ({MEANS_SQL}) m ON m.state = d.state AND m.day = d.day""",
)
def macro_context_fallback(t: Tables):
    daily = op.station_day(features(t)).withColumn("day", F.unix_date("date"))
    return op.macro_context(daily, t.district_day).select(
        "state", "station", F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("macro.scope").alias("scope"),
        F.col("macro.daily_actual").alias("daily_actual"), F.col("macro.category").alias("category"), "integration_level",
    )


@query("union_sources", """SELECT kind, id, latitude, longitude, road_class FROM (
    SELECT 'station' AS kind, site_no AS id, latitude, longitude, CAST(NULL AS VARCHAR) AS road_class FROM stations
    UNION ALL SELECT 'point', point_id, latitude, longitude, NULL FROM points
    UNION ALL SELECT 'segment', feature_id, NULL, NULL, road_class FROM segments)""")
def union_sources(t: Tables):
    """Concatenate sources with different columns; absent columns are NULL."""
    a = t.stations.select(F.lit("station").alias("kind"), F.col("site_no").alias("id"), "latitude", "longitude")
    b = t.points.select(F.lit("point").alias("kind"), F.col("point_id").alias("id"), "latitude", "longitude")
    c = t.segments.select(F.lit("segment").alias("kind"), F.col("feature_id").alias("id"), "road_class")
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("distinct_stations", "SELECT DISTINCT station_key, station, state, district, longitude FROM tele")
def distinct_stations(t: Tables):
    return t.tele.select("station_key", "station", "state", "district", "longitude").distinct()


@query(
    "subset_check",
    f"""SELECT count(*) AS outside FROM (SELECT DISTINCT day FROM ({STATION_DAY_SQL})
    WHERE day NOT IN (SELECT DISTINCT CAST(ts AS DATE) - DATE '1970-01-01' FROM tele WHERE ts IS NOT NULL))""",
)
def subset_check(t: Tables):
    """Dates of the output that the input does not have (0 when the output is a subset)."""
    out = op.station_day(features(t)).select("date").distinct()
    src = t.tele.select(F.to_date("ts").alias("date")).filter("date is not null").distinct()
    return out.join(src, "date", "left_anti").agg(F.count(F.lit(1)).alias("outside"))

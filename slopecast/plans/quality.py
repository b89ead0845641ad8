"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import blank_to_null, normal_name, number_or_null, rounded
from slopecast.functions.rainfall import in_domain
from slopecast.operators import quality as op
from slopecast.operators import telemetry
from slopecast.plans.bindings import Tables, rnd
from slopecast.plans.registry import query
from slopecast.plans.telemetry import MEANS_SQL, STATION_DAY_SQL, features
from slopecast.sources.readers import day_first_timestamp, offset_timestamp

NORMAL_STATE = "upper(trim(regexp_replace(raw_state, '\\s+', ' ', 'g')))"
STATE_LIST = ", ".join(f"'{s}'" for s in fixed.REGION_STATES)


@query("normalize_state", f"SELECT event_id, {NORMAL_STATE} AS state FROM inventory")
def normalize_state(t: Tables):
    return t.inventory.select("event_id", normal_name(F.col("raw_state")).alias("state"))


@query(
    "blank_to_null",
    "SELECT event_id, nullif(trim(raw_road), '') AS road, nullif(trim(raw_time), '') AS time FROM inventory",
)
def blanks(t: Tables):
    return t.inventory.select(
        "event_id", blank_to_null(F.col("raw_road")).alias("road"), blank_to_null(F.col("raw_time")).alias("time")
    )


NUMBER_TEXT = (
    "CASE l_linenumber % 4 WHEN 0 THEN concat('-', cast(l_quantity as string), '%') "
    "WHEN 1 THEN concat('1,', cast(100 + l_partkey % 900 as string)) WHEN 2 THEN 'n/a' "
    "ELSE cast(l_quantity as string) END AS text"
)


@query(
    "safe_numeric",
    f"""SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace(text, '[%,]', '', 'g') AS DOUBLE) AS number
    FROM (SELECT l_orderkey, l_linenumber, {NUMBER_TEXT} FROM lineitem)""",
)
def safe_numeric(t: Tables):
    raw = t.raw("lineitem").selectExpr("l_orderkey", "l_linenumber", NUMBER_TEXT)
    return raw.select("l_orderkey", "l_linenumber", number_or_null(F.col("text")).alias("number"))


@query(
    "safe_timestamp",
    """SELECT event_id,
    CASE WHEN event_id % 5 IN (0, 4) THEN epoch_us(date_trunc('second', ts)) WHEN event_id % 5 = 1 THEN epoch_us(date_trunc('minute', ts)) END AS local_us,
    CASE WHEN event_id % 5 = 3 THEN epoch_us(date_trunc('second', ts)) - 19800000000 END AS utc_us FROM events""",
)
def safe_timestamp(t: Tables):
    """Day-first text and ISO text with an offset; anything else is NULL."""
    text = (
        F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
        .when(F.col("event_id") % 5 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .when(F.col("event_id") % 5 == 2, F.lit("not a time"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return t.raw("events").select("event_id", text.alias("x")).select(
        "event_id", F.unix_micros(day_first_timestamp(F.col("x"))).alias("local_us"),
        F.unix_micros(offset_timestamp(F.col("x"))).alias("utc_us"),
    )


@query("region_filter", f"SELECT event_id, {NORMAL_STATE} AS state_normal FROM inventory WHERE {NORMAL_STATE} IN ({STATE_LIST})")
def region_filter(t: Tables):
    return op.region_filter(t.inventory, "raw_state", fixed.REGION_STATES).select("event_id", "state_normal")


@query(
    "region_filter_report",
    f"""SELECT count(*) FILTER (s IN ({STATE_LIST})) AS kept, count(*) FILTER (s NOT IN ({STATE_LIST})) AS dropped,
    count(*) FILTER (s IS NULL) AS missing FROM (SELECT {NORMAL_STATE} AS s FROM inventory)""",
)
def region_filter_report(t: Tables):
    return op.region_report(t.inventory, "raw_state", fixed.REGION_STATES)


@query(
    "class_filter",
    f"SELECT feature_id, road_class FROM segments WHERE road_class IN ({', '.join(repr(c) for c in fixed.ROAD_CLASSES)})",
)
def class_filter(t: Tables):
    return t.segments.filter(F.col("road_class").isin(*fixed.ROAD_CLASSES)).select("feature_id", "road_class")


@query(
    "search_filter",
    """SELECT site_no, station, state, station_key FROM stations
    WHERE lower(concat_ws(' ', station, state, station_key, site_no)) LIKE '%asia%' ORDER BY site_no LIMIT 50""",
)
def search_filter(t: Tables):
    """First 50 stations whose name, state, key or number contains the text."""
    text = F.lower(F.concat_ws(" ", "station", "state", "station_key", F.col("site_no").cast("string")))
    return t.stations.filter(text.contains("asia")).select("site_no", "station", "state", "station_key").orderBy("site_no").limit(50)


@query(
    "event_layer",
    """SELECT event_id, event_day, trim(raw_state) AS state, trim(raw_district) AS district, latitude, longitude,
    coalesce(fatalities, 0) AS fatalities, source_id,
    CASE WHEN trigger_reported IS NOT NULL THEN 'ALIGNED' ELSE 'MONITORED' END AS rainfall_linkage_status,
    coalesce(confidence, 'HIGH') AS confidence FROM inventory""",
)
def event_layer(t: Tables):
    return t.inventory.select(
        "event_id", "event_day", F.trim("raw_state").alias("state"), F.trim("raw_district").alias("district"),
        "latitude", "longitude", F.coalesce("fatalities", F.lit(0)).alias("fatalities"), "source_id",
        F.when(F.col("trigger_reported").isNotNull(), "ALIGNED").otherwise("MONITORED").alias("rainfall_linkage_status"),
        F.coalesce("confidence", F.lit("HIGH")).alias("confidence"),
    )


def _rule_sql() -> str:
    parts = []
    for name, lo, hi in fixed.FEATURE_LIMITS:
        tail = (
            f"WHEN {name} NOT IN (0, 1) THEN 'NOT_ALLOWED'" if lo is None
            else f"WHEN {name} < {lo} THEN 'BELOW_MIN' WHEN {name} > {hi} THEN 'ABOVE_MAX'"
        )
        parts.append(
            f"SELECT doc_id, line_no, '{name}' AS field, CASE WHEN {name} IS NULL THEN 'NULL' "
            f"WHEN isinf(CAST({name} AS DOUBLE)) THEN 'INFINITE' {tail} END AS rule FROM feature_rows"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rule IS NOT NULL"


@query("rule_violations", _rule_sql())
def rule_violations(t: Tables):
    return op.rule_violations(t.feature_rows, ["doc_id", "line_no"])


@query(
    "cross_field_warnings",
    """SELECT doc_id, line_no, 'rainfall_24h' AS field, 'rainfall_3d' AS exceeds FROM feature_rows WHERE rainfall_24h > rainfall_3d
    UNION ALL SELECT doc_id, line_no, 'rainfall_3d', 'rainfall_7d' FROM feature_rows WHERE rainfall_3d > rainfall_7d""",
)
def cross_field_warnings(t: Tables):
    return op.cross_field_warnings(t.feature_rows, ["doc_id", "line_no"])


def _gate_sql() -> str:
    parts = [
        "SELECT 'rows' AS \"check\", '' AS field, count(*) AS n FROM feature_rows",
        "SELECT 'null', 'risk', count(*) FILTER (risk IS NULL) FROM feature_rows",
        "SELECT 'duplicate_rows', '', (SELECT count(*) FROM feature_rows) - (SELECT count(*) FROM (SELECT DISTINCT "
        + ", ".join(fixed.FEATURES) + ", risk FROM feature_rows))",
        "SELECT CASE WHEN risk IN ('Critical', 'High', 'Low', 'Watch') THEN 'class' ELSE 'invalid_class' END, risk, count(*) "
        "FROM feature_rows WHERE risk IS NOT NULL GROUP BY risk",
        "SELECT 'unseen_class', c, 0 FROM (VALUES ('Critical'), ('High'), ('Low'), ('Watch')) v(c) "
        "WHERE c NOT IN (SELECT risk FROM feature_rows WHERE risk IS NOT NULL)",
        "SELECT 'size_warning', '', n FROM (SELECT count(*) AS n FROM feature_rows) WHERE n < 50",
    ]
    for name, lo, hi in fixed.FEATURE_LIMITS:
        x = f"CAST({name} AS DOUBLE)"
        parts.append(f"SELECT 'null', '{name}', count(*) FILTER ({name} IS NULL) FROM feature_rows")
        parts.append(f"SELECT 'infinite', '{name}', count(*) FILTER (isinf({x})) FROM feature_rows")
        if lo is None:
            parts.append(f"SELECT 'not_allowed', '{name}', count(*) FILTER ({name} NOT IN (0, 1)) FROM feature_rows")
        else:
            parts.append(f"SELECT 'below_min', '{name}', count(*) FILTER (NOT isinf({x}) AND {x} < {lo}) FROM feature_rows")
            parts.append(f"SELECT 'above_max', '{name}', count(*) FILTER (NOT isinf({x}) AND {x} > {hi}) FROM feature_rows")
    return " UNION ALL ".join(parts)


@query("dataset_profile_gate", _gate_sql())
def dataset_profile_gate(t: Tables):
    return op.profile_gate(t.feature_rows, fixed.FEATURE_LIMITS, "risk", fixed.RISK_CLASSES)


CONTRACT = ("24-hour rainfall", "3-day rainfall", "weekly rainfall", "slope angle", "altitude", "soil risk")


@query(
    "schema_conformance",
    f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_filter({list(CONTRACT)}, lambda c: NOT list_contains(have, c))), ','), '') AS missing,
    coalesce(array_to_string(list_sort(list_filter(have, lambda c: NOT list_contains({list(CONTRACT)}, c))), ','), '') AS unexpected
    FROM (SELECT doc_id, list(DISTINCT lower(trim(label))) AS have FROM entities GROUP BY doc_id)""",
)
def schema_conformance(t: Tables):
    """Names each payload lacks or adds, against the contract."""
    items = t.entities.select("doc_id", F.lower(F.trim("label")).alias("label"))
    return op.payload_conformance(items, "doc_id", "label", CONTRACT)


@query(
    "column_preservation",
    """WITH aft AS (SELECT point_id, latitude, coalesce(elevation_m, 0) AS elevation_m, static_score FROM points WHERE nation_no <> 3)
    SELECT 'lost_keys' AS "check", count(*) FILTER (b.point_id IS NULL) AS n FROM points a LEFT JOIN aft b USING (point_id)
    UNION ALL SELECT 'added_keys', 0
    UNION ALL SELECT 'repeated_keys', count(*) - count(DISTINCT point_id) FROM aft
    UNION ALL SELECT 'changed:latitude', count(*) FILTER (a.latitude IS DISTINCT FROM b.latitude) FROM points a JOIN aft b USING (point_id)
    UNION ALL SELECT 'changed:elevation_m', count(*) FILTER (a.elevation_m IS DISTINCT FROM b.elevation_m) FROM points a JOIN aft b USING (point_id)
    UNION ALL SELECT 'changed:static_score', count(*) FILTER (a.static_score IS DISTINCT FROM b.static_score) FROM points a JOIN aft b USING (point_id)""",
)
def column_preservation(t: Tables):
    """An enrichment that lost one nation and replaced NULL elevations is caught."""
    before = t.points.select("point_id", "latitude", "elevation_m", "static_score")
    after = t.points.filter("nation_no <> 3").select(
        "point_id", "latitude", F.coalesce("elevation_m", F.lit(0.0)).alias("elevation_m"), "static_score"
    )
    return op.preservation(before, after, "point_id")


GATE_COLUMNS = ("district", "latitude", "rainfall_mm", "rainfall_24h_sum", "rainfall_7d", "state_actual")
GATE_STATES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")


@query(
    "publish_gate",
    f"""WITH d AS (SELECT x.*, m.state_actual FROM ({STATION_DAY_SQL}) x LEFT JOIN ({MEANS_SQL}) m ON x.state = m.state AND x.day = m.day)
    SELECT 'rows' AS "check", count(*) AS n FROM d
    UNION ALL SELECT 'outside_region', count(*) FILTER (state NOT IN {GATE_STATES}) FROM d
    UNION ALL SELECT 'undated', count(*) FILTER (date IS NULL) FROM d
    UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (state, station, date)) FROM d
    UNION ALL SELECT 'dates_outside_source', count(DISTINCT date) FILTER (day NOT IN (SELECT CAST(ts AS DATE) - DATE '1970-01-01' FROM tele WHERE ts IS NOT NULL)) FROM d
    UNION ALL SELECT 'rows:' || state, count(*) FROM d GROUP BY state
    {' '.join(f"UNION ALL SELECT 'null:{c}', count(*) FILTER ({c} IS NULL) FROM d" for c in GATE_COLUMNS)}""",
)
def publish_gate(t: Tables):
    daily = telemetry.enrich_with_state_day(telemetry.station_day(features(t)), t.district_day)
    days = t.tele.select(F.to_date("ts").alias("date")).filter("date is not null").distinct()
    return op.publish_gate(daily, days, GATE_STATES, GATE_COLUMNS)


REQUIRED_PROPERTIES = ("SlideNo", "State", "District", "Latitude", "Longitude", "Year")


@query(
    "feature_property_check",
    f"""SELECT 'missing_property' AS "check", p AS name, 0 AS n FROM (VALUES ('SlideNo'), ('Year')) v(p)
    UNION ALL SELECT 'other_state', s, count(*) FROM (SELECT {NORMAL_STATE} AS s FROM inventory) WHERE s <> 'SIKKIM' GROUP BY s""",
)
def feature_property_check(t: Tables):
    props = F.create_map(
        F.lit("State"), F.col("raw_state"), F.lit("District"), F.col("raw_district"),
        F.lit("Latitude"), F.col("latitude").cast("string"), F.lit("Longitude"), F.col("longitude").cast("string"),
    )
    return op.property_check(t.inventory.select(props.alias("p")), "p", REQUIRED_PROPERTIES, "SIKKIM")


@query(
    "key_duplicates",
    """SELECT * FROM (SELECT report_id, state, district, day, count(*) OVER (PARTITION BY state, district, day) AS copies,
    report_id = min(report_id) OVER (PARTITION BY state, district, day) AS is_first FROM district_reports) WHERE copies > 1""",
)
def key_duplicates(t: Tables):
    return op.key_duplicates(t.district_reports, ["state", "district", "day"], "report_id").select(
        "report_id", "state", "district", "day", "copies", "is_first"
    )


@query(
    "file_qc",
    f"""WITH f AS (SELECT DISTINCT concat('gauge_', c_nationkey, '.csv') AS source_file FROM customer),
    q AS (SELECT source_file, count(*) AS n_rows, count(*) FILTER (rainfall_1h IS NULL) AS missing,
      count(*) FILTER (copy_no = 1) + count(*) FILTER (copy_no = 2 AND rainfall_1h IS NULL AND reading_id % 50 <> 0)
      + count(*) FILTER (copy_no = 2 AND rainfall_1h IS NULL AND reading_id % 50 = 0) AS duplicate_rows,
      min(rainfall_1h) AS min_mm, max(rainfall_1h) AS max_mm, count(*) FILTER (rainfall_1h < 0) AS negative,
      count(*) FILTER (rainfall_1h > 100) AS spikes FROM tele GROUP BY source_file)
    SELECT f.source_file, coalesce(n_rows, 0) AS n_rows, coalesce(missing, 0) AS missing, coalesce(duplicate_rows, 0) AS duplicate_rows,
    min_mm, max_mm, coalesce(negative, 0) AS negative, coalesce(spikes, 0) AS spikes,
    CASE WHEN n_rows > 0 THEN floor(missing / n_rows * 100.0 * 1e2 + 0.5) / 1e2 ELSE 0.0 END AS missing_pct,
    n_rows IS NULL AS is_empty FROM f LEFT JOIN q USING (source_file)""",
)
def file_qc(t: Tables):
    files = t.raw("customer").select(
        F.concat(F.lit("gauge_"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("source_file")
    ).distinct()
    return op.file_qc(t.tele, files)


@query(
    "global_qc",
    """SELECT count(*) AS records, count(*) FILTER (rainfall_1h IS NULL) AS missing, count(*) FILTER (rainfall_1h = 0) AS zeros,
    count(*) FILTER (rainfall_1h > 0) AS positives, count(*) FILTER (rainfall_1h < 0) AS negatives,
    count(*) FILTER (rainfall_1h > 50) AS over_50, count(*) FILTER (rainfall_1h > 100) AS over_100,
    count(*) FILTER (rainfall_1h > 300) AS over_300 FROM tele""",
)
def global_qc(t: Tables):
    return op.global_qc(t.tele)


@query(
    "station_qc",
    """SELECT station, count(*) AS records, count(*) FILTER (rainfall_1h IS NULL) AS missing, count(*) FILTER (rainfall_1h = 0) AS zeros,
    count(*) FILTER (rainfall_1h > 0) AS positives, count(*) FILTER (rainfall_1h > 100) AS over_100,
    coalesce(max(rainfall_1h), 0) AS max_mm, first(state ORDER BY reading_id, copy_no) AS state,
    first(latitude ORDER BY reading_id, copy_no) FILTER (latitude IS NOT NULL) AS latitude,
    first(longitude ORDER BY reading_id, copy_no) FILTER (longitude IS NOT NULL) AS longitude FROM tele GROUP BY station""",
)
def station_qc(t: Tables):
    return op.station_qc(t.tele)


@query(
    "extreme_topk",
    """SELECT reading_id, copy_no, station, rainfall_1h FROM tele WHERE rainfall_1h > 100
    ORDER BY rainfall_1h DESC, reading_id, copy_no LIMIT 20""",
)
def extreme_topk(t: Tables):
    return op.extreme_readings(t.tele).select("reading_id", "copy_no", "station", "rainfall_1h")


@query(
    "telemetry_audit",
    f"""SELECT state, count(*) AS n_rows, count(DISTINCT station) AS stations, count(DISTINCT district) AS districts,
    {rnd('avg(coverage_24h)')} AS mean_coverage_24h,
    {rnd('avg(CASE WHEN rainfall_1h IS NULL THEN 1.0 ELSE 0.0 END) * 100.0')} AS missing_1h_pct,
    {rnd('avg(CASE WHEN rainfall_24h IS NULL THEN 1.0 ELSE 0.0 END) * 100.0')} AS missing_24h_pct,
    count(*) FILTER (quality_flag = 'OK') AS flag_ok, count(*) FILTER (quality_flag = 'LOW_24H_COVERAGE') AS flag_low_24h_coverage,
    count(*) FILTER (quality_flag = 'TIMESTAMP_COLLISION') AS flag_timestamp_collision,
    count(*) FILTER (quality_flag = 'EXTREME_REVIEW') AS flag_extreme_review,
    count(*) FILTER (quality_flag = 'MISSING_RAINFALL') AS flag_missing_rainfall FROM tele_feat GROUP BY state""",
)
def telemetry_audit(t: Tables):
    return op.telemetry_audit(features(t))


@query(
    "integration_audit",
    f"""WITH d AS (SELECT x.*, m.state_actual FROM ({STATION_DAY_SQL}) x LEFT JOIN ({MEANS_SQL}) m ON x.state = m.state AND x.day = m.day)
    SELECT count(*) AS station_days, count(state_actual) AS matched, {rnd('count(state_actual) / count(*) * 100.0')} AS matched_pct,
    min(day) AS first_day, max(day) AS last_day, min(day) FILTER (state_actual IS NOT NULL) AS first_overlap,
    max(day) FILTER (state_actual IS NOT NULL) AS last_overlap FROM d""",
)
def integration_audit(t: Tables):
    return op.integration_audit(telemetry.enrich_with_state_day(telemetry.station_day(features(t)), t.district_day))


@query(
    "district_state_inspection",
    """SELECT state, CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT district) AS districts, min(day) AS first_day, max(day) AS last_day,
    CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows
    FROM (SELECT state, district, day, count(*) AS n FROM district_reports GROUP BY ALL) GROUP BY state""",
)
def district_state_inspection(t: Tables):
    return op.district_inspection(t.district_reports)


PROFILED = ("latitude", "longitude", "slope_deg", "elevation_m", "aspect_deg", "clay_percent", "nation_no")


@query(
    "column_profile",
    f"""WITH p AS (SELECT {', '.join(PROFILED)} FROM points)
    SELECT 'rows' AS metric, '' AS field, CAST(count(*) AS DOUBLE) AS value FROM p
    {' '.join(f"UNION ALL SELECT 'null', '{c}', CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) FROM p" for c in PROFILED)}
    UNION ALL SELECT 'min', 'latitude', min(latitude) FROM p UNION ALL SELECT 'max', 'latitude', max(latitude) FROM p
    UNION ALL SELECT 'min', 'longitude', min(longitude) FROM p UNION ALL SELECT 'max', 'longitude', max(longitude) FROM p
    UNION ALL SELECT 'inside', '', CAST(count(*) FILTER (latitude BETWEEN 21.5 AND 30 AND longitude BETWEEN 88 AND 98) AS DOUBLE) FROM p
    UNION ALL SELECT 'outside', '', CAST(count(*) FILTER (NOT (latitude BETWEEN 21.5 AND 30 AND longitude BETWEEN 88 AND 98)) AS DOUBLE) FROM p
    UNION ALL SELECT 'duplicates', '', CAST((SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS DOUBLE)""",
)
def column_profile(t: Tables):
    return op.column_profile(
        t.points.select(*PROFILED), "latitude", "longitude", in_domain(F.col("latitude"), F.col("longitude"))
    )


NUMERIC = ("slope_deg", "elevation_m", "aspect_deg", "clay_percent", "static_score")


def _profile_sql(table: str, columns, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"SELECT {g}'{c}' AS field, {rnd(f'min({c})')} AS min, {rnd(f'avg({c})')} AS mean, {rnd(f'max({c})')} AS max, "
        f"{rnd(f'stddev_samp({c})')} AS std, count(*) FILTER ({c} IS NULL) AS non_finite, "
        f"{rnd(f'quantile_cont({c}, 0.5)')} AS median FROM {table}{f' GROUP BY {group}' if group else ''}"
        for c in columns
    )


@query("numeric_profile", _profile_sql("points", NUMERIC))
def numeric_profile(t: Tables):
    return op.numeric_profile(t.points, NUMERIC)


@query(
    "feature_separation_by_label",
    f"WITH lab AS (SELECT *, CAST(static_score >= 0.5 AS INTEGER) AS label FROM points) {_profile_sql('lab', NUMERIC, 'label')}",
)
def feature_separation_by_label(t: Tables):
    labelled = t.points.withColumn("label", (F.col("static_score") >= 0.5).cast("int"))
    return op.numeric_profile(labelled, NUMERIC, ["label"])


BATCH = [
    "event_no",
    "CASE WHEN event_no % 3 = 0 THEN concat('F', cast(site_no as string)) ELSE NULL END AS feature_key",
    "CASE WHEN event_no % 3 = 1 THEN concat('S', cast(site_no as string)) ELSE NULL END AS slide_no",
    "raw_state", "raw_district", "raw_type", "raw_name",
]


@query(
    "feature_dedup",
    f"""SELECT max(event_no) AS event_no, count(*) AS versions FROM (SELECT {', '.join(BATCH)} FROM inventory)
    GROUP BY coalesce(feature_key, slide_no, concat_ws('|', raw_state, raw_district, raw_type, coalesce(raw_name, '<null>')))""",
)
def feature_dedup(t: Tables):
    batch = t.inventory.selectExpr(*BATCH)
    return op.feature_dedup(
        batch, ["feature_key", "slide_no"], ["raw_state", "raw_district", "raw_type", "raw_name"], "event_no"
    ).select("event_no", "versions")


@query(
    "missing_members",
    f"""SELECT 'missing' AS kind, m AS member FROM (VALUES {', '.join(f"('{s}')" for s in fixed.REGION_STATES)}) v(m)
    WHERE m NOT IN (SELECT {NORMAL_STATE} FROM inventory)
    UNION ALL SELECT DISTINCT 'invalid', {NORMAL_STATE} FROM inventory WHERE {NORMAL_STATE} NOT IN ({STATE_LIST})""",
)
def missing_members(t: Tables):
    return op.missing_members(t.inventory, "raw_state", fixed.REGION_STATES)

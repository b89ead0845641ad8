"""Event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from slopecast.functions.columns import rounded
from slopecast.operators import events as op
from slopecast.operators import telemetry
from slopecast.operators.spatial import nearest_site
from slopecast.plans.bindings import SQL_TABLES, Tables, registered_sources, rnd, sql_haversine
from slopecast.plans.hazard import rd
from slopecast.plans.registry import query

# The bound gauges report about 6.7 times a day, so the needed counts are scaled like the windows.
NEED = {"24h": 1, "48h": 8, "72h": 12, "7d": 24}
NEED_DAY, NEED_API = 4, 4

SQL_TABLES["std"] = """SELECT *, CASE state WHEN 'Arunachal Pradesh' THEN 'AR' WHEN 'Assam' THEN 'AS' WHEN 'Manipur' THEN 'MN' WHEN 'Meghalaya' THEN 'ML'
    WHEN 'Mizoram' THEN 'MZ' WHEN 'Nagaland' THEN 'NL' WHEN 'Sikkim' THEN 'SK' WHEN 'Tripura' THEN 'TR' ELSE 'NE' END AS state_code,
    raw_state ILIKE '%sikkim%' AND raw_state ILIKE '%bengal%' AS is_border,
    CASE WHEN lower(trim(raw_district)) = 'trap' THEN 'Tirap' WHEN lower(trim(raw_district)) = 'kamrup metro' THEN 'Kamrup Metropolitan'
    WHEN lower(trim(raw_district)) = 'south' AND state = 'Tripura' THEN 'South Tripura' ELSE trim(raw_district) END AS district,
    CASE WHEN raw_time = '7:30' THEN '07:30:00' WHEN raw_time = '18:05' THEN '18:05:00' END AS event_time,
    CASE WHEN raw_time IN ('7:30', '18:05') THEN 'EXACT_TIME' ELSE 'DATE_ONLY' END AS event_time_precision,
    CASE WHEN raw_type = '2' OR coalesce(raw_name, '') ILIKE '%debris%' THEN 'Debris slide'
    WHEN raw_type = '3' OR coalesce(raw_name, '') ILIKE '%rock%' OR coalesce(raw_name, '') ILIKE '%fall%' THEN 'Rock fall'
    WHEN coalesce(raw_name, '') ILIKE '%mud%' THEN 'Mudslide' ELSE 'Landslide (slope failure)' END AS landslide_type,
    CASE WHEN raw_road NOT IN ('-', '') THEN raw_road END AS road_affected,
    CASE event_no % 6 WHEN 0 THEN 'DISTRICT_ONLY' WHEN 1 THEN 'UNKNOWN' ELSE 'EXACT_COORDINATE' END AS location_precision
    FROM (SELECT *, CASE WHEN raw_state ILIKE '%sikkim%' THEN 'Sikkim' WHEN raw_state ILIKE '%arunachal%' THEN 'Arunachal Pradesh'
    WHEN raw_state ILIKE '%assam%' THEN 'Assam' WHEN raw_state ILIKE '%manipur%' THEN 'Manipur' WHEN raw_state ILIKE '%meghalaya%' THEN 'Meghalaya'
    WHEN raw_state ILIKE '%mizoram%' THEN 'Mizoram' WHEN raw_state ILIKE '%nagaland%' THEN 'Nagaland' WHEN raw_state ILIKE '%tripura%' THEN 'Tripura'
    ELSE trim(raw_state) END AS state FROM inventory)"""
STANDARD = [
    "event_id", "state", "state_code", "is_border", "district", "event_time", "event_time_precision", "landslide_type", "road_affected",
]


def standard(t: Tables):
    precision = F.when(F.col("event_no") % 6 == 0, "DISTRICT_ONLY").when(F.col("event_no") % 6 == 1, "UNKNOWN").otherwise("EXACT_COORDINATE")
    return op.standardize(t.inventory).withColumn("location_precision", precision)


def readings(t: Tables):
    return telemetry.dedup_measurements(telemetry.usable_rows(t.tele))


@query("event_standardize", f"SELECT {', '.join(STANDARD)} FROM std")
def event_standardize(t: Tables):
    return standard(t).select(*STANDARD)


_N = "CASE WHEN length(CAST({n} AS VARCHAR)) < 3 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


@query(
    "sequence_ids",
    f"""SELECT event_id, 'EV-2021-' || state_code || '-' || {_N.format(n='n')} AS sequence_id
    FROM (SELECT *, row_number() OVER (PARTITION BY state_code ORDER BY event_no) AS n FROM std)""",
)
def sequence_ids(t: Tables):
    return op.sequence_ids(standard(t), "state_code", "event_no", "EV-2021").select("event_id", "sequence_id")


@query(
    "control_periods",
    f"""SELECT event_id, 'CTRL-2021-' || upper(substr(state, 1, 2)) || '-' || {_N.format(n='n')} AS control_id,
    CASE (n - 1) % 3 WHEN 0 THEN '2021-01-10' WHEN 1 THEN '2021-02-05' ELSE '2021-11-15' END AS control_start,
    CASE (n - 1) % 3 WHEN 0 THEN '2021-01-17' WHEN 1 THEN '2021-02-12' ELSE '2021-11-22' END AS control_end,
    'CANDIDATE_CONTROL' AS control_quality FROM (SELECT *, row_number() OVER (ORDER BY event_no) AS n FROM std)""",
)
def control_periods(t: Tables):
    return op.control_periods(standard(t), "event_no").select("event_id", "control_id", "control_start", "control_end", "control_quality")


_ROWS = "OVER (PARTITION BY station_key, CAST(ts AS DATE) ORDER BY ts, reading_id, copy_no ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"


def _peak(rows: int, need: int) -> str:
    w = _ROWS.format(k=rows - 1)
    return f"CASE WHEN count(rainfall_1h) {w} >= {need} THEN sum(rainfall_1h) {w} END"


SQL_TABLES["profile"] = f"""SELECT station_key, CAST(ts AS DATE) - DATE '1970-01-01' AS day, count(rainfall_1h) AS n_valid, sum(rainfall_1h) AS total,
    max(rainfall_1h) AS rain_1h, max(s3) AS rain_3h, max(s6) AS rain_6h, max(s12) AS rain_12h
    FROM (SELECT *, {_peak(3, 2)} AS s3, {_peak(6, 4)} AS s6, {_peak(12, 8)} AS s12 FROM tele_dedup) GROUP BY ALL"""


@query(
    "subdaily_peaks",
    f"SELECT station_key, day, n_valid, rain_1h, {rnd('rain_3h')} AS rain_3h, {rnd('rain_6h')} AS rain_6h, {rnd('rain_12h')} AS rain_12h FROM profile",
)
def subdaily_peaks(t: Tables):
    return op.day_profile(readings(t)).select(
        "station_key", "day", "n_valid", "rain_1h", *[rounded(F.col(c)).alias(c) for c in ("rain_3h", "rain_6h", "rain_12h")]
    )


def _cal(days: int, need: int) -> str:
    w = f"OVER (PARTITION BY station_key ORDER BY day RANGE BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN sum(n_valid) {w} >= {need} THEN sum(total) {w} END"


SQL_TABLES["calendar"] = f"""SELECT *, {_cal(1, 1)} AS rain_24h, {_cal(2, 8)} AS rain_48h, {_cal(3, 12)} AS rain_72h, {_cal(7, 24)} AS rain_7d FROM profile"""


@query(
    "calendar_windows",
    f"SELECT station_key, day, {', '.join(f'{rnd(c)} AS {c}' for c in ('rain_24h', 'rain_48h', 'rain_72h', 'rain_7d'))} FROM calendar",
)
def calendar_windows(t: Tables):
    return op.calendar_windows(op.day_profile(readings(t)), NEED).select(
        "station_key", "day", *[rounded(F.col(c)).alias(c) for c in ("rain_24h", "rain_48h", "rain_72h", "rain_7d")]
    )


SQL_TABLES["api"] = f"""SELECT p.station_key, p.day,
    {rnd('coalesce(sum(q.total * pow(0.85, p.day - q.day)) FILTER (p.day - q.day <= 3), 0.0)')} AS api_3d,
    {rnd('coalesce(sum(q.total * pow(0.85, p.day - q.day)), 0.0)')} AS api_7d, 7 - count(q.day) AS api_missing_days
    FROM profile p LEFT JOIN profile q ON q.station_key = p.station_key AND p.day - q.day BETWEEN 1 AND 7 AND q.n_valid >= 4 GROUP BY p.station_key, p.day"""


@query("antecedent_index", "SELECT * FROM api")
def antecedent_index(t: Tables):
    return op.antecedent_index(op.day_profile(readings(t)), NEED_API).select(
        "station_key", "day", "api_3d", "api_7d", F.col("api_missing_days").cast("bigint").alias("api_missing_days")
    )


_ES = sql_haversine("p.latitude", "p.longitude", "s.latitude", "s.longitude")
SQL_TABLES["event_near"] = f"""SELECT p.site_no, s.station_key, s.station, {_ES} AS km FROM (SELECT DISTINCT site_no, latitude, longitude FROM inventory) p, stations s
    QUALIFY row_number() OVER (PARTITION BY p.site_no ORDER BY {_ES}, s.site_no) = 1"""
_G = "CASE WHEN gauge THEN {x} END"
SQL_TABLES["linked"] = f"""SELECT * EXCLUDE ({', '.join(op.WINDOW_COLUMNS)}, api_3d, api_7d),
    {', '.join(f"{_G.format(x=rd(c, 2))} AS {c}" for c in op.WINDOW_COLUMNS if c != 'rain_24h')},
    CASE WHEN gauge THEN {rd('rain_24h', 2)} ELSE {rd('grid_rainfall_mm', 2)} END AS rain_24h,
    CASE WHEN gauge THEN api_3d END AS api_3d, CASE WHEN gauge THEN api_7d END AS api_7d,
    CASE WHEN gauge THEN 'CWC' ELSE 'GPM/IMERG' END AS rainfall_source,
    CASE WHEN gauge THEN 'CWC_STN_' || upper(replace(station, ' ', '_')) ELSE 'GPM_GRID_' || printf('%.1f', floor(latitude * 10 + 0.5) / 10) || '_' || printf('%.1f', floor(longitude * 10 + 0.5) / 10) END AS station_or_grid_id,
    CASE WHEN gauge THEN {rd('km', 2)} END AS station_distance_km,
    CASE WHEN gauge AND event_time_precision = 'EXACT_TIME' THEN 'EXACT' ELSE 'SAME_DAY' END AS temporal_alignment
    FROM (SELECT e.*, n.km, n.station, n.station_key, c.* EXCLUDE (station_key, day), a.api_3d, a.api_7d, coalesce(n.km <= 50 AND c.n_valid >= 4, false) AS gauge
      FROM std e JOIN event_near n USING (site_no) LEFT JOIN calendar c ON c.station_key = n.station_key AND c.day = e.rain_day
      LEFT JOIN api a ON a.station_key = n.station_key AND a.day = e.rain_day)"""
LINKED = ["event_id", "rainfall_source", "station_or_grid_id", "station_distance_km", *op.WINDOW_COLUMNS, "api_3d", "api_7d", "temporal_alignment"]


def linked(t: Tables):
    return op.link_rainfall(standard(t), t.stations, readings(t), NEED_DAY, NEED, NEED_API)


@query("event_rainfall_linkage", f"SELECT {', '.join(LINKED)} FROM linked")
def event_rainfall_linkage(t: Tables):
    return linked(t).select(*LINKED)


@query(
    "event_window_join",
    "SELECT event_id, state, district, landslide_type, rainfall_source, rain_24h, rain_7d FROM linked",
)
def event_window_join(t: Tables):
    """Events joined to their window rows by event id."""
    ev = standard(t).select("event_id", "state", "district", "landslide_type")
    win = linked(t).select("event_id", "rainfall_source", "rain_24h", "rain_7d")
    return ev.join(win, "event_id")


@query(
    "pairwise_event_review",
    f"""WITH sites AS (SELECT DISTINCT site_no, latitude, longitude FROM inventory),
    d AS (SELECT p.site_no AS a, s.site_no AS b, {_ES} AS km FROM sites p, sites s),
    x AS (SELECT e.event_no, d.km, abs(e.event_day - f.event_day) AS gap, e.raw_district = f.raw_district AS same FROM inventory e JOIN d ON d.a = e.site_no AND d.km <= 50
        JOIN inventory f ON f.site_no = d.b AND f.event_no <> e.event_no
      UNION ALL SELECT e.event_no, d.km, abs(e.event_day - f.event_day), e.raw_district = f.raw_district FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS step FROM inventory) e
        JOIN inventory f ON f.event_day = e.event_day + e.step JOIN d ON d.a = e.site_no AND d.b = f.site_no AND d.km > 50)
    SELECT i.event_no, count(*) FILTER (km < 0.05 AND gap > 0) AS reactivation, count(*) FILTER (km < 1 AND gap = 0) AS ward_cluster,
    count(*) FILTER (km >= 1 AND km <= 50 AND gap = 0) AS corridor_cluster,
    count(*) FILTER (NOT (km < 0.05 AND gap > 0) AND NOT (km <= 50 AND gap = 0)) AS independent, count(*) FILTER (km < 1) AS high_similarity,
    count(*) FILTER (km >= 1 AND same) AS moderate_similarity, count(*) FILTER (km >= 1 AND NOT same) AS low_similarity
    FROM inventory i LEFT JOIN x ON x.event_no = i.event_no GROUP BY i.event_no""",
)
def pairwise_event_review(t: Tables):
    return op.pair_review(t.inventory, "event_no", "event_day", "raw_district")


@query(
    "event_rain_distribution",
    f"""SELECT count(rain_24h) AS n, {rnd('avg(rain_24h)')} AS mean, {rnd('stddev_samp(rain_24h)')} AS std, min(rain_24h) AS min, max(rain_24h) AS max,
    {', '.join(f"{rnd(f'quantile_cont(rain_24h, {q})')} AS {n}" for n, q in (('q25', 0.25), ('median', 0.5), ('q75', 0.75), ('q90', 0.9)))} FROM linked""",
)
def event_rain_distribution(t: Tables):
    return op.rain_distribution(linked(t))


@query(
    "rain_by_state",
    f"""SELECT state, count(*) AS n, {rnd('avg(rain_24h)')} AS mean, min(rain_24h) AS min, max(rain_24h) AS max,
    {rnd('quantile_cont(rain_24h, 0.5)')} AS median FROM linked GROUP BY state""",
)
def rain_by_state(t: Tables):
    return op.rain_by_state(linked(t))


@query(
    "window_availability",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"window\", count({c}) AS valid, count(*) - count({c}) AS missing, {rd(f'count({c}) / count(*) * 100.0', 2)} AS valid_pct FROM linked"
        for c in op.WINDOW_COLUMNS
    ),
)
def window_availability(t: Tables):
    return op.window_availability(linked(t))


_BANDS = (("high", "rain_24h >= 100"), ("watch", "rain_24h >= 50 AND rain_24h < 100"), ("below", "rain_24h < 50"))


@query(
    "threshold_exceedance",
    "SELECT count(rain_24h) AS n, " + ", ".join(
        f"count(*) FILTER ({c}) AS {k}_count, {rd(f'count(*) FILTER ({c}) / count(rain_24h) * 100.0', 2)} AS {k}_pct" for k, c in _BANDS
    ) + " FROM linked",
)
def threshold_exceedance(t: Tables):
    return op.threshold_exceedance(linked(t))


DIMENSIONS = ["confidence", "location_precision", "temporal_alignment", "state", "source_id"]


@query(
    "event_qc_summary",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM linked GROUP BY {d}" for d in DIMENSIONS),
)
def event_qc_summary(t: Tables):
    return op.qc_summary(linked(t), DIMENSIONS)


@query(
    "enum_and_fk_checks",
    """SELECT 'events' AS "check", count(*) AS n FROM linked
    UNION ALL SELECT 'bad_time_precision', count(*) FILTER (event_time_precision NOT IN ('EXACT_TIME', 'DATE_ONLY', 'MONTH_ONLY', 'YEAR_ONLY', 'UNKNOWN')) FROM linked
    UNION ALL SELECT 'bad_alignment', count(*) FILTER (temporal_alignment NOT IN ('EXACT', 'SAME_DAY', 'WITHIN_24H', 'WITHIN_72H', 'DATE_ONLY', 'UNKNOWN')) FROM linked
    UNION ALL SELECT 'bad_confidence', count(*) FILTER (confidence NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) FROM linked
    UNION ALL SELECT 'grid_rows_with_subdaily', count(*) FILTER (rainfall_source = 'GPM/IMERG' AND (rain_1h IS NOT NULL OR rain_72h IS NOT NULL)) FROM linked
    UNION ALL SELECT 'fatalities', CAST(sum(fatalities) AS BIGINT) FROM linked
    UNION ALL SELECT 'unregistered_source_events', count(*) FILTER (source_id NOT IN ('SRC_O', 'SRC_F')) FROM linked""",
)
def enum_and_fk_checks(t: Tables):
    register = registered_sources(t)
    return op.enum_checks(linked(t), register, ("1-URGENT", "2-HIGH", "3-MEDIUM"))


SAMPLE_DAY = "CASE event_no % 4 WHEN 0 THEN NULL WHEN 1 THEN event_day ELSE rain_day + 3 END AS sample_day"


@query(
    "temporal_feasibility",
    f"""SELECT count(*) AS samples, count(sample_day) AS dated, count(*) FILTER (ok) AS feasible, count(*) FILTER (NOT ok) AS impossible,
    {rnd('avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END) * 100.0')} AS impossible_pct FROM (SELECT sample_day, sample_day IS NOT NULL AND EXISTS (SELECT 1 FROM
      (SELECT DISTINCT station_key, CAST(ts AS DATE) - DATE '1970-01-01' AS day FROM tele_dedup) r
      WHERE r.station_key = s.station_key AND r.day BETWEEN s.sample_day - 7 AND s.sample_day) AS ok
      FROM (SELECT i.event_no, n.station_key, {SAMPLE_DAY} FROM inventory i JOIN event_near n USING (site_no)) s)""",
)
def temporal_feasibility(t: Tables):
    near = nearest_site(t.inventory, t.stations, ["site_no", "station_key"])
    samples = near.select(F.col("nearest.station_key").alias("station_key"), F.expr(SAMPLE_DAY))
    days = readings(t).select("station_key", F.unix_date(F.to_date("ts")).alias("day")).distinct()
    return op.temporal_feasibility(samples, days)

"""The domain tables, derived from the driver tables with integer arithmetic.

No driver table has coordinates or rainfall. Every table below reads a whole driver table;
the same derivation is written once as Spark columns and once as a SQL text for the oracle.
Column lists whose text means the same in both engines are shared.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopecast.session import load_table, prepare


def dbl(text: str) -> str:
    """A literal that both engines read as a double."""
    return f"cast({text} as double)"


REGION_CASE = (
    "CASE {k} % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' "
    "WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END"
)
TYPE_CASE = (
    "CASE {k} % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'signup' WHEN 2 THEN 'view' "
    "WHEN 3 THEN 'purchase' ELSE 'error' END"
)


def site_lat(k: str, mult: int, off: int = 0) -> str:
    return f"{dbl('21.5')} + (({k} * {mult} + {off}) % 8500) / {dbl('1000')}"


def site_lon(k: str, mult: int, off: int = 0) -> str:
    return f"{dbl('88')} + (({k} * {mult} + {off}) % 10000) / {dbl('1000')}"


TELE = [
    "event_id AS reading_id",
    "concat(event_type, '::', cast(user_id % 10 as string)) AS station_key",
    "concat('ST-', event_type, '-', cast(user_id % 10 as string)) AS station",
    f"{REGION_CASE.format(k='user_id')} AS state",
    "concat('NATION_', cast(user_id % 10 as string)) AS district",
    f"CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN {dbl('10')} "
    f"ELSE {dbl('22')} + (user_id % 10) * {dbl('0.75')} + length(event_type) * {dbl('0.1')} END AS latitude",
    f"{dbl('89')} + (user_id % 10) * {dbl('0.8')} + length(event_type) * {dbl('0.05')} AS longitude",
    "CASE WHEN event_id % 113 = 0 THEN NULL ELSE cast(ts as timestamp) END AS ts",
    "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 29 = 0 THEN -value "
    f"WHEN event_id % 31 = 0 THEN {dbl('0')} ELSE value / 4 END AS rainfall_1h",
    "concat('gauge_', cast(user_id % 7 as string), '.csv') AS source_file",
    "CASE WHEN event_id % 2 = 0 THEN '2021_2025_source' ELSE '2026_2030_source' END AS source_period",
]

STATIONS = [
    "s_suppkey AS site_no",
    f"concat({TYPE_CASE.format(k='s_suppkey')}, '::', "
    "cast(cast(floor(s_suppkey / 5) as bigint) % 12 as string)) AS station_key",
    "s_name AS station",
    f"{REGION_CASE.format(k='s_suppkey')} AS state",
    "concat('NATION_', cast(s_nationkey as string)) AS district",
    f"{site_lat('s_suppkey', 7919)} AS latitude",
    f"{site_lon('s_suppkey', 104729)} AS longitude",
]

POINTS = [
    "c_custkey AS point_id",
    f"{site_lat('c_custkey', 6271, 13)} AS latitude",
    f"{site_lon('c_custkey', 15485863, 13)} AS longitude",
    f"CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE (c_custkey * 37 % 600) / {dbl('10')} END AS slope_deg",
    f"CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE (c_custkey * 53 % 3000) + {dbl('0.5')} END AS elevation_m",
    f"CASE WHEN c_custkey % 47 = 0 THEN NULL ELSE (c_custkey * 71 % 360) + {dbl('0.25')} END AS aspect_deg",
    f"CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE (c_custkey * 29 % 450) / {dbl('10')} END AS relief_std_5x5_m",
    f"CASE WHEN c_custkey % 59 = 0 THEN NULL ELSE 10 + (c_custkey * 17 % 300) / {dbl('10')} END AS clay_percent",
    f"20 + (c_custkey * 19 % 400) / {dbl('10')} AS sand_percent",
    f"CASE WHEN c_custkey % 61 = 0 THEN NULL ELSE 15 + (c_custkey * 23 % 300) / {dbl('10')} END AS silt_percent",
    f"{dbl('1.1')} + (c_custkey * 31 % 50) / {dbl('100')} AS bulk_density_kg_dm3",
    f"((c_custkey * 97 % 400) - 200) / {dbl('100')} AS plan_curvature",
    f"2 + (c_custkey * 89 % 700) / {dbl('100')} AS topographic_wetness_index",
    "CASE WHEN c_custkey % 67 = 0 THEN NULL ELSE c_custkey % 31 END AS soil_code",
    "CASE WHEN c_custkey % 12 = 11 THEN 95 ELSE (c_custkey % 12) * 10 END AS cover_code",
    "CASE c_custkey % 5 WHEN 0 THEN 'Foot-Slope / Toe Cut' WHEN 1 THEN 'Valley Bottom / Deep Hollow' "
    "WHEN 2 THEN 'Mid-Slope' WHEN 3 THEN 'Upper Slope / Shoulder' ELSE 'Ridge / Crest' END AS slope_position",
    "CASE c_custkey % 4 WHEN 0 THEN 'Concave-Convergent (Hollow / Extreme Accumulation Risk)' "
    "WHEN 1 THEN 'Convergent (Gully Channel)' WHEN 2 THEN 'Planar (Uniform Slope)' "
    "ELSE 'Convex-Divergent (Shedding Ridge / Stable)' END AS curvature_class",
    "c_mktsegment = 'BUILDING' AS road_cut_present",
    "c_mktsegment = 'MACHINERY' AS drainage_blocked",
    "c_mktsegment = 'FURNITURE' AS deforestation_observed",
    "c_mktsegment = 'AUTOMOBILE' AS unsupported_excavation",
    "c_custkey % 9 = 0 AS has_retaining_wall",
    f"CASE WHEN c_custkey % 3 = 0 THEN 40 + (c_custkey % 35) + {dbl('0.5')} ELSE NULL END AS cut_slope_deg",
    f"(c_custkey * 7 % 1000) / {dbl('1000')} AS static_score",
    "c_nationkey AS nation_no",
    "cast(1704067200000000 + ((c_custkey * 7919) % 2592000) * 1000000 as bigint) AS query_us",
]

GRID = [
    "cast(floor(o_orderkey / 100) as bigint) AS grid_row",
    "o_orderkey % 100 AS grid_col",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 500 + 30 * (cast(floor(o_orderkey / 100) as bigint) % 17) "
    f"+ 20 * ((o_orderkey % 100) % 13) + o_totalprice / {dbl('10000')} END AS elev",
]

INVENTORY = [
    "o_orderkey AS event_no",
    "concat('EV-', cast(o_orderkey as string)) AS event_id",
    f"{site_lat('o_custkey', 6271, 13)} AS latitude",
    f"{site_lon('o_custkey', 15485863, 13)} AS longitude",
    "o_custkey AS site_no",
    "CASE o_custkey % 11 WHEN 0 THEN ' Sikkim/West Bengal' WHEN 1 THEN 'SIKKIM' WHEN 2 THEN 'arunachal pradesh ' "
    "WHEN 3 THEN 'Assam' WHEN 4 THEN 'Manipur' WHEN 5 THEN 'meghalaya' WHEN 6 THEN 'Mizoram' WHEN 7 THEN 'Nagaland' "
    "WHEN 8 THEN 'TRIPURA' WHEN 9 THEN 'Assam (Kamrup)' ELSE 'Bhutan' END AS raw_state",
    "CASE o_custkey % 6 WHEN 0 THEN 'Trap' WHEN 1 THEN 'kamrup metro' WHEN 2 THEN 'South' "
    "WHEN 3 THEN ' East Sikkim' ELSE concat('District ', cast(o_custkey % 25 as string)) END AS raw_district",
    "CASE o_orderkey % 7 WHEN 0 THEN '-' WHEN 1 THEN '7:30' WHEN 2 THEN '18:05' WHEN 3 THEN 'Early morning' "
    "WHEN 4 THEN 'Evening' WHEN 5 THEN 'late Night' ELSE '' END AS raw_time",
    "CASE o_orderkey % 5 WHEN 0 THEN '2' WHEN 1 THEN '3' WHEN 2 THEN '1' WHEN 3 THEN '' ELSE '-' END AS raw_type",
    "CASE o_orderkey % 8 WHEN 0 THEN 'Rock slope A' WHEN 1 THEN 'Mud flow B' WHEN 2 THEN 'Debris track' "
    "WHEN 3 THEN 'Hill C' ELSE NULL END AS raw_name",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'NH-10' WHEN o_orderkey % 4 = 1 THEN '-' ELSE '' END AS raw_road",
    "CASE WHEN o_orderkey % 23 = 0 THEN o_orderkey % 5 ELSE NULL END AS fatalities",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Monsoonal rainfall' END AS trigger_reported",
    "concat('SRC_', o_orderstatus) AS source_id",
    "o_orderpriority AS confidence",
    f"o_totalprice / {dbl('4000')} AS grid_rainfall_mm",
]

SEGMENTS = [
    "p_partkey AS feature_id",
    "CASE p_partkey % 11 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' "
    "WHEN 4 THEN 'tertiary' WHEN 5 THEN 'unclassified' WHEN 6 THEN 'residential' WHEN 7 THEN 'service' "
    "WHEN 8 THEN 'track' WHEN 9 THEN 'footway' ELSE 'steps' END AS road_class",
    f"{site_lat('p_partkey', 3571)} AS y1",
    f"{site_lon('p_partkey', 9241)} AS x1",
    f"{site_lat('p_partkey', 3571)} + ((p_partkey * 31) % 200 - 100) / {dbl('1000')} AS y2",
    f"{site_lon('p_partkey', 9241)} + ((p_partkey * 47) % 200 - 100) / {dbl('1000')} AS x2",
]

# One five-sided outline per nation on a 5 x 5 lay-out; neighbours leave narrow gaps.
_X0 = f"{dbl('88')} + (n_nationkey % 5) * {dbl('2')}"
_Y0 = f"{dbl('21.5')} + cast(floor(n_nationkey / 5) as bigint) * {dbl('1.7')}"
POLYGON_CORNERS = [
    (0, f"{_X0} + {dbl('0.01037')}", f"{_Y0} + {dbl('0.00731')}"),
    (1, f"{_X0} + {dbl('1.98319')}", f"{_Y0} + {dbl('0.00517')}"),
    (2, f"{_X0} + {dbl('1.60743')}", f"{_Y0} + {dbl('0.84913')}"),
    (3, f"{_X0} + {dbl('1.97711')}", f"{_Y0} + {dbl('1.69271')}"),
    (4, f"{_X0} + {dbl('0.02153')}", f"{_Y0} + {dbl('1.68613')}"),
]

FEATURE_ROWS = [
    "l_orderkey AS doc_id",
    "l_linenumber AS line_no",
    "CASE WHEN l_linenumber = 7 AND l_partkey % 50 = 0 THEN NULL ELSE l_quantity * 60 - 30 END AS rainfall_24h",
    "CASE WHEN l_partkey % 37 = 0 THEN l_quantity * 50 ELSE l_quantity * 65 END AS rainfall_3d",
    f"CASE WHEN l_suppkey % 19 = 0 THEN {dbl('1e308')} * 10 WHEN l_partkey % 41 = 0 THEN l_quantity * 55 "
    "ELSE l_quantity * 80 END AS rainfall_7d",
    f"l_quantity * 2 - {dbl('4')} AS slope",
    f"l_extendedprice / 10 - {dbl('600')} AS elevation",
    "CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 0 ELSE 2 END AS historical_landslide",
    f"l_tax * {dbl('1000')} AS distance_to_landslide",
    f"l_discount * 12 - {dbl('0.05')} AS soil_risk",
    "CASE l_linenumber WHEN 1 THEN 'Low' WHEN 2 THEN 'Watch' WHEN 3 THEN 'High' WHEN 4 THEN 'Low' "
    "WHEN 5 THEN 'Watch' WHEN 6 THEN 'Severe' ELSE NULL END AS risk",
]

SCORED = [
    "doc_id",
    "quality AS y",
    f"((doc_id * 37) % 101) / {dbl('100')} AS p",
    f"((doc_id * 53 + quality * 29) % 101) / {dbl('101')} AS p2",
]


def telemetry_of(events: DataFrame) -> DataFrame:
    """Telemetry rows of an events table or stream: each row, plus its repeats."""
    base = events.selectExpr(*TELE)
    copies = F.concat(
        F.array(F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("d"))),
        F.when(F.col("reading_id") % 50 == 0, F.array(F.struct(F.lit(1).alias("n"), F.lit(0.0).alias("d")))).otherwise(F.array()),
        F.when(F.col("reading_id") % 70 == 0, F.array(F.struct(F.lit(2).alias("n"), F.lit(1.0).alias("d")))).otherwise(F.array()),
    )
    return (
        base.withColumn("_c", F.explode(copies))
        .withColumn("copy_no", F.col("_c.n"))
        .withColumn("rainfall_1h", F.col("rainfall_1h") + F.col("_c.d"))
        .drop("_c")
    )


class Tables:
    """The bound tables of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return load_table(self.spark, self.folder, name)

    @cached_property
    def tele(self) -> DataFrame:
        """Hourly telemetry with exact repeats and conflicting repeats."""
        return telemetry_of(self.raw("events"))

    def tele_stream(self) -> DataFrame:
        """The same telemetry as a stream over the events file."""
        schema = self.spark.read.parquet(f"{self.folder}/events.parquet").schema
        source = prepare(self.spark).readStream.schema(schema).options(pathGlobFilter="events.parquet", maxFilesPerTrigger=64)
        raw = source.parquet(self.folder)
        return telemetry_of(raw)

    @cached_property
    def stations(self) -> DataFrame:
        return self.raw("supplier").selectExpr(*STATIONS)

    @cached_property
    def points(self) -> DataFrame:
        return self.raw("customer").selectExpr(*POINTS).withColumn("query_ts", F.timestamp_micros("query_us"))

    @cached_property
    def grid(self) -> DataFrame:
        return self.raw("orders").selectExpr(*GRID)

    @cached_property
    def inventory(self) -> DataFrame:
        df = self.raw("orders")
        day = F.unix_date(F.to_date("o_orderdate"))
        return df.selectExpr(*INVENTORY, "o_orderdate").select(
            "*",
            F.unix_date(F.to_date("o_orderdate")).alias("event_day"),
            (F.lit(19723) + (day - 9131) % 30).alias("rain_day"),
        ).drop("o_orderdate")

    @cached_property
    def segments(self) -> DataFrame:
        return self.raw("part").selectExpr(*SEGMENTS)

    @cached_property
    def vertices(self) -> DataFrame:
        corners = ", ".join(
            f"named_struct('seq', {s}, 'lon', {x}, 'lat', {y})" for s, x, y in POLYGON_CORNERS
        )
        return (
            self.raw("nation")
            .select("n_name", F.explode(F.expr(f"array({corners})")).alias("v"))
            .select(F.col("n_name").alias("state"), "v.seq", "v.lon", "v.lat")
        )

    @cached_property
    def district_reports(self) -> DataFrame:
        """One row per report: state, district, day and daily amounts."""
        nation = self.raw("nation")
        region = self.raw("region")
        cust = self.raw("customer").select("c_custkey", "c_nationkey")
        day = F.unix_date(F.to_date("o_orderdate"))
        return (
            self.raw("orders")
            .select("o_orderkey", "o_custkey", "o_totalprice", (F.lit(19723) + (day - 9131) % 17).alias("day"))
            .join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("o_orderkey").alias("report_id"),
                F.col("r_name").alias("state"),
                F.col("n_name").alias("district"),
                "day",
                (F.col("o_totalprice") / 10000.0).alias("actual"),
                (F.col("o_totalprice") / 12000.0 + F.col("o_orderkey") % 7).alias("normal"),
            )
        )

    @cached_property
    def district_day(self) -> DataFrame:
        """One row per (state, district, day)."""
        from slopecast.functions.columns import rounded

        return (
            self.district_reports.groupBy("state", "district", "day")
            .agg(
                rounded(F.avg("actual")).alias("daily_actual"),
                rounded(F.avg("normal")).alias("daily_normal"),
            )
            .withColumn(
                "daily_departure_pct",
                rounded((F.col("daily_actual") - F.col("daily_normal")) / F.col("daily_normal") * 100.0),
            )
            .withColumn(
                "category",
                F.when(F.col("daily_departure_pct") >= 20, "EXCESS")
                .when(F.col("daily_departure_pct") >= -19, "NORMAL")
                .otherwise("DEFICIENT"),
            )
        )

    @cached_property
    def feature_rows(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*FEATURE_ROWS)

    @cached_property
    def scored(self) -> DataFrame:
        return self.raw("labels").selectExpr(*SCORED)

    @cached_property
    def entities(self) -> DataFrame:
        """Labelled text mentions, eight kinds, one row per order line and per document."""
        return self.raw("lineitem").selectExpr(*ENTITIES)


ENTITIES = [
    "l_orderkey AS doc_id",
    "l_linenumber AS line_no",
    "CASE l_linenumber WHEN 1 THEN (CASE WHEN l_orderkey % 3 = 0 THEN 'rainfall' ELSE '24-Hour Rainfall ' END) "
    "WHEN 2 THEN '3-day rainfall' WHEN 3 THEN 'weekly rainfall' WHEN 4 THEN 'slope angle' "
    "WHEN 5 THEN 'altitude' WHEN 6 THEN 'historical landslide' "
    "ELSE (CASE WHEN l_orderkey % 2 = 0 THEN 'distance' ELSE 'soil risk' END) END AS label",
    "CASE WHEN l_linenumber = 6 THEN (CASE l_orderkey % 4 WHEN 0 THEN 'No prior landslide recorded' "
    "WHEN 1 THEN 'occurred near site' WHEN 2 THEN 'Site visited' ELSE 'documented in 2014' END) "
    "WHEN l_linenumber = 7 AND l_orderkey % 2 = 1 THEN (CASE l_orderkey % 5 WHEN 0 THEN 'high' "
    "WHEN 1 THEN concat(cast(l_quantity as string), '%') WHEN 2 THEN 'index 0.4' "
    "ELSE cast(l_quantity as string) END) "
    "ELSE concat(cast(l_quantity as string), CASE l_linenumber "
    "WHEN 1 THEN (CASE l_orderkey % 4 WHEN 0 THEN ' cm' WHEN 1 THEN ' inches' WHEN 2 THEN 'mm' ELSE ' litres' END) "
    "WHEN 2 THEN ' mm' WHEN 3 THEN '' WHEN 4 THEN (CASE WHEN l_orderkey % 2 = 0 THEN '%' ELSE ' degrees' END) "
    "WHEN 5 THEN (CASE l_orderkey % 3 WHEN 0 THEN ' ft' WHEN 1 THEN 'm' ELSE ' km' END) "
    "ELSE (CASE l_orderkey % 3 WHEN 0 THEN ' km' WHEN 1 THEN ' miles' ELSE ' m' END) END) END AS text",
]


def _select(columns: list[str], table: str) -> str:
    return "SELECT " + ", ".join(columns) + f" FROM {table}"


def rnd(text: str) -> str:
    """SQL twin of functions.columns.rounded with four digits."""
    return f"floor(floor(({text}) * 1e8 + 0.5) / 1e8 * 1e4 + 0.5) / 1e4"


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"(12742.0 * atan2(sqrt{a}, sqrt(greatest(0.0, 1.0 - {a}))))"


_ORDER_DAY = "(CAST(o_orderdate AS DATE) - DATE '1970-01-01')"
_WIN = "OVER (PARTITION BY station_key ORDER BY epoch_us(ts) RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)"


def _feat_sql() -> str:
    parts = []
    for label, hours, expected in (("24h", 24, 6), ("3d", 72, 20), ("7d", 168, 46)):
        w = _WIN.format(w=hours * 3_600_000_000 - 1)
        parts.append(
            f"{rnd(f'sum(rainfall_1h) {w}')} AS rainfall_{label}_sum, count(rainfall_1h) {w} AS rainfall_obs_{label}, "
            f"least(count(rainfall_1h) {w} / CAST({expected} AS DOUBLE), 1.0) AS coverage_{label}"
        )
    inner = "SELECT *, " + ", ".join(parts) + " FROM tele_dedup"
    gates = ", ".join(
        f"coverage_{x} < 0.75 AS missing_{x}, CASE WHEN coverage_{x} >= 0.75 THEN rainfall_{x}_sum END AS rainfall_{x}"
        for x in ("24h", "3d", "7d")
    )
    quality = (
        "CASE WHEN rainfall_1h IS NULL THEN 'MISSING' WHEN rainfall_1h < 0 THEN 'INVALID_NEGATIVE' "
        "WHEN rainfall_1h > 100 THEN 'EXTREME_REVIEW' WHEN rainfall_1h > 50 THEN 'HIGH_REVIEW' "
        "WHEN rainfall_1h > 0 THEN 'VALID' ELSE 'ZERO' END AS rainfall_quality"
    )
    flag = (
        "CASE WHEN missing_24h THEN 'LOW_24H_COVERAGE' WHEN timestamp_collision THEN 'TIMESTAMP_COLLISION' "
        "WHEN rainfall_1h > 100 THEN 'EXTREME_REVIEW' WHEN rainfall_1h IS NULL THEN 'MISSING_RAINFALL' "
        "ELSE 'OK' END AS quality_flag"
    )
    return f"SELECT *, {flag} FROM (SELECT *, {gates}, {quality} FROM ({inner}))"


SQL_TABLES = {
    "tele_base": _select(TELE, "events"),
    "tele": "SELECT *, 0 AS copy_no FROM tele_base UNION ALL SELECT *, 1 FROM tele_base WHERE reading_id % 50 = 0 "
    "UNION ALL SELECT * REPLACE (rainfall_1h + 1.0 AS rainfall_1h), 2 FROM tele_base WHERE reading_id % 70 = 0",
    "tele_ok": "SELECT * FROM tele WHERE ts IS NOT NULL AND latitude BETWEEN 21.5 AND 30 AND longitude BETWEEN 88 AND 98 "
    "AND (rainfall_1h IS NULL OR rainfall_1h >= 0)",
    "tele_dedup": "SELECT * EXCLUDE (rk), count(*) OVER (PARTITION BY station_key, ts) > 1 AS timestamp_collision FROM "
    "(SELECT *, row_number() OVER (PARTITION BY station_key, ts, rainfall_1h ORDER BY reading_id, copy_no) AS rk "
    "FROM tele_ok) WHERE rk = 1",
    "tele_feat": _feat_sql(),
    "stations": _select(STATIONS, "supplier"),
    "points": _select(POINTS + ["c_custkey"], "customer"),
    "grid": _select(GRID, "orders"),
    "inventory": _select(
        INVENTORY + [f"{_ORDER_DAY} AS event_day", f"19723 + ({_ORDER_DAY} - 9131) % 30 AS rain_day"], "orders"
    ),
    "segments": _select(SEGMENTS, "part"),
    "vertices": " UNION ALL ".join(
        f"SELECT n_name AS state, {s} AS seq, {x} AS lon, {y} AS lat FROM nation" for s, x, y in POLYGON_CORNERS
    ),
    "edges": "SELECT a.state, a.seq, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM vertices a "
    "JOIN vertices b ON a.state = b.state AND b.seq = (a.seq + 1) % 5",
    "district_reports": "SELECT o_orderkey AS report_id, r_name AS state, n_name AS district, "
    f"19723 + ({_ORDER_DAY} - 9131) % 17 AS day, o_totalprice / 10000.0 AS actual, "
    "o_totalprice / 12000.0 + o_orderkey % 7 AS normal FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "district_day": "SELECT *, CASE WHEN daily_departure_pct >= 20 THEN 'EXCESS' WHEN daily_departure_pct >= -19 "
    "THEN 'NORMAL' ELSE 'DEFICIENT' END AS category FROM (SELECT *, "
    f"{rnd('(daily_actual - daily_normal) / daily_normal * 100.0')} AS daily_departure_pct FROM "
    f"(SELECT state, district, day, {rnd('avg(actual)')} AS daily_actual, {rnd('avg(normal)')} AS daily_normal "
    "FROM district_reports GROUP BY ALL))",
    "feature_rows": _select(FEATURE_ROWS, "lineitem"),
    "scored": _select(SCORED, "labels"),
    "entities": _select(ENTITIES, "lineitem"),
}
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def with_tables(sql: str) -> str:
    """Prepend the table definitions an oracle text mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in SQL_TABLES and name not in needed:
                visit(SQL_TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    sql = sql.strip()
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({SQL_TABLES[n]})" for n in needed)
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"


def registered_sources(t: Tables) -> DataFrame:
    """The source register: the sources of orders that are open or filled."""
    known = t.raw("orders").filter(F.col("o_orderstatus").isin("O", "F"))
    return known.select(F.concat(F.lit("SRC_"), "o_orderstatus").alias("source_id")).distinct()

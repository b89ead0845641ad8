"""Scans of the source files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slopecast.functions.columns import blank_to_null, number_or_null
from slopecast.session import settle

# Source header -> column name (fixed values of the telemetry export).
TELEMETRY_COLUMNS = {
    "SlNo": "sl_no", "Station": "station", "Agency": "agency", "State LGD Code": "state_lgd_code",
    "State": "state", "District LGD Code": "district_lgd_code", "District": "district",
    "Tehsil": "tehsil", "Block": "block", "Village": "village", "River": "river", "Basin": "basin",
    "Tributary": "tributary", "Subtributary": "subtributary", "SubSubtributary": "subsubtributary",
    "Local River": "local_river", "Latitude": "latitude", "Longitude": "longitude",
    "Data Acquisition Time": "timestamp", "Telemetry Hourly Rainfall (mm)": "rainfall_1h",
}
NUMERIC = ("latitude", "longitude", "rainfall_1h")
PERIOD_FOLDERS = ("1991_2020", "2021_2025", "2026_2030")
DAY_FIRST_FORMATS = ("dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")


def day_first_timestamp(c: Column) -> Column:
    """Day-first text to a timestamp; text in no known form is NULL."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DAY_FIRST_FORMATS])


def offset_timestamp(c: Column) -> Column:
    """ISO text with an offset to a UTC instant; text without an offset is rejected as NULL."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c.try_cast("timestamp"))


#: Column that takes the text of a line that does not have the file's columns.
BROKEN = "_broken"


def _with_broken(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, BROKEN)])


def _period() -> Column:
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return F.when(folder.isin(*PERIOD_FOLDERS), F.concat(folder, F.lit("_source"))).otherwise(folder)


def _telemetry_lines(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(_with_broken(list(TELEMETRY_COLUMNS)))
        .options(header=True, recursiveFileLookup=True, pathGlobFilter="*.csv", enforceSchema=False, columnNameOfCorruptRecord=BROKEN, columnPruning=False)
        .csv(path)
    )


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """All telemetry files below path, with file name and period folder as columns.

    Lines with too few or too many fields are no rows; broken_lines has them.
    """
    raw = _telemetry_lines(spark, path).filter(~_is_broken("SlNo"))
    cols = [
        (number_or_null(F.col(f"`{h}`")) if n in NUMERIC
         else day_first_timestamp(F.col(f"`{h}`")) if n == "timestamp"
         else blank_to_null(F.col(f"`{h}`"))).alias(n)
        for h, n in TELEMETRY_COLUMNS.items()
    ]
    return raw.select(*cols, F.col("_metadata.file_name").alias("source_file"), _period().alias("source_period"))


def _broken_text(first: str) -> Column:
    """The text of a broken line, NULL for others. A scan that reads nothing but this text is refused by Spark, so an
    empty piece of another column goes with it."""
    return F.concat(F.col(BROKEN), F.substring(F.coalesce(F.col(f"`{first}`"), F.lit("")), 1, 0))


def _is_broken(first: str) -> Column:
    return F.coalesce(F.length(_broken_text(first)) >= 0, F.lit(False))


def broken_lines(lines: DataFrame, first: str) -> DataFrame:
    """(source_file, source_period, line) of the lines that a scan sets aside: the quarantine table. first is any
    column of the file."""
    kept = lines.select(F.col("_metadata.file_name").alias("source_file"), _period().alias("source_period"), _broken_text(first).alias("line"))
    return kept.filter(F.length("line") >= 0)


def telemetry_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The broken lines of all telemetry files below path."""
    return broken_lines(_telemetry_lines(spark, path), next(iter(TELEMETRY_COLUMNS)))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, source_period, rows, broken) of every telemetry file, in one scan."""
    lines = _telemetry_lines(spark, path).select(F.col("_metadata.file_name").alias("source_file"), _period().alias("source_period"), _is_broken("SlNo").alias("bad"))
    bad = F.col("bad")
    return lines.groupBy("source_file", "source_period").agg(F.count_if(~bad).alias("rows"), F.count_if(bad).alias("broken"))


def unique_files(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length, digest, original, is_copy) of every text file below path; the first path of equal files is kept.

    Only files of equal length are read, and only as lines, so no file is held as one row however long it is.
    A file of a length of its own is no copy and has no digest; empty files are not listed.
    """
    files = (
        spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path).select("path", "length", F.col("_metadata.file_path").alias("_name"))  # names as the line scan gives them
    )
    files = settle(files, "files")  # the listing; contents are not read
    alike = files.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(files, "length").select("_name")
    names = settle(alike, "alike")
    if names.isEmpty():
        return files.select("path", "length", F.lit(None).cast("string").alias("digest"), F.col("path").alias("original"), F.lit(False).alias("is_copy"))
    digests = _digests(spark.read.options(recursiveFileLookup=True, pathGlobFilter=pattern, lineSep="\n").text(path), names)
    known = files.join(digests, "_name", "left").withColumn("_same", F.coalesce("digest", "path"))
    return mark_copies(known, "path", "_same").select("path", "length", "digest", "original", "is_copy")


def _digests(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(_name, digest) of the named files from their lines.

    A block of a file has the sums of two 48-bit hashes of its lines, plain and weighted by the line's place in
    the block, in exact arithmetic; the digest is the SHA-256 of the sums of all blocks in order. Files of
    one length are cut into the same blocks.
    """
    at = lines.select(F.col("_metadata.file_path").alias("_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    at = at.join(names, "_name", "left_semi")
    sums = [F.count(F.lit(1)).alias("n"), F.min("id").alias("first")]
    for k in (1, 2):
        h = F.xxhash64(F.lit(k), "value").bitwiseAND(F.lit((1 << 48) - 1)).cast("decimal(20,0)")
        sums += [F.sum(h).cast("decimal(38,0)").alias(f"h{k}"), F.sum(h * (F.col("id") % (1 << 33)).cast("decimal(11,0)")).cast("decimal(38,0)").alias(f"w{k}")]
    blocks = at.groupBy("_name", "block").agg(*sums)
    first = F.col("first") % (1 << 33)
    parts = F.concat_ws(",", "block", "n", *[x for k in (1, 2) for x in (f"h{k}", (F.col(f"w{k}") - F.col(f"h{k}") * first.cast("decimal(11,0)")).cast("string"))])
    return blocks.groupBy("_name").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", parts.alias("sums")))), lambda b: b["sums"]), ";"), 256).alias("digest"))


def mark_copies(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Add the smallest key with the same digest; the other rows are copies of it."""
    first = df.groupBy(digest).agg(F.min(key).alias("original"))
    return df.join(first, digest).withColumn("is_copy", F.col(key) != F.col("original"))


def _district_lines(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.options(header=True, multiLine=True, recursiveFileLookup=True, enforceSchema=False, columnNameOfCorruptRecord=BROKEN, columnPruning=False)
    names = reader.csv(path).columns
    return reader.schema(_with_broken(names)).csv(path)


def district_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The broken lines of all district reports below path."""
    lines = _district_lines(spark, path)
    return broken_lines(lines, lines.columns[0])


def read_district_days(spark: SparkSession, path: str) -> DataFrame:
    """District daily reports; header names may contain line breaks and repeated blanks.

    The first file's header gives the schema, and every file's header is checked against it: a file
    with other columns, or another order, is an error and not misread.
    """
    raw = _district_lines(spark, path)
    raw = raw.filter(~_is_broken(raw.columns[0])).drop(BROKEN)
    raw = raw.withColumnsRenamed({c: "_".join(c.lower().split()) for c in raw.columns})
    return raw.select(
        blank_to_null(F.col("state")).alias("state"),
        blank_to_null(F.col("district")).alias("district"),
        F.coalesce(*[F.to_date(F.try_to_timestamp("date", F.lit(f))) for f in ("dd-MM-yyyy", "yyyy-MM-dd")]).alias("date"),
        number_or_null(F.col("daily_actual")).alias("daily_actual"),
        number_or_null(F.col("daily_normal")).alias("daily_normal"),
        number_or_null(F.col("daily_departure_per")).alias("daily_departure_pct"),
    )


GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
FEATURE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("geometry", GEOMETRY),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
COLLECTION = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])


def _summed(pieces: Column, done) -> Column:
    """done(sum), where sum has the totals w, x and y of pieces (w, x, y), added up in one walk."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "wxy"])
    return F.aggregate(pieces, zero, lambda s, p: F.struct(*[(s[c] + p[c]).alias(c) for c in "wxy"]), done)


def _moments(pieces: Column) -> Column:
    """Centroid struct(x, y) of pieces (w, x, y) with x and y weighted by w; NULL without weight."""
    return _summed(pieces, lambda s: F.when(s["w"] > 0, F.struct((s["x"] / s["w"]).alias("x"), (s["y"] / s["w"]).alias("y"))))


def _steps(line: Column, piece) -> Column:
    """piece(a, b) for every two neighbours of a line."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), piece)


def _ring(ring: Column, sign: Column) -> Column:
    """(w, x, y) of a closed ring, its area counted with the given sign whatever its direction."""

    def piece(a: Column, b: Column) -> Column:
        w = a[0] * b[1] - b[0] * a[1]
        return F.struct(w.alias("w"), ((a[0] + b[0]) * w).alias("x"), ((a[1] + b[1]) * w).alias("y"))

    def turned(s: Column) -> Column:
        turn = sign * F.signum(s["w"])
        return F.struct((s["w"] * turn).alias("w"), (s["x"] * turn / 3.0).alias("x"), (s["y"] * turn / 3.0).alias("y"))

    return _summed(_steps(ring, piece), turned)


def polygons_centroid(polygons: Column) -> Column:
    """Area centroid of polygons; the rings after the first of each are holes."""
    rings = F.flatten(F.transform(polygons, lambda p: F.transform(p, lambda r, i: _ring(r, F.when(i == 0, 1.0).otherwise(-1.0)))))
    return _moments(rings)


def lines_centroid(lines: Column) -> Column:
    """Centroid of lines, weighted by length."""

    def piece(a: Column, b: Column) -> Column:
        length = F.hypot(b[0] - a[0], b[1] - a[1])
        return F.struct(length.alias("w"), ((a[0] + b[0]) / 2.0 * length).alias("x"), ((a[1] + b[1]) / 2.0 * length).alias("y"))

    return _moments(F.flatten(F.transform(lines, lambda line: _steps(line, piece))))


def points_centroid(points: Column) -> Column:
    return _moments(F.transform(points, lambda p: F.struct(F.lit(1.0).alias("w"), p[0].alias("x"), p[1].alias("y"))))


def geometry_centroid(kind: Column, coordinates: Column) -> Column:
    """Centroid struct(x, y) of a geometry: by area, else by length, else of its points."""

    def parsed(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    flat = F.coalesce(
        F.when(kind == "Point", F.array(parsed(1))), F.when(kind.isin("MultiPoint", "LineString"), parsed(2)),
        F.when(kind.isin("MultiLineString", "Polygon"), F.flatten(parsed(3))), F.when(kind == "MultiPolygon", F.flatten(F.flatten(parsed(4)))),
    )
    lines = F.coalesce(
        F.when(kind == "LineString", F.array(parsed(2))), F.when(kind.isin("MultiLineString", "Polygon"), parsed(3)),
        F.when(kind == "MultiPolygon", F.flatten(parsed(4))),
    )
    areas = F.coalesce(F.when(kind == "Polygon", F.array(parsed(3))), F.when(kind == "MultiPolygon", parsed(4)))
    return F.coalesce(polygons_centroid(areas), lines_centroid(lines), points_centroid(flat))


def read_inventory(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feature collections to one row per feature; the position is taken from the properties,
    else from the geometry's centroid, whatever its type. Features without coordinates, as geometry
    collections are, and without a position in the properties are skipped."""
    raw = spark.read.schema(COLLECTION).json(path, multiLine=multi_line)
    f = raw.select(F.explode("features").alias("f")).select("f.*").filter("geometry is not null")
    # made by a generator, which is not copied to each place that reads it, the filter included
    f = f.withColumn("_c", F.explode(F.array(geometry_centroid(F.col("geometry.type"), F.col("geometry.coordinates")))))
    p = F.col("properties")
    return f.select(
        F.col("id").alias("feature_id"),
        p["SlideNo"].alias("slide_no"), p["State"].alias("state"), p["District"].alias("district"),
        p["Year"].try_cast("int").alias("year"),
        F.coalesce(p["Latitude"].try_cast("double"), F.col("_c.y")).alias("latitude"),
        F.coalesce(p["Longitude"].try_cast("double"), F.col("_c.x")).alias("longitude"),
        F.col("geometry.type").alias("geometry_type"),
    ).filter("latitude is not null and longitude is not null")


TILE = "struct<tile:bigint,width:int,elevations:array<double>>"


def read_tile_cells(payload: DataFrame, column: str) -> DataFrame:
    """JSON tile payloads to one row per cell."""
    parsed = payload.select(F.from_json(column, TILE).alias("t")).select("t.tile", "t.width", F.posexplode("t.elevations"))
    return parsed.select(
        "tile", F.floor(F.col("pos") / F.col("width")).alias("cell_row"),
        (F.col("pos") % F.col("width")).alias("cell_col"), F.col("col").alias("elev"),
    )

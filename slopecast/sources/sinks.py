"""Sinks: feature tables and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.functions.columns import rounded


def write_features(df: DataFrame, path: str, columns: Sequence[str], date: str = "date") -> None:
    """Write the contract columns, one folder per date; only the dates present are replaced.

    The rebalance hint splits a heavy date over several files and merges small ones.
    """
    (
        df.select(*columns, date)
        .hint("rebalance", date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date)
        .parquet(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write a one-row report as JSON."""
    report.write.mode("overwrite").json(path)


def run_report(tele: DataFrame, usable: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: what came in, what was removed and what was kept."""
    came = tele.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("ts").isNull()).alias("undated"),
        F.count_if(F.col("rainfall_1h") < 0).alias("negative"),
        F.count_if(F.col("rainfall_1h").isNull()).alias("missing"),
        F.count_distinct("source_file").alias("files"),
    )
    left = usable.agg(F.count(F.lit(1)).alias("rows_usable"))
    out = kept.agg(
        F.count(F.lit(1)).alias("rows_kept"),
        F.count_distinct("station_key").alias("stations"),
        F.count_distinct("state").alias("states"),
        F.unix_micros(F.min("ts")).alias("first_us"),
        F.unix_micros(F.max("ts")).alias("last_us"),
    )
    merged = came.unionByName(left, allowMissingColumns=True).unionByName(out, allowMissingColumns=True)
    one = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
    return one.withColumn("removed", F.col("rows_in") - F.col("rows_usable")).withColumn(
        "collapsed", F.col("rows_usable") - F.col("rows_kept")
    )


def source_coverage(rows: DataFrame, source: str, key: str, day: str) -> DataFrame:
    """Per source: events, first and last day, the share of the days between with an event, and a checksum: the sum of
    32 bits of the MD5 of every key, the same in any order."""
    part = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        rounded(F.count_distinct(day) / (F.max(day) - F.min(day) + 1)).alias("day_coverage"), F.sum(part).alias("checksum"),
    )

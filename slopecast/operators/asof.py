"""As-of join: the reading of a key that is nearest in time to each query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopecast.functions.columns import HOUR_US


def asof(
    queries: DataFrame,
    readings: DataFrame,
    key: str,
    query_time: str,
    reading_time: str,
    pick: Sequence[str],
    name: str = "obs",
    direction: str = "nearest",
    bucket_hours: int = 24,
) -> DataFrame:
    """Add the reading as a struct (_t, *pick); no reading of the key gives NULL.

    direction "nearest" takes the smaller absolute gap (the earlier one of a tie), "backward"
    never looks at a later reading. Readings at one instant are settled by the order of pick.

    A key is cut into time buckets: windows run inside a bucket, and what lies in other buckets
    comes from a table with the first and last reading of every bucket. A busy key is therefore
    never sorted in one task.
    """
    if direction not in ("nearest", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    size = bucket_hours * HOUR_US
    r = (
        readings.filter(F.col(reading_time).isNotNull())
        .groupBy(F.col(key).alias("_k"), F.unix_micros(reading_time).alias("_t"))
        .agg(F.min(F.struct(*pick)).alias("_p"))
        .select("_k", "_t", F.struct("_t", "_p.*").alias("_r"), F.lit(0).alias("_q"))
    )
    q = (
        queries.filter(F.col(query_time).isNotNull())
        .select(F.col(key).alias("_k"), F.unix_micros(query_time).alias("_t"))
        .distinct()
        .withColumn("_q", F.lit(1))
    )
    bucket = F.floor(F.col("_t") / size)
    rows = r.unionByName(q, allowMissingColumns=True).withColumn("_b", bucket)
    inside = Window.partitionBy("_k", "_b")
    up = inside.orderBy("_t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.desc("_t"), "_q").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_before": F.last("_r", ignorenulls=True).over(up),
        "_after": F.last("_r", ignorenulls=True).over(down),
    }).filter("_q = 1")
    edges = (
        r.select("_k", bucket.alias("_b"), "_r")
        .unionByName(q.select("_k", bucket.alias("_b")), allowMissingColumns=True)
        .groupBy("_k", "_b")
        .agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    )
    line = Window.partitionBy("_k")
    earlier = line.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    later = line.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "_k", "_b",
        F.last("_last", ignorenulls=True).over(earlier).alias("_prev"),
        F.last("_first", ignorenulls=True).over(later).alias("_next"),
    )
    hit = rows.join(edges, ["_k", "_b"]).select(
        "_k", "_t", F.coalesce("_before", "_prev").alias("_x"), F.coalesce("_after", "_next").alias("_y")
    )
    earlier_wins = F.col("_y").isNull() | (F.col("_t") - F.col("_x._t") <= F.col("_y._t") - F.col("_t"))
    best = F.col("_x") if direction == "backward" else F.when(F.col("_x").isNotNull() & earlier_wins, F.col("_x")).otherwise(F.col("_y"))
    hit = hit.select("_k", "_t", best.alias(name))
    return queries.join(
        hit, (F.col(key) == F.col("_k")) & (F.unix_micros(query_time) == F.col("_t")), "left"
    ).drop("_k", "_t")

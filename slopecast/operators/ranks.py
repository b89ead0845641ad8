"""Running totals, row numbers and exact quantiles that never sort a whole group in one task.

Each job splits the order into buckets (a monotone function of the order key), sums every
bucket, turns the small bucket table into offsets, and only sorts inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.session import settle


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    totals: dict[str, Column],
) -> DataFrame:
    """Add, per name in totals, the inclusive running sum of its column in the given order.

    bucket must not decrease along order; ties in order are broken arbitrarily.
    """
    keys = [*groups, "_bucket"]
    work = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": c for n, c in totals.items()})
    offsets = work.groupBy(*keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in totals])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(inside) for n in totals})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = work.join(offsets, same)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_v_{n}") + F.col(f"_o_{n}")).alias(n) for n in totals],
    )


def in_ranges(df: DataFrame, order: Sequence[str], label: str = "ranges") -> DataFrame:
    """df, written in ranges of its order, with _bucket: the number of the range.

    The ranges follow the data, so that a crowded stretch of values is cut into as many buckets as
    its rows need; equal keys share a bucket, and buckets do not decrease along the order.
    """
    return settle(df.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id().cast("bigint")), label)


def numbered(
    df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """1-based row number per group."""
    return running_totals(df, groups, bucket, order, {name: F.lit(1).cast("bigint")})


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    quantiles: dict[str, float],
) -> DataFrame:
    """Exact quantiles with linear interpolation; NULL values are skipped.

    Works on value counts, so repeated values cost one row, and sorts only inside ranges of values
    that follow the data.
    """
    known = df.filter(F.col(value).isNotNull())
    return quantiles_of_counts(known.groupBy(*groups, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n")), groups, quantiles)


def quantiles_of_counts(counts: DataFrame, groups: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """The same from the number of rows (_n) of each value (_x)."""
    keep = list(groups)
    if not keep:
        counts, groups = counts.withColumn("_all", F.lit(0)), ["_all"]
    counts = in_ranges(counts, [*groups, "_x"], "counts")
    span = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    span = span.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_size")
    counts = counts.join(span, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
    cum = running_totals(counts, groups, F.col("_bucket"), [F.col("_x")], {"_end": F.col("_n")})
    # a row goes on once for each quantile that lies in it, so the plan does not grow with the list of quantiles
    start, last = F.col("_end") - F.col("_n"), F.col("_size") - 1
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(quantiles.values())])
    hits = F.filter(wanted, lambda w: (F.floor(w["q"] * last) < F.col("_end")) & (F.ceil(w["q"] * last) >= start))
    hit = cum.withColumn("_w", F.explode(hits)).withColumn("_pos", F.col("_w.q") * last)
    inside = lambda at: F.max(F.when((start <= at) & (at < F.col("_end")), F.col("_x")))
    each = hit.groupBy(*groups, F.col("_w.i").alias("_i")).agg(
        inside(F.floor("_pos")).alias("_lo"), inside(F.ceil("_pos")).alias("_hi"), F.max(F.col("_pos") - F.floor("_pos")).alias("_w"),
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    out = each.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_i", value.alias("v")))).alias("_of"))
    return out.select(*keep, *[F.element_at("_of", F.lit(i)).alias(n) for i, n in enumerate(quantiles)])

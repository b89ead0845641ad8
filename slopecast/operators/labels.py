"""Label construction: negative candidates, quotas, bootstrap draws, splits, blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.functions.columns import rounded
from slopecast.operators.ranks import in_ranges, numbered
from slopecast.operators.outlines import outline_cells, polygon_edges, state_of_point
from slopecast.operators.spatial import nearest_site
from slopecast.session import settle

CHUNK = 10_000
#: Rows of a table that a task of its bootstrap has, about.
TASK_ROWS = 131_072


def uniform(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from the given parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def pick_index(n: Column, *parts: Column) -> Column:
    """Repeatable index in 0..n-1 from the given parts."""
    return F.floor(uniform(*parts) * n)


def negative_candidates(
    positives: DataFrame, vertices: DataFrame, seed: int = 42, exclusion_km: float = 1.0, first_draws: int = 3, max_draws: int = 500
) -> DataFrame:
    """As many candidates as positives per state: uniform in the box, inside the outline, at least
    exclusion_km from every positive. They are candidates, not confirmed absences.

    Draws of a state are numbered, and the first that pass are taken, so the result does not depend
    on the rounds: the first makes first_draws per place wanted, later ones as many as the measured
    acceptance asks for. A state that is not filled after max_draws per place raises. Draws are made
    in chunks that Spark spreads, so one state with most positives is not one task. What returns to
    the driver is one row per outline and round.
    """
    index, deepest = outline_cells(vertices)
    outlines = settle(index, "outlines"), deepest
    quota = (
        state_of_point(positives, outlines).filter("inside_state is not null")
        .groupBy(F.col("inside_state").alias("state")).agg(F.count(F.lit(1)).alias("quota"))
    )
    e = polygon_edges(vertices)
    box = e.groupBy("state").agg(
        F.min("x1").alias("x0"), F.max("x1").alias("xm"), F.min("y1").alias("y0"), F.max("y1").alias("ym")
    )
    plan = settle(quota.join(box, "state"), "quota")
    spark = plan.sparkSession

    def accepted(spans: list[tuple[str, int, int]]) -> DataFrame:
        """Draws first + 1 to last of each state that pass both rules."""
        asked = spark.createDataFrame(spans, "state string, _from long, _to long")
        cut = F.sequence(F.floor(F.col("_from") / CHUNK), F.floor((F.col("_to") - 1) / CHUNK))
        chunks = plan.join(asked, "state").withColumn("_c", F.explode(cut)).repartition("state", "_c")
        low, high = F.greatest(F.col("_from"), F.col("_c") * CHUNK), F.least(F.col("_to"), (F.col("_c") + 1) * CHUNK)
        draws = chunks.withColumn("draw", F.explode(F.sequence(low + 1, high)))
        base = [F.lit(str(seed)), F.col("state"), F.col("draw").cast("string")]
        cand = draws.select(
            "state", "quota", "draw",
            (F.col("x0") + (F.col("xm") - F.col("x0")) * uniform(*base, F.lit("lon"))).alias("longitude"),
            (F.col("y0") + (F.col("ym") - F.col("y0")) * uniform(*base, F.lit("lat"))).alias("latitude"),
        )
        inside = state_of_point(cand, outlines).filter(F.col("inside_state") == F.col("state")).drop("inside_state")
        near = nearest_site(inside, positives.select("latitude", "longitude", F.lit(0).alias("_any")), ["_any"], "_near")
        return settle(near.filter(F.col("_near").isNull() | (F.col("_near.distance") > exclusion_km)).drop("_near"), "candidates")

    wanted = {r["state"]: r["quota"] for r in plan.select("state", "quota").collect()}
    drawn, passed, parts = dict.fromkeys(wanted, 0), dict.fromkeys(wanted, 0), []
    while short := [s for s in sorted(wanted) if passed[s] < wanted[s]]:
        spans = []
        for s in short:
            rate = max(passed[s], 1) / max(drawn[s], 1)
            more = wanted[s] * first_draws if not drawn[s] else int(1.2 * (wanted[s] - passed[s]) / rate) + 16
            last = min(drawn[s] + more, wanted[s] * max_draws)
            if last <= drawn[s]:
                raise ValueError(f"{s}: {passed[s]} of {wanted[s]} candidates after {drawn[s]} draws")
            spans.append((s, drawn[s], last))
            drawn[s] = last
        parts.append(accepted(spans))
        for r in parts[-1].groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect():
            passed[r["state"]] += r["n"]
    if not parts:
        return spark.createDataFrame([], "state string, draw long, latitude double, longitude double, candidate_no long")
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    ranked = numbered(kept, ["state"], F.floor(F.col("draw") / CHUNK), [F.col("draw")])
    return ranked.filter(F.col("rn") <= F.col("quota")).select("state", "draw", "latitude", "longitude", F.col("rn").alias("candidate_no"))


def quota_allocation(df: DataFrame, group: str, total: int) -> DataFrame:
    """Split a total over the groups by share; the rounding rest goes to the largest group.

    The windows run on the group table, one row per group.
    """
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("_raw", F.floor(F.col("members") * float(total) / F.sum("members").over(everything) + 0.5))
    per = per.withColumns({
        "_rest": F.lit(total) - F.sum("_raw").over(everything),
        "_rank": F.row_number().over(everything.orderBy(F.desc("members"), group)),
    })
    return per.select(group, "members", (F.col("_raw") + F.when(F.col("_rank") == 1, F.col("_rest")).otherwise(0)).alias("quota"))


def stratified_bootstrap(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Half of the table size drawn with replacement from each of the two labels.

    Returns (label, draw, key). Draw j of a label takes the row whose number is a hash of j. Draws
    are made in chunks by their number, so a label with one row is not one task. Rows and draws meet in tasks
    whose number follows the table: by the bytes of such narrow rows, too many would share a task.
    """
    tasks = max(1, math.ceil(df.count() / TASK_ROWS))
    rows = numbered(in_ranges(df.select(label, key), [label, key]), [label], F.col("_bucket"), [F.col(key)])
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_half", F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) / 2))  # one row per label
    chunks = sizes.filter("_half > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_half") - 1) / CHUNK)))).repartition(tasks, "_l", "_c")
    draws = chunks.withColumn("draw", F.explode(F.sequence(F.col("_c") * CHUNK, F.least(F.col("_half"), (F.col("_c") + 1) * CHUNK) - 1)))
    chosen = draws.select(
        "_l", "draw", (pick_index(F.col("_n"), F.lit(str(seed)), F.col("_l").cast("string"), F.col("draw").cast("string")) + 1).alias("_pick")
    )
    chosen, rows = chosen.repartition(tasks, "_l", "_pick"), rows.repartition(tasks, label, "rn")
    return chosen.join(rows, (F.col("_l") == F.col(label)) & (F.col("_pick") == F.col("rn"))).select(label, "draw", key)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.75, seed: int = 42) -> DataFrame:
    """Add part: the share of each class with the smallest hashes is train, the rest test."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.withColumn("_h", h)
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = numbered(hashed, [label], bucket, [F.col("_h"), F.col(key)])
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    part = F.when(F.col("rn") <= F.floor(F.col("_n") * share + 0.5), "train").otherwise("test")
    return ranked.join(sizes, F.col(label) == F.col("_l")).withColumn("part", part).drop("_h", "rn", "_l", "_n")


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """Repeatable fold number of a row."""
    return pick_index(F.lit(folds), F.lit(str(seed)), key.cast("string"), F.lit("fold")).cast("int")


def spatial_block(lat: Column, lon: Column) -> Column:
    """Name of the 1-degree block."""
    return F.concat(F.lit("B_"), F.floor(lat).cast("string"), F.lit("_"), F.floor(lon).cast("string"))


def block_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts and centroid per block."""
    return df.groupBy(spatial_block(F.col("latitude"), F.col("longitude")).alias("block")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col(label) == 1).alias("pos_count"),
        F.count_if(F.col(label) == 0).alias("neg_count"), F.avg("latitude").alias("mean_lat"), F.avg("longitude").alias("mean_lon"),
    )


def label_balance(df: DataFrame, state: str, label: str) -> DataFrame:
    """Positives and negatives per state, and whether they differ."""
    wide = df.groupBy(state).pivot(label, [0, 1]).agg(F.count(F.lit(1)))
    neg, pos = F.coalesce(F.col("0"), F.lit(0)), F.coalesce(F.col("1"), F.lit(0))
    return wide.select(state, pos.alias("positives"), neg.alias("negatives"), (pos != neg).alias("imbalanced"))


def stable_order(df: DataFrame, label: str, state: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(label), state, key)


def mean_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in ("mean_lat", "mean_lon")})

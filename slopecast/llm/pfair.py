"""Mixing sources to target weights by Pfair block scheduling."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slopecast.llm.common import map_batches, settle

BLOCK = 16
#: Slots of the plan that are made at once.
SLOTS = 4096
#: Default weights are the shares of the sources to this power.
EXPONENT = 0.8
#: Rows of a numbering bucket, on average.
BUCKET_ROWS = 4_000
MISSING = "\x00missing"


def shares(weights: Mapping[str, float]) -> dict[str, Fraction]:
    """The exact target of each source; weights count as the decimals that they are written as."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(repr(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: x / total for s, x in exact.items()}


def whole_weights(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Slots of each source in a mix of `slots`, rounded: largest remainders first, slots in all.

    For a report or a mix of that length; schedule keeps to the targets themselves.
    """
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources need at least as many slots")
    exact = {s: x * slots for s, x in shares(weights).items()}
    out = {s: int(x) for s, x in exact.items()}
    rest = slots - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:rest]:
        out[s] += 1
    return out


def plan(targets: Mapping[str, Fraction], blocks: Mapping[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot), slots in order, until every source had its blocks.

    Block j (from 0) of a source with target w is released at floor(j / w) and due by
    ceil((j + 1) / w), in exact arithmetic. Each slot takes the released block with the earliest
    deadline, ties by name. The targets add up to one, so every block meets its window, and a source
    is never a block or more from its share, however long the mix.
    """
    names = sorted(targets)
    waiting = [(0, s, 0) for s in names]
    ready: list[tuple[int, str, int, int]] = []
    upside = {s: (targets[s].numerator, targets[s].denominator) for s in names}
    left = sum(1 for s in names if blocks[s] > 0)
    slot = 0
    while left:
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            p, n = upside[s]
            heapq.heappush(ready, (-(-(j + 1) * n // p), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline, slot
        left -= j + 1 == blocks[s]
        p, n = upside[s]
        heapq.heappush(waiting, ((j + 1) * n // p, s, j + 1))
        slot += 1


def period(parts: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """The plan of whole weights over one period, after which all is as at the start."""
    used = {s: p for s, p in parts.items() if p}
    return list(plan({s: Fraction(p, sum(used.values())) for s, p in used.items()}, used))


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Rows of each source; the sources of a mix are a list with one weight each, which the driver holds."""
    rows = docs.groupBy(_source(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["s"]: r["n"] for r in rows}


def plan_table(spark: SparkSession, targets: Mapping[str, Fraction], blocks: Mapping[str, int], slots: int) -> DataFrame:
    """The plan as (__source, __block, __release, __deadline, __slot): one task makes it, `slots` rows at a time."""
    schema = "__source string, __block long, __release long, __deadline long, __slot long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = plan(targets, blocks)
            while rows := list(itertools.islice(made, slots)):
                s, *numbers = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)],
                    names=["__source", "__block", "__release", "__deadline", "__slot"],
                )

    return settle(map_batches(spark.range(0, 1, 1, 1), run, schema), "plan")


def _source(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def numbered(docs: DataFrame, counts: Mapping[str, int], id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with __source and __rank: its place, from 0, in the shuffled order of its source.

    The order is by a seeded hash of id and text. A source is cut into hash buckets of about
    BUCKET_ROWS rows; each bucket is numbered by itself and shifted by the rows of earlier ones, so
    no window holds a hot source.
    """
    spread = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(seed))
    buckets = max(1, -(-max(counts.values(), default=1) // BUCKET_ROWS))
    tagged = docs.withColumn("__source", _source(source_col)).withColumn("__spread", spread)
    tagged = tagged.withColumn("__bucket", F.pmod(F.shiftright("__spread", 20), F.lit(buckets)).cast("int"))
    sizes = tagged.groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row per source and bucket: rows / BUCKET_ROWS of the largest source times the sources
    before = F.sum("__n").over(W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.select("__source", "__bucket", F.coalesce(before, F.lit(0)).alias("__shift"))
    order = W.partitionBy("__source", "__bucket").orderBy("__spread", F.col(id_col).cast("string"), F.col(text_col))
    placed = tagged.withColumn("__place", F.row_number().over(order) - 1)
    joined = placed.join(shifts, ["__source", "__bucket"])
    return joined.withColumn("__rank", F.col("__place") + F.col("__shift")).drop("__bucket", "__spread", "__place", "__shift")


def schedule(
    docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, slots: int = SLOTS, seed: int = 42,
) -> DataFrame:
    """docs in the mix, with __source, __epoch, __block, __release, __deadline, __slot, __position.

    Each source, shuffled, is read again and again and cut into blocks of `block` documents; blocks
    take slots by `plan`. The mix ends at the slot by which every source has been read once, so
    every document is in it, and those of sources above their natural share come in several epochs.
    After any number of slots, the blocks of a source differ from target times slots by less than
    one. weights (by source; null sources under MISSING) default to the shares to the power
    EXPONENT; a source without a weight is an error, one without documents is left out. Positions
    are the order of the mix. An empty table gives an empty mix. Repeated rows are separate rows.
    """
    counts = source_counts(docs, source_col)
    spark = docs.sparkSession
    if weights is None:
        weights = {s: n**EXPONENT for s, n in counts.items()}
    if missing := set(counts) - set(weights):
        raise ValueError(f"no weight for {sorted(missing)[:5]}")
    targets = shares({s: weights[s] for s in sorted(counts)})
    slotted = plan_table(spark, targets, {s: -(-n // block) for s, n in counts.items()}, slots)
    taken = {r["__source"]: r["n"] for r in slotted.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one row a source, as in the driver's list
    info = spark.createDataFrame([(s, counts[s], taken.get(s, 0) * block) for s in counts], "__source string, __count long, __taken long")
    ranked = numbered(docs, counts, id_col, text_col, source_col, seed).join(F.broadcast(info), "__source")
    copies = ranked.withColumn("__epoch", F.explode(F.expr("sequence(0L, (__taken - __rank - 1) div __count)")))
    turn = F.col("__epoch") * F.col("__count") + F.col("__rank")
    blocks = copies.withColumn("__turn", turn).withColumn("__block", F.expr(f"__turn div {block}"))
    timed = blocks.join(slotted, ["__source", "__block"])
    return timed.select(
        *[timed[c] for c in docs.columns], "__source", "__epoch", "__block", "__release", "__deadline", "__slot",
        (F.col("__slot") * block + F.expr(f"__turn % {block}")).alias("__position"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, in ranges of its order, with the columns of docs only."""
    plan = schedule(docs, weights, id_col, text_col, source_col)
    return plan.repartitionByRange("__position").sortWithinPartitions("__position").select(*docs.columns)

"""Structured Streaming jobs over telemetry."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slopecast import fixed
from slopecast.functions import hazard
from slopecast.functions.columns import HOUR_US, rounded
from slopecast.functions.rainfall import ingested

HOUR_MS = 3_600_000
#: Parts that the places of a station are dealt in where hours are given to them.
SHARES = 16
#: What the score of a place follows from, besides the hour.
KIND = ("station_key", "static_score", "tier")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(out: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append it to a Parquet table, exactly once."""
    q = (
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def ingest(stream: DataFrame) -> DataFrame:
    """The batch rule for usable rows, applied to a stream."""
    return ingested(stream)


def dedup(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop re-deliveries of the same (station, time, amount) inside the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["station_key", "ts", "rainfall_1h"])


def station_day(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily totals per station, emitted when the day is closed."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy("station_key", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("rainfall_1h").alias("rainfall_mm"), F.count("rainfall_1h").alias("valid_readings"))
        .select("station_key", F.col("w.start").alias("day_start"), "rainfall_mm", "valid_readings")
    )


class HourWindows(StatefulProcessor):
    """Trailing sums of a station over several window lengths, from its hourly sums.

    The state is a map with one entry an hour, never more than the longest window holds; a row in updates one
    entry and is in no window table. With every_hour, each hour end up to the watermark has a row while
    a window holds an hour with readings, and an event-time timer wakes the station for the next one;
    without, only the hours that have readings do, and a timer drops the state of a station that is silent for the
    longest window. Hours are counted by their ends since 1970.
    """

    def __init__(self, spans: list[int], every_hour: bool):
        self.spans, self.longest, self.every_hour = spans, max(spans), every_hour

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "mm double, obs bigint")
        self.done = handle.getValueState("done", "hour bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = {int(h): (float(mm), int(obs)) for pdf in rows for h, mm, obs in zip(pdf["hour"], pdf["mm"], pdf["obs"])}
        held = self._held()
        known = held | fresh
        if self.every_hour:
            done = self.done.get()[0] if self.done.exists() else min(known) - 1
            ends = np.arange(done + 1, max(max(fresh), self._closed(timerValues)) + 1)
        else:
            ends = np.array(sorted(fresh))
        yield from self._advance(key, held, known, ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        ends = np.arange(self.done.get()[0] + 1, self._closed(timerValues) + 1)
        yield from self._advance(key, held, held, ends, quiet=not self.every_hour)

    def _held(self) -> dict[int, tuple[float, int]]:
        return {int(h[0]): (v[0], int(v[1])) for h, v in self.hours.iterator()} if self.hours.exists() else {}

    def _closed(self, timerValues) -> int:
        return timerValues.getCurrentWatermarkInMs() // HOUR_MS

    def _advance(self, key, held, known, ends: np.ndarray, quiet: bool = False) -> Iterator[pd.DataFrame]:
        """Rows of the given window ends; the state is cut to the hours that later ends can see."""
        out = self._sums(known, ends)
        last = int(ends[-1]) if len(ends) else self.done.get()[0]
        kept = {h for h in known if h > last + 1 - self.longest}
        for h in held.keys() - kept:
            self.hours.removeKey((h,))
        for h in kept - held.keys():
            self.hours.updateValue((h,), known[h])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.done.update((last,))
            self.handle.registerTimer((last + 1 if self.every_hour else max(kept) + self.longest) * HOUR_MS)
        else:
            self.hours.clear()
            self.done.clear()
        if len(out) and not quiet:
            yield out.assign(station_key=key[0])[["station_key", *out.columns]]

    def _sums(self, known: dict[int, tuple[float, int]], ends: np.ndarray) -> pd.DataFrame:
        t = np.array(sorted(known), np.int64)
        mm = np.concatenate([[0.0], np.cumsum([known[h][0] for h in t.tolist()])])
        obs = np.concatenate([[0], np.cumsum([known[h][1] for h in t.tolist()], dtype=np.int64)])
        high = np.searchsorted(t, ends, "right")
        ends, high = (x[high > np.searchsorted(t, ends - self.longest, "right")] for x in (ends, high))
        columns: dict[str, np.ndarray] = {"hour": ends}
        for n in self.spans:
            low = np.searchsorted(t, ends - n, "right")
            columns |= {f"mm_{n}": mm[high] - mm[low], f"obs_{n}": obs[high] - obs[low], f"hours_{n}": high - low}
        return pd.DataFrame(columns)

    def close(self) -> None:
        pass


def hour_windows(stream: DataFrame, spans: list[int], every_hour: bool, delay: str = "1 hour") -> DataFrame:
    """(station_key, at, and per length n: mm_n, obs_n, hours_n) at closed hour ends, of the trailing n hours:
    amount, readings with an amount, and hours with any reading. Partial sums by the hour come first, so
    Python sees one row a station and hour."""
    hourly = (
        stream.withWatermark("ts", delay)
        .groupBy("station_key", F.window("ts", "1 hour").alias("h"))
        .agg(F.coalesce(F.sum("rainfall_1h"), F.lit(0.0)).alias("mm"), F.count("rainfall_1h").alias("obs"))
        .select("station_key", F.window_time("h").alias("at"), (F.unix_seconds("h.end") / 3600).cast("bigint").alias("hour"), "mm", "obs")
    )
    fields = ", ".join(f"mm_{n} double, obs_{n} bigint, hours_{n} bigint" for n in spans)
    out = hourly.groupBy("station_key").transformWithStateInPandas(
        statefulProcessor=HourWindows(spans, every_hour), outputStructType=f"station_key string, hour bigint, {fields}", outputMode="append", timeMode="EventTime",
    )
    return out.withColumn("at", F.timestamp_seconds(F.col("hour") * 3600)).drop("hour")


def sliding_rain(stream: DataFrame, expected: dict[int, float], delay: str = "1 hour") -> DataFrame:
    """(station_key, hours, window_end, rainfall_sum, rainfall_obs, coverage): sliding totals by whole hours of
    all the lengths in expected, from one stream; closed windows with any reading."""
    sums = hour_windows(stream, list(expected), True, delay)
    windows = [
        F.struct(F.lit(n).alias("hours"), F.when(F.col(f"obs_{n}") > 0, F.col(f"mm_{n}")).alias("mm"), F.col(f"obs_{n}").alias("obs"), F.col(f"hours_{n}").alias("any"), F.lit(float(x)).alias("of"))
        for n, x in expected.items()
    ]
    each = sums.select("station_key", F.col("at").alias("window_end"), F.inline(F.array(*windows))).where("any > 0")
    return each.select("station_key", "hours", "window_end", F.col("mm").alias("rainfall_sum"), F.col("obs").alias("rainfall_obs"), F.least(F.col("obs") / F.col("of"), F.lit(1.0)).alias("coverage"))


class FreshnessProcessor(StatefulProcessor):
    """Keeps the latest reading time of a station and reports silences longer than the limit.

    A batch of a station is reduced to the first and last time of each slot of the limit's length,
    chunk by chunk, so memory follows the time span and not the number of readings. No silence
    can hide inside a slot.
    """

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, tuple[int, int]] = {}
        for pdf in rows:
            for slot, lo, hi in pdf["t_ms"].groupby(pdf["t_ms"] // self.limit).agg(["min", "max"]).itertuples():
                a, b = slots.get(slot, (lo, hi))
                slots[slot] = (min(a, int(lo)), max(b, int(hi)))
        times = [int(t) for slot in sorted(slots) for t in slots[slot]]
        last = self.last.get()[0] if self.last.exists() else None
        stale = []
        for t in times:
            if last is not None and t > last + self.limit:
                stale.append(last + self.limit)
            if last is None or t > last:
                last = t
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.limit)
        self.last.update((last,))
        if stale:
            yield pd.DataFrame({"station_key": key[0], "kind": "STALE", "t_ms": stale})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"station_key": [key[0]], "kind": ["STALE"], "t_ms": [int(expiredTimerInfo.getExpiryTimeInMs())]})

    def close(self) -> None:
        pass


def freshness(stream: DataFrame, max_age_hours: float = 6.0, delay: str = "1 hour") -> DataFrame:
    """STALE events at the moment a station has been silent for max_age_hours."""
    timed = stream.withWatermark("ts", delay).select("station_key", "ts", F.unix_millis("ts").alias("t_ms"))
    return timed.groupBy("station_key").transformWithStateInPandas(
        statefulProcessor=FreshnessProcessor(int(max_age_hours * 3_600_000)),
        outputStructType="station_key string, kind string, t_ms bigint",
        outputMode="append", timeMode="EventTime",
    )


def window_rain(stream: DataFrame, expected: dict[str, float], delay: str = "1 hour") -> DataFrame:
    """Rain of the last hour, 24 h, 3 d and 7 d at the end of every closed hour with a reading.

    Returns (station_key, at, rainfall_1h, rainfall_24h, rainfall_3d, rainfall_7d, quality, status).
    All windows come from one state of hourly sums (HourWindows). A window with less than the required
    share of its expected readings has no amount, and makes the quality PARTIAL.
    """
    hours = {w: fixed.WINDOW_HOURS[w] for w in expected}
    closed = hour_windows(stream, [1, *hours.values()], False, delay)
    full = {w: F.col(f"obs_{hours[w]}") >= x * fixed.MIN_COVERAGE for w, x in expected.items()}
    lacking = ~functools.reduce(Column.__and__, full.values())
    missing = F.col("obs_1") == 0
    return closed.select(
        "station_key", "at", F.when(~missing, rounded(F.col("mm_1"))).alias("rainfall_1h"),
        *[F.when(full[w], rounded(F.col(f"mm_{hours[w]}"))).alias(f"rainfall_{w}") for w in expected],
        F.when(missing, "MISSING").when(lacking, "PARTIAL").otherwise("GOOD").alias("quality"),
        F.when(missing, "MISSING").otherwise("OK").alias("status"),
    )


class AlertProcessor(StatefulProcessor):
    """Emits a row when a place enters a HIGH or CRITICAL level it was not in before.

    The state is the newest time seen and its level; rows that are not newer are too late to change
    it and are ignored. A place has one row an hour, so a micro-batch holds its hours, not readings.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "t_us bigint, level string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, level = self.newest.get() if self.newest.exists() else (None, None)
        levels: dict[int, str] = {}
        for pdf in rows:
            for t, risk in zip(pdf["t_us"].tolist(), pdf["risk_level"].tolist()):
                if at is None or t > at:
                    levels[t] = risk
        found = []
        for t in sorted(levels):
            if levels[t] in ("HIGH", "CRITICAL") and levels[t] != level:
                found.append((t, levels[t]))
            at, level = t, levels[t]
        if levels:
            self.newest.update((at, level))
        if found:
            times, risks = zip(*found)
            yield pd.DataFrame({"station_key": key[0], "place_id": key[1], "t_us": times, "risk_level": risks})

    def close(self) -> None:
        pass


def alerts(scored: DataFrame) -> DataFrame:
    """Transitions into HIGH or CRITICAL per station and place; scored has at and risk_level, one row an hour."""
    narrow = scored.select("station_key", "place_id", F.unix_micros("at").alias("t_us"), "risk_level")
    return narrow.groupBy("station_key", "place_id").transformWithStateInPandas(
        statefulProcessor=AlertProcessor(),
        outputStructType="station_key string, place_id bigint, t_us bigint, risk_level string",
        outputMode="append", timeMode="None",
    )


def score_stream(stream: DataFrame, places: DataFrame, expected: dict[str, float], delay: str = "1 hour") -> DataFrame:
    """Closed hours joined to their static places (station_key, place_id, static_score, tier), then
    triggered on all four windows and fused.

    A place counts by its static score and tier only, so an hour is scored once for each of those that the places of
    its station have, and then given to the places.
    """
    kinds = places.select(*KIND).distinct()
    scored = hazard.fuse(hazard.rain_trigger(window_rain(stream, expected, delay)).join(kinds, "station_key"))
    return given(scored, places, KIND)


def given(rows: DataFrame, places: DataFrame, same: Sequence[str]) -> DataFrame:
    """rows joined to the places with equal columns same (station_key, which is not null, and others). Places are dealt
    in SHARES, so that those of a station are not one task."""
    rows = rows.withColumn("_share", F.explode(F.array(*[F.lit(k) for k in range(SHARES)])))
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {c: f"_own_{c}" for c in same}
    held = places.withColumnsRenamed(own).withColumn("_part", F.pmod(F.xxhash64("place_id"), F.lit(SHARES)).cast("int"))
    held = held.repartition(tasks, *own.values(), "_part")
    equal = [F.col(c) == F.col(o) if c == "station_key" else F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()]
    return rows.join(held, [*equal, F.col("_share") == F.col("_part")]).drop("_share", "_part", *own.values())


def place_alerts(stream: DataFrame, places: DataFrame, expected: dict[str, float], delay: str = "1 hour") -> DataFrame:
    """The alerts of every place, from score_stream.

    Places of a station with equal static score and tier are at the same level at any time, so the state is kept for
    the one with the least id, and its alerts are given to all of them. The table of places stays as it is
    for as long as the checkpoint is used: one that is added later has no alert for a level that its kind is in already.
    """
    firsts = places.groupBy(*KIND).agg(F.min("place_id").alias("_first"))
    found = alerts(score_stream(stream, firsts.withColumnRenamed("_first", "place_id"), expected, delay))
    theirs = firsts.withColumnsRenamed({c: f"_of_{c}" for c in KIND})
    members = places.join(theirs, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in KIND]).select("station_key", "_first", "place_id")
    return given(found.withColumnRenamed("place_id", "_first"), members, ["station_key", "_first"]).select("station_key", "place_id", "t_us", "risk_level")


class LateSplitter:
    """foreachBatch sink: rows older than the newest earlier time minus the delay go to a side table.

    Every batch writes its own folders and its own watermark row, so a repeated batch replaces
    what it wrote before.
    """

    def __init__(self, spark: SparkSession, root: str, delay_hours: float):
        self.spark, self.root, self.delay_us = spark, root, int(delay_hours * HOUR_US)

    def _mark(self, batch: int) -> int | None:
        """Watermark left by the batch before; one number."""
        if batch == 0:
            return None
        row = self.spark.read.parquet(f"{self.root}/mark/batch={batch - 1}").first()
        return row["mark"] if row else None

    def __call__(self, df: DataFrame, batch: int) -> None:
        mark = self._mark(batch)
        t = F.unix_micros("ts")
        late = F.lit(False) if mark is None else t < F.lit(mark)
        # one pass over the batch: the side is a partition column
        df.withColumn("side", F.when(late, "late").otherwise("on_time")).write.mode("overwrite").partitionBy("side").parquet(
            f"{self.root}/rows/batch={batch}"
        )
        newest = self.spark.read.parquet(f"{self.root}/rows/batch={batch}").agg(
            F.greatest(F.max(F.unix_micros("ts")) - self.delay_us, F.lit(mark).cast("bigint")).alias("mark")
        )
        newest.write.mode("overwrite").parquet(f"{self.root}/mark/batch={batch}")


def split_late(stream: DataFrame, root: str, checkpoint: str, delay_hours: float = 1.0) -> None:
    """Run split_late to the end of the available input."""
    sink = LateSplitter(stream.sparkSession, root, delay_hours)
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

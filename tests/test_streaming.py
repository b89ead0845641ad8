"""Scripted streams: state that must survive several micro-batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slopecast.streaming import jobs

BASE = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/part={name}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{path}/in/part=*")


def test_stale_events_over_batches(spark, rocks, tmp_path):
    schema = "station_key string, ts timestamp"
    hours = lambda *hs: [("a", BASE + timedelta(hours=h)) for h in hs]
    for name, rows in (("1", hours(0, 1, 9)), ("2", hours(10, 30)), ("3", [("b", BASE + timedelta(hours=60))])):
        out = jobs.freshness(feed(spark, str(tmp_path), name, rows, schema))
        jobs.run_to_end(out, f"{tmp_path}/rows", f"{tmp_path}/cp")
    got = sorted(r.t_ms for r in spark.read.parquet(f"{tmp_path}/rows").filter("station_key = 'a'").collect())
    want = [int((BASE + timedelta(hours=h)).replace(tzinfo=timezone.utc).timestamp() * 1000) for h in (7, 16, 36)]
    assert got == want


def test_alert_only_on_transition(spark, rocks, tmp_path):
    schema = "station_key string, place_id bigint, at timestamp, risk_level string"

    def rows(start, levels, place=1):
        return [("a", place, BASE + timedelta(hours=start + i), x) for i, x in enumerate(levels)]

    first = rows(0, ["LOW", "HIGH", "HIGH"]) + rows(0, ["HIGH"], place=2)
    # an hour that arrives after newer ones must change nothing
    second = rows(3, ["HIGH", "CRITICAL", "WATCH", "HIGH"]) + rows(1, ["LOW"]) + rows(1, ["HIGH", "LOW", "HIGH"], place=2)
    for name, r in (("1", first), ("2", second), ("3", rows(7, ["HIGH"]) + rows(2, ["LOW"]))):
        jobs.run_to_end(jobs.alerts(feed(spark, str(tmp_path), name, r, schema)), f"{tmp_path}/rows", f"{tmp_path}/cp")
    us = lambda h: int((BASE + timedelta(hours=h)).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)
    got = sorted((r.place_id, r.t_us, r.risk_level) for r in spark.read.parquet(f"{tmp_path}/rows").collect())
    assert got == [(1, us(1), "HIGH"), (1, us(4), "CRITICAL"), (1, us(6), "HIGH"), (2, us(0), "HIGH"), (2, us(3), "HIGH")]


def test_four_windows_at_closed_hours(spark, rocks, tmp_path):
    schema = "station_key string, ts timestamp, rainfall_1h double"
    rows = [("a", BASE + timedelta(hours=h, minutes=10), 1.0) for h in range(0, 200)]
    jobs.run_to_end(jobs.window_rain(feed(spark, str(tmp_path), "1", rows, schema), {"24h": 24.0, "3d": 72.0, "7d": 168.0}), f"{tmp_path}/rows", f"{tmp_path}/cp")
    got = {(r["at"] - BASE).total_seconds() / 3600: r for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert got[10].rainfall_1h == 1.0 and got[10].rainfall_24h is None and got[10].quality == "PARTIAL"
    assert (got[180].rainfall_24h, got[180].rainfall_3d, got[180].rainfall_7d, got[180].quality) == (24.0, 72.0, 168.0, "GOOD")
    assert max(got) <= 199


def brute_windows(readings, spans, mark, every_hour):
    """Trailing sums at hour ends up to the mark, over (hour, amount) readings; hours are ends."""
    out = {}
    ends = range(min(h for h, _ in readings), mark + 1) if every_hour else sorted({h for h, _ in readings if h <= mark})
    for end in ends:
        for n in spans:
            inside = [(h, v) for h, v in readings if end - n < h <= end]
            if inside:
                out[end, n] = (round(sum(v for _, v in inside if v is not None), 6), sum(v is not None for _, v in inside), len({h for h, _ in inside}))
    return out


@pytest.mark.parametrize("every_hour", [True, False])
def test_windows_from_hourly_state(spark, rocks, tmp_path, every_hour):
    rng = random.Random(3)
    spans = [1, 24, 168]
    schema = "station_key string, ts timestamp, rainfall_1h double"
    batches = [[*range(0, 30)], [*range(33, 60, 4), 61], [*range(70, 75), 400], [402, 403, 640]]  # gaps within and beyond the longest window
    readings = []
    for k, hours in enumerate(batches):
        rows = []
        for h in hours:
            for minute in (5, 25)[: rng.randint(1, 2)]:
                amount = None if rng.random() < 0.2 else round(rng.random() * 9, 2)
                rows.append(("a", BASE + timedelta(hours=h, minutes=minute), amount))
                readings.append((h + 1, amount))
        rows += [("b", BASE + timedelta(hours=hours[-1], minutes=1), 1.0)]
        out = jobs.hour_windows(feed(spark, str(tmp_path), str(k), rows, schema), spans, every_hour)
        jobs.run_to_end(out, f"{tmp_path}/rows", f"{tmp_path}/cp")
    first = int(BASE.replace(tzinfo=timezone.utc).timestamp()) // 3600
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/rows").where("station_key = 'a'").collect():
        end = int(r["at"].replace(tzinfo=timezone.utc).timestamp()) // 3600 - first
        for n in spans:
            if r[f"hours_{n}"]:
                assert (end, n) not in got
                got[end, n] = (round(r[f"mm_{n}"], 6), r[f"obs_{n}"], r[f"hours_{n}"])
    assert got == brute_windows(readings, spans, 639, every_hour)


def test_state_of_windows_is_bounded():
    class Kept(dict):
        exists = lambda self: bool(self)
        iterator = lambda self: iter(list(self.items()))
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__

    class One:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        timers: set = set()
        listTimers = lambda self: list(self.timers)
        registerTimer = lambda self, t: self.timers.add(t)
        deleteTimer = lambda self, t: self.timers.discard(t)

    class Now:
        def __init__(self, hour):
            self.hour = hour

        def getCurrentWatermarkInMs(self):
            return self.hour * jobs.HOUR_MS

    for every_hour in (True, False):
        windows = jobs.HourWindows([1, 24, 168], every_hour)
        windows.handle, windows.hours, windows.done = Handle(), Kept(), One()
        rows = 0
        for h in range(1000, 3000):
            pdf = pd.DataFrame({"hour": [h], "mm": [1.0], "obs": [1]})
            rows += sum(len(x) for x in windows.handleInputRows(("a",), iter([pdf]), Now(h)))
            assert len(windows.hours) <= 168 and len(windows.handle.timers) == 1
        assert rows == 2000
        for h in range(3000, 3400):
            if windows.handle.timers and min(windows.handle.timers) <= h * jobs.HOUR_MS:
                windows.handle.timers.clear()
                rows += sum(len(x) for x in windows.handleExpiredTimer(("a",), Now(h), None))
        assert rows == (2167 if every_hour else 2000) and not windows.hours and not windows.handle.timers


def test_late_rows_are_kept_aside(spark, tmp_path):
    schema = "id int, ts timestamp"
    for name, hs in (("1", [0, 10]), ("2", [3, 9, 12]), ("3", [10, 13])):
        rows = [(h, BASE + timedelta(hours=h)) for h in hs]
        jobs.split_late(feed(spark, str(tmp_path), name, rows, schema), f"{tmp_path}/out", f"{tmp_path}/cp", delay_hours=1.0)
    got = sorted((r.side, r.id) for r in spark.read.parquet(f"{tmp_path}/out/rows").select("side", "id").collect())
    assert got == [("late", 3), ("late", 10), ("on_time", 0), ("on_time", 9), ("on_time", 10), ("on_time", 12), ("on_time", 13)]


def test_repeated_batch_replaces_its_output(spark, tmp_path):
    sink = jobs.LateSplitter(spark, str(tmp_path), 1.0)
    df = spark.createDataFrame([(1, BASE)], "id int, ts timestamp")
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 1


def test_dedup_within_watermark(spark, tmp_path):
    schema = "station_key string, ts timestamp, rainfall_1h double"
    for name, rows in (("1", [("a", BASE, 1.0), ("a", BASE, 1.0), ("a", BASE, 2.0)]), ("2", [("a", BASE, 1.0), ("a", BASE + timedelta(minutes=5), 1.0)])):
        jobs.run_to_end(jobs.dedup(feed(spark, str(tmp_path), name, rows, schema)), f"{tmp_path}/rows", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/rows").select("ts", "rainfall_1h").distinct().count() == 3
    assert spark.read.parquet(f"{tmp_path}/rows").agg(F.count("ts")).first()[0] == 3


def test_ingest_of_odd_amounts(spark, tmp_path):
    from tests.test_telemetry import SCHEMA, odd_telemetry

    stream = feed(spark, str(tmp_path), "1", odd_telemetry(), SCHEMA)
    jobs.run_to_end(jobs.ingest(stream), f"{tmp_path}/rows", f"{tmp_path}/cp")
    got = {r.reading_id: r.rainfall_1h for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    assert set(got) == {*range(30), *range(100, 105)} and all(got[i] is None for i in range(100, 104)) and got[3] is not None


def test_hours_are_scored_once_for_places_alike(spark, monkeypatch):
    hours = [("a", 1.0, 120.0, 10.0, 10.0, "GOOD", "OK"), ("a", None, None, None, None, "MISSING", "MISSING"), ("b", 2.0, 3.0, 4.0, 5.0, "GOOD", "OK")]
    closed = spark.createDataFrame(hours, "station_key string, rainfall_1h double, rainfall_24h double, rainfall_3d double, rainfall_7d double, quality string, status string")
    spots = [("a", k, 0.8, "VERY_HIGH") for k in range(500)] + [("a", 500, None, None), ("b", 501, 0.1, "LOW"), ("c", 502, 0.1, "LOW"), (None, 503, 0.1, "LOW")]
    places = spark.createDataFrame(spots, "station_key string, place_id bigint, static_score double, tier string")
    monkeypatch.setattr(jobs, "window_rain", lambda *_: closed)
    own, scored = jobs.hazard.fuse, []
    monkeypatch.setattr(jobs.hazard, "fuse", lambda df: scored.append(df.count()) or own(df))
    names = ["station_key", "place_id", "rainfall_24h", "static_score", "tier", "trigger_level", "trigger_score", "risk_level", "fusion_score"]
    got = jobs.score_stream(None, places, {}).select(names)
    want = own(jobs.hazard.rain_trigger(closed.join(places, "station_key"))).select(names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 1003
    assert scored == [5]  # two kinds of places at a, one at b


def test_alerts_keep_one_state_for_places_alike(spark, monkeypatch):
    levels = [("a", BASE + timedelta(hours=h), mm) for h, mm in ((1, 10.0), (2, 400.0), (3, 400.0), (4, 10.0), (5, 400.0))]
    closed = spark.createDataFrame(levels, "station_key string, at timestamp, rainfall_24h double").selectExpr(
        "*", "rainfall_24h AS rainfall_1h", "rainfall_24h AS rainfall_3d", "rainfall_24h AS rainfall_7d", "'GOOD' AS quality", "'OK' AS status")
    spots = [("a", k, 0.8, "VERY_HIGH") for k in range(300)] + [("a", 300, None, None), ("a", 301, 0.1, "LOW"), ("b", 302, 0.8, "VERY_HIGH")]
    places = spark.createDataFrame(spots, "station_key string, place_id bigint, static_score double, tier string")
    states = []

    def entered(scored):
        rows = sorted((r.station_key, r.place_id, r.at, r.risk_level) for r in scored.collect())
        states.append(len({r[:2] for r in rows}))
        found = [b for a, b in zip([(None,) * 4, *rows], rows) if b[3] in ("HIGH", "CRITICAL") and (b[:2], b[3]) != (a[:2], a[3])]
        return spark.createDataFrame([(s, p, int(t.timestamp()), r) for s, p, t, r in found], "station_key string, place_id bigint, t_us bigint, risk_level string")

    monkeypatch.setattr(jobs, "window_rain", lambda *_: closed)
    monkeypatch.setattr(jobs, "alerts", entered)
    want = sorted(map(str, entered(jobs.score_stream(None, places, {})).collect()))
    got = sorted(map(str, jobs.place_alerts(None, places, {}).collect()))
    assert got == want and len(got) >= 600
    assert states == [302, 3]

"""Trailing windows, daily totals and their independence of row order and slicing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from slopecast.operators import telemetry
from slopecast.sources import readers

SCHEMA = (
    "reading_id bigint, copy_no int, station_key string, station string, state string, district string, latitude double, "
    "longitude double, ts timestamp, rainfall_1h double, source_file string, source_period string"
)
BASE = datetime(2024, 3, 1)


def rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b"])
        ts = BASE + timedelta(hours=rng.randint(0, 24 * 20))
        mm = None if rng.random() < 0.2 else round(rng.random() * 40, 2)
        out.append((i, 0, key, key, "S", "D", 25.0, 92.0, ts, mm, "f.csv", "p"))
    return out


def expected(data):
    df = pd.DataFrame(data, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    df = df.drop_duplicates(["station_key", "ts", "rainfall_1h"])
    want = {}
    for _, r in df.iterrows():
        for label, hours in (("24h", 24), ("3d", 72), ("7d", 168)):
            m = (df.station_key == r.station_key) & (df.ts <= r.ts) & (df.ts > r.ts - timedelta(hours=hours))
            v = df[m].rainfall_1h.dropna()
            want[(r.reading_id, label)] = (None if v.empty else v.sum(), len(v))
    return want


def test_windows_match_brute_force(spark):
    data = rows()
    feat = telemetry.build_features(spark.createDataFrame(data, SCHEMA)).collect()
    want = expected(data)
    assert len(feat) * 3 == len(want)
    for r in feat:
        for label in ("24h", "3d", "7d"):
            total, obs = want[(r.reading_id, label)]
            assert r[f"rainfall_obs_{label}"] == obs
            got = r[f"rainfall_{label}_sum"]
            assert (got is None) == (total is None) and (got is None or abs(got - total) < 1e-6)
            assert r[f"missing_{label}"] == (r[f"coverage_{label}"] < 0.75)


def test_row_order_partitions_and_slices_do_not_matter(spark):
    data = rows(seed=2)
    cols = ["reading_id", "rainfall_24h_sum", "rainfall_7d_sum", "rainfall_obs_3d", "quality_flag", "timestamp_collision"]
    a = telemetry.build_features(spark.createDataFrame(data, SCHEMA)).select(*cols).orderBy("reading_id").collect()
    random.Random(3).shuffle(data)
    mixed = spark.createDataFrame(data, SCHEMA).repartition(7)
    deduped = telemetry.dedup_measurements(telemetry.usable_rows(mixed))
    b = telemetry.trailing_rain(deduped, slice_days=400).select(*cols).orderBy("reading_id").collect()
    assert a == b


def test_all_missing_day_stays_missing(spark):
    data = [(i, 0, "a", "a", "S", None if i == 0 else "D", 25.0, 92.0, BASE + timedelta(hours=i), None, "f", "p") for i in range(3)]
    day = telemetry.station_day(telemetry.build_features(spark.createDataFrame(data, SCHEMA))).first()
    assert day.rainfall_mm is None and day.valid_readings == 0 and day.district == "D"


def test_conflicting_repeats_are_flagged_and_kept(spark):
    t = BASE
    data = [(i, 0, "a", "a", "S", "D", 25.0, 92.0, t, v, "f", "p") for i, v in enumerate([2.0, 2.0, 4.0, None])]
    out = telemetry.build_features(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(r.reading_id for r in out) == [0, 2, 3]
    assert all(r.timestamp_collision and r.rainfall_24h_sum == 6.0 for r in out)


ODD = [float("nan"), float("inf"), float("-inf"), None, 1e300]


def odd_telemetry():
    """A reading an hour of 0.1 + 1e-9 mm, and odd amounts between them."""
    data = [(i, 0, "a", "a", "S", "D", 25.0, 92.0, BASE + timedelta(hours=i), 0.1 + 1e-9 * i, "f", "p") for i in range(30)]
    data += [(100 + i, 0, "a", "a", "S", "D", 25.0, 92.0, BASE + timedelta(hours=i, minutes=30), v, "f", "p") for i, v in enumerate(ODD)]
    data += [(200, 0, "a", "a", "S", "D", float("nan"), 92.0, BASE, 5.0, "f", "p"), (201, 0, "a", "a", "S", "D", 25.0, float("inf"), BASE, 5.0, "f", "p")]
    return data + [(202, 0, "a", "a", "S", "D", 25.0, 92.0, BASE, -1.0, "f", "p")]


def test_nan_and_infinite_amounts_are_missing(spark):
    out = {r.reading_id: r for r in telemetry.build_features(spark.createDataFrame(odd_telemetry(), SCHEMA)).collect()}
    assert set(out) == {*range(30), *range(100, 105)}
    for i in range(100, 104):
        assert out[i].rainfall_1h is None and out[i].rainfall_quality == "MISSING"
    assert out[104].rainfall_quality == "EXTREME_REVIEW"  # marked, but in no sum
    for i in range(24):
        assert out[i].rainfall_obs_24h == i + 1
        assert abs(out[i].rainfall_24h_sum - round(sum(0.1 + 1e-9 * k for k in range(i + 1)), 4)) < 1e-12
    day = telemetry.station_day(telemetry.build_features(spark.createDataFrame(odd_telemetry(), SCHEMA)).where("reading_id < 104")).orderBy("date").first()
    assert day.valid_readings == 24 and abs(day.rainfall_mm - 2.4) < 1e-3


def test_sums_are_exact_beyond_millionths(spark):
    data = [(i, 0, "a", "a", "S", "D", 25.0, 92.0, BASE + timedelta(minutes=i), 4e-7, "f", "p") for i in range(1000)]
    last = telemetry.trailing_rain(spark.createDataFrame(data, SCHEMA)).orderBy(F.desc("ts")).first()
    assert last.rainfall_24h_sum == 0.0004  # a thousand readings that millionths would have rounded to nothing


def test_unique_files(spark, tmp_path):
    for name, text in (("b/x.csv", "1,2\n"), ("a/y.csv", "1,2\n"), ("c.csv", "3\n")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    out = {r.path.rsplit("/", 1)[1]: r.is_copy for r in readers.unique_files(spark, str(tmp_path)).collect()}
    assert out == {"y.csv": False, "x.csv": True, "c.csv": False}


def test_copies_of_files_by_their_lines(spark, tmp_path):
    rng = random.Random(7)
    big = "".join(f"{rng.random()},{i}\n" for i in range(60_000))  # some blocks long
    swapped = big.split("\n")
    swapped[100], swapped[40_000] = swapped[40_000], swapped[100]
    files = {
        "a/big.csv": big, "b/big copy.csv": big, "c/swapped.csv": "\n".join(swapped), "d/alone.csv": big + "x", "e.csv": "1,2\n3,4\n", "f.csv": "3,4\n1,2\n", "g.csv": "1,2\n3,4\n",
        "h.csv": "1,2\r\n3,4", "i.csv": "1,2\n3,4\r", "j.csv": "", "k.csv": "", "l.csv": "1,2\n3,4\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        out = {r.path.rsplit("/", 1)[1]: r for r in readers.unique_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(out) == len(files) - 2  # empty files are not listed
    copies = {n.replace("%20", " "): r.original.rsplit("/", 1)[1] for n, r in out.items() if r.is_copy}
    assert copies == {"big copy.csv": "big.csv", "g.csv": "e.csv", "l.csv": "e.csv"}
    assert out["alone.csv"].digest is None and out["alone.csv"].length == len(files["d/alone.csv"])


def test_broken_lines_are_counted_and_kept(spark, tmp_path):
    header = ",".join(readers.TELEMETRY_COLUMNS)
    good = ["1"] + ["x"] * 15 + ["25.0", "92.0", "05-03-2024 10:00:00", "3.5"]
    lines = [header, ",".join(good), "only,three,fields", ",".join(good + ["too", "many"]), ",".join(good)]
    folder = tmp_path / "2021_2025"
    folder.mkdir()
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    (folder / "b.csv").write_text("\n".join([header, ",".join(good)]) + "\n")
    rows = readers.read_telemetry(spark, str(tmp_path))
    assert rows.count() == 3 and rows.where("rainfall_1h = 3.5 and station = 'x'").count() == 3
    assert {(r.source_file, r.line) for r in readers.telemetry_quarantine(spark, str(tmp_path)).collect()} == {("a.csv", lines[2]), ("a.csv", lines[3])}
    assert {tuple(r) for r in readers.scan_report(spark, str(tmp_path)).collect()} == {("a.csv", "2021_2025_source", 2, 2), ("b.csv", "2021_2025_source", 1, 0)}


def test_broken_district_lines(spark, tmp_path):
    (tmp_path / "d.csv").write_text('State, District,Date,"Daily\nActual","Daily\n Normal","Daily Departure\nPer"\nA,B,05-03-2024,1,2,-50%\nA,B\nA,C,06-03-2024,1,2,"-50%"\n')
    got = readers.read_district_days(spark, str(tmp_path)).collect()
    assert sorted((r.district, r.daily_actual, r.daily_departure_pct) for r in got) == [("B", 1.0, -50.0), ("C", 1.0, -50.0)]
    assert [r.line.strip() for r in readers.district_quarantine(spark, str(tmp_path)).collect()] == ["A,B"]


def test_inventory_from_multi_line_collections(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        """{"type": "FeatureCollection", "features": [
        {"id": "1", "geometry": {"type": "Point", "coordinates": [91.5, 25.5]}, "properties": {"State": "Assam", "Year": 2014}},
        {"id": "2", "geometry": {"type": "Polygon", "coordinates": [[[90, 24], [92, 24], [92, 26], [90, 26], [90, 24]]]}, "properties": {}},
        {"id": "3", "geometry": null, "properties": {"State": "X"}}]}"""
    )
    got = {r.feature_id: (r.latitude, r.longitude, r.year) for r in readers.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {"1": (25.5, 91.5, 2014), "2": (25.0, 91.0, None)}


def test_centroids_are_made_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features": [{"id": "1", "geometry": {"type": "Point", "coordinates": [91.5, 25.5]}, "properties": {}}]}')
    plan = readers.read_inventory(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("signum") <= 3  # one area's turn, carried to its three sums


def test_timestamps(spark):
    df = spark.createDataFrame([("05-03-2024 10:00:00",), ("5 March",), ("2024-03-05T10:00:00+05:30",), ("2024-03-05T10:00:00",)], "x string")
    got = [tuple(r) for r in df.select(
        F.date_format(readers.day_first_timestamp(F.col("x")), "yyyy-MM-dd HH"), F.date_format(readers.offset_timestamp(F.col("x")), "yyyy-MM-dd HH:mm")
    ).collect()]
    assert got == [("2024-03-05 10", None), (None, None), (None, "2024-03-05 04:30"), (None, None)]


def test_settled_tables_can_be_removed(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from slopecast import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    assert session.settle(spark.range(5), "five").count() == 5
    assert list(Path(session.scratch_root(spark)).iterdir())
    session.remove_scratch(spark)
    assert not Path(session.scratch_root(spark)).exists()

"""Data-quality rules, audits and profiles; every job returns a table of findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import normal_name, rounded
from slopecast.operators.ranks import exact_quantiles
from slopecast.session import settle

INF = float("inf")


def broken_rule(value: Column, low: float | None, high: float | None) -> Column:
    """Name of the first rule a feature value breaks, else NULL; no limits means a 0/1 flag."""
    v = value.cast("double")
    check = (
        F.when(v.isNull(), "NULL").when(F.isnan(v), "NAN").when(F.abs(v) == INF, "INFINITE")
    )
    if low is None or high is None:
        return check.when(~v.isin(0.0, 1.0), "NOT_ALLOWED")
    return check.when(v < low, "BELOW_MIN").when(v > high, "ABOVE_MAX")


def rule_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per broken feature rule."""
    found = F.array(
        *[F.struct(F.lit(n).alias("field"), broken_rule(F.col(n), lo, hi).alias("rule")) for n, lo, hi in fixed.FEATURE_LIMITS]
    )
    return df.select(*keys, F.explode(F.filter(found, lambda x: x["rule"].isNotNull())).alias("v")).select(*keys, "v.*")


def cross_field_warnings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A shorter window above a longer one: a warning, not an error."""

    def above(a: str, b: str):
        bad = ~F.isnan(a) & ~F.isnan(b) & (F.col(a) > F.col(b))
        return F.when(bad, F.struct(F.lit(a).alias("field"), F.lit(b).alias("exceeds")))

    found = F.array_compact(F.array(above("rainfall_24h", "rainfall_3d"), above("rainfall_3d", "rainfall_7d")))
    return df.select(*keys, F.explode(found).alias("w")).select(*keys, "w.*")


def unpivot(df: DataFrame, columns: dict[str, Column], keep: Sequence[str] = (), name: str = "field", value: str = "n") -> DataFrame:
    """One row per named expression."""
    items = F.array(*[F.struct(F.lit(k).alias(name), c.alias(value)) for k, c in columns.items()])
    return df.select(*keep, F.explode(items).alias("_i")).select(*keep, "_i.*")


def profile_gate(df: DataFrame, features: Sequence[tuple], target: str, classes: Sequence[str]) -> DataFrame:
    """Findings over a training table as (check, field, n)."""
    aggs: dict[str, Column] = {"rows||": F.count(F.lit(1)), "null|" + target: F.count_if(F.col(target).isNull())}
    for name, lo, hi in features:
        v = F.col(name).cast("double")
        finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != INF)
        aggs[f"null|{name}"] = F.count_if(v.isNull() | F.isnan(v))
        aggs[f"infinite|{name}"] = F.count_if(F.abs(v) == INF)
        if lo is None or hi is None:
            aggs[f"not_allowed|{name}"] = F.count_if(finite & ~v.isin(0.0, 1.0))
        else:
            aggs[f"below_min|{name}"] = F.count_if(finite & (v < lo))
            aggs[f"above_max|{name}"] = F.count_if(finite & (v > hi))
    columns = [n for n, _, _ in features] + [target]
    # one pass by class gives every count; the rest of the job reads that table of one row per class
    by_class = settle(df.groupBy(target).agg(*[c.alias(k) for k, c in aggs.items()]), "profile")
    wide = by_class.agg(*[F.coalesce(F.sum(f"`{k}`"), F.lit(0)).alias(k) for k in aggs])
    flat = unpivot(wide, {k: F.col(f"`{k}`") for k in aggs}).select(
        F.split("field", r"\|")[0].alias("check"), F.split("field", r"\|")[1].alias("field"), "n"
    )
    small = flat.filter("check = 'rows' and n < 50").select(F.lit("size_warning").alias("check"), "field", "n")
    # equal rows have equal 128-bit digests; a NULL is told from every text
    row = F.md5(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}))
    dup = df.groupBy(row.alias("_row")).agg(F.count(F.lit(1)).alias("_n")).agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.count(F.lit(1))).alias("n")).select(
        F.lit("duplicate_rows").alias("check"), F.lit("").alias("field"), "n"
    )
    per_class = by_class.filter(F.col(target).isNotNull()).select(target, F.col("`rows||`").alias("n"))
    dist = per_class.select(
        F.when(F.col(target).isin(*classes), "class").otherwise("invalid_class").alias("check"),
        F.col(target).alias("field"), "n",
    )
    allowed = df.sparkSession.createDataFrame([(c,) for c in classes], "field string")
    unseen = allowed.join(per_class.select(F.col(target).alias("field")), "field", "left_anti").select(
        F.lit("unseen_class").alias("check"), "field", F.lit(0).cast("bigint").alias("n")
    )
    return reduce(DataFrame.unionByName, [flat, small, dup, dist, unseen])


def payload_conformance(items: DataFrame, key: str, name: str, contract: Sequence[str]) -> DataFrame:
    """Per payload: names the contract asks for that are absent, and names it does not know."""
    want = F.array(*[F.lit(c) for c in sorted(contract)])
    have = F.array_sort(F.collect_set(name))
    per = items.groupBy(key).agg(have.alias("_have"))
    return per.select(
        key,
        F.array_join(F.array_except(want, "_have"), ",").alias("missing"),
        F.array_join(F.array_except("_have", want), ",").alias("unexpected"),
    )


def preservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(check, n): lost, added and repeated keys, and changed values per earlier column."""
    cols = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = after.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    checks = {
        "lost_keys": F.count_if(F.col("_kb").isNull()),
        "added_keys": F.count_if(F.col("_ka").isNull()),
        **{f"changed:{c}": F.count_if(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in cols},
    }
    wide = a.join(b, F.col("_ka") == F.col("_kb"), "full").agg(*[c.alias(k) for k, c in checks.items()])
    flat = unpivot(wide, {k: F.col(f"`{k}`") for k in checks}, name="check")
    repeated = (
        after.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
        .select(F.lit("repeated_keys").alias("check"), "n")
    )
    return flat.unionByName(repeated)


def publish_gate(daily: DataFrame, source_days: DataFrame, states: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(check, n) over the integrated station-day table; 0 passes, except rows and rows:<state>."""
    aggs = {
        "rows": F.count(F.lit(1)),
        "outside_region": F.count_if(~F.col("state").isin(*states)),
        "undated": F.count_if(F.col("date").isNull()),
        **{f"null:{c}": F.count_if(F.col(c).isNull()) for c in columns},
    }
    flat = unpivot(daily.agg(*[c.alias(k) for k, c in aggs.items()]), {k: F.col(f"`{k}`") for k in aggs}, name="check")
    keys = daily.groupBy("state", "station", "date").agg(F.count(F.lit(1)).alias("_n"))
    dup = keys.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_keys").alias("check"), "n")
    foreign = (
        daily.select("date").distinct().join(source_days, "date", "left_anti")
        .agg(F.count(F.lit(1)).alias("n")).select(F.lit("dates_outside_source").alias("check"), "n")
    )
    per_state = daily.groupBy("state").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("rows:"), "state").alias("check"), "n"
    )
    return reduce(DataFrame.unionByName, [flat, dup, foreign, per_state])


def property_check(features: DataFrame, properties: str, required: Sequence[str], expected_state: str) -> DataFrame:
    """Required properties that no feature carries, and features of another state."""
    keys = features.select(F.explode(F.map_keys(properties)).alias("name")).distinct()
    want = features.sparkSession.createDataFrame([(r,) for r in required], "name string")
    missing = want.join(keys, "name", "left_anti").select(
        F.lit("missing_property").alias("check"), "name", F.lit(0).cast("bigint").alias("n")
    )
    state = normal_name(F.col(properties)["State"])
    other = (
        features.select(state.alias("name"))
        .filter((F.col("name") != expected_state) & (F.col("name") != ""))
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("other_state").alias("check"), "name", "n")
    )
    return missing.unionByName(other)


def region_filter(df: DataFrame, state: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose normalised state is accepted."""
    name = normal_name(F.col(state))
    return df.withColumn("state_normal", name).filter(F.col("state_normal").isin(*allowed))


def region_report(df: DataFrame, state: str, allowed: Sequence[str]) -> DataFrame:
    name = normal_name(F.col(state))
    return df.agg(
        F.count_if(name.isin(*allowed)).alias("kept"),
        F.count_if(~name.isin(*allowed)).alias("dropped"),
        F.count_if(name.isNull()).alias("missing"),
    )


def key_duplicates(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every member of a repeated key, with the first member marked.

    Counting happens in an aggregate, so a heavily repeated key is never one window group.
    """
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("_first"))
    return (
        df.join(seen.filter("copies > 1"), list(keys))
        .withColumn("is_first", F.col(order) == F.col("_first"))
        .drop("_first")
    )


def file_qc(tele: DataFrame, files: DataFrame) -> DataFrame:
    """Per source file: rows, gaps, repeats, range and spikes; listed files without rows are empty."""
    raw = [c for c in tele.columns if c != "copy_no"]
    rows = tele.groupBy(*raw).agg(F.count(F.lit(1)).alias("_n"))
    mm = F.col("rainfall_1h")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    per = rows.groupBy("source_file").agg(
        F.sum("_n").alias("n_rows"), total(mm.isNull()).alias("missing"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.min(mm).alias("min_mm"), F.max(mm).alias("max_mm"),
        total(mm < 0).alias("negative"), total(mm > fixed.EXTREME_MM).alias("spikes"),
    )
    out = files.join(per, "source_file", "left").fillna(0, ["n_rows", "missing", "duplicate_rows", "negative", "spikes"])
    return out.withColumns({
        "missing_pct": F.when(F.col("n_rows") > 0, rounded(F.col("missing") / F.col("n_rows") * 100.0, 2)).otherwise(F.lit(0.0)),
        "is_empty": F.col("n_rows") == 0,
    })


def value_counts(mm: Column) -> dict[str, Column]:
    """Conditional counts every rainfall audit shares."""
    return {
        "records": F.count(F.lit(1)),
        "missing": F.count_if(mm.isNull()),
        "zeros": F.count_if(mm == 0),
        "positives": F.count_if(mm > 0),
        "negatives": F.count_if(mm < 0),
        "over_50": F.count_if(mm > 50),
        "over_100": F.count_if(mm > 100),
        "over_300": F.count_if(mm > 300),
    }


def global_qc(tele: DataFrame) -> DataFrame:
    return tele.agg(*[c.alias(k) for k, c in value_counts(F.col("rainfall_1h")).items()])


def station_qc(tele: DataFrame) -> DataFrame:
    """Per station counts, maximum and its first known position."""
    order = F.struct("reading_id", "copy_no")
    mm = F.col("rainfall_1h")
    counts = value_counts(mm)
    return tele.groupBy("station").agg(
        *[counts[k].alias(k) for k in ("records", "missing", "zeros", "positives", "over_100")],
        F.coalesce(F.max(mm), F.lit(0.0)).alias("max_mm"),
        F.min_by("state", order).alias("state"),
        F.min_by("latitude", F.when(F.col("latitude").isNotNull(), order)).alias("latitude"),
        F.min_by("longitude", F.when(F.col("longitude").isNotNull(), order)).alias("longitude"),
    )


def extreme_readings(tele: DataFrame, n: int = 20) -> DataFrame:
    """The n largest readings above the extreme limit."""
    return (
        tele.filter(F.col("rainfall_1h") > fixed.EXTREME_MM)
        .orderBy(F.desc("rainfall_1h"), "reading_id", "copy_no")
        .limit(n)
    )


def telemetry_audit(feat: DataFrame) -> DataFrame:
    """Per state: stations, districts, coverage, gaps and flags."""
    flags = ("OK", "LOW_24H_COVERAGE", "TIMESTAMP_COLLISION", "EXTREME_REVIEW", "MISSING_RAINFALL")
    return feat.groupBy("state").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("station").alias("stations"), F.count_distinct("district").alias("districts"),
        rounded(F.avg("coverage_24h")).alias("mean_coverage_24h"),
        rounded(F.avg(F.col("rainfall_1h").isNull().cast("double")) * 100.0).alias("missing_1h_pct"),
        rounded(F.avg(F.col("rainfall_24h").isNull().cast("double")) * 100.0).alias("missing_24h_pct"),
        *[F.count_if(F.col("quality_flag") == f).alias(f"flag_{f.lower()}") for f in flags],
    )


def integration_audit(integrated: DataFrame) -> DataFrame:
    """Overlap of the two rainfall sources in one row."""
    hit = F.col("state_actual").isNotNull()
    return integrated.agg(
        F.count(F.lit(1)).alias("station_days"), F.count_if(hit).alias("matched"),
        rounded(F.avg(hit.cast("double")) * 100.0).alias("matched_pct"),
        F.unix_date(F.min("date")).alias("first_day"), F.unix_date(F.max("date")).alias("last_day"),
        F.unix_date(F.min(F.when(hit, F.col("date")))).alias("first_overlap"),
        F.unix_date(F.max(F.when(hit, F.col("date")))).alias("last_overlap"),
    )


def district_inspection(reports: DataFrame) -> DataFrame:
    """Per state: rows, districts, day span and rows of repeated (state, district, day) keys."""
    keys = reports.groupBy("state", "district", "day").agg(F.count(F.lit(1)).alias("_n"))
    return keys.groupBy("state").agg(
        F.sum("_n").alias("n_rows"), F.count_distinct("district").alias("districts"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("duplicate_rows"),
    )


def column_profile(df: DataFrame, lat: str, lon: str, inside: Column) -> DataFrame:
    """(metric, field, value): rows, NULLs per column, repeated rows, coordinate range, box hits."""
    aggs = {
        "rows|": F.count(F.lit(1)),
        **{f"null|{c}": F.count_if(F.col(c).isNull()) for c in df.columns},
        **{f"min|{c}": F.min(c) for c in (lat, lon)},
        **{f"max|{c}": F.max(c) for c in (lat, lon)},
        "inside|": F.count_if(inside), "outside|": F.count_if(~inside),
    }
    wide = df.agg(*[c.cast("double").alias(k) for k, c in aggs.items()])
    flat = unpivot(wide, {k: F.col(f"`{k}`") for k in aggs}, value="value").select(
        F.split("field", r"\|")[0].alias("metric"), F.split("field", r"\|")[1].alias("field"), "value"
    )
    dup = (
        df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
        .agg(F.sum(F.col("_n") - 1).cast("double").alias("value"))
        .select(F.lit("duplicates").alias("metric"), F.lit("").alias("field"), "value")
    )
    return flat.unionByName(dup)


def numeric_profile(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Per column (and group): range, mean, median, sample deviation and non-finite count."""
    long = unpivot(df, {c: F.col(c).cast("double") for c in columns}, keep=groups, value="x")
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == INF)
    clean = long.withColumn("v", F.when(~bad, F.col("x")))
    keys = [*groups, "field"]
    stats = clean.groupBy(*keys).agg(
        rounded(F.min("v")).alias("min"), rounded(F.avg("v")).alias("mean"), rounded(F.max("v")).alias("max"),
        rounded(F.stddev_samp("v")).alias("std"), F.count_if(bad).alias("non_finite"),
    )
    median = exact_quantiles(clean, keys, "v", {"median": 0.5}).withColumn("median", rounded(F.col("median")))
    return stats.join(median, keys, "left")


def feature_dedup(df: DataFrame, keys: Sequence[str], canonical: Sequence[str], order: str) -> DataFrame:
    """Overlapping batches: identity is the first known key, else the canonical JSON; the last wins."""
    identity = F.coalesce(*keys, F.sha2(F.to_json(F.struct(*canonical)), 256))
    rest = [c for c in df.columns if c != order]
    return (
        df.withColumn("_key", identity)
        .groupBy("_key")
        .agg(F.max(F.struct(order, *rest)).alias("_last"), F.count(F.lit(1)).alias("versions"))
        .select("_last.*", "versions")
    )


def missing_members(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Allowed members that do not occur, and occurring members that are not allowed."""
    present = df.select(normal_name(F.col(column)).alias("member")).filter("member is not null").distinct()
    want = df.sparkSession.createDataFrame([(a,) for a in allowed], "member string")
    gone = want.join(present, "member", "left_anti").select(F.lit("missing").alias("kind"), "member")
    odd = present.join(want, "member", "left_anti").select(F.lit("invalid").alias("kind"), "member")
    return gone.unionByName(odd)

"""Event inventory: standard names, linkage with rainfall, pair review, control periods, audits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions.columns import degrees_for_km, haversine_km, literal_map, rounded
from slopecast.operators.cells import count_within, unfolded
from slopecast.operators.quality import unpivot
from slopecast.operators.ranks import exact_quantiles, in_ranges, numbered
from slopecast.operators.spatial import PAIRS_A_PLACE, nearest_site, pairs_near, radius_cell, radius_reach
from slopecast.session import settle, ship

PLACE = ["_lat", "_lon", "_dist"]
#: Radius cells and days of a group in which the partners of a day are counted, and pairs compared at a time.
WIDE_CELLS, WIDE_DAYS, PAIRS_AT_ONCE = 6, 16, 1 << 20
EARTH_KM = 2 * fixed.EARTH_RADIUS_KM
WINDOW_COLUMNS = ["rain_1h", "rain_3h", "rain_6h", "rain_12h", "rain_24h", "rain_48h", "rain_72h", "rain_7d"]


def standardize(inv: DataFrame) -> DataFrame:
    """Free-text state, district, time, type and road to standard values with a precision label."""
    low = F.lower("raw_state")
    state = F.when(low.contains("sikkim"), "Sikkim")
    for name in ("Arunachal Pradesh", "Assam", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Tripura"):
        state = state.when(low.contains(name.split()[0].lower()), name)
    state = state.otherwise(F.trim("raw_state"))
    codes = literal_map(fixed.STATE_CODES)
    district = F.trim("raw_district")
    low_district = F.lower(district)
    hh = F.regexp_extract("raw_time", r"^(\d{1,2}):(\d{2})$", 1)
    mm = F.regexp_extract("raw_time", r"^(\d{1,2}):(\d{2})$", 2)
    exact = F.coalesce(hh != "", F.lit(False))
    label = F.lower(F.coalesce("raw_name", F.lit("")))
    kind = F.trim("raw_type")
    df = inv.withColumn("state", state)
    return df.withColumns({
        "state_code": F.coalesce(F.try_element_at(codes, F.col("state")), F.lit("NE")),
        "is_border": low.contains("sikkim") & low.contains("bengal"),
        "district": F.when(low_district == "trap", "Tirap").when(low_district == "kamrup metro", "Kamrup Metropolitan")
        .when((low_district == "south") & (F.col("state") == "Tripura"), "South Tripura").otherwise(district),
        "event_time": F.when(exact, F.concat(F.lpad(hh, 2, "0"), F.lit(":"), mm, F.lit(":00"))),
        "event_time_precision": F.when(exact, "EXACT_TIME").otherwise("DATE_ONLY"),
        "landslide_type": F.when((kind == "2") | label.contains("debris"), "Debris slide")
        .when((kind == "3") | label.contains("rock") | label.contains("fall"), "Rock fall")
        .when(label.contains("mud"), "Mudslide").otherwise("Landslide (slope failure)"),
        "road_affected": F.when(~F.trim("raw_road").isin("-", ""), F.trim("raw_road")),
    })


def _padded(n: Column, width: int) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def sequence_ids(df: DataFrame, group: str, order: str, prefix: str, width: int = 3) -> DataFrame:
    """Running id per group in source order, e.g. EV-2021-AR-001; numbered in ranges that follow the data."""
    out = numbered(in_ranges(df, [order]), [group], F.col("_bucket"), [F.col(order)], "_n").drop("_bucket")
    return out.withColumn("sequence_id", F.concat(F.lit(f"{prefix}-"), group, F.lit("-"), _padded(F.col("_n"), width))).drop("_n")


def control_periods(df: DataFrame, order: str) -> DataFrame:
    """One candidate dry-season window per event, dealt out in turn.

    Candidates only: they are not confirmed quiet periods and never negative labels.
    """
    out = numbered(in_ranges(df, [order]), [], F.col("_bucket"), [F.col(order)], "_n").drop("_bucket")
    turn = ((F.col("_n") - 1) % len(fixed.CONTROL_WINDOWS)).cast("int")
    windows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in fixed.CONTROL_WINDOWS])
    w = F.element_at(windows, turn + 1)
    return out.withColumns({
        "control_id": F.concat(F.lit("CTRL-2021-"), F.upper(F.substring("state", 1, 2)), F.lit("-"), _padded(F.col("_n"), 3)),
        "control_start": w["a"], "control_end": w["b"], "control_quality": F.lit("CANDIDATE_CONTROL"),
    }).drop("_n")


def day_profile(readings: DataFrame) -> DataFrame:
    """Per station and day: valid readings, total, and the best 1/3/6/12-row sums of that day.

    A row sum needs 2, 4 and 8 valid readings. A window group is one station's single day.
    """
    day = F.unix_date(F.to_date("ts"))
    order = Window.partitionBy("station_key", "day").orderBy("ts", "reading_id", "copy_no")
    df = readings.withColumn("day", day)
    sums = {}
    for rows, need in ((3, 2), (6, 4), (12, 8)):
        w = order.rowsBetween(-(rows - 1), 0)
        sums[f"_s{rows}"] = F.when(F.count("rainfall_1h").over(w) >= need, F.sum("rainfall_1h").over(w))
    return df.withColumns(sums).groupBy("station_key", "day").agg(
        F.count("rainfall_1h").alias("n_valid"),
        F.sum("rainfall_1h").alias("total"),
        F.max("rainfall_1h").alias("rain_1h"),
        F.max("_s3").alias("rain_3h"), F.max("_s6").alias("rain_6h"), F.max("_s12").alias("rain_12h"),
    )


def calendar_windows(profile: DataFrame, need: dict[str, int]) -> DataFrame:
    """Totals of whole days ending at each station day, NULL below the needed valid readings.

    Runs on one row per station and day, so a window group is a station's days.
    """
    line = Window.partitionBy("station_key").orderBy("day")
    out = {}
    for label, days in (("24h", 1), ("48h", 2), ("72h", 3), ("7d", 7)):
        w = line.rangeBetween(-(days - 1), 0)
        out[f"rain_{label}"] = F.when(F.sum("n_valid").over(w) >= need[label], F.sum("total").over(w))
    return profile.withColumns(out)


def antecedent_index(profile: DataFrame, need: int) -> DataFrame:
    """API over 3 and 7 days: sum of daily total times 0.85^t for the days before.

    A day without enough readings counts as 0; api_missing_days says how many did.
    """
    line = Window.partitionBy("station_key").orderBy("day")
    good = F.when(F.col("n_valid") >= need, F.col("total"))
    daily = {t: F.sum(good).over(line.rangeBetween(-t, -t)) for t in range(1, 8)}
    terms = {t: F.coalesce(v, F.lit(0.0)) * (fixed.API_DECAY**t) for t, v in daily.items()}

    def total(n: int) -> Column:
        return rounded(sum((terms[t] for t in range(2, n + 1)), terms[1]))

    gone = sum((daily[t].isNull().cast("int") for t in range(2, 8)), daily[1].isNull().cast("int"))
    return profile.withColumns({"api_3d": total(3), "api_7d": total(7), "api_missing_days": gone})


def link_rainfall(
    events: DataFrame, stations: DataFrame, readings: DataFrame,
    need_day: int = 18, need: dict[str, int] | None = None, need_api: int = 12,
) -> DataFrame:
    """Rainfall of each event: its nearest station when close and complete enough, else the grid value.

    events has rain_day (days since 1970), event_time_precision and grid_rainfall_mm. Sub-daily
    windows of grid-linked events stay NULL.
    """
    need = need or {"24h": 1, "48h": 24, "72h": 36, "7d": 72}
    profile = antecedent_index(calendar_windows(day_profile(readings), need), need_api)
    near = nearest_site(events, stations, ["site_no", "station_key", "station"])
    near = near.withColumns({"station_key": F.col("nearest.station_key"), "_km": F.col("nearest.distance")})
    df = near.join(profile.withColumnRenamed("day", "rain_day"), ["station_key", "rain_day"], "left")
    gauge = F.coalesce((F.col("_km") <= fixed.MAX_STATION_KM) & (F.col("n_valid") >= need_day), F.lit(False))
    lat1, lon1 = rounded(F.col("latitude"), 1), rounded(F.col("longitude"), 1)
    values = {c: F.when(gauge, rounded(F.col(c), 2)) for c in WINDOW_COLUMNS if c != "rain_24h"}
    return df.withColumns({
        **values,
        "rain_24h": F.when(gauge, rounded(F.col("rain_24h"), 2)).otherwise(rounded(F.col("grid_rainfall_mm"), 2)),
        "api_3d": F.when(gauge, F.col("api_3d")), "api_7d": F.when(gauge, F.col("api_7d")),
        "rainfall_source": F.when(gauge, "CWC").otherwise("GPM/IMERG"),
        "station_or_grid_id": F.when(
            gauge, F.concat(F.lit("CWC_STN_"), F.upper(F.regexp_replace("nearest.station", " ", "_")))
        ).otherwise(F.concat(F.lit("GPM_GRID_"), F.format_string("%.1f", lat1), F.lit("_"), F.format_string("%.1f", lon1))),
        "station_distance_km": F.when(gauge, rounded(F.col("_km"), 2)),
        "temporal_alignment": F.when(gauge & (F.col("event_time_precision") == "EXACT_TIME"), "EXACT").otherwise("SAME_DAY"),
    }).drop("nearest", "_km", "total")


def _spread(df: DataFrame, km: float) -> DataFrame:
    """Totals under their names with a b, once for each radius cell that they can be a partner of."""
    other = df.select(*[F.col(c).alias(f"b{c}") for c in df.columns], F.explode(radius_reach(F.col("_lat"), F.col("_lon"), km)).alias("_a"))
    return other.select("*", F.col("_a.i").alias("_ci"), F.col("_a.j").alias("_cj")).drop("_a")


def _in_cells(df: DataFrame, km: float) -> DataFrame:
    own = radius_cell(F.col("_lat"), F.col("_lon"), km)
    return df.drop("_n").withColumns({"_ci": own["i"], "_cj": own["j"]})


def _total(cond: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.expr(value))), F.lit(0))


def _place_partners(place: DataFrame, km: float) -> DataFrame | None:
    """Partner counts per place from the pairs of places in radius cells; None where there are more than PAIRS_A_PLACE of
    them for each place."""
    here, there = _in_cells(place, km), _spread(place, km)
    if pairs_near(here, ["_ci", "_cj"]) > PAIRS_A_PLACE:
        return None
    d = F.col("_d")
    apart = haversine_km(F.col("_lat"), F.col("_lon"), F.col("b_lat"), F.col("b_lon"))
    same = F.coalesce(F.col("_dist") == F.col("b_dist"), F.lit(False))
    total = lambda cond: _total(cond, "b_n")
    return here.join(unfolded(there), ["_ci", "_cj"]).withColumn("_d", apart).filter(d <= km).groupBy(*PLACE).agg(
        total(d < 0.05).alias("_p50m"), total(d < 1.0).alias("_p1k"), total(d >= 0.05).alias("_pfar"), total(same & (d >= 1.0)).alias("_psame"),
    )


def _day_partners(place_day: DataFrame, km: float, days: int) -> DataFrame | None:
    """The same per place and day, among the places of the days around it, in groups of WIDE_CELLS x WIDE_CELLS radius cells and
    WIDE_DAYS days: a row goes to the groups that it can be a partner in, not once to each cell and day."""
    if pairs_near(_in_cells(place_day, km), ["_day", "_ci", "_cj"], 9 * (2 * days + 1)) > PAIRS_A_PLACE:
        return None
    ship(place_day.sparkSession)
    lat, lon, day = F.col("_lat"), F.col("_lon"), F.col("_day")
    wide = lambda c: F.struct(F.floor(c["i"] / WIDE_CELLS).alias("i"), F.floor(c["j"] / WIDE_CELLS).alias("j"))
    own, reach = radius_cell(lat, lon, km), F.col("_reach")
    home = F.struct(F.floor(day / WIDE_DAYS).alias("b"), wide(own).alias("at"))
    blocks = F.sequence(F.floor((day - days) / WIDE_DAYS), F.floor((day + days) / WIDE_DAYS))
    homes = F.flatten(F.transform(blocks, lambda b: F.transform(F.array_distinct(F.transform(reach, wide)), lambda c: F.struct(b.alias("b"), c.alias("at")))))
    reached = place_day.withColumn("_reach", radius_reach(lat, lon, km))
    rows = reached.select(*PLACE, "_day", "_n", own.alias("_own"), F.size(F.filter(reach, lambda c: c["i"] == reach[0]["i"])).alias("_cells"), reach[0]["j"].alias("_j"), home.alias("_home"), F.explode(homes).alias("_g"))
    here = (F.col("_g") == F.col("_home")).alias("_here")
    dealt = rows.select(F.col("_g.b").alias("_b"), F.col("_g.at.i").alias("_wi"), F.col("_g.at.j").alias("_wj"), here, *PLACE, "_day", "_n", F.col("_own.i").alias("_ci"), F.col("_own.j").alias("_cj"), "_j", "_cells")
    names = ("_d50m", "_d1k", "_dfar", "_dge50m", "_dnear", "_dsame")
    schema = f"_lat double, _lon double, _dist string, {day_type(place_day)}, " + ", ".join(f"{n} long" for n in names)
    turn = max(1, int(360.0 / degrees_for_km(km)))
    return dealt.groupBy("_b", "_wi", "_wj").applyInArrow(near_in_days(km, days, turn, names), schema)


def day_type(df: DataFrame) -> str:
    return f"_day {df.schema['_day'].dataType.simpleString()}"


def near_in_days(km: float, days: int, turn: int, names: Sequence[str]):
    """The function of one group of _day_partners: its own rows (_here) with the numbers of rows (_n) near them, by class; each row
    counts itself. `turn` cells of longitude are a circle, and a row reaches _cells cells of each of three rows, from _j on."""

    def near(table: pa.Table) -> pa.Table:
        of = lambda c: table.column(c).to_numpy()
        lat, lon, day, n, ci, cj = of("_lat"), of("_lon"), of("_day").astype(np.int64), of("_n").astype(float), of("_ci"), of("_cj")
        codes = pc.fill_null(pc.dictionary_encode(table.column("_dist").combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(of("_here"))
        span = of("_cells")
        first_day, first_row = day.min(), ci.min() - 1
        key = lambda d, i, j: ((d - first_day) * (ci.max() - first_row + 2) + (i - first_row)) * turn + j % turn
        # each row once for each cell that it reaches
        row = np.repeat(np.arange(len(lat)), span)
        step = np.arange(len(row)) - np.repeat(np.cumsum(span) - span, span)
        keys = np.concatenate([key(day[row], ci[row] + k, of("_j")[row] + step) for k in (-1, 0, 1)])
        order = np.argsort(keys, kind="stable")
        keys, row = keys[order], np.concatenate([row] * 3)[order]
        out = np.zeros((len(names), len(here)))
        x, y, cos = np.radians(lat), np.radians(lon), np.cos(np.radians(lat))
        limits = [np.sin(r / EARTH_KM) ** 2 for r in (0.05, 1.0, km)]

        def below(a: np.ndarray, k: int) -> np.ndarray:
            """Distances below 50 m and 1 km, or up to km, by the haversine's a; on the limit by the distance itself."""
            fits = a < limits[k]
            close = np.flatnonzero(np.abs(a - limits[k]) <= 1e-9 * limits[k])
            d = EARTH_KM * np.arctan2(np.sqrt(a[close]), np.sqrt(np.maximum(0.0, 1.0 - a[close])))
            fits[close] = d <= km if k == 2 else d < (0.05, 1.0)[k]
            return fits

        for gap in range(-days, days + 1):
            wanted = key(day[here] + gap, ci[here], cj[here])
            start, end = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
            pairs = np.cumsum(end - start)
            at = 0
            while at < len(here):
                done = pairs[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(pairs, done + PAIRS_AT_ONCE, "right")))
                many = (end - start)[at:to]
                mine = np.repeat(np.arange(at, to), many)
                other = row[np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[at:to], many)]
                at, own = to, here[mine]
                s, t = np.sin((x[other] - x[own]) / 2), np.sin((y[other] - y[own]) / 2)
                a = s * s + cos[own] * cos[other] * (t * t)
                within = below(a, 2)
                a, mine, own, other = a[within], mine[within], own[within], other[within]
                count = lambda cond: np.bincount(mine[cond], n[other[cond]], len(here))
                every = np.ones(len(a), bool)
                out[4] += count(every)
                out[5] += count((codes[own] == codes[other]) & (codes[own] >= 0))
                if gap == 0:
                    m50, k1 = below(a, 0), below(a, 1)
                    for k, cond in enumerate((m50, k1, ~k1, ~m50)):
                        out[k] += count(cond)
        columns = [table.column(c).take(pa.array(here)) for c in (*PLACE, "_day")]
        return pa.Table.from_arrays([*columns, *[pa.array(v.astype(np.int64)) for v in out]], names=[*PLACE, "_day", *names])

    return near


def _partners_by_pairs(place: DataFrame, place_day: DataFrame, km: float, days: int) -> tuple[DataFrame, DataFrame] | None:
    """Partner counts per place, and per place and day, from pairs; None where there are too many of either."""
    by_place, by_day = _place_partners(place, km), _day_partners(place_day, km, days)
    return None if by_place is None or by_day is None else (by_place, by_day)


def _partners_by_sums(place: DataFrame, place_day: DataFrame | None, km: float, days: int) -> tuple[DataFrame, DataFrame | None]:
    """The same counts from the sums of cells (cells.count_within): of all places, and by day, district, and both; without
    place_day those per place only."""
    steps = F.explode(F.array(*[F.lit(s) for s in range(-days, days + 1)]))

    def named(kind: str, *parts: Column) -> Column:
        return F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts])

    def groups(day: Column | None) -> Column:
        own = [] if day is None else [day]
        every, alike = ("all", "district") if day is None else ("day", "both")
        options = [F.struct(F.lit(every).alias("kind"), named(every, *own).alias("_key"))]
        options.append(F.when(F.col("_dist").isNotNull(), F.struct(F.lit(alike).alias("kind"), named(alike, *own, F.col("_dist")).alias("_key"))))
        return F.explode(F.array_compact(F.array(*options))).alias("g")

    of_place = place.select(*PLACE, "_n", groups(None)).select(*PLACE, "_n", "g.*")
    totals, asked = of_place.select("_key", "_lat", "_lon", "_n"), of_place.select("_key", "_lat", "_lon")
    if place_day is not None:
        of_day = place_day.select(*PLACE, "_day", "_n", groups(F.col("_day"))).select(*PLACE, "_day", "_n", "g.*")
        around = place_day.select(*PLACE, "_day", steps.alias("_step")).select("*", groups(F.col("_day") + F.col("_step"))).select(*PLACE, "_day", "_step", "g.*")
        totals, asked = totals.union(of_day.select("_key", "_lat", "_lon", "_n")), asked.union(around.select("_key", "_lat", "_lon"))
    totals = totals.groupBy("_key", F.col("_lat").alias("_ilat"), F.col("_lon").alias("_ilon")).agg(F.sum("_n").alias("_n"))
    asked = asked.distinct()
    under = [math.nextafter(0.05, 0.0), math.nextafter(1.0, 0.0), km]  # below 50 m and 1 km, up to km
    counts = settle(count_within(settle(asked, "asked"), settle(totals, "totals"), under, "_key"), "counted")
    kind, now = F.col("kind"), F.col("_step") == 0
    by_place = unfolded(of_place).join(counts, ["_key", "_lat", "_lon"]).groupBy(*PLACE).agg(
        _total(kind == "all", "w0").alias("_p50m"), _total(kind == "all", "w1").alias("_p1k"),
        _total(kind == "all", "w2 - w0").alias("_pfar"), _total(kind == "district", "w2 - w1").alias("_psame"),
    )
    if place_day is None:
        return by_place, None
    by_day = unfolded(around).join(counts, ["_key", "_lat", "_lon"]).groupBy(*PLACE, "_day").agg(
        _total((kind == "day") & now, "w0").alias("_d50m"), _total((kind == "day") & now, "w1").alias("_d1k"),
        _total((kind == "day") & now, "w2 - w1").alias("_dfar"), _total((kind == "day") & now, "w2 - w0").alias("_dge50m"),
        _total(kind == "day", "w2").alias("_dnear"), _total(kind == "both", "w2").alias("_dsame"),
    )
    return by_place, by_day


def pair_review(events: DataFrame, key: str, day: str, district: str, km: float = 50.0, days: int = 2) -> DataFrame:
    """Review of each event's partners: those within km, or within days of it.

    Partners are counted per class and never listed: in a dense place or on a busy date the list
    of pairs is quadratic. Counting runs on the totals of places, and of places by day, so that events that
    share them cost one row; in dense places it runs on the sums of cells.

    - reactivation: under 50 m, another day
    - ward_cluster: under 1 km, same day
    - corridor_cluster: 1 km to km, same day
    - independent: the other partners
    - high_similarity: partners under 1 km on any day; moderate_similarity: the others of the same
      district; low_similarity: the rest. A missing district is like no other.
    """
    at = events.select(
        key, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col(district).alias("_dist"), F.col(day).alias("_day")
    ).filter("_lat is not null and _lon is not null and _day is not null")
    where = PLACE
    place_day = settle(at.groupBy(*where, "_day").agg(F.count(F.lit(1)).alias("_n")), "place-days")
    place = settle(place_day.groupBy(*where).agg(F.sum("_n").alias("_n")), "places")
    steps = F.explode(F.array(*[F.lit(s) for s in range(-days, days + 1)]))
    by_day = _day_partners(place_day, km, days)
    by_place = None if by_day is None else _place_partners(place, km)
    if by_place is None:
        by_place, summed = _partners_by_sums(place, place_day if by_day is None else None, km, days)
        by_day = summed if by_day is None else by_day

    # close in time anywhere, per day, and per day and district
    def around_day(keys: list[str], name: str) -> DataFrame:
        return (
            place_day.groupBy("_day", *keys).agg(F.sum("_n").alias("b_n"))
            .select("_day", *keys, "b_n", steps.alias("_step")).withColumn("_day", F.col("_day") + F.col("_step"))
            .groupBy("_day", *keys).agg(F.sum("b_n").alias(name))
        )

    alike = [by_day[c].eqNullSafe(by_place[c]) for c in where]
    counts = by_day.join(by_place, alike).select(by_day["*"], "_p50m", "_p1k", "_pfar", "_psame")
    # one row a day and district: what no district has is NULL
    known = place_day.select("_day", "_dist").distinct()
    around = known.join(around_day([], "_anywhere"), "_day").join(around_day(["_dist"], "_anysame"), ["_day", "_dist"], "left")
    around = settle(around.withColumnsRenamed({"_day": "_aday", "_dist": "_adist"}), "around")
    counts = counts.join(around, (F.col("_day") == F.col("_aday")) & F.col("_dist").eqNullSafe(F.col("_adist"))).drop("_aday", "_adist")
    partners = F.col("_p50m") + F.col("_pfar") - 1 + F.col("_anywhere") - F.col("_dnear")
    high = F.col("_p1k") - 1
    moderate = F.col("_psame") + F.coalesce(F.col("_anysame") - F.col("_dsame"), F.lit(0))
    counts = counts.select(
        *where, "_day",
        (F.col("_p50m") - F.col("_d50m")).alias("reactivation"),
        (F.col("_d1k") - 1).alias("ward_cluster"),
        F.col("_dfar").alias("corridor_cluster"),
        (F.col("_pfar") - F.col("_dge50m") + F.col("_anywhere") - F.col("_dnear")).alias("independent"),
        high.alias("high_similarity"), moderate.alias("moderate_similarity"), (partners - high - moderate).alias("low_similarity"),
    )
    joined = at.join(counts.withColumnsRenamed({c: f"k{c}" for c in (*where, "_day")}), [at[c].eqNullSafe(F.col(f"k{c}")) for c in (*where, "_day")])
    return joined.select(
        key, "reactivation", "ward_cluster", "corridor_cluster", "independent", "high_similarity", "moderate_similarity", "low_similarity"
    )


def rain_distribution(linked: DataFrame) -> DataFrame:
    """Distribution of the 24 h rain of all events."""
    rain = settle(linked.select("rain_24h"), "rain")
    stats = rain.agg(
        F.count("rain_24h").alias("n"), rounded(F.avg("rain_24h")).alias("mean"), rounded(F.stddev_samp("rain_24h")).alias("std"),
        F.min("rain_24h").alias("min"), F.max("rain_24h").alias("max"),
    )
    names = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    q = exact_quantiles(rain, [], "rain_24h", names).select(*[rounded(F.col(c)).alias(c) for c in names])
    both = stats.unionByName(q, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def rain_by_state(linked: DataFrame) -> DataFrame:
    rain = settle(linked.select("state", "rain_24h"), "rain")
    stats = rain.groupBy("state").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("rain_24h")).alias("mean"),
        F.min("rain_24h").alias("min"), F.max("rain_24h").alias("max"),
    )
    q = exact_quantiles(rain, ["state"], "rain_24h", {"median": 0.5}).withColumn("median", rounded(F.col("median")))
    return stats.join(q, "state", "left")


def window_availability(linked: DataFrame, columns: Sequence[str] = WINDOW_COLUMNS) -> DataFrame:
    """Valid values and their share per window."""
    wide = linked.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = unpivot(wide, {c: F.col(c) for c in columns}, keep=["_n"], name="window", value="valid")
    return long.select("window", "valid", (F.col("_n") - F.col("valid")).alias("missing"),
                       rounded(F.col("valid") / F.col("_n") * 100.0, 2).alias("valid_pct"))


def threshold_exceedance(linked: DataFrame) -> DataFrame:
    watch, high = fixed.RAIN_THRESHOLDS["24h"]
    r = F.col("rain_24h")
    bands = {"high": r >= high, "watch": (r >= watch) & (r < high), "below": r < watch}
    return linked.agg(
        F.count(r).alias("n"), *[F.count_if(c).alias(f"{k}_count") for k, c in bands.items()],
        *[rounded(F.count_if(c) / F.count(r) * 100.0, 2).alias(f"{k}_pct") for k, c in bands.items()],
    )


def qc_summary(linked: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Event totals by each dimension, as (dimension, value, n), in one grouping-sets pass."""
    sets = [[F.col(d)] for d in dimensions]
    counts = linked.groupingSets(sets, *dimensions).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions])
    name = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_g_{d}") == 0, F.col(d)) for d in dimensions])
    return counts.select(name.alias("dimension"), value.alias("value"), "n")


TIME_PRECISIONS = ("EXACT_TIME", "DATE_ONLY", "MONTH_ONLY", "YEAR_ONLY", "UNKNOWN")
ALIGNMENTS = ("EXACT", "SAME_DAY", "WITHIN_24H", "WITHIN_72H", "DATE_ONLY", "UNKNOWN")


def enum_checks(linked: DataFrame, register: DataFrame, confidences: Sequence[str]) -> DataFrame:
    """(check, n): values outside their lists, unregistered sources, totals, invented zeros."""
    grid = F.col("rainfall_source") == "GPM/IMERG"
    aggs = {
        "events": F.count(F.lit(1)),
        "bad_time_precision": F.count_if(~F.col("event_time_precision").isin(*TIME_PRECISIONS)),
        "bad_alignment": F.count_if(~F.col("temporal_alignment").isin(*ALIGNMENTS)),
        "bad_confidence": F.count_if(~F.col("confidence").isin(*confidences)),
        "grid_rows_with_subdaily": F.count_if(grid & (F.col("rain_1h").isNotNull() | F.col("rain_72h").isNotNull())),
        "fatalities": F.coalesce(F.sum("fatalities"), F.lit(0)),
    }
    flat = unpivot(linked.agg(*[c.alias(k) for k, c in aggs.items()]), {k: F.col(k) for k in aggs}, name="check")
    orphan = linked.join(register, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unregistered_source_events").alias("check"), "n"
    )
    return flat.unionByName(orphan)


def temporal_feasibility(samples: DataFrame, station_days: DataFrame, days: int = 7) -> DataFrame:
    """How many samples can get antecedent windows: dated, with a reading in the days up to it.

    samples has station_key and sample_day; station_days has station_key and day.
    """
    span = station_days.select("station_key", F.explode(F.sequence(F.col("day"), F.col("day") + days)).alias("sample_day")).distinct()
    marked = samples.join(span.withColumn("_ok", F.lit(True)), ["station_key", "sample_day"], "left")
    ok = F.col("_ok").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("samples"), F.count("sample_day").alias("dated"), F.count_if(ok).alias("feasible"),
        F.count_if(~ok).alias("impossible"), rounded(F.avg((~ok).cast("double")) * 100.0).alias("impossible_pct"),
    )

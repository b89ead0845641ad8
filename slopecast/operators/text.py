"""Labelled mentions to the eight-feature vector, for a whole table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast import fixed
from slopecast.functions import text as tx
from slopecast.operators.quality import broken_rule

# Feature -> (kind of quantity, labels in order of preference).
ALIASES = {
    "rainfall_24h": ("rain", ("24-hour rainfall", "24h rainfall", "1-day rainfall", "daily rainfall", "rainfall 24h")),
    "rainfall_3d": ("rain", ("3-day rainfall", "3d rainfall", "72-hour rainfall", "rainfall 3d")),
    "rainfall_7d": ("rain", ("7-day rainfall", "7d rainfall", "weekly rainfall", "cumulative 7-day rainfall", "rainfall 7d")),
    "slope": ("slope", ("slope", "slope angle", "terrain slope", "gradient")),
    "elevation": ("elevation", ("elevation", "altitude", "elevation above sea level")),
    "historical_landslide": ("flag", ("historical landslide", "past landslide", "prior landslide", "previous landslide")),
    "distance_to_landslide": (
        "distance", ("distance to landslide", "distance to historical landslide", "proximity to landslide", "distance"),
    ),
    "soil_risk": ("soil", ("soil risk", "soil susceptibility", "soil erodibility index", "soil index")),
    "_generic": ("rain", ("rainfall",)),
}


def first_mentions(mentions: DataFrame) -> DataFrame:
    """First text per document and known label, with its feature, preference and normal value.

    mentions has doc_id, line_no, label and text.
    """
    table = F.create_map(*[
        x for feat, (kind, labels) in ALIASES.items() for i, lab in enumerate(labels)
        for x in (F.lit(lab), F.struct(F.lit(feat).alias("feature"), F.lit(kind).alias("kind"), F.lit(i).alias("rank")))
    ])
    known = [lab for _, labels in ALIASES.values() for lab in labels]
    df = mentions.withColumn("label", F.lower(F.trim("label"))).filter(F.col("label").isin(known))
    df = df.groupBy("doc_id", "label").agg(F.min(F.struct("line_no", "text")).alias("_m"))
    df = df.withColumn("_a", F.try_element_at(table, F.col("label"))).select(
        "doc_id", "label", "_a.*", F.col("_m.text").alias("text")
    )
    number, unit = tx.quantity_value(F.col("text")), tx.quantity_unit(F.col("text"))
    normal = tx.normal_quantity(F.col("kind"), number, unit)
    flag = tx.landslide_flag(F.col("text")).cast("double")
    is_flag = F.col("kind") == "flag"
    return df.withColumn("_n", normal).select(
        "doc_id", "label", "feature", "rank", "text",
        F.when(is_flag, flag).otherwise(F.col("_n.value")).alias("value"),
        F.when(~is_flag, F.col("_n.warning")).alias("warning"),
    )


def entity_features(mentions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per document: the eight features, missing names, warnings, sources and readiness.

    texts (doc_id, text) gives the context: it can place an unlabelled rainfall in the 24 h window
    and state a past landslide. The whole text is read where it lies; only two flags are joined.
    """
    per = first_mentions(mentions)
    # the first soil label counts even when it has no number
    usable = F.col("value").isNotNull() | (F.col("feature") == "soil_risk")
    aggs = []
    for feat in ALIASES:
        pick = F.when((F.col("feature") == feat) & usable, F.col("rank"))
        aggs.append(F.min_by(F.struct("value", "label", "warning", "text"), pick).alias(f"_{feat}"))
    wide = per.groupBy("doc_id").agg(*aggs)
    if texts is None:
        wide = wide.withColumns({"_daily": F.lit(False), "_said": F.lit(None).cast("int")})
    else:
        context = texts.select("doc_id", tx.names_daily_window(F.col("text")).alias("_daily"), tx.landslide_flag(F.col("text")).alias("_said"))
        wide = wide.join(context, "doc_id", "left")
    generic = F.col("__generic")
    unplaced = F.col("_rainfall_24h").isNull() & generic.isNotNull()
    placed = unplaced & F.coalesce("_daily", F.lit(False))
    values = {f: F.col(f"_{f}.value") for f in fixed.FEATURES}
    values["rainfall_24h"] = F.when(placed, generic["value"]).otherwise(values["rainfall_24h"])
    values["historical_landslide"] = F.coalesce(values["historical_landslide"], F.col("_said").cast("double"))
    sources = {f: F.when(F.col(f"_{f}.value").isNotNull(), F.col(f"_{f}.label")) for f in fixed.FEATURES}
    sources["rainfall_24h"] = F.when(placed, F.lit("rainfall (24 h from context)")).otherwise(sources["rainfall_24h"])
    sources["historical_landslide"] = F.coalesce(
        sources["historical_landslide"], F.when(F.col("_said").isNotNull(), F.lit("document context"))
    )
    warnings = [
        F.when(F.col(f"_{f}.warning").isNotNull(), F.concat(F.col(f"_{f}.warning"), F.lit(f":{f}"))) for f in fixed.FEATURES
    ]
    warnings.append(F.when(unplaced & ~placed, "AMBIGUOUS_RAINFALL"))
    out = wide.select(
        "doc_id", *[v.alias(k) for k, v in values.items()],
        F.array_compact(F.array(*warnings)).alias("warnings"),
        F.map_filter(F.create_map(*[x for k, v in sources.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()).alias("sources"),
    )
    gone = F.array_compact(F.array(*[F.when(F.col(f).isNull(), f) for f in fixed.FEATURES]))
    broken = F.array_compact(F.array(*[
        F.when(broken_rule(F.col(n), lo, hi).isNotNull(), F.concat(broken_rule(F.col(n), lo, hi), F.lit(f":{n}"))) for n, lo, hi in fixed.FEATURE_LIMITS
    ]))
    out = out.withColumn("missing_features", gone)
    complete = F.size("missing_features") == 0
    return out.withColumns({
        "warnings": F.when(complete, F.concat("warnings", broken)).otherwise(F.col("warnings")),
        "prediction_ready": complete & (F.size(broken) == 0),
    })

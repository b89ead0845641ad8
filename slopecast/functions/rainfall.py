"""Rainfall classes and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast import fixed


def finite(c: Column) -> Column:
    """NaN and infinities, as columnar sources write them for missing numbers, become NULL."""
    return F.when(F.abs(c) < float("inf"), c)


def rainfall_class(mm: Column) -> Column:
    """Quality class of one reading; extremes are marked for review, never clipped. What is no number is missing."""
    mm = finite(mm)
    return (
        F.when(mm.isNull(), "MISSING")
        .when(mm < 0, "INVALID_NEGATIVE")
        .when(mm > fixed.EXTREME_MM, "EXTREME_REVIEW")
        .when(mm > fixed.HIGH_REVIEW_MM, "HIGH_REVIEW")
        .when(mm > 0, "VALID")
        .otherwise("ZERO")
    )


def quality_flag(mm: Column, collision: Column, thin_24h: Column) -> Column:
    """One flag per reading: thin window first, then collision, extreme and missing."""
    mm = finite(mm)
    return (
        F.when(thin_24h, "LOW_24H_COVERAGE")
        .when(collision, "TIMESTAMP_COLLISION")
        .when(mm > fixed.EXTREME_MM, "EXTREME_REVIEW")
        .when(mm.isNull(), "MISSING_RAINFALL")
        .otherwise("OK")
    )


def in_domain(lat: Column, lon: Column) -> Column:
    """Inside the domain box; NULL coordinates count as outside."""
    return F.coalesce(
        lat.between(fixed.LAT_MIN, fixed.LAT_MAX) & lon.between(fixed.LON_MIN, fixed.LON_MAX), F.lit(False)
    )


def usable(ts: Column, lat: Column, lon: Column, mm: Column) -> Column:
    """Dated, inside the domain and not negative; a missing amount stays usable, whether NULL, NaN or infinite."""
    return ts.isNotNull() & in_domain(lat, lon) & (mm.isNull() | (mm >= 0) | (mm == float("-inf")))


def ingested(rows: DataFrame) -> DataFrame:
    """The usable rows of a telemetry table or stream, with missing amounts as NULL.

    The one way in for jobs that build features; the conditions are on the source columns, so that
    they are pushed to the scan where possible. Coordinates that are no numbers lie outside the domain.
    """
    kept = rows.filter(usable(F.col("ts"), F.col("latitude"), F.col("longitude"), F.col("rainfall_1h")))
    return kept.withColumn("rainfall_1h", finite(F.col("rainfall_1h")))

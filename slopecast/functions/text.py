"""Quantities, units and statements in report text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopecast.functions.columns import rounded

# Fixed patterns and word lists.
QUANTITY = r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)\s*([a-zA-Z°%]+)?"
NEGATIVE_WORDS = (
    r"no\s+past", r"no\s+prior", r"no\s+previous", r"no\s+historical", r"no\s+landslide",
    "none", "false", "0", "absent", "zero",
)
POSITIVE_WORDS = (
    "occurred", "previous", "past", "history", "yes", "true", "documented", "prior", "1", "present", "recorded",
)
UNITS = {
    "mm": ("mm", "millimeter", "millimeters", "millimetres"),
    "cm": ("cm", "centimeter", "centimeters", "centimetres"),
    "m": ("m", "meter", "meters", "metre", "metres"),
    "km": ("km", "kilometer", "kilometre", "kilometres", "kilometers"),
    "in": ("in", "inch", "inches"),
    "ft": ("ft", "feet", "foot"),
    "mi": ("mi", "mile", "miles"),
    "deg": ("deg", "degree", "degrees", "°"),
    "%": ("%", "percent", "percentage"),
}


def whole_words(words: tuple[str, ...]) -> str:
    """Pattern for any of the words not touching another letter, digit or underscore."""
    edge = r"[^\p{L}\p{N}_]"
    return f"(^|{edge})({'|'.join(words)})({edge}|$)"


def quantity_value(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), QUANTITY, 1).try_cast("double")


def quantity_unit(text: Column) -> Column:
    """Unit after the first number, lower case; NULL without a number or unit."""
    unit = F.lower(F.regexp_extract(F.trim(text), QUANTITY, 2))
    return F.when(unit != "", unit)


def _is(unit: Column, *kinds: str) -> Column:
    names = [n for k in kinds for n in UNITS[k]]
    return F.coalesce(unit.isin(*names), F.lit(False))


def normal_quantity(kind: Column, value: Column, unit: Column) -> Column:
    """Struct (value, warning) in mm, degrees, m, km or 0..1 for the kind of quantity.

    An unknown unit keeps the number and warns; words never become numbers.
    """
    bare = unit.isNull()
    rain = (
        F.when(_is(unit, "cm"), value * 10.0)
        .when(_is(unit, "m") & (unit != "metre"), value * 1000.0).when(_is(unit, "in"), value * 25.4).otherwise(value)
    )
    slope = F.when(_is(unit, "%"), rounded(F.degrees(F.atan(value / 100.0)), 2)).otherwise(value)
    elev = F.when(_is(unit, "ft"), rounded(value * 0.3048, 2)).when(_is(unit, "km"), value * 1000.0).otherwise(value)
    dist = F.when(_is(unit, "m"), rounded(value / 1000.0)).when(_is(unit, "mi"), rounded(value * 1.60934)).otherwise(value)
    soil = (
        F.when(unit.isin("%", "percent"), rounded(value / 100.0)).when((value >= 0) & (value <= 1), rounded(value))
        .when((value > 1) & (value <= 10), rounded(value / 10.0)).when((value > 10) & (value <= 100), rounded(value / 100.0))
    )
    known = (
        F.when(kind == "rain", bare | _is(unit, "mm", "cm", "in") | (_is(unit, "m") & (unit != "metre")))
        .when(kind == "slope", bare | _is(unit, "%", "deg"))
        .when(kind == "elevation", bare | _is(unit, "ft", "km", "m"))
        .when(kind == "distance", bare | _is(unit, "m", "km", "mi"))
        .otherwise(F.lit(True))
    )
    out = (
        F.when(kind == "rain", rain).when(kind == "slope", slope).when(kind == "elevation", elev)
        .when(kind == "distance", dist).when(kind == "soil", soil)
    )
    warning = (
        F.when(value.isNull(), F.when(kind == "soil", "QUALITATIVE").otherwise("NO_NUMBER"))
        .when(~known, "UNKNOWN_UNIT").when((kind == "soil") & soil.isNull(), "OUT_OF_RANGE")
    )
    return F.struct(out.alias("value"), warning.alias("warning"))


def landslide_flag(text: Column) -> Column:
    """0 when the text denies a past landslide, 1 when it states one, else NULL; denial wins."""
    low = F.trim(F.lower(text))
    return F.when(low.rlike(whole_words(NEGATIVE_WORDS)), 0).when(low.rlike(whole_words(POSITIVE_WORDS)), 1)


def names_daily_window(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("24-hour") | low.contains("24 hour") | low.contains("daily")

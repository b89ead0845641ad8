"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.session import load_table, scratch_path, settle, ship

__all__ = ["crc_of_id", "load_table", "map_batches", "rows_total", "scratch_path", "settle", "ship", "store", "text_or_empty"]


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with the package at hand on every executor; Spark bounds a batch by rows and bytes."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(name: str) -> Column:
    """The text column; null reads as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str) -> Column:
    """Unsigned CRC-32 of the id written in decimal; null stays null."""
    return F.crc32(F.col(name).cast("string").cast("binary"))


def store(df: DataFrame, label: str) -> DataFrame:
    """Like settle, with zstd files: for wide payloads."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_total(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


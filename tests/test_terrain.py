"""Neighbourhoods of grids in blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slopecast.operators import terrain


@pytest.mark.parametrize("block", [3, 4, 256])
def test_neighbours_in_blocks(spark, block):
    rng = random.Random(4)
    cells = {(k, r, c): None if rng.random() < 0.1 else rng.random() for k in "ab" for r in range(-3, 14) for c in range(11)}
    grid = spark.createDataFrame([(*k, z) for k, z in cells.items()], "tile string, grid_row bigint, grid_col bigint, elev double")
    got = terrain.neighbourhood(grid, ["tile"], block).collect()
    assert len(got) == len(cells)
    for x in got:
        for dr in range(-2, 3):
            for dc in range(-2, 3):
                there = x[terrain.n_name(dr, dc)]
                at = (x.tile, x.grid_row + dr, x.grid_col + dc)
                assert (there is not None) == (at in cells) and (there is None or there.z == cells[at])


def test_a_wide_row_is_cut_into_blocks_in_one_exchange(spark):
    wide = spark.range(1_000_000).select(F.lit(0).cast("bigint").alias("grid_row"), F.col("id").alias("grid_col"), (F.col("id") % 7).cast("double").alias("elev"))
    out = terrain.neighbourhood(wide)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # both window passes run inside it
    got = out.agg(F.count(F.lit(1)), F.sum("n_0_m2.z"), F.sum("n_0_2.z"), F.count("n_1_0")).first()
    assert tuple(got) == (1_000_000, float(sum(i % 7 for i in range(999_998))), float(sum(i % 7 for i in range(2, 1_000_000))), 0)


def test_tasks_follow_the_cells(spark):
    grid = spark.range(200_000).select(F.floor(F.col("id") / 100).alias("grid_row"), (F.col("id") % 100).alias("grid_col"), F.lit(1.0).alias("elev"))
    assert terrain.neighbourhood(grid).rdd.getNumPartitions() == -(-200_000 // terrain.CELLS) > 4

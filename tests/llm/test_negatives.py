"""Hard negatives against brute force; the order and the end of the multi-index search."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopecast.llm import negatives

CLASHES = "cell int, sub int, q string, k1 long, w int, ids long, id string, score int"


def brute(rows, every):
    used = {}
    dims = max((len(v) for i, v, lab in rows if None not in (i, v, lab)), default=0)
    for i, v, lab in rows:
        if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v):
            used[i, lab, tuple(math.floor(256 * x) for x in v) + (0,) * (dims - len(v))] = None
    used = list(used)
    out = []
    for a in (r for r in used if r[0] % every == 0):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in used if b is not a))
        for back, p, _ in [s for s in scored if s[2] == a[1]][:5]:
            fits = [(-s, i) for s, i, lab in scored if lab != a[1] and 50 * -back <= 100 * -s <= 95 * -back]
            out += [(a[0], p, k, i, -back, s) for k, (s, i) in enumerate(fits[:3], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4, 5, "y", 6) for r in rows], "vec_id long, embedding array<float>, label int, " + CLASHES).repartition(3)


def clustered(rng, n, dims=8):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for k in range(n):
        c = rng.randrange(12)
        rows.append((k, [float(np.float32(x + rng.gauss(0, 0.15))) for x in centres[c]], c % 4 if rng.random() < 0.7 else rng.randrange(4)))
    return rows


def found(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CELL", 20), ("FIRST", 100), ("BLOCK", 16), ("BATCH", 5)):
            monkeypatch.setattr(negatives, name, value)
    rng = random.Random(2)
    rows = clustered(rng, 1500)
    hot = rows[7][1]
    rows += [(2000 + k, hot, k % 2) for k in range(600)]  # copies, with ties of all kinds
    rows += [(4000, None, 1), (4050, [1.0, None] + [0.0] * 6, 1), (4100, [float("nan")] * 8, 2), (4150, [float("inf")] + [0.0] * 7, 1), (4200, hot, None), (None, hot, 1)]
    rows += [(50, rows[50][1], rows[50][2]), (5000, [0.0] * 8, 1), (5050, [-x for x in hot], 1), (5100, hot[:3], 2), (5150, [], 3)]
    docs = table(spark, rows)
    got = found(negatives.hard_negatives(docs, F.col("id") % 50 == 0))
    assert got == brute(rows, 50) and len(got) > 300


def test_few_rows(spark):
    anchor = F.col("id") % 2 == 0
    assert found(negatives.hard_negatives(table(spark, []), anchor)) == []
    for rows in ([(2, [1.0], 1)], [(2, [1.0], 1), (3, [2.0], 1), (5, [0.75], 2), (7, [0.6], 0)], [(2, [], 1), (3, [], 1), (4, [], 2)]):
        assert found(negatives.hard_negatives(table(spark, rows), anchor)) == brute(rows, 2)


def test_large_components(spark):
    rows = [(2, [1e6, -3e6], 1), (3, [2e6, 1e6], 1), (4, [-1e6, -2e6], 1), (5, [0.5e6, -2e6], 2), (7, [1e6, -2.2e6], 0)]
    assert found(negatives.hard_negatives(table(spark, rows), F.col("id") % 2 == 0)) == brute(rows, 2)
    huge = [(2, [1e30, 1.0], 1), (3, [1e30, 2.0], 1), (5, [3e29, 1.0], 2)]
    negatives.hard_negatives(table(spark, huge), F.col("id") % 2 == 0).collect()  # held within 64 bits


def test_visits_in_order_until_certain():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (40, 16))
    rows = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 15, (4000, 16)))
    codes = [negatives.fitted_codes(h, 16) for h in negatives.halves(rows)]
    near = [negatives.nearest_codes(h, c) for h, c in zip(negatives.halves(rows), codes)]
    far = [np.sqrt(np.square(h - c[n]).sum(axis=1)) for h, c, n in zip(negatives.halves(rows), codes, near)]
    radii = [np.array([f[n == k].max(initial=0) for k in range(len(c))]) for f, n, c in zip(far, near, codes)]
    width = len(codes[1])
    cell = near[0] * width + near[1]
    book = negatives.Book(codes, radii, np.bincount(cell, minlength=len(codes[0]) * width), 1)
    looked = 0
    for k in range(0, 4000, 200):
        scores = rows @ rows[k]
        need = np.sort(scores)[-6]
        cells = [c for c, _ in negatives.visits(book, rows[k], need, np.inf)]
        assert set(cell[scores >= need]) <= set(cells) and len(cells) == len(set(cells))
        looked += book.sizes[cells].sum()
        best = [scores[cell == c].max() for c, _ in negatives.visits(book, rows[k], -np.inf, np.inf)]
        assert len(best) == len(set(cell)) and max(best[:3]) == scores.max()
        low, high = 0.5 * scores.max(), 0.6 * scores.max()
        inside = [c for c, _ in negatives.visits(book, rows[k], low, high)]
        assert set(cell[(scores >= low) & (scores <= high)]) <= set(inside)
    assert looked < 0.2 * 20 * 4000  # the bounds end the search early


def test_requests_are_packed_by_lot(spark, monkeypatch):
    for name, value in (("CELL", 20), ("FIRST", 100), ("BLOCK", 16)):
        monkeypatch.setattr(negatives, name, value)
    rows = clustered(random.Random(5), 800)
    nodes = negatives.vectors(negatives.keyed(table(spark, rows), "vec_id", "embedding", "label")).cache()
    blocks, book, total = negatives.indexed(nodes, 8)
    everything = {"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf"))), "needs": F.array(F.lit(float("-inf")))}
    asked = nodes.select("k1", "k2", "label", "q").withColumns(everything)
    packs = negatives.requests(asked, book, 8, False).count()  # not a row for each query and block
    assert total == 800 and packs <= 2 * spark.sparkContext.defaultParallelism * len(set(r["lot"] for r in blocks.select("lot").distinct().collect()))
    assert packs < 800 * (book.sizes > 0).sum() / 2

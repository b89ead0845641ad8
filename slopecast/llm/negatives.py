"""Hard negatives through an inverted multi-index: cells of two half-space codebooks, visited in the order of their bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopecast.llm.common import map_batches, settle

POSITIVES, NEGATIVES = 5, 3
#: Share of the positive's score (per cent) that a negative's score must lie within.
LOW, HIGH = 50, 95
#: Distinct vectors that the codebooks are fitted on at most; the index holds every row.
TRAIN = 8192
#: Vectors of a cell, about, and most codes of a half: the K x K cells that every task knows are bounded by it.
CELL, MOST_CODES = 1024, 256
#: Vectors of a block (a crowded cell has several), queries of a batch, vectors that the first round looks at.
BLOCK, BATCH, FIRST = 512, 128, 4096
#: Blocks of a lot at most, which meets its queries in one group; queries times cells that are marked at a time.
LOT, QUERY_CELLS = 16, 1 << 22
ROUNDS = 12
_ASKED = "lot int, kind string, k1 binary, k2 binary, label binary, q binary, windows binary, lows binary, highs binary, wanted binary"
_HELD = "lot int, kind string, cell binary, label binary, q binary, counts binary, ids binary"
_HIT = "k1 long, k2 long, w int, score double, id long"


@dataclass
class Book:
    """What every task knows of the index: codes and radii of both halves, rows of each cell, blocks of a lot."""

    codes: list[np.ndarray]
    radii: list[np.ndarray]
    sizes: np.ndarray
    lot: int

    def firsts(self) -> np.ndarray:
        """Number of each cell's first block; blocks are numbered cell by cell."""
        n = -(-self.sizes // BLOCK)
        return n.cumsum() - n

    def spans(self) -> list[tuple[int, int]]:
        """The first cell of each lot, and the one after its last."""
        n = -(-self.sizes // BLOCK)
        of_block = np.repeat(np.arange(len(n)), n)
        return [(int(part[0]), int(part[-1]) + 1) for part in (of_block[k:k + self.lot] for k in range(0, len(of_block), self.lot))]


def keyed(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, q, k1, k2): the rows that take part, components as whole doubles; k1 and k2 digest label and vector.

    Rows with a null id, label or vector, or a null, NaN or infinite component take no part; shorter vectors are
    filled up with zeros. Equal rows are one row.
    """
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    used = used.where("id is not null and label is not null and x is not null and forall(x, v -> coalesce(abs(v) < double('infinity'), false))")
    dims = used.agg(F.max(F.size("x"))).first()[0] or 0
    whole = F.transform("x", lambda v: F.floor(v * 256).cast("double"))
    filled = F.concat(whole, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("x")))
    out = used.select("id", "label", filled.alias("q"))
    return out.withColumns({"k1": F.xxhash64("label", "q"), "k2": F.xxhash64(F.lit(1), "q", "label")}).dropDuplicates(["id", "k1", "k2"])


def vectors(rows: DataFrame) -> DataFrame:
    """(k1, k2, label, q, ids): every distinct labelled vector once, with its first ids.

    Copies have equal scores and follow each other by id, so an anchor's five positives among them and the
    anchor itself are the first six ids at most; the rest of a group of copies can stand in no result.
    """
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))  # Spark cuts groups down before the exchange, too
    first = rows.withColumn("place", place).where(F.col("place") <= max(POSITIVES + 1, NEGATIVES))
    return first.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("q").alias("q"), F.array_sort(F.collect_list("id")).alias("ids"))


def fitted_codes(sample: np.ndarray, codes: int, seed: int = 13) -> np.ndarray:
    """Centroids of a half of the sample by Lloyd's rounds from random distinct starts."""
    if not sample.size:
        return np.zeros((1, sample.shape[1]))
    points = np.unique(sample, axis=0)
    centres = points[np.random.default_rng(seed).permutation(len(points))[:codes]].astype(float)
    for _ in range(ROUNDS):
        near = nearest_codes(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest_codes(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1)[None, :] - 2 * half @ centres.T).argmin(axis=1)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def halves(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = q.shape[1] // 2
    return q[:, :middle], q[:, middle:]


def indexed(nodes: DataFrame, dims: int) -> tuple[DataFrame, Book, int]:
    """(lot, cell, label, q, ids) of every vector, and the book. Codebooks are fitted on TRAIN vectors by the least
    digests; radii and cell sizes are taken over all vectors."""
    total = nodes.agg(F.count(F.lit(1))).first()[0]
    sample = nodes.orderBy("k1", "k2").limit(TRAIN).select("q").toArrow().column(0).combine_chunks()  # TRAIN vectors at most
    codes = min(MOST_CODES, max(1, round(math.sqrt(total / CELL))))
    centres = [fitted_codes(h, codes) for h in halves(matrix(sample, dims))]
    width = len(centres[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = halves(matrix(batch.column(3), dims))
            near = [nearest_codes(h, c) for h, c in zip(parts, centres)]
            far = [np.sqrt(np.square(h - c[n]).sum(axis=1)) for h, c, n in zip(parts, centres, near)]
            cell = pa.array((near[0] * width + near[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, cell, pa.array(far[0]), pa.array(far[1])], names=["k1", "k2", "label", "q", "ids", "cell", "far1", "far2"])

    placed = map_batches(nodes.select("k1", "k2", "label", "q", "ids"), run, "k1 long, k2 long, label long, q array<double>, ids array<long>, cell int, far1 double, far2 double")
    placed = settle(placed, "cells")
    sizes = np.zeros(len(centres[0]) * width, np.int64)
    radii = [np.zeros(len(c)) for c in centres]
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)), F.max("far1"), F.max("far2")).collect():  # one row a cell, K x K at most
        sizes[r[0]] = r[1]
        for half, code, far in ((0, r[0] // width, r[2]), (1, r[0] % width, r[3])):
            radii[half][code] = max(radii[half][code], far)
    n_blocks = int((-(-sizes // BLOCK)).sum())
    book = Book(centres, radii, sizes, max(1, min(LOT, n_blocks // (4 * nodes.sparkSession.sparkContext.defaultParallelism))))
    counts = nodes.sparkSession.createDataFrame([(int(c), -(-int(n) // BLOCK), int(f)) for c, (n, f) in enumerate(zip(sizes, book.firsts())) if n], "cell int, subs int, first int")
    lot = F.floor((F.col("first") + F.pmod(F.col("k1"), F.col("subs"))) / book.lot).cast("int").alias("lot")
    blocks = placed.join(counts, "cell").select(lot, "cell", "label", "q", "ids")
    return blocks, book, total


def bounds(book: Book, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The greatest and the least that the product of a half of q with a row of each code can be."""
    tops, lows = [], []
    for half, codes, radii in zip(halves(q[None, :]), book.codes, book.radii):
        middle = codes @ half[0]
        reach = math.sqrt(float(half[0] @ half[0])) * radii
        slack = 1 + 1e-9 * (np.abs(middle) + reach)  # wider than any rounding
        tops.append(middle + reach + slack)
        lows.append(middle - reach - slack)
    return tops, lows


def visits(book: Book, q: np.ndarray, need: float, highest: float) -> Iterator[tuple[int, int]]:
    """(cell, its rows) in falling order of the bound on inner products with q, until no row of a later cell
    can score `need`; cells whose rows all score above `highest` are passed over.

    A half's product with a row lies within |half| times the radius of the product with the row's code. Both
    halves are sorted by that bound, and a heap takes the best sums, as in a multi-sequence search.
    """
    tops, lows = bounds(book, q)
    order = [np.argsort(-t, kind="stable") for t in tops]
    first, second = (t[o].tolist() for t, o in zip(tops, order))
    width = len(second)
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if -bound < need:
            return
        if j + 1 < width:
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
        one, two = int(order[0][i]), int(order[1][j])
        rows = int(book.sizes[one * width + two])
        if rows and lows[0][one] + lows[1][two] <= highest:
            yield one * width + two, rows


def wanted_cells(book: Book, q: np.ndarray, need: float, highest: float) -> np.ndarray:
    """For each cell, whether visits() gives it; the order makes no difference where all of them are looked at."""
    tops, lows = bounds(book, q)
    return ((tops[0][:, None] + tops[1][None, :] >= need) & (lows[0][:, None] + lows[1][None, :] <= highest)).ravel() & (book.sizes > 0)


def narrow(q: np.ndarray) -> np.ndarray:
    """Whole numbers in the least type that holds them."""
    largest = np.abs(q).max(initial=0)
    return q.astype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)


def requests(queries: DataFrame, book: Book, dims: int, first_round: bool) -> DataFrame:
    """_ASKED: for each lot of blocks the queries that look at some of its cells in a round, packed; `needs` (of the
    queries) are the least scores that can still stand in a result. The second round passes over what the first has seen."""
    spans = book.spans()
    step = max(16, QUERY_CELLS // max(1, len(book.sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                yield packed(whole.slice(at, step))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrix(batch.column(3), dims)
        lows, highs, needs = (batch.column(k).to_pylist() for k in (4, 5, 6))
        wanted = np.zeros((len(q), len(book.sizes)), bool)
        for k in range(len(q)):
            seen, before = 0, []
            for cell, size in visits(book, q[k], min(lows[k]), max(highs[k])):
                if seen >= FIRST:
                    break
                seen += size
                before.append(cell)
            if first_round:
                wanted[k, before] = True
            else:
                wanted[k] = wanted_cells(book, q[k], min(needs[k]), max(highs[k]))
                wanted[k, before] = False
        least = lows if first_round else needs
        k1, k2, label = (batch.column(k).to_numpy() for k in (0, 1, 2))
        small, windows = narrow(q), np.array([len(x) for x in lows], np.int32)
        rows = []
        for lot, (a, b) in enumerate(spans):
            part = wanted[:, a:b]
            some = np.flatnonzero(part.any(axis=1))
            if len(some):
                edges = [np.array([x for k in some for x in list_[k]], float) for list_ in (least, highs)]
                own = (k1[some], k2[some], label[some], small[some], windows[some], *edges, np.packbits(part[some], axis=1))
                rows.append((lot, small.dtype.str, *[x.tobytes() for x in own]))
        columns = list(zip(*rows)) if rows else [()] * 10
        types = (pa.int32(), pa.string(), *[pa.binary()] * 8)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _ASKED.split(", ")])

    dealt = queries.select("k1", "k2", "label", "q", "lows", "highs", "needs").repartition(2 * queries.sparkSession.sparkContext.defaultParallelism)
    return map_batches(dealt, run, _ASKED)


def lots(blocks: DataFrame, dims: int) -> DataFrame:
    """_HELD: the vectors of the blocks, packed by lot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lot, cell, label = (batch.column(k).to_numpy() for k in (0, 1, 2))
            q = matrix(batch.column(3), dims)
            ids = batch.column(4)
            counts, first = np.diff(ids.offsets.to_numpy()).astype(np.int32), ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)
            rows = []
            for k in np.unique(lot):
                some = np.flatnonzero(lot == k)
                small = narrow(q[some])
                own = (cell[some], label[some], small, counts[some], np.concatenate([values[first[r]:first[r + 1]] for r in some]))
                rows.append((k, small.dtype.str, *[x.tobytes() for x in own]))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = (pa.int32(), pa.string(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _HELD.split(", ")])

    return map_batches(blocks.select("lot", "cell", "label", "q", "ids"), run, _HELD)


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers (rows x queries), exact up to 2 ** 53; larger ones are summed as Python
    integers, held within 64 bits and given as the nearest doubles."""
    largest = (np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if largest < 2.0**53:
        return rows @ queries.T
    exact = np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape) @ np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1024).astype(float)  # the last double below 2 ** 63


def _ranked(score: np.ndarray, row: np.ndarray, ids: list[list[int]], low: float, high: float, most: int) -> list[tuple[float, int]]:
    """The first `most` (score, id) with a score from low to high; score falls."""
    at = int(np.searchsorted(-score, -high, side="left"))
    out: list[tuple[float, int]] = []
    while at < len(score) and score[at] >= low and len(out) < most:
        end = int(np.searchsorted(-score, -score[at], side="right"))
        tied = sorted(i for r in row[at:end] for i in ids[r])
        out += [(float(score[at]), i) for i in tied[:most - len(out)]]
        at = end
    return out


def block_hits(label, q, ids, seen, of_label, of_q, lows, highs, same: bool, most: int) -> Iterator[tuple[int, int, float, int]]:
    """(query, window, score, id): what the rows of a lot have for a batch of queries, the first `most` of each window;
    seen says which rows (second) each query (first) looks at."""
    scores = products(of_q, q)
    alike = of_label[:, None] == label[None, :]
    fits = seen & (alike if same else ~alike)
    fits &= scores >= np.array([min(x) for x in lows])[:, None]
    fits &= scores <= np.array([max(x) for x in highs])[:, None]
    if same:  # one open window: only what reaches the lot's own first places
        for k in np.flatnonzero(fits.sum(axis=1) > 4 * most):
            own = scores[k, fits[k]]
            fits[k] &= scores[k] >= np.partition(own, len(own) - most)[len(own) - most]
    of, row = np.nonzero(fits)
    value = scores[of, row]
    order = np.lexsort((-value, of))
    of, row, value = of[order], row[order], value[order]
    cuts = np.searchsorted(of, np.arange(len(of_q) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[k], cuts[k + 1]
        for w, (low, high) in enumerate(zip(lows[k], highs[k])):
            for score, i in _ranked(value[a:b], row[a:b], ids, low, high, most):
                yield k, w, score, i


def looked_up(wanted: DataFrame, held: DataFrame, book: Book, dims: int, same: bool, most: int) -> DataFrame:
    """_HIT rows of the requests: each lot of blocks meets all queries that ask for it, once."""
    spans = book.spans()
    names = ("k1", "k2", "w", "score", "id")
    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())

    def joined(table: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def vectors_of(table: pa.Table) -> np.ndarray:
        parts = [np.frombuffer(x, kind).astype(float) for x, kind in zip(table.column("q").to_pylist(), table.column("kind").to_pylist())]
        return np.concatenate(parts).reshape(-1, dims)

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            a, b = spans[key[0].as_py()]
            cell, label, counts, values = (joined(rows, c, t) for c, t in (("cell", np.int32), ("label", np.int64), ("counts", np.int32), ("ids", np.int64)))
            q = vectors_of(rows) if dims else np.zeros((len(cell), 0))
            ends = np.cumsum(counts)
            ids = [values[e - n:e].tolist() for e, n in zip(ends, counts)]
            k1, k2, of_label, windows = (joined(asked, c, t) for c, t in (("k1", np.int64), ("k2", np.int64), ("label", np.int64), ("windows", np.int32)))
            of_q = vectors_of(asked) if dims else np.zeros((len(k1), 0))
            bits = joined(asked, "wanted", np.uint8).reshape(len(k1), -1)
            cuts = np.cumsum(windows)[:-1]
            lows, highs = ([x.tolist() for x in np.split(joined(asked, c, float), cuts)] for c in ("lows", "highs"))
            for at in range(0, len(k1), BATCH):
                own = slice(at, at + BATCH)
                seen = np.unpackbits(bits[own], axis=1, count=b - a).astype(bool)[:, cell - a]
                found = block_hits(label, q, ids, seen, of_label[own], of_q[own], lows[own], highs[own], same, most)
                out += [(k1[at + x], k2[at + x], w, s, i) for x, w, s, i in found]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    parts = max(1, len(spans))
    asked, rows = (x.repartition(parts, "lot").groupBy("lot") for x in (wanted, held))
    return asked.cogroup(rows).applyInArrow(run, _HIT)


def first_of(hits: DataFrame, most: int) -> DataFrame:
    """(k1, k2, w, found): the first (score, id) of each window, scores falling, ids rising."""
    place = F.row_number().over(Window.partitionBy("k1", "k2", "w").orderBy(F.col("score").desc(), "id"))
    first = hits.withColumn("place", place).where(F.col("place") <= most)
    found = first.groupBy("k1", "k2", "w").agg(F.array_sort(F.collect_list(F.struct("place", "score", "id"))).alias("e"))
    return found.select("k1", "k2", "w", F.transform("e", lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id"))).alias("found"))


def search(queries: DataFrame, held: DataFrame, book: Book, dims: int, same: bool, most: int) -> DataFrame:
    """(k1, k2, w, found) for queries (k1, k2, label, q, lows, highs): the first `most` of each score window, among rows of the same
    or of other labels. Both rounds together look at every cell that could hold a better row, so the result is exact."""
    queries = settle(queries, "queries")
    near = settle(looked_up(requests(queries.withColumn("needs", F.col("lows")), book, dims, True), held, book, dims, same, most), "near")
    last = first_of(near, most).where(F.size("found") >= most).select("k1", "k2", "w", F.element_at("found", -1)["score"].alias("need"))
    lists = last.groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("w", "need"))).alias("known"))
    needs = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("known", w), low)))
    open_ = queries.join(lists, ["k1", "k2"], "left").withColumn("known", F.coalesce("known", F.expr("cast(map() as map<int, double>)"))).withColumn("needs", needs)
    far = looked_up(requests(open_, book, dims, False), held, book, dims, same, most)
    return settle(first_of(near.union(far), most), "found")


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 x); scores are integer inner products. is_anchor is a condition on `id`. An
    anchor's positives are its first five other rows of the same label by falling score, then rising id; a positive's
    negatives are the first three rows of other labels with LOW to HIGH per cent of its score. A negative
    score of a positive has none. Copies are searched once; see keyed for rows that take no part and repeats.
    Rows that share an id but differ are rows of their own. An empty table gives an empty table; other columns are not read.
    """
    used = settle(keyed(rows, id_col, vec_col, label_col), "vectors")
    nodes = settle(vectors(used), "nodes")
    dims = used.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    blocks, book, _ = indexed(nodes, dims)
    held = settle(lots(blocks, dims), "lots")
    square = F.aggregate("q", F.lit(0.0), lambda a, v: a + v * v)
    anchors = settle(used.where(is_anchor).select("id", "k1", "k2", square.alias("own")), "anchors")
    asked = nodes.join(anchors.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", "label", "q")
    asked = settle(asked, "asked")
    everything = {"lows": F.array(F.lit(float("-inf"))), "highs": F.array(F.lit(float("inf")))}
    alike = search(asked.withColumns(everything), held, book, dims, True, POSITIVES + 1)

    # in whole numbers, without passing 64 bits
    hundreds, rest = "(cast(p as bigint) div 100)", "(cast(p as bigint) % 100)"
    low = F.expr(f"cast({hundreds} * {LOW} + ceil({rest} * {LOW} / 100.0D) as double)")
    high = F.expr(f"cast({hundreds} * {HIGH} + floor({rest} * {HIGH} / 100.0D) as double)")
    scores = alike.select("k1", "k2", F.explode(F.array_distinct(F.transform("found", lambda e: e["score"]))).alias("p")).where("p >= 0")
    bounds = scores.select("k1", "k2", "p", low.alias("low"), high.alias("high")).where("low <= high")
    windows = bounds.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("ws"))
    windows = settle(windows, "windows")
    asked = asked.join(windows, ["k1", "k2"]).select("k1", "k2", "label", "q", F.col("ws.low").alias("lows"), F.col("ws.high").alias("highs"))
    unlike = search(asked, held, book, dims, False, NEGATIVES)
    negatives = unlike.join(windows, ["k1", "k2"]).select("k1", "k2", F.expr("ws[w].p").alias("p"), "found")

    # sums beyond 2 ** 53 may differ in their last bits
    own = F.expr("cast(array_position(transform(found, e -> e.id = id and (e.score = own or own >= 9007199254740992D)), true) as int)")
    others = F.expr("slice(if(at > 0, concat(slice(found, 1, at - 1), slice(found, at + 1, size(found))), found), 1, %d)" % POSITIVES)
    positives = anchors.join(alike.drop("w"), ["k1", "k2"]).withColumn("at", own).select("id", "k1", "k2", F.explode(others).alias("e"))
    both = positives.select("id", "k1", "k2", F.col("e.id").alias("positive_id"), F.col("e.score").alias("p")).join(negatives, ["k1", "k2", "p"])
    found = both.select(F.col("id").alias("anchor_id"), "positive_id", F.posexplode("found").alias("at", "e"), F.col("p").cast("long").alias("positive_score"))
    return found.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", F.col("e.score").cast("long").alias("negative_score"))

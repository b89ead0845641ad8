"""Near-duplicates by their five-word shingles: Golay keys of SimHashes, banded min-hashes, exact Jaccard, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import map_batches, settle, text_or_empty
from slopecast.llm.components import connected_components
from slopecast.llm.simhash import fingerprint, links, one_a_cluster

WIDTH = 5
#: Documents are near-duplicates from this Jaccard similarity of their shingle sets on (a fraction).
SIMILAR = (4, 5)
#: Bands of min-hashes and rows of a band: a pair at 0.8 shares no band in (1 - 0.8 ** 4) ** 30, about
#: one in 7 million cases, one at 0.9 in less than one in 10 ** 13.
BANDS, ROWS = 30, 4
#: Blocks of hash values that tell sets of some hundred shingles apart without comparing them.
BLOCKS = 512
# Factors and summands of the min-hashes, made by a rule.
_SEEDS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 11) for i in range(2 * BANDS * ROWS)], np.uint64)
FACTORS, SUMMANDS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words as in simhash.fingerprint, fewer words: the whole."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    after = np.cumsum([len(w) + 1 for w in words])
    width = min(width, len(words))
    starts = [0, *after[: len(words) - width].tolist()]
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[a:b - 1]) for a, b in zip(starts, after[width - 1:].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key a band from the min-hashes of a set; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at:at + 4096, None] * FACTORS + SUMMANDS).min(axis=0))
    keys = [xxhash.xxh3_64_intdigest(band.tobytes(), seed=i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, node, n, keys, fp) a row: node stands for the document's shingle set of n shingles, keys are
    its bands, fp its SimHash over the same shingles. Null texts read as empty; texts without a word have an empty set and no keys; repeated rows stay;
    an empty table gives an empty table; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = (shingles(t) for t in texts)
            made = [(xxhash.xxh3_64_intdigest(s.tobytes()), len(s), band_keys(s)) for s in sets]
            fps = np.array([fingerprint(t, WIDTH) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64)),
                    pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.list_(pa.int64())),
                    pa.array(fps, pa.int64()),
                ],
                names=["id", "text_hash", "node", "n", "keys", "fp"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    return map_batches(source, run, "id long, text_hash long, node long, n int, keys array<long>, fp long")


def block_bits(hashes: np.ndarray) -> np.ndarray:
    """BLOCKS bits as signed longs: one is set for each block of hash values that holds a shingle. A bit that
    another set lacks stands for a shingle at least that it has not."""
    bits = np.zeros(BLOCKS, np.uint8)
    bits[(hashes % np.uint64(BLOCKS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def shingle_sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, hashes, bits): the shingle sets of the wanted nodes, each from one of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # sets are as large as their texts
                part = batch.slice(at, 256)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                bits = pa.array([block_bits(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), bits], names=["node", "hashes", "bits"])

    first = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    own = docs.select(F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    made = map_batches(own.join(first, "text_hash").select("node", "text"), run, "node long, hashes array<long>, bits array<long>")
    return made.dropDuplicates(["node"])


def shared_counts(sets: DataFrame) -> DataFrame:
    """(node, n, shared, bits): sizes of the sets, and how many of their shingles stand in other sets, too."""
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("node"))
    alone = alone.where("sets = 1").groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("alone"))
    return sets.select("node", F.size("hashes").alias("n"), "bits").join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), "bits")


def fits(x: str, y: str) -> str:
    """Whether two sets can be similar: of x.n and y.n shingles a share must be common, and none can be that
    stand in one set alone, or in a block of hash values that the other set has nothing in."""

    def most(p: str, q: str) -> str:
        lacking = " + ".join(f"bit_count({p}.bits[{k}] & ~{q}.bits[{k}])" for k in range(BLOCKS // 64))
        return f"least({p}.shared, {p}.n - ({lacking}))"

    return f"{sum(SIMILAR)}L * least({most(x, y)}, {most(y, x)}) >= {SIMILAR[0]}L * ({x}.n + {y}.n)"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of SIMILAR or more, in whole numbers."""
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("s")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("t"))
    similar = f"{sum(SIMILAR)}L * size(array_intersect(s, t)) >= {SIMILAR[0]}L * (size(s) + size(t))"
    return pairs.join(left, "a").join(right, "b").where(similar).select("a", "b")


def golay_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): candidates by SimHash. Nodes with one fingerprint meet the least of them, and these meet where their
    fingerprints are tied within two bits (see simhash.links, by Golay keys); settled."""
    nodes = prints.where("n > 0").groupBy("node").agg(F.min("fp").alias("fp"))
    nodes = settle(nodes, "fingerprints")
    heads = settle(nodes.groupBy("fp").agg(F.min("node").alias("head")), "distinct")
    own = nodes.join(heads, "fp").select(F.col("head").alias("x"), F.col("node").alias("m"))
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("m"))
    near = links(heads).distinct().join(left, "a").join(right, "b").select("x", "m")
    both = own.union(near).where("x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b"))
    return settle(both.distinct(), "candidates")


def similar_links(docs: DataFrame, prints: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): links between nodes that have the same components as all similar pairs with a common band, or with
    SimHashes that are tied within two bits.

    Pairs by SimHash are verified first. At a similarity of 0.8 two SimHashes differ in about 10 bits, so those that
    are further apart than two bits meet by bands.
    The members of a band's bucket that can be similar at all (see fits) meet in three rounds, each verified:
    every node with the most central head of its buckets, the head being the set with the largest share of
    shingles that others have; then with the heads of all its buckets; then every pair. From the second
    round on only pairs in different components are looked at, and none twice. The heads join a group of
    near copies in work linear in its size, and sets with too many shingles of their own are out of the
    last round before pairs are formed. No pair is left out for the size of a bucket, and no bucket is
    gathered in one row.
    """
    nodes = prints.groupBy("node").agg(F.first("keys").alias("keys"))
    at = settle(nodes.select("node", F.explode("keys").alias("key")), "keys")
    crowded = at.groupBy("key").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("key")
    members = settle(at.join(crowded, "key"), "members")
    by_bits = golay_pairs(prints)
    wanted = members.select("node").union(by_bits.select("a")).union(by_bits.select("b")).distinct()
    sets = settle(shingle_sets(docs, prints, wanted, text_col), "sets")
    found = settle(verified(by_bits, sets), "similar")
    sizes = settle(shared_counts(sets), "sizes")
    share = F.struct((-F.col("shared") / F.col("n")).alias("rank"), "node", "n", "shared", "bits")
    members = settle(members.join(sizes, "node").withColumn("m", share).select("key", "node", "m"), "members")
    heads = members.groupBy("key").agg(F.min("m").alias("x"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("x.node", "m.node").alias("a"), F.greatest("x.node", "m.node").alias("b")).distinct()

    with_head = settle(members.join(heads, "key").where("x.node <> m.node").where(fits("x", "m")).select("x", "m").distinct(), "heads")
    nearest = with_head.groupBy("m").agg(F.min("x").alias("x"))
    pairs = settle(ordered(nearest).join(by_bits, ["a", "b"], "left_anti"), "candidates")
    found = settle(found.union(verified(pairs, sets)), "similar")
    tested = by_bits.union(pairs)
    for every in (False, True):
        parts = settle(connected_components(found), "parts")

        def placed(table: DataFrame, side: str, parts: DataFrame = parts) -> DataFrame:
            part = parts.select(F.col("node").alias("of"), F.col("component").alias(f"{side}_part"))
            return table.join(part, F.col(f"{side}.node") == F.col("of"), "left").drop("of").withColumn(f"{side}_part", F.coalesce(f"{side}_part", f"{side}.node"))

        if every:
            pairs = every_pair(placed(members, "m"))
        else:
            pairs = placed(placed(with_head, "m"), "x").where("x_part <> m_part")
        pairs = ordered(pairs).join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs, "candidates")
        found = settle(found.union(verified(pairs, sets)), "similar")
        tested = tested.union(pairs)
    return found


def every_pair(members: DataFrame) -> DataFrame:
    """(x, m) of all pairs in one bucket and different components that fit; members are (key, m, m_part).

    Members that fit with no size in their bucket go first. The members outside the component of the bucket's
    head meet all others, so a large component is not paired with itself.
    """
    for _ in range(2):
        about = members.groupBy("key").agg(F.min("m.n").alias("least"), F.min("m_part").alias("low"), F.max("m_part").alias("high"), F.min(F.struct("m", "m_part")).alias("head"))
        members = members.join(about, "key").where("low < high").where(f"{sum(SIMILAR)}L * m.shared >= {SIMILAR[0]}L * (m.n + least)")
        members = settle(members.select("key", "m", "m_part", F.col("head.m_part").alias("main")), "open")
    outside = members.where("m_part <> main").select("key", F.col("m").alias("x"), F.col("m_part").alias("x_part"), F.col("main").alias("x_main"))
    both = outside.join(members, "key").where("x_part <> m_part and (m_part = x_main or x_part < m_part)")
    return both.where(fits("x", "m")).select("x", "m")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, cluster) per document: documents with a Jaccard similarity of 0.8 or more of their
    sets of five-word shingles are linked, also through others; without any word (null texts, too) they are
    alike. Rows with a null id keep it; repeated rows stay and share a cluster; an empty table gives an empty
    table; other columns are not read."""
    prints = settle(shingled(docs, id_col, text_col), "shingled")
    parts = connected_components(similar_links(docs, prints, text_col)).withColumnRenamed("component", "cluster")
    return prints.join(parts, "node", "left").select("id", "text_hash", F.coalesce("cluster", "node").alias("cluster"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates (see simhash.one_a_cluster for the one that stays)."""
    return one_a_cluster(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)

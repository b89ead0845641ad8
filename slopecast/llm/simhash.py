"""SimHash near-duplicates: Golay-code keys, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopecast.llm import golay
from slopecast.llm.common import map_batches, settle, text_or_empty
from slopecast.llm.components import connected_components

WIDTH = 3
SEED = 42
MAX_BITS = 2
#: Buckets of up to this many fingerprints are compared pair by pair; larger ones by midpoints.
PAIRED = 64
#: The three parts of a fingerprint: lowest bit and length.
PARTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a text (see fingerprints)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(joined)]
    else:
        after = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], after[:-width]]).tolist()
        ends = (after[width - 1:] - 1).tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):
        part = zip(starts[at:at + 65536], ends[at:at + 65536])
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, text_hash, fingerprint) per document; fingerprint is the 64 bits as a signed long.

    A-Z are lowered; words are runs without ASCII white space; shingles are `width` words joined by
    a space, repeats included (fewer words: the whole sequence). A bit is set when it is set in more
    than half of the shingles' XXH64 (seed 42). Null, empty and blank texts have fingerprint zero.
    text_hash tells texts with the same id apart. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values.view(np.int64), pa.int64())], names=["id", "text_hash", "fingerprint"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    return map_batches(source, run, "id long, text_hash long, fingerprint long")


def golay_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for distinct fingerprints: one part exactly, with the Golay indices of the next.

    With two errors in three parts, one part has none, and the next has at most two: for that pair
    of parts, both fingerprints give the same exact part and share a Golay index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [((fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in PARTS]
            near = [golay.fuzzy_keys(p) for p in parts]
            for i in range(3):
                index = near[(i + 1) % 3]
                rows, cols = np.nonzero(index >= 0)
                key = ((parts[i][rows] << 12 | index[rows, cols]) << 2) | i
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[rows], pa.int64())], names=["key", "fp"])

    return map_batches(fps.select("fp"), run, "key long, fp long")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that have the same components as all pairs of distinct fingerprints within two bits.

    Candidates share a Golay key. Buckets of up to 64 fingerprints are joined with themselves and
    verified. In a larger bucket every member also stands at each word one bit away or itself:
    members at one such midpoint (65 at most, whatever the data) are within two bits of each other,
    and two members within two bits have a midpoint, so tying those at a midpoint to the least of
    them loses no link and compares no pairs.
    """
    keys = settle(golay_keys(fps), "golay")
    size = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = settle(size, "buckets")
    small = keys.join(size.where(F.col("n") <= PAIRED).select("key"), "key", "left_semi")
    left = small.select("key", F.col("fp").alias("a"))
    right = small.select("key", F.col("fp").alias("b"))
    pairs = left.join(right, "key").where(F.col("a") < F.col("b")).where(_apart("a", "b") <= MAX_BITS).select("a", "b")

    dense = keys.join(size.where(F.col("n") > PAIRED).select("key"), "key", "left_semi").select("fp").distinct()
    flips = "transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))"
    at = dense.select("fp", F.explode(F.expr(flips)).alias("midpoint"))
    groups = at.groupBy("midpoint").agg(F.collect_set("fp").alias("members")).where("size(members) > 1")
    ties = groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.union(ties)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, fingerprint, cluster, component_id) per document.

    Documents with equal fingerprints, or with fingerprints that differ in one or two bits, are
    linked; cluster is the least fingerprint reachable and component_id the least id of the cluster
    (null if all its ids are null). Repeated rows stay and share a component. An empty table gives
    an empty table. Nothing is capped: see links for hot buckets.
    """
    prints = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    least = settle(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("least")), "distinct")
    nodes = connected_components(links(least))
    tagged = settle(
        least.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("cluster")), "clusters"
    )
    heads = tagged.groupBy("cluster").agg(F.min("least").alias("component_id"))
    final = settle(tagged.join(heads, "cluster").select(F.col("fp").alias("fingerprint"), "cluster", "component_id"), "heads")
    return prints.join(final, "fingerprint").select("id", "text_hash", "fingerprint", "cluster", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates (see one_a_cluster for the one that stays)."""
    return one_a_cluster(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def one_a_cluster(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each cluster in found (id, text_hash, cluster) the document with the least id stays
    (null ids last, then the least text hash); of repeated equal rows one stays. All columns are kept."""
    identity = "concat(coalesce(cast(id as string), '-'), ':', hex(text_hash))"
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"))
    winners = (
        found.groupBy("cluster").agg(F.min(order).alias("w"))
        .select(F.col("w.id").alias("id"), F.col("w.text_hash").alias("text_hash")).select(F.expr(identity).alias("__identity"))
    )
    tagged = docs.withColumn(
        "__identity", F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64(text_or_empty(text_col))))
    )
    kept = tagged.join(settle(winners, "winners"), "__identity", "left_semi")
    return kept.dropDuplicates(["__identity"]).select(*docs.columns)

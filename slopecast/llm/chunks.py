"""Substring deduplication on content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slopecast.llm.common import map_batches, settle, ship, text_or_empty

#: Mean chunk in bytes; a chunk ends where the rolling hash is below 2 ** 16 / MEAN.
MEAN = 32
#: Bytes that the rolling hash sees.
SPAN = 16
#: A run of repeated chunks counts as a repeated passage from this many bytes on (about 15 words;
#: a passage of 50 words loses the part before its first and after its last cut).
MIN_BYTES = 96
#: Random 16-bit numbers of the gear hash, made by a rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last is its length.

    The gear hash h = 2 h + gear[byte] modulo 2 ** 16 depends on the last 16 bytes only, so a cut
    depends on nothing else: after an insertion the cuts are the same again 16 bytes later. There is
    no least or largest chunk, which would carry the effect on. A cut inside a UTF-8 character is
    not made. An empty text has no chunk.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = GEAR[data]
    width = 1
    while width < SPAN:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint16(width))
        width *= 2
    ends = np.flatnonzero(h < (1 << 16) // MEAN) + 1
    ends = ends[(ends >= SPAN) & (ends < len(data))]
    ends = ends[(data[ends] & 0xC0) != 0x80]
    return np.append(ends, len(data))


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, length, digest) of every chunk of every whole text; places are bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, hashes, counts, starts, lengths, digests = [], [], [], [], [], []

            def rows() -> pa.RecordBatch:
                n = np.array(counts)
                take = pa.array(np.repeat(np.arange(len(n)), n))
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(heads, pa.int64()).take(take), pa.array(hashes, pa.int64()).take(take),
                        pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(lengths), pa.int32()),
                        pa.array(np.array(digests, np.uint64).view(np.int64)),
                    ],
                    names=["id", "text_hash", "start", "length", "digest"],
                )

            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                ends = cuts(np.frombuffer(raw, np.uint8))
                if not len(ends):
                    continue
                begin = np.concatenate([[0], ends[:-1]])
                heads.append(doc_id)
                hashes.append(text_hash)
                counts.append(len(ends))
                starts.append(begin)
                lengths.append(ends - begin)
                digests += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), ends.tolist())]
                if len(digests) >= 100_000:
                    yield rows()
                    heads, hashes, counts, starts, lengths, digests = [], [], [], [], [], []
            if counts:
                yield rows()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash"), text_or_empty(text_col).alias("text"))
    return map_batches(source, run, "id long, text_hash long, start int, length int, digest long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, text_hash, start, length, first_id, repeated_bytes) of passages that other documents have too.

    A chunk is repeated when documents of two ids have its digest; its first document is the one
    with the least id, where it stays. Adjoining repeated chunks make a run; runs of min_bytes on
    count. repeated_bytes are those of the run that stand in an earlier document: 0 where the run is
    the first occurrence. Documents with equal or null ids count as one document (nulls come last);
    repeats within one document are no repeats. Null and empty texts have no passage. Digests have
    64 bits: a chance collision touches one chunk, and a run needs several.
    """
    chunks = settle(chunk_table(docs, id_col, text_col).withColumn("rank", F.coalesce("id", F.lit((1 << 63) - 1))), "chunks")
    owners = chunks.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    owners = settle(owners.select("digest", "first"), "owners")
    shared = chunks.join(owners, "digest").select("id", "text_hash", "rank", "start", "length", "first")
    order = W.partitionBy("id", "text_hash").orderBy("start")
    before = F.lag(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).over(order)
    # a repeated row has its chunks twice, side by side: the second ones go
    once = shared.withColumn("before", before).where(F.col("before").isNull() | (F.col("before.start") < F.col("start")))
    opened = F.when(F.col("before.end") == F.col("start"), 0).otherwise(1)
    runs = once.withColumn("opened", opened).withColumn("run", F.sum("opened").over(order))
    spans = runs.groupBy("id", "text_hash", "run").agg(
        F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.min("first").alias("first_id"),
        F.sum(F.when(F.col("first") < F.col("rank"), F.col("length")).otherwise(0)).cast("int").alias("repeated_bytes"),
    )
    return spans.where(F.col("length") >= min_bytes).drop("run")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of docs with repeated passages cut from all but the document where they come first.

    A run with a repeated byte is cut whole. The text of other documents, and all other columns, stay as they are.
    """
    ship(docs.sparkSession)
    found = repeated_passages(docs, id_col, text_col, min_bytes).where("repeated_bytes > 0")
    key = "concat(coalesce(cast(id as string), '-'), ':', hex(text_hash))"
    spans = found.groupBy(F.expr(key).alias("__identity")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__spans"))
    tagged = docs.withColumn(
        "__identity", F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("-")), F.lit(":"), F.hex(F.xxhash64(text_or_empty(text_col))))
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)])

    joined = tagged.join(spans, "__identity", "left")
    text = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    for span in spans:
        out.append(raw[at:span["start"]])
        at = span["start"] + span["length"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

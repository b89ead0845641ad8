"""Token ids of whole texts, and their binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slopecast.llm import eliasfano
from slopecast.llm.common import map_batches, scratch_path, text_or_empty

END_ID = 1
#: A block is closed when it holds this many ids; a longer document has a block of its own.
BLOCK_IDS = 1 << 19
#: Words and pieces whose ids a worker keeps; a full store is emptied.
KEPT_WORDS = 300_000
MAGIC = b"TIDB"
_HEAD = struct.Struct("<4sBxxxIQI")
BLOCK_SCHEMA = "shard int, block int, shard_start long, n_docs long, n_ids long, payload binary"


class WordStore(dict):
    """Ids, as bytes, of each white-space separated word; the tokenizer is asked once per piece.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are
    those of its words. A word of plain Latin letters, digits and ASCII signs is split into the
    pre-tokenizer's pieces, which go to the library's BPE model; any other word goes through the
    library's whole pipeline.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-įĲ-ž]*")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, tokenizer, dtype: str):
        super().__init__()
        self.tokenizer, self.dtype, self.pieces = tokenizer, dtype, {}
        self.signs = _byte_signs()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= KEPT_WORDS:
                self.pieces.clear()
            signs = piece.encode().decode("latin-1").translate(self.signs)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(signs)], dtype=self.dtype).tobytes()
            self.pieces[piece] = found
        return found

    def __missing__(self, word: str) -> bytes:
        if self.PLAIN.fullmatch(word):
            found = b"".join(map(self._piece, self.PIECE.findall(word.lower())))
        else:
            found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found
        return found


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Spark-free state of a Python worker: one encoder per vocabulary file.
@functools.cache
def encoder(path: str, dtype: str) -> Encoder:
    return Encoder(path, dtype)


class Encoder:
    """Whole texts to ids with one vocabulary; `by_words` tells whether words are independent."""

    #: Separators on which Python and the vocabulary's pattern disagree, and the start of control strings.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = dtype
        parts = json.loads(self.tokenizer.to_str())
        splits = [s.get("behavior") for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_words = parts["model"].get("end_of_word_suffix") == "</w>" and splits[:1] == ["Removed"]
        self.words = WordStore(self.tokenizer, dtype) if self.by_words else None

    def ids(self, text: str) -> np.ndarray:
        if not self.by_words or any(s in text for s in self.ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), dtype=self.dtype)


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it, else four."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def pack_block(doc_ids: list, bounds: list[int], ids: np.ndarray) -> bytes:
    """One self-contained block: header, null flags, document ids, Elias-Fano bounds, ids.

    bounds has the end of each document within the block.
    """
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    numbers = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    marks = eliasfano.encode(np.array(bounds, np.uint64))
    return _HEAD.pack(MAGIC, ids.dtype.itemsize, len(doc_ids), len(ids), len(marks)) + nulls + numbers + marks + ids.tobytes()


def unpack_block(data: bytes) -> tuple[list, eliasfano.Reader, np.ndarray]:
    """Document ids, boundary reader and ids of a block."""
    magic, width, n_docs, n_ids, n_marks = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    flags = -(-n_docs // 8)
    nulls = np.unpackbits(np.frombuffer(data, np.uint8, flags, at), bitorder="little", count=n_docs)
    at += flags
    numbers = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    reader = eliasfano.Reader(data[at:at + n_marks])
    at += n_marks
    ids = np.frombuffer(data, f"<u{width}", n_ids, at)
    return [None if x else int(d) for d, x in zip(numbers, nulls)], reader, ids


def write_ids(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    end_id: int = END_ID, block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text and write blocks of ids in ascending document order below path.

    Documents are dealt by ranges of their id, so a task writes one shard, block after block, and
    shard numbers follow the ids. Null texts are empty and have the end id alone; null ids come
    first; equal ids stand side by side in the order of their text hash; other columns are not read.
    An empty table gives no block. A task holds one block and one batch of texts.
    """
    dtype = id_type(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, dtype).ids
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], dtype)
        doc_ids, bounds, parts, held, block, start = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            payload = pack_block(doc_ids, bounds, np.concatenate(parts))
            row = {"shard": shard, "block": block, "shard_start": start, "n_docs": len(doc_ids), "n_ids": held, "payload": payload}
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(texts[i].as_py())
                if held and held + len(ids) + 1 > block_ids:
                    yield close()
                    block, start = block + 1, start + held
                    doc_ids, bounds, parts, held = [], [], [], 0
                parts += (ids, end)
                held += len(ids) + 1
                doc_ids.append(doc_id)
                bounds.append(held)
        if held:
            yield close()

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    dealt = source.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    map_batches(dealt, run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, block_bytes) of every document in written files.

    Boundaries come from the blocks' Elias-Fano select; the start adds the ids of earlier blocks and
    shards. The shard totals are one row per writing task, which bounds the broadcast.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    order = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("shard_start")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, reader, ids = unpack_block(payload.as_py())
                ends = reader.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(ends - starts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return map_batches(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files of a table to the shared folder and read their documents back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, tokenizer_path, id_col, text_col)
    return read_ids(spark, path)

"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopecast.llm.common import map_batches, store

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""Content without control strings: each `<|`, with any backslashes between, gets one backslash more."""
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: a newline would end it."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """Turns as START role newline text END newline, START and END being ids above the vocabulary."""

    def __init__(self, path: str, learn_end: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.start = self.tokenizer.get_vocab_size()
        self.end = self.start + 1
        self.newline = self._encode(["\n"])[0]
        self.learn_end = learn_end

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mask, bounds) of (role, text) turns in a row; turn k is ids[bounds[k]:bounds[k + 1]].

        Every segment is encoded by itself, so no token spans two. Segment places are the prefix sums
        of their lengths; the mask is the prefix sum of +1 where a learned text starts and -1 where
        it ends.
        """
        heads = self._encode([escape_role(r) + "\n" for r, _ in turns])
        texts = self._encode([escape(t) for _, t in turns])
        one = lambda i: np.array([i], np.int32)
        parts, learned = [], []
        for (role, _), head, text in zip(turns, heads, texts):
            own = int(role == LEARNED_ROLE)
            parts += (one(self.start), head, text, one(self.end), self.newline)
            learned += (0, 0, own, own * self.learn_end, 0)
        places = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        delta = np.zeros(places[-1] + 1, np.int32)
        flags = np.array(learned, np.int32)
        np.add.at(delta, places[:-1], flags)
        np.add.at(delta, places[1:], -flags)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return ids, np.cumsum(delta)[:-1].astype(np.int8), places[::5]

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """(role, text, learned text, formatted characters) of one assembled turn."""
        if ids[0] != self.start or self.end not in ids[1:]:
            raise ValueError("not an assembled turn")
        stop = 1 + int(np.argmax(ids[1:] == self.end))
        body = self.tokenizer.decode(ids[1:stop].tolist(), skip_special_tokens=False)
        tail = self.tokenizer.decode(ids[stop + 1:].tolist(), skip_special_tokens=False)
        learned = ids[(mask > 0) & (ids < self.start)]
        said = self.tokenizer.decode(learned.tolist(), skip_special_tokens=False)
        role, _, text = body.partition("\n")
        return unescape_role(role), unescape(text), unescape(said), len(START) + len(body) + len(END) + len(tail)


@functools.cache
def template(path: str, learn_end: bool = False) -> Template:
    """One template a Python worker."""
    return Template(path, learn_end)


def formatted(turns: DataFrame, tokenizer_path: str, learn_end: bool = False) -> DataFrame:
    """(conv_id, turn, ids, mask) of every row (conv_id, turn, role, text), without a shuffle.

    A conversation's token stream is its rows' ids in the order of turn (nulls first), ties by
    formatted ids. Null roles and texts are empty; a null conv_id is a conversation of its own.
    learn_end puts the END id of learned turns under the mask. Other columns are not read; an empty
    table stays empty. A row is one turn, so a hot conversation is spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(tokenizer_path, learn_end)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, mask, bounds = form.assemble(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist())))
                offsets = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                    names=["conv_id", "turn", "ids", "mask"],
                )

    empty = F.lit("")
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return map_batches(source, run, "conv_id long, turn long, ids array<int>, mask array<tinyint>")


def turns_back(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turn, role, text, learned, chars) read from formatted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = template(tokenizer_path)
        for batch in batches:
            read = [form.read(i.values.to_numpy(), m.values.to_numpy()) for i, m in zip(batch.column(2), batch.column(3))]
            role, text, learned, chars = zip(*read) if read else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(learned, pa.string()), pa.array(chars, pa.int64())],
                names=["conv_id", "turn", "role", "text", "learned", "chars"],
            )

    return map_batches(rows, run, "conv_id long, turn long, role string, text string, learned string, chars long")


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation: turns and learned text digested in the order of turn.

    SHA-256 takes a conversation's bytes one after another, so a conversation is hashed in one
    place; rows stream through sorted, and a task holds one batch and one running hash, however
    long the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> pa.RecordBatch:
            values = [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        done = []
        for batch in batches:
            for conv_id, role, text, learned, chars in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != key:
                    if state is not None:
                        done.append(row())
                    key, state = conv_id, [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += chars
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state is not None:
            yield row()

    dealt = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(dealt.select("conv_id", "role", "text", "learned", "chars"), run, schema)


def conversation_digests(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """Format all turns, write the token rows, read them back and digest every conversation."""
    return digests(turns_back(store(formatted(turns, tokenizer_path), "chat"), tokenizer_path))

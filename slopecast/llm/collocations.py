"""Phrases that stand together more often than their parts, counted in quotient filters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopecast.llm import quotient
from slopecast.llm.common import map_batches, settle, ship, text_or_empty

LONGEST = 4
LEAST_COUNT = 30
#: A phrase goes if a longer one that holds it is found in this share (per cent) of its places.
COVERED = 80
TOP = 2000
#: Parts that a language's phrases are ranked in first, so that the last ranking reads PARTS times `top` and their ties.
PARTS = 32
#: Bytes of text that are split at once, words of a buffer, and n-grams that one task's filter takes.
SLICE, BUFFER, FILTER = 1 << 22, 1 << 20, 1 << 20
#: Words of the corpus a shard, about; it bounds what one merge holds.
SHARD = 1 << 18
#: Most bits of the bitmaps of frequent words and pairs that go to every task (16 MB). A fuller bitmap lets more
#: rare n-grams into the filters; it never keeps a frequent one out.
BITMAP_BITS = 27
WORD_BITS = (40, 48, 56, 64)
# A-Z are lowered, punctuation and line ends become a byte that UTF-8 never holds, tabs blanks.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + 10 * _BREAK + b" ")


def word_slices(text: str) -> Iterator[list[bytes]]:
    """Lower-case words of a text with _BREAK between pieces, in slices of bounded length cut at blanks."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_BREAK, b" \xff ")
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE) if at + SLICE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class WordIds(dict):
    """Ids of the words of one language: the top bits of a hash, 0 for a break; kept for the next time."""

    def __init__(self, lang: str, bits: int, seed: int):
        super().__init__()
        self.prefix, self.shift, self.seed = lang.encode("utf-8", "surrogatepass") + b"\0", 64 - bits, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = 0 if word == _BREAK else xxhash.xxh3_64_intdigest(self.prefix + word, self.seed) >> self.shift
        self[word] = found
        return found


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, f): occurrences of every word of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = seen.setdefault(lang, Counter())
                for words in word_slices(text):
                    mine.update(words)
            for lang, mine in seen.items():
                mine.pop(_BREAK, None)
                words = pa.array(list(mine), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), words, pa.array(list(mine.values()), pa.int64())], names=["lang", "word", "f"])

    found = map_batches(_source(docs, text_col, lang_col), run, "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def with_ids(words: DataFrame) -> tuple[DataFrame, int, int]:
    """words (settled) with `id`, and the bits and seed of the ids: the fewest bits that give every word its own
    id. That is tested over all words, so that no two are ever counted as one."""
    total = words.agg(F.count(F.lit(1))).first()[0]
    for seed in range(1, 100):
        for bits in WORD_BITS:
            if bits < 64 and total**2 >= 1 << bits:
                continue

            def run(batches: Iterator[pa.RecordBatch], bits: int = bits, seed: int = seed) -> Iterator[pa.RecordBatch]:
                ids: dict[str, WordIds] = {}
                for batch in batches:
                    langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                    made = [ids.setdefault(lang, WordIds(lang, bits, seed))[word] for lang, word in zip(langs, texts)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(made, np.uint64).view(np.int64))], names=["lang", "word", "f", "id"])

            out = settle(map_batches(words, run, "lang string, word string, f long, id long"), "words")
            if out.groupBy("id").count().where("count > 1 or id = 0").limit(1).count() == 0:
                return out, bits, seed
    raise RuntimeError("no seed gives every word its own id")


def bitmap(keys: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """Bitmap of the top bits of `key` (ids of `bits` bits), of a size by the number of keys up to BITMAP_BITS."""
    n = keys.agg(F.count(F.lit(1))).first()[0]
    size = min(BITMAP_BITS, max(16, (16 * n).bit_length()))
    place = F.shiftrightunsigned("key", bits - size)
    chunk = 15  # bits of a piece's places: 4 KB

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        piece = np.zeros(1 << chunk, np.uint8)
        piece[frame["place"].to_numpy() & ((1 << chunk) - 1)] = 1
        return pd.DataFrame({"chunk": [int(frame["place"].iloc[0]) >> chunk], "piece": [np.packbits(piece).tobytes()]})

    places = keys.select(place.alias("place")).distinct()
    pieces = places.groupBy(F.shiftright("place", chunk).alias("c")).applyInPandas(run, "chunk long, piece binary")
    whole = np.zeros((1 << size) // 8, np.uint8)
    for row in pieces.toLocalIterator():  # 4 KB each, 16 MB in all at most
        at = row.chunk << (chunk - 3)
        whole[at:at + len(row.piece)] = np.frombuffer(row.piece, np.uint8)
    return whole, size


def _held(whole: np.ndarray, size: int, keys: np.ndarray, bits: int) -> np.ndarray:
    at = (keys >> np.uint64(bits - size)).astype(np.int64)
    return (whole[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def buffers(batches: Iterable[pa.RecordBatch], bits: int, seed: int) -> Iterator[tuple[np.ndarray, int]]:
    """Arrays of word ids with 0 at breaks, and how many of the first ones stood in the array before."""
    ids: dict[str, WordIds] = {}
    parts, held, carried = [], 0, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            of = ids.setdefault(lang, WordIds(lang, bits, seed))
            for words in word_slices(text):
                parts.append(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)))
                held += len(words)
                if held >= BUFFER:
                    whole = np.concatenate(parts)
                    yield whole, carried
                    tail = whole[-(LONGEST - 1):]
                    parts, held, carried = [tail], len(tail), len(tail)
            parts.append(np.zeros(1, np.uint64))
    if parts:
        yield np.concatenate(parts), carried


def gram_filters(docs: DataFrame, sizes: tuple[int, ...], bits: int, seed: int, above: int, known, text_col: str, lang_col: str) -> DataFrame:
    """(n, shard, block): quotient filters of the n-grams of the given sizes, cut by the shards of `above` bits.

    known(ids) gives for every place whether an n-gram of the least size may start there; longer ones need
    all their parts of that size.
    """

    def blocks(n: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        grams = np.concatenate(parts)
        lead, rest, counts = quotient.counted(quotient.permuted(grams, bits), grams[:, 1:], np.ones(len(grams), np.int64))
        shard = (lead >> np.uint64(bits - above)).astype(np.int64) if above else np.zeros(len(lead), np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        rows = [(int(shard[a]), quotient.packed(lead[a:b], rest[a:b], counts[a:b], bits, above)) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["n", "shard", "block"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {n: [] for n in sizes}
        for ids, carried in buffers(batches, bits, seed):
            least = known(ids)
            for n in sizes:
                starts = len(ids) - n + 1
                if starts <= 0:
                    continue
                fits = np.ones(starts, bool)
                for k in range(n - sizes[0] + 1):
                    fits &= least[k:k + starts]
                fits[:max(0, carried - n + 1)] = False
                at = np.flatnonzero(fits)
                if len(at):
                    kept[n].append(np.stack([ids[at + k] for k in range(n)], axis=1))
                if sum(map(len, kept[n])) >= FILTER:
                    yield from blocks(n, kept[n])
                    kept[n] = []
        for n, parts in kept.items():
            if parts:
                yield from blocks(n, parts)

    return map_batches(_source(docs, text_col, lang_col), run, "n int, shard long, block binary")


def frequent_grams(filters: DataFrame, bits: int, above: int, least: int) -> DataFrame:
    """(words, f, key) of the n-grams with `least` or more occurrences, from the merged filters of every shard."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, shard = int(frame["n"].iloc[0]), int(frame["shard"].iloc[0])
        lead, rest, counts = quotient.merged(frame["block"], bits, above, shard, n - 1)
        keep = counts >= least
        grams = quotient.restored(lead[keep], rest[keep], bits).view(np.int64)
        return pd.DataFrame({"words": list(grams), "f": counts[keep], "key": lead[keep].view(np.int64)})

    ship(filters.sparkSession)
    return settle(filters.groupBy("n", "shard").applyInPandas(run, "words array<long>, f long, key long"), "grams")


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The word table (lang, word, f, id), and (words, f) of all phrases of 2 to LONGEST words that occur `least`
    times or more in a language, as arrays of word ids.

    Pairs are counted where both words are frequent, longer phrases where all their pairs are; bitmaps of
    bounded size tell that without missing any.
    """
    words, bits, seed = with_ids(settle(word_counts(docs, text_col, lang_col), "word-counts"))
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    above = max(0, (total // SHARD).bit_length())
    context = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    singles = context.broadcast(bitmap(words.where(F.col("f") >= least).select(F.col("id").alias("key")), bits))

    def frequent_words(ids: np.ndarray) -> np.ndarray:
        return (ids != 0) & _held(*singles.value, ids, bits)

    def word_pairs(ids: np.ndarray) -> np.ndarray:
        ok = frequent_words(ids)
        return ok[:-1] & ok[1:]

    two = frequent_grams(gram_filters(docs, (2,), bits, seed, above, word_pairs, text_col, lang_col), bits, above, least)
    pairs = context.broadcast(bitmap(two.select("key"), bits))

    def frequent_pairs(ids: np.ndarray) -> np.ndarray:
        ok = word_pairs(ids)
        at = np.flatnonzero(ok)
        ok[at] = _held(*pairs.value, quotient.permuted(np.stack([ids[at], ids[at + 1]], axis=1), bits), bits)
        return ok

    def frequent_triples(ids: np.ndarray) -> np.ndarray:
        ok = frequent_pairs(ids)
        return ok[:-1] & ok[1:]

    more = frequent_grams(gram_filters(docs, (3, 4), bits, seed, above, frequent_triples, text_col, lang_col), bits, above, least)
    return words, two.select("words", "f").union(more.select("words", "f"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the first `top` phrases of each language.

    Words and counts are per language, and phrases do not cross punctuation or line ends. A phrase is cut where its
    score, 2 000 000 times its count over the counts of both parts, is least; equal scores to the first cut.
    Phrases that a longer one covers are dropped. Ties in rank go to the higher count, then to the phrase in
    byte order. Null texts are empty, a null language is `und`, repeated rows count each, an empty table gives
    an empty table; other columns are not read.
    """
    words, grams = phrase_counts(docs, least, text_col, lang_col)
    frequent = words.where(F.col("f") >= least).select("lang", "word", "id", "f")
    parts = grams.union(frequent.select(F.array("id").alias("words"), "f"))
    cuts = grams.select("words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("slice(words, 1, k)"), "right": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("(cast(a as decimal(38, 0)) * 2000000) div (cast(l as decimal(38, 0)) + r)")
    best = cuts.groupBy("words").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = "flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))))"
    covers = grams.where("size(words) > 2").select(F.explode(F.expr(inner)).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    covered = F.expr(f"coalesce(cast(longer as decimal(38, 0)) * 100 >= cast(a as decimal(38, 0)) * {COVERED}, false)")
    kept = best.join(covers, "words", "left").where(~covered).withColumn("first", F.col("words")[0])
    kept = kept.join(frequent.select(F.col("id").alias("first"), "lang"), "first").select("lang", "words", "a", "cut")

    order = [F.col("cut.score").desc(), F.col("a").desc()]
    near = kept.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        near = near.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= top)
    near = settle(near.drop("place", "part"), "phrases")  # the first ones, with all that tie with the last
    spelled = near.select("words", F.posexplode("words").alias("at", "id")).join(frequent.select("id", "word"), "id")
    spelled = spelled.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = near.join(spelled, "words").withColumn("rank", place.cast("long")).where(F.col("rank") <= top).join(sums, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"), F.col("cut.k").alias("cut"))

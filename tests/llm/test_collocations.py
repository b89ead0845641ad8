"""Quotient filters: exact round trips; phrases against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopecast.llm import collocations, quotient
from tests.llm.test_tables import frame, odd_rows


def brute_phrases(rows, least, top=2000):
    counts = defaultdict(Counter)
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                counts["und" if lang is None else lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(v for k, v in f.items() if len(k) == 1)
        found = []
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in often.items()):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], k))
        for rank, (s, a, p, left, right, k) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -s, k))
    return out


@pytest.mark.parametrize("bits", [40, 48, 56, 64])
def test_permutation_and_blocks(bits):
    rng = np.random.default_rng(bits)
    for n, above in ((2, 0), (3, 3), (4, 9)):
        grams = rng.integers(0, (1 << bits) - 1, (5000, n), dtype=np.uint64, endpoint=True)
        grams[:2000] = grams[rng.integers(0, 40, 2000)]  # repeats
        lead = quotient.permuted(grams, bits)
        assert (lead < 1 << bits).all() if bits < 64 else True
        assert (quotient.restored(lead, grams[:, 1:], bits) == grams).all()
        want = Counter(map(tuple, grams.tolist()))
        got = Counter()
        parts = defaultdict(list)
        for piece in np.array_split(np.arange(5000), 7):
            a, b, c = quotient.counted(lead[piece], grams[piece, 1:], np.full(len(piece), 300))
            top = (a >> np.uint64(bits - above)).astype(int) if above else np.zeros(len(a), int)
            for t in set(top.tolist()):
                parts[t].append(quotient.packed(a[top == t], b[top == t], c[top == t], bits, above))
        for t, blocks in parts.items():
            a, b, c = quotient.merged(blocks, bits, above, t, n - 1)
            assert (np.diff(a.astype(object)) >= 0).all()
            got.update({tuple(g): int(x) for g, x in zip(quotient.restored(a, b, bits).tolist(), c)})
        assert got == Counter({g: 300 * x for g, x in want.items()})


def test_equal_leading_words_stay_apart():
    lead = np.array([5, 5, 5, 5, 3], np.uint64)
    rest = np.array([[1], [2], [1], [2], [9]], np.uint64)
    a, b, c = quotient.counted(lead, rest, np.ones(5, np.int64))
    assert (a.tolist(), b.ravel().tolist(), c.tolist()) == ([3, 5, 5], [9, 1, 2], [1, 2, 2])


def texts(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        w = []
        for _ in range(rng.randint(0, 120)):
            w += rng.choice([["new", "york"], ["New", "York", "City"], ["of", "the"], ["a", "b", "c", "d", "e"], [f"w{int(rng.random() ** 3 * 40)}"], [rng.choice([".", ",", "\n", "\t", "x.y", "ü日"])]])
        rows.append((k, " ".join(w), ("en", "de", None, "und")[k % 4], "a"))
    return rows


def test_against_plain_counting(spark, monkeypatch):
    rows = texts(2) + odd_rows() + [(7000 + k, "x " * 400 + "hot hot Hot", "en", "a") for k in range(40)]
    docs = frame(spark, rows)
    got = [tuple(r) for r in collocations.collocations(docs).collect()]
    assert sorted(got) == sorted(brute_phrases([(r[1], r[2]) for r in rows], 30))
    few = [tuple(r) for r in collocations.collocations(docs, top=3, least=5).collect()]
    assert sorted(few) == sorted(brute_phrases([(r[1], r[2]) for r in rows], 5, 3))
    assert collocations.collocations(frame(spark, [])).count() == 0


def test_small_slices_and_buffers(monkeypatch):
    # runs in this process: slices and buffers that end inside documents lose no n-gram and add none
    import pyarrow as pa

    monkeypatch.setattr(collocations, "SLICE", 20)
    monkeypatch.setattr(collocations, "BUFFER", 7)
    rows = texts(3)[:60]
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] or "und" for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    got = Counter()
    for ids, carried in collocations.buffers([batch], 48, 1):
        for n in (1, 2, 3, 4):
            for i in range(max(0, carried - n + 1), len(ids) - n + 1):
                if 0 not in ids[i:i + n]:
                    got[tuple(ids[i:i + n].tolist())] += 1
    of = {}
    want = Counter()
    for _, text, lang, _ in rows:
        w = of.setdefault(lang or "und", collocations.WordIds(lang or "und", 48, 1))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            ids = [w[x.encode()] for x in re.findall(r"[^\x20\x09]+", piece)]
            for n in (1, 2, 3, 4):
                want.update(tuple(ids[i:i + n]) for i in range(len(ids) - n + 1))
    assert got == want


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    docs = frame(spark, texts(4))
    want = sorted(map(tuple, collocations.collocations(docs, least=5).collect()))
    monkeypatch.setattr(collocations, "bitmap", lambda keys, bits: (np.full(1 << 13, 255, np.uint8), 16))
    assert sorted(map(tuple, collocations.collocations(docs, least=5).collect())) == want


def test_ids_of_their_own(spark, monkeypatch):
    words = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("word"), F.lit(1).cast("long").alias("f"))
    got, bits, seed = collocations.with_ids(words)
    assert bits == 40 and got.select("id").distinct().count() == 3000
    monkeypatch.setattr(collocations, "WORD_BITS", (24, 48))
    got, bits, _ = collocations.with_ids(words)
    assert got.select("id").distinct().count() == 3000

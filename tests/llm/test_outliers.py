"""Robust outliers against plain counting and a dense covariance estimate."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from slopecast.llm import outliers, queries
from tests.conftest import DATA
from tests.llm.test_tables import frame, odd_rows, words

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup, lines = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), lines


def brute_kept(rows):
    """Verdicts by the covariance determinant of exactly the nearest three quarters of each group's rows."""
    stats = [brute_statistics(r[1]) for r in rows]
    passed = [s[0] >= 20 and 100 * s[4] <= 30 * s[0] for s in stats]
    sizes = Counter((r[2], r[3]) for r, p in zip(rows, passed) if p)
    pooled = Counter()
    for (lang, _), n in sizes.items():
        pooled[lang] += n if n < outliers.LEAST_ROWS else 0
    rest = sum(n for n in pooled.values() if n < outliers.LEAST_ROWS)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        if passed[k]:
            if sizes[r[2], r[3]] >= outliers.LEAST_ROWS:
                members[r[2], r[3]].append(k)
            elif pooled[r[2]] >= outliers.LEAST_ROWS:
                members[r[2], None, "pooled"].append(k)
            elif rest >= outliers.LEAST_ROWS:
                members["rest"].append(k)
    kept = list(passed)
    floor = np.diag(np.square(outliers.LEAST_SPREAD))
    for group in members.values():
        s = np.array([stats[k] for k in group], float)
        mean = s[:, 1].sum() / s[:, 0].sum()
        z = np.stack([np.log((s[:, 1] + 64 * mean) / (s[:, 0] + 64)), *[np.sqrt(s[:, a] / s[:, b]) for a, b in ((2, 0), (3, 5), (4, 0))]], axis=1)
        far = lambda c, v: np.einsum("ni,ij,nj->n", z - c, np.linalg.inv(v), z - c)
        best = None
        quartiles = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
        for c, v in ((quartiles[1], np.diag(((quartiles[2] - quartiles[0]) / 1.349) ** 2) + floor), (z.mean(axis=0), np.cov(z.T, bias=True) + floor)):
            for _ in range(30):
                near = z[np.argsort(far(c, v), kind="stable")[:int(np.ceil(0.75 * len(z)))]]
                c, v = near.mean(axis=0), np.cov(near.T, bias=True) * 0.75 / outliers.chi_square_share(outliers.chi_square_limit(0.75), 6) + floor
            if best is None or np.linalg.slogdet(v)[1] < best[0]:
                best = np.linalg.slogdet(v)[1], c, v
        limit = outliers.chi_square_limit(0.975)
        near = z[far(*best[1:]) <= limit]
        v = np.cov(near.T, bias=True) * 0.975 / outliers.chi_square_share(limit, 6) + floor
        for k, d in zip(group, far(near.mean(axis=0), v)):
            kept[k] = bool(d <= outliers.chi_square_limit(1 - outliers.REJECTED))
    return kept


def test_chi_square():
    assert abs(outliers.chi_square_limit(0.975) - 11.1433) < 1e-3  # tabulated for four dimensions
    assert abs(outliers.chi_square_share(7.779, 4) - 0.9) < 1e-4 and abs(outliers.chi_square_share(10.645, 6) - 0.9) < 1e-4


def test_statistics():
    rng = random.Random(3)
    texts = [r[1] or "" for r in odd_rows()] + ["a b c d e f g h " * 2, "x " * 9, "#a *b\n\n \n#a *b\n#a *b \n<&>|%$", "ü 日本 😀 x\x0by\x1cz", words(rng, 400, 2), words(rng, 3000, 3)]
    for text in texts:
        assert outliers.statistics(text) == brute_statistics(text)


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_robust_outliers"](spark, folder).collect()}
    assert len(got) == len(docs)
    kept = brute_kept([(d.doc_id, d.text, d.lang, d.source) for d in docs])
    for d, keep in zip(docs, kept):
        assert tuple(got[d.doc_id][n] for n in NAMES) == brute_statistics(d.text)[:5]
        assert got[d.doc_id].kept == keep


def planted(rng, n):
    rows = []
    for k in range(n):
        lang = ("en", "de", None)[k % 3]
        size = rng.randint(25, 300)
        mean = {"en": 5, "de": 7, None: 4}[lang]
        text = " ".join("x" * max(1, round(rng.gauss(mean, 1.5))) + str(rng.randrange(10 ** 4)) for _ in range(size))
        if k % 7 == 0:
            text = " | ".join(text.split())
        rows.append((k, text, lang, "big" if k % 5 else f"s{k % 40}"))
    return rows


def test_groups_and_odd_rows(spark):
    rng = random.Random(5)
    rows = planted(rng, 3000)
    rows += [(9000 + r[0] if r[0] is not None else None, *r[1:]) for r in odd_rows()] + [(5, rows[5][1], "en", "big")] * 2
    docs = frame(spark, rows)
    got = outliers.judged(docs).collect()
    want = Counter((r[0], *brute_statistics(r[1])[:5], k) for r, k in zip(rows, brute_kept(rows)))
    assert Counter((r.id, *[r[n] for n in NAMES], r.kept) for r in got) == want
    kept = outliers.without_outliers(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.id for r in got if r.kept)
    assert sum(not r.kept for r in got if r.id is not None and r.id < 3000 and r.id % 7 == 0) == 429
    assert sum(not r.kept and not r.base_failed for r in got if r.id is not None and r.id < 3000 and r.id % 7) == 0


def test_few_rows_and_equal_rows(spark):
    assert outliers.judged(frame(spark, [])).count() == 0 and outliers.without_outliers(frame(spark, [])).count() == 0
    few = frame(spark, planted(random.Random(1), 50))
    assert all(r.kept and r.distance is None for r in outliers.judged(few).collect())
    text = " ".join(f"word{k}" for k in range(40))
    equal = outliers.judged(frame(spark, [(k, text, "en", "a") for k in range(400)] + [(900, text + " | #", "en", "a"), (901, "#### " * 30 + text, "en", "a")])).collect()
    assert {r.id for r in equal if not r.kept} == {901}

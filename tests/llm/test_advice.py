"""Whole jobs: what the second review found missing."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slopecast.llm import pfair, pseudonyms, simhash, similar, templates
from slopecast.llm.common import settle
from tests.conftest import DATA
from tests.llm.test_tables import brute_components, brute_leaks, frame, odd_rows


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_heads(texts):
    """Least id of each group linked by a Jaccard similarity of 0.8 or more."""
    sets = {d: brute_shingles(t) for d, t in texts.items()}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common)

    return sorted(set(brute_components(texts, linked).values()))


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.01"])
def test_near_dedup_stage_against_jaccard(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = corpus_pipeline.near_dedup(spark, docs, folder)
    assert sorted(r.doc_id for r in got.collect()) == brute_heads(texts)


def test_near_dedup_rows(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(10 ** 6)}" for _ in range(300)]
    rows = [r for r in odd_rows() if r[0] is not None]
    rows += [(1000 + k, " ".join(w if rng.random() > 0.02 else f"x{rng.randrange(10 ** 6)}" for w in base), "en", "a") for k in range(90)]
    docs = frame(spark, rows)
    got = similar.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_heads({i: t for i, t, _, _ in rows})
    assert similar.one_of_each(frame(spark, [])).count() == 0


@pytest.mark.parametrize("documents", [1_000, 100_000, 600_000])
def test_plan_keeps_to_the_targets(documents):
    counts = {"big": documents // 3, "one": 1} | {f"s{k:02}": documents * 2 // 3 // 18 for k in range(18)}
    weights = {s: n**pfair.EXPONENT for s, n in counts.items()}
    targets = pfair.shares(weights)
    assert sum(targets.values()) == 1
    seen = Counter()
    slots = 0
    for s, j, release, deadline, slot in pfair.plan(targets, {s: -(-n // pfair.BLOCK) for s, n in counts.items()}):
        assert release <= slot < deadline and j == seen[s] and slot == slots
        seen[s] += 1
        slots += 1
        if slots % 997 == 0:
            assert all(abs(seen[x] - w * slots) < 1 for x, w in targets.items())
    assert all(abs(seen[x] - w * slots) < 1 for x, w in targets.items())
    assert seen["one"] <= targets["one"] * slots + 1


def test_mix_of_a_long_table_keeps_to_the_targets(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id = 0, 'one', if(id % 3 = 0, 'big', 's' || id % 19)) as source")
    got = pfair.schedule(rows, block=1)
    n = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    total = sum(x**pfair.EXPONENT for x in n.values())
    mixed = {r["__source"]: r["count"] for r in got.groupBy("__source").count().collect()}
    slots = sum(mixed.values())
    assert all(abs(mixed[s] - n[s] ** pfair.EXPONENT / total * slots) < 1 + 1e-6 for s in n)
    assert got.select("__slot").distinct().count() == slots and got.select("doc_id").distinct().count() == 40_000


def test_mix_of_many_sources(spark):
    rows = spark.range(5_000).selectExpr("id as doc_id", "cast(id as string) as text", "cast(id as string) as source")
    assert pfair.mixed(rows).count() == 5_000 * pfair.BLOCK


def found_items(spark, items, texts):
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {(r.id, r.item_id): r.kind for r in templates.contaminated(docs, bench).collect()}


def test_items_of_numbers(spark):
    items = {
        1: "Compute 12 + 7, 30 - 4, 5 * 6 and 81 / 9", 2: "Please add 1 2 3 4 5 and then tell us what the result is", 3: "1 2 3 4 5 6 7 8 9 10 11 12",
        4: "Put 3 4 5 6 7 into one row and 8 9 10 11 12 into the next , then add 13 14 15 16 17 to both",
    }
    texts = {
        1: "so we read. " + items[1] + " as a task", 2: items[1].replace("12", "13"), 3: items[2].replace("4", "44"), 4: "0 " + items[3] + " 13",
        5: "9 8 7 6 5 4 3 2 1 0 1 2 3 4", 6: "text before " + items[4] + " and after", 7: "Please add 9 numbers",
    }
    assert found_items(spark, items, texts) == {(1, 1): "exact", (3, 2): "reparameterised", (4, 3): "exact", (6, 4): "exact"}


def test_names_whatever_their_case_and_place(spark):
    items = {
        1: "Anna gives Ben 5 apples , then Carl takes 3 of them to Dora , and Emil asks Frida how many are left with Ben",
        2: "Compute 12 + 7, 30 - 4, 5 * 6 and 81 / 9",
    }
    texts = {
        1: items[1].lower(), 2: items[1].upper(), 3: items[1].replace(" ", "\n"), 4: "he said Yes , " + items[1], 5: "we read: " + items[2] + " there",
        6: "Anna gives Carl 6 apples , then Emil takes 4 of them", 7: items[1].lower().replace("5", "7"), 8: items[1].replace("Ben", "Otto").replace("Frida", "Gerd"),
    }
    got = found_items(spark, items, texts)
    assert {k for k in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (7, 1), (8, 1)}
    assert all(got[k, 1] == "exact" for k in (1, 2, 3, 4)) and got[5, 2] == "exact" and got[7, 1] == got[8, 1] == "reparameterised"


def test_ibans_before_a_word(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "PL61109010140000071219812874", "SE45 5000 0000 0583 9825 7466", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"]
    texts = [f"pay {i} {after}" for i in ibans for after in ("BIC CAIXESBB", "ODER 1234", "2024 7", "now", "")] + ["no ES91 2100 0418 4502 0005 1333 BIC"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", pseudonyms.pseudonymised("text", "k").alias("p"))
    rows = docs.selectExpr("doc_id", "text", "p.text as new", "p.kinds").orderBy("doc_id")
    got = rows.select("*", pseudonyms.pseudonymised("new", "k", True)["text"].alias("back")).collect()
    for r in got[:-1]:
        iban = ibans[r.doc_id // 5]
        assert r.kinds == ["iban"] and iban not in r.new and r.back == r.text
        start, end = r.text.split(iban)
        assert r.new.startswith(start) and r.new.endswith(end) and len(r.new) == len(r.text)
        plain = r.new[len(start):len(start) + len(iban)].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[-1].new == got[-1].text


def test_pipeline_stages_after_near_dedup(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = settle(stages["near_dedup"](spark, stages["language_id"](spark, docs, DATA), DATA), "test-kept")
    clean = settle(stages["decontaminate"](spark, kept, DATA), "test-clean")
    leaks = brute_leaks([(r.doc_id, r.text) for r in kept.collect()], duck.execute("select item_id, text from benchmark").fetchall(), 15)
    gone = {r.doc_id for r in kept.collect()} - {r.doc_id for r in clean.collect()}
    assert {d for d, _ in leaks} <= gone
    mix = settle(stages["mix"](spark, clean, DATA), "test-mix")
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} == {r.doc_id for r in clean.collect()}
    target = pfair.shares({s: c**pfair.EXPONENT for s, c in Counter(r.source for r in clean.collect()).items()})
    mixed = Counter(r.source for r in mix.collect())
    blocks = sum(mixed.values()) / pfair.BLOCK
    assert all(abs(mixed[s] / pfair.BLOCK - w * blocks) < 1 for s, w in target.items())
    assert corpus_pipeline.run(spark, DATA).count() == sum(mixed.values())


def test_short_items_are_no_poison(spark):
    items = {1: "42", 2: "yes", 3: "Paris"}
    texts = {1: "he is 42 years old", 2: "oh yes it rains", 3: "we went to Paris in May", 4: "the answer\n42\nfollows", 5: "Yes!", 6: "42 42"}
    assert found_items(spark, items, texts) == {(4, 1): "exact", (5, 2): "exact"}


def test_one_changed_name_in_a_long_copy(spark):
    rng = random.Random(12)
    plain = lambda n: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}x" for _ in range(n))
    item = f"{plain(20)} Anna {plain(22)} Anna {plain(21)} Anna went"
    copy = item[:item.rindex("Anna")] + "Dora went"
    assert found_items(spark, {1: item}, {1: copy, 2: item.replace("Anna", "Dora")}) == {(1, 1): "exact", (2, 1): "reparameterised"}


def test_near_dedup_links_by_golay_keys(spark):
    words = [f"w{i * i % 997}x{i}" for i in range(3000)]
    near = next(t for k in range(3000) if 0 < bin(simhash.fingerprint(t := " ".join([*words[:k], "other", *words[k + 1:]]), 5) ^ simhash.fingerprint(" ".join(words), 5)).count("1") <= 2)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (3, "not like the others at all"), (4, "")], "doc_id bigint, text string")
    prints = similar.shingled(docs).withColumn("keys", F.array().cast("array<long>"))  # no band at all
    got = similar.similar_links(docs, prints).collect()
    assert {frozenset(r) for r in got} == {frozenset(r.node for r in prints.where("id <= 2").collect())}

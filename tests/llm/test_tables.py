"""The operators on small tables: brute force, nulls, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slopecast.llm import audio, chat, chunks, language, pfair, pseudonyms, quality, queries, simhash, templates, tokens
from slopecast.llm.common import settle
from slopecast.llm.components import connected_components
from tests.conftest import DATA

#: Columns that operators use inside, as extra columns of their input.
CLASHES = "id long, text_hash long, fingerprint string, cluster int, component_id int, start int, length int, digest int, shard int, place int, hash int, tokens string, w int, slot int"
DOC = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES


def frame(spark, rows):
    """documents with clashing extra columns; rows are (doc_id, text, lang, source)."""
    extra = [1, 2, "x", 3, 4, 5, 6, 7, 8, 9, 10, "y", 11, 12]
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], DOC).repartition(3)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def odd_rows():
    rng = random.Random(9)
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t", "en", None), (None, "a null id here", "fr", "b"), (None, None, None, None),
        (4, "Ünïcode 日本語 😀 text", "de", "b"), (5, "12345 !!", "en", "a"),
    ]
    base = words(rng, 60)
    rows += [(10, base, "en", "a"), (11, base, "en", "a"), (11, base, "en", "a"), (12, base + " tail", "en", "b")]
    rows += [(20 + k, words(rng, rng.randint(1, 80)), "en", "ab"[k % 2]) for k in range(30)]
    return rows + [(99, "long " + words(rng, 30_000, 5000), "en", "a")]


def brute_fingerprint(text):
    import xxhash

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(5, None), (None, None)]
    want = brute_components({x for p in pairs if None not in p and p[0] != p[1] for x in p}, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == set(want.items()) and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_links_against_all_pairs(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 40)}  # a crowded bucket
    values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in list(values)[:60]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    assert len(values) > simhash.PAIRED
    want = brute_components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = dict.fromkeys(signed)
    got = {v: v for v in signed} | {r.node: r.component for r in connected_components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()}
    assert got == want


def test_simhash_rows(spark):
    rows = odd_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {brute_fingerprint(t) for _, t, _, _ in rows}
    root = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, t, _, _ in rows:
        least[root[brute_fingerprint(t)]].append(i)
    want = Counter((i, brute_fingerprint(t), min((x for x in least[root[brute_fingerprint(t)]] if x is not None), default=None)) for i, t, _, _ in rows)
    assert Counter((r.id, r.fingerprint % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    groups = [r.doc_id for r in kept.collect()]
    assert len(groups) == len(set(root.values())) and 10 in groups and 11 not in groups and 1 in groups and 2 not in groups
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = odd_rows()
    got = tokens.token_table(frame(spark, rows), path).orderBy("start").collect()
    ordered = sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert [r.doc_id for r in got] == [d if known else None for known, d in ordered]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter()
    for i, t, _, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokens.token_table(frame(spark, []), path).count() == 0


def test_small_blocks(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_ids(frame(spark, odd_rows()), f"{tmp_path}/ids", path, block_ids=50)
    small = tokens.read_ids(spark, f"{tmp_path}/ids")
    assert sorted(map(str, small.collect())) == sorted(map(str, tokens.token_table(frame(spark, odd_rows()), path).collect()))


def test_audio_rows(spark):
    rows = odd_rows()
    got = audio.documents_as_audio(frame(spark, rows)).collect()
    want = Counter()
    for i, t, _, _ in rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({r.media_sha256 for r in got if r.doc_id in (10, 11)}) == 1 and len({r.feature for r in got if r.doc_id in (10, 11)}) == 1
    assert audio.documents_as_audio(frame(spark, [])).count() == 0


def test_chat_rows(spark):
    import public_tokenizers

    rows = [
        (1, 2, "assistant", "b <|im_end|>"), (1, 1, "user", "a"), (1, None, None, None), (2, 1, "assistant", "x\ny"), (2, 1, "assistant", "x\ny"),
        (None, 1, "us\ner", "null conversation"), (3, 1, "system", None), (4, 7, "assistant", "é😀 " * 3000), (2, 1, "user", "tie"),
    ]
    turns = spark.createDataFrame([(*r, 1, "q") for r in rows], "conv_id long, turn long, role string, text string, ids int, mask string")
    got = {r.conv_id: r for r in chat.conversation_digests(turns, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.conversation_digests(turns.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_chat_against_sql(spark, duck):
    got = queries.QUERIES["op5_chat_tokens"](spark, DATA)
    res = duck.execute(queries.ORACLE["op5_chat_tokens"])
    assert got.columns == [d[0] for d in res.description]
    assert sorted(map(tuple, got.collect())) == sorted(res.fetchall())


def test_mix(spark):
    rows = [(i, f"t{i}", "en", s) for i, s in enumerate("a" * 100 + "b" * 37 + "c")] + [(500, None, None, None), (None, "", "en", "a"), (7, "t7", "en", "a")]
    docs = frame(spark, rows)
    weights = {"a": 0.4, "b": 0.3, "c": 0.1, pfair.MISSING: 0.2}
    got = pfair.schedule(docs, weights, block=4, slots=40).collect()
    parts = pfair.whole_weights({s: weights[s] for s in sorted(weights)}, 40)
    assert sorted(r["__position"] for r in got) == list(range(len(got)))
    assert all(r["__release"] <= r["__slot"] < r["__deadline"] for r in got)
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[1]) for r in rows}
    filled = Counter()
    for slot, group in itertools.groupby(sorted(got, key=lambda r: r["__slot"]), key=lambda r: r["__slot"]):
        group = list(group)
        assert len(group) == 4 and len({r["__source"] for r in group}) == 1
        filled[group[0]["__source"]] += 1
        assert all(abs(filled[s] - parts[s] * (slot + 1) / 40) < 1 for s in parts)
    epochs = Counter((r["__source"], r.doc_id, r.text, r["__epoch"]) for r in got)
    assert max(epochs.values()) == 2  # the repeated row of id 7
    mix = pfair.mixed(docs, weights)
    assert mix.columns == docs.columns
    assert pfair.schedule(frame(spark, [])).count() == 0 and pfair.mixed(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pfair.schedule(docs, {"a": 1.0})


def brute_repeats(rows, floor):
    """Documents with a run of `floor` bytes that documents of two ids have, in words."""
    seen = defaultdict(set)
    for i, t, _, _ in rows:
        w = (t or "").split()
        for p in range(len(w) - floor + 1):
            seen[tuple(w[p:p + floor])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_repeated_passages(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [fresh(60) for _ in range(4)]
    rows = [(i, f"{fresh(rng.randint(5, 90))} {passages[i % 4]} {fresh(rng.randint(0, 90))}", "en", "a") for i in range(24)]
    rows += [(100 + i, fresh(120), "en", "a") for i in range(30)] + [(200, None, None, None), (201, "", None, None), (None, passages[0], None, None)]
    rows += [(300, fresh(80) * 2, "en", "a")] + [rows[0]]
    docs = frame(spark, rows)
    got = chunks.repeated_passages(docs).collect()
    assert {r.id for r in got} == brute_repeats(rows, 51)
    texts = {(i, t) for i, t, _, _ in rows}
    for r in got:
        piece = [t.encode()[r.start:r.start + r.length] for i, t in texts if i == r.id and t][0]
        assert any(piece in (t or "").encode() for i, t in texts if i != r.id)
        assert (r.repeated_bytes == 0) == (r.first_id == r.id)
    cut = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    assert cut[0] == rows[0][1] and len(cut[4]) < len(rows[4][1]) and cut[100] == rows[24][1] and cut[200] is None and cut[201] == ""
    assert chunks.without_repeats(docs).count() == len(rows) and chunks.without_repeats(docs).columns == docs.columns
    assert chunks.repeated_passages(frame(spark, [])).count() == 0


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark):
    texts = [
        "card 4539578763621486, 4539 5787 6362 1486; other 4785380592391130$$$", "ip 152.143.123.131### v 999.1.1.1", "call +1 (017) 555-7713 or (212) 555-0100",
        "ssn 123-45-6789 000-12-3456", "iban DE89370400440532013000, GB82 WEST 1234 5698 7654 32.", "on 2024-02-29, 29/02/2024 and 12/25/2020; 2024-13-01 1850-01-01",
        "mail a.34@mail7.example.com### token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "plain words: none", "2024 3.5 1,000 12345", "", None,
        "same 4539578763621486 again", "9" * 25 + " 1.2.3",
    ]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    found = docs.select("doc_id", "text", pseudonyms.pseudonymised("text", "k").alias("p")).select("doc_id", "text", F.col("p.text").alias("new"), "p.kinds")
    got = {r.doc_id: r for r in found.withColumn("back", pseudonyms.pseudonymised("new", "k", True)["text"]).collect()}
    for i in (0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12):
        assert got[i].back == texts[i]
    for i in (7, 8, 9, 10, 12):
        assert got[i].new == texts[i] and got[i].kinds == []
    cards = re.findall(r"\d[\d ]{14,}\d", got[0].new)
    assert luhn(cards[0]) and cards[1].replace(" ", "") == cards[0] and re.fullmatch(r"(\d{4} ){3}\d{4}", cards[1]) and not luhn(cards[2])
    assert cards[0] in got[11].new and "4539" not in got[0].new.split()[1]
    assert "999.1.1.1" in got[1].new and "000-12-3456" in got[3].new and "152.143" not in got[1].new
    assert got[2].new.startswith("call +1 (") and "555-7713" not in got[2].new
    for iban in re.findall(r"[A-Z]{2}\d{2}[A-Z0-9 ]+\d", got[4].new):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    dates = re.search(r"on (\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4}) and", got[5].new).groups()
    assert dates[:3] == dates[:2:-1] and "2024-02-29" not in got[5].new and got[5].new.endswith("2024-13-01 1850-01-01")
    assert "example.com" not in got[6].new and "24be64" not in got[6].new and got[6].kinds == ["email", "secret"]
    other = docs.where("doc_id = 0").select(pseudonyms.pseudonymised("text", "another")["text"].alias("t")).first().t
    assert other != got[0].new
    assert pseudonyms.pseudonymise(docs, "k").columns == docs.columns and pseudonyms.pseudonymise(frame(spark, []), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    one = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    moved = one.select("d", F.expr(pseudonyms.feistel("d", "k", "t")).alias("e")).select("d", "e", F.expr(pseudonyms.feistel("e", "k", "t", True)).alias("b"))
    rows = moved.collect()
    assert len({r.e for r in rows}) == 1000 and all(r.b == r.d and len(r.e) == 3 for r in rows) and sum(r.e == r.d for r in rows) < 20


def test_decontamination(spark):
    items = [
        (1, "If Anna has 12 apples and gives Ben 5 apples , how many apples does Anna have left after 3 days ?"), (2, "the quick brown fox jumps over a very lazy dog while the sun is slowly setting behind old hills"),
        (3, "too short item"), (4, None), (5, ""), (None, "a null item id that nobody can report as it has no name at all"), (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    ]
    rng = random.Random(4)
    near = "Yes. If Anna has 12 apples and gives Ben 5 apples , how many apples does Anna have left after 3 days ?"
    rows = [
        (1, words(rng, 30) + ". " + items[0][1] + " " + words(rng, 9), "en", "a"), (2, near.replace("Anna", "Carl").replace("12", "40"), "en", "a"),
        (3, near.replace("does Anna", "does Dora"), "en", "a"), (4, "so THE QUICK BROWN fox, jumps over a very lazy dog while the sun is slowly setting", "en", "a"),
        (5, "the quick brown fox jumps over a cat", "en", "a"), (6, "this is too short item here", "en", "a"), (7, "7 6 5 4 3 2 1 9 8 7 6 5 4 3 2 1 3", "en", "a"),
        (8, None, "en", "a"), (9, "", "en", "a"), (None, items[1][1], "en", "a"), (1, words(rng, 30), "en", "a"), (10, items[1][1], "en", "a"), (10, items[1][1], "en", "a"),
        (11, "one line\n Too short, item!\nand more", "en", "a"), (12, "TOO SHORT ITEM", "en", "a"),
    ] + [(50 + k, words(rng, 50), "en", "a") for k in range(20)]
    bench = spark.createDataFrame([(*i, 0, 1) for i in items], "item_id long, text string, id int, hash int")
    got = {(r.id, r.item_id): r.kind for r in templates.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 1): "exact", (2, 1): "reparameterised", (3, 1): "exact", (4, 2): "exact", (11, 3): "exact", (12, 3): "exact", (None, 2): "exact", (10, 2): "exact"}
    kept = templates.without_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 5, 6, 7, 8, 9, *range(50, 70)])
    assert templates.contaminated(frame(spark, []), bench).count() == 0
    assert templates.without_contaminated(frame(spark, rows), bench.limit(0)).count() == len(rows)


def brute_leaks(docs, items, run=13):
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    seen = defaultdict(set)
    for i, t in items:
        w = tok(t)
        for p in range(len(w) - run + 1):
            seen[tuple(w[p:p + run])].add(i)
    return {(d, i) for d, t in docs for w in [tok(t)] for p in range(len(w) - run + 1) for i in seen.get(tuple(w[p:p + run]), ())}


def test_decontamination_against_word_runs(spark, duck):
    docs = duck.execute("select doc_id, text from documents").fetchall()
    items = duck.execute("select item_id, text from benchmark").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_template_decontamination"](spark, DATA).collect()}
    assert brute_leaks(docs, items, 15) <= got <= brute_leaks(docs, items, 11) and got


def test_language_held_out(spark, duck):
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, DATA).collect()}
    truth = duck.execute("select doc_id, lang from documents where lang is not null").fetchall()
    assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
    held = [(got[d].lang_pred, lang) for d, lang in truth if got[d].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_rows(spark):
    docs = frame(spark, odd_rows())
    model = language.learn(docs, F.lit(True))
    got = docs.select("doc_id", "text", language.identified(docs, model).alias("f")).select("doc_id", "text", "f.*").collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    kept = language.of_known_language(docs, F.lit(True))
    assert kept.columns == docs.columns and not {1, 2, 3, 5} & {r.doc_id for r in kept.collect()} and all(r.lang for r in kept.collect())
    assert language.of_known_language(frame(spark, []), F.lit(True)).count() == 0


def test_quality_held_out(spark, duck):
    got = {r.doc_id: r for r in queries.QUERIES["op6_nbsvm_quality"](spark, DATA).collect()}
    truth = duck.execute("select doc_id, quality from labels").fetchall()
    scores = [(got[d].score, q) for d, q in truth if d in got and got[d].held_out]
    good, bad = [s for s, q in scores if q == 1], [s for s, q in scores if q == 0]
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    if good and bad:
        assert np.mean([[g > b for b in bad] for g in good]) > 0.9


def test_quality_rows(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(20 + k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (20, None, 0), (21, 7, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, F.lit(True))
    rows = docs.select("doc_id", quality.scored(docs, model).alias("s")).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.s <= 1 for r in rows)
    none = quality.learn(docs, labels.limit(0), F.lit(True))
    assert docs.limit(3).select(quality.scored(docs, none).alias("s")).first().s == pytest.approx(0.5)
    assert frame(spark, []).select(quality.scored(docs, model)).count() == 0


def test_pipeline_stages(spark, duck):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    total = docs.count()
    state, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before = state
        state = settle(stage(spark, state, DATA), f"test-{name}")
        sizes.append(state.count())
        if name != "token_ids":
            assert state.columns == docs.columns
        if name == "language_id":
            assert {r.doc_id for r in state.collect()} == {r.doc_id for r in before.collect() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "near_dedup":
            from tests.llm.test_advice import brute_heads

            assert sorted(r.doc_id for r in state.collect()) == brute_heads({r.doc_id: r.text for r in before.collect()})
        if name == "decontaminate":
            leaks = brute_leaks([(r.doc_id, r.text) for r in before.collect()], duck.execute("select item_id, text from benchmark").fetchall(), 15)
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in state.collect()}
            assert {d for d, _ in leaks} <= gone
        if name == "mix":
            assert {r.doc_id for r in state.collect()} == {r.doc_id for r in before.collect()}
            n = Counter(r.source for r in before.collect())
            target = pfair.whole_weights({s: c**pfair.EXPONENT for s, c in sorted(n.items())})
            mixed = Counter(r.source for r in state.collect())
            assert all(abs(mixed[s] / pfair.BLOCK - target[s] / pfair.SLOTS * sizes[-1] / pfair.BLOCK) < 1 for s in n)
    assert sizes[0] <= total and sizes[1] < sizes[0] and sizes[-1] == sizes[-2]
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]


def test_queries_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names

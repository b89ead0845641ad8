"""Spark-free parts: codes, parsers, schedules, fits."""

from __future__ import annotations

import random

import numpy as np
import pytest

from slopecast.llm import audio, chat, chunks, eliasfano, golay, language, pfair, quality, simhash, svm, tokens


@pytest.mark.parametrize("n,last", [(0, 0), (1, 0), (1, 9), (1000, 5), (1000, 10**6), (77, 77), (500, 10**9)])
def test_elias_fano_select(n, last):
    rng = random.Random(n + last)
    values = sorted(rng.randint(0, last) for _ in range(n))
    data = eliasfano.encode(np.array(values, np.uint64))
    reader = eliasfano.Reader(data)
    assert reader.all().tolist() == values
    assert [reader.select(i) for i in range(n)] == values
    assert reader.size == len(data)
    with pytest.raises(IndexError):
        reader.select(n)


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000)).astype(np.uint64)
    assert len(eliasfano.encode(values)) < 10_000 * (2 + 10 + 1) / 8 + 100


def test_block_round_trip():
    ids = np.arange(10, dtype="<u2")
    names, reader, back = tokens.unpack_block(tokens.pack_block([None, -3, 7], [2, 2, 10], ids))
    assert names == [None, -3, 7] and reader.all().tolist() == [2, 2, 10] and back.tolist() == ids.tolist()
    with pytest.raises(ValueError):
        tokens.unpack_block(b"x" * 40)


def test_word_store_equals_the_whole_pipeline():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    encoder = tokens.Encoder(path, "<u4")
    assert encoder.by_words
    samples = [
        "", " ", "Hello, World! It's 42... don't WE'LL", "a\x1cb\x85c d e", "Straße ÄÖÜ éàç İi ŉ ſ", "ΟΔΥΣΣΕΥΣ σς 日本語 é é ́x",
        "<|endoftext|> <| x |> <|startoftext|>", "x_y __z__ 'S '' ''s 3.14 1,000 ½ ²", "tab\tnew\nline\r\n\x0b\x0c", "😀 family 👨‍👩‍👧", "naïve café coöperate ﻿",
    ]
    rng = random.Random(5)
    alphabet = "abzAZéßÉ 019_.,'-!|<>\n\té́σΣİ日 \x1f" + "st"
    samples += ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(400)]
    for text in samples:
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 300)
    assert (golay.fuzzy_keys(words) >= 0).sum(axis=1).max() == 6
    own = golay.fuzzy_keys(words)
    for a in range(23):
        for b in range(a, 23):
            other = golay.fuzzy_keys(words ^ (1 << a) ^ (0 if a == b else 1 << b))
            shared = (own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)
            assert shared.any(axis=(1, 2)).all()


def test_golay_is_perfect():
    errors = golay._tables()[2]
    assert len(np.unique(errors)) == 2048 and all(int(e).bit_count() <= 3 for e in errors)


def test_fingerprint_edges():
    assert simhash.fingerprint("") == 0 and simhash.fingerprint(" \t\r\n") == 0
    assert simhash.fingerprint("One Two") == simhash.fingerprint("one\ttwo")
    assert simhash.fingerprint("a b c d") != simhash.fingerprint("a b c e")
    import xxhash

    assert simhash.fingerprint("a b c") == xxhash.xxh64_intdigest(b"a b c", 42)


def test_pfair_windows_and_lag():
    parts = pfair.whole_weights({"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}, 40)
    assert sum(parts.values()) == 40 and min(parts.values()) >= 1
    plan = pfair.period(parts)
    seen = dict.fromkeys(parts, 0)
    for s, j, release, deadline, slot in plan:
        assert release <= slot < deadline and j == seen[s]
        seen[s] += 1
        for x, p in parts.items():
            assert abs(seen[x] - p * (slot + 1) / 40) < 1
    with pytest.raises(ValueError):
        pfair.whole_weights({"a": 0.0, "b": 1.0})
    with pytest.raises(ValueError):
        pfair.whole_weights({"a": 1.0, "b": 1.0}, 1)


def test_cuts_resist_insertions():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)).encode()
    pieces = lambda raw: {raw[a:b] for a, b in zip([0, *chunks.cuts(np.frombuffer(raw, np.uint8))], chunks.cuts(np.frombuffer(raw, np.uint8)))}
    own, other = pieces(text), pieces(b"something new " + text[:900] + b"!" + text[900:])
    assert len(own - other) <= 4
    assert len(chunks.cuts(np.frombuffer(b"", np.uint8))) == 0
    wide = ("é" * 500).encode()
    assert all(b == len(wide) or wide[b] & 0xC0 != 0x80 for b in chunks.cuts(np.frombuffer(wide, np.uint8)))


def test_escapes_turn_back():
    for text in ("", "<|im_end|>", r"<\|im_start|>", r"<\\|a", "<", "|", "<<||>>", "a<|b<\\|c"):
        assert "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape(text)) == text
    for role in ("user", "a\nb", "\\n", "<|im_start|>", ""):
        assert "\n" not in chat.escape_role(role) and chat.unescape_role(chat.escape_role(role)) == role


def test_template_masks_by_prefix_sums():
    import public_tokenizers

    form = chat.Template(public_tokenizers.path("byte_bpe_50k.json"))
    turns = [("user", "hi <|im_end|>"), ("assistant", ""), ("assistant", "é <|x"), ("", "z")]
    ids, mask, bounds = form.assemble(turns)
    assert bounds[0] == 0 and bounds[-1] == len(ids) == len(mask)
    for k, (role, text) in enumerate(turns):
        a, b = bounds[k], bounds[k + 1]
        assert form.read(ids[a:b], mask[a:b])[:3] == (role, text, text if role == "assistant" else "")
        assert list(ids[a:b]).count(form.start) == 1 and list(ids[a:b]).count(form.end) == 1
    assert form.assemble([])[0].tolist() == []


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 922, 923, 5000, 300_001])
def test_audio_round_trip(size):
    raw = random.Random(size).randbytes(size)
    data = audio.write(audio.pad(raw), size)
    stream = audio.read(data)
    assert audio.payload_of(data, stream) == (audio.pad(raw), size)
    assert stream.samples == 1152 * len(stream.offsets) and stream.failed == 0 and stream.skipped == 0
    assert stream.vbr["frames"] == len(stream.offsets) and stream.vbr["kind"] == "xing" and stream.tag_crc_ok
    assert all(data[o] == 0xFF for o in stream.offsets) and len(stream.vbr["toc"]) == 100


def test_audio_resynchronises_and_finds_damage():
    payload = audio.pad(bytes(range(256)) * 40)
    data = audio.write(payload, len(payload))
    whole = audio.read(data)
    cut = whole.offsets[3]
    noisy = data[:cut] + b"\xff\xfb\x00junk\xff" + data[cut:] + b"TAG" + b"Title".ljust(125, b"\x00")
    again = audio.read(noisy)
    assert len(again.offsets) == len(whole.offsets) and again.skipped == 8 and again.tags["title"] == "Title"
    broken = bytearray(data)
    broken[whole.offsets[2] + 10] ^= 1
    assert audio.read(bytes(broken)).failed == 1
    with pytest.raises(ValueError):
        audio.payload_of(bytes(broken), audio.read(bytes(broken)))
    assert audio.read(b"").offsets == [] and audio.read(b"no audio here").offsets == []
    assert audio.read(data[:-5]).skipped > 0


def test_audio_payload_with_the_letters_of_a_closing_tag():
    for size in (100, 900, 1000, 2600):
        for back in range(128, 200):
            raw = audio.pad(b"x" * size)
            at = max(0, len(raw) - back)
            for payload in (raw[:at] + b"TAG" + raw[at + 3:], raw[:at] + b"TAG" * ((len(raw) - at) // 3) + raw[:(len(raw) - at) % 3]):
                data = audio.write(payload, len(payload))
                assert audio.payload_of(data, audio.read(data)) == (payload, len(payload))
    data = audio.write(raw, len(raw))
    tail = b"TAG" + b"a title".ljust(30, b"\x00") + bytes(95)
    tagged, plain = audio.read(data + tail), audio.read(data)
    assert tagged.tags["title"] == "a title" and (tagged.offsets, tagged.skipped) == (plain.offsets, 0)
    assert audio.read(data[:-5] + tail).skipped > 0 and audio.read(data[:-5] + tail).tags["title"] == "a title"


def test_audio_header_rules():
    assert audio.header_of(b"\xff\xfb\x90\x00").size == 417 and audio.header_of(b"\xff\xfb\x92\x00").size == 418
    assert audio.header_of(b"\xff\xf3\x90\x00").samples == 576 and audio.header_of(b"\xff\xff\x90\x00").samples == 384
    for bad in (b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xe9\x90\x00", b"\xfe\xfb\x90\x00"):
        assert audio.header_of(bad) is None


def test_hinge_separates_and_is_the_minimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0.1, 1.0, -1.0)
    rows = [(np.arange(2), v) for v in x]
    w = svm.fit_hinge(rows, y, 2, cost=1.0, rounds=500)
    value = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:2] + w[2])).sum()
    best = value(w)
    assert all(value(w + d) >= best - 1e-2 for d in rng.normal(scale=0.05, size=(300, 3)))


def test_language_edges():
    model = language.fit([])
    assert model.predict("text") == ("und", 0.0)
    one = language.fit([("en", *language.features("the cat and the dog")), ("en", *language.features("a house"))])
    assert one.predict("the house")[0] == "en" and one.predict("1234 !")[0] == "und" and one.predict(None)[0] == "und"
    assert language.family_of("pt-BR") == "romance" and language.family_of("xx") == "xx"
    long = language.features("word " * 400_000)
    assert np.allclose(long[1].sum(), language.SCALE)


def test_quality_edges():
    assert len(quality.indicators("")) == 0
    model = quality.fit([], np.array([], int), np.zeros(quality.DIMS), 0.7)
    assert abs(model.score("x") - 0.7) < 1e-9 and abs(model.score(None) - 0.7) < 1e-9
    again, plain = set(quality.indicators("ab ab ab ab")), set(quality.indicators("ab cd ef gh"))
    assert any(c >= len(quality.WIDTHS) << quality.BITS for c in again) and not any(c >= len(quality.WIDTHS) << quality.BITS for c in plain)
    ratios = quality.log_count_ratios(np.array([9.0, 0.0]), np.array([0.0, 9.0]))
    assert ratios[0] > 0 > ratios[1]


def test_gram_slices_cover_everything():
    data = bytes(random.Random(1).randbytes(svm.SLICE * 2 + 77))
    whole = svm.gram_codes(np.frombuffer(data, np.uint8), 3, 15)
    parts = np.concatenate([svm.gram_codes(p, 3, 15) for p in svm.slices(data, 3)])
    assert np.array_equal(whole, parts)

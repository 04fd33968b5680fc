from __future__ import annotations

import random
import struct

import public_tokenizers
import pytest
import sentencepiece as library
from helpers import awkward, frame, prose
from knnscore.llm import sentencepiece, token_counts
from tokenizers import Tokenizer

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
DEFINITION = open(public_tokenizers.path("byte_bpe_50k.json")).read()


def odd_texts():
    r = random.Random(5)
    texts = ["", " ", "a  b   c", "▁x", "日本語 🎉🎉", "éé\n\n\tx", "    deep", " " * 40, "a" * 700, "x<|endoftext|>y <|endoftext|>", "\u0000x", "don't 12 3.5", "ÀÉÎ" * 30]
    texts += ["".join(r.choice("abcdefghij  etaoin.,-ABC\n") for _ in range(200)) for _ in range(60)]
    texts += [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 25))) for _ in range(40)) for _ in range(60)]
    return texts + [prose(1, 500)]


def test_byte_pair_paths_equal_the_library():
    texts = odd_texts()
    machine = sentencepiece.Transducer(MODEL)
    processor = library.SentencePieceProcessor(model_proto=MODEL)
    got = machine.encode(texts)
    assert got == processor.encode(texts)
    assert [machine.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    assert machine.encode([None]) == [[]]


def field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(fallback, squeeze=0):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.75, "▁a": -3.5, "bab": -4.25, "c": -3.0, "abc": -6.0, "▁abab": -8.5}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    pieces += [(t, s, 1) for t, s in scores.items()]
    model = b"".join(field(1, field(1, t.encode()) + field(2, s) + field(3, k)) for t, s, k in pieces)
    trainer = field(3, 1) + (field(35, 1) if fallback else b"")
    return model + field(2, trainer) + field(3, field(1, b"identity") + field(2, b"") + field(3, 1) + field(4, squeeze) + field(5, 1))


def test_long_words_go_through_windows(monkeypatch):
    r = random.Random(7)
    texts = ["".join(r.choice("etaoinshrdlu日é🎉") for _ in range(n)) for n in (3, 900, 49, 51, 1)] + [prose(2, 300)]
    processor = library.SentencePieceProcessor(model_proto=MODEL)
    for window in (1, 7, 50):
        monkeypatch.setattr(sentencepiece, "WINDOW", window)
        assert sentencepiece.Transducer(MODEL).encode(texts) == processor.encode(texts)


def test_paths_are_the_least_of_all_paths():
    """Every way to cut a word is weighed on the model with additive weights."""
    machine = sentencepiece.Transducer(unigram_model(False))

    def least(word):
        if not word:
            return 0.0
        ways = [least(word[i:]) - machine.score[word[:i]] for i in range(1, len(word) + 1) if word[:i] in machine.score]
        return min([*ways, least(word[1:]) + machine.fallback_weight] if word[0] not in machine.score else ways)

    r = random.Random(11)
    words = ["".join(r.choice("abcx") for _ in range(r.randint(1, 9))) for _ in range(80)]
    for word, path in zip(words, machine.shortest_paths(words), strict=True):
        assert "".join(map(machine.text_of, path)) == word
        weight = sum(-machine.scores[x] if x < machine.first_character else machine.fallback_weight for x in path)
        assert weight == pytest.approx(least(word))


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_paths_equal_the_library(fallback, squeeze):
    model = unigram_model(fallback, squeeze)
    machine, processor = sentencepiece.Transducer(model), library.SentencePieceProcessor(model_proto=model)
    r = random.Random(3)
    texts = ["".join(r.choice("aabbc ") for _ in range(r.randint(0, 25))) for _ in range(200)] + ["xyz ab", "é", "  a  b ", "   ", "a ▁ b"]
    assert machine.encode(texts) == processor.encode(texts)


def test_encode_and_decode_tables(spark):
    docs = frame(spark, awkward())
    got = sentencepiece.encode(docs, MODEL).collect()
    processor = library.SentencePieceProcessor(model_proto=MODEL)
    assert sorted((r.doc_id or -1, list(r.ids), r.round_trip) for r in got) == sorted((i or -1, processor.encode(t or ""), True) for i, t in awkward())
    back = sentencepiece.decode(sentencepiece.encode(docs, MODEL), MODEL).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in awkward())
    assert sentencepiece.encode(docs.limit(0), MODEL).count() == 0


def test_token_counts_equal_the_library(spark):
    rows = [*awkward(), *enumerate(odd_texts(), 100)]
    tokenizer = Tokenizer.from_str(DEFINITION)
    got = token_counts.count_tokens(frame(spark, rows), DEFINITION).collect()
    expected = [(i or -1, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows]
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(expected)
    assert token_counts.count_tokens(frame(spark, []), DEFINITION).count() == 0


def test_long_pre_tokens_equal_the_library_in_little_time():
    import time

    tokenizer, counter = Tokenizer.from_str(DEFINITION), token_counts.Counter(DEFINITION)
    r = random.Random(11)
    texts = ["a" * 3001, "ab" * 2000, "".join(r.choice("etaoinshrdlu") for _ in range(20_000)), "é" * 1500, "-=" * 900 + "!" * 700, "xyz" * 171 + " " * 600 + "q"]
    assert counter(texts) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [counter([t])[0] for t in texts] == counter(texts)
    began = time.perf_counter()
    counter(["".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 30


def test_unknown_vocabularies_raise():
    import json

    spec = json.loads(DEFINITION)
    for key, value in (("pre_tokenizer", {"type": "Whitespace"}), ("normalizer", {"type": "NFC"})):
        with pytest.raises(ValueError):
            token_counts.Counter(json.dumps(spec | {key: value}))

"""Importance resampling and source mixing against restatements in plain Python, and their awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnscore.llm import importance_resampling as resampling
from knnscore.llm import source_mixing as mixing

DOCS = "doc_id long, text string, source string, score long, rank string, _task long"
BENCH = "item_id string, text string, doc_id string"


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]


def resampled(docs, bench):
    of = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in bench for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for (doc, _), (words, f) in zip(docs, of, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(f), weight, score, None, len(words) >= 20 and doc is not None])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for place, r in enumerate(fit[: 25 * len(fit) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling_equals_a_restatement(spark):
    texts = [f"Word{i % 7} naïve {'ß' * (i % 3)} x{i}! " * (i % 40) for i in range(300)]
    docs = [(i, t, "s", 1, "r", 2) for i, t in enumerate(texts)]
    docs += [(1000, None, None, 1, "r", 2), (1001, "", "s", 1, "r", 2), (1002, "\x00,;-", "s", 1, "r", 2), (None, "no id " * 30, "s", 1, "r", 2), (5, texts[39], "s", 1, "r", 2), (5, texts[39], "s", 1, "r", 2)]
    bench = [("a", "word3 naïve x3", "z"), ("b", None, "z"), ("c", "", None)]
    found = resampling.resample(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(bench, BENCH))
    assert Counter(map(tuple, found.collect())) == resampled([d[:2] for d in docs], [b[1] for b in bench])


def test_resampling_of_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(resampling, "WINDOW_BYTES", 7)
    for text in ("", "a", "abcdefghijklmnop" * 5, "ab cd  ef,gh " * 20, "   abcdefg hijklmn opqrst ", "ééééé éé " * 9):
        got, n = resampling.counts(text, 10_000)
        words, f = features(text)
        assert n == len(words)
        assert {b: int(got[b]) for b in got.nonzero()[0]} == Counter(f)


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 40, "s", 0, "", 0)] * 8, DOCS)
    assert resampling.resample(none, spark.createDataFrame([], BENCH)).collect() == []
    assert sorted(r["rank"] or 9 for r in resampling.resample(some, spark.createDataFrame([], BENCH)).collect()) == [1, 2, *[9] * 6]


def test_blocks_hold_every_count(spark):
    docs = spark.createDataFrame([(i, "one two two " * i) for i in range(250)], "doc_id long, text string")
    blocks = resampling.matrix(docs, F.col("doc_id"), "test-blocks").collect()
    assert sorted(d for b in blocks for d in b["doc_id"]) == list(range(250))
    for b in blocks:
        starts, bucket, n = (np.frombuffer(b[c], "<i4").tolist() for c in ("row_starts", "bucket", "n"))
        for doc, a, z in zip(b["doc_id"], starts, starts[1:], strict=False):
            assert dict(zip(bucket[a:z], n[a:z], strict=True)) == Counter(features("one two two " * doc)[1])


def test_targets_share_the_excess():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([5, 5, 5, 5, 5], [1, 10, 100, 1000, 7], [0, 3, 9]):
        found = mixing.targets(sizes)
        assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * n for t, n in zip(found, sizes, strict=True))


def mixed(spark, rows, parts=4, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank int").repartition(parts), **more)


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (i * 37 % 211), ("hot", "b", "c", None)[0 if i % 3 else i // 3 % 4], "x", 0) for i in range(900)]
    found = mixed(spark, rows).collect()
    again = mixed(spark, rows[::-1], parts=7).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))
    assert len(found) == 900 and all(0 <= r["copies"] <= 2 and r["size"] == len(rows[r["doc_id"]][1].split()) for r in found)
    for source in ("hot", "b", "c", None):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < max(r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    order = sorted({r["source"] for r in found if r["source"] is not None}) + [None]
    sizes = [next(r["source_size"] for r in found if r["source"] == s) for s in order]
    assert [next(r["target"] for r in found if r["source"] == s) for s in order] == mixing.targets(sizes)


def test_mix_of_awkward_rows(spark):
    rows = [(1, None, "a", "", 0), (1, "\t\n", "a", "", 0), (2, "x y", "b", "", 0), (2, "x y", "b", "", 0), (None, "z\x0bz", "b", "", 0), (3, "  " * 50_000, "", "", 0)]
    found = mixed(spark, rows).collect()
    assert sorted(((r["doc_id"] or -1), r["size"], r["source_size"]) for r in found) == [(-1, 2, 6), (1, 0, 0), (1, 0, 0), (2, 2, 6), (2, 2, 6), (3, 50_000, 50_000)]
    assert all(r["target"] == 0 and r["copies"] == 0 for r in found if r["source"] == "a")
    assert mixed(spark, []).collect() == []


def test_what_is_emitted(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], "", 0) for i in range(50)]
    found = mixed(spark, rows, carry=("text",))
    out = mixing.emitted(found).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({r["doc_id"]: r["copies"] for r in found.collect() if r["copies"]})
    assert all(r["text"] == f"text {r['doc_id']}" for r in out)

"""Small tables with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re
from collections import Counter

EXTRA = "seen string, spans string, n int, kept string, start int, digest string, rep int, hits int"
SCHEMA = f"doc_id long, text string, {EXTRA}"
WORD = re.compile(r"[^\W_]+")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    out = []
    for i in range(words):
        out.append(r.choice(vocabulary))
        if i % 13 == 12:
            out[-1] += "."
        if i % 40 == 39:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def frame(spark, rows):
    """doc_id, text and extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", 2, "d", 3, 4) for i, t in rows], SCHEMA)


def awkward():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = prose(99, 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(4, 120)), (5, prose(4, 120)), (6, prose(6, 80)), (6, prose(6, 80)), (7, long), (8, long), (9, "one two"), (10, "one two"), (None, prose(4, 120)), (11, "ÄÖ ß 日本語 🎉 " * 20)]


def bag(text):
    words = WORD.findall((text or "").lower())
    size = min(5, len(words))
    return Counter(zip(*(words[k:] for k in range(size)), strict=False)) if size else Counter()


def similarity(a, b):
    least = sum((a & b).values())
    return least / max(1, sum(a.values()) + sum(b.values()) - least)

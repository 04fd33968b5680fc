"""Hard negatives against all pairs, with lists that bounds do and don't rule out."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from knnscore.llm import hard_negatives as mining

SCHEMA = "id long, label int, vec array<float>, score long, shelf int, rank string"


def brute(rows, every=100, positives=5, negatives=10):
    unique = {}
    for i, label, vec in rows:
        if i is None or label is None or not vec or any(x is None or not math.isfinite(x) for x in vec):
            continue
        x = (label, [math.floor(float(np.float32(v)) * 256) for v in vec])
        unique[i] = min(unique.get(i, x), x)
    out = Counter()
    ids = np.array(sorted(unique))
    data, labels = np.array([unique[i][1] for i in ids]), np.array([unique[i][0] for i in ids])
    for at, a in enumerate(ids):
        if a % every:
            continue
        score = [int(x) for x in data @ data[at]]
        order = sorted(range(len(ids)), key=lambda j: (-score[j], ids[j]))
        for p in [j for j in order if labels[j] == labels[at] and j != at][:positives]:
            within = [j for j in order if labels[j] != labels[at] and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            for rank, j in enumerate(within[:negatives], 1):
                out[(int(a), int(ids[p]), rank, int(ids[j]), int(score[p]), int(score[j]))] += 1
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5)
    return Counter(tuple(r) for r in mining.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, centres, seed=1, spread=0.05, labels=4):
    r = np.random.default_rng(seed)
    means = r.normal(0, 1, (centres, 8))
    return [(i, int(r.integers(labels)), (means[i % centres] + r.normal(0, spread, 8)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_equal_to_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(mining, "LIST_ROWS", 32)
    rows = clustered(900, 12, spread=spread)
    found = mined(spark, rows, every=10)
    assert found == brute(rows, every=10) and len(found) > 500


def test_copies_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(mining, "LIST_ROWS", 16)
    monkeypatch.setattr(mining, "SHELF_ROWS", 16)
    rows = clustered(300, 3, spread=0.0) + [(1000 + i, i % 2, [0.5] * 8) for i in range(400)]
    rows += [(2000 + i, 3, [0.25] * 8) for i in range(30)]
    assert mined(spark, rows, every=20) == brute(rows, every=20)


def test_awkward_rows(spark):
    ones = [1.0] * 8
    rows = clustered(60, 2) + [(100, None, ones), (200, 1, None), (300, 1, [1.0, None, *ones[2:]]), (400, 1, [float("nan"), *ones[1:]]), (500, 1, [float("-inf"), *ones[1:]]), (None, 1, ones), (600, 1, [])]
    rows += [(700, 2, ones), (700, 2, ones), (700, 1, [0.9] * 8), (701, 1, ones), (0, 1, ones)]
    assert mined(spark, rows, every=10) == brute(rows, every=10)
    assert mined(spark, []) == Counter() and mined(spark, [(100, 1, ones)]) == Counter()
    assert mined(spark, [(100, 1, ones), (101, 1, ones), (102, 2, [-1.0] * 8)]) == Counter()  # its score is outside the window
    with pytest.raises(Exception, match="differ in length"):
        mined(spark, [(100, 1, ones), (101, 1, [1.0])])


def test_large_numbers_are_exact(spark):
    rows = [(i, i % 2, [2.0**22 - i * 64, 3.0 * i, 1.0]) for i in range(120)]
    assert mined(spark, rows, every=50) == brute(rows, every=50)


def test_bounds_hold_and_stop_the_search(spark, monkeypatch):
    """Bounds are true; clustered rows let most lists be passed by; lists outside every window aren't asked for."""
    rows = np.array([v for _, _, v in clustered(800, 10, spread=0.01)]) * 256 // 1
    means = mining.fit(rows, 10)
    nearest = mining._nearest(rows, means)
    radii = np.array([np.sqrt(((rows[nearest == c] - means[c]) ** 2).sum(axis=1)).max(initial=0) for c in range(len(means))])
    lists = mining.Lists(means, radii, np.arange(len(means)), np.arange(len(means)))
    least, greatest = lists.bounds(rows, np.arange(len(means)))
    scores = rows @ rows.T
    for c in range(len(means)):
        assert (scores[:, nearest == c] <= greatest[:, [c]]).all() and (scores[:, nearest == c] >= least[:, [c]]).all()
    compared = defaultdict(int)
    real = mining.Shelf.products
    monkeypatch.setattr(mining.Shelf, "products", lambda self, asked, a, b: compared.__setitem__("n", compared["n"] + len(asked) * (b - a)) or real(self, asked, a, b))
    import pyarrow as pa

    held = pa.table({"list": nearest.astype(np.int32), "id": np.arange(len(rows)), "label": np.zeros(len(rows), np.int32), "vec": pa.array(rows.astype(np.int32).tolist(), pa.list_(pa.int32()))})
    shelf = mining.Shelf(held, lists, 5, True)
    window = pa.array([[{"positive_id": None, "positive_score": None, "low": mining.LEAST, "high": mining.MOST}]] * 100, pa.list_(pa.struct([(n, pa.int64()) for n in ("positive_id", "positive_score", "low", "high")])))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(100)), pa.array(np.zeros(100, np.int32)), pa.array(rows[:100].astype(np.int32).tolist(), pa.list_(pa.int32())), window], names=["anchor_id", "label", "vec", "windows"])
    out = pa.Table.from_batches(shelf.ask(batch)).to_pylist()
    assert len(out) == 500 and compared["n"] < 0.4 * 100 * len(rows)
    for a in range(100):
        best = sorted(((int(-scores[a, j]), j) for j in range(len(rows)) if j != a))[:5]
        assert [(r["score"], r["id"]) for r in out if r["anchor_id"] == a] == [(-s, j) for s, j in best]

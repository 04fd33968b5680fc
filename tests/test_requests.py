from __future__ import annotations

import gzip
import json
import struct

import numpy as np
import pytest

from knnscore.functions import scalar as S
from knnscore.operators import features, index
from knnscore.plans.scoring import score
from knnscore.sources import vectors
from knnscore.streaming.scorer import score_stream


def request(**changes):
    body = {
        "transaction": {"amount": 8000.0, "installments": 6, "requested_at": "2025-11-08T03:40:50Z"},
        "customer": {"avg_amount": 160.0, "tx_count_24h": 16, "known_merchants": ["shop-1"]},
        "merchant": {"id": "shop-9", "mcc": "7802", "avg_amount": 250.0},
        "terminal": {"is_online": True, "card_present": False, "km_from_home": 600.0},
        "last_transaction": None,
    }
    for k, v in changes.items():
        part, _, field = k.partition("__")
        if field:
            body[part][field] = v
        else:
            body[part] = v
    return body


ORDINARY = {
    "transaction": {"amount": 250.0, "installments": 3, "requested_at": "2024-05-06T18:20:00Z"},
    "customer": {"avg_amount": 100.0, "tx_count_24h": 5, "known_merchants": ["a", "shop-2"]},
    "merchant": {"id": "shop-2", "mcc": "5411", "avg_amount": 90.0},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 12.0},
    "last_transaction": {"timestamp": "2024-05-06T06:20:00Z", "km_from_current": 40.0},
}


def vector(spark, body):
    text = body if isinstance(body, str) else json.dumps(body)
    row = features.vectorise(features.parse(spark.createDataFrame([(0, text)], "query_id long, body string"))).withColumn("q", S.quantise_vector("vec")).first()
    return row.status, row.vec, row.q


def test_features_of_both_examples(spark):
    _, vec, q = vector(spark, request())  # a Saturday
    assert vec == pytest.approx([0.8, 0.5, 1, 3 / 23, 5 / 6, -1, -1, 0.6, 0.8, 1, 0, 1, 0.75, 0.025], abs=1e-6)
    assert q == [102, 64, 127, 17, 106, -127, -127, 76, 102, 127, 0, 127, 95, 3]
    _, vec, q = vector(spark, ORDINARY)  # a Monday
    assert vec == pytest.approx([0.025, 0.25, 0.25, 18 / 23, 0, 0.5, 0.04, 0.012, 0.25, 0, 1, 0, 0.15, 0.009], abs=1e-6)
    assert q == [3, 32, 32, 99, 0, 64, 5, 2, 32, 0, 127, 0, 19, 1]


@pytest.mark.parametrize(
    ("change", "dim", "value"),
    [
        ({"customer__avg_amount": 0.0}, 2, 0.0),
        ({"merchant__mcc": "0001"}, 12, 0.5),
        ({"customer__known_merchants": []}, 11, 1.0),
        ({"last_transaction": {"timestamp": "2025-11-08T05:00:00Z", "km_from_current": 1.0}}, 5, 0.0),
        ({"last_transaction": {"timestamp": "2025-11-08T03:39:59Z", "km_from_current": 1.0}}, 5, 1 / 1440),
        ({"transaction__requested_at": "2024-02-29T23:00:00Z"}, 4, 3 / 6),
        ({"transaction__amount": -5.0}, 0, 0.0),
    ],
)
def test_edges(spark, change, dim, value):
    status, vec, _ = vector(spark, request(**change))
    assert status == 200 and vec[dim] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("body", ["", "{", "[1]", json.dumps(request(transaction__requested_at="soon")), json.dumps({k: v for k, v in request().items() if k != "merchant"})])
def test_malformed_requests_have_status_400(spark, body):
    assert vector(spark, body)[:2] == (400, None)


def small_index(spark):
    vecs = [vector(spark, request())[1], vector(spark, ORDINARY)[1]]
    rows = [(i, [float(x) for x in vecs[i % 2]], int(i % 2 == 0)) for i in range(12)]
    return index.build(spark.createDataFrame(rows, "id long, vec array<float>, label int"), np.array(vecs, float), 2)


def test_batch_and_stream_give_the_same_answers(spark, tmp_path):
    built = small_index(spark)
    raw = spark.createDataFrame([(1, json.dumps(request())), (2, json.dumps(ORDINARY)), (3, "nonsense")], "query_id long, body string")
    batch = {r.query_id: (r.status, r.body) for r in score(raw, built).collect()}
    assert batch[3] == (400, None)
    assert json.loads(batch[1][1]) == {"approved": False, "fraud_score": 1.0}
    assert json.loads(batch[2][1]) == {"approved": True, "fraud_score": 0.0}
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    query = score_stream(stream, built, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    assert {r.query_id: (r.status, r.body) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_rows_that_share_an_id_have_answers_of_their_own(spark):
    built = small_index(spark)
    raw = spark.createDataFrame([(1, json.dumps(request())), (1, json.dumps(ORDINARY)), (1, json.dumps(ORDINARY)), (None, json.dumps(request())), (None, None)], "query_id long, body string")
    got = [(r.query_id, r.status, r.body and json.loads(r.body)["approved"]) for r in score(raw, built).collect()]
    assert sorted(got, key=str) == sorted([(1, 200, False), (1, 200, True), (1, 200, True), (None, 200, False), (None, 400, None)], key=str)
    assert score(raw.limit(0), built).count() == 0


def brute_score(vectors, labels, centroids, query, nprobe, k=5):
    """Count of label 1 among the k nearest quantised rows of the probed lists, one row after the other."""
    quantise = lambda v: [max(-127, min(127, int(np.float32(x) * np.float32(127) + np.float32(0.5 if x >= 0 else -0.5)))) for x in v]
    away = lambda a, b: sum((float(x) - float(y)) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    probed = sorted(range(len(centroids)), key=lambda c: (away(query, centroids[c]), c))[:nprobe]
    near = sorted((away(quantise(v), quantise(query)), probed.index(c), i) for i, v in enumerate(vectors) if (c := nearest(v)) in probed)[:k]
    return sum(labels[i] for *_, i in near)


def test_scores_equal_brute_force(spark):
    bodies = [request(transaction__amount=50.0 * k, terminal__km_from_home=float(k * 7 % 900), merchant__mcc=("5411", "7995", "0")[k % 3], customer__tx_count_24h=k % 23) for k in range(90)]
    raw = spark.createDataFrame([(k, json.dumps(b)) for k, b in enumerate(bodies)], "query_id long, body string")
    vecs = [r.vec for r in features.vectorise(features.parse(raw)).orderBy("query_id").collect()]
    labels = [k * 5 % 11 < 5 for k in range(90)]
    data = spark.createDataFrame([(k, v, int(x)) for k, (v, x) in enumerate(zip(vecs, labels, strict=True))], "id long, vec array<float>, label int")
    built = index.build(data, np.array(vecs[:7], float), 2)
    for r in score(raw, built).collect():
        n = brute_score(vecs, labels, vecs[:7], vecs[r.query_id], 2)
        assert json.loads(r.body) == {"approved": n < 3, "fraud_score": n / 5}


def test_json_source(spark, tmp_path):
    path = tmp_path / "rows.json.gz"
    path.write_bytes(gzip.compress(json.dumps([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [0.1] * 14, "label": "legit"}]).encode()))
    got = vectors.read_json(spark, str(path), 2).orderBy("label").collect()
    assert [(r.label, len(r.vec)) for r in got] == [(0, 14), (1, 14)]


def binary(version, dims=3):
    """Eleven vectors in two clusters (nine and two)."""
    values = np.arange(11 * dims).astype(np.int8).reshape(11, dims)
    labels = (np.arange(11) % 2).astype(np.int8)
    sizes = np.array([9, 2], "<i4")
    head = struct.pack("<4i", 0x52494E48, version, 11, dims)
    if version == 2:
        return head + (values / np.float32(127)).astype("<f4").tobytes() + labels.tobytes(), values, labels
    head += struct.pack("<4i", 2, 1, 0, 0)
    tail = np.zeros((2, dims), "<f4").tobytes() + sizes.tobytes()
    if version == 3:
        order = np.arange(11)[::-1].astype("<i4")
        return head + values.tobytes() + labels.tobytes() + tail + order.tobytes(), values[::-1], labels[::-1]
    body = values.tobytes() if version == 4 else values[:8].T.copy().tobytes() + values[8:].tobytes()
    return head + body + labels.tobytes() + tail, values, labels


@pytest.mark.parametrize("version", [2, 3, 4, 5])
def test_binary_layouts(spark, tmp_path, version):
    data, values, labels = binary(version)
    (tmp_path / "rows.bin").write_bytes(data)
    got = vectors.read_binary_lists(spark, str(tmp_path / "rows.bin"), 3).orderBy("cluster_id", "pos").collect()
    assert [r.qvec for r in got] == values.tolist() and [r.label for r in got] == labels.tolist()
    clusters = vectors.read_binary_clusters(spark, str(tmp_path / "rows.bin")).collect()
    assert [r["size"] for r in clusters] == ([] if version == 2 else [9, 2])


@pytest.mark.parametrize("spoil", [lambda d: b"x" + d[1:], lambda d: d[:-1], lambda d: d[:4] + struct.pack("<i", 9) + d[8:], lambda d: d[:8] + struct.pack("<i", 0) + d[12:], lambda d: d[:9]])
def test_unfit_binary_files_raise(spoil, tmp_path):
    (tmp_path / "rows.bin").write_bytes(spoil(binary(4)[0]))
    with pytest.raises(ValueError):
        vectors.layout(str(tmp_path / "rows.bin"), 3)


def large(version, sizes, dims=5):
    """A file of random rows in clusters of the given sizes, and its rows by (cluster, pos)."""
    random = np.random.default_rng(version)
    n = sum(sizes)
    values, labels = random.integers(-127, 128, (n, dims)).astype(np.int8), random.integers(0, 2, n).astype(np.int8)
    head, tail = struct.pack("<8i", 0x52494E48, version, n, dims, len(sizes), 1, 0, 0), random.normal(size=(len(sizes), dims)).astype("<f4").tobytes() + np.array(sizes, "<i4").tobytes()
    if version == 3:
        order = random.permutation(n).astype("<i4")
        return head + values.tobytes() + labels.tobytes() + tail + order.tobytes(), values[order], labels[order]
    body, at = b"", 0
    for size in sizes:
        own, whole = values[at : at + size], size // 8 * 8
        blocks = [own[i : i + 8].T.copy().tobytes() for i in range(0, whole, 8)] if version == 5 else [own[:whole].tobytes()]
        body, at = body + b"".join(blocks) + own[whole:].tobytes(), at + size
    return head + body + labels.tobytes() + tail, values, labels


@pytest.mark.parametrize("version", [3, 4, 5])
@pytest.mark.parametrize("each", [1, 10, 37, 10_000])
def test_files_in_ranges(spark, tmp_path, version, each):
    sizes = [0, 3, 41, 8, 0, 100, 1, 16, 7]
    for name in ("a.bin", "b.bin"):
        data, values, labels = large(version, sizes)
        (tmp_path / name).write_bytes(data)
    found = vectors.layout(str(tmp_path / "a.bin"), 5)
    cuts = found.cuts(each)
    assert [a for a, _ in cuts][1:] == [b for _, b in cuts][:-1] and cuts[0][0] == 0 and cuts[-1][1] == sum(sizes)
    parts = [vectors.decode(found, a, b) for a, b in cuts]
    joined = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.lexsort((joined["pos"], joined["cluster_id"]))
    assert (joined["qvec"][order] == values).all() and (joined["label"][order] == labels).all()
    assert joined["cluster_id"][order].tolist() == np.repeat(np.arange(len(sizes)), sizes).tolist()
    if each == 37:
        rows = spark.dataSource.register(vectors.VectorFiles) or spark.read.format("quantised_vectors").option("rows", each).load(str(tmp_path))
        assert rows.rdd.getNumPartitions() == 2 * len(cuts) > 4
        got = rows.orderBy("cluster_id", "pos").collect()
        assert [r.qvec for r in got[::2]] == values.tolist() == [r.qvec for r in got[1::2]]


def test_one_json_array_is_read_by_several_tasks(spark, tmp_path):
    records = [{"vector": [i / 1000] * 3, "label": "fraud" if i % 3 else "legit"} for i in range(4000)]
    text = json.dumps(records)
    (tmp_path / "rows.json").write_text(text.replace('{"vector": [0.007', '{"vector": "x') + " \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        found = vectors.json_records(spark, str(tmp_path / "rows.json"))
        assert found.rdd.getNumPartitions() > 3
        assert found.where("broken").count() == 1
        got = sorted((round(r.vec[0] * 1000), r.label) for r in vectors.read_json(spark, str(tmp_path / "rows.json")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, int(i % 3 > 0)) for i in range(4000) if i != 7]


@pytest.mark.parametrize(
    ("change", "dim", "value"),
    [
        ({"transaction__requested_at": "2026-03-01T23:30:00-03:00"}, 3, 1.0),
        ({"transaction__requested_at": "2026-03-01T23:30:00-03:00"}, 4, 1.0),
        ({"transaction__installments": 3.7}, 1, 3 / 12),
        ({"transaction__installments": -3}, 1, 0.0),
        ({"customer__tx_count_24h": 99999999999}, 8, 1.0),
        ({"last_transaction": {"timestamp": "2025-11-08T02:40:59+09:00", "km_from_current": 1.0}}, 5, 60 / 1440),
    ],
)
def test_times_and_whole_numbers_are_read_as_they_stand(spark, change, dim, value):
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            status, vec, _ = vector(spark, request(**change))
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        assert status == 200 and vec[dim] == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("at", ["2026-02-30T10:00:00Z", "2026-02-03T24:00:00Z", "2026-02-03 10:00", ""])
def test_times_that_are_none_have_status_400(spark, at):
    assert vector(spark, request(transaction__requested_at=at))[0] == 400


def test_a_stream_that_fails_in_a_batch_loses_and_doubles_no_answer(spark, tmp_path, monkeypatch):
    """The first batch fails after its answers are written; the second run writes them anew."""
    from knnscore.streaming import scorer

    built = small_index(spark)
    rows = [(i, json.dumps(request() if i % 2 else ORDINARY)) for i in range(6)]
    for at in (0, 3):
        spark.createDataFrame(rows[at : at + 3], "query_id long, body string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("query_id long, body string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    real, calls = scorer.score, []

    def failing(raw, index, **more):
        calls.append(1)
        answers = real(raw, index, **more)
        if len(calls) == 1:
            answers.write.mode("overwrite").parquet(f"{tmp_path}/out/batch=0")
            raise RuntimeError("lost")
        return answers

    monkeypatch.setattr(scorer, "score", failing)
    query = score_stream(stream(), built, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    query = score_stream(stream(), built, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.query_id for r in got) == list(range(6)) and len(calls) == 3
    assert all(json.loads(r.body)["approved"] == (r.query_id % 2 == 0) for r in got)

from __future__ import annotations

import json
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knnscore import queries
from knnscore.functions import scalar as S
from knnscore.operators import index, kmeans, parts, search, vote

TABLES = "/root/testdata/sf0.1"
ROWS, QUERIES = "id long, vec array<float>, label int", "query_id long, vec array<float>"
#: Example vectors of the two kinds of request.
LEGIT = [0.02, 0.25, 0.08, 0.5, 0.6, -1, -1, 0.06, 0.2, 0, 1, 0, 0.2, 0.01]
FRAUD = [0.88, 0.75, 0.96, 0.1, 0.7, -1, -1, 0.9, 0.95, 1, 0, 1, 0.8, 0.02]


def first(*values):
    return [[float(v)] + [0.0] * 13 for v in values]


def rows(spark, vectors, fraud=lambda i: False):
    return spark.createDataFrame([(i, [float(x) for x in v], int(fraud(i))) for i, v in enumerate(vectors)], ROWS)


def ask(spark, *vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], QUERIES)


def found(df):
    return [(r.id, r.dist) for r in df.orderBy("query_id", "rank").collect()]


def test_exact_match_comes_first(spark):
    assert found(search.exact(rows(spark, first(1, 2, 3)), ask(spark, *first(2)), 14))[0] == (1, 0.0)


def test_neighbours_are_in_order(spark):
    got = found(search.exact(rows(spark, first(*range(9, -1, -1))), ask(spark, *first(0)), 14))
    assert [i for i, _ in got] == [9, 8, 7, 6, 5]
    assert [d for _, d in got] == sorted(d for _, d in got)


def test_small_stores_give_what_they_have(spark):
    assert len(found(search.exact(rows(spark, first(0, 1, 2, 3, 4)), ask(spark, *first(0)), 14))) == 5
    assert len(found(search.exact(rows(spark, [[0.5, 0.5] + [0] * 12]), ask(spark, *first(0)), 14))) == 1
    assert found(search.exact(rows(spark, []), ask(spark, *first(0)), 14)) == []


def test_the_farthest_is_left_out_and_ties_go_by_id(spark):
    got = [i for i, _ in found(search.exact(rows(spark, first(10, 9, 8, 7, 6, 1)), ask(spark, *first(0)), 14))]
    assert got == [5, 4, 3, 2, 1]
    assert [i for i, _ in found(search.exact(rows(spark, first(*[2] * 9)).repartition(3), ask(spark, *first(2)), 14))] == [0, 1, 2, 3, 4]


def hundred():
    return [[((i * 37 + d * 13) % 100) / 100 for d in range(14)] for i in range(100)]


def test_pruning_by_the_first_dimension_changes_nothing(spark):
    data = rows(spark, hundred()).withColumn("d0", F.col("vec")[0].cast("double"))
    queries = ask(spark, [0.5] * 14, *first(0.3), [-1.0] * 14)
    truth = search.exact(data, queries, 14).orderBy("query_id", "rank").collect()
    assert search.first_dimension_pruned(data, queries, 14, near=0.05).orderBy("query_id", "rank").collect() == truth


def test_int8_order_of_the_hundred(spark):
    data = rows(spark, hundred()).withColumn("vec", S.quantise_vector("vec"))
    query = ask(spark, [0.5] * 14).withColumn("vec", S.quantise_vector("vec"))
    assert found(search.exact(data, query, 14)) == [(68, 15704), (95, 15718), (41, 15747), (14, 15803), (22, 15803)]


@pytest.mark.parametrize(("query", "fraud"), [(LEGIT, 0), (FRAUD, 5)])
def test_examples_are_decided(spark, query, fraud):
    shift = lambda v, i: [v[0] + 0.001 * i, *v[1:]]
    data = rows(spark, [shift(LEGIT, i) for i in range(5)] + [shift(FRAUD, i) for i in range(5)], lambda i: i >= 5)
    queries = ask(spark, query)
    decided = vote.decide(vote.fraud_count(queries, search.exact(data, queries, 14, carry=("label",)))).first()
    assert (decided.fraud_count, decided.fraud_score, decided.approved) == (fraud, fraud / 5, fraud < 3)


@pytest.mark.parametrize("n", range(6))
def test_scores_divide_by_k(spark, n):
    neighbours = spark.createDataFrame([(0, 1)] * n, "query_id long, label int")
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    got = {r.query_id: r for r in vote.decide(vote.fraud_count(queries, neighbours)).collect()}
    assert got[0].fraud_score == pytest.approx(n / 5) and got[0].approved == (n < 3)
    assert got[1].fraud_score == 0 and got[1].approved  # no neighbour at all


@pytest.mark.parametrize(("x", "q"), [(-1.0, -127), (-0.5, -64), (0.0, 0), (0.5, 64), (1.0, 127), (2.0, 127), (-9.0, -127), (1e9, 127), (-1e30, -127), (math.inf, 127), (-math.inf, -127), (math.nan, 0)])
def test_quantise(spark, x, q):
    assert spark.range(1).select(S.quantise(F.lit(x).cast("float")).alias("q")).first().q == q


def integers(seed, n=300, dims=6, clusters=7):
    random = np.random.default_rng(seed)
    centres = random.integers(-60, 60, (clusters, dims))
    return centres[random.integers(clusters, size=n)] / 127 + random.integers(-25, 25, (n, dims)) / 127


def brute_ivf(data, query, centroids, nprobe, k=5):
    data, centroids = data.astype(np.float32).astype(float), centroids.astype(float)
    nearest = ((data[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    order = np.lexsort((np.arange(len(centroids)), ((centroids - np.float32(query)) ** 2).sum(axis=1)))[:nprobe]
    quantise = lambda v: np.clip(np.trunc(v.astype(np.float32) * np.float32(127) + np.where(v >= 0, np.float32(0.5), np.float32(-0.5))), -127, 127)
    q8, out = quantise(np.asarray(query)), []
    for rank, c in enumerate(order):
        for pos, i in enumerate(np.flatnonzero(nearest == c)):
            out.append((((quantise(data[i]) - q8) ** 2).sum(), rank, pos, int(i)))
    return [(i, d) for d, _, _, i in sorted(out)[:k]]


@pytest.mark.parametrize("seed", [1, 2])
def test_inverted_file_matches_brute_force(spark, seed):
    data = integers(seed)
    frame = rows(spark, data.tolist()).repartition(3)
    centroids = np.float32(data[:9]).astype(float)
    built = index.build(frame, centroids, 3)
    queries = data[100:110]
    for nprobe in (1, 3, 9):
        got = search.inverted_file(built, ask(spark, *queries.tolist()), nprobe).orderBy("query_id", "rank").collect()
        for n, query in enumerate(queries):
            assert [(r.id, r.dist) for r in got if r.query_id == n] == brute_ivf(data, query, centroids, nprobe)


def test_all_lists_equal_the_exact_search_and_boxes_prune(spark):
    data = integers(3, n=400, clusters=5)
    frame = rows(spark, data.tolist())
    built = index.build(frame, np.float32(data[:12]).astype(float), 4)
    queries = ask(spark, *data[50:60].tolist())
    quantised = queries.select("query_id", S.quantise_vector("vec").alias("vec"), F.col("vec").alias("raw"))
    truth = {(r.query_id, r.dist) for r in search.exact(frame.withColumn("vec", S.quantise_vector("vec")), quantised.select("query_id", "vec"), 6).collect()}
    assert {(r.query_id, r.dist) for r in search.inverted_file(built, queries, 12).collect()} == truth
    kept = search.pruned_probes(built, quantised)
    probes = kept.select("query_id", "cluster_id", F.lit(1).alias("probe_rank"))
    assert {(r.query_id, r.dist) for r in search.scan_lists(built, quantised.select("query_id", "vec"), probes).collect()} == truth
    assert 0 < kept.count() < 10 * 12  # it does prune
    wrong = kept.where("bound <= radius * 0.02").select("query_id", "cluster_id", F.lit(1).alias("probe_rank"))
    assert {(r.query_id, r.dist) for r in search.scan_lists(built, quantised.select("query_id", "vec"), wrong).collect()} != truth  # the test can fail


def test_empty_clusters_and_bad_nprobe(spark):
    data = integers(4, n=50)
    centroids = np.vstack([data[:3], [[99.0] * 6]])
    built = index.build(rows(spark, data.tolist()), centroids, 2)
    sizes = {r.cluster_id: (r["size"], r["offset"], r.low, r.high) for r in built.clusters.collect()}
    assert sizes[3] == (0, 50, [127] * 6, [-127] * 6) and sum(x[0] for x in sizes.values()) == 50
    assert kmeans.step(rows(spark, data.tolist()), centroids)[3].tolist() == [99.0] * 6
    for nprobe in (0, 5):
        with pytest.raises(ValueError):
            search.inverted_file(built, ask(spark, data[0].tolist()), nprobe)


def test_saved_indexes_come_back(spark, tmp_path):
    data = integers(5, n=80)
    built = index.build(rows(spark, data.tolist()), data[:4].copy(), 2)
    index.save(built, f"{tmp_path}/i")
    loaded = index.load(spark, f"{tmp_path}/i", 6)
    queries = ask(spark, *data[:5].tolist())
    assert found(search.inverted_file(loaded, queries, 2)) == found(search.inverted_file(built, queries, 2))
    with pytest.raises(ValueError):
        index.load(spark, f"{tmp_path}/i", 14)


def test_kmeans_matches_numpy(spark):
    data = integers(6, n=200)
    frame = rows(spark, data.tolist())
    seeds = kmeans.spread_seeds(frame, 5)
    assert len(np.unique(seeds, axis=0)) == 5
    centroids, before = kmeans.fit(frame, seeds, 3)
    expected, x = seeds, np.float32(data).astype(float)
    for _ in range(3):
        nearest = ((x[:, None] - expected[None]) ** 2).sum(axis=2).argmin(axis=1)
        last, expected = expected, np.array([np.float32(x[nearest == c].mean(axis=0)) if (nearest == c).any() else expected[c] for c in range(5)], float)
    assert np.allclose(centroids, expected, atol=1e-6) and np.allclose(before, last, atol=1e-6)


def test_repeated_null_and_text_ids(spark):
    data = spark.createDataFrame([(None, [0.0, 1.0]), ("a", [0.0, 1.0]), ("b", [5.0, 1.0]), ("c", None), ("d", [0.0, 1.0]), ("d", [9.0, 9.0])], "id string, vec array<float>")
    queries = spark.createDataFrame([("q", [0.0, 1.0]), ("q", [0.0, 1.0]), (None, [5.0, 1.0]), ("n", None)], QUERIES.replace("long", "string"))
    got = [(r.query_id, r.rank, r.id, r.dist) for r in search.exact(data, queries, 2, k=3).collect()]
    assert sorted(x for x in got if x[0] == "q") == [("q", 1, "a", 0.0), ("q", 2, "d", 0.0), ("q", 3, None, 0.0)]
    assert [x[2] for x in sorted((x for x in got if x[0] is None), key=lambda x: x[1])] == ["b", "a", "d"]
    assert len(got) == 6
    pruned = search.first_dimension_pruned(data.where("vec IS NOT NULL").withColumn("d0", F.col("vec")[0].cast("double")), queries, 2, k=3).collect()
    assert sorted(map(str, pruned)) == sorted(map(str, search.exact(data, queries, 2, k=3).select("query_id", "id", "dist", "rank").select(pruned[0].__fields__).collect()))


def test_index_on_null_vectors_and_empty_tables(spark):
    data = integers(7, n=40)
    plain = rows(spark, data.tolist())
    holes = plain.union(spark.createDataFrame([(100, None, 1), (None, data[3].tolist(), 0)], ROWS))
    assert index.assign(holes, data[:3].copy()).where("id = 100").first().cluster_id is None
    built = index.build(holes, data[:3].copy(), 3)
    twice = ask(spark, data[3].tolist()).union(ask(spark, data[3].tolist(), data[5].tolist()))
    got = search.inverted_file(built, twice, 3).collect()
    assert sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert {r.id for r in got if r.query_id == 0 and r.dist == 0} == {3, None}
    assert len(kmeans.spread_seeds(plain.limit(0), 4)) == 0
    with pytest.raises(ValueError):
        index.assign(plain, kmeans.spread_seeds(plain.limit(0), 4))
    empty = index.build(plain.limit(0), data[:3].copy(), 2)
    assert search.inverted_file(empty, twice, 2).count() == 0 and empty.clusters.agg(F.sum("size")).first()[0] == 0
    assert search.inverted_file(built, twice.limit(0), 2).count() == 0


def test_boxes_rule_chunks_out():
    """Chunks of far rows aren't compared; with a wrong bound the result differs."""
    random = np.random.default_rng(5)
    data = np.concatenate([random.integers(-5, 5, (50, 4)) + 40 * c for c in range(3)])
    table = pa.table({"id": range(150), "vec": pa.array(data.tolist(), pa.list_(pa.int16())), "label": [0] * 150})
    truth = [sorted((((data[i] - data[q]) ** 2).sum(), i) for i in range(150))[:5] for q in range(4)]

    def nearest(part):
        q, r, d = part.nearest(data[:4].astype(float), np.full(4, np.inf), True)
        ids = part.rows.column("id").to_numpy()
        return [[(x, ids[i]) for n, i, x in zip(q, r, d, strict=True) if n == k] for k in range(4)]

    part = parts.Part(table, 5, chunk=40)
    assert nearest(part) == truth and part.compared <= 4 * 75
    assert sorted(np.concatenate(parts.near_each_other(data, 40)).tolist()) == list(range(150))
    wrong = parts.Part(table, 5, chunk=10)
    wrong.bounds = lambda queries: parts.Part.bounds(wrong, queries) * 1000 + 1e6 * (np.arange(len(wrong.spans)) > 3)
    assert nearest(wrong) != truth


def test_first_dimension_store_skips_row_groups(spark, tmp_path):
    data = np.random.default_rng(8).normal(size=(4000, 4))
    frame = rows(spark, data.tolist())
    search.sorted_by_first_dimension(frame, 4).write.parquet(f"{tmp_path}/sorted")
    stored = spark.read.parquet(f"{tmp_path}/sorted")
    parts = stored.groupBy(F.input_file_name()).agg(F.min("d0").alias("low"), F.max("d0").alias("high")).orderBy("low").collect()
    assert len(parts) > 1 and all(a.high <= b.low for a, b in zip(parts, parts[1:], strict=False))
    queries = ask(spark, *data[:3].tolist())
    order = lambda df: df.orderBy("query_id", "rank").collect()
    assert order(search.first_dimension_pruned(stored, queries, 4, near=0.2)) == order(search.exact(frame, queries, 4))
    plan = stored.where("d0 >= 0.5D AND d0 <= 0.6D")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(d0), GreaterThanOrEqual(d0,0.5), LessThanOrEqual(d0,0.6)]" in plan


def test_mass_and_one_round_match_numpy(spark):
    data = integers(9, n=120)
    x = np.float32(data).astype(float)
    total = ((x[:, None] - x[None, :4]) ** 2).sum(axis=2).min(axis=1).sum()
    assert kmeans.mass(rows(spark, data.tolist()), x[:4]).first().total == pytest.approx(total)


def old_seeds(x, n, seed):
    """k-means++ over all rows, one after the other."""
    random = np.random.default_rng(seed)
    seeds, least = [x[random.integers(len(x))]], np.full(len(x), np.inf)
    for _ in range(1, n):
        least = np.minimum(least, ((x - seeds[-1]) ** 2).sum(axis=1))
        up = np.cumsum(least)
        seeds.append(x[np.searchsorted(up, random.random() * up[-1])])
    return np.array(seeds)


def test_seeds_from_all_rows_are_as_good_as_one_by_one(spark):
    x = np.float32(integers(11, n=3000, clusters=40)).astype(float)
    frame = rows(spark, x.tolist()).repartition(6)
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    ours = np.mean([cost(kmeans.spread_seeds(frame, 40, seed=s)) for s in (1, 2)])
    assert ours <= 1.05 * np.mean([cost(old_seeds(x, 40, s)) for s in range(8)])


def test_a_pass_of_seeding_matches_numpy(spark):
    x = np.float32(integers(12, n=400)).astype(float)
    frame = rows(spark, x.tolist()).repartition(3)
    least = ((x[:, None] - x[None, :2]) ** 2).sum(axis=2).min(axis=1)
    got = kmeans.drawn(frame, x[:2], 60, float(least.sum()), 3, 7)
    chance = {r.id: r.c for r in frame.select("id", (F.pmod(F.xxhash64("id", F.lit(7), F.lit(3)), F.lit(1 << 53)) / float(1 << 53)).alias("c")).collect()}
    expected = [x[i].tolist() for i in range(400) if chance[i] * least.sum() < 60 * least[i]]
    assert sorted(got.tolist()) == sorted(expected) and 20 < len(got) < 120


def test_bounded_rounds_equal_plain_ones_and_skip_rows(spark):
    random = np.random.default_rng(13)
    x = random.normal(0, 1, (20, 6))[random.integers(20, size=1500)] + random.normal(0, 0.1, (1500, 6))
    frame = rows(spark, x.tolist()).repartition(3)
    seeds = kmeans.spread_seeds(frame, 20)
    compared = spark.sparkContext.accumulator(0)
    bounded, before = kmeans.bounded_fit(frame, seeds, 8, compared)
    plain, last = kmeans.fit(frame, seeds, 8)
    assert np.allclose(bounded, plain, atol=1e-6) and np.allclose(before, last, atol=1e-6)
    assert compared.value < 0.6 * 8 * 1500 * 20
    none = kmeans.bounded_fit(frame, np.zeros((0, 0)))[0]
    assert len(none) == 0 and len(kmeans.fit(frame, np.zeros((0, 0)))[0]) == 0


def test_few_rows_give_their_seeds(spark):
    assert sorted(map(tuple, kmeans.spread_seeds(rows(spark, first(1, 2, 2, 3)), 3).tolist())) == sorted(map(tuple, np.array(first(1, 2, 3)).tolist()))
    assert len(kmeans.spread_seeds(rows(spark, first(1, 1)), 4)) == 4


def skewed(n=6000, dims=14, seed=21):
    """Like request vectors: in clusters, and the first dimension near 0 for most."""
    random = np.random.default_rng(seed)
    means = random.random((30, dims))
    x = np.clip(means[random.integers(30, size=n)] + random.normal(0, 0.03, (n, dims)), -1, 1)
    x[:, 0] = np.clip(random.exponential(0.3, n), 0, 1)
    return x


def in_order(df):
    return [(r.query_id, r["rank"], r.id, r.dist) for r in df.orderBy("query_id", "rank").collect()]


def test_two_phases_read_fewer_files_and_rows(spark, tmp_path):
    x = skewed()
    x[:, 0] /= 4
    frame = rows(spark, x.tolist()).repartition(4)
    _, before = kmeans.fit(frame, kmeans.spread_seeds(frame, 30), 4)
    built = index.build(frame, before, 4, f"{tmp_path}/index")
    near = int(np.bincount(((x[:, None] - before[None]) ** 2).sum(axis=2).argmin(axis=1)).argmax())
    asked = ask(spark, *x[((x[:, None] - before[None]) ** 2).sum(axis=2).argmin(axis=1) == near][:20].tolist())
    quantised = lambda df: df.withColumn("vec", S.quantise_vector("vec"))
    truth = in_order(search.exact(quantised(frame), quantised(asked), 14))
    compared = spark.sparkContext.accumulator(0)
    assert in_order(search.pruned_file(built, asked, order=("id",), compared=compared)) == truth
    assert 0 < compared.value < 0.2 * 20 * len(x)
    probes = search._probed(built, asked, built.n_clusters).withColumn("limit", F.lit(12000.0))
    named = search.within_boxes(built, probes).select(F.inline("probes"))
    read = search.lists_named(built, named)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert 0 < files(read) < 0.5 * files(built.lists)
    assert "PartitionFilters: [cluster_id#" in read._jdf.queryExecution().toString()  # folders of others aren't opened
    wrong = in_order(search.pruned_file(built, asked, order=("id",), slack=1e9))
    assert wrong == truth  # no pruning
    loose = in_order(search.inverted_file(built, asked, 4))
    assert len({(q, d) for q, _, _, d in loose} & {(q, d) for q, _, _, d in truth}) >= 0.9 * len({(q, d) for q, _, _, d in truth})


def test_a_wrong_bound_of_boxes_shows(spark, tmp_path):
    x = integers(31, n=800, clusters=12)
    frame = rows(spark, x.tolist())
    built = index.build(frame, np.float32(x[:16]).astype(float), 4)
    asked = ask(spark, *x[100:140].tolist())
    quantised = lambda df: df.withColumn("vec", S.quantise_vector("vec"))
    truth = in_order(search.exact(quantised(frame), quantised(asked), 6))
    assert in_order(search.pruned_file(built, asked, order=("id",))) == truth
    assert in_order(search.pruned_file(built, asked, order=("id",), slack=1e-6)) != truth


def test_bands_compare_few_pairs(spark, tmp_path):
    x = skewed(8000)
    x[::9, 0] = 0.25  # a value that many rows share
    frame = rows(spark, x.tolist()).repartition(4)
    search.save_bands(frame, f"{tmp_path}/bands", 250)
    bands = search.load_bands(spark, f"{tmp_path}/bands", frame.schema)
    assert len(bands.number) > 20
    asked = ask(spark, *x[:1000].tolist(), [9.0] * 14)
    compared = spark.sparkContext.accumulator(0)
    got = in_order(search.band_join(bands, asked, compared=compared))
    assert got == in_order(search.exact(frame, asked, 14))
    assert compared.value < 0.4 * 1000 * len(x)
    holes = frame.limit(3).union(spark.createDataFrame([(9001, None, 0), (9002, [math.nan, *[0.0] * 13], 0)], ROWS))
    search.save_bands(holes, f"{tmp_path}/few")
    few = search.load_bands(spark, f"{tmp_path}/few", holes.schema)
    assert len(in_order(search.band_join(few, asked.limit(2)))) == 6
    search.save_bands(frame.limit(0), f"{tmp_path}/none")
    assert search.band_join(search.load_bands(spark, f"{tmp_path}/none", frame.schema), asked).count() == 0


@pytest.mark.skipif(not os.path.isdir(f"{TABLES}/events.parquet") and not os.path.isfile(f"{TABLES}/events.parquet"), reason="no test tables")
def test_bands_of_request_vectors_compare_a_fifth_of_the_pairs(spark, tmp_path):
    frame = queries._request_vectors(spark, TABLES).select("id", "vec", F.col("label").cast("int").alias("label"))
    search.save_bands(frame, f"{tmp_path}/requests", queries.BAND_ROWS)
    bands = search.load_bands(spark, f"{tmp_path}/requests", frame.schema)
    asked, compared, n = frame.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec"), spark.sparkContext.accumulator(0), frame.count()
    got = in_order(search.band_join(bands, asked, compared=compared))
    assert len(got) == 5 * n // 100 and got == in_order(search.exact(frame, asked, 14))
    assert compared.value < 0.2 * n * n / 100


def test_many_queries_make_a_plan_of_the_same_size(spark):
    x = integers(14, n=300)
    built = index.build(rows(spark, x.tolist()), x[:6].copy(), 2)
    plan = lambda df: search.inverted_file(built, df, 2)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    many = spark.range(200_000).select(F.col("id").alias("query_id"), F.array(*(F.rand(i).cast("float") for i in range(6))).alias("vec"))
    assert plan(many) <= plan(spark.range(3).select(F.col("id").alias("query_id"), F.array(*(F.rand(i).cast("float") for i in range(6))).alias("vec"))) + 2
    assert search.inverted_file(built, many.limit(20_000), 2).count() == 100_000


def test_hot_lists_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 50)
    x = np.vstack([integers(15, n=200), np.tile([0.5] * 6, (400, 1))])
    built = index.build(rows(spark, x.tolist()), np.float32(x[[0, 1, 2, 300]]).astype(float), 4)
    asked = ask(spark, x[300].tolist(), x[5].tolist())
    quantised = lambda df: df.withColumn("vec", S.quantise_vector("vec"))
    assert in_order(search.pruned_file(built, asked, order=("id",))) == in_order(search.exact(quantised(rows(spark, x.tolist())), quantised(asked), 6))


def test_versions_of_an_index(spark, tmp_path, monkeypatch):
    """What a killed writer leaves isn't seen; appended rows are found; of two writers of a version one fails."""
    x, path = integers(16, n=120), f"{tmp_path}/versions"
    old, new = rows(spark, x[:80].tolist()), spark.createDataFrame([(1000 + i, [float(v) for v in x[80 + i]], 1) for i in range(40)], ROWS)
    index.build(old, x[:4].copy(), 4, path)
    asked = ask(spark, *x[78:84].tolist())
    first = in_order(search.inverted_file(index.load(spark, path), asked, 4))
    commit = index._commit
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.append(spark, path, new)
    assert in_order(search.inverted_file(index.load(spark, path), asked, 4)) == first
    monkeypatch.setattr(index, "_commit", commit)
    index.append(spark, path, new)
    both = index.load(spark, path)
    whole = index.build(old.union(new), x[:4].copy(), 4)
    assert in_order(search.inverted_file(both, asked, 4)) == in_order(search.inverted_file(whole, asked, 4)) != first
    assert sorted(map(tuple, both.clusters.select("cluster_id", "size", "offset", "low", "high").collect()), key=str) == sorted(map(tuple, whole.clusters.select("cluster_id", "size", "offset", "low", "high").collect()), key=str)
    with pytest.raises(ValueError, match="exists"):
        index._commit(spark, path, {"version": 2})
    with pytest.raises(ValueError, match="no committed index"):
        index.load(spark, f"{tmp_path}/nowhere")
    assert json.loads(open(f"{path}/meta/v-000000002.json").read())["count"] == 120


@pytest.mark.parametrize("way", ["all lists", "four lists", "bands"])
def test_large_lists_compare_no_more_pairs_a_query_as_rows_grow(spark, tmp_path, monkeypatch, way):
    """Lists and bands beyond what a task holds go in cells: with eight times the rows a query is compared with about as many as before; results are those of brute force, copies and ties included."""
    for name, value in (("PART_ROWS", 256), ("FEW_BANDS", 4)):
        monkeypatch.setattr(search, name, value)
    monkeypatch.setattr(search.cells, "CELL_ROWS", 128)
    quantised = lambda df: df.withColumn("vec", S.quantise_vector("vec"))
    each = []
    for n in (2000, 16000):
        x = skewed(n)
        x[: n // 8] = x[0]  # copies: more than a task holds
        frame = rows(spark, np.round(x, 2).tolist()).repartition(4)
        asked, compared = ask(spark, *np.round(x[:: n // 100], 2).tolist()), spark.sparkContext.accumulator(0)
        if way == "bands":
            search.save_bands(quantised(frame), f"{tmp_path}/{n}", 128)
            bands = search.load_bands(spark, f"{tmp_path}/{n}", quantised(frame).schema)
            got = in_order(search.band_join(bands, quantised(asked), compared=compared))
        else:
            built = index.build(frame, x[n // 2 : n // 2 + 8].copy(), 4)
            assert search._has_cells(built)
            probed = search.pruned_file(built, asked, order=("id",), compared=compared) if way == "all lists" else search.inverted_file(built, asked, 4, compared=compared)
            got = in_order(probed)
        each.append(compared.value / asked.count())
        if way == "four lists":
            probes = search.probe(asked, built, 4)
            far = quantised(asked).join(probes, "query_id").join(built.lists, "cluster_id").select("query_id", "probe_rank", "id", F.aggregate(F.zip_with("vec", "qvec", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v).alias("dist"))
            assert got == in_order(search.blocks.ranked(far, 5, ("probe_rank", "id")))
        else:
            assert got == in_order(search.exact(quantised(frame), quantised(asked), 14))
    assert each[1] < 2 * each[0], each


def test_cells_of_few_null_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 3)
    monkeypatch.setattr(search.cells, "CELL_ROWS", 1)
    held = spark.createDataFrame([(None, [0.5] * 3, 1), (4, None, 1), *((i, [0.5] * 3, 0) for i in range(9, 2, -1)), (1, [0.1, 0.2, 0.3], 0)], ROWS)
    built = index.build(held, np.array([[0.5] * 3, [9.0] * 3]), 2)  # the second list is empty
    asked = ask(spark, [0.5] * 3, [0.1, 0.2, 0.3], [-1.0] * 3)
    quantised = lambda df: df.withColumn("vec", S.quantise_vector("vec"))
    assert search._has_cells(built)
    truth = in_order(search.exact(quantised(held), quantised(asked), 3))
    assert in_order(search.pruned_file(built, asked, order=("id",))) == truth and in_order(search.inverted_file(built, asked, 2)) == truth

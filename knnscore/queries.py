"""The registered queries of the engine and their SQL, over whole tables.

Searches take every row whose vec_id is divisible by 100 as a query. The index of these queries has the
``CLUSTERS`` smallest ids as its centroids, so that SQL can build it too; ``kmeans_centroids`` fits real ones.
A neighbour counts as fraud if its label is 7 or more. Requests are made of events, a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .operators import blocks, features, index, kmeans, search, vote
from .session import shared_path, stored

DIMS, CLUSTERS, NPROBE, K = 64, 16, 4, 5
FITTED, FIT_ROUNDS, BAND_ROWS = 64, 5, 4096  # of the index and the bands of request vectors
FRAUD = "label >= 7"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _quantised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", S.quantise_vector("vec"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    rows = _rows(spark, sf_dir)
    return index.build(rows, kmeans.first_rows(rows, CLUSTERS), NPROBE)


def _exploded(df: DataFrame, key: str, column: str, value: str) -> DataFrame:
    return df.select(key, F.posexplode(column).alias("dim", value))


def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(_quantised(_rows(spark, sf_dir)), "id", "vec", "q").select(F.col("id").alias("vec_id"), "dim", F.col("q").cast("int").alias("q"))


def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _quantised(_rows(spark, sf_dir)).withColumn("vec", S.dequantise_vector(F.col("vec")))
    return _exploded(back, "id", "vec", "x").select(F.col("id").alias("vec_id"), "dim", F.round(F.col("x").cast("double"), 5).alias("value"))


def pair_l2sq_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.all_pairs(_quantised(_rows(spark, sf_dir)), _quantised(_queries(spark, sf_dir)), DIMS)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("dist").cast("long").alias("dist"))


def _ranks(found: DataFrame, whole: bool = True) -> DataFrame:
    dist = F.col("dist").cast("long") if whole else F.round("dist", 6)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), dist.alias("dist"))


def knn_exact_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(search.exact(_quantised(_rows(spark, sf_dir)), _quantised(_queries(spark, sf_dir)), DIMS))


def knn_exact_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(search.exact(_rows(spark, sf_dir), _queries(spark, sf_dir), DIMS), whole=False)


def knn_dim0_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quantised(_rows(spark, sf_dir)).withColumn("d0", F.col("vec")[0].cast("double"))
    return _ranks(search.first_dimension_pruned(rows, _quantised(_queries(spark, sf_dir)), DIMS, near=1.0))


def knn_dim0_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through files by bands of the first dimension: each query goes to its own band, then to those that its radius meets."""
    path, rows = shared_path(spark, "by-first-dimension"), _quantised(_rows(spark, sf_dir))
    search.save_bands(rows, path)
    return _ranks(search.band_join(search.load_bands(spark, path, rows.schema), _quantised(_queries(spark, sf_dir))))


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return index.assign(rows, kmeans.first_rows(rows, CLUSTERS)).select(F.col("id").alias("vec_id"), "cluster_id")


def ivf_sizes_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).clusters.select("cluster_id", "size", "offset")


def ivf_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _index(spark, sf_dir).clusters
    return sizes.agg(F.min("size").alias("min_size"), F.floor(F.sum("size") / F.count(F.lit(1))).alias("avg_size"), F.max("size").alias("max_size"))


def ivf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.layout(_index(spark, sf_dir).lists).select("cluster_id", "pos", F.col("id").alias("vec_id"))


def index_saved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of an index that was written and read again, with its checks."""
    path = shared_path(spark, "index")
    index.save(_index(spark, sf_dir), path)
    return index.layout(index.load(spark, path, DIMS).lists).select("cluster_id", "pos", F.col("id").alias("vec_id"), F.col("label").cast("long").alias("label"))


def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _index(spark, sf_dir).clusters.select("cluster_id", F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x"))
    return both.select("cluster_id", "dim", F.col("x.low").cast("int").alias("low"), F.col("x.high").cast("int").alias("high"))


def bbox_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.box_bounds(_index(spark, sf_dir), _quantised(_queries(spark, sf_dir)))


def bbox_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    kept = search.pruned_probes(_index(spark, sf_dir), queries.select("query_id", S.quantise_vector("vec").alias("vec"), F.col("vec").alias("raw")))
    return kept.groupBy("query_id").agg(F.max("radius").cast("long").alias("radius"), F.count(F.lit(1)).alias("n_clusters"))


def ivf_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.probe(_queries(spark, sf_dir), _index(spark, sf_dir), NPROBE)
    return found.select("query_id", "probe_rank", "cluster_id")


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists whose stored box is within the radius that the nearest list gives: no neighbour is lost. These vectors are spread evenly, so boxes rule out little and four lists find two thirds; see ``knn_requests`` for vectors that cluster."""
    return _ranks(search.pruned_file(_index(spark, sf_dir), _queries(spark, sf_dir)))


def knn_ivf_nprobe4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(search.inverted_file(_index(spark, sf_dir), _queries(spark, sf_dir), NPROBE))


def knn_ivf_nprobe1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(search.inverted_file(_index(spark, sf_dir), _queries(spark, sf_dir), 1))


def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact neighbours that the index finds, by nprobe; all lists find them all."""
    found, queries = _index(spark, sf_dir), _queries(spark, sf_dir)
    truth = search.exact(_quantised(_rows(spark, sf_dir)), _quantised(queries), DIMS).select("query_id", "id")
    out = None
    for nprobe in (1, NPROBE, CLUSTERS):
        hits = search.inverted_file(found, queries, nprobe).select("query_id", "id").withColumn("hit", F.lit(1))
        part = truth.join(hits, ["query_id", "id"], "left").agg(F.lit(nprobe).alias("nprobe"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
        out = part if out is None else out.union(part)
    return out


def kmeans_one_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    assigned = index.assign(rows, kmeans.first_rows(rows, CLUSTERS))
    return _exploded(kmeans.means(assigned, DIMS), "cluster_id", "mean", "x").select("cluster_id", "dim", F.round("x", 6).alias("mean"))


def kmeans_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return kmeans.mass(rows, kmeans.first_rows(rows, CLUSTERS)).select(F.round("total", 5).alias("total"))


def kmeans_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds by k-means++, twenty rounds; no SQL, tests compare with NumPy."""
    rows = _rows(spark, sf_dir)
    centroids, _ = kmeans.fit(rows, kmeans.spread_seeds(rows, CLUSTERS))
    return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    found = search.exact(_quantised(_rows(spark, sf_dir)), _quantised(queries), DIMS, carry=("label",))
    return vote.fraud_count(queries, found, FRAUD)


def fraud_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def fraud_count_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes of the nearest rows by floats."""
    queries = _queries(spark, sf_dir)
    return vote.fraud_count(queries, search.exact(_rows(spark, sf_dir), queries, DIMS, carry=("label",)), FRAUD)


def fraud_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.decide(_counts(spark, sf_dir)).select("query_id", "fraud_score")


def decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.decide(_counts(spark, sf_dir))


def decision_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir)
    return vote.decide(vote.fraud_count(queries, search.pruned_file(_index(spark, sf_dir), queries), FRAUD))


def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vote.response(vote.decide(_counts(spark, sf_dir)))


def _spread(df: DataFrame) -> DataFrame:
    """A table of fewer parts than there are cores is dealt out, as parsing costs much more than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, body: a request of each event (an adapter of the test tables, not part of the engine)."""
    e = _spread(_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    mcc = F.create_map(*(F.lit(x) for pair in (("click", "5411"), ("view", "5812"), ("purchase", "7995"), ("signup", "4511"), ("error", "0000")) for x in pair))
    last = F.struct(
        F.date_format(F.col("ts") - F.make_dt_interval(mins=F.col("k") * 20), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        (F.col("k") * 15).cast("double").alias("km_from_current"),
    )
    body = F.struct(
        F.struct(F.col("value").alias("amount"), (F.col("k") % 15).alias("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct((F.col("user_id") % 7 * 5.5).alias("avg_amount"), (F.col("k") % 25).alias("tx_count_24h"), F.array(F.lit("M1"), F.lit("M2"), F.lit("M3")).alias("known_merchants")).alias("customer"),
        F.struct(F.concat(F.lit("M"), F.col("user_id") % 5).alias("id"), mcc[F.col("event_type")].alias("mcc"), (F.col("value") * 30).alias("avg_amount")).alias("merchant"),
        F.struct((F.col("k") % 2 == 0).alias("is_online"), (F.col("k") % 3 == 0).alias("card_present"), (F.col("k") * 12.5).alias("km_from_home")).alias("terminal"),
        F.when(F.col("k") % 4 != 0, last).alias("last_transaction"),
    )
    return e.select(F.col("event_id").alias("query_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


def iso_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("request.transaction.requested_at")
    parsed = features.parse(requests(spark, sf_dir))
    return parsed.select(F.col("query_id").alias("event_id"), S.hour_of(at).alias("hour"), S.weekday_of(at).alias("weekday"))


def epoch_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", S.epoch_minutes(F.col("ts")).alias("minutes"))


def mcc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = features.parse(requests(spark, sf_dir))
    return parsed.select(F.col("query_id").alias("event_id"), F.round(S.mcc_risk(F.col("request.merchant.mcc")).cast("double"), 6).alias("risk"))


def merchant_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("request")
    known = F.array_contains(r["customer"]["known_merchants"], r["merchant"]["id"])
    return features.parse(requests(spark, sf_dir)).select(F.col("query_id").alias("event_id"), known.alias("known"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = features.vectorise(features.parse(requests(spark, sf_dir)))
    both = vectors.select("query_id", F.posexplode(F.arrays_zip("vec", S.quantise_vector("vec").alias("q"))).alias("dim", "x"))
    return both.select(F.col("query_id").alias("event_id"), "dim", F.round(F.col("x.vec").cast("double"), 5).alias("value"), F.col("x.q").cast("int").alias("q"))


def _request_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label of each event's request; those of a tenth of a limit and more are fraud."""
    found = features.vectorise(features.parse(requests(spark, sf_dir))).where("status = 200")
    return found.select(F.col("query_id").alias("id"), "vec", F.when(F.col("vec")[0] >= 0.01, 1).otherwise(0).cast("tinyint").alias("label"))


def _asked_of(rows: DataFrame) -> DataFrame:
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vec")


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, index.Index]:
    """The request vectors, written once, and an index that k-means was fitted for, saved and loaded."""
    rows, path = stored(_request_vectors(spark, sf_dir), "request-vectors"), shared_path(spark, "fitted-index")
    _, before = kmeans.fit(rows, kmeans.spread_seeds(rows, FITTED, passes=2), FIT_ROUNDS)
    index.build(rows, before, NPROBE, path)
    return rows, index.load(spark, path, features.DIMS)


def _event_ranks(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", F.col("id").alias("event_id"), F.col("dist").cast("long").alias("dist"))


def knn_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of requests through a fitted, saved index: of the lists after the nearest, those whose stored box is within the radius are read."""
    rows, found = _fitted(spark, sf_dir)
    return _event_ranks(search.pruned_file(found, _asked_of(rows), order=("id",)))


def knn_requests_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact neighbours of requests by bands of their first dimension."""
    rows, path = stored(_quantised(_request_vectors(spark, sf_dir)), "request-vectors"), shared_path(spark, "request-bands")
    search.save_bands(rows, path, BAND_ROWS)
    return _event_ranks(search.band_join(search.load_bands(spark, path, rows.schema), _asked_of(rows)))


def knn_requests_nprobe4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of requests in the nearest four of the fitted index's lists; tests hold their recall (0.9 and more) against brute force."""
    rows, found = _fitted(spark, sf_dir)
    return _event_ranks(search.inverted_file(found, _asked_of(rows), NPROBE))


def requests_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact neighbours' distances that four lists of the fitted index reach: a row no farther than the true one counts as found. The exact search goes through all lists and leaves out only what is beyond a radius; tests compare it with brute force."""
    rows, found = _fitted(spark, sf_dir)
    truth = stored(search.pruned_file(found, _asked_of(rows), order=("id",)), "true-neighbours").groupBy("query_id").agg(F.max("dist").alias("worst"), F.count(F.lit(1)).alias("n"))
    got = search.inverted_file(found, _asked_of(rows), NPROBE).join(truth, "query_id").where("dist <= worst")
    return got.agg(F.count(F.lit(1)).alias("hits")).crossJoin(truth.agg(F.sum("n").alias("n"))).select(F.lit(NPROBE).alias("nprobe"), (F.col("hits") / F.col("n")).alias("recall"))


def kmeans_two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids after two rounds from the smallest ids."""
    rows = _rows(spark, sf_dir)
    centroids, _ = kmeans.fit(rows, kmeans.first_rows(rows, CLUSTERS), 2)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster_id int, mean array<double>")
    return _exploded(table, "cluster_id", "mean", "x").select("cluster_id", "dim", (F.round("x", 5) + 0.0).alias("mean"))


def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against an index of their own vectors: those of a tenth of a limit and more are fraud."""
    from .plans.scoring import score

    raw = requests(spark, sf_dir)
    rows = stored(_request_vectors(spark, sf_dir), "request-vectors")  # parsed once, for the seeds and the lists
    found = index.build(rows, kmeans.first_rows(rows, CLUSTERS), NPROBE)
    asked = raw.where("query_id % 100 = 0")
    answered = score(asked, found)
    body = F.from_json("body", "approved boolean, fraud_score double")
    return answered.select("query_id", "status", body["approved"].alias("approved"), body["fraud_score"].alias("fraud_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quantize_int8, dequantize, pair_l2sq_int8, knn_exact_int8, knn_exact_float, knn_dim0_pruned, knn_dim0_store, ivf_assign, ivf_sizes_offsets, ivf_size_stats, ivf_layout, index_saved_lists,
        cluster_bbox, bbox_lower_bound, bbox_pruning, ivf_probe, knn_ivf, knn_ivf_nprobe4, knn_ivf_nprobe1, ivf_recall, kmeans_one_step, kmeans_mass, kmeans_centroids, fraud_count, fraud_count_float,
        fraud_score, decision, decision_ivf, response_json, iso_parts, epoch_minutes, mcc_risk, merchant_known, feature_vector, score_requests,
        knn_requests, knn_requests_bands, knn_requests_nprobe4, requests_recall, kmeans_two_rounds,
    )
}

_Q8 = """q8 AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: CAST(greatest(-127, least(127,
  trunc(x * 127::FLOAT + CASE WHEN x >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END))) AS INTEGER)) AS v FROM embeddings)"""
_D8 = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))"
_DF = "list_sum(list_transform(range(1, 65), lambda i: (a.{0}[i]::DOUBLE - b.{1}[i]::DOUBLE) * (a.{0}[i]::DOUBLE - b.{1}[i]::DOUBLE)))"
_PAIRS = f"{_Q8}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, CAST({_D8} AS BIGINT) AS dist FROM q8 a, q8 b WHERE a.vec_id % 100 = 0)"
_NEAR = f"{_PAIRS}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5)"
_CENT = "cent AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster_id, embedding AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16))"
_ASSIGN = f"""{_Q8}, {_CENT}, assigned AS (SELECT vec_id, arg_min(cluster_id, dist) AS cluster_id FROM (
  SELECT a.vec_id, b.cluster_id, {_DF.format("embedding", "c")} AS dist FROM q8 a, cent b ORDER BY a.vec_id, b.cluster_id) GROUP BY vec_id),
lists AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS pos, vec_id, v, label FROM assigned JOIN q8 USING (vec_id)),
sizes AS (SELECT cluster_id, count(vec_id) AS size FROM cent LEFT JOIN assigned USING (cluster_id) GROUP BY cluster_id),
box AS (SELECT cluster_id, i - 1 AS dim, min(v[i]) AS low, max(v[i]) AS high FROM lists, range(1, 65) t(i) GROUP BY cluster_id, i),
bound AS (SELECT a.vec_id AS query_id, cluster_id, CAST(sum(greatest(low - a.v[dim + 1], 0, a.v[dim + 1] - high) ** 2) AS BIGINT) AS bound
  FROM q8 a, box WHERE a.vec_id % 100 = 0 GROUP BY ALL),
probe AS (SELECT query_id, cluster_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, cluster_id) AS probe_rank FROM (
  SELECT a.vec_id AS query_id, b.cluster_id, {_DF.format("embedding", "c")} AS dist FROM q8 a, cent b WHERE a.vec_id % 100 = 0)),
scanned AS (SELECT query_id, probe_rank, pos, b.vec_id, b.label, CAST({_D8} AS BIGINT) AS dist FROM probe JOIN q8 a ON a.vec_id = query_id JOIN lists b USING (cluster_id))"""
_IVF = "SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, pos) AS rank, vec_id, dist, label FROM scanned WHERE probe_rank <= {}) WHERE rank <= 5"
_COUNT = f"WITH {_NEAR}, counts AS (SELECT query_id, count(*) FILTER (label >= 7) AS fraud_count FROM near GROUP BY query_id)"
_REQ = """req AS (SELECT event_id, date_trunc('second', ts) AS t0, CAST(props->>'$.k' AS INTEGER) AS k, value, user_id, event_type FROM events)"""
_FEATURES = f"""{_REQ}, f AS (SELECT event_id,
  least(greatest(value::FLOAT / 10000::FLOAT, 0), 1)::FLOAT AS d0, least((k % 15)::FLOAT / 12::FLOAT, 1)::FLOAT AS d1,
  CASE WHEN user_id % 7 = 0 THEN 0 ELSE least((value::FLOAT / (user_id % 7 * 5.5)::FLOAT) / 10::FLOAT, 1) END::FLOAT AS d2,
  (hour(t0)::FLOAT / 23::FLOAT)::FLOAT AS d3, ((isodow(t0) - 1)::FLOAT / 6::FLOAT)::FLOAT AS d4,
  CASE WHEN k % 4 = 0 THEN -1 ELSE least((k * 20)::FLOAT / 1440::FLOAT, 1) END::FLOAT AS d5,
  CASE WHEN k % 4 = 0 THEN -1 ELSE least((k * 15)::FLOAT / 1000::FLOAT, 1) END::FLOAT AS d6,
  least((k * 12.5)::FLOAT / 1000::FLOAT, 1)::FLOAT AS d7, least((k % 25)::FLOAT / 20::FLOAT, 1)::FLOAT AS d8,
  (k % 2 = 0)::INTEGER::FLOAT AS d9, (k % 3 = 0)::INTEGER::FLOAT AS d10, (user_id % 5 NOT IN (1, 2, 3))::INTEGER::FLOAT AS d11,
  CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.85 WHEN 'signup' THEN 0.35 ELSE 0.5 END::FLOAT AS d12,
  least((value * 30)::FLOAT / 10000::FLOAT, 1)::FLOAT AS d13 FROM req),
vectors AS (SELECT event_id, [d0, d1, d2, d3, d4, d5, d6, d7, d8, d9, d10, d11, d12, d13] AS vec FROM f)"""

_REQUEST_PAIRS = f"""{_FEATURES}, q14 AS (SELECT event_id, vec, list_transform(vec, lambda x: CAST(greatest(-127, least(127,
  trunc(x * 127::FLOAT + CASE WHEN x >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END))) AS INTEGER)) AS v FROM vectors)"""
_D14 = "CAST(" + " + ".join(f"(a.v[{i}] - b.v[{i}]) * (a.v[{i}] - b.v[{i}])" for i in range(1, 15)) + " AS BIGINT)"
_F14 = "(" + " + ".join(f"(a.vec[{i}]::DOUBLE - c[{i}]::DOUBLE) * (a.vec[{i}]::DOUBLE - c[{i}]::DOUBLE)" for i in range(1, 15)) + ")"
_REQUEST_NEAR = f"""WITH {_REQUEST_PAIRS} SELECT query_id, CAST(rank AS INTEGER) AS rank, event_id, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, event_id) AS rank FROM (SELECT a.event_id AS query_id, b.event_id, {_D14} AS dist FROM q14 a, q14 b WHERE a.event_id % 100 = 0)) WHERE rank <= 5"""


def _round_sql(number: int) -> str:
    """CTE of the centroids after a round: assign to those before, average, as 32-bit floats; a cluster without rows keeps its centroid."""
    last = f"cent{number - 1}"
    return f"""near{number} AS (SELECT vec_id, arg_min(cluster_id, dist) AS cluster_id FROM (
  SELECT a.vec_id, b.cluster_id, {_DF.format("embedding", "c")} AS dist FROM embeddings a, {last} b ORDER BY a.vec_id, b.cluster_id) GROUP BY vec_id),
mean{number} AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(embedding[i]::DOUBLE)::FLOAT AS m FROM near{number} JOIN embeddings USING (vec_id), range(1, 65) t(i) GROUP BY cluster_id, i) GROUP BY cluster_id),
cent{number} AS (SELECT b.cluster_id, coalesce(m.c, b.c) AS c FROM {last} b LEFT JOIN mean{number} m USING (cluster_id))"""


SQL = {
    "knn_requests": _REQUEST_NEAR,
    "knn_requests_bands": _REQUEST_NEAR,
    "kmeans_two_rounds": f"""WITH {_CENT.replace("cent AS", "cent0 AS", 1)}, {_round_sql(1)}, {_round_sql(2)}
SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(c[i]::DOUBLE, 5) + 0.0::DOUBLE AS mean FROM cent2, range(1, 65) t(i)""",
    "score_requests": f"""WITH {_REQUEST_PAIRS}, cent AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS cluster_id, vec AS c FROM (SELECT * FROM q14 ORDER BY event_id LIMIT 16)),
away AS (SELECT event_id, cluster_id, {_F14} AS dist FROM q14 a, cent),
assigned AS (SELECT event_id, arg_min(cluster_id, dist) AS cluster_id FROM (SELECT * FROM away ORDER BY event_id, cluster_id) GROUP BY event_id),
probe AS (SELECT event_id AS query_id, cluster_id, row_number() OVER (PARTITION BY event_id ORDER BY dist, cluster_id) AS probe_rank FROM away WHERE event_id % 100 = 0),
scanned AS (SELECT p.query_id, p.probe_rank, b.event_id, b.vec[1]::DOUBLE >= 0.01::DOUBLE AS fraud, {_D14} AS dist
  FROM probe p JOIN q14 a ON a.event_id = p.query_id JOIN assigned l ON l.cluster_id = p.cluster_id JOIN q14 b ON b.event_id = l.event_id WHERE p.probe_rank <= 4),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, event_id) AS rank FROM scanned) WHERE rank <= 5)
SELECT query_id, 200 AS status, count(*) FILTER (fraud) < 3 AS approved, count(*) FILTER (fraud) / 5 AS fraud_score FROM near GROUP BY query_id""",
    "quantize_int8": f"WITH {_Q8} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, v[i] AS q FROM q8, range(1, 65) t(i)",
    "dequantize": f"WITH {_Q8} SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, round((v[i]::FLOAT / 127::FLOAT)::FLOAT::DOUBLE, 5) AS value FROM q8, range(1, 65) t(i)",
    "pair_l2sq_int8": f"WITH {_PAIRS} SELECT query_id, vec_id, dist FROM pairs",
    "knn_exact_int8": f"WITH {_NEAR} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM near",
    "knn_dim0_pruned": f"WITH {_NEAR} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM near",
    "knn_exact_float": f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {_DF.format("embedding", "embedding")} AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5""",
    "knn_dim0_store": f"WITH {_NEAR} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM near",
    "index_saved_lists": f"WITH {_ASSIGN} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(pos AS INTEGER) AS pos, vec_id, CAST(label AS BIGINT) AS label FROM lists",
    "fraud_count_float": f"""SELECT query_id, count(*) FILTER (label >= 7) AS fraud_count FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, b.label, {_DF.format("embedding", "embedding")} AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5 GROUP BY query_id""",
    "ivf_assign": f"WITH {_ASSIGN} SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id FROM assigned",
    "ivf_sizes_offsets": f"""WITH {_ASSIGN} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, size,
  CAST(coalesce(sum(size) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sizes""",
    "ivf_size_stats": f"WITH {_ASSIGN} SELECT min(size) AS min_size, CAST(floor(sum(size) / count(*)) AS BIGINT) AS avg_size, max(size) AS max_size FROM sizes",
    "ivf_layout": f"WITH {_ASSIGN} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(pos AS INTEGER) AS pos, vec_id FROM lists",
    "cluster_bbox": f"WITH {_ASSIGN} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(i - 1 AS INTEGER) AS dim, coalesce(low, 127) AS low, coalesce(high, -127) AS high FROM (SELECT cluster_id, i FROM cent, range(1, 65) t(i)) LEFT JOIN (SELECT cluster_id, dim + 1 AS i, low, high FROM box) USING (cluster_id, i)",
    "bbox_lower_bound": f"WITH {_ASSIGN} SELECT query_id, CAST(cluster_id AS INTEGER) AS cluster_id, bound FROM bound",
    "bbox_pruning": f"""WITH {_ASSIGN}, near AS ({_IVF.format(1)}), radius AS (SELECT query_id, CASE WHEN count(*) >= 5 THEN max(dist) END AS radius FROM near GROUP BY query_id)
SELECT query_id, radius, count(*) AS n_clusters FROM radius JOIN bound USING (query_id) WHERE bound <= coalesce(radius, 1e18) GROUP BY query_id, radius""",
    "ivf_probe": f"WITH {_ASSIGN} SELECT query_id, CAST(probe_rank AS INTEGER) AS probe_rank, CAST(cluster_id AS INTEGER) AS cluster_id FROM probe WHERE probe_rank <= 4",
    "knn_ivf": f"WITH {_ASSIGN} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM ({_IVF.format(16)})",
    "knn_ivf_nprobe4": f"WITH {_ASSIGN} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM ({_IVF.format(4)})",
    "knn_ivf_nprobe1": f"WITH {_ASSIGN} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, dist FROM ({_IVF.format(1)})",
    "ivf_recall": "WITH " + _ASSIGN + ", " + _PAIRS.split("), ", 1)[1].replace("pairs AS", "pairs AS", 1) + """, truth AS (SELECT query_id, vec_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 5)
""" + " UNION ALL ".join(f"SELECT {n} AS nprobe, round(count(x.vec_id) / count(*), 6) AS recall FROM truth LEFT JOIN ({_IVF.format(n)}) x USING (query_id, vec_id)" for n in (1, 4, 16)),
    "kmeans_one_step": f"WITH {_ASSIGN} SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM assigned JOIN embeddings USING (vec_id), range(1, 65) t(i) GROUP BY cluster_id, i",
    "kmeans_mass": f"WITH {_CENT} SELECT round(sum(least_dist), 5) AS total FROM (SELECT vec_id, min({_DF.format('embedding', 'c')}) AS least_dist FROM embeddings a, cent b GROUP BY vec_id)",
    "fraud_count": f"{_COUNT} SELECT query_id, fraud_count FROM counts",
    "fraud_score": f"{_COUNT} SELECT query_id, fraud_count / 5 AS fraud_score FROM counts",
    "decision": f"{_COUNT} SELECT query_id, fraud_count, fraud_count / 5 AS fraud_score, fraud_count < 3 AS approved FROM counts",
    "decision_ivf": f"WITH {_ASSIGN} SELECT query_id, count(*) FILTER (label >= 7) AS fraud_count, count(*) FILTER (label >= 7) / 5 AS fraud_score, count(*) FILTER (label >= 7) < 3 AS approved FROM ({_IVF.format(16)}) GROUP BY query_id",
    "response_json": f"""{_COUNT} SELECT query_id, '{{"approved":' || (fraud_count < 3) || ',"fraud_score":' || (fraud_count / 5) || '}}' AS body FROM counts""",
    "iso_parts": "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events",
    "epoch_minutes": "SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minutes FROM events",
    "mcc_risk": f"WITH {_FEATURES} SELECT event_id, round(d12::DOUBLE, 6) AS risk FROM f",
    "merchant_known": "SELECT event_id, user_id % 5 IN (1, 2, 3) AS known FROM events",
    "feature_vector": f"""WITH {_FEATURES} SELECT event_id, CAST(i - 1 AS INTEGER) AS dim, round(vec[i]::DOUBLE, 5) AS value,
  CAST(greatest(-127, least(127, trunc(vec[i] * 127::FLOAT + CASE WHEN vec[i] >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END))) AS INTEGER) AS q FROM vectors, range(1, 15) t(i)""",
}

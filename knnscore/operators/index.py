"""The inverted-file index: assignment to centroids, lists, sizes, offsets, boxes; as Parquet in committed versions.

At an index's path are folders of rows by list, of statistics by cluster, and ``meta`` with a file for each version, which names the
folders that belong to it. A version is there once its file is; what a killed writer leaves is named by none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.scalar import QUANTUM, quantise_vector
from ..session import ranked, shared_path
from .blocks import PAIRS_AT_ONCE, matrix

CENTROID_BYTES = 256 << 20  # bound of what is broadcast
NPROBE, CLUSTERS = 4, 1024
SALTS = 16  # parts of a list that are written by different tasks
CLUSTER_ROWS = "cluster_id int, centroid array<double>, size long, offset long, low array<tinyint>, high array<tinyint>"


@dataclass
class Held:
    """Of each cluster its centroid, its size and its box."""

    centroids: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Index:
    """lists: cluster_id, id, qvec, label (a list's order is that of ids). clusters: cluster_id, centroid, size, offset, low, high (of quantised values). Both are written files."""

    lists: DataFrame
    clusters: DataFrame
    dims: int
    n_clusters: int
    nprobe: int = NPROBE
    _held: Held | None = None
    _cells: dict = field(default_factory=dict)  # by k, of large lists, for searches of this session

    def held(self) -> Held:
        """The clusters as arrays, under a checked bound."""
        if self._held is None:
            if self.n_clusters * self.dims * 8 > CENTROID_BYTES:
                raise ValueError("the centroids are too large to broadcast")
            found = self.clusters.orderBy("cluster_id").select("centroid", "size", "low", "high").collect()
            arrays = ((c, kind) for c, kind in (("centroid", float), ("size", np.int64), ("low", float), ("high", float)))
            self._held = Held(*(np.array([r[c] for r in found], kind) for c, kind in arrays))
        return self._held

    def centroids(self) -> np.ndarray:
        return self.held().centroids

    def check_nprobe(self, nprobe: int) -> None:
        if not 1 <= nprobe <= self.n_clusters:
            raise ValueError(f"nprobe {nprobe} isn't between 1 and {self.n_clusters}")


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_id: the nearest centroid of vec, of equals the first; null for a null vector. No shuffle."""
    if not len(centroids):
        raise ValueError("there are no centroids")
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError("the centroids are too large to broadcast")
    sent = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = rows.drop("cluster_id").schema.add("cluster_id", IntegerType())
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = sent.value
        step = max(1, PAIRS_AT_ONCE // len(means))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                there = batch.column("vec").is_valid().to_numpy(zero_copy_only=False)
                nearest = np.zeros(batch.num_rows, np.int32)
                if there.any():
                    data = matrix(batch.column("vec").drop_null())
                    nearest[there] = ((means * means).sum(axis=1) - 2 * data @ means.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(nearest, mask=~there)], names=[*names, "cluster_id"])

    return rows.select(*names).mapInArrow(run, schema)


def layout(assigned: DataFrame) -> DataFrame:
    """Adds pos: the place in the list, by id. A counting sort: rows are dealt by ranges of (list, id), counted by task and list, and placed by the sums of the counts before."""
    return ranked(assigned, "cluster_id", F.col("id"), name="layout").withColumn("pos", (F.col("rank") - 1).cast("int")).drop("rank")


def statistics(lists: DataFrame, n_clusters: int, dims: int) -> list[tuple[int, list[int], list[int]]]:
    """size, low, high of every cluster, in one pass over the lists; an empty one has a box that holds nothing. Tasks send a row a list and dimension; a row a list, of the size of its centroid, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, low, high = np.zeros(n_clusters, np.int64), np.full((n_clusters, dims), QUANTUM), np.full((n_clusters, dims), -QUANTUM)
        for batch in batches:
            if batch.num_rows:
                data, at = matrix(batch.column("qvec")).astype(np.int64), batch.column("cluster_id").to_numpy()
                np.add.at(size, at, 1)
                np.minimum.at(low, at, data)
                np.maximum.at(high, at, data)
        own = np.flatnonzero(size)
        cluster, dim = np.repeat(own, dims), np.tile(np.arange(dims), len(own))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, dim, np.repeat(size[own], dims), low[own].reshape(-1), high[own].reshape(-1))], names=["cluster_id", "dim", "n", "low", "high"])

    parts = lists.select("cluster_id", "qvec").mapInArrow(run, "cluster_id long, dim long, n long, low long, high long")
    by_dim = parts.groupBy("cluster_id", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = by_dim.groupBy("cluster_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("box")).collect()
    out = [(0, [QUANTUM] * dims, [-QUANTUM] * dims) for _ in range(n_clusters)]
    for r in found:
        out[r["cluster_id"]] = r["n"], [x["low"] for x in r["box"]], [x["high"] for x in r["box"]]
    return out


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _latest(spark: SparkSession, path: str) -> dict:
    """The metadata of the newest version that was committed."""
    files, at = _files(spark, path)
    folder = at(f"{path}/meta")
    names = sorted(x.getPath().getName() for x in files.listStatus(folder) if x.getPath().getName().startswith("v-")) if files.exists(folder) else []
    if not names:
        raise ValueError(f"there is no committed index at {path}")
    return json.loads(spark.read.text(f"{path}/meta/{names[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, meta: dict) -> None:
    """Makes a version visible: its metadata are written aside and renamed last. A version that exists is never replaced, so of two writers one fails."""
    files, at = _files(spark, path)
    aside, final = at(f"{path}/meta/.{uuid.uuid4().hex}"), at(f"{path}/meta/v-{meta['version']:09d}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise ValueError(f"version {meta['version']} of the index at {path} exists")


def _write_lists(lists: DataFrame, path: str) -> str:
    """Writes rows by list in a new folder, a list by several tasks; its name."""
    name = f"rows-{uuid.uuid4().hex}"
    dealt = lists.select("cluster_id", "id", "qvec", "label").repartition("cluster_id", F.expr(f"pmod(xxhash64(id), {SALTS})")).sortWithinPartitions("cluster_id", "id")
    dealt.write.partitionBy("cluster_id").parquet(f"{path}/{name}")
    return name


def _read_lists(spark: SparkSession, path: str, names: list[str], schema: StructType) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.read.schema(schema).parquet(f"{path}/{n}").select("cluster_id", "id", "qvec", "label") for n in names))


def _add_version(spark: SparkSession, path: str, meta: dict, centroids: np.ndarray, found: list[tuple[int, list[int], list[int]]]) -> Index:
    """Writes the statistics, then the metadata that name them."""
    sizes = [n for n, _, _ in found]
    meta = meta | {"statistics": f"clusters-{uuid.uuid4().hex}", "count": sum(sizes)}
    rows = [(i, c.tolist(), n, at, low, high) for i, (c, (n, low, high), at) in enumerate(zip(centroids, found, accumulate([0, *sizes]), strict=False))]
    spark.createDataFrame(rows, CLUSTER_ROWS).coalesce(1).write.parquet(f"{path}/{meta['statistics']}")
    _commit(spark, path, meta)
    index = _open(spark, path, meta)
    index._held = Held(np.asarray(centroids, float), np.array(sizes), *(np.array([x[i] for x in found], float) for i in (1, 2)))
    return index


def _open(spark: SparkSession, path: str, meta: dict) -> Index:
    schema = StructType.fromJson(meta["schema"])
    return Index(_read_lists(spark, path, meta["rows"], schema), spark.read.schema(CLUSTER_ROWS).parquet(f"{path}/{meta['statistics']}"), meta["dims"], meta["clusters"], meta["nprobe"])


def write(lists: DataFrame, centroids: np.ndarray, path: str, nprobe: int = NPROBE) -> Index:
    """A new index: rows (cluster_id, id, qvec, label) by list, then sizes and boxes from the written rows, then the metadata, by which it is there."""
    spark, kinds = lists.sparkSession, lists.schema
    schema = StructType([*(kinds[c] for c in ("id", "qvec", "label")), StructField("cluster_id", IntegerType())])
    rows, (n, dims) = [_write_lists(lists, path)], centroids.shape
    meta = {"version": 1, "dims": dims, "clusters": n, "nprobe": nprobe, "rows": rows, "schema": json.loads(schema.json())}
    return _add_version(spark, path, meta, centroids, statistics(_read_lists(spark, path, rows, schema), n, dims))


def build(rows: DataFrame, centroids: np.ndarray, nprobe: int = NPROBE, path: str | None = None) -> Index:
    """rows: id, vec (floats), label. Rows are assigned once, and written to path (else to the shared folder)."""
    if not 1 <= nprobe <= len(centroids):
        raise ValueError(f"nprobe {nprobe} isn't between 1 and {len(centroids)}")
    assigned = assign(rows.where("vec IS NOT NULL"), centroids).withColumn("qvec", quantise_vector("vec"))
    return write(assigned, centroids, path or shared_path(rows.sparkSession, "index"), nprobe)


def save(index: Index, path: str) -> None:
    """Writes an index to another place."""
    write(index.lists, index.centroids(), path, index.nprobe)


def append(spark: SparkSession, path: str, rows: DataFrame) -> Index:
    """Adds rows (id, vec, label) to the lists of the index at path, whose centroids stay: a new version, which readers see once it is whole."""
    meta = _latest(spark, path)
    old = _open(spark, path, meta)
    assigned = assign(rows.where("vec IS NOT NULL"), old.centroids()).withColumn("qvec", quantise_vector("vec"))
    name = _write_lists(assigned, path)
    more = statistics(_read_lists(spark, path, [name], StructType.fromJson(meta["schema"])), old.n_clusters, old.dims)
    held = old.held()
    both = [(n + m, np.minimum(low, a).astype(int).tolist(), np.maximum(high, b).astype(int).tolist()) for n, low, high, (m, a, b) in zip(held.sizes.tolist(), held.low, held.high, more, strict=True)]
    return _add_version(spark, path, meta | {"version": meta["version"] + 1, "rows": [*meta["rows"], name]}, old.centroids(), both)


def load(spark: SparkSession, path: str, dims: int | None = None) -> Index:
    """The newest version at path. Raises ValueError where there is none or the metadata don't fit."""
    meta = _latest(spark, path)
    if meta["count"] <= 0 or meta["clusters"] <= 0 or (dims is not None and meta["dims"] != dims):
        raise ValueError(f"unfit index metadata: {meta}")
    index = _open(spark, path, meta)
    index.check_nprobe(index.nprobe)
    return index

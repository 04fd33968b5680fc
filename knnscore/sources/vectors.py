"""Sources of labelled vectors: JSON (also gzipped), and the older binary files of quantised vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: The mark of binary files and the layouts that are read.
MAGIC = 0x52494E48
FLOATS, LISTED, ORDERED, BLOCKED = 2, 3, 4, 5
LANES = 8
RANGE_ROWS, PIECE = 262_144, 1 << 20  # rows of a task, and ids that are read at once


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """vec, label, broken of the {"vector", "label"} objects of JSON arrays, label 1 where its text begins with f.

    A record ends at its brace, so plain files are cut into ranges that tasks read apart, arrays of one line too; what follows the last record isn't one.
    A compressed file is one task's. broken: what doesn't parse or has no vector.
    """
    text = spark.read.text(path, lineSep="}").where("instr(value, '{') > 0")
    record = F.from_json(F.concat(F.expr("substring(value, instr(value, '{'))"), F.lit("}")), "vector array<float>, label string")
    rows = text.select(record.alias("r")).select("r.vector", "r.label")
    return rows.select(F.col("vector").alias("vec"), F.when(F.col("label").startswith("f"), 1).otherwise(0).cast("tinyint").alias("label"), F.col("vector").isNull().alias("broken"))


def read_json(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """vec, label of the records that aren't broken. partitions: deals the rows of compressed files out for what follows."""
    rows = json_records(spark, path).where("NOT broken").drop("broken")
    return rows.repartition(partitions) if partitions else rows


def header(data: memoryview, dims: int | None) -> tuple[int, int, int, int, int, int]:
    """version, count, dims, clusters, nprobe, size of the header; ValueError where it doesn't fit."""
    if len(data) < 16:
        raise ValueError("the file ends in its header")
    magic, version, count, width = struct.unpack_from("<4i", data)
    if magic != MAGIC:
        raise ValueError(f"bad magic: {magic:#x}")
    if count <= 0 or width <= 0 or (dims is not None and width != dims):
        raise ValueError(f"bad count or dims: {count}, {width}")
    if version == FLOATS:
        return version, count, width, 0, 0, 16
    if version not in (LISTED, ORDERED, BLOCKED):
        raise ValueError(f"unsupported version: {version}")
    return version, count, width, *struct.unpack_from("<2i", data, 16), 32


def unblocked(flat: np.ndarray, sizes: np.ndarray, dims: int) -> np.ndarray:
    """Rows of vectors that stand in column-major blocks of eight within each cluster, the rest row by row."""
    parts, at = [], 0
    for size in sizes.tolist():
        whole = size // LANES * LANES
        block = flat[at * dims : (at + whole) * dims].reshape(-1, dims, LANES)
        parts += [block.transpose(0, 2, 1).reshape(-1, dims), flat[(at + whole) * dims : (at + size) * dims].reshape(-1, dims)]
        at += size
    return np.concatenate(parts) if parts else flat.reshape(-1, dims)


@dataclass
class Layout:
    """What the header and the sizes of a file say: where its sections begin, and its clusters."""

    path: str
    version: int
    count: int
    dims: int
    start: int
    sizes: np.ndarray

    @property
    def width(self) -> int:
        return self.dims * (4 if self.version == FLOATS else 1)

    @property
    def labels(self) -> int:
        return self.start + self.count * self.width

    @property
    def centroids(self) -> int:
        return self.labels + self.count

    @property
    def order(self) -> int:
        return self.centroids + len(self.sizes) * (4 * self.dims + 4)

    def cuts(self, each: int) -> list[tuple[int, int]]:
        """Ranges of about ``each`` rows that can be decoded alone: a cluster's blocks of eight columns aren't cut."""
        if self.version != BLOCKED:
            return [(a, min(a + each, self.count)) for a in range(0, self.count, each)]
        ends, out = np.cumsum(self.sizes), [0]
        while out[-1] < self.count:
            at = out[-1] + max(LANES, each)
            if at < self.count:
                c = int(np.searchsorted(ends, at, "right"))
                first = int(ends[c] - self.sizes[c])
                at = max(first, first + (at - first) // LANES * LANES)
                at = at if at > out[-1] else int(ends[c])
            out.append(min(at, self.count))
        return list(zip(out, out[1:], strict=False))


def _file(path: str):
    """An opened file of any store that Arrow knows."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _paths(path: str) -> list[str]:
    """A file, or the files in a folder."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def _take(file, at: int, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize * n
    data = file.read_at(size, at)
    if len(data) < size:
        raise ValueError("the file ends too early")
    return np.frombuffer(data, kind, n)


def layout(path: str, dims: int | None = None) -> Layout:
    """Reads the header and the clusters' sizes alone. Raises ValueError where they don't fit the file."""
    with _file(path) as file:
        version, count, width, clusters, _, start = header(memoryview(file.read_at(32, 0)), dims)
        found = Layout(path, version, count, width, start, np.zeros(clusters, np.int64))
        if version != FLOATS:
            found.sizes = _take(file, found.centroids + clusters * width * 4, "<i4", clusters).astype(np.int64)
            if found.sizes.sum() != count:
                raise ValueError("the sizes don't add up to the count")
        if file.size() < found.order + (4 * count if version == LISTED else 0):
            raise ValueError("the file ends too early")
    return found


def quantised(f: np.ndarray) -> np.ndarray:
    """As ``functions.scalar.quantise``."""
    near = np.nan_to_num(np.clip(f, -2, 2)) * np.float32(127)
    return np.clip(np.trunc(near + np.where(near >= 0, np.float32(0.5), np.float32(-0.5))), -127, 127).astype(np.int8)


def decode(found: Layout, start: int, end: int) -> dict[str, np.ndarray]:
    """cluster_id, pos, id, qvec, label of the rows from start to end, as they stand in the file."""
    n, place = end - start, np.arange(start, end)
    offsets = np.cumsum(found.sizes) - found.sizes
    with _file(found.path) as file:
        labels = _take(file, found.labels + start, "i1", n)
        if found.version == FLOATS:
            vectors = quantised(_take(file, found.start + start * found.width, "<f4", n * found.dims)).reshape(n, found.dims)
            return {"cluster_id": np.full(n, -1), "pos": place, "id": place, "qvec": vectors, "label": labels}
        flat, ids = _take(file, found.start + start * found.width, "i1", n * found.dims), place
        if found.version == LISTED:  # rows stand by id; the list of ids, which says where each belongs, is read in pieces
            where = np.zeros(n, np.int64)
            for at in range(0, found.count, PIECE):
                listed = _take(file, found.order + 4 * at, "<i4", min(PIECE, found.count - at))
                own = np.flatnonzero((listed >= start) & (listed < end))
                where[listed[own] - start] = at + own
            place, vectors = where, flat.reshape(n, found.dims)
        elif found.version == BLOCKED:
            own = np.clip(np.minimum(offsets + found.sizes, end) - np.maximum(offsets, start), 0, None)
            vectors = unblocked(flat, own, found.dims)
        else:
            vectors = flat.reshape(n, found.dims)
    cluster = np.searchsorted(offsets + found.sizes, place, "right")
    return {"cluster_id": cluster, "pos": place - offsets[cluster], "id": ids, "qvec": vectors, "label": labels}


ROWS = "cluster_id int, pos int, id long, qvec array<tinyint>, label tinyint"
CLUSTERS = "cluster_id int, centroid array<float>, size int"


@dataclass
class Range(InputPartition):
    found: Layout
    start: int
    end: int


class VectorFiles(DataSource):
    """``spark.read.format("quantised_vectors")``: the four layouts, in ranges of rows that tasks read apart.

    Options: path (a file, or a folder of files, in a store that Arrow knows), dims (checked if given), rows (of a range), clusters (true: the clusters in place of the
    rows). The driver reads headers and sizes alone. Files without clusters have all rows in cluster -1.
    """

    @classmethod
    def name(cls) -> str:
        return "quantised_vectors"

    def schema(self) -> str:
        return CLUSTERS if self.options.get("clusters", "false").lower() == "true" else ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Ranges(dict(self.options))


class _Ranges(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.each = options["path"], int(options.get("rows", RANGE_ROWS))
        self.dims = int(options["dims"]) if "dims" in options else None
        self.clusters = options.get("clusters", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        found = [layout(x, self.dims) for x in _paths(self.path)]
        return [Range(f, 0, 0) for f in found] if self.clusters else [Range(f, a, b) for f in found for a, b in f.cuts(self.each)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        f = part.found
        if self.clusters:
            with _file(f.path) as file:
                means = _take(file, f.centroids, "<f4", len(f.sizes) * f.dims).reshape(-1, f.dims)
            yield _batch({"cluster_id": np.arange(len(f.sizes)), "centroid": means, "size": f.sizes}, [pa.int32(), pa.float32(), pa.int32()])
            return
        yield _batch(decode(f, part.start, part.end), [pa.int32(), pa.int32(), pa.int64(), pa.int8(), pa.int8()])


def _batch(found: dict[str, np.ndarray], kinds: list[pa.DataType]) -> pa.RecordBatch:
    def column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        if x.ndim == 1:
            return pa.array(x.astype(kind.to_pandas_dtype()), kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1), kind))

    return pa.RecordBatch.from_arrays([column(x, k) for x, k in zip(found.values(), kinds, strict=True)], names=list(found))


def _read(spark: SparkSession, path: str, dims: int | None, **options: str) -> DataFrame:
    spark.dataSource.register(VectorFiles)
    return spark.read.format("quantised_vectors").options(**options, **({"dims": str(dims)} if dims else {})).load(path)


def read_binary_lists(spark: SparkSession, path: str, dims: int | None = None, rows: int | None = None) -> DataFrame:
    """cluster_id, pos, id, qvec, label of each file at path, a task for each range of rows."""
    return _read(spark, path, dims, rows=str(rows or RANGE_ROWS))


def read_binary_clusters(spark: SparkSession, path: str, dims: int | None = None) -> DataFrame:
    """cluster_id, centroid, size of each file at path."""
    return _read(spark, path, dims, clusters="true")

"""Top-k search of query blocks against all rows: rows stay where they are, queries go to them.

Queries are a stated set. They are sent to the tasks in blocks of at most ``QUERY_BYTES``; more queries mean more
passes. A task keeps the k best of its rows for each query, so what is shuffled is queries x k rows a task.

Defined results: rows and queries with a null vector have no part; rows that share a query id are one query, of
different vectors the least counts; a null query id is an id like others; rows with a null id come last among
equals; ids may be of any type that Arrow sorts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 64 << 20
PAIRS_AT_ONCE = 2_000_000


@dataclass
class Queries:
    """A block of queries: ids (and their type as Spark names it), vectors, whether these are whole numbers, and extra columns by name."""

    ids: pa.Array
    kind: str
    vectors: np.ndarray
    whole: bool
    extra: dict[str, pa.Array]

    def __len__(self) -> int:
        return len(self.ids)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as rows of 64-bit floats, in which sums of squared bytes are exact."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def is_whole(column: pa.Array) -> bool:
    return pa.types.is_integer(column.type.value_type)


def with_vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column("vec")
    return batch.filter(column.is_valid()) if column.null_count else batch


def _one_an_id(ids: pa.Array, vectors: np.ndarray) -> np.ndarray | None:
    """Which rows stay so that an id stands once; None: all."""
    codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((*vectors.T[::-1], codes))
    new = np.r_[True, codes[order][1:] != codes[order][:-1]]
    return None if new.all() else np.sort(order[new])


def query_blocks(queries: DataFrame, dims: int, extra: tuple[str, ...] = ()) -> Iterator[Queries]:
    """queries: query_id, vec and the extra columns. A set that fits one block is computed once."""
    kind = queries.schema["query_id"].dataType.simpleString()
    queries = queries.where("vec IS NOT NULL").select("query_id", "vec", *extra)
    most = max(1, QUERY_BYTES // (8 * (dims + len(extra) + 1)))
    parts: Iterator[pa.Table] = iter([queries.limit(most + 1).toArrow()])
    first = next(parts)
    if first.num_rows > most:
        n_blocks = math.ceil(queries.count() / most)
        parts = (queries.where(F.expr(f"pmod(xxhash64(query_id), {n_blocks})") == b).toArrow() for b in range(n_blocks))
    else:
        parts = iter([first])
    for part in parts:
        columns = {name: pa.concat_arrays(part.column(name).chunks) if part.num_rows else pa.array([], part.schema.field(name).type) for name in part.column_names}
        vectors = matrix(columns["vec"]) if part.num_rows else np.zeros((0, dims))
        keep = _one_an_id(columns["query_id"], vectors) if part.num_rows else None
        if keep is not None:
            vectors, columns = vectors[keep], {k: v.take(pa.array(keep)) for k, v in columns.items()}
        yield Queries(columns["query_id"], kind, vectors, is_whole(columns["vec"]), {k: columns[k] for k in extra})


def distances(queries: np.ndarray, rows: np.ndarray, whole: bool = False) -> np.ndarray:
    """Squared distances, query by row. Of whole numbers by a product, which is exact; else from differences: equal rows have distance 0."""
    if whole:
        return (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * (queries @ rows.T)
    out = np.empty((len(queries), len(rows)))
    if len(rows) < len(queries):
        for i, r in enumerate(rows):
            d = queries - r
            out[:, i] = np.einsum("ij,ij->i", d, d)
    else:
        for i, q in enumerate(queries):
            d = rows - q
            out[i] = np.einsum("ij,ij->i", d, d)
    return out


#: Of a block, a batch with its vectors and each query's limit so far: which rows to compare with which queries, and a number for each of these queries.
Pairing = Callable[[Queries, pa.RecordBatch, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]


def steps(rows: np.ndarray, n_queries: int) -> Iterator[np.ndarray]:
    each = max(1, PAIRS_AT_ONCE // max(1, n_queries))
    for at in range(0, len(rows), each):
        yield rows[at : at + each]


def everything(held: Queries, batch: pa.RecordBatch, data: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
    for rows in steps(np.arange(len(data)), len(held)):
        yield rows, np.arange(len(held)), None


class Best:
    """The k best rows so far of each query of a block."""

    def __init__(self, held: Queries, k: int, pairing: Pairing, order: tuple[str, ...], names: tuple[str, ...], tag: str | None) -> None:
        self.held, self.k, self.pairing, self.tag, self.names = held, k, pairing, tag, names
        self.keys = [("_q", "ascending"), ("dist", "ascending"), *((c, "ascending") for c in order)]
        self.limit = np.full(len(held), np.inf)  # no row farther than this can be among the k best
        self.kept: list[pa.Table] = []
        self.compared = 0

    def add(self, batch: pa.RecordBatch) -> None:
        data = matrix(batch.column("vec"))
        whole = self.held.whole and is_whole(batch.column("vec"))
        for rows, queries, numbers in self.pairing(self.held, batch, data, self.limit):
            if not len(rows) or not len(queries):
                continue
            found = distances(self.held.vectors[queries], data[rows], whole)
            self.compared += found.size
            edge = self.limit[queries]
            if len(rows) >= self.k:
                edge = np.minimum(edge, np.partition(found, self.k - 1, axis=1)[:, self.k - 1])
                edge = np.where(np.isnan(edge), self.limit[queries], edge)
                self.limit[queries] = edge
            q, r = np.nonzero(found <= edge[:, None])
            near = batch.take(pa.array(rows[r])).select(list(self.names))
            columns = [pa.array(queries[q]), pa.array(found[q, r]), *near.columns]
            names = ["_q", "dist", *self.names]
            if self.tag:
                columns, names = [*columns, pa.array(numbers[q].astype(np.int32))], [*names, self.tag]
            self.kept.append(pa.Table.from_arrays(columns, names=names))
            if sum(t.num_rows for t in self.kept) > 4 * self.k * len(self.held) + 10_000:
                self.prune()
        self.prune()

    def prune(self) -> None:
        if not self.kept:
            return
        table = pa.concat_tables(self.kept)
        table = table.take(pc.sort_indices(table, sort_keys=self.keys)).combine_chunks()
        q = table.column("_q").to_numpy()
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = np.flatnonzero(place == self.k - 1)
        self.limit[q[last]] = np.minimum(self.limit[q[last]], table.column("dist").to_numpy()[last])
        self.kept = [table.filter(pa.array(place < self.k))]

    def result(self) -> pa.RecordBatch | None:
        if not self.kept or not self.kept[0].num_rows:
            return None
        table = self.kept[0]
        ids = self.held.ids.take(table.column("_q").combine_chunks())
        names = [*([self.tag] if self.tag else []), "dist", *self.names]
        return pa.RecordBatch.from_arrays([ids, *(pa.concat_arrays(table.column(c).chunks) for c in names)], names=["query_id", *names])


def block_top_k(rows: DataFrame, block: Queries, k: int, pairing: Pairing = everything, order: tuple[str, ...] = ("id",), carry: tuple[str, ...] = (), tag: str | None = None) -> DataFrame:
    """query_id, dist, the order and carry columns: the k best rows of each task. rows: vec and those columns, and what the pairing reads.

    Ties go by the order columns, ascending. tag: names the numbers of the pairing, which may be an order column.
    """
    names = tuple(c for c in dict.fromkeys((*order, *carry)) if c != tag)
    sent = rows.sparkSession.sparkContext.broadcast(block)
    schema = ", ".join([f"query_id {block.kind}", *([f"{tag} int"] if tag else []), "dist double", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, k, pairing, order, names, tag)
        for batch in batches:
            best.add(with_vectors(batch))
        if (found := best.result()) is not None:
            yield found

    return rows.mapInArrow(run, schema)


def ranked(found: DataFrame, k: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k best of all tasks, with their rank from 1."""
    window = Window.partitionBy("query_id").orderBy("dist", *(F.col(c).asc_nulls_last() for c in order))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: DataFrame, k: int, dims: int, pairing: Pairing = everything, extra: tuple[str, ...] = (), order: tuple[str, ...] = ("id",), carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, rank, dist and the order and carry columns: for each query its k nearest rows, ties by the order columns."""
    names = [c for c in dict.fromkeys(("id", "vec", *order, *carry, *(c for c in rows.columns if c == "d0")))]
    parts = [block_top_k(rows.select(*names), b, k, pairing, order, carry) for b in query_blocks(queries, dims, extra)]
    return ranked(reduce(DataFrame.unionByName, parts), k, order)


def all_pairs(rows: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """query_id, id, dist of every (stated query, row) pair."""

    def of(block: Queries) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value
            for batch in map(with_vectors, batches):
                data, whole = matrix(batch.column("vec")), held.whole and is_whole(batch.column("vec"))
                for part in steps(np.arange(len(data)), len(held)):
                    found = distances(held.vectors, data[part], whole)
                    q, r = np.divmod(np.arange(found.size), len(part))
                    yield pa.RecordBatch.from_arrays([held.ids.take(pa.array(q)), batch.column("id").take(pa.array(part[r])), pa.array(found.reshape(-1))], names=["query_id", "id", "dist"])

        return rows.select("id", "vec").mapInArrow(run, f"query_id {block.kind}, id {rows.schema['id'].dataType.simpleString()}, dist double")

    return reduce(DataFrame.unionByName, (of(b) for b in query_blocks(queries, dims)))

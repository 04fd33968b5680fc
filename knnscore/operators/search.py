"""K-nearest-neighbour search: exact, pruned by the first dimension, and through an inverted-file index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import stored as written
from . import blocks, cells
from .index import Index
from .meeting import meet
from .parts import SLACK, Part

K = 5
PART_ROWS = 16_384  # of a list or band that a task holds at once
CHUNK = 256  # rows of similar first dimension that are skipped or compared together
FEW_BANDS = 64  # of more bands, ranges of so many bands together are searched through cells
FEW_LISTS, LISTS_BY_NAME = 16, 2000  # most lists that a scan names, so that files of others aren't opened


def exact(rows: DataFrame, queries: DataFrame, dims: int, k: int = K, carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, rank, id, dist: full scan; equal distances go by id. Fewer rows than k give fewer ranks."""
    return blocks.top_k(rows, queries, k, dims, carry=carry)


def sorted_by_first_dimension(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Adds d0, the first dimension, and sorts by it and id across partitions by range; written so, files and row groups have narrow ranges of d0."""
    d0 = rows.withColumn("d0", F.col("vec")[0].cast("double"))
    return d0.repartitionByRange(*([partitions] if partitions else []), "d0", "id").sortWithinPartitions("d0", "id")


def chunks_within(reach) -> blocks.Pairing:
    """Rows of a batch in the order of their first dimension, in chunks; each is compared with the queries that reach(held, gap to the chunk, limit) names."""

    def pairing(held: blocks.Queries, batch: pa.RecordBatch, data: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
        if not len(data):
            return
        order = np.argsort(data[:, 0], kind="stable")
        asked = held.vectors[:, 0]
        for at in range(0, len(order), CHUNK):
            rows = order[at : at + CHUNK]
            gap = np.maximum(np.maximum(data[rows[0], 0] - asked, asked - data[rows[-1], 0]), 0)
            queries = np.flatnonzero(reach(held, gap, limit))
            if len(queries):
                yield from ((part, queries, None) for part in blocks.steps(rows, len(queries)))

    return pairing


def first_dimension_pruned(rows: DataFrame, queries: DataFrame, dims: int, k: int = K, near: float = 0.0) -> DataFrame:
    """As ``exact``, in two passes over rows whose first dimension is a column ``d0`` (see ``sorted_by_first_dimension``).

    First, rows within ``near`` of the query's first dimension give k candidates and with them a radius; then only
    rows whose first dimension is within the radius, and within the k-th distance found so far, are compared, ties
    included. Without k candidates the radius is infinite. What lies outside of all radii isn't read.
    """
    close = chunks_within(lambda held, gap, limit: gap <= near)
    reached = chunks_within(lambda held, gap, limit: gap * gap <= np.minimum(held.extra["radius"].to_numpy(zero_copy_only=False), limit))
    first = blocks.top_k(rows, queries, k, dims, close)
    radius = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("radius"))
    known = queries.alias("q").join(radius.alias("r"), F.expr("q.query_id <=> r.query_id"), "left").select("q.query_id", "q.vec", F.coalesce("r.radius", F.lit(float("inf"))).alias("radius"))
    low, high = known.agg(F.min(F.col("vec")[0] - F.sqrt("radius")), F.max(F.col("vec")[0] + F.sqrt("radius"))).first()
    within = rows if low is None else rows.where((F.col("d0") >= float(low)) & (F.col("d0") <= float(high)))
    return blocks.top_k(within, known, k, dims, reached, ("radius",))


@dataclass
class Bands:
    """Rows by ranges of their first dimension: rows (band, id, vec, ...), and each band's number and range."""

    rows: DataFrame
    number: np.ndarray
    low: np.ndarray
    high: np.ndarray


def save_bands(rows: DataFrame, path: str, each: int = PART_ROWS) -> None:
    """Writes rows (id, vec, ...) by bands of about ``each`` rows: ranges of the first dimension and id, so many rows with one value spread too. Rows that are nearest to nothing, with a null vector or NaN for its first dimension, go."""
    d0 = rows.where("vec IS NOT NULL").withColumn("d0", F.col("vec")[0].cast("double")).where("NOT isnan(d0)")
    dealt = d0.repartitionByRange(max(1, -(-d0.count() // each)), "d0", "id").sortWithinPartitions("d0", "id")
    dealt.withColumn("band", F.spark_partition_id()).write.partitionBy("band").parquet(path)


def load_bands(spark: SparkSession, path: str, schema: StructType) -> Bands:
    """schema: of the rows as they were saved. A row a band comes to the driver."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("d0", DoubleType()), StructField("band", IntegerType())])).parquet(path)
    ends = rows.groupBy("band").agg(F.min("d0").alias("low"), F.max("d0").alias("high")).orderBy("band").collect()
    return Bands(rows, *(np.array([r[c] for r in ends], kind) for c, kind in (("band", np.int32), ("low", float), ("high", float))))


def _bands_to_visit(bands: Bands, queries: DataFrame, home: bool) -> DataFrame:
    """band, query_id, vec, limit: the band nearest to each query's first dimension, or else all others within its limit."""
    sent = queries.sparkSession.sparkContext.broadcast((bands.number, bands.low, bands.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high = sent.value
        for batch in batches:
            asked = blocks.matrix(batch.column("vec"))[:, :1] if batch.num_rows else np.zeros((0, 1))
            limit = pc.fill_null(batch.column("limit"), np.inf).to_numpy(zero_copy_only=False)
            wanted = []
            for part in blocks.steps(np.arange(len(asked)), len(number)):
                gap = np.maximum(np.maximum(low - asked[part], asked[part] - high), 0)
                first = gap.argmin(axis=1)
                reached = (gap * gap * SLACK <= limit[part, None]) & (np.arange(len(number)) != first[:, None])
                wanted += [[number[i].item()] for i in first] if home else [number[r].tolist() for r in reached]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "bands"])

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "vec", "limit"))
    visits = queries.select("query_id", "vec", "limit").mapInArrow(run, f"{kinds}, bands array<int>")
    return visits.select(F.explode("bands").alias("band"), "query_id", "vec", "limit", F.lit(1).alias("probe_rank"))


def _bands_in_cells(bands: Bands, queries: DataFrame, k: int) -> tuple[cells.Cells, DataFrame]:
    """The bands' rows in cells, ``FEW_BANDS`` ranges of bands being the lists; and the queries with these, that around their first dimension first."""
    each = -(-int(bands.number[-1] + 1) // FEW_BANDS)
    starts = np.searchsorted(bands.number, np.arange(0, bands.number[-1] + 1, each))
    held = cells.deal(bands.rows.select(F.floor(F.col("band") / each).cast("int").alias("cluster_id"), "id", "vec"), len(starts), k, PART_ROWS)
    ends = F.array(*(F.lit(float(x)) for x in bands.low[starts]))
    below = F.size(F.filter(ends, lambda x: x <= F.col("vec")[0].cast("double")))
    home = F.greatest(below - 1, F.lit(0))
    others = F.transform(F.sequence(F.lit(0), F.lit(len(starts) - 1)), lambda c: F.struct(F.when(c == F.col("home"), 1).otherwise(2).alias("probe_rank"), c.alias("cluster_id")))
    return held, one_an_id(queries).withColumn("home", home).select("query_id", "vec", others.alias("probes"))


def band_join(bands: Bands, queries: DataFrame, k: int = K, compared: Accumulator | None = None) -> DataFrame:
    """query_id, rank, id, dist: as ``exact``, by the first dimension. queries: query_id, vec.

    Each query goes to the band around its first dimension and gets a radius there; then to the bands that the radius meets, alone; their files
    alone are read. In a band it goes on only to chunks that are within its k-th distance so far. Where there are many bands, more than the first dimension may tell apart,
    ranges of bands are dealt in cells: a query goes to its own, then to those within its radius, by the first dimension and the others.
    """
    if not len(bands.number):
        return blocks.ranked(bands.rows.join(queries.select("query_id").limit(0), F.lit(True)).withColumn("dist", F.lit(0.0)), k).select("query_id", "rank", "id", "dist")
    if len(bands.number) > FEW_BANDS:
        return blocks.ranked(_through_cells(*_bands_in_cells(bands, queries, k), k, compared), k).select("query_id", "rank", "id", "dist")
    asked = written(one_an_id(queries).withColumn("limit", F.lit(None).cast("double")), "band-queries")
    held = bands.rows.select("band", "id", "vec")

    def near(visits: DataFrame) -> DataFrame:
        named = [r[0] for r in visits.select("band").distinct().collect()]
        rows = held.where(F.col("band").isin(named)) if len(named) <= LISTS_BY_NAME else held
        return meet_parts(rows, visits, ("band",), k, compared)

    first = written(near(_bands_to_visit(bands, asked, True)), "home-bands")
    known = asked.select("query_id", "vec").alias("q").join(_radius(first, k).alias("r"), F.expr("q.query_id <=> r.query_id"), "left").select("q.query_id", "q.vec", "r.limit")
    rest = written(_bands_to_visit(bands, known, False), "band-visits")
    return blocks.ranked(first.unionByName(near(rest)), k).select("query_id", "rank", "id", "dist")


def probe_lists(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """query_id, vec, probes (array of probe_rank from 1 and cluster_id): the nearest centroids, of equals the smaller cluster id. Queries stay where they are."""
    index.check_nprobe(nprobe)
    sent = queries.sparkSession.sparkContext.broadcast(index.centroids())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means = sent.value
        for batch in map(blocks.with_vectors, batches):
            data = blocks.matrix(batch.column("vec"))
            nearest = [np.zeros((0, nprobe), np.int64), *(blocks.distances(data[part], means).argsort(axis=1, kind="stable")[:, :nprobe] for part in blocks.steps(np.arange(len(data)), len(means)))]
            flat = np.concatenate(nearest).astype(np.int32).reshape(-1)
            clusters = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, nprobe, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), clusters], names=["query_id", "vec", "clusters"])

    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "vec"))
    found = queries.select("query_id", "vec").mapInArrow(run, f"{kinds}, clusters array<int>")
    return found.select("query_id", "vec", F.transform("clusters", lambda c, i: F.struct((i + 1).alias("probe_rank"), c.alias("cluster_id"))).alias("probes"))


def probe(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """query_id, probe_rank, cluster_id: a row for each list that a query probes."""
    return probe_lists(queries, index, nprobe).select("query_id", F.inline("probes"))


def one_an_id(queries: DataFrame) -> DataFrame:
    """query_id, vec: rows that share an id are one query, the least vector counts; null vectors have no part."""
    return queries.where("vec IS NOT NULL").groupBy("query_id").agg(F.min("vec").alias("vec"))


def meet_parts(held: DataFrame, asked: DataFrame, keys: tuple[str, ...], k: int, compared: Accumulator | None = None) -> DataFrame:
    """query_id, probe_rank, dist, id and further columns of held: in each part the k nearest rows of the queries that come to it.

    held: keys, id, vec and columns to carry, bounded for each key. asked: keys, query_id, vec, probe_rank, limit (null: none), beyond
    which no row is wanted. compared: counts the pairs whose distance was taken.
    """
    carry = [c for c in held.columns if c not in (*keys, "id", "vec")]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = ", ".join([f"query_id {kind(asked, 'query_id')}, probe_rank int, dist double, id {kind(held, 'id')}", *(f"{c} {kind(held, c)}" for c in carry)])

    def begin(key: tuple[int, ...], rows: pa.Table) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        part = Part(rows, k)

        def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            column, before = batch.column("vec"), part.compared
            limit = pc.fill_null(batch.column("limit"), np.inf).to_numpy(zero_copy_only=False)
            q, r, dist = part.nearest(blocks.matrix(column), limit, blocks.is_whole(column))
            if compared is not None:
                compared.add(part.compared - before)
            near = part.rows.take(pa.array(r)).combine_chunks()
            columns = [batch.column("query_id").take(pa.array(q)), batch.column("probe_rank").take(pa.array(q)), pa.array(dist), *(pa.concat_arrays(near.column(c).chunks) for c in ("id", *carry) if len(q))]
            if len(q):
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "probe_rank", "dist", "id", *carry])

        return ask

    return meet(held, asked, keys, begin, schema)


def _parts(index: Index) -> DataFrame:
    """cluster_id, parts: into how many a list is dealt, so that a task can hold one. A row a list, under the bound of the centroids."""
    parts = np.maximum(1, -(-index.held().sizes // PART_ROWS)).tolist()
    return F.broadcast(index.lists.sparkSession.createDataFrame(list(enumerate(parts)), "cluster_id int, parts int"))


def _scan(index: Index, lists: DataFrame, asked: DataFrame, k: int, compared: Accumulator | None = None) -> DataFrame:
    """asked: query_id, vec (quantised), cluster_id, probe_rank, limit. Lists and queries are dealt by list and part in one shuffle and meet there."""
    parts = _parts(index)
    held = lists.join(parts, "cluster_id").select("cluster_id", F.expr("pmod(xxhash64(id), parts)").cast("int").alias("part"), "id", F.col("qvec").alias("vec"), "label")
    sent = asked.join(parts, "cluster_id").select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vec", "probe_rank", "limit")
    return meet_parts(held, sent, ("cluster_id", "part"), k, compared)


def _answers(found: DataFrame, k: int, order: tuple[str, ...] = ("probe_rank", "id")) -> DataFrame:
    return blocks.ranked(found, k, order).select("query_id", "rank", "id", "dist", "label")


def scan_lists(index: Index, queries: DataFrame, probes: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, id, dist, label: the nearest quantised rows of the probed lists; ties by probe rank, then id, which is the order in a list.

    queries: query_id, vec (quantised). probes: query_id, cluster_id, probe_rank. Any number of queries makes a plan of the
    same size; a list's parts and the queries that probe it meet in one task, where boxes around chunks rule rows out.
    """
    asked = one_an_id(queries).alias("q").join(probes.alias("p"), F.expr("q.query_id <=> p.query_id")).select("q.query_id", "q.vec", "p.cluster_id", "p.probe_rank", F.lit(None).cast("double").alias("limit"))
    return _answers(_scan(index, index.lists, asked, k), k)


def _probed(index: Index, queries: DataFrame, nprobe: int) -> DataFrame:
    """query_id, vec (quantised), probes of float queries."""
    from ..functions.scalar import quantise_vector

    return probe_lists(one_an_id(queries), index, nprobe).withColumn("vec", quantise_vector("vec"))


def _has_cells(index: Index) -> bool:
    """Whether a list is more than a task holds: its rows are then dealt by where they are, so that queries pass by most of them."""
    return bool(index.held().sizes.max(initial=0) > PART_ROWS)


def _cells(index: Index, k: int) -> cells.Cells:
    if k not in index._cells:
        index._cells[k] = cells.deal(index.lists.select("cluster_id", "id", F.col("qvec").alias("vec"), "label"), index.n_clusters, k, PART_ROWS)
    return index._cells[k]


def _through_cells(held: cells.Cells, asked: DataFrame, k: int, compared: Accumulator | None = None, slack: float = 1.0) -> DataFrame:
    """As ``meet_parts`` over all cells of asked's lists (query_id, vec, probes; an id stands once): the cell that a query falls in gives it a radius, then it goes to those within it. What each phase asks is written."""
    asked = written(asked.select("query_id", "vec", "probes", F.lit(None).cast("double").alias("limit")), "probes")
    near = written(meet_parts(held.rows, held.visits(asked, k), ("cell", "part"), k, compared), "nearest")
    known = asked.drop("limit").alias("p").join(_radius(near, k).alias("r"), F.expr("p.query_id <=> r.query_id"), "left").select("p.*", "r.limit")
    return near.unionByName(meet_parts(held.rows, held.visits(known, k, slack), ("cell", "part"), k, compared))


def inverted_file(index: Index, queries: DataFrame, nprobe: int, k: int = K, compared: Accumulator | None = None) -> DataFrame:
    """Search of float queries (query_id, vec): probe, quantise, scan, all in one plan; through cells where lists are large."""
    if _has_cells(index):
        return _answers(_through_cells(_cells(index, k), _probed(index, queries, nprobe), k, compared), k)
    asked = _probed(index, queries, nprobe).select("query_id", "vec", F.inline("probes")).withColumn("limit", F.lit(None).cast("double"))
    return _answers(_scan(index, index.lists, asked, k, compared), k)


def lists_named(index: Index, asked: DataFrame) -> DataFrame:
    """The lists that asked (cluster_id) names: a filter on the folders, so that files of others aren't opened. At most a number a list comes to the driver; of few lists all are read."""
    if index.n_clusters <= FEW_LISTS:
        return index.lists
    named = [r[0] for r in asked.select("cluster_id").distinct().collect()]
    return index.lists.where(F.col("cluster_id").isin(named)) if len(named) < min(index.n_clusters, LISTS_BY_NAME + 1) else index.lists


def within_boxes(index: Index, asked: DataFrame, slack: float = 1.0) -> DataFrame:
    """asked (query_id, vec, probes, limit) with those probes after the first whose list's stored box is no farther than slack times the limit."""
    sent = asked.sparkSession.sparkContext.broadcast(index.held())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, limit = blocks.matrix(batch.column("vec")), pc.fill_null(batch.column("limit"), np.inf).to_numpy(zero_copy_only=False)
            flat, n = batch.column("probes").flatten(), batch.column("probes").value_lengths().to_numpy()
            cluster, owner = flat.field("cluster_id").to_numpy(), np.repeat(np.arange(len(n)), n)
            near = np.empty(len(cluster), bool)
            for part in blocks.steps(np.arange(len(cluster)), index_dims):
                q = vectors[owner[part]]
                gap = np.maximum(np.maximum(held.low[cluster[part]] - q, q - held.high[cluster[part]]), 0)
                near[part] = np.einsum("ij,ij->i", gap, gap) <= slack * limit[owner[part]]
            near &= (flat.field("probe_rank").to_numpy() > 1) & (held.sizes[cluster] > 0)
            kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(owner[near], minlength=len(n)))].astype(np.int32)), flat.filter(pa.array(near)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec"), kept, batch.column("limit")], names=["query_id", "vec", "probes", "limit"])

    index_dims = index.dims
    return asked.select("query_id", "vec", "probes", "limit").mapInArrow(run, asked.select("query_id", "vec", "probes", "limit").schema)


def pruned_file(index: Index, queries: DataFrame, nprobe: int | None = None, k: int = K, compared: Accumulator | None = None, slack: float = 1.0, order: tuple[str, ...] = ("probe_rank", "id")) -> DataFrame:
    """As ``inverted_file``, in two phases; nprobe None: all lists, which loses no neighbour. order: of equal distances.

    The nearest list gives each query k rows and with them a radius. Of the other probed lists only those are read whose stored box is within
    the radius. Both phases' requests and the first one's rows are written to the shared folder, so nothing is computed again; an index of few lists,
    of which no files are passed over, does with one plan. Where lists are large their cells take the place of lists.
    """
    if _has_cells(index):
        asked = _probed(index, queries, index.n_clusters if nprobe is None else nprobe)
        return _answers(_through_cells(_cells(index, k), asked, k, compared, slack), k, order)
    stored = written if index.n_clusters > FEW_LISTS else lambda df, name: df
    probes = stored(_probed(index, queries, index.n_clusters if nprobe is None else nprobe), "probes")
    first = probes.select("query_id", "vec", F.inline(F.slice("probes", 1, 1)), F.lit(None).cast("double").alias("limit"))
    near = stored(_scan(index, lists_named(index, first), first, k, compared), "nearest")
    known = probes.alias("p").join(_radius(near, k).alias("r"), F.expr("p.query_id <=> r.query_id"), "left").select("p.*", "r.limit")
    rest = stored(within_boxes(index, known, slack).select("query_id", "vec", F.inline("probes"), "limit"), "probes-within")
    return _answers(near.unionByName(_scan(index, lists_named(index, rest), rest, k, compared)), k, order)


def _radius(near: DataFrame, k: int) -> DataFrame:
    """query_id, limit: the distance of the k-th row, null where there are fewer."""
    return blocks.ranked(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("limit"))


def pruned_probes(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, radius, cluster_id, bound: the clusters whose box is within the k-th distance found in the nearest one. queries: query_id, vec (quantised), raw (floats)."""
    nearest = probe(queries.select("query_id", F.col("raw").alias("vec")), index, 1)
    first = scan_lists(index, queries.select("query_id", "vec"), nearest, k)
    radius = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("radius"))
    known = queries.select("query_id", "vec").join(radius, "query_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    return box_bounds(index, known, ("radius",)).where("bound <= radius")


def box_bounds(index: Index, queries: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """query_id, cluster_id, bound: least squared distance of each stated query to each cluster's box; empty clusters have none."""
    parts = []
    for block in blocks.query_blocks(queries, index.dims, carry):
        sent = queries.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            held = sent.value
            for batch in batches:
                low, high = (blocks.matrix(batch.column(c)) for c in ("low", "high"))
                for i, q in enumerate(held.vectors):
                    gap = np.maximum(np.maximum(low - q, q - high), 0)
                    same = pa.array(np.full(batch.num_rows, i))
                    columns = [held.ids.take(same), batch.column("cluster_id"), pa.array((gap * gap).sum(axis=1).astype(np.int64)), *(held.extra[c].take(same) for c in carry)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "cluster_id", "bound", *carry])

        schema = f"query_id {block.kind}, cluster_id int, bound long" + "".join(f", {c} double" for c in carry)
        parts.append(index.clusters.where("size > 0").select("cluster_id", "low", "high").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)

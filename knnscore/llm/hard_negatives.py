"""Hard negatives from k-means inverted lists that are visited by a bound on their scores.

Vectors become integers (floor of 256 times each component), a score is their inner product with the anchor. Lists are
those of k-means centroids, fitted on a bounded sample; every row is in a list, and each list keeps its radius, the
greatest distance of its rows to the centroid. By Cauchy and Schwarz a row of a list scores at most
anchor . centroid + |anchor| * radius, and at least anchor . centroid - |anchor| * radius.

An anchor visits lists in the falling order of the upper bound. Lists that lie outside its window of scores are
skipped, and it stops when the bound falls strictly below the k-th score so far. Neighbouring lists make a shelf of at
most ``SHELF_ROWS`` rows, which one task holds while anchors stream past it; a list with more rows has several shelves. First an
anchor visits the shelf of its best list, then, with the k-th score from there, each other shelf that has a list
within bound and window. So it goes once for the positives (one window without an end, rows of the anchor's label) and once for the negatives (a
window for each positive, rows of other labels). The results are those of scanning all rows; bounds only save work, and
save none where vectors are spread evenly.

Of rows with the same label and vector, which all have the same scores, the ``COPIES`` smallest ids alone are in the lists, as no
other can be among the first ten; they are cut to that in each task before the shuffle. Anchors and rows never pass
the driver; centroids, radii and the sample do, under stated bounds.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
vectors have one length, else a ValueError is raised; rows that repeat an id are one row, of which the least label and
vector count; equal scores go by id; a positive whose window holds no row of another label gives no row; scores that
might leave 63 bits raise an OverflowError; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.meeting import meet
from ._shared import stored

POSITIVES, NEGATIVES, ANCHOR_EVERY = 5, 10, 100
COPIES = NEGATIVES + 1  # of equal rows: those that may be wanted, and the anchor itself
SAMPLE_ROWS, ROUNDS, SEED = 20_000, 8, 13  # of the fit
LIST_ROWS, MOST_LISTS, SHELF_ROWS = 1024, 4096, 16_384
PAIRS_AT_ONCE = 2_000_000
NONE, LEAST, MOST = -(2**63) + 1, -(2**62), 2**62  # no score, and the ends of a window without ends
VISIT = "anchor_id long, label int, vec array<int>, windows array<struct<positive_id: long, positive_score: long, low: long, high: long>>"
FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def whole(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """id, label, vec (whole numbers) of the rows that take part, one an id. embeddings: id, label, vec."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fit = embeddings.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    numbers = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    least = fit.select("id", F.struct(F.col("label").cast("int").alias("label"), numbers.alias("vec")).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return least.select("id", "x.label", "x.vec")


def vectors(column: pa.Array, dims: int) -> np.ndarray:
    if not (column.value_lengths().to_numpy() == dims).all():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dims)


@dataclass
class Lists:
    """Centroids and radii by list, and for each part of a list its list and shelf."""

    means: np.ndarray
    radii: np.ndarray
    part_list: np.ndarray
    part_shelf: np.ndarray

    def bounds(self, asked: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a row of each list may have, a little wider than rounding errors."""
        size = np.sqrt(np.einsum("ij,ij->i", asked, asked))[:, None]
        centre, reach = asked @ self.means[lists].T, size * self.radii[lists]
        slack = 1e-6 + 1e-9 * (size * np.sqrt(np.einsum("ij,ij->i", self.means[lists], self.means[lists])) + reach)
        return centre - reach - slack, centre + reach + slack


def fit(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of a sample: rows drawn at random, then rounds of assigning and averaging; an empty cluster keeps its centroid."""
    random = np.random.default_rng(seed)
    means = sample[random.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = _nearest(sample, means)
        sums, counts = np.zeros_like(means), np.bincount(nearest, minlength=len(means))
        np.add.at(sums, nearest, sample)
        means = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], means)
    return means


def _nearest(data: np.ndarray, means: np.ndarray) -> np.ndarray:
    each, norms = max(1, PAIRS_AT_ONCE // len(means)), (means * means).sum(axis=1)
    return np.concatenate([(norms - 2 * data[at : at + each] @ means.T).argmin(axis=1) for at in range(0, len(data), each)])


def assigned(rows: DataFrame, means: np.ndarray) -> DataFrame:
    """Adds list and gap, the distance to its centroid."""
    sent, dims = rows.sparkSession.sparkContext.broadcast(means), means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = vectors(batch.column("vec"), dims)
                nearest = _nearest(data, sent.value)
                gap = np.sqrt(((data - sent.value[nearest]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(gap)], names=[*batch.schema.names, "list", "gap"])

    return rows.mapInArrow(run, "id long, label int, vec array<int>, list int, gap double")


def shelved(rows: DataFrame, means: np.ndarray, n_rows: int) -> tuple[DataFrame, Lists]:
    """The rows with list and shelf, and the lists' bounds. A list of more than a shelf's rows is dealt over several by id."""
    spark = rows.sparkSession
    most = min(SHELF_ROWS, max(LIST_ROWS, n_rows // (2 * spark.sparkContext.defaultParallelism)))
    placed = stored(assigned(rows, means), "lists")
    radii, parts, shelves, shelf, held = np.zeros(len(means)), [], [], 0, 0
    first, count = [0] * len(means), [1] * len(means)
    found = {r["list"]: r for r in placed.groupBy("list").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    for number in _neighbours(means):
        if number not in found:
            continue
        radii[number], n = found[number]["radius"], found[number]["n"]
        if held and held + n > most:
            shelf, held = shelf + 1, 0
        first[number], count[number] = shelf, -(-n // most)
        parts += [number] * count[number]
        shelves += range(shelf, shelf + count[number])
        shelf, held = (shelf + count[number], 0) if count[number] > 1 else (shelf, held + n)
    at = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(zip(first, count, strict=True))], "list int, first int, parts int")
    number = F.col("first") + F.expr("pmod(xxhash64(id), parts)").cast("int")
    return placed.join(F.broadcast(at), "list").select(number.alias("shelf"), "list", "id", "label", "vec"), Lists(means, radii, np.array(parts, np.int64), np.array(shelves, np.int64))


def _neighbours(means: np.ndarray) -> list[int]:
    """The lists in the order of the direction in which centroids differ most."""
    off = means - means.mean(axis=0)
    return np.argsort(off @ np.linalg.eigh(off.T @ off)[1][:, -1], kind="stable").tolist()


def _windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ends of each row's windows; rows with fewer than others get empty ones."""
    n, flat = column.value_lengths().to_numpy(), column.flatten()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.full((len(n), n.max(initial=0)), MOST), np.full((len(n), n.max(initial=0)), LEAST)
    for out, name in ((low, "low"), (high, "high")):
        out[np.repeat(np.arange(len(n)), n), place] = flat.field(name).to_numpy()
    return low, high


def shelves_to_visit(asked: DataFrame, lists: Lists, best: bool) -> DataFrame:
    """``VISIT`` rows by shelf: that of each row's best list, or else all others within its windows."""
    sent, dims = asked.sparkSession.sparkContext.broadcast(lists), lists.means.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        step = max(1, PAIRS_AT_ONCE // max(1, len(held.part_list)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            least, greatest = held.bounds(vectors(batch.column("vec"), dims), held.part_list)
            first = held.part_shelf[greatest.argmax(axis=1)]
            if best:
                wanted = [[x] for x in first.tolist()]
            else:
                low, high = _windows(batch.column("windows"))
                within = np.zeros(greatest.shape, bool)
                for w in range(low.shape[1]):
                    within |= (greatest >= low[:, w : w + 1]) & (least <= high[:, w : w + 1])
                within &= held.part_shelf != first[:, None]
                wanted = [np.unique(held.part_shelf[x]).tolist() for x in within]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "shelves"])

    return asked.mapInArrow(run, f"{VISIT}, shelves array<int>").select(F.explode("shelves").alias("shelf"), "anchor_id", "label", "vec", "windows")


class Shelf:
    """The rows of a shelf by list, each list's by id."""

    def __init__(self, rows: pa.Table, lists: Lists, k: int, same_label: bool) -> None:
        self.lists, self.k, self.same_label, self.dims = lists, k, same_label, lists.means.shape[1]
        rows = rows.sort_by([("list", "ascending"), ("id", "ascending")]).combine_chunks()
        numbers = rows.column("list").to_numpy()
        self.vec = vectors(rows.column("vec").chunk(0), self.dims)
        self.label, self.id = rows.column("label").to_numpy(), rows.column("id").to_numpy()
        self.numbers, first = np.unique(numbers, return_index=True)
        self.spans = list(zip(first.tolist(), [*first[1:].tolist(), len(numbers)], strict=True))
        self.largest = float(np.abs(self.vec).max(initial=0))

    def ask(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS_AT_ONCE // len(self.vec))
        for at in range(0, batch.num_rows, step):
            yield self.visit(batch.slice(at, step))

    def visit(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        asked, label, anchor = vectors(batch.column("vec"), self.dims), batch.column("label").to_numpy(), batch.column("anchor_id").to_numpy()
        low, high = _windows(batch.column("windows"))
        score = np.full((*low.shape, self.k), NONE)
        found = np.zeros_like(score)
        least, greatest = self.lists.bounds(asked, self.numbers)
        order = np.argsort(-greatest, axis=1, kind="stable")
        everyone = np.arange(len(asked))
        for turn in range(len(self.numbers)):
            mine = order[:, turn]
            some, most = least[everyone, mine][:, None], greatest[everyone, mine][:, None]
            going = ((most >= low) & (some <= high)).any(axis=1)  # low: the k-th score so far
            for place in np.unique(mine[going]).tolist():
                who = np.flatnonzero(going & (mine == place))
                start, end = self.spans[place]
                mask = label[who][:, None] == self.label[start:end]
                mask = mask & (anchor[who][:, None] != self.id[start:end]) if self.same_label else ~mask
                scores, ids = in_order(np.where(mask, self.products(asked[who], start, end), NONE), self.id[start:end])
                for w in range(low.shape[1]):
                    score[who, w], found[who, w] = self.merged(score[who, w], found[who, w], scores, ids, low[who, w], high[who, w])
                    low[who, w] = np.maximum(low[who, w], score[who, w, -1])
        a, w, j = np.nonzero(score > NONE)
        flat, starts = batch.column("windows").flatten(), np.r_[0, np.cumsum(batch.column("windows").value_lengths().to_numpy())]
        of = flat.take(pa.array(starts[a] + w))
        return pa.RecordBatch.from_arrays([pa.array(anchor[a]), of.field("positive_id"), of.field("positive_score"), pa.array(found[a, w, j]), pa.array(score[a, w, j])], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    def products(self, asked: np.ndarray, start: int, end: int) -> np.ndarray:
        """Scores, exact: by floats where no sum can leave their whole numbers."""
        top = self.largest * float(np.abs(asked).max(initial=0)) * self.dims
        if top < 2**53:
            return (asked @ self.vec[start:end].T).astype(np.int64)
        if top >= MOST:
            raise OverflowError("scores may leave 63 bits")
        return asked.astype(np.int64) @ self.vec[start:end].astype(np.int64).T

    def merged(self, score: np.ndarray, found: np.ndarray, scores: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k so far and the first k of a list's rows within the window, equal scores by id."""
        at = (scores > high[:, None]).sum(axis=1)[:, None] + np.arange(self.k)
        inside = np.minimum(at, scores.shape[1] - 1)
        more = np.take_along_axis(scores, inside, axis=1)
        more = np.where((at < scores.shape[1]) & (more >= low[:, None]), more, NONE)
        score, found = np.hstack([score, more]), np.hstack([found, np.take_along_axis(ids, inside, axis=1)])
        best = np.lexsort((found, -score), axis=1)[:, : self.k]
        return np.take_along_axis(score, best, axis=1), np.take_along_axis(found, best, axis=1)


def in_order(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores from the highest, equal ones by place (ids rise), and their ids. NONE stays last."""
    n = scores.shape[1]
    there = scores > NONE
    if n and np.abs(scores, where=there, out=np.zeros_like(scores)).max(initial=0) < 2**61 // n:
        keys = np.sort(np.where(there, -scores * n + np.arange(n), 2**62), axis=1)
        real = keys < 2**62
        return np.where(real, -(keys // n), NONE), ids[np.where(real, keys % n, 0)]
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(scores, order, axis=1), ids[order]


def visit(rows: DataFrame, lists: Lists, asked: DataFrame, k: int, same_label: bool, best: bool) -> DataFrame:
    """``FOUND`` rows: in each shelf that is visited the first k of each window."""
    sent = rows.sparkSession.sparkContext.broadcast(lists)
    return meet(rows, shelves_to_visit(asked, lists, best), ("shelf",), lambda key, held: Shelf(held, sent.value, k, same_label).ask, FOUND)


def first_of(found: DataFrame, k: int, *by: str) -> DataFrame:
    """Adds rank: the first k by score, then id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def searched(rows: DataFrame, lists: Lists, asked: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
    """The first k of each window over all rows, with rank: the best shelf, then others with what that has shown."""
    near = stored(visit(rows, lists, asked, k, same_label, True), f"{name}-near")
    known = near.groupBy("anchor_id", "positive_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = known.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("positive_id", F.lit(-1)).alias("p"), "kth"))).alias("kth"))
    kth = lambda w: F.coalesce(F.try_element_at("kth", F.coalesce(w["positive_id"], F.lit(-1))), w["low"])
    narrow = F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], kth(w))))
    rest = asked.join(known, "anchor_id", "left").select("anchor_id", "label", "vec", narrow.alias("windows"))
    far = visit(rows, lists, rest, k, same_label, False)
    return stored(first_of(near.unionByName(far), k, "anchor_id", "positive_id"), name)


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. embeddings: id, label, vec.

    Anchors are the ids divisible by ``every``; a negative's score is between ``least`` and ``most`` hundredths of the positive's.
    """
    spark: SparkSession = embeddings.sparkSession
    unique = stored(whole(embeddings), "whole-vectors")
    copies = unique.withColumn("_copy", F.row_number().over(Window.partitionBy("label", "vec").orderBy("id")))
    rows = stored(copies.where(F.col("_copy") <= max(COPIES, negatives + 1, positives + 1)).drop("_copy"), "distinct-vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = rows.where(F.expr(f"pmod(xxhash64(id), {-(-n // SAMPLE_ROWS)}) = 0")).select("vec").limit(2 * SAMPLE_ROWS).toArrow()
    sample = sample if sample.num_rows else rows.select("vec").limit(1).toArrow()
    vec = pa.concat_arrays(sample.column("vec").chunks)
    means = fit(vectors(vec, int(vec.value_lengths()[0].as_py())), min(MOST_LISTS, -(-n // LIST_ROWS)))
    rows, lists = shelved(rows, means, n)
    window = lambda *x: F.struct(*(v.cast("long").alias(c) for v, c in zip(x, ("positive_id", "positive_score", "low", "high"), strict=True)))
    anchors = unique.where(F.col("id") % every == 0).select(F.col("id").alias("anchor_id"), "label", "vec")
    best = searched(rows, lists, anchors.withColumn("windows", F.array(window(F.lit(None), F.lit(None), F.lit(LEAST), F.lit(MOST)))), positives, True, "positives")
    low, high = F.expr(f"CAST(ceil(CAST(score AS decimal(20, 0)) * {least} / 100) AS long)"), F.expr(f"CAST(floor(CAST(score AS decimal(20, 0)) * {most} / 100) AS long)")
    wanted = best.where(low <= high).groupBy("anchor_id").agg(F.collect_list(window(F.col("id"), F.col("score"), low, high)).alias("windows"))
    found = searched(rows, lists, anchors.join(wanted, "anchor_id"), negatives, False, "negatives")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

"""k-means for the index: seeds by oversampling over all rows, then a fixed number of rounds, in which bounds spare rows their distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .blocks import PAIRS_AT_ONCE, distances, matrix, steps, with_vectors
from .index import CENTROID_BYTES, CLUSTERS, assign

ROUNDS, SEED = 20, 7
PASSES, OVER = 5, 2  # of seeding: passes that draw OVER times as many rows as seeds are wanted
DRAWN = 1 << 53


def first_rows(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n smallest ids: seeds that SQL can name. Null vectors are left out."""
    return np.array([r[0] for r in rows.where("vec IS NOT NULL").orderBy("id").select("vec").limit(n).collect()], np.float64)


def drawn(rows: DataFrame, candidates: np.ndarray, expected: int, total: float, turn: int, seed: int) -> np.ndarray:
    """The vectors of rows drawn in one pass, each by a hash of its id with probability expected * (squared distance to the nearest candidate) / total."""
    sent = rows.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, chance = matrix(batch.column("vec")), batch.column("chance").to_numpy()
            keep = [np.zeros(0, np.int64)]
            for part in steps(np.arange(len(data)), len(sent.value)):
                keep.append(part[chance[part] * total < expected * distances(data[part], sent.value).min(axis=1)])
            yield pa.RecordBatch.from_arrays([batch.column("vec").take(pa.array(np.concatenate(keep)))], names=["vec"])

    chance = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(turn)), F.lit(DRAWN)) / float(DRAWN)
    wanted = rows.where("vec IS NOT NULL").select("vec", chance.alias("chance"))
    found = wanted.mapInArrow(run, f"vec {rows.schema['vec'].dataType.simpleString()}").toArrow()  # about ``expected`` rows
    return matrix(pa.concat_arrays(found.column("vec").chunks)) if found.num_rows else candidates[:0]


def spread_seeds(rows: DataFrame, n: int = CLUSTERS, passes: int = PASSES, seed: int = SEED) -> np.ndarray:
    """n seeds that are spread as by k-means++, from all rows: k-means||.

    Each pass draws about ``OVER`` * n rows in proportion to their squared distance to the candidates so far; the candidates are weighted by the rows
    that are nearest to them, and n of these few are drawn in turn by weight times squared distance. No rows give no seeds; a table of fewer
    different rows than n gives some seeds twice.
    """
    rows = rows.select("id", "vec")
    start = rows.where("vec IS NOT NULL").orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(1).collect()
    if not start:
        return np.zeros((0, 0))
    candidates = np.array([start[0][0]], np.float64)
    turn = 0
    while turn < passes or (len(candidates) < n and turn < 4 * passes):
        total = mass(rows, candidates).first()["total"]
        if not total > 0:
            break
        candidates = np.concatenate([candidates, drawn(rows, candidates, OVER * n, total, turn, seed)])
        turn += 1
    candidates = np.unique(candidates, axis=0)
    weight = np.zeros(len(candidates))
    for row in assign(rows.where("vec IS NOT NULL").select("vec"), candidates).groupBy("cluster_id").count().collect():  # a row a candidate
        weight[row["cluster_id"]] = row["count"]
    return weighted_seeds(candidates, weight, n, seed)


def weighted_seeds(points: np.ndarray, weight: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """k-means++ over few weighted points."""
    random = np.random.default_rng(seed)
    at = np.searchsorted(np.cumsum(weight), random.random() * weight.sum(), "right")
    seeds, least = [points[min(at, len(points) - 1)]], np.full(len(points), np.inf)
    for _ in range(1, n):
        d = points - seeds[-1]
        least = np.minimum(least, np.einsum("ij,ij->i", d, d))
        up = np.cumsum(weight * least)
        at = np.searchsorted(up, random.random() * up[-1], "right") if up[-1] > 0 else 0
        seeds.append(points[min(at, len(points) - 1)])
    return np.array(seeds)


def partial_sums(assigned: DataFrame) -> DataFrame:
    """cluster_id, n, sums: a row for each cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in map(with_vectors, batches):
            data, cluster = matrix(batch.column("vec")), batch.column("cluster_id").to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                own = data[cluster == c]
                sums[c] = sums.get(c, 0) + own.sum(axis=0)
                counts[c] = counts.get(c, 0) + len(own)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([counts[c] for c in sums], pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["cluster_id", "n", "sums"]
            )

    return assigned.select("vec", "cluster_id").mapInArrow(run, "cluster_id int, n long, sums array<double>")


def means(assigned: DataFrame, dims: int) -> DataFrame:
    """cluster_id, n, mean of each cluster that has rows."""
    total = partial_sums(assigned).groupBy("cluster_id").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums"))
    return total.select("cluster_id", "n", F.transform("sums", lambda x: x / F.col("n")).alias("mean"))


def step(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: assign, then average; a cluster without rows keeps its centroid."""
    return _averaged(assign(rows.where("vec IS NOT NULL"), centroids), centroids)


def _averaged(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    out = centroids.copy()
    for row in means(assigned, centroids.shape[1]).collect():  # a row a cluster
        out[row.cluster_id] = np.array(row["mean"], np.float32)
    return out


def fit(rows: DataFrame, seeds: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after the rounds, and those before the last one: lists follow the latter, half a round older. No seeds give no centroids."""
    before = centroids = seeds
    for _ in range(rounds if len(seeds) else 0):
        before, centroids = centroids, step(rows, centroids)
    return centroids, before


STATE = "vec array<double>, cluster_id int, upper double, lower double"


def bounded_step(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, compared: Accumulator | None = None) -> DataFrame:
    """``STATE`` rows against new centroids. moved: how far each went since the state's bounds were true; None for rows without bounds.

    upper is no less than a row's distance to its centroid, lower no more than that to any other. Both are shifted by what has moved; where upper is
    still below lower no other centroid can be nearest, and no distance is taken. compared: counts the distances that are.
    """
    sent = state.sparkSession.sparkContext.broadcast((centroids, moved))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, shift = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data = matrix(batch.column("vec"))
            if shift is None:
                own, upper, lower = np.zeros(len(data), np.int64), np.full(len(data), np.inf), np.full(len(data), -np.inf)
            else:
                own, upper, lower = (batch.column(c).to_numpy().copy() for c in ("cluster_id", "upper", "lower"))
                top = shift.argsort()[::-1]
                upper += shift[own]
                lower -= np.where(own == top[0], shift[top[1]] if len(top) > 1 else 0.0, shift[top[0]])
            open_ = np.flatnonzero(upper * (1 + 1e-12) >= lower)
            for part in np.array_split(open_, max(1, -(-len(open_) * len(means) // PAIRS_AT_ONCE))):
                if not len(part):
                    continue
                # the nearest as in the plain rounds; real distances for the bounds
                score = (means * means).sum(axis=1) - 2 * data[part] @ means.T
                near = score.argmin(axis=1)
                away = np.sqrt(np.maximum(score + (data[part] ** 2).sum(axis=1)[:, None], 0))
                slack = 1e-7 * (1 + np.abs(score).max(axis=1))  # of distances from products
                own[part], upper[part] = near, away[np.arange(len(part)), near] + slack
                away[np.arange(len(part)), near] = np.inf
                lower[part] = away.min(axis=1) - slack
            if compared is not None:
                compared.add(len(open_) * len(means))
            yield pa.RecordBatch.from_arrays([pa.array(data.tolist(), pa.list_(pa.float64())), pa.array(own.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["vec", "cluster_id", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def bounded_fit(rows: DataFrame, seeds: np.ndarray, rounds: int = ROUNDS, compared: Accumulator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``fit``, with the same result: each round's assignment and bounds are written to the shared folder, from where the next goes on. Pays where
    there are many centroids, as a row's vector is written and read in place of its distances to all of them."""
    unknown = F.lit(None).cast("double")
    state = rows.where("vec IS NOT NULL").select(F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("cluster_id"), unknown.alias("upper"), unknown.alias("lower"))
    before = centroids = seeds
    moved = None
    for _ in range(rounds if len(seeds) else 0):
        state = stored(bounded_step(state, centroids, moved, compared), "k-means-round")
        before, centroids = centroids, _averaged(state, centroids)
        moved = np.sqrt(((centroids - before) ** 2).sum(axis=1))
    return centroids, before


def mass(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """total: the sum of squared distances to the nearest centroid; null without rows."""
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError("the centroids are too large to broadcast")
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(with_vectors, batches):
            data, c, total = matrix(batch.column("vec")), sent.value, 0.0
            for part in steps(np.arange(len(data)), len(c)):
                total += float(distances(data[part], c).min(axis=1).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    return rows.select("vec").mapInArrow(run, "part double").agg(F.sum("part").alias("total"))

"""Importance resampling: documents drawn so that their word features are distributed as those of a target.

Features of a text are its words and pairs of neighbouring words, hashed by crc32 into ``BUCKETS`` buckets. The sparse
matrix of counts, document by bucket, is written to the shared folder as blocks in compressed sparse rows (ids, row
pointers, bucket indices, counts). Column sums of the corpus' and the target's matrix give both distributions, their
smoothed log ratio in thousandths is a bucket's gain, and the product of the matrix with the gains, over the number of
features, is a document's weight. Gumbel noise from a hash of the id makes "the highest scores" a weighted draw without
replacement.

A row of the matrix has at most ``BUCKETS`` entries, whatever the length of its text, and a block about
``BLOCK_ENTRIES``, as writers of Parquet hold a hundred values of a column and more before they look at their size. Texts are hashed in windows of about a megabyte. Column sums leave a task as one row a bucket; only the
``BUCKETS`` sums reach the driver. Documents are ranked by ranges of scores, so no task sees all of them.

Defined results: a null or empty text has no features, weight 0 and a score, but too few words to be drawn; of equal
scores the smaller id comes first; repeated rows of an id each count and each may be drawn, next to each other; a null
id has a null score and is never drawn, but its features count; an empty target gives smoothed gains; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import pieces, ranked, stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
WINDOW_BYTES, BLOCK_ENTRIES = 1_000_000, 16_384
BLOCKS = "doc_id array<long>, n_words array<long>, n_features array<long>, row_starts binary, bucket binary, n binary"  # the last three: packed 32-bit numbers
#: Of each byte: a letter in lower case, a digit or a byte of a character beyond ASCII as it is, else a space.
FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def windows(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a window at a time; no word is cut."""
    rest = b""
    for at in range(0, len(text), WINDOW_BYTES):
        folded = text[at : at + WINDOW_BYTES].translate(FOLDED)
        whole, space, last = folded.rpartition(b" ")
        if space:
            yield (rest + whole).split()
            rest = last
        else:
            rest += folded
    yield rest.split()


def counts(text: str | None, buckets: int) -> tuple[np.ndarray, int]:
    """How often each bucket's features occur in a text, and its words."""
    total, n_words, last = np.zeros(buckets, np.int64), 0, []
    for words in windows((text or "").encode()):
        hashes = list(map(crc32, words))
        if words:
            joined = [*last, *hashes]  # of the word before, that of the pair goes on from there
            pairs = list(map(crc32, words[len(words) - len(joined) + 1 :], map(crc32, repeat(b" "), joined[:-1])))
            total += np.bincount(np.array(hashes + pairs, np.int64) % buckets, minlength=buckets)
            n_words, last = n_words + len(words), hashes[-1:]
    return total, n_words


def matrix(docs: DataFrame, key: Column, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``BLOCKS`` rows of the sparse counts of docs (key, text), written to the shared folder."""

    def block(ids: list, words: list[int], rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        where, values = zip(*rows, strict=True)
        packed = [np.r_[0, np.cumsum([len(w) for w in where])], np.concatenate(where), np.concatenate(values)]
        columns = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, [int(x.sum()) for x in values])]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in packed)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, words, rows, entries = [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                row, n = counts(text.as_py(), buckets)
                where = np.flatnonzero(row)
                ids.append(doc)
                words.append(n)
                rows.append((where, row[where]))
                entries += len(where)
                if entries >= BLOCK_ENTRIES:
                    yield block(ids, words, rows)
                    ids, words, rows, entries = [], [], [], 0
            if ids:
                yield block(ids, words, rows)

    return stored(docs.select(key.cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCKS), name)


def unpacked(numbers: pa.Scalar) -> np.ndarray:
    return np.frombuffer(numbers.as_buffer(), "<i4")


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket: partial sums of each task, then a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for index, n in zip(batch.column("bucket"), batch.column("n"), strict=True):
                np.add.at(total, unpacked(index), unpacked(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in blocks.select("bucket", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floored thousandths of the logarithm of its smoothed share in the target over that in the corpus."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the blocks times the gains, by the number of features, rounded down."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1) for i in range(whole.num_rows)):
                index, starts, n = (unpacked(batch.column(c)[0]) for c in ("bucket", "row_starts", "n"))
                products = np.r_[0, np.cumsum(n * sent.value[index])]
                features = batch.column("n_features").flatten().to_numpy()
                weight = (products[starts[1:]] - products[starts[:-1]]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").flatten(), batch.column("n_words").flatten(), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in floored thousandths from a hash of the seed and the id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn), one per row of docs (doc_id, text). target: text."""
    blocks = matrix(docs, F.col("doc_id"), "feature-blocks", buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(matrix(target, F.lit(None), "target-blocks", buckets), buckets))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("unfit", ((F.col("n_words") < least_words) | F.col("doc_id").isNull()).cast("int"))
    placed = ranked(scored, "unfit", F.desc("score"), F.col("doc_id"), F.col("weight"), F.col("n_features"), name="scored-documents")
    fit = placed.agg(F.count_if(F.col("unfit") == 0)).first()[0]
    drawn = (F.col("unfit") == 0) & (F.col("rank") <= percent * fit // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))

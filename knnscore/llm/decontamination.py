"""Benchmark decontamination: which documents hold which test items.

Items are partitioned by size (their number of distinct five-word shingles, in powers of two). The MinHash
sketch of an item is the k least hashes of its shingles, k = largest size of the class - ceil(t * that) + 1, exactly:
an item with containment t or more misses fewer than k shingles, so at least one of the sketch is in the
document and the search loses nothing, however long the document. Candidates are verified by exact
containment of the shingles' words. Documents are scanned in place: no shuffle.

Items are sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters; more items mean more passes.

Defined results: items under five words are one shingle of all their words; items and documents without words
match nothing; null ids are kept; repeated rows give repeated results; items of equal text each match; a very long
text is one set of shingles in its task, in memory proportional to its length; empty tables give no row; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import pieces
from .shingles import WORD, WordHashes, by_text, shingle_hashes

SIZE, CONTAINMENT = 5, 0.8
BLOCK_CHARS = 4_000_000
FOUND = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def grams(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(size)), strict=False))


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that is the threshold or more; the threshold is the decimal number that is written, so that 12 of 15 are 0.8."""
    return math.ceil(Fraction(str(threshold)) * n)


class Sketches:
    """Of each size of shingle: the sorted sketch hashes with their items; of each item its shingles."""

    def __init__(self, items: list[tuple[int | None, str]], threshold: float) -> None:
        hashes, self.items = WordHashes(), []
        found: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            size = min(SIZE, len(words))
            own = np.unique(shingle_hashes(hashes.of([text])[0], size))
            largest = (1 << len(own).bit_length()) - 1
            k = largest - needed(largest, threshold) + 1
            found.setdefault(size, []).extend((h, len(self.items)) for h in own[:k].tolist())
            self.items.append((item_id, size, grams(words, size)))
        self.index = {}
        for size, pairs in found.items():
            keys = np.array([h for h, _ in pairs], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.index[size] = keys[order], np.array([i for _, i in pairs])[order]

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a sketch hash."""
        out: set[tuple[int, int]] = set()
        for size, (keys, items) in self.index.items():
            hashes, owner = by_text(words, bounds, size)
            low = np.searchsorted(keys, hashes)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == hashes)
            high = np.searchsorted(keys, hashes[hit], "right")
            for text, a, b in zip(owner[hit].tolist(), low[hit].tolist(), high.tolist(), strict=True):
                out.update((text, i) for i in items[a:b].tolist())
        return out


def verified(batch: pa.RecordBatch, sketches: Sketches, hashes: WordHashes, threshold: float) -> Iterator[tuple[int, int | None, int, int]]:
    """(row of the batch, item id, shingles of the item, those found) of each pair that exact containment confirms."""
    texts = batch.column("text").to_pylist()
    of_text: dict[tuple[int, int], set] = {}
    for text, i in sorted(sketches.candidates(*hashes.of(texts))):
        item_id, size, wanted = sketches.items[i]
        if (text, size) not in of_text:
            of_text = {k: v for k, v in of_text.items() if k[0] == text}  # one text's at a time
            of_text[text, size] = grams(WORD.findall(texts[text].lower()), size)
        n = len(wanted & of_text[text, size])
        if n >= needed(len(wanted), threshold):
            yield text, item_id, len(wanted), n


def find_block(docs: DataFrame, items: list[tuple[int | None, str]], threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, hashes = Sketches(sent.value, threshold), WordHashes()
        for batch in pieces(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[text], item, size, n, n / size) for text, item, size, n in verified(batch, sketches, hashes, threshold)]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def drop_block(docs: DataFrame, items: list[tuple[int | None, str]], threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, hashes = Sketches(sent.value, threshold), WordHashes()
        for batch in pieces(batches, "text"):
            bad = {row for row, *_ in verified(batch, sketches, hashes, threshold)}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks whose characters are bounded."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(2 * chars / BLOCK_CHARS))
    items = benchmark.select("item_id", "text")
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.expr(f"pmod(xxhash64(item_id, text), {n_blocks})") == b)
        yield [tuple(row) for row in block.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``FOUND`` rows: each (document, item) whose containment is at least the threshold."""
    return reduce(DataFrame.unionByName, (find_block(docs, items, threshold) for items in item_blocks(benchmark)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of docs that hold no item, all columns as they are."""
    return reduce(lambda left, items: drop_block(left, items, threshold), item_blocks(benchmark), docs)

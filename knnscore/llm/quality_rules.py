"""Quality rules with compression bands: base counts and zstandard ratios of whole texts and fixed chunks.

A text's ratio is its UTF-8 bytes over its zstandard bytes. Repetitive text has a high ratio, noise a low
one; both depend on length, so the limits do. Each fixed chunk is held against the limits of its own length,
and a text falls when more than ``bad_chunks`` of its bytes lie in chunks outside them.

Defined results: a null or empty text has no words and fails the base rules; repeated rows give repeated
results; a ratio at a limit is inside, and a share of bad chunks at its limit is kept; a long text is read whole, chunk
by chunk; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from ._shared import pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
RULED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length in bytes: (least length, lowest ratio, highest ratio), lengths ascending."""

    document: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 99.0),
        (200, 1.1, 2.1),
        (500, 1.2, 2.15),
        (1_000, 1.3, 2.3),
        (2_000, 1.4, 2.4),
        (4_000, 1.5, 2.5),
        (8_000, 1.6, 2.6),
        (16_000, 1.7, 2.8),
        (64_000, 1.7, 3.3),
    )
    chunk: tuple[tuple[int, float, float], ...] = ((0, 0.0, 99.0), (500, 1.2, 2.2), (1_000, 1.3, 2.3), (2_000, 1.4, 2.4), (4_000, 1.5, 2.4))
    chunk_bytes: int = 4096
    bad_chunks: float = 0.5
    level: int = 3

    def inside(self, size: int, ratio: float, table: tuple[tuple[int, float, float], ...]) -> bool:
        low, high = next((lo, hi) for least, lo, hi in reversed(table) if size >= least)
        return low <= ratio <= high


def repeat_words(words: list[str], n: int = 3) -> int:
    """Words in windows of n words that occur twice or more, first occurrences included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, total = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += min(n, i + n - covered)
            covered = i + n
    return total


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    duplicate = 0
    for line in text.split("\n"):
        if line in seen:
            duplicate += 1
        elif WORD.search(line):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate, repeat_words(words)


def chunk_share(data: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> float:
    """Share of the bytes in chunks whose ratio is outside the limits of their length."""
    bad = 0
    for i in range(0, len(data), bands.chunk_bytes):
        part = data[i : i + bands.chunk_bytes]
        if not bands.inside(len(part), len(part) / len(squeeze.compress(part)), bands.chunk):
            bad += len(part)
    return bad / max(1, len(data))


def judge(text: str | None, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple:
    n_words, chars, symbols, duplicate, repeated = base_counts(text)
    failed = n_words < 50 or 100 * repeated > 50 * n_words
    data = (text or "").encode()
    ratio = len(data) / len(squeeze.compress(data))
    share = chunk_share(data, bands, squeeze)
    kept = not failed and bands.inside(len(data), ratio, bands.document) and share <= bands.bad_chunks
    return n_words, chars, symbols, duplicate, repeated, ratio, share, failed, kept


def rule(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """``RULED`` rows, one per row of docs (doc_id, text). No shuffle: each task judges its own rows."""
    bands = bands or Bands()
    names = [x.split()[0] for x in RULED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in pieces(batches, "text"):
            rows = [judge(x.as_py(), bands, squeeze) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, RULED)


def keep(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are."""
    bands = bands or Bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.array([judge(x.as_py(), bands, squeeze)[-1] for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

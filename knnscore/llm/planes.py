"""Columns of numbers, and bytes, as one compressed value for rows that go packed through a shuffle.

Numbers are parted into planes (the lowest byte of each, then the next), each compressed by itself: the higher bytes of
ids and places nearly vanish, and those of hashes stay as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import zstandard

FEW = 64  # values; of fewer the planes stand as they are, without their lengths


@functools.cache
def _squeeze() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _stretch() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeezed(data: bytes) -> bytes:
    return _squeeze().compress(data)


def stretched(data: bytes) -> bytes:
    return _stretch().decompress(data)


def pack(columns: Sequence[np.ndarray], rest: bytes = b"") -> bytes:
    """Columns of one length, and further bytes."""
    n = len(columns[0])
    planes = [p.tobytes() for c in columns for p in np.ascontiguousarray(c).view(np.uint8).reshape(n, c.dtype.itemsize).T]
    head = [n]
    if n >= FEW:
        planes = [min(p, squeezed(p), key=len) for p in planes]  # as long as n: not compressed
        head += map(len, planes)
    return np.array(head, "<u4").tobytes() + b"".join(planes) + (squeezed(rest) if rest else b"")


def unpack(blob: bytes, kinds: Sequence[np.dtype]) -> tuple[list[np.ndarray], bytes]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    n_planes = sum(k.itemsize for k in kinds)
    sizes, at = [n] * n_planes, 4
    if n >= FEW:
        sizes, at = np.frombuffer(blob, "<u4", n_planes, 4).tolist(), 4 + 4 * n_planes
    columns, sizes = [], iter(sizes)
    for kind in kinds:
        planes = np.empty((n, kind.itemsize), np.uint8)
        for k in range(kind.itemsize):
            size = next(sizes)
            plane = blob[at : at + size]
            planes[:, k] = np.frombuffer(plane if size == n else stretched(plane), np.uint8)
            at += size
        columns.append(planes.view(kind)[:, 0])
    return columns, stretched(blob[at:]) if at < len(blob) else b""

"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged numpy arrays.

Texts are cut at special strings and into pre-tokens by the vocabulary's pattern. Distinct pre-tokens that a
task hasn't seen are held as one flat array of symbols with sequence numbers. In each round every sequence
finds its lowest-ranked adjacent pair and all its occurrences are merged at once (leftmost first where they
overlap); sequences without a pair leave. What counts is the number of surviving symbols.

Sequences over ``LONG_BYTES`` would need as many passes over all their symbols as they have ranks. They are merged in
the same order, rank after rank for all of them at once, but only the places of that rank and their neighbours are
looked at: work grows with the number of merges. That needs pairs to rank above those that make their parts, which
``Merges`` checks.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; one
very long pre-token is merged in the same way, in memory proportional to its length; an empty table gives no
row; other columns are ignored. A vocabulary whose pre-tokenisation isn't byte-level with the fixed pattern raises.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._shared import pieces

#: Fixed value: the pattern of byte-level pre-tokenisation, public with its vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COUNTED = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
KEPT_PRETOKENS, LONG, LONG_BYTES = 200_000, 64, 512


NONE = np.int64(1 << 40)  # the rank of what is no pair


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """The merge table as sorted arrays: pair key to rank and merged symbol."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space", True) or spec.get("normalizer"):
            raise ValueError("only byte-level pre-tokenisation without prefix space and normaliser is known")
        if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only special strings that are taken as they stand are known")
        vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[x] for x in byte_letters()], np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pair = dict(enumerate(self.merged.tolist()))
        made = {a + b: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        if any(made.get(part, -1) >= rank for rank, pair in enumerate(pairs) for part in pair):
            raise ValueError("a pair ranks before one of its parts")
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each of the sequences."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        long = np.flatnonzero(lengths > LONG_BYTES)
        if not len(long):
            return self.count_short(tokens)
        counts = np.zeros(len(tokens), np.int64)
        short = np.flatnonzero(lengths <= LONG_BYTES)
        if len(short):
            counts[short] = self.count_short([tokens[i] for i in short.tolist()])
        counts[long] = self.count_long([tokens[i] for i in long.tolist()])
        return counts

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count_long(self, tokens: list[bytes]) -> np.ndarray:
        """As ``count_short``: ranks in ascending order, and for each the places that have it."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(symbols)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1], before[ends - lengths] = -1, -1
        rank = np.full(n, NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def renew(places: np.ndarray) -> None:
            """Ranks of the pairs that begin there."""
            following = after[places]
            found = np.where(following >= 0, self.ranks_of(symbols[places], symbols[following]), NONE)
            rank[places] = found
            places, found = places[found < NONE], found[found < NONE]
            by = np.argsort(found, kind="stable")
            places, found = places[by], found[by]
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            for r, part in zip(found[first].tolist(), np.split(places, first[1:]) if len(first) else (), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(order, r)
                waiting[r].append(part)

        renew(np.arange(n))
        counts = lengths.copy()
        while order:
            r = heapq.heappop(order)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[rank[places] == r]
            if not len(places):
                continue
            run = np.r_[True, after[places[:-1]] != places[1:]]
            first = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - first) % 2 == 0]
            gone = after[places]
            rest = after[gone]
            symbols[places] = self.pair[r]
            rank[gone] = NONE
            after[places] = rest
            before[rest[rest >= 0]] = places[rest >= 0]
            counts -= np.bincount(owner[places], minlength=len(counts))
            left = before[places]
            renew(np.unique(np.r_[places, left[left >= 0]]))
        return counts

    def count_short(self, tokens: list[bytes]) -> np.ndarray:
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        counts = lengths.copy()
        none = NONE
        while len(symbols) > 1:
            key = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            hit = np.flatnonzero(rank == np.repeat(np.where(least == none, -1, least), sizes)[:-1])
            if not len(hit):
                break
            # of hits that overlap, every second one is merged, from the left
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            np.subtract.at(counts, owner[hit], 1)
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            keep &= np.repeat(least != none, sizes)  # sequences without a pair are done
            symbols, owner = symbols[keep], owner[keep]
        return counts


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens seen, up to ``KEPT_PRETOKENS``."""

    def __init__(self, definition: str) -> None:
        self.merges = Merges(definition)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.specials, key=len, reverse=True)))) if self.merges.specials else None
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT_PRETOKENS:
            self.known.clear()
        totals, split = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            totals.append(len(parts) - 1)
            split.append([token for part in parts for token in self.pattern.findall(part)])
        known = self.known
        fresh = list({t for tokens in split for t in tokens} - known.keys())
        fresh.sort(key=len)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            known.update(zip(part, self.merges.count([t.encode() for t in part]).tolist(), strict=True))
        counts = [n + sum(map(known.__getitem__, tokens)) for n, tokens in zip(totals, split, strict=True)]
        for token in fresh:
            if len(token) > LONG:  # not worth their memory
                del known[token]
        return counts


def count_tokens(docs: DataFrame, definition: str, limit: int = 512) -> DataFrame:
    """``COUNTED`` rows of docs (doc_id, text). definition: the vocabulary's JSON, read by the driver; its size doesn't grow with the data."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in pieces(batches, "text"):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            counts = np.array(counter(texts), np.int64)
            sizes = np.array([len(x.encode()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)

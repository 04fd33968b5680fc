"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

Compiled once from the model file into arrays: the normaliser (what each state writes for a space and for other
bytes), the trie of the pieces (one arc for each state and symbol, a state's piece as its output), and byte fallback,
arcs over one character that no piece covers, whose output is its byte pieces. A batch of words is composed with them
at once: from every position the trie is walked along the text, which gives a lattice of arcs (begin, end, piece).
Shortest paths come from one pass over the lattice in the tropical (min, +) semiring: the words of a batch go in step,
by the distance of an arc's end from its word's beginning; words of more than ``LONG`` characters go one by one.

Unigram models weigh an arc by minus its piece's score. Byte-pair models have no additive weights; there the
state also remembers the last piece, and an arc weighs 0 if the two pieces may stand side by side, infinity
otherwise. They may if merging their joined text in score order never merges across the boundary. Exactly one
path has weight 0, and it is the library's result (a merge across a boundary depends on nothing outside the
two pieces). As the same holds for each prefix, one last piece a position has a finite weight and is kept.
Both kinds are tested against the library.

As no piece has a character before a white-space mark, the input is composed word by word; each different word of a
batch is composed once, and words that a task has seen are kept.

Defined results: null and empty texts have no pieces; very long texts, also without a space, are composed whole, in
windows of bounded memory; decoding turns white-space marks that stand in the text itself into spaces; repeated rows
give repeated results; equal weights go to the arc that begins first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import gc
import re
import struct
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._shared import pieces

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: kinds of pieces in model files
UNIGRAM, BPE = 1, 2
KEPT_WORDS, KEPT_PAIRS, LONG, WINDOW = 500_000, 500_000, 64, 50_000
IN_STEP, SLOT_BITS = 200_000, 20  # characters of words that go in step; a table of 2^20 pairs
INFINITY = float("inf")
END = (-INFINITY, "", "")
BREAK = 0x110000  # stands after each word; no character has this number
SPACE = 32  # stands for the white-space mark inside
ENCODED = "doc_id long, n_chars long, n_pieces long, ids array<int>, round_trip boolean"


def texts_of(data: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def bytes_of(texts: pa.StringArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each value begins."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and raw values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Transducer:
    def __init__(self, model: bytes) -> None:
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, self.squeeze, self.fallback, self.unknown = UNIGRAM, True, True, False, 0
        for field, value in fields(model):
            if field == 1:
                piece = dict(fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(fields(value))
                self.type, self.fallback, self.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            elif field == 3:
                normaliser = dict(fields(value))
                self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
                if normaliser.get(2) or not normaliser.get(5, 1):
                    raise ValueError("only normalisers without a character map are compiled")
        if self.type not in (UNIGRAM, BPE) or {USER, UNUSED} & {*self.kinds}:
            raise ValueError("only unigram and byte-pair models without user-defined or unused pieces are compiled")
        numbered = list(zip(self.texts, self.kinds, strict=True))
        self.bytes = {int(t[1:-1], 16): i for i, (t, k) in enumerate(numbered) if k == BYTE}
        self.out = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else t.replace(MARK, " ").encode() for t, k in numbered]
        self.written = pa.array(self.out, pa.binary())
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", t) for t, k in numbered if k == NORMAL)
        self.texts = [t.replace(MARK, " ") for t in self.texts]
        self.score = {t: s for t, s, k in zip(self.texts, self.scores, self.kinds, strict=True) if k == NORMAL}
        self.sizes = [len(t) for t in self.texts]
        self.piece_size = np.array(self.sizes or [0])
        self.first_character = len(self.texts)  # labels from here on are characters that no piece covers
        self.start = self.first_character + BREAK  # the label before a word
        self.compile_normaliser()
        self.compile_pieces()
        self.derived: dict[int, tuple | None] = {}
        self.pairs: dict[int, float] = {}
        self.slot_key, self.slot_fits = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, bool)
        self.known: dict[str, tuple[int, ...]] = {}

    def compile_normaliser(self) -> None:
        """Arcs by 2 x state + is a space: how many marks they write first, and whether they copy the byte. States: nothing written yet, after other bytes, after a space."""
        prefix = int(self.prefix)
        if self.squeeze:  # a run of spaces writes one mark, before what follows it
            self.marks = np.array([prefix, 0, 0, 0, 1, 0], np.int8)
            self.copies = np.array([1, 0, 1, 0, 1, 0], np.int8)
        else:
            self.marks = np.array([prefix, prefix, 0, 0, 0, 0], np.int8)
            self.copies = np.ones(6, np.int8)

    def compile_pieces(self) -> None:
        """The trie as sorted keys (state x symbols + symbol), where each arc leads, and the piece and weight of each state and label."""
        self.alphabet = np.array(sorted({ord(c) for t in self.score for c in t} or {SPACE}), np.int64)
        symbols = {chr(c): i for i, c in enumerate(self.alphabet, 1)}
        arcs: dict[int, int] = {}
        ends = {}
        self.n_symbols = len(symbols) + 1
        for i, (text, kind) in enumerate(zip(self.texts, self.kinds, strict=True)):
            if kind == NORMAL:
                state = 0
                for c in text:
                    state = arcs.setdefault(state * self.n_symbols + symbols[c], len(arcs) + 1)
                ends[state] = i
        self.arc_key = np.array(sorted(arcs) or [-1], np.int64)
        self.arc_to = np.array([arcs.get(k, 0) for k in self.arc_key.tolist()], np.int64)
        self.piece = np.full(len(arcs) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.score), default=1)
        self.piece_weight = -np.array(self.scores or [0.0])
        self.fallback_weight = 10 - min(self.score.values(), default=0)

    def normalise(self, texts: pa.StringArray) -> pa.StringArray:
        """Texts without nulls composed with the normaliser; marks are written as spaces."""
        data, bounds = bytes_of(texts)
        space = data == SPACE
        moved = np.r_[0, np.cumsum(~space)] if self.squeeze else np.arange(len(data) + 1)
        state = 1 + np.r_[False, space[:-1]].astype(np.int8) if len(data) else np.zeros(0, np.int8)
        state[moved[:-1] == np.repeat(moved[bounds[:-1]], np.diff(bounds))] = 0
        arc = 2 * state + space
        marks, copies = self.marks[arc], self.copies[arc]
        ends = np.r_[0, np.cumsum(marks + copies, dtype=np.int64)]
        written = np.full(ends[-1], SPACE, np.uint8)
        copied = copies > 0
        written[ends[1:][copied] - 1] = data[copied]
        return pc.replace_substring(texts_of(written, ends[bounds]), MARK, " ")

    def text_of(self, label: int) -> str:
        return self.texts[label] if label < self.first_character else chr(label - self.first_character)

    def derive(self, label: int) -> tuple | None:
        """How merging makes a piece of its characters: (score, leftmost part, rightmost part) after each merge; None if it doesn't."""
        if label in self.derived:
            return self.derived[label]
        parts, steps, score = list(self.text_of(label)), [], self.score
        while len(parts) > 1:
            best, at = max((score.get(a + b, -INFINITY), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == -INFINITY:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
            steps.append((best, parts[0], parts[-1]))
        self.derived[label] = out = (*steps, END) if len(parts) == 1 else None
        return out

    def side_by_side(self, before: int, label: int) -> float:
        """The weight of a byte-pair model's arc after another: 0 if merging the joined text of both leaves exactly these two, else infinity."""
        steps = self.derive(label)
        fits = steps is not None and (before == self.start or self.adjacent(before, label))
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[before * (self.start + 1) + label] = weight = 0.0 if fits else INFINITY
        return weight

    def adjacent(self, a: int, b: int) -> bool:
        left, right, x, y, score = iter(self.derive(a)), iter(self.derive(b)), self.text_of(a)[-1], self.text_of(b)[0], self.score
        (here, _, next_x), (there, next_y, _) = next(left), next(right)
        while True:
            across = score.get(x + y)
            if across is not None and across > here and across >= there:  # of equals the leftmost is first
                return False
            if here >= there:
                if here == -INFINITY:
                    return True
                x = next_x
                here, _, next_x = next(left)
            else:
                y = next_y
                there, next_y, _ = next(right)

    def lattice(self, codes: np.ndarray, symbols: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, ...]:
        """The input composed with pieces and fallback: (begin, end, label, weight) of all arcs that end in (begin, end], by end, then begin."""
        first = max(0, begin + 1 - self.longest)
        at, state = np.arange(first, end), np.zeros(end - first, np.int64)
        uncovered = codes[first:end] != BREAK
        arcs = []
        for depth in range(self.longest):
            key = state * self.n_symbols + symbols[at + depth]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            on = self.arc_key[arc] == key
            at, state = at[on], self.arc_to[arc[on]]
            label = self.piece[state]
            final = label >= 0
            arcs.append((at[final], at[final] + depth + 1, label[final], self.piece_weight[label[final]]))
            if depth == 0:
                uncovered[at[final] - first] = False
            inside = at + depth + 1 < end
            at, state = at[inside], state[inside]
            if not len(at):
                break
        lone = np.flatnonzero(uncovered) + first
        arcs.append((lone, lone + 1, self.first_character + codes[lone], np.full(len(lone), self.fallback_weight)))
        begins, ends, labels, weights = map(np.concatenate, zip(*arcs, strict=True))
        order = np.lexsort((begins, ends))
        order = order[np.searchsorted(ends[order], begin, "right") :]
        return begins[order], ends[order], labels[order], weights[order]

    def shortest_paths(self, words: list[str]) -> list[list[int]]:
        """The labels along each word's path of least weight. Words up to ``LONG`` characters go in step, a longer one by itself."""
        paths: list[list[int]] = [[]] * len(words)
        short: list[int] = []
        held = 0
        for i, word in enumerate(words):
            if len(word) > LONG:
                paths[i] = self.path_of(word)
                continue
            short.append(i)
            held += len(word) + 1
            if held >= IN_STEP:
                self.paths_in_step(words, short, paths)
                short, held = [], 0
        if short:
            self.paths_in_step(words, short, paths)
        return paths

    def coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and symbols of words one after the other, a break behind each, which no arc crosses, and where the breaks are."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        breaks = np.cumsum(sizes + 1) - 1
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        codes[breaks] = BREAK
        symbols = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return codes, np.where(self.alphabet[symbols] == codes, symbols + 1, 0), breaks

    def paths_in_step(self, words: list[str], chosen: list[int], paths: list[list[int]]) -> None:
        """Fills in the paths of the chosen words: (min, +) over the arcs of all of them that end at the same distance from their word's beginning, distance by distance."""
        codes, symbols, breaks = self.coded([words[i] for i in chosen])
        starts = np.r_[0, breaks[:-1] + 1]
        first = np.repeat(starts, breaks + 1 - starts)
        begins, ends, labels, weights = self.lattice(codes, symbols, -1, len(codes) - 1)
        depth = ends - first[begins]
        order = np.argsort((depth * len(codes) + ends) * (self.longest + 1) + self.longest - (ends - begins))
        begins, ends, labels, weights, depth = (x[order] for x in (begins, ends, labels, weights, depth))
        least, last = np.full(len(codes), INFINITY), np.full(len(codes), self.start)
        least[starts] = 0
        bounds = np.flatnonzero(np.diff(depth, prepend=0, append=depth[-1] + 1 if len(depth) else 1)).tolist()
        for low, high in pairwise(bounds):
            start, end, label = begins[low:high], ends[low:high], labels[low:high]
            total = least[start] + (self.side_by_side_all(last[start], label) if self.type == BPE else weights[low:high])
            group = np.flatnonzero(np.diff(end, prepend=-1))
            lowest = np.minimum.reduceat(total, group)
            at_least = np.flatnonzero(total == np.repeat(lowest, np.diff(group, append=len(end))))
            won = at_least[np.flatnonzero(np.diff(end[at_least], prepend=-1))]  # of equals the one that begins first
            won = won[total[won] < INFINITY]
            least[end[won]] = total[won]
            last[end[won]] = label[won]
        word, at, backwards, owners = np.arange(len(chosen)), breaks, [], []
        while True:
            inside = at > starts[word]
            word, at = word[inside], at[inside]
            if not len(word):
                break
            label = last[at]
            backwards.append(label)
            owners.append(word)
            at = at - np.where(label < self.first_character, self.piece_size[np.minimum(label, self.first_character - 1)], 1)
        if not owners:
            return
        owner = np.concatenate(owners)[::-1]
        order = np.argsort(owner, kind="stable")
        labels, cuts = np.concatenate(backwards)[::-1][order], np.searchsorted(owner[order], np.arange(len(chosen) + 1)).tolist()
        flat = labels.tolist()
        for i, (a, b) in zip(chosen, pairwise(cuts), strict=True):
            paths[i] = flat[a:b]

    def side_by_side_all(self, before: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """``side_by_side`` of many arcs: from the table of a slot for each key's hash where the slot holds the pair, which it does afterwards."""
        keys = before * (self.start + 1) + labels
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        weights = np.where(self.slot_fits[slots], 0.0, INFINITY)
        missing = np.flatnonzero(self.slot_key[slots] != keys)
        if len(missing):
            different, of = np.unique(keys[missing], return_inverse=True)
            found = np.empty(len(different))
            for i, key in enumerate(different.tolist()):
                weight = self.pairs.get(key)
                found[i] = self.side_by_side(*divmod(key, self.start + 1)) if weight is None else weight
            weights[missing] = found[of]
            slot, chosen = np.unique(slots[missing], return_index=True)  # of several pairs of a slot one is kept
            self.slot_key[slot] = keys[missing[chosen]]
            self.slot_fits[slot] = weights[missing[chosen]] == 0
        return weights

    def path_of(self, word: str) -> list[int]:
        """The labels along the path of least weight of one word of any length, in windows."""
        codes, symbols, breaks = self.coded([word])
        least, last = np.full(len(codes), INFINITY), np.full(len(codes), self.start)
        least[0] = 0
        weight, label_of = array("d", least.tobytes()), array("q", last.astype(np.int64).tobytes())
        by_pair, pairs, n_labels = self.type == BPE, self.pairs, self.start + 1
        for begin in range(0, len(codes), WINDOW):
            arcs = self.lattice(codes, symbols, begin - 1, min(begin + WINDOW, len(codes)) - 1)
            for start, end, label, more in zip(*[x.tolist() for x in arcs], strict=True):
                if by_pair:
                    if weight[end] == 0:  # no path weighs less
                        continue
                    before = label_of[start]
                    more = pairs.get(before * n_labels + label)
                    if more is None:
                        more = self.side_by_side(before, label)
                total = weight[start] + more
                if total < weight[end]:
                    weight[end] = total
                    label_of[end] = label
        lengths, first_character = self.sizes, self.first_character
        path, end = [], int(breaks[0])
        while end > 0:
            label = label_of[end]
            path.append(label)
            end -= lengths[label] if label < first_character else 1
        path.reverse()
        return path

    def emit(self, path: list[int]) -> tuple[int, ...]:
        """The output labels of a path: pieces, the bytes of other characters, or one unknown piece for a run of them."""
        if max(path, default=0) < self.first_character:
            return tuple(path)
        out: list[int] = []
        for label in path:
            if label < self.first_character:
                out.append(label)
            elif self.fallback:
                out += [self.bytes[b] for b in self.text_of(label).replace(" ", MARK).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words of normalised texts, in order, and the number of words before each text. A word is a run of marks and what follows to the next mark."""
        data, bounds = bytes_of(texts)
        begins = np.zeros(len(data) + 1, bool)
        if self.by_word:
            space = data == SPACE
            begins[1:-1] = space[1:] & ~space[:-1]
        begins[bounds] = True
        at = np.flatnonzero(begins)
        return texts_of(data, at), np.searchsorted(at, bounds)

    def encode_column(self, texts: pa.StringArray) -> pa.ListArray:
        """Pieces of normalised texts."""
        words, bounds = self.words(texts)
        words = words.dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        fresh = [x for x in different if x not in self.known]
        self.known.update(zip(fresh, map(self.emit, self.shortest_paths(fresh)), strict=True))
        paths = list(map(self.known.__getitem__, different))
        for word in fresh:
            if len(word) > LONG:  # not worth their memory
                del self.known[word]
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = pa.array(np.fromiter(chain.from_iterable(paths), np.int32, sizes.sum()))
        of_word = words.indices.to_numpy()
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat).take(words.indices)
        before = np.r_[0, np.cumsum(sizes[of_word])]
        return pa.ListArray.from_arrays(pa.array(before[bounds].astype(np.int32)), ids.flatten())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Pieces of each text."""
        return self.encode_column(self.normalise(pa.array([t or "" for t in texts], pa.string()))).to_pylist()

    def round_trips(self, ids: pa.ListArray, normalised: pa.StringArray) -> pa.BooleanArray:
        """Whether the pieces of each text write exactly the normalised text."""
        data, ends = bytes_of(self.written.take(ids.flatten()))
        bounds = ends[ids.offsets.to_numpy()]
        return pc.equal(texts_of(data, bounds).view(pa.binary()), normalised.view(pa.binary()))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the search for reference cycles: there are none, and each one would visit all words kept."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(maxsize=1)
def compiled(model: bytes) -> Transducer:
    """The transducer of a model; a worker that runs several tasks keeps it with the words it has seen."""
    return Transducer(model)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``ENCODED`` rows of docs (doc_id, text). model: the model file's bytes, read by the driver; their size doesn't grow with the data."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(sent.value)
        for batch in pieces(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            normalised = machine.normalise(texts)
            with no_cycles():
                ids = machine.encode_column(normalised)
            columns = [batch.column("doc_id"), pc.utf8_length(texts).cast(pa.int64()), pc.list_value_length(ids).cast(pa.int64()), ids, machine.round_trips(ids, normalised)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ENCODED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(sent.value)
        for batch in batches:
            texts = [machine.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

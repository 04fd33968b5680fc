"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, verified multiset overlap, classes.

A document is the multiset of its five-word shingles, weighted by their counts. For each shingle a Poisson
process runs over (time, weight level, slot); weight levels are split into dyadic shells (0,1], (1,2], (2,4],
(4,8], ... with a process each, and inside a shell a point counts if its level is below the weight, so that
equal parts of two weights see equal points. A slot keeps its earliest point; a shell's process stops at the
document's latest slot. Two documents agree in a slot with probability equal to their weighted Jaccard
similarity (sum of minima over sum of maxima).

Documents of equal words collapse first. Bands of ``ROWS`` slots deal the rest into buckets. In a bucket every
document is compared with one centre, which is the same for most buckets of a document; verified links join
components. Members of buckets that then hold several components meet on their rarest shingles: all of different
components that share one are compared. That join loses no link, whatever the size of a bucket (``prefix_pairs``).
Rounds before it, in which few documents stand for each component that holds a shingle, join most components that
belong together and so make it small, as pairs of one component are never made; they change no result. There is
one way for buckets and shingles of all sizes. Hot digests, buckets and shingles are joins of two written tables, whose
large partitions adaptive execution splits. Only documents that share a bucket are looked at again; their multisets
are sent once as sets in which a shingle stands once for each occurrence, so that overlaps are counts of equal hashes.

Defined results: documents without words (null, empty) are a class each; under five words the whole is one
shingle; rows sharing an id are one document; a null id has a null class unless a row of equal words has an
id; an empty table gives no row; a very long text is handled whole in one
task, in memory proportional to its length; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dealt_by, lists, pieces, stored
from .components import ROWS_A_TASK, components, joined_by
from .shingles import FACTOR, WordHashes, by_text, mix, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
PAIRS_A_TASK = 5_000
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**24 < 4e-6
SLOTS = BANDS * ROWS
COUNTER_BITS = 20  # counters that order shingles by rarity
DRAWS = 1, 8  # documents of a shingle and component in each round before all that are left are compared; they change the work and not the result
TOKENS_AT_ONCE = 1_000_000
MARKS = 4  # 64-bit words of a set's parity bits
SIGNED = "doc_id long, digest binary, bands array<long>"


def multisets(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, count, text; texts ascending."""
    hashes, owner = by_text(words, bounds, SIZE)
    short = np.flatnonzero((np.diff(bounds) < SIZE) & (np.diff(bounds) > 0))
    if len(short):
        extra = [shingle_hashes(words[bounds[i] : bounds[i + 1]], bounds[i + 1] - bounds[i])[0] for i in short]
        hashes, owner = np.r_[hashes, np.array(extra, np.uint64)], np.r_[owner, short]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.r_[first, len(hashes)]), owner[first]


def shells(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """A process for each shell that a weight reaches: seed, least level, size, weight, text."""
    parts, low, size, number = [], 0, 1, 0
    while len(hashes):
        n = len(hashes)
        seed = mix(hashes ^ mix(np.full(1, number + 1, np.uint64)))
        parts.append((seed, np.full(n, float(low)), np.full(n, float(size)), weights, owner))
        low, size, number = low + size, max(1, low + size), number + 1
        keep = weights > low
        hashes, weights, owner = hashes[keep], weights[keep], owner[keep]
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def signatures(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """Times of the earliest points: a row of slots per text (infinity for texts without shingles)."""
    times = np.full((n_texts, slots), np.inf)
    if not len(hashes):
        return times
    seed, low, size, weight, text = shells(hashes, weights, owner)
    now, step = np.zeros(len(seed)), 0
    flat = times.reshape(-1)
    while len(seed):
        step += 1
        r = mix(seed + np.uint64(step * int(FACTOR) % (1 << 64)))
        u = ((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40
        now = now - np.log(u) / (slots * size)
        slot = ((r & np.uint64(0xFFFFFF)) * np.uint64(slots) >> np.uint64(24)).astype(np.int64)
        partial = np.flatnonzero(low + size > weight)
        counts = np.ones(len(seed), bool)
        if len(partial):
            level = low[partial] + size[partial] * (mix(r[partial] ^ FACTOR) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            counts[partial] = level < weight[partial]
        at = (text * slots + slot)[counts]
        np.minimum.at(flat, at, now[counts])
        going = now < times.max(axis=1)[text] if step < 32 or step % 8 == 0 else np.ones(len(seed), bool)
        if not going.all():
            seed, low, size, weight, text, now = seed[going], low[going], size[going], weight[going], text[going], now[going]
    return times


def band_keys(times: np.ndarray) -> np.ndarray:
    """A key for each band of each text; keys of different bands differ."""
    bits = times.view(np.uint64).reshape(len(times), -1, ROWS)
    keys = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), bits.shape[:2])
    for k in range(ROWS):
        keys = mix(keys * FACTOR + bits[:, :, k])
    return keys.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """``SIGNED`` rows of docs (doc_id, text); digest is of the words, null for texts without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            words, bounds = hashes.of(batch.column("text").to_pylist())
            n = len(bounds) - 1
            digests = [xxhash.xxh3_128_digest(words[a:b].tobytes()) if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
            keys = band_keys(signatures(*multisets(words, bounds), n))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), bands], names=["doc_id", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def expanded(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each multiset as a set in which a shingle stands once for each occurrence: tokens of all texts, ascending in each; and where each text's begin."""
    hashes, counts, owner = multisets(words, bounds)
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = np.repeat(owner, counts).astype(np.int64)
    tokens = mix(np.repeat(hashes, counts) ^ mix(nth.astype(np.uint64))).view(np.int64)
    return tokens[np.lexsort((tokens, owner))], np.cumsum(np.r_[0, np.bincount(owner, minlength=len(bounds) - 1)])


def bags(texts: DataFrame) -> DataFrame:
    """rep, tokens of texts (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in pieces(batches, "text"):
            tokens, bounds = expanded(*hashes.of(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens))], names=["rep", "tokens"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, tokens array<long>")


def overlaps(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Of pairs of sets that stand one after the other in left and in right: how many values are in both."""
    pair = np.r_[np.repeat(np.arange(len(left_sizes)), left_sizes), np.repeat(np.arange(len(right_sizes)), right_sizes)]
    both = np.r_[left, right]
    order = np.lexsort((both, pair))
    pair, both = pair[order], both[order]
    return np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(left_sizes))


def verify(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold. held: rep, tokens."""
    left = held.select(F.col("rep").alias("a"), F.col("tokens").alias("of_a"))
    right = held.select(F.col("rep").alias("b"), F.col("tokens").alias("of_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            (left, a), (right, b) = lists(whole.column("of_a")), lists(whole.column("of_b"))
            ends = np.searchsorted(a + b, np.arange(TOKENS_AT_ONCE, a[-1] + b[-1] + TOKENS_AT_ONCE, TOKENS_AT_ONCE), "right") - 1
            for i, j in zip(cuts := np.unique(np.r_[0, ends, whole.num_rows]), cuts[1:], strict=False):
                n, m = np.diff(a[i : j + 1]), np.diff(b[i : j + 1])
                common = overlaps(left[a[i] : a[j]], n, right[b[i] : b[j]], m)
                yield whole.select(["a", "b"]).slice(i, j - i).filter(pa.array(common >= threshold * np.maximum(1, n + m - common) - 1e-9))

    return dealt_by(joined, pairs.count(), PAIRS_A_TASK).mapInArrow(run, "a long, b long")


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, rep, centre of the members of buckets that several representatives share; and a, b: each member with its centre. reps: rep, bands.

    The centre is the member of least hash, so the same documents are centres of most buckets that they are in, which makes few pairs.
    """
    rows = reps.select("rep", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.min(F.struct(F.xxhash64("rep"), "rep")).alias("least"))
    several = stored(several.where("low < high").select("key", F.col("least.rep").alias("centre")), "buckets")
    members = stored(rows.join(several, "key"), "members")
    pairs = members.where("rep <> centre").select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
    return members, pairs


def mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rep, component of the members of buckets that hold several components."""
    if labels is None:
        return members.select("rep", F.col("rep").alias("component")).distinct()
    marked = stored(members.join(labels, members.rep == labels.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "marked")
    keys = stored(marked.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "mixed")
    return marked.join(keys, "key").select("rep", "component").distinct()


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def token_counts(held: DataFrame) -> np.ndarray:
    """How many tokens of all sets fall on each counter: at least the number of sets that hold a token of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            counts += np.bincount(counter_of(lists(batch.column("tokens"))[0]), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["counter", "n"])

    found = held.select("tokens").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    counts[found.column("counter").to_numpy()] = found.column("n").to_numpy()
    return counts


def parities(tokens: np.ndarray, owner: np.ndarray, n_sets: int) -> np.ndarray:
    """``MARKS`` words for each set, each bit the parity of the tokens that fall on it: two sets differ in no more bits than in tokens."""
    bits = np.bincount(owner * (64 * MARKS) + (mix(tokens.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % (64 * MARKS), minlength=n_sets * 64 * MARKS) & 1
    return np.packbits(bits.reshape(n_sets, -1).astype(np.uint8), axis=1).view(np.int64)


def prefixes(held: DataFrame, threshold: float) -> DataFrame:
    """token, rep, size, place, marks (parities of the whole set): the first floor((1 - threshold) * size) + 1 tokens of each set, rarest first, without those that no other set has. held: rep, tokens."""
    sent = held.sparkSession.sparkContext.broadcast(token_counts(held))  # a number for each counter, however many sets there are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            tokens, bounds = lists(batch.column("tokens"))
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            marks = pa.ListArray.from_arrays(pa.array(np.arange(0, MARKS * len(sizes) + 1, MARKS, dtype=np.int32)), pa.array(parities(tokens, owner, len(sizes)).reshape(-1)))
            n = counts[counter_of(tokens)]
            order = np.lexsort((tokens, n, owner))
            tokens, n = tokens[order], n[order]
            place, size = np.arange(len(tokens)) - bounds[owner], sizes[owner]
            keep = (n > 1) & (size - place >= threshold * size - 1e-6)
            columns = [pa.array(tokens[keep]), batch.column("rep").take(pa.array(owner[keep])), pa.array(size[keep]), pa.array(place[keep]), marks.take(pa.array(owner[keep]))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "rep", "size", "place", "marks"])

    return held.select("rep", "tokens").mapInArrow(run, "token long, rep long, size long, place long, marks array<long>")


def still_mixed(rows: DataFrame) -> DataFrame:
    """The rows (token, component, ...) of tokens that several components hold."""
    several = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    return rows.join(stored(several, "tokens"), "token")


def can_link(threshold: float) -> str:
    """What follows the token is long enough in both sets (rows l and r) for the overlap; their parities differ in no more bits than such sets do in tokens; they are of different components."""
    differ = " + ".join(f"bit_count(l.marks[{i}] ^ r.marks[{i}])" for i in range(MARKS))
    return f"({differ}) * {1 + threshold} <= {1 - threshold} * (l.size + r.size) + 1e-6D AND l.component <> r.component AND least(l.size - l.place, r.size - r.place) * {1 + threshold} >= {threshold} * (l.size + r.size) - 1e-6D"


def chosen(shared: DataFrame, draws: int, threshold: float) -> DataFrame:
    """Of the rows (token, rep, size, place, component) of each token and component one a draw: if there is one, of those that can link to a set of equal size."""
    late = F.expr(f"(size - place) * {1 + threshold} < {2 * threshold} * size - 1e-6D")
    drawn = [F.min_by(F.struct("rep", "size", "place", "marks"), F.struct(late, F.xxhash64("rep", "token", F.lit(k)), "rep")) for k in range(draws)]
    every = shared.groupBy("token", "component").agg(F.array_distinct(F.array(*drawn)).alias("all"))
    return every.select("token", "component", F.inline("all")).select("token", "rep", "size", "place", "marks", "component")


def prefix_pairs(shared: DataFrame, threshold: float) -> DataFrame:
    """a, b: pairs of different components, among them each of similarity ``threshold`` or more. shared: token, rep, size, place, marks, component.

    Tokens have one order, rarest first. Sets of such similarity share threshold / (1 + threshold) of the sum of
    their sizes, so what follows the first shared token is as long in both, and that token is in both prefixes.
    The order is free: counters that tokens share change the number of pairs and lose none. Such sets differ in at most
    (1 - threshold) / (1 + threshold) of the sum of their sizes, and parities in no more bits, which leaves out most others before they are made.
    """
    both = shared.alias("l").join(shared.alias("r"), F.expr(f"l.token = r.token AND l.rep > r.rep AND {can_link(threshold)}"))
    return both.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct()


def labels_of(docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame | None:
    """node, component of representatives that verified links join; None if there is no link. reps: rep, bands."""
    members, pairs = buckets(reps)
    n = members.count()
    if not n:
        return None
    few = lambda df: dealt_by(df, n, ROWS_A_TASK)
    wanted = few(members.select("rep").distinct())
    texts = docs.select(F.col("doc_id").alias("rep"), "text").where("text IS NOT NULL").join(wanted, "rep", "left_semi").dropDuplicates(["rep"])
    held = stored(bags(texts), "bags")
    tried = stored(few(pairs), "pairs")
    good = stored(verify(tried, held, threshold), "links")
    labels = None if good.isEmpty() else components(good)
    labelled = stored(few(mixed(members, labels)), "labelled")
    shared = prefixes(held.join(labelled, "rep", "left_semi"), threshold).join(labelled, "rep")
    for draws in (*DRAWS, None):
        shared = stored(few(still_mixed(stored(few(shared), "prefixes"))), "shared")
        if shared.isEmpty():
            break
        pairs = prefix_pairs(stored(few(chosen(shared, draws, threshold)), "chosen") if draws else shared, threshold)
        pairs = stored(few(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        tried = tried.union(pairs)
        good = stored(verify(pairs, held, threshold), "links")
        if not good.isEmpty():
            labels = components(good) if labels is None else joined_by(labels, good)
            known = labels.select("node", F.col("component").alias("now"))
            shared = shared.join(known, shared.rep == known.node, "left").select("token", "rep", "size", "place", "marks", F.coalesce("now", "component").alias("component"))
    return labels


def with_representatives(signed: DataFrame) -> DataFrame:
    """doc_id, rep (the least id with equal words), bands of each row of signed."""
    copies = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = signed.join(stored(copies.select("digest", "rep"), "copies"), "digest", "left")
    return joined.select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("digest").isNotNull(), F.col("bands")).alias("bands"))


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of the class) of each row of docs (doc_id, text)."""
    rows = stored(with_representatives(stored(sign(docs), "signed")), "representatives")
    labels = labels_of(docs, rows.where("doc_id = rep AND bands IS NOT NULL").select("rep", "bands"), threshold)
    rows = rows.select("doc_id", "rep")
    if labels is None:
        return rows.select("doc_id", F.col("rep").alias("class_id"))
    return rows.join(labels, rows.rep == labels.node, "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: that of the least id, all columns as they are. Rows with a null id stay."""
    found = classes(docs, threshold).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)

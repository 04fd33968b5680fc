"""Substring de-duplication by hashing lines and their sentences.

Lines are cut into sentences, which are the units; a line without sentence ends is one unit. A unit is normalised
(its words, runs of letters and digits, in lower case, joined by one space) and hashed to 128 bits. Digests are
grouped over all documents, and a unit is repeated if its digest has an earlier occurrence, ranked by document id
and place. Of the repeated units those go that

* stand in a run of repeated units of a document, line ends ignored, that has ``LEAST_WORDS`` words or more, or
* are a whole line, of any length, whose digest ``COMMON`` documents or more hold.

Few short sentences in a row, and short lines that few documents share, repeat by chance in different texts and
stay; the README gives the number of these. A passage inside a line goes but for what its first or last sentence
shares with the words around it. What goes takes the white space after it along, and a line of which nothing is
left its line end; the removed spans keep their offsets in the original text.

Digests are sent once per document and grouped with partial sums, so that a line which a third of the documents
share costs one row a task; a document counts once, however many rows have its id; that digest's documents are found in a join of two written tables, whose large
partitions adaptive execution splits. Texts move once, by document id.

Defined results: a null text stays null and an empty one empty; units without letters and digits stay; repeated
rows of one document id count as one document and get the same result; rows with a null id are never removed
against others; an empty table gives no row; a very long text is handled whole in one task, in memory proportional
to its length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import pieces, stored

WORD = regex.compile(r"[\p{L}\p{N}]+")
SENTENCE = regex.compile(r".*?[.!?][\x20\x09-\x0D]+|.+")  # with the white space that follows
LEAST_WORDS, COMMON = 8, 10
EARLIER, HELD_BY_MANY = 1, 2  # flags of a digest in a document
CLEANED = "doc_id long, text string, n_removed_chars long, n_removed long, n_units long, spans array<struct<start: long, end: long>>"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def units(text: str) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
    """line, start, end, words, digest, whether it is its line's only one, of each unit of a text."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        found, start = [], at
        for part in SENTENCE.findall(line):
            words = WORD.findall(part.lower())
            if words:
                found.append((number, start, start + len(part), len(words), xxhash.xxh3_128_digest(" ".join(words))))
            start += len(part)
        for unit in found:
            yield *unit, len(found) == 1
        at += len(line) + 1


def unit_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest: each digest once per document. Rows of a task have each digest once; only where an id has several rows is the table made distinct, as that moves all digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000):
            ids, out = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = {u[4] for u in units(text or "")}
                ids += [doc] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "digest"])

    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    found = stored(named.mapInArrow(run, "doc_id long, digest binary"), "units")
    repeated = named.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return stored(found.distinct(), "units-once") if repeated else found


def seen_before(held: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, _seen: for each document its digests that a smaller document id has or many documents hold, and which of both. held: doc_id, digest."""
    shared = held.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    shared = stored(shared.select("digest", "first", (F.col("n") >= common).alias("many")), "shared-units")
    flags = F.when(F.col("doc_id") > F.col("first"), EARLIER).otherwise(0) + F.when(F.col("many"), HELD_BY_MANY).otherwise(0)
    flagged = held.join(shared, "digest").select("doc_id", "digest", flags.alias("flags")).where("flags > 0")
    return flagged.groupBy("doc_id").agg(F.collect_set(F.struct("digest", "flags")).alias("_seen"))


def cut(text: str, seen: dict[bytes, int], least_words: int) -> tuple[str, int, int, int, list[dict[str, int]]]:
    """What is left of a text, and the removed characters, removed units, units and removed spans."""
    found, earlier, runs, number = list(units(text)), set(), [], -1
    before = False
    for _, _, _, _, digest, _ in found:  # the run that each unit is in, -1 for those that are not repeated
        repeated = digest in earlier or seen.get(digest, 0) & EARLIER > 0
        earlier.add(digest)
        number += repeated and not before
        runs.append(number if repeated else -1)
        before = repeated
    words = [0] * (number + 1)
    for unit, r in zip(found, runs, strict=True):
        if r >= 0:
            words[r] += unit[3]
    gone = [u for u, r in zip(found, runs, strict=True) if r >= 0 and (words[r] >= least_words or (u[5] and seen.get(u[4], 0) & HELD_BY_MANY))]
    of_line: dict[int, list[tuple[int, int]]] = {}
    for line, start, end, *_ in gone:
        of_line.setdefault(line, []).append((start, end))
    kept, at = [], 0
    for i, line in enumerate(text.split("\n")):
        left, place = [], at
        for start, end in of_line.get(i, ()):
            left.append(text[place:start])
            place = end
        left.append(text[place : at + len(line)])
        rest = "".join(left)
        if i not in of_line or rest.strip(" \t\n\v\f\r"):
            kept.append(rest)
        at += len(line) + 1
    return "\n".join(kept), sum(u[2] - u[1] for u in gone), len(gone), len(found), [{"start": u[1], "end": u[2]} for u in gone]


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS, common: int = COMMON, carry: tuple[str, ...] = ()) -> DataFrame:
    """``CLEANED`` rows, one per row of docs (doc_id, text), and as they are the columns named in carry."""
    seen = seen_before(unit_digests(docs), common)
    joined = docs.select("doc_id", "text", *carry).join(seen, "doc_id", "left").select("doc_id", "text", "_seen", *carry)
    schema = T.StructType.fromDDL(CLEANED)
    for c in carry:
        schema.add(docs.schema[c])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for text, seen in zip(batch.column("text").to_pylist(), batch.column("_seen").to_pylist(), strict=True):
                rows.append((None, 0, 0, 0, []) if text is None else cut(text, {x["digest"]: x["flags"] for x in seen or ()}, least_words))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *(batch.column(c) for c in carry)], names=names)

    return joined.mapInArrow(run, schema)

"""Mixing sources to target weights by systematic sampling.

Each source has a weight and a size in words. The mix takes ``percent`` of all words; sources share it by weight, none
gets more than ``most`` times its size, and what is over is shared again by weight. A document's expected copies are
its source's target over its source's size. Within a source, documents in falling size have the prefix sums of their
expected copies, one random offset is added, and a document is emitted once for each integer boundary it crosses.
Falling size makes the words come near, not the documents alone: what a source gives differs from its target by less
than its largest document's size. (Let D be copies so far less those expected; D lies within the offset and the offset
less 1, and the difference in words is the sum of D times the falls in size, which add up to the largest size.)

Ranks within a source come from ranges of (source, size, id) over all tasks, so a source may hold any share of the
rows. The driver has a row a source, of which there may be ``MOST_SOURCES``: the weights are a stated list.

Defined results: a null or empty text has size 0 and gives no words, though it may be emitted; null sources are one
source, the last; a source without words has target 0; equal sizes go by id, equal ids among repeated rows are
interchangeable and each row counts; null ids come first among equals; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ranked, stored

WEIGHTS, PERCENT, MOST, SEED = (3, 1, 2), 150, 2, 12
MOST_SOURCES = 1_000_000


def n_words(text: Column) -> Column:
    """Runs of characters other than white space: each is made one letter, with the white space after it."""
    bare = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> list[float]:
    """Of each source, in the order of ``sizes``; weights repeat. A full source stays full, so each round closes one at least or is the last."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        share = (percent * sum(sizes) / 100 - most * sum(sizes[i] for i in full)) / max(1, sum(weight[i] for i in rest))
        over = {i for i in rest if weight[i] * share > most * sizes[i]}
        if not over:
            return [float(most * n) if i in full else weight[i] * share for i, n in enumerate(sizes)]
        full |= over


def offset(source: str | None, seed: int) -> float:
    """Between 0 and 1, of 17 bits, so that sums with whole numbers are exact."""
    drawn = hashlib.sha256(f"{seed}:{'' if source is None else 's' + source}".encode()).hexdigest()[:4]
    return (int(drawn, 16) + 0.5) / 65536


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and as they are the columns named in carry, one per row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *carry), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix has at most {MOST_SOURCES} sources")
    found = sorted(((r["source"], r["n"]) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    plan = [(i, s, n, t, offset(s, seed)) for i, ((s, n), t) in enumerate(zip(found, targets([n for _, n in found], weights, percent, most), strict=True))]
    sources = spark.createDataFrame(plan, f"_number int, _source {docs.schema['source'].dataType.simpleString()}, source_size long, target double, _offset double")
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = ranked(rows, "_number", F.desc("size"), F.col("doc_id"), name="mixed")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = lambda n: F.floor(n * each + F.col("_offset"))
    copies = F.least(crossed(F.col("rank")) - crossed(F.col("rank") - 1), F.ceil(each)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *carry)


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it is taken, with copy (from 1)."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

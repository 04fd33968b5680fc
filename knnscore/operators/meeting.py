"""Two tables meet by key in the same tasks: one side of a key is held, the other streams past it.

Both tables are dealt by the keys in one shuffle and sorted so that a key's held rows come first. A task holds one key's
rows at a time, so these have to be bounded (deal a large key out by a part number and send the other side to each
part); of the other side a key may have any number of rows. Nothing passes the driver, and the plan has the same size
for any number of rows. A key with one side only gives nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a key and its held rows: what to do with each batch of the rows that stream past.
Begin = Callable[[tuple[int, ...], pa.Table], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]


def meet(held: DataFrame, asked: DataFrame, keys: tuple[str, ...], begin: Begin, schema: str, partitions: int | None = None) -> DataFrame:
    """What ``begin(key, held rows)`` makes of the batches of asked rows. keys: integer columns without nulls of both tables.

    partitions: as many as a shuffle has unless told otherwise; fewer rows don't make fewer tasks, as the work is not in moving them.
    """
    names = [[c for c in df.columns if c not in keys] for df in (held, asked)]
    kinds = [{c: df.schema[c].dataType for c in own} for df, own in zip((held, asked), names, strict=True)]

    def side(df: DataFrame, number: int) -> DataFrame:
        columns = [(F.col(c) if n == number else F.lit(None).cast(kinds[n][c])).alias(f"_{n}_{c}") for n in (0, 1) for c in names[n]]
        return df.select(*keys, F.lit(number).alias("_side"), *columns)

    each = partitions or int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = side(held, 0).union(side(asked, 1)).repartition(each, *keys).sortWithinPartitions(*keys, "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ask = None, [], None
        for batch in batches:
            marks = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "_side")])
            edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            sides = [pa.RecordBatch.from_arrays([batch.column(f"_{n}_{c}") for c in names[n]], names=names[n]) for n in (0, 1)]
            for at, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if at == end:
                    continue
                *now, side = marks[:, at].tolist()
                if now != key:
                    key, parts, ask = now, [], None
                rows = sides[side].slice(at, end - at)
                if not side:
                    parts.append(rows)
                elif parts:
                    ask = ask or begin(tuple(key), pa.Table.from_batches(parts).combine_chunks())
                    yield from ask(rows)

    return dealt.mapInArrow(run, schema)

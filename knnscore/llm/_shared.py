"""What several operators need: the shared folder and tables that cut lineage (of the engine's session module), byte-bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ranked, shared_dir, stored
from ..session import shared_path as new_path

__all__ = ["dealt_by", "lists", "new_path", "pieces", "ranked", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts each batch so that the texts of a piece hold about ``most_bytes``; a single longer text is a piece of its own. column: the texts, or their lengths."""
    for batch in batches:
        lengths = batch.column(column)
        lengths = pc.fill_null(lengths if pa.types.is_integer(lengths.type) else pc.binary_length(lengths), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of number lists without nulls, one list after the other, and where each list begins."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), bounds - bounds[0]


def dealt_by(df: DataFrame, rows: int, each: int) -> DataFrame:
    """``df`` in as many partitions as ``rows`` need at ``each`` a task (eight at least), where it has more: small tables in rounds don't pay for a task per shuffle partition."""
    return df.coalesce(max(8, -(-rows // each)))

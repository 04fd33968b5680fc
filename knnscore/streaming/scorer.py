"""Scoring of a stream of requests: each micro-batch runs the batch plan; there is no state, requests are independent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..plans.scoring import score


def score_stream(raw: DataFrame, index: Index, out: str, checkpoint: str, is_fraud: str = "label = 1") -> StreamingQuery:
    """Starts a query that writes the answers of each micro-batch below ``out`` (one folder a batch, so that a repeated batch replaces itself)."""

    def answer(batch: DataFrame, number: int) -> None:
        score(batch.select("query_id", "body"), index, is_fraud=is_fraud).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return raw.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()

"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(name: str = "knnscore", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; conf: further settings, underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='knnscore-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, *order: Column, name: str) -> DataFrame:
    """Adds rank: the place from 1 among the rows of the same group, in the given order, however many rows a group has.

    Rows are dealt by ranges of (group, order), so a group spreads over tasks, and written sorted with each row's task and
    place in it. What stands before a task is the sum of the counts of earlier tasks: a row for each task and for each
    group that begins in it, which is what is broadcast. group has no nulls.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    written = stored(dealt.withColumn("_row", F.monotonically_increasing_id()), name)
    placed = written.withColumns({"_task": F.shiftright("_row", 33), "_at": F.col("_row").bitwiseAND((1 << 33) - 1)}).drop("_row")
    runs = placed.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(group, "_task", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(before), [group, "_task"]).withColumn("rank", F.col("_at") + F.col("_shift") + 1).select(*df.columns, "rank")

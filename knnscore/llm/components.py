"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dealt_by, stored

ROWS_A_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of links (a, b); nodes without links aren't listed.

    Each half-step joins links with the least neighbour of a node, pre-aggregated, and keeps distinct pairs, so a
    node with very many links costs no more than its links. Written tables cut lineage.
    """
    state = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    checked = F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    mark = state.agg(*checked).first()
    while True:
        few = lambda df, rows=2 * mark[0]: dealt_by(df, rows, ROWS_A_TASK)
        both = few(state.union(state.select("b", "a")))
        least = few(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = few(few(both.join(least, "a")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a")).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least)
        state = stored(few(small.distinct()), "stars")
        now = state.agg(*checked).first()
        if now == mark:
            break
        mark = now
    found = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stored(few(found.union(found.select("component", "component").distinct())), "components")


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of labels (node, component) once further links (a, b) join them: links of components alone are gone over, of nodes not in labels as their own."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    found = components(named).toDF("was", "now")
    moved = labels.join(found, labels.component == found.was, "left").select("node", F.coalesce("now", "component").alias("component"))
    new = found.join(labels, found.was == labels.node, "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return stored(moved.union(new), "components")

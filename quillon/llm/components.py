"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v: neighbours of u move to the smallest of them and u itself."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of the component, for every node that has an edge; edges are (u, v).

    Any orderable key; loops and repeated or reversed edges are allowed, null ends dropped. Each step groups with
    partial minima and joins on the grouped side's unique key, so a star of any size is no hot task for long, and
    is written to the shared folder; stars are reached in about log2 of the longest chain steps.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), name)
    mark = None
    while True:
        last, now = now, materialize(_star(_star(now, True), False), name)
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

"""Connected components of an edge table by alternating large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import durable


def _directed(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return (edges.where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _directed(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _directed(edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .union(low.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges(u, v)`` with ``root``, the smallest node of their component.

    Runs to the fixpoint (no round limit): the edge set ends as a star around
    each root.  Every round is checkpointed; the test for the fixpoint is one
    count and one sum.  Hub nodes are pre-aggregated by ``min`` before the
    shuffle, and a join on a hub meets one row on its other side, so it can be
    split.  Self-loops and repeated edges have no effect; no edges, no rows.
    """
    cur = durable(_directed(edges))
    seen = _state(cur)
    while seen[0]:
        cur = durable(_small_star(_large_star(cur)))
        now = _state(cur)
        if now == seen:
            break
        seen = now
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))

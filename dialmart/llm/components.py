"""Connected components by alternating large-star and small-star rounds.

Every round is one or two joins against a per-node minimum.  The minimum is pre-aggregated
before its shuffle and a hub's edges are an ordinary skewed join key, which adaptive execution
splits.  Nothing but a two-number checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _towards_min(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _towards_min(
        both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _towards_min(moved.unionAll(low.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that is not its component's smallest.

    edges has long columns u and v, in either direction, repeats and self-loops allowed; null
    ends are ignored.  An empty table gives an empty result.  Nodes missing from the result
    are their own component.
    """
    now = materialize(_towards_min(edges.where("u is not null and v is not null")), "cc")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        now = materialize(_small_star(_large_star(now)), "cc")
    raise RuntimeError("components did not settle")

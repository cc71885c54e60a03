"""Connected components of an edge table, without a driver-side structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlink.runtime import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges kept as (a, b) with a > b.

    Large: each node hands its larger neighbours to its smallest neighbour. Small: each node hands its
    smaller neighbours and itself to the smallest of them. Minima are partial aggregates, so a hub's
    neighbours never meet in one group; the join back to its edges can be split by skew handling.
    """
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, the component named by its smallest node.

    Alternates star steps until the edge set stands still; each round is written to the shared folder,
    so plans stay short and a lost executor costs one round. Null ends and self-loops are ignored; nodes
    without another node do not appear.
    """
    pair = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    now = materialise(pair.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "components")
    before = None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = materialise(_star(_star(now, True), False), "components")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components by alternating star contractions, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours to the smallest node around them.

    Minima are partial aggregates, so a node with very many neighbours costs one row per task.
    """
    near = _both_ways(edges) if larger_only else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = near.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
    joined = near.join(least, "a")
    if larger_only:
        linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return linked.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node."""
    current = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    seen = _state(current)
    for _ in range(rounds):
        current = cut_lineage(_star(_star(current, True), False))
        state = _state(current)
        if state == seen:
            nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return nodes.unionByName(roots)
        seen = state
    raise RuntimeError(f"components did not settle within {rounds} rounds")

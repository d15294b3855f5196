"""Connected components by alternating stars, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``large``: every node links its larger neighbours to its least neighbour;
    otherwise its smaller neighbours and itself. A hub's rows meet its minimum by an equi-join, so that
    adaptive execution can split the hub; no group is ever gathered."""
    if large:
        both = _directed(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("m").alias("u"), "v").where("u < v")
    return linked.union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``edges`` (columns ``u``, ``v`` of one orderable type).

    ``root`` is the least node of the component. Self links and nulls are ignored; without links the
    result is empty. The number of rounds grows with the logarithm of the longest chain.
    """
    now = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            break
        before = state
        step = materialize(_star(_star(now, True), False), "cc")
        discard(now)
        now = step
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

"""Connected components over edge tables, without collecting anything.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every round rewires edges to the
smallest neighbour, and about log^2 n rounds leave a star per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rejoin, release

#: Rounds after which an unconverged run is reported as an error rather than returned.
MAX_ROUNDS = 40


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. edges: (a, b) with a > b."""
    if large:
        rows = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = rejoin(rows, least, ["a"], "inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = rejoin(edges, least, ["a"], "inner").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) ids linked in any direction -> (node, component), the smallest id reachable.

    Nodes without an edge to another node do not occur; nulls and loops are
    ignored, repeats count once.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        before, now = now, materialize(_stars(_stars(now, True), False), "edges")
        release(before, sweep=False)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, spread

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("sum(xxhash64(u, v) % 1000000007)").alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which need a number of rounds
    that grows with the logarithm of the graph. Loops and repeated edges are fine; edges with a
    null end are ignored. The least neighbours are dealt anew before they are joined, so the join can
    be split at a node that many edges share. Edges are cut from their lineage after each round.
    """
    good = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = cut(good.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        star = large.join(low, "u").select(F.expr("CASE WHEN v = m THEN u ELSE v END AS u"), F.col("m").alias("v"))
        ends = low.select("u", F.col("m").alias("v"))
        after = cut(star.unionByName(ends).where("u <> v").distinct())
        new_state = _state(after)
        now = after
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) of all nodes of ``edges``; the component is its smallest node.

    Each round points all larger neighbours of a node at its smallest one, then all smaller ones; the
    edges become one star for each component after about log n rounds. Only edges move; each round is
    checkpointed, so a lost executor costs one round at most. Self-links and repeated edges do no
    harm; an empty table gives no rows.
    """
    ab = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = ab.select(F.greatest("u", "v").alias("high"), F.least("u", "v").alias("low")).distinct().checkpoint()
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(now.select(F.col("low").alias("u"), F.col("high").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).filter("high <> low")
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(smallest, "high").select(F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct("high", F.col("m").alias("low")))).alias("e")).select("e.*")
        now = small.filter("high <> low").distinct().checkpoint()
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())

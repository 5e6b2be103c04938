"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch

MOST_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest of u and its neighbours in ``pairs``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest member) of every node of ``edges`` (u, v).

    Each round links the larger neighbours of a node to its smallest one, then the smaller neighbours;
    when a round changes nothing, every node hangs on the smallest of its component. Rounds are stored,
    so a lost executor costs one round at most, and each goes when the next is there. Edges from a node to itself and null ends are left out.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.put(edges.select("u", "v").filter("u <> v").distinct(), "0")
    state = None
    for round_ in range(MOST_ROUNDS):
        large = _star(_both_ways(now)).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _star(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now = scratch.put(small, str(round_ + 1))
        scratch.drop(str(round_))
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

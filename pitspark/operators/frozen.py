"""Frozen selections: stored with their request, replayed later, and compared by a tree of hashes.

A selection's rows are dealt to leaves by a hash of their key, so a hot issuer is spread. A node of the tree
covers a range of leaves and holds the number of its rows and four sums of 60-bit words of their hashes: a
hash of a multiset, which no order of rows changes and which is the sum of its children's, so every level
comes from one aggregation with a map-side combine. A comparison goes down from the root only where hashes
differ, and reads frozen rows only of the shards and leaves that it ends in.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitspark.functions import scalar
from pitspark.functions.storage import stored

#: Leaves that differ are named in the scan's filter up to this number; a join finds them in any case.
NAMED = 4096
WORDS = ["w0", "w1", "w2", "w3"]
TREE = "n bigint, w0 decimal(38,0), w1 decimal(38,0), w2 decimal(38,0), w3 decimal(38,0), node bigint, level int"


def _dealt(rows: DataFrame, key: list[str], leaf_digits: int, shard_digits: int) -> DataFrame:
    """(leaf, shard, h, k, row): the row as a struct, so that names of columns cannot clash."""
    k = F.struct(*[F.col(c) for c in key])
    leaf = F.conv(F.substring(scalar.content_id(k.alias("k")), 1, leaf_digits), 16, 10).cast("long")
    whole = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    out = rows.select(leaf.alias("leaf"), scalar.content_id(whole.alias("row")).alias("h"), k.alias("k"), whole.alias("row"))
    return out.withColumn("shard", F.shiftright("leaf", 4 * (leaf_digits - shard_digits)).cast("int"))


def _tree(dealt: DataFrame, leaf_digits: int) -> DataFrame:
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(w) for i, w in enumerate(WORDS)]
    leaves = dealt.groupBy("leaf").agg(F.count("*").alias("n"), *words)
    up = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), F.shiftright("leaf", 4 * (leaf_digits - d)).alias("node")) for d in range(leaf_digits + 1)]))
    every = leaves.withColumn("up", up).groupBy("up.level", "up.node").agg(F.sum("n").alias("n"), *[F.sum(w).cast("decimal(38,0)").alias(w) for w in WORDS])
    return every.select("n", *WORDS, "node", "level")


def _differing(then: DataFrame, now: DataFrame, level: int, parents: list[int] | None, parent_digits: int = 1) -> DataFrame:
    """Nodes of a level whose hashes differ, below ``parents`` only."""
    sides = []
    for side, tree in (("then", then), ("now", now)):
        mine = tree.filter(F.col("level") == level)
        if parents is not None:
            mine = mine.filter(F.shiftright("node", 4 * parent_digits).isin(parents))
        sides.append(mine.select("node", F.struct("n", *WORDS).alias(side)))
    return sides[0].join(sides[1], "node", "full_outer").filter(~F.col("then").eqNullSafe(F.col("now"))).select("node")


def freeze(rows: DataFrame, key: list[str], request: DataFrame, path: str, leaf_digits: int = 5, shard_digits: int = 2) -> None:
    """Stores ``rows`` and the request that chose them under ``path``: shards by the first ``shard_digits`` hex
    digits of the key's hash (at most three, 4,096), rows of a shard by leaf, and the tree last, without which
    nothing is frozen. Rows may repeat; a key may have several, and null parts."""
    if not 1 <= shard_digits <= 3 or leaf_digits <= shard_digits or leaf_digits > 12:
        raise ValueError("one to three digits make a shard, and more than those, up to twelve, a leaf")
    spark = rows.sparkSession
    dealt = stored(_dealt(rows, key, leaf_digits, shard_digits), "selection")
    dealt.repartitionByRange("leaf").sortWithinPartitions("leaf").write.partitionBy("shard").parquet(f"{path}/rows")
    request.write.parquet(f"{path}/request")
    about = [(list(key), leaf_digits, shard_digits, dealt.schema.json(), request.schema.json())]
    spark.createDataFrame(about, "key array<string>, leaf_digits int, shard_digits int, rows string, request string").coalesce(1).write.parquet(f"{path}/about")
    _tree(dealt, leaf_digits).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.partitionBy("level").parquet(f"{path}/tree")


class Frozen:
    """A selection that :func:`freeze` stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.about = spark.read.parquet(f"{path}/about").first()
        self.tree = spark.read.schema(TREE).parquet(f"{path}/tree")

    def request(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.about.request))).parquet(f"{self.path}/request")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(self.about.rows))).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._rows().select("row.*")

    def differences(self, rows: DataFrame) -> DataFrame:
        """Keys whose rows are not those frozen: (key, state, frozen_rows, stored_rows), state ``removed``,
        ``added`` or ``altered``. Another set of columns alters every row.

        Levels down to the shards are compared one by one (at most 4,096 nodes, their number fixed by the
        digits); from there one comparison of leaves, within those shards, ends in the rows to be read.
        """
        a = self.about
        now = stored(_dealt(rows, list(a.key), a.leaf_digits, a.shard_digits), "replayed")
        tree = stored(_tree(now, a.leaf_digits), "tree")
        nodes = None
        for level in range(a.shard_digits + 1):
            nodes = [r.node for r in _differing(self.tree, tree, level, nodes).collect()]
            if not nodes:
                break
        shards = nodes
        leaves = _differing(self.tree, tree, a.leaf_digits, shards, a.leaf_digits - a.shard_digits).toDF("leaf")
        leaves = stored(leaves, "leaves")
        few = [r.leaf for r in leaves.limit(NAMED + 1).collect()]
        within = F.col("shard").isin(shards)
        if len(few) <= NAMED:
            within &= F.col("leaf").isin(few)
        side = lambda df, then: df.filter(within).join(leaves, "leaf", "left_semi").select("k", "h", F.lit(int(then)).alias("then"), F.lit(int(not then)).alias("now"))
        both = side(self._rows(), True).unionByName(side(now, False))
        by_content = both.groupBy("k", "h").agg(F.sum("then").alias("then"), F.sum("now").alias("now"))
        by_key = by_content.groupBy("k").agg(F.sum("then").alias("frozen_rows"), F.sum("now").alias("stored_rows"), F.bool_or(F.col("then") != F.col("now")).alias("differs"))
        return by_key.filter("differs").select("k.*", _state().alias("state"), "frozen_rows", "stored_rows")

    def replay(self, select: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Runs the selection again with the request that was frozen, and gives :meth:`differences`; there
        should be none while the evidence is as it was."""
        return self.differences(select(self.request()))


def _state() -> Column:
    return F.when(F.col("stored_rows") == 0, "removed").when(F.col("frozen_rows") == 0, "added").otherwise("altered")

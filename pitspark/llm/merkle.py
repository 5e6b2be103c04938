"""A Merkle manifest of a dataset, with the proof of every row.

Leaves are hashes of rows. Within a source they are ranked by doc_id, and the digits of a rank in base
:data:`FAN` say where a leaf stands: a block of ``FAN ** DIGITS`` leaves is rolled up by grouping its
digit columns away one after another, each time collecting the children as structs within their parent,
so that a block ends as one nested row of bounded size. Blocks are the leaves of the next storey, until
each source is one block; the sources' subroots are rolled up in the same way. On the way down each
storey turns its nested rows inside out: a transform gives every child its siblings to the left and to
the right, an explode makes it a row. Leaves meet no join: only blocks do, once a storey, by their number.

A storey of one tree that has one node left passes it on unchanged, so trees of all sizes go together.

Defined cases: nulls in any hashed column are written ``-``; rows with a null source are a tree of their
own, the first; a null doc_id comes first in its source and is never tampered with; rows with one doc_id
are ordered by their leaf, and equal rows are leaves of their own; other columns do not count; an empty
table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch, crc_mod
from pitspark.llm.ranking import ranked

FAN, DIGITS = 16, 3
BLOCK = FAN**DIGITS
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
LOWERED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts: Column) -> Column:
    """The hash of the concatenated parts, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, itself; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """tree (the source, told apart from null), doc_id, leaf, and tampered: the leaf of the changed row, where a row is changed."""
    original = digest(*[field(F.col(c)) for c in HASHED])
    changed = digest(*[field(F.translate(c, *LOWERED) if c == "text" else F.col(c)) for c in HASHED])
    hit = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) == 0)
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), original.alias("leaf"), F.when(hit, changed).alias("tampered"), F.monotonically_increasing_id().alias("row"))


def rolled_up(nodes: DataFrame, payload: Column) -> DataFrame:
    """tree, total, block, hash and kids of each block of ``nodes`` (tree, rank, total, hash).

    kids nests structs (digit, hash, kids) storey by storey; the innermost hold ``payload``.
    """
    digits = [f"digit{k}" for k in range(DIGITS)]
    at = {"block": F.expr(f"rank div {BLOCK}"), "kids": payload} | {d: F.expr(f"cast(rank div {FAN**k} % {FAN} as int)") for k, d in enumerate(digits)}
    now = nodes.withColumns(at).repartition("tree", "block")
    for k, d in enumerate(digits):
        collected = F.sort_array(F.collect_list(F.struct(F.col(d).alias("digit"), "hash", "kids")))
        now = now.groupBy("tree", "total", "block", *digits[k + 1 :]).agg(collected.alias("kids"))
        parent = F.when(F.col("total") > FAN**k, digest(F.array_join("kids.hash", ""))).otherwise(F.col("kids")[0]["hash"])
        now = now.withColumn("hash", parent)
    return now


def _beside(storey: int):
    """Gives each child of a nested row its siblings, put before the path of its parent."""

    def place(child: Column, i: Column) -> Column:
        before, after = F.slice("kids", F.lit(1), i), F.slice("kids", i + 2, F.lit(FAN))
        step = F.struct(F.array_join(before["hash"], "").alias("left"), F.array_join(after["hash"], "").alias("right"))
        path = F.when(F.col("total") > FAN**storey, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        return F.struct(child["hash"].alias("hash"), child["kids"].alias("kids"), path.alias("path"))

    return place


def turned_out(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, hash, path and payload (as kids) of every innermost node of ``blocks``, which have a path."""
    now = blocks
    for storey in reversed(range(DIGITS)):
        now = now.select("total", *keep, F.inline(F.transform("kids", _beside(storey))))
    return now.drop("total")


def storeys(nodes: DataFrame, payload: Column, scratch: Scratch, name: str) -> list[DataFrame]:
    """Stored blocks of ``nodes``, then blocks of those blocks, until no tree has two."""
    found = []
    while True:
        blocks = scratch.put(rolled_up(nodes, payload), f"{name}-{len(found)}")
        found.append(blocks)
        if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
            return found
        nodes = blocks.select("tree", F.col("block").alias("rank"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), "hash")
        payload = F.col("rank")


def descended(found: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """The lowest nodes of ``found`` with their whole paths; ``tops`` has a path and ``keep`` for each tree."""
    paths = tops.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(found[1:]):
        placed = turned_out(blocks.select("tree", "total", "block", "kids").join(paths, ["tree", "block"]), ["tree", *keep])
        paths = placed.select("tree", F.col("kids").alias("block"), "path", *keep)
    return turned_out(found[0].select("tree", "total", "block", "kids").join(paths, ["tree", "block"]), ["tree", *keep])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs``.

    ``folded_root`` is computed from the row as it may have been tampered with and its untampered siblings.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    found = scratch.put(leaves(docs), "leaves")
    nodes = ranked(found, "tree", ["doc_id", "leaf", "row"], scratch, "ranges").withColumnRenamed("leaf", "hash")
    of_rows = storeys(nodes, F.struct("doc_id", "tampered"), scratch, "rows")
    scratch.drop("leaves", "ranges")

    sources = of_rows[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    of_sources = storeys(ranked(sources, "tree", ["name"], scratch, "names"), F.col("name"), scratch, "sources")
    nothing = F.from_json(F.lit("[]"), "array<struct<left:string,right:string>>")
    top = of_sources[-1].select("tree", nothing.alias("path"), F.col("hash").alias("root"))
    tops = descended(of_sources, top, ["root"]).select(F.col("kids").alias("tree"), F.col("hash").alias("subroot"), "path", "root")

    rows = descended(of_rows, tops, ["subroot", "root"])
    siblings = F.flatten(F.transform("path", lambda p: F.array(p["left"], p["right"])))
    folded = F.aggregate("path", F.coalesce(F.col("kids.tampered"), F.col("hash")), lambda now, p: digest(p["left"], now, p["right"]))
    out = rows.select(F.col("kids.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""Near duplicates by word shingles: a grouped prefix join.

Shingles are 64-bit hashes of runs of words, put into one order for all documents: rare ones first. Two
sets that are alike enough share a shingle among the first few of each in that order (the prefix), so
only documents that meet there need to be compared. How common a shingle is comes from counts over all
documents in a table of :data:`CELLS` cells by hash; shingles that share a cell count as equally common,
which costs some comparisons and loses none, because any order that all documents share is right.

Texts with one set form a class, and classes with one prefix and size form a group; the index holds
groups. Links are found in two steps, since only what is connected is asked for. First each group is
compared with one leader for each prefix shingle (the group where it stands foremost, which is the least
altered copy) and each class with its group's first. Then, wherever a shingle still brings together
different components, the entries outside its largest component are compared with all others: pairs that
the first step has joined already, directly or by way of others, are passed over. Candidates are
filtered by size, by the places of the shared shingles and by how many there are, and verified on whole sets.

Defined cases: words are lower-cased in A to Z; a text of fewer words than a shingle has its whole
sequence as its one shingle; no words or a null text: the empty set, linked with nothing, a component of
its own; texts under one repeated doc_id count as one document as to links; a null doc_id never is the
smallest and joins its text's class; an empty table stays empty. Equal 64-bit hashes count as equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch, slices, text_or_empty, written
from pitspark.llm.components import connected_components

CELL_BITS = 22
CELLS = 1 << CELL_BITS
PART_CELLS = 1 << 15
MOST_BITS = 1 << 27  # of a map that goes to all tasks; beyond, a join does its work

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    run = min(width, len(h))
    total = np.full(len(h) - run + 1, run, np.uint64)
    for k in range(run):
        total += h[k : len(h) - run + 1 + k] * _FACTORS[k]
    return np.unique(_mixed(total))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def cell_levels(docs: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """For each cell, how common its shingles are: the whole log2 of its count over the mean.

    A fixed :data:`CELLS` counters come to the driver however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(CELLS, np.uint32)
        for batch in slices(batches, 2048):
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            if sets:
                np.add.at(totals, (np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
        parts = [zlib.compress(totals[a : a + PART_CELLS].tobytes(), 1) for a in range(0, CELLS, PART_CELLS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                found = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + found if part in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    counted = scratch.put(docs.select(text_or_empty("text").alias("text")).mapInArrow(count, schema), "cells")
    totals = np.zeros(CELLS, np.uint64)
    for row in counted.repartition("part").mapInArrow(add, schema).collect():
        totals[row["part"] * PART_CELLS : (row["part"] + 1) * PART_CELLS] = np.frombuffer(zlib.decompress(row["counts"]), np.uint64)
    scratch.drop("cells")
    mean, levels = max(1.0, float(totals.mean())), np.empty(CELLS, np.uint8)
    for a in range(0, CELLS, PART_CELLS):
        levels[a : a + PART_CELLS] = np.log2(np.maximum(1.0, totals[a : a + PART_CELLS] / mean))
    return levels


def _ordered(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found, levels[(found >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))]


def with_prefixes(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), sig (hash of the set) and prefix of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            sizes, sigs, prefixes = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                sigs.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                prefixes.append(_ordered(found, shared.value)[: prefix_length(len(found), percent)].view(np.int64) if len(found) else [])
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(make, "doc_id long, n long, sig binary, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and its whole set, for the wanted nodes and few others.

    A map of bits by hash, sized to the number of nodes up to :data:`MOST_BITS`, tells which texts to read;
    the few others that it lets through cost work and change nothing. More nodes than that are met by a join.
    """
    many = wanted.count()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "members"])

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), text_or_empty("text").alias("text"))
    if many * 4 > MOST_BITS:
        return rows.join(wanted.distinct(), "node", "left_semi").mapInArrow(make, "node long, members array<long>")
    bit = F.pmod(F.xxhash64("node"), F.lit(1 << max(16, (many * 8).bit_length())))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    marks = wanted.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(one).alias("bits"))
    hit = rows.withColumns({"word": F.floor(bit / 64), "one": one}).join(F.broadcast(marks), "word").filter(F.col("bits").bitwiseAND(F.col("one")) != 0)
    return hit.select("node", "text").mapInArrow(make, "node long, members array<long>")


def _may_link(percent: int) -> Column:
    """Whether sizes n and o, with their first shared shingle at places i and j, allow a link.

    Two sets that link pass this at one shingle at least, the first that they share: none before it is
    shared, so no more than what follows in each can be.
    """
    most = F.least(F.col("n") - F.col("i"), F.col("o") - F.col("j"))
    return (F.lit(100) * F.least("n", "o") >= percent * F.greatest("n", "o")) & (F.lit(100 + percent) * most >= percent * (F.col("n") + F.col("o")))


def _enough_shared(ends: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, n, o) of groups whose prefixes share enough shingles for a link."""
    here, there = met.select(F.col("gid").alias("u"), "token"), met.select(F.col("gid").alias("v"), "token")
    counted = ends.join(here, "u").join(there, ["v", "token"]).groupBy("u", "v", "n", "o").agg(F.count("*").alias("shared"))
    return counted.filter(_share_enough(percent)).select("u", "v")


def _share_enough(percent: int) -> Column:
    """Whether ``shared`` prefix shingles of sets of n and o allow a link.

    Of the two prefixes, all that the other set holds up to the end of the earlier-ending one lies in its
    prefix too; so beyond ``shared`` only what follows that prefix can be shared.
    """
    after = [F.expr(f"({percent} * {x} + 99) div 100 - 1") for x in ("n", "o")]
    return F.lit(100 + percent) * (F.col("shared") + F.greatest(*after)) >= percent * (F.col("n") + F.col("o"))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v), of a stored table, whose whole sets are alike enough, stored as ``name``."""
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node")))
    sets = scratch.put(sets_of(docs, wanted, width), f"{name}-sets")
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    both = pairs.join(left, "u").join(right, "v")
    links = scratch.put(both.filter(F.lit(100) * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v").distinct(), name)
    scratch.drop(f"{name}-sets")
    return links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of each row of ``docs``.

    Two documents link when 100 * shared >= ``percent`` * all of their distinct ``width``-word shingles.
    """
    texts, scratch = docs.select("doc_id", "text"), Scratch(docs.sparkSession, "near-duplicates")
    rows = scratch.put(with_prefixes(texts, cell_levels(texts, width, scratch), width, percent), "prefixes")

    nodes = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("node"))
    keyed = rows.filter("n > 0").select("doc_id", "n", "sig", F.xxhash64("prefix").alias("key"))
    members = scratch.put(keyed.groupBy("sig", "n", "key").agg(F.min("doc_id").alias("node")).filter("node is not null").select("node", "n", "key"), "members")
    groups = members.groupBy("n", "key").agg(F.min("node").alias("gid"), F.count("*").alias("many"))
    grouped = scratch.put(members.join(groups, ["n", "key"]).select("node", "gid", "n", "many"), "grouped")
    scratch.drop("members")

    leaders = grouped.filter("node = gid").select("gid").distinct()
    firsts = rows.filter("n > 0").join(leaders, F.col("doc_id") == F.col("gid"), "left_semi")
    entries = firsts.select(F.col("doc_id").alias("gid"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token")).repartition("token")
    tokens = entries.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("i", "n", "gid")).alias("lead")).filter("c > 1")
    met = scratch.put(entries.join(tokens, "token").select("token", "gid", "n", "i", F.col("lead.gid").alias("lead"), F.col("lead.n").alias("o"), F.col("lead.i").alias("j")), "met")

    ends = met.filter((F.col("gid") != F.col("lead")) & _may_link(percent)).select(F.col("gid").alias("u"), F.col("lead").alias("v"), "n", "o").distinct()
    stars = _enough_shared(ends, met, percent)
    inner = grouped.filter("node <> gid").select(F.col("node").alias("u"), F.col("gid").alias("v"))
    first_pairs = stars.unionByName(inner).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    first_pairs = scratch.put(first_pairs, "first-pairs")
    joined = scratch.put(connected_components(verified(first_pairs, texts, width, percent, scratch, "first-links")), "first-components")

    rest = scratch.put(_between_components(met, grouped, joined, percent, scratch).join(first_pairs, ["u", "v"], "left_anti"), "pairs")
    scratch.drop("met", "grouped", "mixed", "near", "first-pairs", "first-links")
    more = verified(rest, texts, width, percent, scratch, "links")
    everything = connected_components(more.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    scratch.drop("pairs", "links", "first-components")

    ids = rows.select("doc_id", "n", "sig").join(nodes, "sig", "left").join(everything, "node", "left")
    return ids.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def _between_components(met: DataFrame, grouped: DataFrame, joined: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (u > v) of nodes in different components.

    The largest component of each shingle's entries is one side only, so a group of like documents that
    are joined already costs nothing here, whatever its size.
    """
    placed = grouped.join(joined, "node", "left").select("node", "gid", "n", F.coalesce("component", "node").alias("comp"))
    held = placed.select("gid", "comp").distinct()
    entries = met.select("token", "gid", "n", "i").join(held, "gid")
    sizes = entries.groupBy("token", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).filter("comps > 1")
    mixed = mixed.select("token", F.col("top.comp").alias("top"))
    here = scratch.put(entries.join(mixed, "token"), "mixed")
    minor = here.filter("comp <> top").select("token", "gid", "n", "i", "comp")
    other = here.select("token", F.col("gid").alias("gid2"), F.col("n").alias("o"), F.col("i").alias("j"), F.col("comp").alias("comp2"), "top")
    # two minor entries would meet from both sides; one order is enough
    once = (F.col("comp2") == F.col("top")) | (F.col("comp") > F.col("comp2"))
    near = minor.join(other, "token").filter((F.col("comp") != F.col("comp2")) & once & _may_link(percent)).select("gid", "comp", "n", "gid2", "comp2", "o").distinct()
    near = scratch.put(near, "near")
    kept = _enough_shared(near.select(F.col("gid").alias("u"), F.col("gid2").alias("v"), "n", "o").distinct(), met, percent)
    pairs = near.join(kept.select(F.col("u").alias("gid"), F.col("v").alias("gid2")), ["gid", "gid2"], "left_semi").select("gid", "comp", "gid2", "comp2")
    within = held.alias("a").join(held.alias("b"), (F.col("a.gid") == F.col("b.gid")) & (F.col("a.comp") > F.col("b.comp")))
    pairs = pairs.unionByName(within.select(F.col("a.gid").alias("gid"), F.col("a.comp").alias("comp"), F.col("b.gid").alias("gid2"), F.col("b.comp").alias("comp2"))).distinct()
    left = placed.select("gid", "comp", F.col("node").alias("x"))
    right = placed.select(F.col("gid").alias("gid2"), F.col("comp").alias("comp2"), F.col("node").alias("y"))
    expanded = pairs.join(left, ["gid", "comp"]).join(right, ["gid2", "comp2"])
    return expanded.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def _row_id() -> Column:
    """doc_id, or for a null one a number from the text's hash, beyond the ids in use."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text_or_empty("text")), 2))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id.

    Rows with a null doc_id are told apart by their texts, and a numbered row goes before them. Of rows
    under one doc_id, that with the smallest text stays (then by the row as JSON). Columns go through as
    one struct, so that no name of theirs can clash with one used here.
    """
    whole = docs.select(_row_id().alias("id"), F.struct("*").alias("row"))
    found = near_duplicates(docs.select(_row_id().alias("doc_id"), "text"), width, percent)
    states = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("component_id")).alias("gone"))
    states = written(states.filter("gone or rows > 1"), "gone")
    marked = whole.join(states, "id", "left")
    kept = marked.filter("rows is null").select("row")
    if not states.filter("not gone").isEmpty():
        again = marked.filter("not gone").groupBy("id").agg(F.min_by("row", F.struct(F.col("row.text"), F.to_json("row"))).alias("row"))
        kept = kept.unionByName(again.select("row"))
    return kept.select("row.*")

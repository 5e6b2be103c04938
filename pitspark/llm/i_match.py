"""I-Match fingerprints over randomised lexicon subsets.

A term is a distinct word of a text, lower-cased in A to Z. The lexicon holds the terms whose inverse
document frequency lies within a band: in at least one of :data:`RAREST` texts and at most one of
:data:`COMMONEST`. As a text has some hundreds of distinct terms on average, no more than that many times
RAREST terms can be so frequent, however many texts there are; the lexicon's size does not grow with the
table. It is broadcast if it has at most :data:`MOST_BROADCAST` terms, and joined by a shuffle beyond that.

Lexicon subsets are drawn by the hash of a term: its leading zero bits give a level, further bits one of
:data:`SLOTS` slots. So a level's slots are random subsets of one density, each level half as dense as the
one before it. A text's terms in each subset are sorted and hashed; the fingerprint lists the hashes of
the subsets in which the text has a term, after the hash of the list as a whole (the plain I-Match
signature). Two fingerprints are alike as far as their subsets agree: of the subsets of the sparse levels
(where at most half of the slots hold a term of either text, so that most hold one term alone) the share
with equal hashes. That estimates how much of both texts' terms is common.

The next text in the order of doc_id comes by a window over cells of ``2 ** CELL_BITS`` neighbouring ids,
and for a cell's last text by a join with the first text of the next cell. One exchange of the texts
by cell serves the window, the terms and their grouping. Only DataFrame functions are used.

Defined cases: a null text counts as empty; a text without a term in the lexicon has the hash of the whole
text as its fingerprint, which is alike (1) to itself and to no other (0); null doc_ids come before all
numbers, in the order of a hash of their texts; rows with one doc_id are ordered by their texts; the only
row of a table is followed by itself; other columns do not count; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch, text_or_empty
from pitspark.llm.merkle import LOWERED
from pitspark.llm.ranking import ranked

COMMONEST, RAREST = 8, 1024
LEVELS, SLOTS = "abcdefghijkl", 32
MOST_BROADCAST = 1_000_000
CELL_BITS = 6
#: In every text's list and in the lexicon, so that texts without any term go along; no word is empty.
NO_TERM = ""
SPACE_RE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text, and :data:`NO_TERM`."""
    return F.array_distinct(F.concat(F.array(F.lit(NO_TERM)), F.split(F.translate(text, *LOWERED), SPACE_RE)))


def subset_of(term: Column) -> Column:
    """The level and slot of a term: a letter and two digits."""
    bits, slot = (F.conv(F.substring(F.md5(term.cast("binary")), at, 8), 16, 10).cast("long") for at in (1, 9))
    level = F.least(F.lit(32) - F.length(F.bin(bits)), F.lit(len(LEVELS) - 1))
    return F.concat(F.substr(F.lit(LEVELS), level + 1, F.lit(1)), F.lpad((slot % SLOTS).cast("string"), 2, "0"))


def lexicon(docs: DataFrame) -> DataFrame:
    """term and subset of the terms within the band; counts are over all rows of ``docs``."""
    rows = docs.count()
    counted = docs.select(F.explode(terms(text_or_empty("text"))).alias("term")).filter(F.col("term") != NO_TERM).groupBy("term").agg(F.count("*").alias("n"))
    band = counted.filter((F.col("n") * RAREST >= rows) & (F.col("n") <= -(-rows // COMMONEST)))
    return band.select("term", subset_of(F.col("term")).alias("subset"))


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's place (numbered, cell, pos), doc_id and text, with the next row's text and place."""
    text = text_or_empty("text")
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))
    rows = docs.select(F.col("doc_id").isNotNull().alias("numbered"), F.shiftright(key, CELL_BITS).alias("cell"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cells = scratch.put(ranked(rows.select("numbered", "cell").distinct().withColumn("all", F.lit("")), "all", ["numbered", "cell"], scratch, "ranges"), "cells")
    here = cells.select(F.col("numbered").alias("numbered2"), F.col("cell").alias("cell2"), "rank")
    follows = cells.select("numbered", "cell", F.expr("(rank + 1) % total").alias("rank")).join(here, "rank").drop("rank")

    place = Window.partitionBy("numbered", "cell").orderBy("key", "text")
    placed = rows.withColumns({"pos": F.row_number().over(place), "after": F.lead("text").over(place)})
    heads = placed.filter("pos = 1").select(F.col("numbered").alias("numbered2"), F.col("cell").alias("cell2"), F.col("text").alias("head"))
    heads = heads.join(follows, ["numbered2", "cell2"])
    joined = placed.join(heads, ["numbered", "cell"])
    last = F.col("after").isNull()
    return joined.select(
        "numbered", "cell", "pos", "doc_id", "text", F.coalesce("after", "head").alias("next_text"),
        F.when(last, F.struct(F.col("numbered2").alias("numbered"), F.col("cell2").alias("cell"), F.lit(1).alias("pos"))).otherwise(F.struct("numbered", "cell", (F.col("pos") + 1).alias("pos"))).alias("next"),
    )


def edited() -> Column:
    """``text`` with its last half replaced by the beginning of ``next_text``."""
    half = F.expr("cast(length(text) div 2 as int)")
    return F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def signed(codes: Column) -> Column:
    """The fingerprint of a text's terms, given as subset and term in one; null without any."""

    def listed(c: Column) -> Column:
        def follow(code: Column, i: Column) -> Column:
            same = F.substring(code, 1, 3) == F.substring(F.get(c, i - 1), 1, 3)
            return F.concat(F.when(same, " ").otherwise(F.when(i > 0, "\n").otherwise("")), code)

        runs = F.split(F.array_join(F.transform(c, follow), ""), "\n")
        return F.array_join(F.transform(runs, lambda run: F.concat(F.substring(run, 1, 3), F.substring(F.md5(run.cast("binary")), 1, 4))), ",")

    whole = bound(bound(F.sort_array(codes), listed), lambda x: F.concat(F.substring(F.md5(x.cast("binary")), 1, 16), F.lit(":"), x))
    return F.when(F.size(codes) > 0, whole)


def fingerprints(texts: DataFrame, words: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``keys`` (which tell rows apart), ``keep``, fingerprint and edited_fingerprint of ``texts`` (with text and edited).

    ``words`` is the lexicon. What is kept travels with one row of each text's list alone.
    """
    kept = F.struct(*keep)
    known = words.unionByName(words.sparkSession.createDataFrame([(NO_TERM, None)], "term string, subset string"))

    def listed(column: str, kind: int) -> Column:
        return F.transform(terms(F.col(column)), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("term"), F.when((w == NO_TERM) & F.lit(kind == 0), kept).alias("kept")))

    each = texts.select(*keys, F.inline(F.concat(listed("text", 0), listed("edited", 1))))
    found = each.join(F.broadcast(known) if words.count() <= MOST_BROADCAST else known, "term")
    code = F.concat("subset", "term")
    codes = [F.collect_list(F.when(F.col("kind") == kind, code)).alias(name) for kind, name in enumerate(("own", "edited"))]
    whole = found.groupBy(*keys).agg(F.first("kept", ignorenulls=True).alias("kept"), *codes)
    return whole.select(*keys, "kept.*", signed(F.col("own")).alias("fingerprint"), signed(F.col("edited")).alias("edited_fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""

    def entries(x: Column) -> Column:
        return F.filter(F.split(F.coalesce(F.get(F.split(x, ":"), F.lit(1)), F.lit("")), ","), lambda e: e != "")

    # each step is bound to a lambda variable, so that none is computed twice
    def levels(x: Column) -> Column:
        subsets = F.array_union(F.transform(x["a"], lambda e: F.substring(e, 1, 3)), F.transform(x["b"], lambda e: F.substring(e, 1, 3)))
        both = (F.array_intersect(x["a"], x["b"]), subsets)
        return F.struct(*[F.array_join(F.transform(k, lambda e: F.substring(e, 1, 1)), "").alias(name) for name, k in zip(("agree", "of"), both)])

    def share(x: Column) -> Column:
        agree = of = F.lit(0)
        for level in LEVELS:
            many = F.length(x["of"]) - F.length(F.replace(x["of"], F.lit(level), F.lit("")))
            alike = F.length(x["agree"]) - F.length(F.replace(x["agree"], F.lit(level), F.lit("")))
            agree, of = agree + F.when(many * 2 <= SLOTS, alike).otherwise(0), of + F.when(many * 2 <= SLOTS, many).otherwise(0)
        return F.coalesce(F.try_divide(agree.cast("double"), of.cast("double")), F.lit(0.0))

    return F.when(a == b, 1.0).otherwise(bound(bound(F.struct(entries(a).alias("a"), entries(b).alias("b")), levels), share))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of each row of ``docs``.

    The edited text is the text with its last half of code points replaced by the first of the next text.
    """
    scratch, place = Scratch(docs.sparkSession, "i-match"), ["numbered", "cell", "pos"]
    words = scratch.put(lexicon(docs), "lexicon")
    texts = with_next(docs, scratch).withColumn("edited", edited())
    sums = {"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "own_sha256": F.sha2(F.col("text").cast("binary"), 256)}
    found = fingerprints(texts.withColumns(sums), words, place, ["doc_id", *sums, "next"])
    # a text without a term in the lexicon is told by all of it
    plain = {name: F.coalesce(name, F.concat(F.lit("="), F.substring(of, 1, 16))) for name, of in (("fingerprint", "own_sha256"), ("edited_fingerprint", "edited_sha256"))}
    stored = scratch.put(found.withColumns(plain).drop("own_sha256"), "prints")
    after = stored.select(F.struct(*place).alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    near = {f"near_{x}": likeness(F.col("fingerprint"), F.col(f"{x}_fingerprint")) for x in ("edited", "next")}
    return stored.join(after, "next").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[v.alias(k) for k, v in near.items()])

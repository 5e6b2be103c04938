"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word is a point: how often it has each letter. One inserted or deleted letter moves a point by one
step, a replaced letter by one step up and one down. Points are held as thermometer codes: a letter has
two bits, "once or more" and "twice or more", and letters beyond a to z share six places; so 32 places
make one 64-bit number. Steps between two codes are at most those between the words, a box of points is
its lowest code (all and-ed) and its highest (all or-ed), and a cut of the tree is a bit.

Searches go per pair of lengths: words of length L among themselves, and words of length L + 1 among
those of length L. A coarse tree for each length, laid out from a bounded sample (:data:`SAMPLE` words in
all, which only decides where cuts lie), deals words into cells; a word is sent as a query to the cells
whose boxes it can reach. A cell that holds more than :data:`CELL_WORDS` is dealt into parts by hash, and
its queries go to each part. A task builds a fine tree over one part at a time and streams queries
through it; what the codes let through is verified letter by letter.

Defined cases: a null text has no words; a null doc_id counts as the empty text in the hash that picks
deletions; rows are counted as they are, repeated or not; a word without near words has null for its
form and itself as its root; other columns do not count; an empty table or one without repeated long
words gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch, text_or_empty
from pitspark.llm.merkle import LOWERED

LEAST_LETTERS, LEAST_COUNT = 7, 2
DELETED_ONE_IN, FORM_TIMES = 31, 10
SAMPLE, SAMPLE_LEAF = 65_536, 16
CELL_WORDS, LEAF_WORDS, QUERIES = 32_768, 48, 4_096
MOST_PAIRS = 1 << 20  # that are verified at a time
PLACES = 32
HOME, SAME, LONGER = 0, 1, 2

#: The place of each code point up to 255 in a code: a to z first, all others in six.
_PLACE = np.array([c - 97 if 97 <= c <= 122 else 26 + c % (PLACES - 26) for c in range(256)], np.uint8)
_ONE = np.uint64(1)


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of the words of all texts, after the deletions that a hash of document and run picks."""
    runs = F.regexp_extract_all(F.translate(text_or_empty("text"), *LOWERED), F.lit(rf"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left(F.col("run"), at), F.substr("run", at + 2))
    words = each.select(F.when(F.col("h") % DELETED_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letters(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each word; all have ``length``."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def codes(chars: np.ndarray) -> np.ndarray:
    """The thermometer code of each row of :func:`letters`."""
    once = np.zeros(len(chars), np.uint64)
    twice = np.zeros(len(chars), np.uint64)
    for column in _PLACE[chars.T]:
        bit = _ONE << (np.uint64(2) * column.astype(np.uint64))
        twice |= once & bit
        once |= bit
    return once | twice << _ONE


def _steps(lacks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(lacks)


def reach(query: np.ndarray, low: np.uint64, high: np.uint64, kind: int) -> np.ndarray:
    """Whether a word one edit away can lie in the box; a longer word loses one letter and gains none."""
    return (_steps(~query & low) <= (kind == SAME)) & (_steps(query & ~high) <= 1)


def best_cut(points: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The bit that halves the points best, and where it is set; None if they are all equal."""
    bits = np.unpackbits(points.astype("<u8").view(np.uint8).reshape(len(points), 8), axis=1, bitorder="little")
    set_ = bits.sum(axis=0, dtype=np.int64)
    k = int(np.abs(2 * set_ - len(points)).argmin())
    return None if set_[k] in (0, len(points)) else (k, bits[:, k].astype(bool))


class Layout:
    """The coarse tree of one length: leaves are cells, each with a number of parts."""

    def __init__(self, sample: np.ndarray, weight: int):
        """``weight`` is the number of words for which one of the sample stands."""
        self.leaves: list[tuple[int, int, int]] = []  # lowest code, highest code, parts
        self.cuts: list[tuple[int, int, int]] = []  # bit, then the nodes below; a leaf is ~its number
        self.top = self._grow(sample, weight, 0, (1 << 64) - 1)

    def _grow(self, points: np.ndarray, weight: int, low: int, high: int) -> int:
        cut = best_cut(points) if len(points) > max(SAMPLE_LEAF, CELL_WORDS // weight) else None
        if cut is None:
            self.leaves.append((low, high, max(1, -(-len(points) * weight // CELL_WORDS))))
            return ~(len(self.leaves) - 1)
        k, there = cut
        node = len(self.cuts)
        self.cuts.append((k, 0, 0))
        # "twice" holds only where "once" does
        below = self._grow(points[~there], weight, low, high & ~(3 << k if k % 2 == 0 else 1 << k))
        above = self._grow(points[there], weight, low | (1 << k if k % 2 == 0 else 3 << k - 1), high)
        self.cuts[node] = (k, below, above)
        return node

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.full(len(points), self.top, np.int64)
        while (open_ := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[open_]):
                here, (k, below, above) = np.flatnonzero(at == node), self.cuts[node]
                at[here] = np.where((points[here] >> np.uint64(k) & _ONE).astype(bool), above, below)
        return ~at

    def reached(self, points: np.ndarray, kind: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each cell with the places of the queries that can reach it."""
        for cell, (low, high, _) in enumerate(self.leaves):
            hit = np.flatnonzero(reach(points, np.uint64(low), np.uint64(high), kind))
            if hit.size:
                yield cell, hit


WHOLE = Layout(np.zeros(0, np.uint64), 1)  # of lengths too rare to be in the sample


def layouts(words: DataFrame, many: int) -> dict[int, Layout]:
    """A coarse tree for each length that the sample has; the sample is one word in ``weight`` by hash."""
    weight = max(1, -(-many // SAMPLE))
    rows = words.filter(F.pmod(F.xxhash64("word"), F.lit(weight)) == 0).select("word").collect()
    by_length: dict[int, list[str]] = {}
    for row in rows:
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    return {n: Layout(codes(letters(found, n)), weight) for n, found in by_length.items()}


ROUTED = "length int, cell int, part int, kind int, word string, n long"


def routed(words: DataFrame, trees: dict[int, Layout]) -> DataFrame:
    """Each word at home in its cell, and as a query in each cell that it can reach."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            every, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.fromiter(map(len, every), np.int64, len(every))
            for length in np.unique(lengths):
                where = np.flatnonzero(lengths == length)
                own = [every[i] for i in where]
                points, tree = codes(letters(own, length)), shared.value.get(int(length), WHOLE)
                hashes = np.fromiter((xxhash.xxh32_intdigest(w) for w in own), np.int64, len(own))
                cells = tree.homes(points)
                parts = hashes % np.array([leaf[2] for leaf in tree.leaves])[cells]
                taken = pa.array(own, pa.string())
                yield _rows(taken, counts[where], length, cells, parts, HOME)
                for shorter, kind in ((length, SAME), (length - 1, LONGER)):
                    if shorter < LEAST_LETTERS:
                        continue
                    other = shared.value.get(int(shorter), WHOLE)
                    for cell, hit in other.reached(points, kind):
                        for part in range(other.leaves[cell][2]):
                            yield _rows(taken.take(pa.array(hit)), counts[where][hit], shorter, np.full(len(hit), cell), np.full(len(hit), part), kind)

    return words.mapInArrow(route, ROUTED)


def _rows(words: pa.Array, counts: np.ndarray, length: int, cells: np.ndarray, parts: np.ndarray, kind: int) -> pa.RecordBatch:
    same = [pa.array(np.full(len(words), x), pa.int32()) for x in (length, kind)]
    columns = [same[0], pa.array(cells, pa.int32()), pa.array(parts, pa.int32()), same[1], words, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["length", "cell", "part", "kind", "word", "n"])


class Fine:
    """The tree over the words at home in one part."""

    def __init__(self, words: pa.Array, counts: np.ndarray, length: int):
        self.words, self.counts, self.length = words, counts, length
        self.chars = letters(words.to_pylist(), length)
        self.points = codes(self.chars)
        self.nodes: list[tuple[np.uint64, np.uint64, int, int, np.ndarray | None]] = []
        self._grow(np.arange(len(words)))

    def _grow(self, own: np.ndarray) -> int:
        points, node = self.points[own], len(self.nodes)
        box = np.bitwise_and.reduce(points), np.bitwise_or.reduce(points)
        self.nodes.append((*box, 0, 0, own))
        if len(own) > LEAF_WORDS and (cut := best_cut(points)):
            self.nodes[node] = (*box, self._grow(own[~cut[1]]), self._grow(own[cut[1]]), None)
        return node

    def near(self, words: pa.Array, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries and of words at home that are one edit apart."""
        chars = letters(words.to_pylist(), self.length + (kind == LONGER))
        points = codes(chars)
        open_, queries, homes, held = [(0, np.arange(len(points)))], [], [], 0
        while open_:
            node, asked = open_.pop()
            low, high, below, above, own = self.nodes[node]
            asked = asked[reach(points[asked], low, high, kind)]
            if asked.size and own is None:
                open_ += [(below, asked), (above, asked)]
            elif asked.size:
                q, h = np.nonzero(np.bitwise_count(points[asked][:, None] ^ self.points[own][None, :]) <= (2 if kind == SAME else 1))
                queries.append(asked[q])
                homes.append(own[h])
                held += len(q)
            if held and (held >= MOST_PAIRS or not open_):
                q, h = np.concatenate(queries), np.concatenate(homes)
                true = self._one_edit(chars[q], self.chars[h], kind)
                yield q[true], h[true]
                queries, homes, held = [], [], 0

    def _one_edit(self, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        """Whether rows of letters differ in one place, or become equal when the longer one loses a letter."""
        if kind == SAME:
            return (a != b).sum(axis=1) == 1
        front = np.logical_and.accumulate(a[:, :-1] == b, axis=1).sum(axis=1)
        back = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
        return front + back >= self.length


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near and near_n of each pair of ``words`` (a stored table) one edit apart, once."""
    parts = routed(words, layouts(words, words.count())).repartition("length", "cell", "part").sortWithinPartitions("length", "cell", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("length", "cell", "part", "kind")], axis=1)
            for start, stop in _runs(keys):
                *now, kind = keys[start].tolist()
                if now != key:
                    key, held, tree = now, [], None
                if kind == HOME:
                    held.append(batch.slice(start, stop - start))
                    continue
                if tree is None:
                    if not held:
                        continue
                    tree = Fine(pa.concat_arrays([b.column("word") for b in held]), np.concatenate([b.column("n").to_numpy() for b in held]), now[0])
                for at in range(start, stop, QUERIES):
                    asked = batch.slice(at, min(QUERIES, stop - at))
                    for q, h in tree.near(asked.column("word"), kind):
                        left, right = asked.column("word").take(pa.array(q)), tree.words.take(pa.array(h))
                        found = pa.RecordBatch.from_arrays([left, pa.array(asked.column("n").to_numpy()[q]), right, pa.array(tree.counts[h])], names=["word", "n", "near", "near_n"])
                        # words of one length meet from both sides; one is enough
                        yield found if kind == LONGER else found.filter(pc.less(left, right))

    return parts.mapInArrow(search, "word string, n long, near string, near_n long")


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where equal rows begin and end."""
    if not len(keys):
        return []
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of each word of ``forms`` (word, form): where its forms lead to.

    A form occurs :data:`FORM_TIMES` times as often as its word, so chains end; each round doubles what is
    followed and is stored, so that a chain of k takes about log2(k) rounds.
    """
    now = scratch.put(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 64):
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(beyond, "root", "left")
        stepped = scratch.put(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{k}")
        scratch.drop(f"roots-{k - 1}")
        now = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            break
    return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put(word_counts(docs), "words")
    pairs = scratch.put(near_pairs(words), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), best.alias("best"))
    often = -F.col("best.minus") >= FORM_TIMES * F.col("n")
    judged = scratch.put(found.select("word", "n_near", F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n")), "judged")
    scratch.drop("pairs")
    ends = roots(judged.filter("form is not null"), scratch)
    out = words.join(judged, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")

"""A hierarchical Pitman-Yor language model over words.

Every word is a context with a restaurant of its own, and so is the start of a text. All share a parent,
the unigram restaurant. Its base measure is even over the known words and one class of unknown words, so
an unknown word gets one share in V + 1 of the parent's new tables. A cell is a dish (word) in a
restaurant: its customers are the training counts, its tables are sampled. Each table of a restaurant is
a customer of the parent.

Sampling is blocked Gibbs: a sweep takes all customers of each cell out and draws its number of tables
from the conditional (Stirling numbers count the seatings that a number of tables stands for). Other
cells' tables and the parent's measure are as of the sweep's start, as in distributed Gibbs sampling; the
parent's dishes are swept in turn. For cells of more than :data:`SMALL` customers the Stirling numbers
come from a saddle point. The first :data:`BURN_IN` sweeps are passed over; predictive probabilities are averaged over the
next :data:`SAMPLES`.

The work is messages between three kinds of places, each a group of rows in a Spark shuffle. Batches of
texts send their distinct cells to buckets; a bucket holds whole restaurants. Each sweep, buckets send
the customers of their dishes to parts of the parent (ranges of the words' hashes), which send sums and
tables back. At the end buckets answer the batches, cell by cell. What a bucket or a part holds is
bounded by its share of the corpus; a restaurant that would fill more than a quarter of a bucket is split
by dish, and its totals are summed by the parts too. Which ones are split is estimated from a sample and
decides only where a cell lies: random numbers come from hashes of context, word and sweep, so scores are
a function of the rows, whatever the partitions.

Defined cases: a null text counts as empty and holds the end token alone; rows with equal ids or texts
are scored one by one; with no training row every word is unknown; 64-bit hashes stand for words; the
texts are read twice, and rows that come differently the second time (from a source without a stable
order) end the job with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import Scratch, slices, text_or_empty

BATCH_TOKENS = 1 << 21
BUCKET_BYTES = 12 << 20  # of text for each bucket, about
BUCKETS_A_PART = 2
SAMPLE_BYTES = 32 << 20  # of text, or a 1,024th, to estimate which restaurants to split
SMALL = 256
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
END = np.uint64(0x2D06800538D394C2)  # the hash of the empty word: the end, and the context of a start

MESSAGE = "to long, kind int, sender long, blobs array<binary>, sums array<long>"
NAMES = ["to", "kind", "sender", "blobs", "sums"]
REQUEST, CELLS, SEATS, SENT, PARENT, REPLY, TEXTS, ANSWER = range(8)


# ---- seating ------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the outcome depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number from 0 to 1 for each key, of this sweep."""
    turn = np.uint64((sweep * 0x9E3779B97F4A7C15) % (1 << 64))
    return (_mixed(keys + turn) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def stirling(discount: float, most: int = SMALL) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t) for c, t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, t] + np.log(np.maximum(c - t * discount, 1e-300))
            out[c + 1, t] = np.logaddexp(out[c, t - 1], np.where(np.isfinite(out[c, t]), stay, -np.inf))
    return out


def many_tables(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, chance: np.ndarray) -> np.ndarray:
    """Draws near the conditional for cells too large for the table of Stirling numbers.

    These have the generating function g(x)**t / t! with g(x) = (1 - (1 - x)**d) / d. At its saddle point,
    x * (1 - x)**(d - 1) = c / a, the conditional is largest at t = a * g(x), where a is the weight of a new
    table; there, t - 1 is about Poisson, the less so the more customers sit alone."""
    mean = np.ones(len(customers))
    for _ in range(12):
        weight = (STRENGTH + discount * (others + mean)) * base
        low, high = np.full(len(customers), -700.0), np.full(len(customers), -1e-12)  # of log(1 - x)
        for _ in range(50):
            middle = (low + high) / 2
            above = np.log(-np.expm1(middle)) + (discount - 1) * middle > np.log(customers / weight)
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        mean = np.minimum(weight * -np.expm1(discount * low) / discount, customers - 1.0)
    few = np.zeros(len(customers))
    term = np.exp(-np.minimum(mean, 30))
    reached = term.copy()
    for k in range(1, 80):
        few += chance >= reached
        term = term * np.minimum(mean, 30) / k
        reached += term
    wide = np.sqrt(mean * (1 - mean / customers)) * np.log(np.clip(chance, 1e-9, 1 - 1e-9) / np.clip(1 - chance, 1e-9, 1)) / 1.702
    drawn = np.where(mean < 16, few, np.rint(mean + wide))
    return np.clip(1 + drawn, 1, customers).astype(np.int64)


def swept(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, logs: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """A new number of tables for each cell of two customers or more, given the ``others`` of its restaurant."""
    tables = tables.copy()
    large = np.flatnonzero(customers > SMALL)
    tables[large] = many_tables(customers[large], others[large], base[large], discount, chance[large])
    some = np.flatnonzero((customers > 1) & (customers <= SMALL))
    some = some[np.argsort(customers[some], kind="stable")]
    ends = np.cumsum(np.bincount(customers[some], minlength=SMALL + 1))
    for c in np.flatnonzero(np.diff(ends, prepend=0)):
        for a in range(ends[c - 1], ends[c], 1 << 16):
            mine = some[a : min(a + (1 << 16), ends[c])]
            weights = np.cumsum(np.log((STRENGTH + discount * (others[mine, None] + np.arange(c))) * base[mine, None]), 1) + logs[c, 1 : c + 1]
            shares = np.cumsum(np.exp(weights - weights.max(1, keepdims=True)), 1)
            tables[mine] = 1 + (shares < chance[mine, None] * shares[:, -1:]).sum(1)
    return tables


@dataclass(frozen=True)
class Totals:
    """What every place needs to know of the whole: sizes of the parent, words and discounts."""

    customers: int  # of the parent
    tables: int  # of the parent
    words: int
    discount: float
    parent_discount: float

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The unigram probabilities of dishes."""
        new = (STRENGTH + self.parent_discount * self.tables) * self.base
        return (customers - self.parent_discount * tables + new) / (STRENGTH + self.customers)

    def child(self, customers: np.ndarray, tables: np.ndarray, of_context: np.ndarray, tables_of_context: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """The probabilities of cells in their restaurants."""
        new = (STRENGTH + self.discount * tables_of_context) * parent
        return (customers - self.discount * tables + new) / (STRENGTH + of_context)


# ---- messages -----------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> list[bytes]:
    """Each array as bytes: first those of lowest value, so that small numbers leave runs of zeros."""
    import zstandard

    return [zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes(), 1) for a in arrays]


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    plain = np.frombuffer(zstandard.decompress(data, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _message(to: int, kind: int, sender: int, blobs: list[bytes], sums: list[int] | None = None) -> pa.RecordBatch:
    columns = [pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([sender], pa.int64()), pa.array([blobs], pa.list_(pa.binary())), pa.array([sums], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


Mail = dict[int, list[tuple[int, list[bytes]]]]


def delivered(messages: DataFrame, places: int, act: Callable[[int, Mail], Iterator[pa.RecordBatch]], schema: str = MESSAGE, numbered: bool = True) -> DataFrame:
    """What ``act`` yields for each addressee and its mail: by kind, senders in order with their blobs.

    Numbered addressees (from 0 to ``places``) have a partition each; others are dealt by hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mail = None, {}
        for batch in slices(batches, 16):
            for to, kind, sender, blobs in zip(*(batch.column(c).to_pylist() for c in NAMES[:4])):
                if to != now and mail:
                    yield from act(now, mail)
                    mail = {}
                now = to
                mail.setdefault(kind, []).append((sender, blobs))
        if mail:
            yield from act(now, mail)

    dealt = messages.repartitionById(places, F.col("to").cast("int")) if numbered else messages.repartition(places, "to")
    return dealt.sortWithinPartitions("to", "kind", "sender").mapInArrow(work, schema)


# ---- texts --------------------------------------------------------------------------------------


def _source(docs: DataFrame, training: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of a text, then the end."""
    import xxhash

    words = text.encode().lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


@dataclass(frozen=True)
class Split:
    """Restaurants in more than one bucket, and the buckets of cells."""

    contexts: np.ndarray  # sorted
    shares: np.ndarray  # into how many each is split
    buckets: int

    def of(self, contexts: np.ndarray) -> np.ndarray:
        """Which contexts are split."""
        if not len(self.contexts):
            return np.zeros(len(contexts), bool)
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return self.contexts[at] == contexts

    def places(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        share = np.zeros(len(contexts), np.uint64)
        split = np.flatnonzero(self.of(contexts))
        if len(split):
            at = np.searchsorted(self.contexts, contexts[split])
            share[split] = _mixed(words[split]) % self.shares[at].astype(np.uint64)
        return (_mixed(contexts + share) % np.uint64(self.buckets)).astype(np.int64)


@dataclass
class Batch:
    """Some texts as distinct cells, in order of bucket, context and word, and the cell of each token."""

    name: int
    doc_ids: pa.Array
    lengths: np.ndarray
    cell_of: np.ndarray
    place: np.ndarray
    context: np.ndarray
    word: np.ndarray
    customers: np.ndarray


def batches_of(rows: Iterator[pa.RecordBatch], split: Split) -> Iterator[Batch]:
    """The texts of a task, some at a time; a name tells the task, the turn and the texts."""
    import xxhash
    from pyspark import TaskContext

    def made(turn: int) -> Batch:
        lengths = np.array([len(t) for t in texts])
        tokens = np.concatenate(texts)
        name = xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=(TaskContext.get().partitionId() << 24) + turn) >> 1
        words, ids = np.unique(tokens, return_inverse=True)
        before = np.concatenate([[np.searchsorted(words, END)], ids[:-1]])
        cells, cell_of = np.unique(before * len(words) + ids, return_inverse=True)
        learnt = np.bincount(cell_of[np.repeat(np.concatenate(training), lengths)], minlength=len(cells))
        context, word = words[cells // len(words)], words[cells % len(words)]
        place = split.places(context, word)
        order = np.argsort(place, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return Batch(name, pa.concat_arrays(ids_), lengths, rank[cell_of], place[order], context[order], word[order], learnt[order])

    texts, training, ids_, turn, size = [], [], [], 0, 0
    for batch in slices(rows, 256):
        texts += [words_of(t) for t in batch.column("text").to_pylist()]
        training.append(batch.column("training").to_numpy(zero_copy_only=False).astype(bool))
        ids_.append(batch.column("doc_id"))
        size += sum(len(t) for t in texts[len(texts) - batch.num_rows :])
        if size >= BATCH_TOKENS:
            yield made(turn)
            texts, training, ids_, turn, size = [], [], [], turn + 1, 0
    if texts:
        yield made(turn)


def split_restaurants(source: DataFrame, size: int, buckets: int, scratch: Scratch) -> Split:
    """Contexts that would fill more than a quarter of a bucket, as a sample of the texts has it."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows, 2048):
            if batch.num_rows:
                words, n = np.unique(np.concatenate([words_of(t) for t in batch.column("text").to_pylist()]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    fraction = min(1.0, max(1 / 1024, SAMPLE_BYTES / max(1, size)))
    counts = scratch.put(source.select("text").sample(fraction, 1).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample")
    every = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * 4 * buckets > every).orderBy("word").collect() if buckets > 1 else []  # fewer than 4 * buckets rows
    scratch.drop("sample")
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    shares = np.array([-(-r["n"] * 4 * buckets // every) for r in found], np.int64)
    order = np.argsort(words)
    return Split(words[order], shares[order], buckets)


# ---- the model ----------------------------------------------------------------------------------


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the parent that a word belongs to: a range of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _posted(bucket: int, words: np.ndarray, of_words: list[np.ndarray], contexts: np.ndarray, of_contexts: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """A bucket's numbers of its words and of the split contexts, to the parts."""
    ends, far = (np.searchsorted(_part(x, parts), np.arange(parts + 1)) for x in (words, contexts))
    for p in range(parts):
        a, b, c, d = ends[p], ends[p + 1], far[p], far[p + 1]
        if b > a or d > c:
            yield _message(p, SENT, bucket, packed(words[a:b], contexts[c:d], *[x[c:d] for x in of_contexts], *[x[a:b].astype("<i8") for x in of_words]))


class Bucket:
    """Whole restaurants (or shares of split ones): cells in order of context and word."""

    def __init__(self, blobs: list[bytes], split: Split):
        self.contexts, self.words = (unpacked(b, "<u8") for b in blobs[:2])
        self.context, self.word = (unpacked(b, "<u4").astype(np.int64) for b in blobs[2:4])
        self.customers = unpacked(blobs[4], "<i8")
        self.senders, self.lengths, self.steps = unpacked(blobs[5], "<i8"), unpacked(blobs[6], "<i8"), blobs[7]
        self.far = np.flatnonzero(split.of(self.contexts))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, len(self.contexts)).astype(np.int64)

    def posted(self, name: int, tables: np.ndarray, counts: bool, parts: int) -> Iterator[pa.RecordBatch]:
        of_words = [np.bincount(self.word, x, len(self.words)) for x in ((tables, self.customers) if counts else (tables,))]
        of_contexts = [self.sums(x)[self.far] for x in (tables, self.customers)]
        return _posted(name, self.words, of_words, self.contexts[self.far], of_contexts, parts)

    def state(self, tables: np.ndarray, replies: list[list[bytes]], totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tables and customers of the restaurants, the parent's measure of the words, and of the cells' dishes."""
        of_tables, of_customers = self.sums(tables), self.sums(self.customers)
        columns = [np.concatenate([unpacked(r[k], "<i8") for r in replies]) for k in range(4)]
        of_tables[self.far], of_customers[self.far] = columns[:2]
        parent = totals.parent(columns[2], columns[3])
        return of_tables, of_customers, parent, parent[self.word]

    def asked(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each batch and its cells here."""
        steps, at = unpacked(self.steps, "<u4").astype(np.int64), 0
        for sender, n in zip(self.senders.tolist(), self.lengths.tolist()):
            yield sender, np.cumsum(steps[at : at + n])
            at += n


def requests(source: DataFrame, split: Split) -> DataFrame:
    """The distinct cells of each batch and their training counts, to the buckets."""

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, split):
            ends = np.searchsorted(batch.place, np.arange(split.buckets + 1))
            for b in range(split.buckets):
                some = slice(ends[b], ends[b + 1])
                if ends[b + 1] > ends[b]:
                    context = batch.context[some]
                    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    runs = np.diff(np.append(starts, len(context))).astype("<u4")
                    yield _message(b, REQUEST, batch.name, packed(context[starts], runs, batch.word[some], batch.customers[some].astype("<u4")))

    return source.select("doc_id", "text", "training").mapInArrow(ask, MESSAGE)


def gathered(bucket: int, mail: Mail) -> Iterator[pa.RecordBatch]:
    """The cells of a bucket, and which of them each batch asked for."""
    senders = [sender for sender, _ in mail[REQUEST]]
    runs = [(unpacked(b[0], "<u8"), unpacked(b[1], "<u4"), unpacked(b[2], "<u8"), unpacked(b[3], "<u4")) for _, b in mail[REQUEST]]
    lengths = np.array([len(r[2]) for r in runs], "<i8")
    contexts, context = np.unique(np.concatenate([np.repeat(r[0], r[1]) for r in runs]), return_inverse=True)
    words, word = np.unique(np.concatenate([r[2] for r in runs]), return_inverse=True)
    cells, cell_of = np.unique(context * len(words) + word, return_inverse=True)
    customers = np.bincount(cell_of, np.concatenate([r[3] for r in runs]), len(cells)).astype("<i8")
    steps = np.diff(cell_of, prepend=0)
    starts = np.cumsum(lengths) - lengths
    steps[starts] = cell_of[starts]
    blobs = packed(contexts, words, (cells // len(words)).astype("<u4"), (cells % len(words)).astype("<u4"), customers, np.array(senders, "<i8"), lengths, steps.astype("<u4"))
    yield _message(bucket, CELLS, -1, blobs, [int((customers == 1).sum()), int((customers == 2).sum()), int(customers.sum())])


def _summed(messages: DataFrame, kind: int, n: int) -> list[int]:
    row = messages.filter(F.col("kind") == kind).agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(n)]).first()
    return [int(x or 0) for x in row]


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def _exchange(part: int, mail: Mail, sweep: int, totals: Totals | None) -> Iterator[pa.RecordBatch]:
    """The parent's sweep over a range of words: sums and tables go back to each bucket."""
    sent = [[unpacked(b, "<u8" if k < 2 else "<i8") for k, b in enumerate(blobs)] for _, blobs in mail[SENT]]
    words, word = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
    contexts, context = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
    of_contexts = [np.bincount(context, np.concatenate([s[k] for s in sent]), len(contexts)).astype(np.int64) for k in (2, 3)]
    of_words = [np.bincount(word, np.concatenate([s[k] for s in sent]), len(words)).astype(np.int64) for k in range(4, len(sent[0]))]
    customers = of_words[0]
    tables = np.minimum(customers, 1)
    if totals is not None:
        before = np.clip(unpacked(mail[PARENT][0][1][0], "<i8"), tables, customers)
        others = np.maximum(0, totals.tables - before)
        tables = swept(customers, before, others, np.full(len(words), totals.base), totals.parent_discount, stirling(totals.parent_discount), uniform(_mixed(words), sweep))
    yield _message(part, PARENT, -1, packed(tables), [int(customers.sum()), int(tables.sum()), int((customers > 0).sum()), int((customers == 1).sum()), int((customers == 2).sum())])
    at, far = 0, 0
    for (bucket, _), s in zip(mail[SENT], sent):
        mine, own = word[at : at + len(s[0])], context[far : far + len(s[1])]
        yield _message(bucket, REPLY, part, packed(*[x[own] for x in of_contexts], customers[mine], tables[mine], *[x[mine] for x in of_words[1:]]))
        at, far = at + len(s[0]), far + len(s[1])


def fit(source: DataFrame, scratch: Scratch) -> tuple[DataFrame, Split, list[int]]:
    """Answers to the batches (log10 probability and training count of the word, cell by cell), the split
    of the restaurants, and the numbers of training tokens and of known words."""
    size = int(source.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES))
    parts = max(1, buckets // BUCKETS_A_PART)
    split = split_restaurants(source, size, buckets, scratch)
    cells = scratch.put(delivered(requests(source, split), buckets, gathered), "cells")
    ones, twos, tokens = _summed(cells, CELLS, 3)

    def first(bucket: int, mail: Mail) -> Iterator[pa.RecordBatch]:
        b = Bucket(mail[CELLS][0][1], split)
        yield from b.posted(bucket, np.minimum(b.customers, 1), False, parts)

    seats = scratch.put(delivered(cells, buckets, first), "seats0")
    totals: Totals | None = None
    discount, parent_discount = _discount(ones, twos), 0.5
    parent = None
    for sweep in range(BURN_IN + SAMPLES):
        sent = seats.filter(F.col("kind") == SENT)
        if parent is not None:
            sent = sent.unionByName(parent.filter(F.col("kind") == PARENT))
        before, old = parent, totals
        parent = scratch.put(delivered(sent, parts, lambda p, mail, old=old, sweep=sweep: _exchange(p, mail, sweep, old)), f"parent{sweep}")
        customers, tables, words, once, twice = _summed(parent, PARENT, 5)
        if totals is None:
            parent_discount = _discount(once, twice)
        totals = Totals(customers, tables, words, discount, parent_discount)
        replies = parent.filter(F.col("kind") == REPLY)
        last = sweep == BURN_IN + SAMPLES - 1
        mine = cells.unionByName(seats.filter(F.col("kind") == SEATS)).unionByName(replies)
        act = _answers(split, totals) if last else _seating(split, totals, sweep, parts)
        after = scratch.put(delivered(mine, buckets, act), "answers" if last else f"seats{sweep + 1}")
        scratch.drop(f"seats{sweep}", *([f"parent{sweep - 1}"] if before is not None else []))
        seats = after
    scratch.drop("cells", f"parent{sweep}")
    return seats, split, [tokens, totals.words]


def _opened(mail: Mail, split: Split, totals: Totals, counted: bool) -> tuple[Bucket, np.ndarray, np.ndarray, list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket with its tables and its sums of probabilities, those of now included where they count."""
    b, replies = Bucket(mail[CELLS][0][1], split), [blobs for _, blobs in mail[REPLY]]
    held = mail[SEATS][0][1] if SEATS in mail else None
    tables = unpacked(held[0], "<u4").astype(np.int64) if held else np.minimum(b.customers, 1)
    of_tables, of_customers, _, dish = b.state(tables, replies, totals)
    mean = unpacked(held[1], "<f4").astype(np.float64) if held and len(held) > 1 else np.zeros(len(tables))
    if counted:
        mean += totals.child(b.customers, tables, of_customers[b.context], of_tables[b.context], dish)
    return b, tables, mean, replies, of_tables, of_customers, dish


def _seating(split: Split, totals: Totals, sweep: int, parts: int) -> Callable[[int, Mail], Iterator[pa.RecordBatch]]:
    """A bucket's sweep; the seating that it starts from counts as a sample after the burn-in."""
    counts = sweep == BURN_IN + SAMPLES - 2  # the next exchange, the last, sums training counts too

    def act(bucket: int, mail: Mail) -> Iterator[pa.RecordBatch]:
        b, tables, mean, _, of_tables, _, dish = _opened(mail, split, totals, sweep >= BURN_IN)
        others = np.maximum(0, of_tables[b.context] - tables)
        keys = _mixed(b.contexts[b.context] ^ _mixed(b.words[b.word]))
        tables = swept(b.customers, tables, others, dish, totals.discount, stirling(totals.discount), uniform(keys, sweep))
        yield _message(bucket, SEATS, -1, packed(tables.astype("<u4"), *([mean.astype("<f4")] if sweep >= BURN_IN else [])))
        yield from b.posted(bucket, tables, counts, parts)

    return act


def _answers(split: Split, totals: Totals) -> Callable[[int, Mail], Iterator[pa.RecordBatch]]:
    def act(bucket: int, mail: Mail) -> Iterator[pa.RecordBatch]:
        b, _, mean, replies, _, _, _ = _opened(mail, split, totals, True)
        logs = np.log10(mean / SAMPLES).astype("<f4")
        counts = np.concatenate([unpacked(r[4], "<i8") for r in replies])[b.word]
        for sender, some in b.asked():
            yield _message(sender, ANSWER, bucket, packed(logs[some], counts[some]))

    return act


SCORES = "doc_id long, n_tokens long, n_known long, base double, score double"


def _texts(source: DataFrame, split: Split) -> DataFrame:
    """Each batch's documents and their tokens as places in the answers to come."""

    def tell(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, split):
            ids = batch.doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            known = np.asarray(batch.doc_ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            yield _message(batch.name, TEXTS, -1, packed(ids, known, batch.lengths.astype("<i8"), batch.cell_of.astype("<u4")))

    return source.select("doc_id", "text", "training").mapInArrow(tell, MESSAGE)


def _scores(name: int, mail: Mail) -> Iterator[pa.RecordBatch]:
    """The sums of each text of a batch."""
    if TEXTS not in mail or ANSWER not in mail:
        raise RuntimeError("documents came in another order at the second reading: store them first")
    ids, known, lengths, cell_of = (unpacked(b, kind) for b, kind in zip(mail[TEXTS][0][1], ("<i8", "u1", "<i8", "<u4")))
    logs, counts = (np.concatenate([unpacked(blobs[k], kind) for _, blobs in mail[ANSWER]]) for k, kind in ((0, "<f4"), (1, "<i8")))
    row = np.repeat(np.arange(len(lengths)), lengths)
    counts = counts[cell_of]
    sums = [np.bincount(row, x, len(lengths)) for x in (counts > 0, np.log10(counts + 1.0), logs[cell_of].astype(np.float64))]
    columns = [pa.array(ids, mask=known == 0), pa.array(lengths), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")])


def scored(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    source = _source(docs, training)
    scratch = Scratch(source.sparkSession, "pitman-yor")
    answers, split, (tokens, words) = fit(source, scratch)
    each = delivered(_texts(source, split).unionByName(answers), split.buckets, _scores, SCORES, numbered=False)
    norm = float(np.log10(tokens + words + 1))
    return each.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score")

"""Packing of token sequences into windows by minimum bin slack.

A document is cut at every multiple of the capacity; the whole windows stand alone and the remainders
are packed. Which remainders share a window depends on how many there are of each length, and there are
fewer lengths than the capacity, so the plan is made on that small table of counts: the longest
remaining length opens a window, a bitset subset-sum over the remaining lengths (counts split into
powers of two) finds the fullest total that fits beside it, and the counts that reach it are traced
back. A pattern so found serves as many windows as the counts allow. Documents then take the places of
their length by rank, which is a count over buckets and a row number within a bucket.

Defined cases: a null text counts as empty (the end id alone); a document id may be null or repeat (rows
of one id are packed like rows of different ids); an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.common import slices, text_or_empty, written
from pitspark.llm.tokens import text_encoder

CAPACITY = 2048
#: Rows of one length that share a bucket, about; a bucket is what one task ranks at a time.
BUCKET_ROWS = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie long"


def fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is the largest that is at most ``room``."""
    lengths = [int(x) for x in np.nonzero(counts[: room + 1])[0] if x > 0][::-1]
    layers: list[tuple[int, int, int]] = []  # (length, copies, the sums that were there before)
    mask, reached = (1 << (room + 1)) - 1, 1
    for length in lengths:
        left, copies = min(int(counts[length]), room // length), 1
        while left > 0 and not reached >> room & 1:
            copies = min(copies, left)
            layers.append((length, copies, reached))
            reached |= (reached << (length * copies)) & mask
            left, copies = left - copies, copies * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, copies, before in reversed(layers):
        if not before >> total & 1:
            total -= length * copies
            chosen[length] = chosen.get(length, 0) + copies
    return chosen


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(windows, lengths and their counts in each) until nothing of ``counts`` (by length) is left."""
    counts, made = counts.astype(np.int64).copy(), []
    while (rest := np.nonzero(counts)[0]).size:
        longest = int(rest[-1])
        counts[longest] -= 1
        pattern = fullest(counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        windows = min(int(counts[x]) // n for x, n in pattern.items())
        for x, n in pattern.items():
            counts[x] -= n * windows
        made.append((windows, pattern))
    return made


class Places:
    """For each length: the places of its ranks, as runs of windows."""

    def __init__(self, made: list[tuple[int, dict[int, int]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first, taken = 0, {}
        for windows, pattern in made:
            at = 0
            for length in sorted(pattern, reverse=True):
                runs.setdefault(length, []).append((taken.get(length, 0), first, pattern[length], at))
                taken[length] = taken.get(length, 0) + windows * pattern[length]
                at += length * pattern[length]
            first += windows
        self.runs = {k: np.array(v, dtype=np.int64).T for k, v in runs.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window of each piece and its offset there."""
        window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            mine = length == x
            from_rank, first, copies, at = self.runs[int(x)]
            k = np.searchsorted(from_rank, rank[mine], side="right") - 1
            since = rank[mine] - from_rank[k]
            window[mine] = first[k] + since // copies[k]
            offset[mine] = at[k] + since % copies[k] * x
        return window, offset


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, width: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: whole windows and a remainder, each with the checksum of its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, keeps_space, width)
        end = int(end_id).to_bytes(width, "little")
        for batch in slices(batches):
            rows = []
            for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                ids = np.frombuffer(encoded + end, f"<u{width}").astype("<u4")
                tie = zlib.crc32(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), tie))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (see :func:`token_pieces`).

    What reaches the driver is one count for each length, at most ``capacity`` rows.
    """
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in by_length.items():
        counts[length] = n
    places = Places(plan(counts, capacity))
    buckets = max(1, -(-int(counts.max(initial=0)) // BUCKET_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            window, offset = places.find(length, rank)
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(window), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    bucket: Column = F.pmod(F.xxhash64("doc_id", "start", "tie"), F.lit(buckets))
    dealt = pieces.withColumn("bucket", bucket)
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "tie")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", (F.col("before") + F.col("within")).cast("long"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, width: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Cuts, stores the cut pieces, plans and places: one row for each piece."""
    return pack(written(token_pieces(docs, tokenizer, end_id, keeps_space, width, capacity), "pieces"), capacity)

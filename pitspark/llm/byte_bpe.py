"""Byte-level BPE by a hierarchical-bitmap rank queue, and its decoding.

The bytes of a pre-token form a linked list. A pair of neighbours that the vocabulary joins waits in the
bucket of the joined token's rank, by its position, and a bucket is worked through from left to right,
unless a pair of its own or a lower rank turns up, which then comes first. Two levels of bitmaps say which buckets hold
anything; finding the first set bit at each level gives the next rank. An entry whose neighbours have
changed since it was put there is stale and is passed over when it comes up. So a pre-token of n bytes
takes about n log n steps however long it is, where a search for the best pair after each merge takes
n squared.

Defined cases: a null text counts as empty, which has no ids; ties between equal pairs go to the
leftmost; all 256 single bytes are in the vocabulary, so that any text can be encoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import slices, text_or_empty
from pitspark.llm.tokens import CACHED_PIECES, LONGEST_CACHED, pieces_with_space

LEAF_BITS = 8  # ranks that share a leaf bitmap: 2**LEAF_BITS
LEAF_MASK = (1 << LEAF_BITS) - 1


class Merges:
    """The ranks, and which joined token each pair of tokens makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.zeros(256, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        self.wall = max(ranks.values()) + 1  # stands between pre-tokens and joins with nothing
        self.base = self.wall + 1
        self.pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    self.pairs[left * self.base + right] = rank
        self.first = np.full((256, 256), -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank


def merge_all(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each pre-token; one queue serves all of them, with a wall after each."""
    if not pieces:
        return []
    data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    walls = np.cumsum([len(p) + 1 for p in pieces]) - 1
    tokens = merges.single[data]
    tokens[walls] = merges.wall
    start = np.full(len(data), -1, np.int64)
    start[:-1] = merges.first[data[:-1], data[1:]]
    start[walls] = -1
    start[walls[walls > 0] - 1] = -1
    at = np.flatnonzero(start >= 0)
    at = at[np.argsort(start[at], kind="stable")]
    found, begins = np.unique(start[at], return_index=True)

    buckets: dict[int, list[int]] = {}  # positions by rank
    leaves: dict[int, int] = {}
    summary = 0
    for rank, some in zip(found.tolist(), np.split(at, begins[1:])):
        buckets[rank] = some.tolist()
        leaves[rank >> LEAF_BITS] = leaves.get(rank >> LEAF_BITS, 0) | 1 << (rank & LEAF_MASK)
        summary |= 1 << (rank >> LEAF_BITS)

    ids, wanted = tokens.tolist(), start.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    joins, base = merges.pairs.get, merges.base
    while summary:
        leaf = (summary & -summary).bit_length() - 1
        bits = leaves[leaf]
        low = bits & -bits
        rank = leaf << LEAF_BITS | low.bit_length() - 1
        leaves[leaf] = bits = bits ^ low
        if not bits:
            summary ^= 1 << leaf
        bucket = buckets.pop(rank)
        bucket.sort()
        lowest = rank + 1
        for k, i in enumerate(bucket):
            if wanted[i] != rank:
                continue  # stale
            j = after[i]
            end = after[j]
            left = before[i]
            ids[i] = rank
            wanted[j] = -1
            after[i] = end
            before[end] = i
            new = joins(rank * base + ids[end])
            if new is None:
                wanted[i] = -1
            else:
                wanted[i] = new
                bucket_of = buckets.get(new)
                if bucket_of is not None:
                    bucket_of.append(i)
                else:
                    buckets[new] = [i]
                    leaf = new >> LEAF_BITS
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (new & LEAF_MASK)
                    summary |= 1 << leaf
                if new < lowest:
                    lowest = new
            if left >= 0:
                new = joins(ids[left] * base + rank)
                if new is None:
                    wanted[left] = -1
                else:
                    wanted[left] = new
                    bucket_of = buckets.get(new)
                    if bucket_of is not None:
                        bucket_of.append(left)
                    else:
                        buckets[new] = [left]
                        leaf = new >> LEAF_BITS
                        leaves[leaf] = leaves.get(leaf, 0) | 1 << (new & LEAF_MASK)
                        summary |= 1 << leaf
                    if new < lowest:
                        lowest = new
            if lowest <= rank and k + 1 < len(bucket):
                # something that comes before the rest of this bucket has turned up: put the rest back
                buckets.setdefault(rank, []).extend(bucket[k + 1 :])
                leaf = rank >> LEAF_BITS
                leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & LEAF_MASK)
                summary |= 1 << leaf
                break
    out, one, i, wall = [], [], 0, merges.wall
    while i < n:
        if ids[i] == wall:
            out.append(one)
            one = []
        else:
            one.append(ids[i])
        i = after[i]
    return out


def merge(piece: bytes, merges: Merges) -> list[int]:
    """The ids of one pre-token."""
    whole = merges.ranks.get(piece)
    return [whole] if whole is not None else merge_all([piece], merges)[0]


class ByteBpe:
    """Encodes and decodes with a file of ranks (base64 token, space, rank on each line)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.merges = Merges(ranks)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.text_of = {rank: b"%d" % rank for rank in ranks.values()}
        self.matches = regex.compile(pattern).findall
        self.cache: dict[bytes, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces of text, 4 bytes each; their new pre-tokens are merged together."""
        known, ranks = self.pre_tokens, self.merges.ranks
        split = [self.matches(part.decode()) for part in missing]
        new = list(set().union(*split).difference(known))
        whole = [ranks.get(m.encode()) for m in new]
        merged = iter(merge_all([m.encode() for m, w in zip(new, whole) if w is None], self.merges))
        found = {m: array("I", next(merged) if w is None else (w,)).tobytes() for m, w in zip(new, whole)}
        known.update((m, ids) for m, ids in found.items() if len(m) <= LONGEST_CACHED)
        return {part: b"".join([known[m] if m in known else found[m] for m in matches]) for part, matches in zip(missing, split)}

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        lists = [pieces_with_space(t) for t in texts]
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        if len(self.pre_tokens) > CACHED_PIECES:
            self.pre_tokens.clear()
        cache, long = self.cache, {}
        for part, ids in self._learn(list(set().union(*lists).difference(cache))).items():
            (cache if len(part) <= LONGEST_CACHED else long)[part] = ids
        for parts in lists:
            found = [long[p] if p in long else cache[p] for p in parts] if long else map(cache.__getitem__, parts)
            yield array("I", b"".join(found)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decimal(self, ids: list[int]) -> bytes:
        return b" ".join(map(self.text_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process."""
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of its text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in slices(batches, 4096):
            ids = pa.array(coder.encode(batch.column("text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in slices(batches, 4096):
            found = pa.array([coder.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes each text, decodes the ids, and gives digests of both, without the ids leaving the task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in slices(batches, 4096):
            rows = []
            for ids in coder.encode(batch.column("text").to_pylist()):
                rows.append((len(ids), hashlib.sha256(coder.decimal(ids)).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

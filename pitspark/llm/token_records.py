"""Token ids in length-delimited binary records with masked checksums and an offset index.

Each shard file is a run of frames: the payload's length (8 bytes), the masked CRC-32C of those bytes,
the payload, the masked CRC-32C of the payload; all little-endian. A payload is a 16-byte header
(document id, number of ids, bytes an id takes, 1 if the document id is null) and then the ids. The
index is a Parquet table beside the shards with one row for each frame, so that a reader can fetch
frames in any order.

Defined cases: a null text counts as empty and holds the end id alone; a null document id is written
and comes first; rows with equal ids are all written, in the order of their texts; an empty table gives
no shard and an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitspark.llm.common import AtomicFile, filesystem, shared_dir, slices, text_or_empty, written
from pitspark.llm.crc32c import crc32c, masked
from pitspark.llm.tokens import text_encoder

HEADER = struct.Struct("<qIHH")
LENGTH = struct.Struct("<Q")
CHECK = struct.Struct("<I")
OVERHEAD = LENGTH.size + 2 * CHECK.size

INDEX = pa.schema([("shard", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("n_tokens", pa.int64())])
READ = pa.schema([("shard", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("start", pa.int64()), ("ids_crc32", pa.int64())])


class CorruptRecord(ValueError):
    """A length or a checksum that does not fit its frame."""


def frames(payloads: list[bytes]) -> list[bytes]:
    """A frame for each payload."""
    lengths = [LENGTH.pack(len(p)) for p in payloads]
    checks = masked(crc32c(lengths + payloads)).astype("<u4")
    n = len(payloads)
    return [a + CHECK.pack(checks[i]) + p + CHECK.pack(checks[n + i]) for i, (a, p) in enumerate(zip(lengths, payloads))]


def payloads(found: list[bytes]) -> list[bytes]:
    """The payloads of whole frames, after a check of their checksums."""
    n = len(found)
    parts = [f[: LENGTH.size] for f in found] + [f[OVERHEAD - CHECK.size : -CHECK.size] for f in found]
    stored = [CHECK.unpack_from(f, LENGTH.size)[0] for f in found] + [CHECK.unpack_from(f, len(f) - CHECK.size)[0] for f in found]
    if (masked(crc32c(parts)) != np.array(stored, dtype=np.uint32)).any():
        raise CorruptRecord("a checksum does not fit")
    return parts[n:]


def write_token_records(docs: DataFrame, out: str, tokenizer: str, end_id: int, keeps_space: bool = False, width: int = 2) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) to shards under ``out`` in ascending order of doc_id.

    Returns the index, which is a table in ``out``/index. Shards are ranges of doc_id, so that their
    order is the order of the documents. ``width`` is 2 for vocabularies under 65,536 ids, else 4.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, keeps_space, width)
        end = int(end_id).to_bytes(width, "little")
        shard, file, place = f"shard-{TaskContext.get().partitionId():06d}.rec", None, 0
        try:
            for batch in slices(batches):
                if file is None:
                    file = AtomicFile(f"{out}/{shard}")
                ids, rows = batch.column("doc_id").to_pylist(), []
                encoded = [e + end for e in encoder.encode(batch.column("text").to_pylist())]
                found = frames([_encode(i, e, width) for i, e in zip(ids, encoded)])
                at = file.size
                for i, e, f in zip(ids, encoded, found):
                    rows.append((shard, place, i, at, len(f), len(e) // width))
                    place, at = place + 1, at + len(f)
                file.write(b"".join(found))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types)], schema=INDEX)
            if file is not None:
                file.commit()
        except BaseException:
            if file is not None:
                file.abort()
            raise

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, "shard string, place long, doc_id long, offset long, length long, n_tokens long").write.parquet(f"{out}/index")
    return read_index(docs.sparkSession, out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("shard string, place long, doc_id long, offset long, length long, n_tokens long").parquet(f"{out}/index")


def _encode(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return HEADER.pack(doc_id or 0, len(ids) // width, width, doc_id is None) + ids


def _decode(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, n, width, null = HEADER.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=HEADER.size)
    if len(ids) != n:
        raise CorruptRecord("a record has another number of ids than it says")
    return None if null else doc_id, ids


def _frames_of(stream, many: int = 256) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    while head := stream.read(LENGTH.size):
        if len(head) < LENGTH.size:
            raise CorruptRecord("a file ends within a frame")
        rest = stream.read(LENGTH.unpack(head)[0] + 2 * CHECK.size)
        held.append(head + rest)
        if len(held) == many:
            yield held
            held = []
    if held:
        yield held


def read_token_records(spark: SparkSession, out: str) -> DataFrame:
    """Reads every shard from its first byte to its last: one row for each record.

    ``start`` counts the ids of all records before it. Only one sum for each shard meets in one place.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(*(batch.column(c).to_pylist() for c in ("shard", "before"))):
                fs, path = filesystem(f"{out}/{shard}")
                place = 0
                with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for some in _frames_of(stream):
                        rows = []
                        for doc_id, ids in map(_decode, payloads(some)):
                            rows.append((shard, place, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                            place, start = place + 1, start + len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ.types)], schema=READ)

    sizes = read_index(spark, out).groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    shards = written(sizes.select("shard", (F.sum("tokens").over(upto) - F.col("tokens")).alias("before")), "shards")
    return shards.repartition(max(1, shards.count())).mapInArrow(read, "shard string, place long, doc_id long, n_tokens long, start long, ids_crc32 long")


def read_shuffled(spark: SparkSession, out: str, seed: int) -> DataFrame:
    """The records in a random order that ``seed`` fixes, each fetched at the offset the index gives."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, object] = {}
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r in rows:
                if r["shard"] not in files:
                    if len(files) >= 64:
                        files.popitem()[1].close()
                    fs, path = filesystem(f"{out}/{r['shard']}")
                    files[r["shard"]] = fs.open_input_file(path)
                found.append(files[r["shard"]].read_at(r["length"], r["offset"]))
            got = [_decode(p) for p in payloads(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in got], pa.int64()), pa.array([i.astype("<i4") for _, i in got], pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    order = F.xxhash64("shard", "place", F.lit(seed))
    return read_index(spark, out).withColumn("_order", order).repartitionByRange("_order").sortWithinPartitions("_order").mapInArrow(fetch, "doc_id long, ids array<int>")


def token_records(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = False, width: int = 2) -> DataFrame:
    """Writes and reads back: doc_id, start, n_tokens, ids_crc32, and where the record lies."""
    out = shared_dir(docs.sparkSession, "records")
    write_token_records(docs, out, tokenizer, end_id, keeps_space, width)
    return read_token_records(docs.sparkSession, out).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "place")

"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at the end of a bundle
lists the sizes and checksums of the frames, so that any reader of Zstandard can read the whole bundle
and one that knows the list can open any frame alone. A Parquet index beside the bundles maps each
record to its bundle, its frame and its place within the frame.

Defined cases: a null html counts as empty; a null url has no target header; of rows with one payload of
at least :data:`LEAST_SHARED` bytes those with the smallest page_id are responses (if the same page_id
and payload occur again, each of those rows is a response); a null page_id is smaller than none, so its
row is a revisit where the payload has a numbered page, else a response; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm.common import AtomicFile, filesystem, shared_dir, slices, text_or_empty, written

LEAST_SHARED = 100
FRAME_BYTES = 256 * 1024
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int"


class CorruptBundle(ValueError):
    """Bytes that do not fit their checksum, size or digest."""


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record; ``payload`` is None for a revisit, whose block holds the HTTP head alone."""
    revisit = payload is None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _number(name: str) -> int | None:
    inner = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(inner) if inner else None


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and the block of the record at ``at``, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise CorruptBundle("a record does not begin where it should")
    head = dict(line.split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise CorruptBundle("a record does not end where it should")
    return head, data[start:stop], stop + 4


def described(head: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload size, payload digest, type and the page referred to; a payload is hashed again."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise CorruptBundle("a payload does not fit its digest")
    return _number(head["WARC-Record-ID"]), size, digest, kind, _number(head["WARC-Refers-To"]) if kind == "revisit" else None


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The skippable frame that lists (compressed size, size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUM_FLAG, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class Bundle:
    """A bundle open for reading: frames by number."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise CorruptBundle("no seek table")
        self.entries = list(struct.iter_unpack("<III", self.file.read_at(12 * n, size - 9 - 12 * n)))
        self.starts, at = [], 0
        for e in self.entries:
            self.starts.append(at)
            at += e[0]
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        import xxhash

        packed, size, check = self.entries[k]
        data = self.decompressor.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise CorruptBundle("a frame does not fit its checksum")
        return data


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, refers_to (null for responses)."""
    payload = text_or_empty("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = rows.filter(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = rows.join(shared.select("digest", "first"), "digest", "left")
    return joined.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, out: str, date: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to bundles under ``out``, one for each partition; returns the index."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        name, file, entries, held, held_bytes, rows = f"bundle-{TaskContext.get().partitionId():06d}.warc.zst", None, [], [], 0, []

        def close_frame() -> None:
            nonlocal held, held_bytes
            data = b"".join(held)
            packed = compressor.compress(data)
            file.write(packed)
            entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            held, held_bytes = [], 0

        try:
            for batch in slices(batches, 256):
                file = file or AtomicFile(f"{out}/{name}")
                rows = []
                for r in batch.to_pylist():
                    made = record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], date)
                    rows.append((r["page_id"], name, len(entries), held_bytes, len(made)))
                    held.append(made)
                    held_bytes += len(made)
                    if held_bytes >= FRAME_BYTES:
                        close_frame()
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "bundle", "frame", "offset", "length"])
            if file is not None:
                if held:
                    close_frame()
                file.write(seek_table(entries))
                file.commit()
        except BaseException:
            if file is not None:
                file.abort()
            raise

    # a task that runs again must write the same bytes, in whatever order its shuffle blocks come
    ordered = with_types(pages).sortWithinPartitions("digest", "page_id", "url")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{out}/index")
    return read_index(pages.sparkSession, out)


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame"])


def read_bundles(spark: SparkSession, out: str) -> DataFrame:
    """Every record of every bundle, frame by frame; payloads are checked against their digests."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                bundle = Bundle(f"{out}/{name}")
                for k in range(len(bundle.entries)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        rows.append((*described(head, block), name, k))
                    yield _batch(rows)

    bundles = written(read_index(spark, out).select("bundle").distinct(), "bundles")
    return bundles.repartition(max(1, bundles.count())).mapInArrow(read, RECORD)


def fetch(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """page_id and payload of the wanted page_ids: one frame is opened for each, not the bundle.

    A revisit gives the payload of the response that it refers to; no wanted row is lost.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_now: dict[str, Bundle] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["bundle"] not in open_now:
                    if len(open_now) >= 16:
                        open_now.clear()
                    open_now[r["bundle"]] = Bundle(f"{out}/{r['bundle']}")
                head, block, _ = parse(open_now[r["bundle"]].frame(r["frame"]), r["offset"])
                revisit = head["WARC-Type"] == "revisit"
                rows.append((r["page_id"], None if revisit else block.partition(b"\r\n\r\n")[2], _number(head["WARC-Refers-To"]) if revisit else None))
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload", "refers_to"])

    index = read_index(spark, out)
    found = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(read, "page_id long, payload binary, refers_to long")
    direct, via = found.filter("payload is not null"), found.filter("payload is null").select(F.col("page_id").alias("asked"), F.col("refers_to").alias("page_id"))
    origin = index.join(via.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(read, "page_id long, payload binary, refers_to long")
    return direct.select("page_id", "payload").unionByName(via.join(origin.filter("payload is not null"), "page_id").select(F.col("asked").alias("page_id"), "payload"))


def archived(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles and reads them back."""
    out = shared_dir(pages.sparkSession, "warc")
    write_bundles(pages, out, date)
    return read_bundles(pages.sparkSession, out)

"""Audio features of stored media: resampling, log-mel bands and segments.

The stored form is a WAV file of 8-bit mono samples in a binary column. Features are computed from the
bytes that are read back: a polyphase filter resamples by 2/3, overlapped windowed frames go through a
discrete Fourier transform and triangular mel bands to levels of half a decibel, and a segment begins
where a frame's energy reaches an upper level and ends where it falls under a lower one. Levels lie in
Arrow tensors of fixed shape (frames by bands) with the time span of each.

All sums are over whole numbers small enough to be exact in a double, and levels come from comparisons
with a table, so that equal samples give equal features on any machine and at any place in a batch.

Defined cases: a null text counts as empty and is stored as :data:`UNIT` spaces; a null or repeated id
is kept as it is; an empty table gives empty tables; a very long text is taken in blocks of frames.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import AtomicFile, shared_dir, slices, text_or_empty, written

UNIT, FILL = 192, 32
RATE, UP, DOWN = 8000, 2, 3
TAPS = 24  # of each phase
FRAME, HOP, BANDS = 256, 128, 16
TENSOR_FRAMES = 16
LEVELS = np.power(10.0, np.arange(1, 256) / 20)  # half a decibel of power each
RAISE, LOWER = 2, 0  # above the median level: where a segment begins, and where it still goes on
BLOCK_FRAMES = 4096
HEAD = "<4sI4s4sIHHIIHH4sI"


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono samples as a WAV file."""
    return struct.pack(HEAD, b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(stored: bytes) -> bytes:
    """The samples of a file that :func:`wav` made."""
    riff, _, wave, _, _, _, _, _, _, _, bits, data, n = struct.unpack_from(HEAD, stored)
    if (riff, wave, data, bits) != (b"RIFF", b"WAVE", b"data", 8) or len(stored) != struct.calcsize(HEAD) + n:
        raise ValueError("not a WAV file of 8-bit samples")
    return stored[struct.calcsize(HEAD) :]


def padded(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, bytes([FILL]))


@functools.lru_cache(maxsize=1)
def _phases() -> np.ndarray:
    """The filter's whole-numbered taps, a column for each phase."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    low_pass = np.sinc(n / DOWN) * np.hanning(TAPS * UP + 2)[1:-1]
    return np.rint(low_pass / low_pass.sum() * UP * 1024).reshape(TAPS, UP)[::-1].astype(np.float64)


def resampled(signal: np.ndarray) -> np.ndarray:
    """``signal`` at 2/3 of its rate, in 1/1024 of a sample."""
    held = np.pad(signal, (TAPS // 2, TAPS // 2 + 1))
    out = np.empty(-(-len(signal) * UP // DOWN))
    k = np.arange(len(out)) * DOWN
    windows = np.lib.stride_tricks.sliding_window_view(held, TAPS)
    for phase in range(UP):
        mine = np.nonzero(k % UP == phase)[0]
        for a in range(0, len(mine), 1 << 15):
            some = mine[a : a + (1 << 15)]
            out[some] = windows[k[some] // UP] @ _phases()[:, phase]
    return out


@functools.lru_cache(maxsize=1)
def _transform() -> np.ndarray:
    """Windowed cosines and sines as whole numbers: FRAME rows, 2 columns for each of FRAME/2 bins."""
    t, f = np.arange(FRAME)[:, None], np.arange(1, FRAME // 2 + 1)[None, :]
    turn = 2 * np.pi * t * f / FRAME
    return np.rint(np.concatenate([np.cos(turn), np.sin(turn)], 1) * np.hanning(FRAME)[:, None] * 1024)


@functools.lru_cache(maxsize=1)
def _mel() -> np.ndarray:
    """Triangles of equal width on the mel scale, as whole numbers up to 64."""
    top = 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    hertz = np.arange(1, FRAME // 2 + 1) * RATE * UP / DOWN / FRAME
    up = (hertz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - hertz[:, None]) / (edges[2:] - edges[1:-1])
    return np.rint(np.clip(np.minimum(up, down), 0, 1) * 64)


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Band levels (frames by bands, unsigned bytes) and segments as [first, last + 1) frames."""
    signal = resampled(np.frombuffer(payload, np.uint8).astype(np.float64) - 128)
    n = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    signal = np.pad(np.floor(signal / 16), (0, max(0, (n - 1) * HOP + FRAME - len(signal))))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP][:n]
    levels, energy = np.empty((n, BANDS), np.uint8), np.empty(n, np.int64)
    for a in range(0, n, BLOCK_FRAMES):
        some = frames[a : a + BLOCK_FRAMES]
        bins = np.floor(some @ _transform() / 2**14)
        power = np.square(bins[:, : FRAME // 2]) + np.square(bins[:, FRAME // 2 :])
        levels[a : a + BLOCK_FRAMES] = np.searchsorted(LEVELS, power @ _mel(), side="right")
        energy[a : a + BLOCK_FRAMES] = np.searchsorted(LEVELS, np.einsum("ij,ij->i", some, some), side="right")
    return levels, segments(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs that begin at the upper level and last while the lower one is held."""
    middle = int(np.sort(energy)[len(energy) // 2])
    marks = np.where(energy >= middle + RAISE, 1, np.where(energy < middle + LOWER, -1, 0))
    last = np.maximum.accumulate(np.where(marks != 0, np.arange(len(marks)), -1))
    on = np.where(last >= 0, marks[last], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def digest(levels: np.ndarray, spans: list[tuple[int, int]]) -> str:
    """Frames, segments, mean level of each band and a hash of all levels and segments."""
    means = ".".join(str(int(x)) for x in levels.sum(0, dtype=np.int64) // len(levels))
    return f"{len(levels)}:{len(spans)}:{means}:{hashlib.sha256(levels.tobytes() + repr(spans).encode()).hexdigest()[:32]}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, the size of its text and the WAV file that holds it."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [padded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.uint8(), [TENSOR_FRAMES, BANDS])


def _tensors(rows: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    ids, parts, begins, ends = [], [], [], []
    for doc_id, levels in rows:
        for a in range(0, len(levels), TENSOR_FRAMES):
            part = levels[a : a + TENSOR_FRAMES]
            ids.append(doc_id)
            begins.append(seconds(a))
            ends.append(seconds(a + len(part)))
            parts.append(np.pad(part, ((0, TENSOR_FRAMES - len(part)), (0, 0))))
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(np.stack(parts)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins), pa.array(ends), tensors.cast(tensor_type())], names=["doc_id", "begin_s", "end_s", "levels"])


def media_features(media: DataFrame, tensors: str | None = None) -> DataFrame:
    """Reads stored media and gives what it holds; with ``tensors``, also writes Arrow files of levels there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = stream = None
        try:
            for batch in slices(batches, 256):
                rows, levels_of = [], []
                for doc_id, n, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                    payload = samples(stored)
                    levels, spans = features(payload)
                    levels_of.append((doc_id, levels))
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), digest(levels, spans), [seconds(x) for s in spans for x in s]))
                if tensors is not None:
                    made = _tensors(levels_of)
                    if file is None:
                        file = AtomicFile(f"{tensors}/part-{TaskContext.get().partitionId():06d}.arrows")
                        stream = pa.ipc.new_stream(file.out, made.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    stream.write_batch(made)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans_s"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            if file is not None:
                stream.close()
                file.commit()
        except BaseException:
            if file is not None:
                file.abort()
            raise

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans_s array<double>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores texts as media, reads them back and computes their features, which are stored as tensors."""
    media = written(to_media(docs), "media", compression="zstd")
    return media_features(media, shared_dir(docs.sparkSession, "tensors"))

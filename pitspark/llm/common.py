"""Shared folder, file access and small helpers of the training-data operators."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The code points that separate words in every operator here: space and 9 to 13.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Spark then removes an execution's shuffle files when it ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"pitspark-{application}-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a temporary folder of this session serves on a ``local`` master; a
    cluster's executors would not see it, so there its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, out: str, **options: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(out)
    finally:
        conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends here."""
    out = shared_dir(df.sparkSession, name)
    _write(df, out, **options)
    return df.sparkSession.read.schema(df.schema).parquet(out)


class Scratch:
    """Tables of one run in the shared folder, each removed when the run needs it no more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        _write(df, f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it is complete.

    A task that runs again, after a lost executor or as a speculative copy, writes the same bytes
    under a name of its own and renames it; the last rename wins and changes nothing.
    """

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:  # file systems that do not rename over a file
            self.fs.delete_file(self.path)
            self.fs.move(self.temp, self.path)

    def abort(self) -> None:
        self.out.close()
        if self.fs.get_file_info(self.temp).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.temp)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few long texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus

"""Publication: which batches are complete, and pointers to the latest snapshot that only move forward."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.functions.storage import stored
from pitspark.operators import selection

#: Why a batch may not be published (fixed values).
PROBLEMS = ("no_input", "capture_not_archived", "no_coverage", "metadata_capture_outside_inputs", "observation_capture_outside_inputs", "unresolved_without_flag")


def archived() -> Column:
    """A capture that was answered with success and whose body is stored."""
    there = [F.col(c).isNotNull() for c in ("completed_at", "fetched_at", "body_hash", "blob_key", "byte_count")]
    ok = F.col("http_status").between(200, 299)
    for c in there:
        ok &= c
    return F.coalesce(ok, F.lit(False))


def publication_problems(batches: DataFrame, inputs: DataFrame, captures: DataFrame, coverage: DataFrame, observations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(batch, reasons) for each row of ``batches``; without reasons it may be published.

    inputs: (batch, capture). captures: (capture, completed_at, fetched_at, http_status, body_hash, blob_key,
    byte_count), one row a capture. coverage: (batch, capture) of the filing's metadata. observations:
    (batch, capture) of all that were selected or considered. resolutions: (batch, status, flagged). An input
    whose capture is unknown is not archived. Rows of batches that are not asked for are left out; a null
    capture is outside any inputs. Evidence meets its batch's inputs by (batch, capture), so a large batch is
    spread; a batch then has one row for each task and kind.
    """
    good = captures.filter(archived()).select("capture", F.lit(True).alias("good")).distinct()
    told = inputs.select("batch", "capture").join(good, "capture", "left").select("batch", "capture", F.lit("input").alias("kind"), F.col("good").isNull().alias("bad"))
    met = told
    for kind, rows in (("metadata", coverage), ("observation", observations)):
        met = met.unionByName(rows.select("batch", "capture", F.lit(kind).alias("kind"), F.lit(False).alias("bad")))
    is_a = lambda kind: F.bool_or(F.col("kind") == kind)
    pair = met.groupBy("batch", "capture").agg(is_a("input").alias("input"), is_a("metadata").alias("metadata"), is_a("observation").alias("observation"), F.bool_or("bad").alias("bad"))
    outside = ~F.col("input") | F.col("capture").isNull()
    none = F.lit(False)
    each = pair.select("batch", "input", "metadata", "bad", (F.col("metadata") & outside).alias("outside_m"), (F.col("observation") & outside).alias("outside_o"), none.alias("open"))
    unresolved = (F.coalesce("status", F.lit("missing")) != "observed") & ~F.coalesce("flagged", F.lit(False))
    every = each.unionByName(resolutions.select("batch", *[none.alias(c) for c in ("input", "metadata", "bad", "outside_m", "outside_o")], unresolved.alias("open")))
    by_batch = every.groupBy("batch").agg(*[F.bool_or(c).alias(c) for c in ("input", "metadata", "bad", "outside_m", "outside_o", "open")])
    holds = lambda c: F.coalesce(F.col(c), F.lit(False))
    tests = (~holds("input"), holds("bad"), ~holds("metadata"), holds("outside_m"), holds("outside_o"), holds("open"))
    return batches.select("batch").distinct().join(by_batch, "batch", "left").select("batch", flags.reasons(**dict(zip(PROBLEMS, tests, strict=True))).alias("reasons"))


class Pointers:
    """Latest snapshots by scope, as numbered editions of one table under ``path``.

    An edition is written under a name of its own and renamed to the next number; the rename fails where that
    number is taken, and the writer then merges its offer with the edition that came first. So of two writers
    each scope keeps the higher sequence, whoever comes last, and a writer that dies leaves the edition before.
    The file system's rename must be atomic (HDFS, POSIX); object stores need a committer that makes it so.
    Two editions stay, so that who reads the one before can finish. A folder that starts with ``_`` is what a
    dead writer left; nothing reads it.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], most_tries: int = 50):
        self.spark, self.path, self.by, self.most_tries = spark, path.rstrip("/"), by, most_tries
        jvm = spark._jvm
        self._where = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._where(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._where(self.path))

    def _edition(self, number: int) -> str:
        return f"{self.path}/{number:010d}"

    def editions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._where(self.path))]
        return sorted(int(n) for n in names if n.isdigit())

    def newest(self) -> tuple[int, DataFrame | None]:
        """The newest edition's number and rows (by, sequence, snapshot); 0 and none before the first."""
        numbers = self.editions()
        return (numbers[-1], self.spark.read.parquet(self._edition(numbers[-1])).drop("action")) if numbers else (0, None)

    def _claim(self, written: str, number: int) -> bool:
        try:
            self._context.rename(self._where(written), self._where(self._edition(number)), self._options)
            return True
        except Py4JJavaError:
            if number not in self.editions():
                raise
            self._fs.delete(self._where(written), True)
            return False

    def publish(self, offered: DataFrame) -> DataFrame:
        """Offers (by, sequence, snapshot) in one edition: returns its rows, each with what happened to it:
        ``moved``, ``kept`` (an offer that is not higher) or ``unchanged`` (no offer). Of several offers to one
        scope the highest sequence counts. An offer without a sequence or a snapshot is none."""
        best = offered.filter(F.col("sequence").isNotNull() & F.col("snapshot").isNotNull()).groupBy(*self.by).agg(F.max(F.struct("sequence", "snapshot")).alias("x")).select(*self.by, "x.sequence", "x.snapshot")
        best = stored(best, "offer")
        for _ in range(self.most_tries):
            number, held = self.newest()
            merged = selection.forward_only(best.limit(0) if held is None else held, best, self.by)
            written = f"{self.path}/_{uuid.uuid4().hex}"
            merged.write.parquet(written)
            if self._claim(written, number + 1):
                for old in self.editions():
                    if old < number:
                        self._fs.delete(self._where(self._edition(old)), True)
                return self.spark.read.schema(merged.schema).parquet(self._edition(number + 1))
        raise RuntimeError(f"{self.most_tries} other writers came first under {self.path}")


def publish_complete(pointers: Pointers, offered: DataFrame, problems: DataFrame) -> DataFrame:
    """Publishes the offers (by, sequence, snapshot, batch) of batches that :func:`publication_problems` knows
    and finds nothing against; the others leave their scope as it was."""
    complete = problems.filter(F.size("reasons") == 0).select("batch")
    return pointers.publish(offered.join(complete, "batch", "left_semi"))

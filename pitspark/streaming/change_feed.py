"""A feed of filing changes: each poll is compared with the last sound inventory of its issuers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitspark.operators import changes

ROW = "issuer long, accession long, form string, acceptance_at timestamp_ntz, cutoff timestamp_ntz, content string, complete boolean, described boolean"
STATE = f"{ROW}, poll long"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
OUTCOME = "issuer long, originals long, amendments long, flags array<string>, outcome string, poll long"
#: After so many polls the inventories are stored whole again, so that a poll reads few folders.
EVERY = 32
#: Filings of a poll that a task compares at most, about; a larger poll has more tasks.
SHARE = 250_000


def _of(rows: DataFrame, issuers: DataFrame) -> DataFrame:
    """Rows of these issuers. The issuers, which are fewer, are what a task holds; the rows pass by unsorted."""
    return rows.join(issuers.hint("shuffle_hash"), "issuer", "left_semi")


class ChangeFeed:
    """Baselines under ``folder``/held-N, outcomes and new filings of each poll under ``folder``/outcomes and /changes.

    A micro-batch holds whole inventories (:data:`ROW`; a null accession stands for an answer without filings).
    An issuer's first sound inventory is its baseline; later ones are compared by
    :func:`changes.compared_inventories`: any flag, as an answer that is not complete, an accession that is
    gone or one whose content differs, keeps the baseline and reports no filing. A poll stores the inventories
    of the issuers that advance, and an issuer's newest one is its baseline. A batch that runs again reads the
    same baseline and overwrites its own output, so it is counted once.
    """

    def __init__(self, spark: SparkSession, folder: str, forms: tuple[str, ...] = ("10-K", "10-K/A")):
        self.spark, self.folder, self.forms = spark, folder, list(forms)

    def state(self, batch: int, issuers: DataFrame | None = None) -> DataFrame:
        """The baselines as of a batch, of the given issuers or of all."""
        if batch < 0:
            return self.spark.createDataFrame([], ROW)
        whole = (batch + 1) // EVERY * EVERY - 1
        names = [f"{self.folder}/whole-{whole}"] * (whole >= 0) + [f"{self.folder}/held-{k}" for k in range(whole + 1, batch + 1)]
        rows = self.spark.read.schema(STATE).parquet(*names)
        return self._newest(rows if issuers is None else _of(rows, issuers)).select(*COLUMNS)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("issuer").agg(F.max("poll").alias("poll")).hint("shuffle_hash"), ["issuer", "poll"], "left_semi")

    def apply(self, polled: DataFrame, batch: int) -> None:
        polled = polled.select(*COLUMNS)
        before = self.state(batch - 1, polled.select("issuer").distinct())
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), polled.count() // SHARE + 1)
        each = changes.compared_filings(before, polled, ["issuer"], self.forms, tasks)
        self._write(each, "compared")
        each = self.spark.read.schema(each.schema).parquet(f"{self.folder}/compared")
        found = changes.outcomes(each, ["issuer"])
        first = each.filter("there").select("issuer", F.lit(True).alias("_known")).distinct()
        fresh = F.col("_known").isNull() & (F.size("flags") == 0)
        none = lambda c: F.when(fresh, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
        outcomes = found.join(first, "issuer", "left").select("issuer", none("originals"), none("amendments"), "flags", F.when(fresh, "baseline").otherwise(F.col("outcome")).alias("outcome"), F.lit(batch).cast("long").alias("poll"))
        self._write(outcomes, f"outcomes/poll={batch}-")
        told = self.spark.read.schema(OUTCOME).parquet(f"{self.folder}/outcomes/poll={batch}-")
        sound = told.filter(F.size("flags") == 0).select("issuer", "outcome")
        added = _of(each.filter("is and not there").select("issuer", "accession", "form"), sound.filter("outcome <> 'baseline'").select("issuer"))
        self._write(added.withColumn("poll", F.lit(batch).cast("long")), f"changes/poll={batch}-")
        self._write(_of(polled, sound.select("issuer")).withColumn("poll", F.lit(batch).cast("long")), f"held-{batch}")
        if (batch + 1) % EVERY == 0:
            whole = batch + 1 - EVERY
            names = [f"{self.folder}/whole-{whole - 1}"] * (whole > 0) + [f"{self.folder}/held-{k}" for k in range(whole, batch + 1)]
            self._write(self._newest(self.spark.read.schema(STATE).parquet(*names)), f"whole-{batch}")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def start(self, polls: DataFrame) -> StreamingQuery:
        """Runs over what there is now and stops."""
        return polls.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(f"{self.folder}/outcomes")

    def found(self) -> DataFrame:
        """New filings, each with its poll."""
        return self.spark.read.schema("issuer long, accession long, form string, poll long").option("recursiveFileLookup", "true").parquet(f"{self.folder}/changes")

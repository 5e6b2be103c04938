"""The newest reference date of each series over a stream of observations that come out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = ("reference_date", "observations", "late")
#: After so many micro-batches the states are stored whole again, so that a micro-batch reads few folders.
EVERY = 32


class SeriesFeed:
    """State of each series under ``folder``/newest/batch-N: its newest reference date, and how many observations it
    has and how many came late.

    A late observation, of an older date than the newest known when its micro-batch came, counts in the
    history and never takes the place of the newer one. A micro-batch is counted by series and date, meets the
    states that it touches by a join and writes them under its number: so there is no call for each series, and
    one that runs again after a restart reads the same states, replaces its output and counts nothing twice.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder, keys

    def start(self, rows: DataFrame) -> StreamingQuery:
        """Runs over what there is now of ``rows`` (keys, reference_date) and stops."""
        return rows.select(*self.keys, "reference_date").writeStream.foreachBatch(self._write).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

    def advanced(self, rows: DataFrame, batch: int) -> DataFrame:
        """The states that a micro-batch touches, after it."""
        days = rows.groupBy(*self.keys, "reference_date").agg(F.count("*").alias("n"))
        if batch == 0:
            joined = days.select("*", F.lit(None).cast("date").alias("_reference_date"), *[F.lit(None).cast("long").alias(f"_{c}") for c in STATE[1:]])
        else:
            before = self._last(self._read(batch - 1)).select(*[F.col(k).alias(f"_key_{k}") for k in self.keys], *[F.col(c).alias(f"_{c}") for c in STATE])
            same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.keys]
            joined = days.join(before, same, "left")
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        late = F.sum(F.when(F.col("reference_date") < F.col("_reference_date"), F.col("n")))
        return joined.groupBy(*self.keys).agg(
            F.greatest(F.max("reference_date"), F.max("_reference_date")).alias("reference_date"), (F.sum("n") + none(F.max("_observations"))).alias("observations"), (none(late) + none(F.max("_late"))).alias("late"),
        )

    def _read(self, batch: int) -> DataFrame:
        """States that hold the last one of every series as of a micro-batch."""
        whole = (batch + 1) // EVERY * EVERY - 1
        names = [f"{self.folder}/whole-{whole}"] * (whole >= 0) + [f"{self.folder}/newest/batch-{k}" for k in range(whole + 1, batch + 1)]
        return self.spark.read.parquet(*names)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last state of every series: all that is in one can only grow."""
        return rows.groupBy(*self.keys).agg(*[F.max(c).alias(c) for c in STATE])

    def _write(self, rows: DataFrame, batch: int) -> None:
        self.advanced(rows, batch).write.mode("overwrite").parquet(f"{self.folder}/newest/batch-{batch}")
        if (batch + 1) % EVERY == 0:
            whole, folders = batch + 1 - EVERY, []
            folders += [f"{self.folder}/whole-{whole - 1}"] * (whole > 0) + [f"{self.folder}/newest/batch-{k}" for k in range(whole, batch + 1)]
            self._last(self.spark.read.parquet(*folders)).write.mode("overwrite").parquet(f"{self.folder}/whole-{batch}")

    def newest(self) -> DataFrame:
        """The last state of every series."""
        return self._last(self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/newest"))

"""Folders that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"pitspark-{application}-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, a temporary one on a ``local``
    master. A cluster's executors would not see that, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once in a shared folder and read again: what several later steps read is worked out once,
    and a lost executor costs no more than the step it was in."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

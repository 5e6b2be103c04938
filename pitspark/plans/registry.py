"""Registration of queries over the driver's tables, each with the SQL it is compared with.

``{name}`` in SQL stands for a table or a bridge view. Bridge views (:mod:`pitspark.plans.bridge`) are
written in SQL that Spark and the oracle both read, so both start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pitspark.functions.storage import work_dir
from pitspark.plans.bridge import VIEWS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def expanded(sql: str, table: Callable[[str], str], held: dict[str, str] | None = None) -> str:
    """``sql`` with tables and bridge views put in, views within views too; ``held`` names what stands for a view."""

    def put(match: re.Match) -> str:
        name = match[1]
        if held and name in held:
            return held[name]
        return table(name) if name in TABLES else f"({expanded(VIEWS[name], table, held)})" if name in VIEWS else match[0]

    return re.sub(r"\{(\w+)\}", put, sql)


class Data:
    """The driver's tables and the bridge views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, held: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.held = spark, sf_dir, held or {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in self.held:
            return self.sql(f"select * from {self.held[name]}")
        if name in VIEWS:
            return self.sql(VIEWS[name])
        raise AttributeError(name)

    def dealt(self, rows: DataFrame, *by: str) -> DataFrame:
        """``rows`` of few bytes dealt to as many tasks as a shuffle has, ahead of work that is long for each row."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *by)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(expanded(text, lambda t: f"parquet.`{self.sf_dir}/{t}.parquet`", self.held))

    def once(self, *names: str) -> Data:
        """The same tables and views, with these views worked out once and stored: views that read them several
        times read them back."""
        held = dict(self.held)
        for name in names:
            if name not in held:
                path = work_dir(self.spark, name)
                getattr(self, name).write.parquet(path)
                held[name] = f"parquet.`{path}`"
        return Data(self.spark, self.sf_dir, held)

    def grouped(self, view: str, *by: str) -> Data:
        """The same tables and views, with the rows of ``view`` dealt by some of its columns wherever it is read:
        views that group its rows, and joins of these, by those columns and others move rows no further."""
        lines = expanded(f"{{{view}}}", lambda t: f"parquet.`{self.sf_dir}/{t}.parquet`", self.held)
        return Data(self.spark, self.sf_dir, self.held | {view: f"(select /*+ repartition({', '.join(by)}) */ * from {lines})"})


def query(name: str, sql: str | None = None):
    """Registers a function of :class:`Data` under ``name``; ``sql`` is its oracle."""

    def register(function: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Data(spark, sf_dir))
        if sql is not None:
            SQL[name] = expanded(sql, lambda t: t)
        return function

    return register

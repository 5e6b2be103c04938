"""All registered queries of the reference's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitspark.plans import evidence_queries, metric_queries, sector_queries, selection_queries, source_queries, statement_queries, valuation_queries  # noqa: F401
from pitspark.plans.registry import QUERIES, SQL, Data

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sector_queries.flagship(Data(spark, sf_dir))

"""What the statement read moves between tasks."""

from pyspark.sql import functions as F

from pitspark.operators import statements
from pitspark.plans import statement_queries
from pitspark.plans.registry import Data

from .test_queries import DATA
from .test_statements import REQUEST, SCHEMAS, D, asked, base


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_of_a_version_move_once(spark):
    """Coverage's two parts and filings are dealt by version; neither their groups nor their join deal them again."""
    e = statement_queries.evidence(Data(spark, DATA))
    assert plan(e.coverage.hint("merge").join(e.filings.select("version", "filed"), "version")).count("Exchange hashpartitioning") == 3


def test_rows_that_no_key_reaches_do_not_move(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), "id")
    keys = spark.range(0, 40_000, 400).select(F.col("id").alias("k"))
    few = statements.reached(rows, keys, "k")
    assert few.join(keys, "k").count() == rows.join(keys, "k").count() == 0  # multiples of ten have no key
    rows = rows.withColumn("k", F.col("id"))
    few = statements.reached(rows, keys, "k")
    assert few.join(keys, "k").count() == 100 and few.count() < 110
    assert statements.reached(rows, keys.limit(0), "k").count() == 0
    assert statements.reached(rows, keys.withColumn("k", F.col("k").cast("int")), "k").count() == 40_000  # hashes of types differ


def test_a_full_map_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(statements, "PLACES", 64)
    rows = spark.range(1000).withColumnRenamed("id", "k")
    assert statements.reached(rows, rows.filter("k % 3 = 0"), "k").join(rows.filter("k % 3 = 0"), "k").count() == 334


def test_an_edition_is_looked_for_before_coverage_moves(spark):
    """Of many days' coverage one row of each batch goes on to its request; before, every row did."""
    many = base()
    many["filings"] = [(v, v, 7, D(2023, 1, 1 + v % 28), None, 10) for v in range(300)]
    many["coverage"] = [(v, 1 + v % 2, v, 5, "income", "whole", "USD", "periodic_complete", "audited", "covered", "us_gaap") for v in range(300)]
    e = statements.Evidence(**{name: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[name]) for name, rows in many.items()})
    requests = spark.createDataFrame([asked(mode="latest_reported")], REQUEST)
    found = statements.edition(statements.covered(statements.sound(requests, statements.bundles(requests, e)), e))
    assert sorted(r.version for r in found.collect()) == [v for v in range(300) if v % 28 == 27]
    lines = plan(found).split("Initial Plan")[-1].splitlines()
    moved = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(request" in line)
    assert any("Window" in line for line in lines[moved:])

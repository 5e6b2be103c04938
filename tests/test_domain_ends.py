"""Roots beside the ends of their domains, in the queries that solve for a target, against their SQL."""

from datetime import datetime

import duckdb
import pytest

from pitspark.operators import roots
from pitspark.plans import catalog
from pitspark.plans.valuation_queries import RANGES

from .test_queries import DATA, rows

PRICE = 2e8
#: How far a root lies within its domain, or outside; a billionth of an end is not told from it.
WITHIN = (-5e-10, 2e-10, 5e-10, 2e-9, 1e-6)


def target(variable, x, revenue=4 * PRICE, g=0.06, m=0.15, k=0.05):
    """The value of the base scenario where the variable is ``x``."""
    g, k = (x if variable == roots.GROWTH else g), (x if variable == roots.REINVESTMENT else k)
    faded = [0.75 * 0.1 + 0.25 * x, 0.5 * 0.1 + 0.5 * x, x] if variable == roots.MARGIN else [m] * 3
    value, last = 0.0, x if variable == roots.MARGIN else m
    for year, margin in enumerate(faded, 1):
        value += revenue * (1 + g) ** year * (margin * 0.75 - k) / 1.1**year
    return value + revenue * (1 + g) ** 3 * 1.02 * last * 0.75 * 0.75 / 0.08 / 1.1**3


@pytest.fixture(scope="module")
def beside_ends(spark, tmp_path_factory):
    """A supplier for each end and distance: one line in each of four quarters, and a balance that puts the root there."""
    folder = str(tmp_path_factory.mktemp("ends"))
    points = [(v, end + side * d) for v, ends in RANGES.items() for end, side in zip(ends, (1, -1)) for d in WITHIN]
    suppliers = [(i, i % 25, round(target(v, x) / 4, 2)) for i, (v, x) in enumerate(points)]
    lines = [(10 * i + q, i, 1, 1.0, PRICE, 0.0, 0.0, "N", "O", datetime(1996, 3 * q + 1, 5)) for i, _, _ in suppliers for q in range(4)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.read.parquet(f"{DATA}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "nation"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["V4_reverse_solve", "V5_scenario_results", "A20_scenario_span"])
def test_roots_beside_an_end_equal_sql(spark, beside_ends, name):
    folder, con = beside_ends
    got, want = catalog.QUERIES[name](spark, folder), con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_a_root_is_told_from_an_end(spark, beside_ends):
    found = {(r.issuer, r.variable): r.state for r in catalog.QUERIES["V4_reverse_solve"](spark, beside_ends[0]).filter("scenario = 'base'").collect()}
    states = [found[i, v] for i, v in enumerate(v for v in RANGES for _ in range(2 * len(WITHIN)))]
    assert states == ["no_solution", "no_solution", "no_solution", "converged", "converged"] * 6

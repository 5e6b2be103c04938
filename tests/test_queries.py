"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from pitspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = oracle.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_rows_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([rows(df.columns, df.collect()) for df in (catalog.QUERIES[q](spark, DATA) for q in ("W1_latest_edition", "J8_bounded_backward_as_of", "A13_concentration", "A21_manifest_hash"))])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_training_data_operators():
    code = "import sys; sys.modules['pitspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parent.parent / "pitspark"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "pitspark.llm" in p.read_text()]


def test_bands_work_out_their_flows_once(spark):
    """Points are made of flows in seven ways; the lines are read when these are stored, not again for each."""
    for name in ("A17_exclusions", "A17_history_band", "W6_sample_rules"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_shipdate" not in plan, name


def test_valuations_work_out_sums_of_four_quarters_once(spark):
    """Both modes of the cells read stored sums; what is solved for takes its anchor from its own snapshot."""
    plan = lambda name: catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan("V6_sensitivity_cells")
    assert plan("V5_scenario_results").count("Relation [l_orderkey") == 1

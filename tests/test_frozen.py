"""Frozen selections: replay, and comparisons that read only the ranges that differ."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitspark.operators import frozen

SCHEMA = "issuer int, shard string, row double"


def base(spark, n=400):
    return spark.createDataFrame([(i % 50, f"c{i}", float(i)) for i in range(n)] + [(None, "c", None), (1, None, 2.0), (1, None, 2.0)], SCHEMA)


def request(spark):
    return spark.createDataFrame([(400,)], "most int")


@pytest.fixture
def held(spark, tmp_path):
    path = str(tmp_path / "f")
    frozen.freeze(base(spark), ["issuer", "shard"], request(spark), path)
    return frozen.Frozen(spark, path)


def found(df):
    return {(r.issuer, r.shard): (r.state, r.frozen_rows, r.stored_rows) for r in df.collect()}


def test_a_replay_of_the_same_evidence_finds_nothing(spark, held):
    assert held.replay(lambda r: base(spark, r.first().most).orderBy(F.rand())).count() == 0
    assert held.rows().count() == 403 and held.rows().columns == sorted(held.rows().columns)


def test_removed_added_and_altered_rows_are_found(spark, held):
    now = base(spark).filter("not (issuer <=> 7 and shard = 'c7')").withColumn("row", F.when(F.col("shard") == "c9", -1.0).when(F.col("issuer").isNull(), 0.0).otherwise(F.col("row")))
    now = now.unionByName(spark.createDataFrame([(99, "new", 1.0), (1, None, 2.0), (3, "c3", 3.5)], SCHEMA))
    assert found(held.differences(now)) == {(7, "c7"): ("removed", 1, 0), (9, "c9"): ("altered", 1, 1), (None, "c"): ("altered", 1, 1), (99, "new"): ("added", 0, 1), (1, None): ("altered", 2, 3), (3, "c3"): ("altered", 1, 2)}


def test_one_altered_row_is_found_by_reading_its_range_alone(spark, held):
    now = base(spark).withColumn("row", F.when(F.col("shard") == "c9", -1.0).otherwise(F.col("row")))
    mine = held._rows().filter(F.col("k.shard") == "c9").first()["shard"]
    for folder in (Path(held.path) / "rows").glob("shard=*"):
        if folder.name != f"shard={mine}":
            shutil.rmtree(folder)
    diff = frozen.Frozen(spark, held.path).differences(now)
    assert found(diff) == {(9, "c9"): ("altered", 1, 1)}
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "shard#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "leaf" in plan.split("PushedFilters:")[1].split("]")[0]


def test_more_leaves_than_are_named_are_joined(spark, held, monkeypatch):
    monkeypatch.setattr(frozen, "NAMED", 3)
    now = base(spark).withColumn("row", F.col("row") + 1)
    assert len(found(held.differences(now))) == 401
    assert len(found(held.differences(base(spark).withColumn("more", F.lit(1))))) == 402


def test_empty_selections(spark, tmp_path, held):
    none = base(spark).limit(0)
    assert {v[0] for v in found(held.differences(none)).values()} == {"removed"} and len(found(held.differences(none))) == 402
    path = str(tmp_path / "none")
    frozen.freeze(none, ["issuer", "shard"], request(spark).limit(0), path)
    empty = frozen.Frozen(spark, path)
    assert empty.differences(none).count() == 0 and empty.request().count() == 0
    assert {v[0] for v in found(empty.differences(base(spark))).values()} == {"added"}


def test_what_is_not_frozen_whole_cannot_be_read(spark, tmp_path, held):
    shutil.rmtree(f"{held.path}/tree")
    with pytest.raises(Exception, match="tree"):
        frozen.Frozen(spark, held.path).differences(base(spark))
    with pytest.raises(ValueError):
        frozen.freeze(base(spark), ["issuer"], request(spark), str(tmp_path / "x"), leaf_digits=2, shard_digits=2)

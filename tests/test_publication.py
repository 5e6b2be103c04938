"""Publication: completeness of batches and pointers that two writers move."""

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pitspark.sources.publication import Pointers, publication_problems, publish_complete

AT = datetime(2024, 1, 1)
CAPTURE = "capture int, completed_at timestamp, fetched_at timestamp, http_status int, body_hash string, blob_key string, byte_count int"


def problems(spark, inputs=((1, 1),), captures=((1, AT, AT, 200, "h", "k", 1),), coverage=((1, 1),), observations=((1, 1),), resolutions=((1, "observed", False),), batches=((1,),)):
    pairs = "batch int, capture int"
    df = publication_problems(
        spark.createDataFrame(list(batches), "batch int"), spark.createDataFrame(list(inputs), pairs), spark.createDataFrame(list(captures), CAPTURE), spark.createDataFrame(list(coverage), pairs),
        spark.createDataFrame(list(observations), pairs), spark.createDataFrame(list(resolutions), "batch int, status string, flagged boolean"),
    )
    return {r.batch: r.reasons for r in df.collect()}


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, []),
        ({"inputs": (), "coverage": (), "observations": ()}, ["no_coverage", "no_input"]),
        ({"captures": ()}, ["capture_not_archived"]),
        ({"captures": ((1, AT, AT, 304, "h", "k", 1),)}, ["capture_not_archived"]),
        ({"captures": ((1, AT, AT, None, "h", "k", 1),)}, ["capture_not_archived"]),
        ({"captures": ((1, AT, AT, 200, "h", None, 1),)}, ["capture_not_archived"]),
        ({"captures": ((1, AT, AT, 200, "h", "k", None),)}, ["capture_not_archived"]),
        ({"captures": ((1, None, AT, 200, "h", "k", 1),)}, ["capture_not_archived"]),
        ({"coverage": ((2, 1),)}, ["no_coverage"]),
        ({"coverage": ((1, 2),)}, ["metadata_capture_outside_inputs"]),
        ({"coverage": ((1, None),)}, ["metadata_capture_outside_inputs"]),
        ({"observations": ((1, 1), (1, 9))}, ["observation_capture_outside_inputs"]),
        ({"inputs": ((2, 9), (1, 1)), "observations": ((1, 9),)}, ["observation_capture_outside_inputs"]),
        ({"resolutions": ((1, "ambiguous", False),)}, ["unresolved_without_flag"]),
        ({"resolutions": ((1, "ambiguous", None),)}, ["unresolved_without_flag"]),
        ({"resolutions": ((1, None, False),)}, ["unresolved_without_flag"]),
        ({"resolutions": ((1, "missing", True),)}, []),
        ({"resolutions": ()}, []),
        ({"inputs": ((1, 1), (1, 1)), "batches": ((1,), (1,))}, []),
    ],
)
def test_a_batch_needs_inputs_archived_captures_and_coverage(spark, change, reasons):
    assert problems(spark, **change) == {1: reasons}


def offer(spark, *rows):
    return spark.createDataFrame(list(rows), "scope int, sequence long, snapshot string")


def held(pointers):
    return {r.scope: (r.sequence, r.snapshot) for r in pointers.newest()[1].collect()}


def test_pointers_move_forward_only(spark, tmp_path):
    p = Pointers(spark, str(tmp_path / "p"), ["scope"])
    assert p.newest() == (0, None)
    p.publish(offer(spark, (1, 5, "a"), (2, 7, "b"), (1, 4, "z"), (3, None, "n"), (4, 1, None)))
    assert held(p) == {1: (5, "a"), 2: (7, "b")}
    done = p.publish(offer(spark, (1, 5, "c"), (2, 8, "d"), (5, 0, "e")))
    assert {r.scope: r.action for r in done.collect()} == {1: "kept", 2: "moved", 5: "moved"}
    assert held(p) == {1: (5, "a"), 2: (8, "d"), 5: (0, "e")}
    p.publish(offer(spark))
    assert held(p) == {1: (5, "a"), 2: (8, "d"), 5: (0, "e")} and p.editions() == [2, 3]


def test_a_writer_that_was_overtaken_merges_with_who_came_first(spark, tmp_path):
    first, second = (Pointers(spark, str(tmp_path / "p"), ["scope"]) for _ in range(2))

    class Overtaken(Pointers):
        reads = 0

        def newest(self):
            found = super().newest()
            self.reads += 1
            if self.reads == 1:
                second.publish(offer(spark, (1, 9, "high"), (2, 1, "low")))
            return found

    first.publish(offer(spark, (1, 1, "old")))
    late = Overtaken(spark, str(tmp_path / "p"), ["scope"])
    done = {r.scope: (r.sequence, r.snapshot, r.action) for r in late.publish(offer(spark, (1, 5, "lower"), (2, 3, "higher"))).collect()}
    assert late.reads == 2 and done == {1: (9, "high", "kept"), 2: (3, "higher", "moved")} and held(first) == {1: (9, "high"), 2: (3, "higher")}
    assert not [n for n in (tmp_path / "p").iterdir() if n.name.startswith("_")]


def test_a_torn_write_leaves_the_pointer(spark, tmp_path):
    p = Pointers(spark, str(tmp_path / "p"), ["scope"])
    p.publish(offer(spark, (1, 1, "a")))
    torn = offer(spark, (1, 2, "b")).withColumn("snapshot", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        p.publish(torn)
    offer(spark, (1, 3, "half")).write.parquet(str(tmp_path / "p" / "_dead"))
    assert held(p) == {1: (1, "a")}
    p.publish(offer(spark, (1, 2, "b")))
    assert held(p) == {1: (2, "b")}


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    def write(k):
        Pointers(spark, str(tmp_path / "p"), ["scope"]).publish(offer(spark, (0, k, f"s{k}"), (k, 1, "own")))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert held(Pointers(spark, str(tmp_path / "p"), ["scope"])) == {0: (4, "s4")} | {k: (1, "own") for k in range(1, 5)}


def test_only_complete_batches_are_published(spark, tmp_path):
    p = Pointers(spark, str(tmp_path / "p"), ["scope"])
    told = spark.createDataFrame([(1, []), (2, ["no_input"])], "batch int, reasons array<string>")
    offers = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 2), (2, 1, "c", 2), (3, 1, "d", 3)], "scope int, sequence long, snapshot string, batch int")
    publish_complete(p, offers, told)
    assert held(p) == {1: (1, "a")}

"""Feeds over several polls and over streams that are begun again."""

import datetime as dt
import re

from pyspark.sql import functions as F

from pitspark.operators import changes
from pitspark.streaming import change_feed, series_feed
from pitspark.streaming.change_feed import ChangeFeed
from pitspark.streaming.series_feed import SeriesFeed

D = dt.date


def polled(spark, rows):
    """issuer, accession, form, day of acceptance, content, complete."""
    at, cutoff = (lambda day: None if day is None else dt.datetime(2024, 1, day)), dt.datetime(2024, 1, 20)
    return spark.createDataFrame([(i, a, form, at(day), cutoff, content, complete, True) for i, a, form, day, content, complete in rows], change_feed.ROW)


def row(issuer, accession, content="x", form="10-K", day=1, complete=True):
    return (issuer, accession, form, day, content, complete)


def outcomes(feed, poll):
    return {r.issuer: (r.outcome, r.flags) for r in feed.outcomes().filter(F.col("poll") == poll).collect()}


def test_flags_keep_the_baseline(spark, tmp_path):
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed")
    feed.apply(polled(spark, [row(k, 10 * k) for k in range(1, 8)]), 0)
    assert outcomes(feed, 0) == {k: ("baseline", []) for k in range(1, 8)} and feed.found().count() == 0
    second = [row(1, 10), row(1, 11), row(2, 20, "y"), row(2, 21), row(3, 31), row(4, 40), row(4, 41, complete=False), row(5, 50), row(5, 51, form="10-K/A"), row(5, 52, form="8-K"), row(5, 53, day=25), row(6, 60), row(6, 61, day=None), row(9, 90, complete=False)]
    for _ in range(2):  # a batch that runs again counts once
        feed.apply(polled(spark, second), 1)
    assert outcomes(feed, 1) == {
        1: ("new_filing", []), 2: ("incomplete", ["existing_accession_metadata_changed"]), 3: ("incomplete", ["baseline_accession_missing"]), 4: ("incomplete", ["current_inventory_incomplete"]), 5: ("amendment", []), 6: ("incomplete", ["current_acceptance_unverified"]), 9: ("incomplete", ["current_inventory_incomplete"]),
    }
    assert sorted((r.issuer, r.accession, r.poll) for r in feed.found().collect()) == [(1, 11, 1), (5, 51, 1)]
    feed.apply(polled(spark, [row(2, 20), row(2, 21), row(3, 30), row(4, 40), row(4, 41), row(9, 90), row(1, 10), row(1, 11)]), 2)
    assert outcomes(feed, 2) == {1: ("no_change", []), 2: ("new_filing", []), 3: ("no_change", []), 4: ("new_filing", []), 9: ("baseline", [])}
    assert sorted((r.issuer, r.accession) for r in feed.state(2).collect() if r.issuer in (6, 7)) == [(6, 60), (7, 70)]


def test_whole_inventories_are_stored_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(change_feed, "EVERY", 2)
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed")
    polls = [[row(1, 1), row(2, 1)], [row(1, 1), row(1, 2)], [row(2, 1), row(2, 2)], [row(1, 1), row(1, 2), row(1, 3)], [row(2, 1), row(2, 2)]]
    for k, rows in enumerate(polls):
        feed.apply(polled(spark, rows), k)
    feed.apply(polled(spark, polls[4]), 4)  # runs again
    assert sorted((r.issuer, r.accession) for r in feed.state(4).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert sorted((r.issuer, r.accession, r.poll) for r in feed.found().collect()) == [(1, 2, 1), (1, 3, 3), (2, 2, 2)]


def test_a_stream_of_polls(spark, tmp_path):
    feed, source = ChangeFeed(spark, f"file://{tmp_path}/feed"), f"{tmp_path}/polls"
    for k, rows in enumerate([[row(1, 1)], [row(1, 1), row(1, 2)]]):
        polled(spark, rows).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(change_feed.ROW).option("recursiveFileLookup", "true").parquet(source)
        feed.start(stream).awaitTermination()
    assert [(r.issuer, r.accession, r.poll) for r in feed.found().collect()] == [(1, 2, 1)]


def test_late_observations_change_history_only(spark, tmp_path):
    feed, source = SeriesFeed(spark, f"file://{tmp_path}/series", ["issuer", "series"]), f"{tmp_path}/rows"
    parts = [[(1, "a", D(2024, 1, 5)), (1, "a", D(2024, 1, 4)), (2, "a", None)], [(1, "a", D(2024, 1, 3)), (1, "b", D(2024, 1, 1)), (1, "a", D(2024, 1, 5))], [(1, "a", D(2024, 1, 6)), (2, "a", D(2024, 1, 2)), (1, "a", D(2023, 1, 1))]]
    schema = "issuer int, series string, reference_date date"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
        feed.start(stream()).awaitTermination()
        feed.start(stream()).awaitTermination()  # nothing new: a restart counts nothing twice
    got = {(r.issuer, r.series): (r.reference_date, r.observations, r.late) for r in feed.newest().collect()}
    assert got == {(1, "a"): (D(2024, 1, 6), 6, 2), (1, "b"): (D(2024, 1, 1), 1, 0), (2, "a"): (D(2024, 1, 2), 2, 0)}


def test_a_larger_poll_has_more_tasks_and_none_gathers_what_it_scanned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(change_feed, "SHARE", 4)
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed")
    feed.apply(polled(spark, [row(k, k) for k in range(80)]), 0)
    held = [spark.read.parquet(str(p)).count() for p in (tmp_path / "feed" / "compared").glob("*.parquet")]
    assert sum(held) == 80 and max(held) <= 16 and len(held) > 4
    rows = polled(spark, [row(k, k) for k in range(80)])
    plan = changes.compared_filings(rows, rows, ["issuer"], ["10-K"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange")


def test_states_of_series_are_stored_again_and_need_no_call_for_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(series_feed, "EVERY", 2)
    schema, feed = "issuer int, series string, reference_date date", SeriesFeed(spark, f"file://{tmp_path}/series", ["issuer", "series"])
    parts = [[(1, None, D(2024, 1, 5)), (1, None, None)], [(1, None, D(2024, 1, 5)), (1, None, D(2024, 1, 2)), (2, "a", D(2024, 1, 9))], [(1, None, D(2024, 1, 7)), (2, "a", D(2024, 1, 8)), (2, "a", D(2024, 1, 8))], [(None, "a", None)], [(None, "a", D(2024, 1, 1)), (1, None, D(2024, 1, 6))]]
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema)
        assert not {"Python", "Pandas"} & set(re.findall("Python|Pandas", feed.advanced(df, k)._jdf.queryExecution().executedPlan().toString()))
        feed._write(df, k)
        feed._write(df, k)  # runs again
    got = {(r.issuer, r.series): (r.reference_date, r.observations, r.late) for r in feed.newest().collect()}
    assert got == {(1, None): (D(2024, 1, 7), 6, 2), (2, "a"): (D(2024, 1, 9), 3, 2), (None, "a"): (D(2024, 1, 1), 2, 0)}
    assert sorted(p.name for p in (tmp_path / "series").glob("whole-*")) == ["whole-1", "whole-3"]

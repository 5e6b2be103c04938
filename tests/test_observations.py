"""Batch and date selection against hand-computed cases and a plain definition."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pitspark.operators import observations

D, T = dt.date, dt.datetime
ASKS = "issuer int, selected date, cutoff timestamp"
BATCHES = "issuer int, batch long, response_at timestamp, known_at timestamp, published_at timestamp, answers string, window_from date, window_to date, coverage_state string"
HELD = "issuer int, batch long, reference_date date, value double, value_state string"
QUALITY = "batch long, rule string, severity string, reference_date date"


def batch(k, at, first, last, coverage="complete", answers=None, known=None, published=None):
    return (1, k, at, known or at, published or at, answers or str(k), first, last, coverage)


def held(k, day, value=None):
    return (1, k, day, value, "observed" if value is not None else "source_null")


def observed(spark, batches, rows, day, age=None, cutoff=T(2025, 2, 1), quality=(), issuer=1):
    frames = [spark.createDataFrame(list(r), s) for r, s in (([(issuer, day, cutoff)], ASKS), (batches, BATCHES), (rows, HELD), (quality, QUALITY))]
    (row,) = observations.observed(*frames, ["issuer"], age).collect()
    return row


def told(row):
    return row.reference_date, row.value, list(row.flags), row.usable


FIRST = batch(1, T(2025, 1, 3), D(2025, 1, 1), D(2025, 1, 3))
VALUE = held(1, D(2025, 1, 3), 4.25)


def test_the_newest_date_in_reach_keeps_its_own_date(spark):
    long_ = batch(1, T(2025, 1, 3), D(2025, 1, 1), D(2025, 1, 6))
    assert told(observed(spark, [long_], [VALUE], D(2025, 1, 6), 3)) == (D(2025, 1, 3), 4.25, ["backward_selected"], True)
    assert told(observed(spark, [long_], [VALUE], D(2025, 1, 6), 2)) == (D(2025, 1, 6), None, ["missing_observation"], False)
    row = observed(spark, [long_], [VALUE], D(2025, 1, 6), 3)
    assert row.age_days == 3 and row.batch == 1


def test_an_ask_without_a_known_batch_is_a_row(spark):
    assert told(observed(spark, [FIRST], [VALUE], D(2025, 1, 3), 7, T(2025, 1, 2))) == (D(2025, 1, 3), None, ["no_eligible_batch"], False)
    assert told(observed(spark, [FIRST], [VALUE], D(2025, 1, 3), issuer=2)) == (D(2025, 1, 3), None, ["no_eligible_batch"], False)
    late = batch(1, T(2025, 1, 3), D(2025, 1, 1), D(2025, 1, 3), known=T(2025, 1, 9))  # metadata ended later
    assert told(observed(spark, [late], [VALUE], D(2025, 1, 3), cutoff=T(2025, 1, 8)))[2] == ["no_eligible_batch"]


@pytest.mark.parametrize("first, last", [(D(2025, 1, 3), D(2025, 1, 4)), (D(2025, 1, 4), D(2025, 1, 4)), (D(2025, 1, 6), D(2025, 1, 8)), (D(1995, 1, 1), D(2025, 1, 3))])
def test_a_newer_empty_answer_for_the_date_or_a_later_window_blocks(spark, first, last):
    empty = batch(2, T(2025, 1, 8), first, last)
    assert told(observed(spark, [FIRST, empty], [VALUE], D(2025, 1, 6), 7)) == (D(2025, 1, 3), None, ["missing_observation"], False)


@pytest.mark.parametrize("first, last", [(D(2024, 12, 1), D(2025, 1, 2)), (D(2025, 1, 7), D(2025, 1, 9))])
def test_windows_that_end_before_the_date_or_begin_after_the_ask_do_not_count(spark, first, last):
    other = batch(2, T(2025, 1, 8), first, last)
    assert told(observed(spark, [FIRST, other], [VALUE], D(2025, 1, 6), 7)) == (D(2025, 1, 3), 4.25, ["backward_selected"], True)


def test_a_missing_value_sets_the_date_and_blocks(spark):
    later = batch(2, T(2025, 1, 4), D(2025, 1, 4), D(2025, 1, 4))
    assert told(observed(spark, [FIRST, later], [VALUE, held(2, D(2025, 1, 4))], D(2025, 1, 6), 7)) == (D(2025, 1, 4), None, ["backward_selected", "source_null"], False)


def test_two_values_of_one_answer_are_ambiguous(spark):
    rows = [VALUE, held(1, D(2025, 1, 3), 11.0)]
    for age in (None, 3):
        assert told(observed(spark, [FIRST], rows, D(2025, 1, 3), age)) == (D(2025, 1, 3), None, ["ambiguous_observation"], False)


def test_answers_of_one_time_differ_or_are_parsed_again(spark):
    other = batch(2, T(2025, 1, 3), D(2025, 1, 2), D(2025, 1, 3))
    assert told(observed(spark, [FIRST, other], [VALUE], D(2025, 1, 3)))[2] == ["ambiguous_batch"]
    again = batch(2, T(2025, 1, 3), D(2025, 1, 1), D(2025, 1, 3), answers="1", published=T(2025, 1, 20))
    row = observed(spark, [FIRST, again], [VALUE, held(2, D(2025, 1, 3), 5.0)], D(2025, 1, 3))
    assert (row.batch, row.value) == (2, 5.0)


def test_coverage_and_quality_decide_whether_a_value_is_usable(spark):
    partial = batch(1, T(2025, 1, 3), D(2025, 1, 1), D(2025, 1, 3), "partial")
    assert told(observed(spark, [partial], [VALUE], D(2025, 1, 3))) == (D(2025, 1, 3), 4.25, ["incomplete_coverage"], False)
    for severity, day, want in (("warning", None, (["odd"], True)), ("error", D(2025, 1, 3), (["odd"], False)), ("blocking", None, (["odd"], False)), ("error", D(2025, 1, 2), ([], True))):
        assert told(observed(spark, [FIRST], [VALUE], D(2025, 1, 3), quality=[(1, "odd", severity, day)]))[2:] == want


def plain(asks, batches, rows, age):
    """The definition: every ask with every batch."""
    out = []
    for issuer, day, cutoff in asks:
        oldest = day - dt.timedelta(days=age or 0)
        known = [b for b in batches if b[0] == issuer and b[3] <= cutoff and b[6] <= day and b[7] >= oldest]
        dates = [r[2] for r in rows if age is not None and r[1] in {b[1] for b in known} and oldest <= r[2] <= day]
        on = max(dates, default=day)
        if dates:
            known = [b for b in known if b[7] >= on]
        top = [b for b in known if b[2] == max(x[2] for x in known)]
        tied = len({b[5] for b in top}) > 1
        pick = max(top, key=lambda b: (b[4], b[1]))[1] if top and not tied else None
        found = [r for r in rows if r[1] == pick and r[2] == on]
        out.append((issuer, day, cutoff, on, pick, found[0][3] if len(found) == 1 else None, tied, len(found)))
    return sorted(out)


@pytest.mark.parametrize("age", [None, 0, 9])
def test_selection_is_that_of_the_definition(spark, age):
    rng = random.Random(7)
    day = lambda spread: D(2024, 3, 1) + dt.timedelta(days=rng.randint(-spread, spread))
    batches = []
    for k in range(400):
        at, first = T(2024, 3, 1) + dt.timedelta(hours=rng.randint(-300, 300)), day(20)
        batches.append((rng.randint(1, 4), k, at, at + dt.timedelta(hours=rng.choice([0, 0, 50])), at, str(k % 9), first, first + dt.timedelta(days=rng.choice([0, 1, 5, 40, 9000])), "complete"))
    rows = [(b[0], b[1], b[6] + dt.timedelta(days=rng.randint(-2, 6)), float(i), "observed") for i, b in enumerate(batches) if rng.random() < 0.8]
    asks = [(i, D(2024, 2, 25) + dt.timedelta(days=k), T(2024, 3, c)) for i in range(1, 6) for k in range(0, 20, 3) for c in (1, 6, 13)]
    frames = [spark.createDataFrame(r, s) for r, s in ((asks, ASKS), (batches, BATCHES), (rows, HELD))]
    got = observations.observed(*frames, spark.createDataFrame([], QUALITY), ["issuer"], age).collect()
    want = plain(asks, batches, rows, age)
    assert sorted((r.issuer, r.selected, r.cutoff, r.reference_date, r.batch or -1, r.value or -1.0) for r in got) == [(*w[:4], w[4] or -1, w[5] or -1.0) for w in want]
    assert [("ambiguous_batch" in r.flags) for r in sorted(got, key=lambda r: (r.issuer, r.selected, r.cutoff))] == [w[6] for w in want]


def test_a_window_is_few_spans_and_every_day_of_it_lies_in_one(spark):
    windows = [(D(1969, 12, 20), D(1970, 1, 5)), (D(1990, 1, 1), D(2024, 12, 31)), (D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 2), D(2024, 1, 1))]
    df = spark.createDataFrame(windows, "a date, b date").select("a", "b", observations.spans(F.col("a"), F.col("b")).alias("s"))
    for row in df.collect():
        days = [d for x in row.s for d in range(x.node << x.level, (x.node + 1) << x.level)]
        first, last = ((d - D(1970, 1, 1)).days for d in (row.a, row.b))
        assert sorted(days) == list(range(first, last + 1)) and len(row.s) <= 27


def test_intervals_that_hold_a_date_with_closures(spark):
    rng = random.Random(5)
    day = lambda n: D(2020, 1, 1) + dt.timedelta(days=n)
    intervals = [(rng.randint(1, 3), k, f"c{k}", day(a := rng.randint(0, 400)), None if k % 9 == 0 else day(a + rng.choice([0, 1, 3, 50, 3000]))) for k in range(120)]
    closures = {k: day(rng.randint(0, 500)) for k in range(0, 120, 4)}
    facts = [(rng.randint(1, 4), i, None if i % 50 == 0 else day(rng.randint(-5, 450))) for i in range(300)] + [(1, 7, day(30))] * 2
    frames = spark.createDataFrame(facts, "issuer int, id int, day date"), spark.createDataFrame(intervals, "issuer int, interval int, label string, valid_from date, valid_to date"), spark.createDataFrame(list(closures.items()), "interval int, closed_on date")
    for closed in (closures, {}):
        got = observations.contained(*frames[:2], ["issuer"], "day", frames[2] if closed else None).collect()
        ends = {k: closed.get(k, to) or D(9999, 12, 31) for _, k, _, _, to in intervals}
        want = [(i, n, k) for i, n, d in facts if d for j, k, _, a, _ in intervals if i == j and a <= d < ends[k]]
        assert sorted((r.issuer, r.id, r.interval) for r in got) == sorted(want)


def test_open_intervals_add_no_lengths_to_look_up(spark, monkeypatch):
    looked = []
    levels_of = observations.levels_of
    monkeypatch.setattr(observations, "levels_of", lambda *a: looked.append(levels_of(*a)) or looked[-1])
    intervals = spark.createDataFrame([(1, 1, D(2020, 1, 1), None), (1, 2, D(2020, 1, 9), D(9000, 1, 1)), (1, 3, D(2021, 1, 1), None)], "issuer int, interval int, valid_from date, valid_to date")
    facts = spark.createDataFrame([(1, D(2020, 1, 10)), (1, D(2020, 1, 8)), (1, D(2019, 12, 31)), (1, None)], "issuer int, day date")
    got = observations.contained(facts, intervals, ["issuer"], "day").collect()
    assert sorted((r.day.day, r.interval) for r in got) == [(8, 1), (10, 1), (10, 2)] and looked == [4]
    assert observations.contained(facts.limit(0), intervals, ["issuer"], "day").count() == 0


def test_publication_knowledge(spark):
    at, on, cutoff = T(2024, 1, 5, 10), D(2024, 1, 5), T(2024, 1, 5, 12)
    schema = "precision string, published_at timestamp, published_on date, start date, cutoff timestamp, as_of date"
    cases = {
        ("instant", at, None, None, cutoff, None): None, ("instant", cutoff + dt.timedelta(1), None, None, cutoff, None): "source_publication_after_cutoff", ("date", None, on, None, cutoff, None): "ambiguous_source_publication_date",
        ("date", None, D(2024, 1, 4), None, cutoff, D(2024, 1, 4)): None, ("instant", at, None, None, cutoff, on): "ambiguous_source_vintage_at_instant", ("instant", at, None, on, cutoff, None): "ambiguous_source_vintage_at_instant",
        ("unknown", None, None, None, cutoff, None): "unknown_source_publication_time",
    }
    for case, want in cases.items():
        df = spark.createDataFrame([case], schema)
        assert df.select(observations.publication_problem(*[F.col(c) for c in ("precision", "published_at", "published_on", "start", "cutoff", "as_of")]).alias("x")).first().x == want


def test_short_windows_look_at_few_levels(spark):
    df = spark.sql("select date '2024-01-01' + cast(id % 40 as int) as a, date '2024-01-01' + cast(id % 40 + id % 13 as int) as b from range(600)").distinct()
    most = observations.levels_of(df, F.col("a"), F.col("b"))
    few, every = observations.spans(F.col("a"), F.col("b"), most), observations.spans(F.col("a"), F.col("b"))
    assert most == 4 and df.filter(few != every).count() == 0
    assert sum(len(r.s) for r in df.select(few.alias("s")).collect()) > 600

"""Hand-computed cases of single operators."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.functions.concepts import CONCEPTS
from pitspark.operators import changes, history, inputs, metrics, periods, sectors, selection, valuation
from pitspark.sources import bodies

D = dt.date


def company_rows(spark, rows):
    schema = "sector int, issuer int, cap decimal(18,2), income decimal(18,2), revenue decimal(18,2), prior_revenue decimal(18,2), period_end date"
    return spark.createDataFrame([(1, i, *[None if v is None else Decimal(v) for v in r], D(2025, 12, 31)) for i, r in enumerate(rows)], schema)


def values(rows, *names, policy=sectors.Policy()):
    found = sectors.sector_values(rows, ["sector"], {n: sectors.METRICS[n] for n in names}, policy).collect()
    return {r.metric: r for r in found} if len(names) > 1 else found[0]


def pe(spark, incomes, caps=None):
    return values(company_rows(spark, [((caps or [100] * 9)[i], x, 1, 1) for i, x in enumerate(incomes)]), "price_earnings")


def test_total_keeps_a_loss_and_the_distribution_leaves_it_out(spark):
    r = pe(spark, [10, 1, -9])
    assert (r.n, r.k, r.v, r.v_ratio, r.total) == (3, 3, 3, 2, 150.0)
    assert (r.p25, r.median, r.p75, r["mean"]) == (32.5, 55.0, 77.5, 55.0)
    assert (r.positive, r.zero, r.negative, r.zero_denominators) == (2, 0, 1, 0)
    assert r.comparable and not r.comparable_ratio  # two of the distribution are too few


def test_profit_breadth_counts_all_with_an_income(spark):
    r = values(company_rows(spark, [(100, x, 1, 1) for x in (10, 1, -9)]), "profit_breadth")
    assert r.total == pytest.approx(2 / 3) and (r.positive, r.negative, r.v) == (2, 1, 3)


def test_total_is_null_when_the_denominators_sum_to_zero_or_less(spark):
    r = pe(spark, [10, 1, -11])
    assert r.total is None and r.v == 3 and "denominator_nonpositive" in r.flags


def test_a_total_within_its_error_is_null(spark):
    rows = company_rows(spark, [(100, 3, 1, 1), (100, 3, 1, 1), (100, -5, 1, 1)]).withColumn("income_error", F.lit(1).cast("decimal(18,2)"))
    r = values(rows, "price_earnings")
    assert r.total is None and "denominator_indistinguishable_from_zero" in r.flags and r.v_ratio == 2


def test_a_missing_input_leaves_both_sums(spark):
    r = pe(spark, [10, 1, None])
    assert (r.n, r.k, r.v) == (3, 2, 2) and r.total == pytest.approx(200 / 11)


def test_evidence_issues_keep_a_company_out(spark):
    rows = company_rows(spark, [(100, 10, 1, 1), (100, 1, 1, 1)]).withColumn("income_issues", F.when(F.col("issuer") == 1, F.array(F.lit("unsupported_currency"))))
    assert values(rows, "price_earnings").k == 1
    reasons = sectors.exclusion_counts(sectors.assessed(rows, sectors.METRICS["price_earnings"]).select("sector", "m.reasons"), ["sector"]).collect()
    assert [(r.reason, r.n) for r in reasons] == [("unsupported_currency", 1)]


def test_growth_of_one_large_company_is_not_broad(spark):
    found = values(company_rows(spark, [(1, 1, 110, 100)] + [(1, 1, 9, 10)] * 9), "revenue_growth", "growth_breadth")
    r = found["revenue_growth"]
    assert r.total == pytest.approx(1 / 190) and r["median"] == pytest.approx(-0.1) and found["growth_breadth"].total == 0.1
    said = lambda r: r.select(sectors.growth_observations(*map(F.col, ("total", "median", "positive", "zero", "negative", "v", "comparable"))).alias("o")).first().o
    frame = sectors.sector_values(company_rows(spark, [(1, 1, 110, 100)] + [(1, 1, 9, 10)] * 9), ["sector"], {"revenue_growth": sectors.METRICS["revenue_growth"]})
    assert said(frame) == ["aggregate_grew_most_declined", "median_declined", "1/0/9/10"]
    assert said(frame.withColumn("comparable", F.lit(False))) == []


def test_breadth_is_among_valid_growths(spark):
    r = values(company_rows(spark, [(1, 1, 11, 10), (1, 1, 11, 0)]), "growth_breadth")
    assert (r.n, r.k, r.v, r.total, r.zero_denominators) == (2, 2, 1, 1.0, 1)


def test_gate_is_reached_by_equality_and_asks_for_a_whole_roster(spark):
    policy = sectors.Policy(least_contributors=2, issuer_coverage=1.0, cap_coverage=1.0)
    rows = company_rows(spark, [(100, 10, 1, 1), (100, 5, 1, 1)])
    assert values(rows, "price_earnings", policy=policy).comparable
    r = values(rows.withColumn("roster_complete", F.lit(False)), "price_earnings", policy=policy)
    assert not r.comparable and {"partial_sector_universe", "limited_coverage"} <= set(r.flags)


def test_coverage_and_dates_go_by_the_cohort(spark):
    rows = company_rows(spark, [(100, 10, 1, 1), (300, -1, 1, 1), (600, None, 1, 1)]).withColumns({"cap_date": F.date_add("period_end", F.col("issuer")), "period_end": F.date_sub("period_end", F.col("issuer") * 10)})
    r = values(rows, "price_earnings")
    assert r.cap_coverage == 0.4 and r.cap_coverage_ratio == 0.1 and r.ratio_eligibility == 0.5
    assert (r.first_end, r.last_end, r.first_quote, r.last_quote) == (D(2025, 12, 21), D(2025, 12, 31), D(2025, 12, 31), D(2026, 1, 1))
    unknown = values(company_rows(spark, [(100, 10, 1, 1), (None, 5, 1, 1)]), "price_earnings")
    assert unknown.full_cap is None and "full_capitalization_unknown" in unknown.flags


def test_growth_leaves_out_the_prior_leaders(spark):
    caps = [(1, 10), (2, 20), (3, 30), (4, 40), (5, 50), (60, 1), (70, 2)]
    rows = company_rows(spark, [(now, 1, 200 if i < 5 else 110, 100) for i, (now, _) in enumerate(caps)])
    rows = rows.withColumn("prior_cap", F.element_at(F.array(*[F.lit(p) for _, p in caps]), F.col("issuer") + 1).cast("decimal(18,2)"))
    r = sectors.concentration(rows, ["sector"]).first()
    assert r.top_share == pytest.approx((60 + 70 + 5 + 4 + 3) / 145) and r.growth == pytest.approx(520 / 700) and r.growth_without_top == pytest.approx(0.1)
    r = sectors.concentration(rows.withColumn("prior_cap", F.when(F.col("issuer") > 0, F.col("prior_cap"))), ["sector"]).first()
    assert r.growth_without_top is None and r.top_share is not None


def test_axis_holds_zero(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", -1.0), ("b", 3.0), ("c", 0.0), ("d", None)], "k string, v double")
    got = {}
    for r in sectors.axis_ticks(rows, ["k"], "v").collect():
        got.setdefault(r.k, {})[r.tick] = r.value
    assert {k: (round(v[0], 9), round(v[4], 9)) for k, v in got.items()} == {"a": (0.0, 4.2), "b": (-1.2, 3.2), "c": (0.0, 1.0), "d": (0.0, 1.0)}


def evidence(spark, **other):
    row = {"value": Decimal(5), "absolute_error": Decimal(1), "currency": "USD", "basis": "common_equity", "input_hash": "a" * 64, "usable": True, "period_start": None, "period_end": D(2025, 12, 31), "flags": ["revised_view"]} | other
    schema = "value decimal(18,2), absolute_error decimal(18,2), currency string, basis string, input_hash string, usable boolean, period_start date, period_end date, flags array<string>"
    return spark.createDataFrame([tuple(row.values())], schema).select(F.struct("*").alias("e"))


@pytest.mark.parametrize(
    ("other", "instant", "want"),
    [
        ({}, True, []),
        ({"absolute_error": None}, True, ["source_precision_unknown"]),
        ({"absolute_error": Decimal(-1)}, True, ["source_precision_invalid"]),
        ({"input_hash": "A" * 64}, True, ["evidence_hash_invalid"]),
        ({"value": None, "usable": None}, True, ["evidence_unusable", "evidence_value_invalid"]),
        ({"currency": None, "basis": "x", "flags": ["late"]}, True, ["incompatible_evidence_basis", "late", "unsupported_currency"]),
        ({"period_end": D(2025, 12, 30)}, True, ["incompatible_equity_date"]),
        ({"period_start": D(2025, 1, 1)}, False, []),
        ({"period_start": D(2024, 12, 1)}, False, ["unsupported_flow_period"]),
        ({"period_start": D(2025, 2, 1), "period_end": D(2026, 1, 31)}, False, ["unsupported_flow_period"]),
        ({}, False, ["unsupported_flow_period"]),
    ],
)
def test_evidence_issues(spark, other, instant, want):
    got = evidence(spark, **other).select(sectors.evidence_issues(F.col("e"), "common_equity", F.lit("2025-12-31").cast("date"), instant).alias("x")).first().x
    assert sorted(got) == want


def test_restated_fact_by_mode(spark):
    rows = spark.createDataFrame([("x", D(2018, 2, 16), 10999), ("x", D(2019, 6, 7), 10941), ("y", D(2019, 6, 7), 1), ("y", D(2019, 6, 7), 2)], "fact string, filed date, value long")
    first = {r.fact: r for r in selection.editions(rows, ["fact"], latest=False).collect()}
    last = {r.fact: r for r in selection.editions(rows, ["fact"], latest=True).collect()}
    assert (first["x"].value, last["x"].value) == (10999, 10941)
    assert last["y"].value is None and last["y"].reason == "ambiguous_filing_order"


def test_history_band_excludes_the_window_start(spark):
    ends = [D(2025, 3, 31), D(2025, 6, 30), D(2025, 9, 30), D(2025, 12, 31), D(2022, 12, 31)]
    points = spark.createDataFrame([(1, e, v, i) for i, (e, v) in enumerate(zip(ends, (10.0, 20.0, 30.0, 40.0, 999.0)))], "k int, quarter_end date, value double, point_id long")
    dates = spark.createDataFrame([(1, D(2025, 12, 31))], "k int, as_of date")
    r = history.bands(history.sampled(points, ["k"]), dates, ["k"], 3, 4).first()
    assert (r.samples, r.p25, r.p50, r.p75) == (4, 17.5, 25.0, 32.5)


def test_four_quarters_need_to_touch(spark):
    q = [(1, D(2024, 1, 1), D(2024, 3, 31)), (1, D(2024, 4, 1), D(2024, 6, 30)), (1, D(2024, 7, 1), D(2024, 9, 30)), (1, D(2024, 10, 1), D(2024, 12, 31)), (1, D(2025, 4, 1), D(2025, 6, 30))]
    rows = spark.createDataFrame([(*x, 1) for x in q], "k int, period_start date, period_end date, v long")
    assert [r.v for r in periods.four_quarters(rows, ["k"], ["v"]).orderBy("period_end").collect()] == [None, None, None, 4, None]


def test_february_29(spark):
    assert spark.range(1).select(scalar.window_start(F.lit("2024-02-29").cast("date"), 3).alias("d")).first().d == D(2021, 2, 28)


def forecast(spark, years, **other):
    row = {"revenue": 100.0, "growth": [0.1] * years, "margins": [0.2] * years, "taxes": [0.25] * years, "reinvestment": [0.05] * years, "wacc": 0.1, "risk_free": 0.04, "terminal_growth": 0.02, "terminal_margin": 0.2, "terminal_tax": 0.25, "terminal_roic": 0.08, "k": 1} | other
    return spark.createDataFrame([row])


@pytest.mark.parametrize(("years", "ev", "dominant"), [(3, 173.4375, True), (5, 193.4375, False)])
def test_forward_value(spark, years, ev, dominant):
    r = valuation.forward(forecast(spark, years)).first()
    assert r.ev == pytest.approx(ev) and r.dominant == dominant and r.terminal_pv == pytest.approx(143.4375)


def test_bridge_needs_all_seven_claims(spark):
    values = spark.createDataFrame([(k, 100.0) for k in range(1, 6)], "k int, ev double")
    kinds = [*valuation.ADDED, *valuation.SUBTRACTED]
    known, old = dt.datetime(2024, 1, 1), D(2023, 12, 31)
    row = lambda k, kind, **o: tuple(({"k": k, "kind": kind, "amount": Decimal(10), "state": "eligible_amount", "currency": "USD", "known_at": known, "as_of": old} | o).values())
    claims = [row(1, x) for x in kinds] + [row(2, x) for x in kinds[:6]] + [row(3, x, **({"currency": "EUR"} if x == "debt" else {})) for x in kinds] + [row(4, x, **({"as_of": D(2020, 1, 1)} if x == "cash" else {})) for x in kinds] + [row(5, x) for x in [*kinds, "cash"]]
    rows = spark.createDataFrame(claims, "k int, kind string, amount decimal(18,2), state string, currency string, known_at timestamp, as_of date")
    got = {r.k: (r.equity, r.reasons) for r in valuation.bridge(values, rows, ["k"], F.lit("USD"), F.lit("2024-01-02").cast("timestamp"), 100).collect()}
    assert got == {1: (70.0, []), 2: (None, ["claim_missing:pensions"]), 3: (None, ["ineligible_claim:debt"]), 4: (None, ["ineligible_claim:cash"]), 5: (None, ["claim_repeated:cash"])}


def test_price_states(spark):
    body = '[{"date":"2024-01-02T00:00:00Z","open":99,"high":99,"low":90,"close":100,"volume":true,"adjClose":5,"adjHigh":4,"adjLow":1},{"date":"2024-01-03","close":null},{"date":"2024-01-03","close":"100.5"},{"date":"2024-01-04","splitFactor":-1,"divCash":1e2},{"date":"2024-01-05T09:00:00Z"},7]'
    rows = bodies.eod_prices(spark.createDataFrame([(1, body)], "k int, body string"), ["k"], "2024-01-01", "2024-01-31")
    found = rows.withColumns({"flags": bodies.ohlc_flags(), "adj_flags": bodies.ohlc_flags("adj")}).orderBy(F.asc_nulls_last("session"), "close_state", "problem").collect()
    assert found[0].volume_state == "unparseable" and float(found[0].close) == 100 and found[0].flags == ["close", "high", "low", "open"]
    assert found[0].adj_flags == ["adjClose", "adjHigh", "adjLow", "adjOpen"]
    assert [r.close_state for r in found[1:3]] == ["source_null", "unparseable"] and all(r.problem == "duplicate_session" for r in found[1:3])
    assert found[3].splitFactor_state == "unparseable" and float(found[3].divCash) == 100 and found[3].problem is None
    assert sorted(r.problem for r in found[4:]) == ["body_malformed", "date_invalid"]


def test_a_price_body_that_repeats_a_key_or_is_no_array_is_a_problem(spark):
    rows = spark.createDataFrame([(1, '[{"date":"2024-01-02","close":1,"close":2}]'), (2, "{}"), (3, "x"), (4, None), (5, "[]")], "k int, body string")
    found = bodies.eod_prices(rows, ["k"], "2024-01-01", "2024-01-31").collect()
    assert sorted((r.k, r.problem) for r in found) == [(k, "body_malformed") for k in (1, 2, 3, 4)]


def test_older_documents_have_bounds(spark):
    body = '{"filings":{"recent":{},"files":[{"name":"a","filingCount":3,"filingFrom":"2001-01-01","filingTo":"2002-01-01"},{"name":"b","filingFrom":"2003-01-01","filingTo":"2002-01-01"},{"filingCount":1},{"name":"c"}]}}'
    found = bodies.older_documents(spark.createDataFrame([(1, body)], "k int, body string"), ["k"]).collect()
    assert [(r.name, r.advertised, r.problem) for r in found] == [("a", 3, None), ("b", None, "bounds_crossed"), (None, 1, "name_missing"), ("c", None, "bounds_missing")]


@pytest.mark.parametrize(
    ("text", "scale", "sign", "form", "want"),
    [("+5", 0, None, None, "5"), (".5", 0, "-", None, "-0.5"), ("5.", 3, None, None, "5000"), ("1,000", 0, None, None, None), ("1,000", -3, None, "num-dot-decimal", "1"), ("\u00a01 000.2 5\n", 0, None, "num-dot-decimal", "1000.25"), ("dash", 6, None, "fixed-zero", "0"), ("5", 0, None, "num-unit-decimal", None), ("-5", 0, None, None, None), ("123456789012345678.1", 0, None, None, "123456789012345678.1"), ("", 0, None, None, None), (None, 0, None, None, None)],
)
def test_scaled_numbers_are_exact(spark, text, scale, sign, form, want):
    row = spark.createDataFrame([(text, scale, sign, form)], "t string, s int, g string, f string")
    got = row.select(scalar.scaled_number(*map(F.col, "tsgf")).alias("x")).first().x
    assert got == (None if want is None else Decimal(want))


def points(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "k int, point_id long, quarter_end date, value double, input_hash string, flags array<string>")


def test_samples_have_all_their_reasons(spark):
    q = D(2025, 3, 31)
    rows = points(spark, [(q, 1.0, "h", []), (q, 1.0, "h", []), (D(2025, 1, 31), 1.0, "h", []), (D(2025, 6, 30), 1.0, "h", []), (D(2025, 6, 30), 1.0, "other", []), (D(2025, 9, 30), None, " ", ["late"]), (D(2025, 12, 31), float("inf"), "h", [])])
    got = {r.point_id: r.reasons for r in history.sampled(rows, ["k"]).collect()}
    assert got == {0: [], 1: ["duplicate_sample"], 2: ["not_quarter_end"], 3: ["conflicting_quarter"], 4: ["conflicting_quarter"], 5: ["late", "missing_lineage", "missing_value"], 6: ["nonfinite_value"]}
    other = history.sampled(rows, ["k"], F.col("point_id") != 4).collect()
    assert {r.point_id: r.reasons for r in other}[3] == [] and {r.point_id: r.reasons for r in other}[4] == ["incompatible_series"]


@pytest.mark.parametrize(("rates", "want"), [((0.0, 0.0, 0.1), "mixed"), ((0.0, 0.03, 0.06), "rising"), ((0.06, 0.03, 0.0), "falling"), ((0.0, 0.02, 0.0), "broadly_stable"), ((0.0, None, 0.0), None)])
def test_trend_of_three_rates(spark, rates, want):
    ends = [(D(2025, 1, 1), D(2025, 3, 31)), (D(2025, 4, 1), D(2025, 6, 30)), (D(2025, 7, 1), D(2025, 9, 30))]
    rows = spark.createDataFrame([(1, *e, r) for e, r in zip(ends, rates)], "k int, period_start date, period_end date, rate double")
    last = history.trend(rows, ["k"], "rate", 0.02).orderBy(F.desc("period_end")).first()
    assert last.trend == want and last.reasons == ([] if want else ["trend_input_unavailable"])
    gap = rows.withColumns({"period_start": F.when(F.month("period_start") == 7, F.date_add("period_start", 1)).otherwise(F.col("period_start"))})
    assert history.trend(gap, ["k"], "rate", 0.02).orderBy(F.desc("period_end")).first().reasons[0] == "nonconsecutive_trend_quarters"


def test_a_year_never_meets_a_quarter(spark):
    rows = spark.createDataFrame([(1, D(2024, 10, 1), D(2024, 12, 31), 10), (1, D(2024, 1, 1), D(2024, 12, 31), 40), (1, D(2025, 1, 1), D(2025, 12, 31), 50), (1, D(2025, 10, 1), D(2025, 12, 31), 20), (1, D(2024, 2, 1), D(2024, 4, 30), 1), (1, D(2025, 2, 1), D(2025, 4, 30), 1)], "k int, period_start date, period_end date, v long")
    got = {(r.period_start, r.period_end): r.prior for r in periods.compared(rows, ["k"], "v").collect()}
    assert got[D(2025, 1, 1), D(2025, 12, 31)] == 40 and got[D(2025, 10, 1), D(2025, 12, 31)] == 10 and got[D(2025, 2, 1), D(2025, 4, 30)] is None


def test_observations_and_review(spark):
    rows = spark.createDataFrame([(1, "revenue_growth", 0.0, True, []), (1, "free_cash_flow", -1.0, True, []), (1, "operating_margin", -0.1, True, []), (1, "net_margin", -2.0, True, ["extreme_margin"]), (1, "return_on_assets", None, False, ["x"])], "k int, metric string, value double, usable boolean, reasons array<string>")
    assert {r.metric: r.rule for r in metrics.observed(rows).collect()} == {"revenue_growth": "revenue_unchanged", "free_cash_flow": "cash_spending_gap", "operating_margin": "operating_loss", "net_margin": "consolidated_loss"}
    got = [(r.place, r.topic, r.rule, r.metrics) for r in metrics.review_items(rows, ["k"]).orderBy("place").collect()]
    assert got == [(1, "data_availability", "data_review", ["return_on_assets"]), (2, "extreme_margin", "extreme_margin_review", ["net_margin"]), (3, "cash_generation", "cash_spending_gap", ["free_cash_flow"])]
    assert metrics.review_items(rows, ["k"], 9).filter("topic = 'earnings'").first().metrics == ["net_margin", "operating_margin"]


def test_levels_of_a_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 9)], "parent int, child int")
    roots = spark.createDataFrame([(1,), (9,)], "node int")
    got = {r.node: r.depth for r in selection.acyclic_levels(edges, roots, 5).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 9: 5}


def test_flags_are_sorted_sets(spark):
    r = spark.range(1).select(flags.union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit(None))).alias("x"), flags.blocking(F.array(F.lit("revised_view"), F.lit("z"))).alias("y")).first()
    assert r.x == ["a", "b"] and r.y == ["z"]


def test_extreme_margin_does_not_block(spark):
    r = metrics.metric(spark.createDataFrame([(Decimal(30), Decimal(10))], "income decimal(18,2), revenue decimal(18,2)"), "net_margin").first()
    assert r.value == 3.0 and r.reasons == ["extreme_margin"]


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (2, 5.0), (2, 5.0)], "k int, v double")
    assert {(r.k, r.bin): r.n for r in sectors.histogram(rows, ["k"], "v", 2).collect()} == {(1, 0): 1, (1, 1): 2, (2, 0): 2}


def test_membership_by_what_was_known(spark):
    known = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "a", D(2024, 1, 1), None, known), (1, "b", D(2024, 1, 1), D(2024, 2, 1), known), (2, "a", D(2024, 1, 1), None, dt.datetime(2024, 1, 5, 23)), (3, "a", D(2024, 1, 1), None, dt.datetime(2024, 1, 6))], "issuer int, class string, effective_from date, effective_to date, known_at timestamp")
    dates = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 2, 1),)], "as_of date")
    issuers = spark.createDataFrame([(1,), (2,), (3,), (4,)], "issuer int")
    ask = lambda before: {(r.issuer, r.as_of.month): (r["class"], r.reason) for r in sectors.membership_at(issuers, rows, dates, F.lit(before).cast("timestamp")).collect()}
    found = ask("2025-01-01")
    assert found == {(1, 1): (None, "classification_conflict"), (1, 2): ("a", None), (2, 1): ("a", None), (2, 2): ("a", None), (3, 1): (None, "classification_unavailable"), (3, 2): ("a", None), (4, 1): (None, "classification_unavailable"), (4, 2): (None, "classification_unavailable")}
    assert ask("2024-01-02")[2, 2] == (None, "classification_unavailable")


def inventory(spark, rows):
    cutoff = dt.datetime(2024, 1, 10)
    return spark.createDataFrame([(k, a, form, None if day is None else dt.datetime(2024, 1, day), cutoff, c) for k, a, form, day, c in rows], "issuer int, accession string, form string, acceptance_at timestamp, cutoff timestamp, content string")


def test_outcome_of_a_comparison(spark):
    same = [(k, "old", "10-K", 1, "x") for k in range(1, 10)]
    now = [r for r in same if r[0] not in (5, 6)] + [(2, "n", "10-K", 2, "x"), (3, "n", "10-K/A", 2, "x"), (4, "n", "10-K", 2, "x"), (4, "m", "10-K/A", 2, "x"), (6, "old", "10-K", 1, "y"), (7, "n", "10-K", None, "x"), (8, "n", "10-K", 11, "x"), (8, "o", "8-K", 2, "x"), (9, "n", "10-K", 2, "x"), (9, "n", "10-K", 2, "x")]
    got = {r.issuer: (r.outcome, r.flags) for r in changes.compared_inventories(inventory(spark, same), inventory(spark, now), ["issuer"], ["10-K", "10-K/A"]).collect()}
    assert got == {
        1: ("no_change", []), 2: ("new_filing", []), 3: ("amendment", []), 4: ("mixed_changes", []), 5: ("incomplete", ["baseline_accession_missing"]), 6: ("incomplete", ["existing_accession_metadata_changed"]),
        7: ("incomplete", ["current_acceptance_unverified"]), 8: ("no_change", []), 9: ("incomplete", ["current_duplicate_accession"]),
    }


def test_places_go_on_over_ranges(spark):
    values = [(i, None if i % 5 == 0 else float(i * 7919 % 97)) for i in range(3000)]
    rows = spark.createDataFrame(values, "id int, total double")
    got = sectors.placed(rows, [F.desc_nulls_last("total"), F.asc("id")], "place")
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r.id: r.place for r in got.collect()} == {r[0]: k + 1 for k, r in enumerate(want)}
    assert sectors.placed(rows.limit(0), [F.desc_nulls_last("total")], "place").count() == 0


def test_the_ordered_query_does_not_go_through_one_task(spark):
    from pitspark.plans import catalog

    found = catalog.QUERIES["O3_ordered_with_gaps_last"](spark, "/root/testdata/sf0.001")
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_numeric_limits(spark):
    rows = [("1", True), ("-0.0", True), ("7" * 1000, True), ("7" * 1001, False), ("1E1000", True), ("12E1000", False), ("1e-1000", True), ("1.5E-1000", False), ("x", False), ("", False), ("1E99999999999999999999", False), (None, None)]
    got = spark.createDataFrame(rows, "t string, want boolean").select(inputs.within_limits(F.col("t")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_units_and_scopes(spark):
    units = [("USD", ["iso4217:USD"], None, True), ("USD", ["iso4217:EUR"], [], False), ("shares", ["xbrli:shares"], [], True), ("USD/shares", ["iso4217:USD"], ["xbrli:shares"], True), ("USD/shares", ["iso4217:USD"], [], False), ("usd", ["iso4217:usd"], [], None), (None, None, None, None)]
    rows = spark.createDataFrame(units, "key string, numerators array<string>, denominators array<string>, want boolean")
    assert all(r.x == r.want for r in rows.select(inputs.unit_fits(F.struct("key", "numerators", "denominators")).alias("x"), "want").collect())


CFO, CAPEX = inputs.CASH_CONCEPTS


def test_operands_of_one_formula(spark):
    schema = "concept string, value decimal(18,2), issues array<string>, history_key string, basis string, unit string, kind string, start date, end date, edition string, family string, scope string"
    good = (CFO, Decimal(5), ["revised_view"], "own", "us_gaap", "USD", "duration", D(2025, 1, 1), D(2025, 3, 31), "e", "cash_flow", "consolidated")

    def ask(**other):
        names = [x.split()[0] for x in schema.split(", ")]
        second = tuple(other.get(n, CAPEX if n == "concept" else v) for n, v in zip(names, good))
        rows = spark.createDataFrame([(1, good), (2, second)], f"k int, o struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>".replace("decimal(18:2)", "decimal(18,2)"))
        operands = F.transform(F.array_sort(F.collect_list(F.struct("k", "o"))), lambda x: x["o"])
        return rows.agg(operands.alias("x")).select(inputs.operand_issues(F.col("x"), [CFO, CAPEX]).alias("r")).first().r

    assert ask() == []
    assert ask(value=None, issues=["late"]) == ["late", "source_input_unavailable"]
    assert ask(start=None) == ["flow_period_required", "incompatible_periods"]
    assert ask(basis="other", unit="EUR", edition="f") == ["incompatible_filing_editions", "incompatible_reporting_basis", "incompatible_units", "unsupported_reporting_basis"]
    assert ask(scope=None, family="income", history_key="x", concept=CFO) == ["incompatible_history_policy", "incompatible_statement_family", "unexpected_concept", "unsupported_semantic_scope"]


def test_cash_concepts_are_those_of_the_vocabulary():
    assert set(inputs.CASH_CONCEPTS) <= set(CONCEPTS)


def test_a_metric_is_accepted_with_its_evidence_only(spark):
    metrics_ = spark.createDataFrame([(1, "m", ["a", "b"], ["1", "2"]), (2, "m", ["a", "b"], ["2", "1"]), (3, "m", ["a", "b"], ["1", "2"])], "k int, metric string, fields array<string>, operand_hashes array<string>")
    held = spark.createDataFrame([(k, f, h) for k in (1, 2) for f, h in (("a", "1"), ("b", "2"))] + [(3, "a", "1")], "k int, field string, input_hash string")
    got = {r.k: r.reasons for r in inputs.accepted_metrics(metrics_, held, ["k"]).collect()}
    assert got == {1: [], 2: ["company_metric_input_mismatch"], 3: ["company_metric_input_mismatch", "company_metric_input_missing"]}


def test_editions_go_by_acceptance_only_where_all_are_verified(spark):
    day, hour = D(2024, 1, 5), lambda h: dt.datetime(2024, 1, 5, h)
    rows = [("one", 1, day, None, "g", "USD", "covered"), ("timed", 1, day, hour(1), "g", "USD", "covered"), ("timed", 2, day, hour(2), "g", "USD", "covered"), ("open", 1, day, hour(1), "g", "USD", "covered"), ("open", 2, day, None, "g", "USD", "covered"), ("tie", 1, day, hour(1), "g", "USD", "covered"), ("tie", 2, day, hour(1), "g", "USD", "covered"), ("basis", 1, day, hour(1), "g", "USD", "covered"), ("basis", 1, day, hour(1), "h", "USD", "covered"), ("gap", 1, D(2024, 1, 4), None, "g", "USD", "covered"), ("gap", 2, day, None, "g", None, "covered")]
    frame = spark.createDataFrame(rows, "fact string, version int, filed date, acceptance_at timestamp, basis string, currency string, state string").withColumn("complete", F.col("fact") != "gap")
    last = {r.fact: (r.version, r.reason) for r in selection.chosen_versions(frame, ["fact"], latest=True).collect()}
    assert last == {"one": (1, None), "timed": (2, None), "open": (None, "ambiguous_filing_order"), "tie": (None, "ambiguous_filing_order"), "basis": (1, "incompatible_reporting_basis"), "gap": (2, "unresolved_coverage")}
    first = {r.fact: (r.version, r.reason) for r in selection.chosen_versions(frame, ["fact"], latest=False).collect()}
    assert first["timed"] == (1, None) and first["gap"] == (1, None)
    modes = {r.fact: r.mode for r in selection.chosen_versions(frame, ["fact"], latest=False).collect()}
    assert modes["gap"] == "earliest_available" and modes["one"] is None
    half = spark.createDataFrame([("x", 1, day, None, None, "USD", "covered", True), ("x", 1, day, None, "g", "USD", "covered", True)], frame.schema)
    assert selection.chosen_versions(half, ["fact"], latest=True).first().reason == "incompatible_reporting_basis"


def test_freshness_of_a_source(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [("ok", "success", at(2)), ("ok", "http_error", at(1)), ("stale", "success", at(2)), ("stale", "http_error", at(2)), ("again", "success", at(1)), ("again", "http_error", at(2)), ("again", "not_modified", at(3)), ("never", "archive_error", at(1)), ("open", "success", at(1)), ("open", "success", None), ("later", "success", at(9))]
    frame = spark.createDataFrame(rows, "k string, state string, finished_at timestamp")
    got = {r.k: r.flags for r in selection.freshness(frame, ["k"], F.lit("2024-01-05").cast("timestamp")).collect()}
    assert got == {"ok": [], "stale": ["newer_capture_failed"], "again": [], "never": ["capture_failed", "capture_unavailable"], "open": ["source_attempt_outcome_unknown"], "later": ["capture_unavailable", "source_attempt_outcome_unknown"]}


def test_a_pointer_moves_forward_only(spark):
    schema = "k string, sequence int, snapshot string"
    now, offer = spark.createDataFrame([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old"), ("d", 5, "old")], schema), spark.createDataFrame([("a", 6, "new"), ("b", 5, "new"), ("c", 4, "new"), ("e", 1, "new")], schema)
    got = {r.k: (r.sequence, r.snapshot, r.action) for r in selection.forward_only(now, offer, ["k"]).collect()}
    assert got == {"a": (6, "new", "moved"), "b": (5, "old", "kept"), "c": (5, "old", "kept"), "d": (5, "old", "unchanged"), "e": (1, "new", "moved")}


def test_status_by_priority(spark):
    rows = [(5.0, [], [], True, 0, "valid"), (None, ["denominator_nonpositive"], [], True, 0, "not_meaningful"), (None, ["denominator_nonpositive"], [], False, 0, "missing"), (None, [], [], True, 0, "missing"), (None, ["x", "denominator_missing"], [], True, 0, "missing"), (None, ["unsupported_x"], [], True, 0, "unsupported"), (None, ["x"], [], True, 0, "invalid"), (5.0, ["x"], [], True, 0, "invalid"), (5.0, ["extreme_margin"], [], True, 0, "valid"), (5.0, [], ["unsupported_p"], True, 0, "unsupported"), (5.0, [], ["unsupported_p", "late"], True, 0, "invalid"), (5.0, [], [], True, 99, "stale"), (5.0, ["x"], [], True, 99, "invalid")]
    frame = spark.createDataFrame(rows, "v double, r array<string>, p array<string>, precise boolean, age int, want string")
    got = frame.select(metrics.status(F.col("v"), F.col("r"), F.col("age"), 10, problems=F.col("p"), precise=F.col("precise")).alias("s"), "want").collect()
    assert [r.s for r in got] == [r.want for r in got]
    assert frame.limit(1).select(metrics.status(F.col("v"), F.col("r"), F.col("age"), 10, F.lit(None).cast("boolean")).alias("s")).first().s == "unsupported"


def test_months_of_a_range_are_bounded(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 15), D(2024, 3, 2)), (2, D(2000, 1, 1), D(2010, 1, 1)), (3, D(2024, 2, 1), D(2024, 1, 1)), (4, D(2014, 4, 1), D(2024, 3, 31))], "k int, start date, stop date")
    found = periods.monthly_windows(rows, ["k"]).collect()
    assert [(r.start, r.stop) for r in found if r.k == 1] == [(D(2024, 1, 15), D(2024, 1, 31)), (D(2024, 2, 1), D(2024, 2, 29)), (D(2024, 3, 1), D(2024, 3, 2))]
    assert [(r.k, r.start, r.reason) for r in found if r.k in (2, 3)] == [(2, None, "too_many_months"), (3, None, "ends_crossed")] and sum(r.k == 4 for r in found) == 120


def test_flags_of_whole_inventories(spark):
    """Duplicates are looked for in all forms; a partial answer and a filing without its period are flags."""
    base = [(k, "old", "10-K", 1, "x") for k in range(1, 6)]
    now = [*base, (1, "e", "8-K", 2, "x"), (1, "e", "8-K", 2, "x"), (2, "n", "8-K", 2, "x"), (3, "n", "10-K", 2, "x"), (4, "n", "10-K", 11, "x")]
    current = inventory(spark, now).withColumns({"complete": F.col("issuer") != 2, "described": ~F.col("issuer").isin(3, 4) | (F.col("accession") == "old")})
    nothing = inventory(spark, [(6, None, None, None, None)]).withColumns({"complete": F.lit(False), "described": F.lit(True)})
    got = {r.issuer: r.flags for r in changes.compared_inventories(inventory(spark, base), current.unionByName(nothing), ["issuer"], ["10-K", "10-K/A"]).collect()}
    assert got == {1: ["current_duplicate_accession"], 2: ["current_inventory_incomplete"], 3: ["current_filing_metadata_incomplete"], 4: [], 5: [], 6: ["current_inventory_incomplete"]}


def test_duplicates_and_documents(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), ("c", None)], "k string, v int")
    assert {r.k: (r.copies, r.v, r.reason) for r in selection.without_duplicates(rows, ["k"], ["v"]).collect()} == {"a": (2, 1, None), "b": (2, None, "conflicting_duplicates"), "c": (1, None, None)}
    refs = spark.createDataFrame([("x", D(2024, 1, 1), D(2024, 2, 1)), ("y", D(2024, 2, 1), D(2024, 3, 1)), ("z", D(2023, 1, 1), D(2023, 2, 1))], "name string, date_from date, date_to date")
    low, high = (F.lit(d).cast("date") for d in ("2024-02-01", "2024-02-02"))
    assert {r.name: r.state for r in changes.required_documents(refs, spark.createDataFrame([("y",), ("z",)], "name string"), ["name"], low, high).collect()} == {"x": "missing", "y": "held"}


def test_company_facts_by_type(spark):
    body = '{"facts":{"g":{"a/b":{"units":{"USD/shares":[{"start":"2024-01-01","end":"2024-03-31","val":1.10,"accn":"x","form":"10-Q","filed":"2024-05-01"},{"val":"5"},{"val":null},{"end":"2024-01-01"},{"val":"NaN"},{"val":12345678901234567890.5}]}}}}}'
    rows = spark.createDataFrame([(1, body), (2, '{"facts":{},"facts":{}}'), (3, "[]"), (4, None), (5, '{"facts":{}}')], "k int, body string")
    found = bodies.company_facts(rows, ["k"]).orderBy("k", "locator").collect()
    assert [(r.k, r.problem) for r in found if r.k > 1] == [(2, "body_malformed"), (3, "body_malformed"), (4, "body_malformed")]
    facts = [r for r in found if r.k == 1]
    assert [r.state for r in facts] == ["observed", "not_numeric", "null_value", "missing_field", "nonfinite", "observed"]
    assert facts[0].locator == "/facts/g/a~1b/units/USD~1shares/0" and facts[0].val == Decimal("1.1") and facts[5].val == Decimal("12345678901234567890.5") and facts[0].filed == "2024-05-01"


def test_numbers_of_facts_stay_as_they_were_written(spark):
    written = ["1.50", "1E+3", "-0.0", "1.2345678901", "1.23456789012345", "1" * 28, "9" * 41, "1E28", "1E-10", "1E-11", "12.3400000000000000E1", "0.00000000001E1", "1E99999999999"]
    body = '{"facts":{"g":{"t":{"units":{"USD":[' + ",".join(f'{{"val" : {w}, "note":"say \\"val\\":7"}}' for w in written) + ',{"val":"#1"},{"val":true}]}}}}}'
    rows = sorted(bodies.company_facts(spark.createDataFrame([(1, body)], "k int, body string"), ["k"]).collect(), key=lambda r: int(r.locator.rsplit("/", 1)[1]))
    assert [r.text for r in rows] == [*written, "#1", "true"]
    fits = [True, True, True, True, False, True, False, False, True, False, True, True, False]
    assert [r.state for r in rows] == ["observed" if f else "numeric_range_exceeded" for f in fits] + ["not_numeric"] * 2
    assert [r.val for r in rows if r.state == "observed"] == [Decimal(w) for w, f in zip(written, fits) if f]


def test_resolution_in_its_order(spark):
    good = ("covered", 1, False, 5, None, "t", "d", 3, None)
    cases = {
        "observed": [good], "gap": [("source_missing", 0, True, None, None, "t", "d", 1, None)], "none": [("covered", 0, True, 5, None, "t", "d", 1, None)], "many": [("covered", 2, True, 5, None, "t", "d", 1, None)], "torn": [("covered", 1, True, None, "json_null", "t", "d", 1, None)],
        "bad": [good, ("covered", 1, False, None, "json_null", "t", "d", 1, None)], "two": [good, ("covered", 1, False, 6, None, "t", "d", 1, None)], "tags": [good, ("covered", 1, False, 5, None, "u", "d", 1, None)], "meta": [good, ("covered", 1, False, 5, None, "t", "e", 1, None)],
        "chosen": [("covered", 1, False, 5, None, "t", "d", 3, "t"), ("covered", 1, False, 5, None, "u", "e", 1, "t")], "first": [good, ("covered", 1, False, 5, None, "t", "d", 1, None)],
    }
    rows = [(k, *r) for k, many in cases.items() for r in many]
    frame = spark.createDataFrame(rows, "k string, coverage string, rules int, conflict boolean, value int, bad string, tag string, detail string, place int, preferred string")
    got = {r.k: (r.state, r.reason, r.value) for r in bodies.resolution(frame, ["k"]).collect()}
    assert got == {
        "observed": ("observed", None, 5), "gap": ("missing", "source_missing", None), "none": ("unsupported_scope", "no_reviewed_complete_scope_tag", None), "many": ("ambiguous", "conflicting_mapping_rules", None), "torn": ("ambiguous", "filing_metadata_conflict", None), "bad": ("missing", "json_null", None),
        "two": ("ambiguous", "conflicting_reviewed_observations", None), "tags": ("ambiguous", "equivalent_tags_without_reviewed_preference", None), "meta": ("ambiguous", "same_value_different_source_metadata", None), "chosen": ("observed", None, 5), "first": ("observed", None, 5),
    }


def test_year_to_date_of_another_edition_gives_no_amount(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 3, 31), 1, 10, "a"), (1, D(2024, 1, 1), D(2024, 6, 30), 2, 25, "b"), (1, D(2024, 1, 1), D(2024, 9, 30), 3, 45, "b")], "k int, start date, end date, quarters int, v int, edition string")
    got = {r.end.month: r.v for r in periods.quarter_from_year_to_date(rows, ["k"], "v", ("edition",)).collect()}
    assert got == {3: 10, 6: None, 9: 20}


def test_inventory_problems(spark):
    rows = spark.createDataFrame([(1, "a", D(2024, 1, 1), 1), (1, "a", D(2024, 1, 1), 1), (2, "b", D(2023, 1, 1), 1), (3, "c", D(2024, 1, 1), 1), (4, "c", D(2024, 1, 1), 2)], "d int, accession string, filed date, content int")
    said = spark.createDataFrame([(d, n, D(2024, 1, 1), D(2024, 12, 31)) for d, n in ((1, 2), (2, 2), (3, 1), (4, 1), (5, 0))], "d int, advertised int, date_from date, date_to date")
    got = {r.d: r.reasons for r in changes.inventory_problems(rows, ["d"], said).collect()}
    assert got == {1: ["duplicate_accession"], 2: ["filing_outside_bounds", "inventory_count_mismatch"], 3: ["conflicting_filing_metadata"], 4: ["conflicting_filing_metadata"], 5: []}


def test_a_multiple_needs_a_denominator_beyond_its_error_and_good_evidence(spark):
    rows = spark.createDataFrame([(Decimal(100), Decimal(5), Decimal(1), None), (Decimal(100), Decimal(5), Decimal(5), None), (Decimal(100), Decimal(5), None, ["unsupported_currency"])], "cap decimal(18,2), income decimal(18,2), income_error decimal(18,2), cap_issues array<string>")
    assert [(r.value, r.reasons) for r in metrics.metric(rows, "price_earnings").collect()] == [(20.0, []), (None, ["denominator_within_error"]), (None, ["unsupported_currency"])]


def test_a_request_with_too_many_dates_is_refused(spark, monkeypatch):
    monkeypatch.setattr(scalar, "MOST_ASKED", 2)
    dates = spark.createDataFrame([(D(2024, 1, k),) for k in (1, 2, 3, 3)], "as_of date")
    assert scalar.asked_for(dates.limit(2), "as_of", "x").first().x == [D(2024, 1, 1), D(2024, 1, 2)]
    with pytest.raises(Exception, match="a request may ask for 2"):
        scalar.asked_for(dates, "as_of", "x").collect()


def snapshots(spark, rows, **columns):
    """Companies of one sector: (issuer, cap, income, revenue, prior revenue, prior cap)."""
    schema = "issuer int, cap decimal(18,2), income decimal(18,2), revenue decimal(18,2), prior_revenue decimal(18,2), prior_cap decimal(18,2)"
    df = spark.createDataFrame([(r[0], *[None if v is None else Decimal(v) for v in r[1:]]) for r in rows], schema).withColumns({"sector": F.lit(1), "period_end": F.lit("2025-12-31").cast("date"), "cap_issues": F.lit(None).cast("array<string>")})
    return df.withColumns(columns)


def test_equal_snapshots_of_an_issuer_count_once_and_conflicting_ones_not_at_all(spark):
    rows = [(1, 100, 10, 5, 4, 90), (1, 100, 10, 5, 4, 90), (2, 100, 10, 5, 4, 90), (3, 100, 10, 5, 4, 90), (4, 100, 10, 5, 4, 90)]
    r = values(snapshots(spark, rows), "price_earnings")
    assert (r.n, r.k, r.v, r.total, r.cap_coverage, r.comparable) == (4, 4, 4, 10.0, 1.0, True)
    r = values(snapshots(spark, [*rows, (2, 100, 11, 5, 4, 90)]), "price_earnings")
    assert (r.n, r.k, r.v, r.total) == (4, 3, 3, 10.0) and r.cap_coverage is None and not r.comparable and "full_capitalization_unknown" in r.flags
    why = sectors.assessed(sectors.one_snapshot(snapshots(spark, [*rows, (2, 100, 11, 5, 4, 90)]), ["sector", "issuer"]), sectors.METRICS["price_earnings"]).filter("issuer = 2").first().m
    assert why.reasons == ["conflicting_issuer_snapshots"] and not why.complete
    one = sectors.sector_values(snapshots(spark, rows), ["sector"], {"revenue_growth": sectors.METRICS["revenue_growth"]}).first()
    assert (one.n, one.total) == (4, 0.25)


def test_a_cap_with_issues_is_unknown_everywhere(spark):
    rows = [(k, 100, 10, 5, 4, 90) for k in range(1, 6)]
    doubted = snapshots(spark, rows, cap_issues=F.when(F.col("issuer") == 5, F.array(F.lit("unsupported_currency"))))
    r = values(doubted, "operating_margin" if "operating_income" in doubted.columns else "net_margin")
    assert (r.n, r.k, r.total) == (5, 5, 2.0) and r.full_cap is None and r.cap_coverage is None and not r.comparable
    assert sectors.top_by_cap(doubted, ["sector"]).count() == 0
    c = sectors.concentration(doubted, ["sector"]).first()
    assert c.top_share is None and c.growth == 0.25


def test_concentration_needs_a_whole_universe(spark):
    rows = [(k, 100 + k, 10, 5, 4, 90 + k) for k in range(1, 8)]
    whole = sectors.concentration(snapshots(spark, rows), ["sector"]).first()
    assert whole.top_share == pytest.approx(525 / 728) and whole.growth == 0.25 and whole.growth_without_top == 0.25
    part = sectors.concentration(snapshots(spark, rows, roster_complete=F.col("issuer") != 3), ["sector"]).first()
    assert (part.top_share, part.growth, part.growth_without_top) == (None, None, None)
    torn = sectors.concentration(snapshots(spark, [*rows, (3, 1, 1, 1, 1, 1)]), ["sector"]).first()
    assert (torn.top_share, torn.growth, torn.growth_without_top) == (None, None, None)
    unknown = sectors.concentration(snapshots(spark, [*rows, (9, 100, 10, 5, 4, None)]), ["sector"]).first()
    assert unknown.top_share is not None and unknown.growth == 0.25 and unknown.growth_without_top is None


def test_profiles_and_periods_of_inputs(spark):
    rows = snapshots(spark, [(k, 100, 10, 5, 4, 90) for k in (1, 2)], applicable=F.when(F.col("issuer") == 1, F.array(F.lit("price_earnings"))).otherwise(F.array(F.lit("net_margin"))), income_period=F.lit("2025"), revenue_period=F.when(F.col("issuer") == 1, "2024").otherwise("2025"))
    got = {m: {r.issuer: r.m.reasons for r in sectors.assessed(rows, sectors.METRICS[m], m).withColumn("m", F.col(m)).collect()} for m in ("price_earnings", "net_margin")}
    assert got == {"price_earnings": {1: [], 2: ["unsupported_profile"]}, "net_margin": {1: ["incompatible_periods", "unsupported_profile"], 2: []}}


def test_display_of_a_denominator_that_cannot_be_told_from_zero(spark):
    codes = F.array(F.lit("company_denominator_indistinguishable_from_zero"))
    assert spark.range(1).select(sectors.display_status(F.lit(None), codes, F.lit(True)).alias("x")).first().x == "not_meaningful"


def test_coverage_goes_by_the_applicability_roster(spark):
    roster = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", True), (1, "d", False), (2, "a", True), (2, "b", None), (3, "a", False)], "k int, metric string, applicable boolean")
    done = spark.createDataFrame([(1, "a", "valid"), (1, "b", "not_meaningful"), (1, "d", "valid"), (2, "a", "valid"), (3, "a", "valid")], "k int, metric string, status string")
    got = {r.k: (r.members, r.valid, r.not_meaningful, r.missing, r.unsupported, r.inapplicable, r.applicable, r.unreviewed, r.covered) for r in inputs.status_counts(done, roster, ["k"], ["metric"]).collect()}
    assert got == {1: (4, 1, 1, 1, 0, 1, 3, 0, pytest.approx(2 / 3)), 2: (2, 1, 0, 0, 1, 0, 1, 1, None), 3: (1, 0, 0, 0, 0, 1, 0, 0, None)}


def test_exclusions_of_a_band_by_date(spark):
    days = {1: "2020-03-31", 2: "2023-06-30", 3: "2023-06-30", 4: "2023-09-30", 5: "2023-09-30", 6: "2023-08-15", 7: "2024-03-31", 8: "2024-03-31", 9: "2024-06-30", 10: "2020-12-31"}
    values = {1: "1", 2: "1", 3: "2", 4: "3", 5: "3", 6: "4", 7: "1E2000", 8: None, 9: "x", 10: "5"}
    rows = spark.createDataFrame([("a", i, values[i]) for i in days], "k string, point_id int, value string").withColumn("quarter_end", F.create_map(*[F.lit(x) for p in days.items() for x in p])[F.col("point_id")].cast("date"))
    points = history.sampled(rows, ["k"])
    own = {r.point_id: r.reasons for r in points.collect()}
    assert own[7] == ["conflicting_quarter", "numeric_range_exceeded"] and own[8] == ["conflicting_quarter", "missing_value"] and own[9] == ["invalid_value_type"] and own[1] == own[4] == own[10] == []
    dates = spark.createDataFrame([("a", "2023-12-31"), ("a", "2024-12-31"), ("b", "2024-12-31"), ("a", "2023-12-31")], "k string, d string").select("k", F.col("d").cast("date").alias("as_of"))
    got = {(str(r.as_of), r.reason): r.points for r in history.exclusions(points, dates, ["k"], 3).collect()}
    assert got == {
        ("2023-12-31", "outside_window"): 2, ("2023-12-31", "after_as_of"): 3, ("2023-12-31", "conflicting_quarter"): 2, ("2023-12-31", "duplicate_sample"): 1, ("2023-12-31", "not_quarter_end"): 1, ("2023-12-31", "numeric_range_exceeded"): 1, ("2023-12-31", "missing_value"): 1, ("2023-12-31", "invalid_value_type"): 1,
        ("2024-12-31", "outside_window"): 2, ("2024-12-31", "conflicting_quarter"): 4, ("2024-12-31", "duplicate_sample"): 1, ("2024-12-31", "not_quarter_end"): 1, ("2024-12-31", "numeric_range_exceeded"): 1, ("2024-12-31", "missing_value"): 1, ("2024-12-31", "invalid_value_type"): 1,
    }
    assert history.bands(points, dates, ["k"], 3, 1).filter("k = 'a' and as_of = '2023-12-31'").first().samples == 1


def test_anchor_reasons(spark):
    year, valued = ("2023-01-01", "2023-12-31"), "2024-02-15 01:00:00"
    cases = [
        ("2024-02-14", year, year, 10.0, 0.5, []), ("2024-02-15", year, year, 10.0, 0.5, ["anchor_intraday_publication_unproven"]), (None, year, year, 10.0, 0.5, ["anchor_intraday_publication_unproven"]),
        ("2024-02-14", ("2023-04-01", "2023-12-31"), ("2023-04-01", "2023-12-31"), 10.0, 0.5, ["unsupported_anchor_calendar"]), ("2024-02-14", ("2022-07-01", "2023-06-30"), year, 10.0, 0.5, ["unsupported_anchor_calendar"]),
        ("2024-02-14", ("2023-01-02", "2024-01-01"), ("2023-01-02", "2024-01-01"), 10.0, 0.5, ["unsupported_anchor_calendar"]), ("2024-02-14", (None, "2023-12-31"), year, 10.0, 0.5, ["unsupported_anchor_calendar"]),
        ("2024-02-14", year, year, 10.0, None, ["anchor_precision_unknown"]), ("2024-02-14", year, year, 10.0, 10.0, ["anchor_not_distinguishable_from_zero"]), ("2024-02-14", year, year, None, None, ["anchor_precision_unknown"]),
    ]
    rows = spark.createDataFrame([(i, f, *p, *a, v, e) for i, (f, p, a, v, e, _) in enumerate(cases)], "i int, filed string, s string, e string, ws string, we string, value double, error double")
    day = lambda c, n: F.col(c).cast("date").alias(n)
    codes = valuation.anchor_reasons(F.array().cast("array<string>"), F.col("filed").cast("date"), F.lit(valued).cast("timestamp"), F.struct(day("s", "start"), day("e", "end")), F.struct(day("ws", "start"), day("we", "end")), F.col("value"), F.col("error"))
    assert [r.c for r in rows.select("i", codes.alias("c")).orderBy("i").collect()] == [c[-1] for c in cases]


def test_amounts_assembled_from_sources(spark):
    long = "1" + "0" * 50
    rows = [
        ("a", long, "0.5", 1, [], ["revised_view"]), ("a", "1", "0.25", -1, [], []), ("b", "-3", "1", -1, [], []), ("b", "2", None, 1, [], []), ("c", "1", "1", 1, ["p"], ["f"]), ("c", "2", "1", 1, None, None),
        ("d", None, "1", 1, [], []), ("e", "1E3000", "1", 1, [], []), (None, "4", "0", 1, [], []), (None, "+5", "0", -1, [], []),
    ]
    got = {r.k: (r.value, r.error, r.flags) for r in periods.assembled(spark.createDataFrame(rows, "k string, value string, error string, coefficient int, problems array<string>, flags array<string>"), ["k"]).collect()}
    assert got == {
        "a": ("9" * 50, "0.75", ["revised_view"]), "b": ("5", None, []), "c": (None, None, ["f", "p"]), "d": (None, None, ["source_value_missing"]), "e": (None, None, ["unsupported_numeric_range"]), None: ("-1", "0", []),
    }
    capex = spark.createDataFrame([("x", "capital_expenditures_ppe", "-1", "2"), ("y", "revenue", "-1", "2"), ("z", "capital_expenditures_ppe", "1", "1E2000")], "k string, concept string, value string, error string").selectExpr("*", "1 as coefficient", "array() as problems", "array() as flags").withColumns({c: F.col(c).cast("array<string>") for c in ("problems", "flags")})
    assert {r.k: (r.value, r.error, r.flags) for r in periods.assembled(capex, ["k"]).collect()} == {"x": (None, "2", ["negative_cash_ppe_capex"]), "y": ("-1", "2", []), "z": (None, None, ["unsupported_numeric_range"])}


def test_annual_amounts_and_inventories_at_a_cutoff(spark):
    rows = spark.sql("select cast(s as date) period_start, cast(e as date) period_end, 1.5 as value, cast(null as array<string>) as problems from values ('2023-01-01', '2023-12-31'), ('2023-01-01', '2023-09-30'), (null, '2023-12-31') as t(s, e)")
    assert sorted((str(r.period_start), r.value is not None, r.problems) for r in periods.annual_amounts(rows).collect()) == [("2023-01-01", False, ["unsupported_annual_period"]), ("2023-01-01", True, []), ("None", False, ["unsupported_annual_period"])]
    at = dt.datetime(2024, 1, 1)
    filings = spark.createDataFrame([(1, "10-K", at, "verified_timezone"), (2, "10-K", at, None), (3, "10-K", None, "verified_timezone"), (4, "10-K", dt.datetime(2024, 1, 2), "verified_timezone"), (5, "8-K", at, "verified_timezone"), (6, None, at, "verified_timezone")], "i int, form string, acceptance_at timestamp, acceptance_time_basis string")
    assert {r.i: r.state for r in changes.at_cutoff(filings, ["10-K"], F.lit(at)).collect()} == {1: "selected", 2: "acceptance_unverified", 3: "acceptance_unverified", 4: "excluded_after_cutoff"}


def test_coherence_copies_no_row_for_each_column(spark):
    rows = [("a", "x", "f", 1, "s", "USD"), ("a", None, "f", 2, "t", "EUR"), ("b", "x", "f", 1, "s", "USD"), ("b", "y", "g", 1, "s", None), ("c", None, "f", 1, None, "USD"), ("c", None, "g", 2, "s", "EUR")]
    found = selection.statement_coherence(spark.createDataFrame(rows, "k string, basis string, family string, edition int, scope string, currency string"), ["k"])
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: r.flags for r in found.collect()} == {"a": [], "b": ["incompatible_reporting_basis"], "c": ["incompatible_statement_currencies", "mixed_statement_editions"]}

"""The certified root search against hand-computed cases, and its claims against exact arithmetic."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitspark.operators import roots, valuation

ROW = {"revenue": 100.0, "wacc": 0.1, "risk_free": 0.04, "terminal_growth": 0.02, "terminal_margin": 0.2, "terminal_tax": 0.25, "terminal_roic": 0.08, "target": 193.4375}
FADE = {"weights": [1.0] * 5, "anchor_margin": 0.2}
EXACT = roots.Bounds(absolute=1e-3, relative=0.0, width=1e-9)


def row(years=5, **other):
    return ROW | {"growth": [0.1] * years, "margins": [0.2] * years, "taxes": [0.25] * years, "reinvestment": [0.05] * years, "k": 1} | other


def solved(spark, low, high, variable=roots.GROWTH, bounds=roots.Bounds(), **other):
    return valuation.reverse_solve(spark.createDataFrame([row(**other)]), variable, low, high, bounds).first()


@pytest.mark.parametrize(("variable", "want", "low", "high"), [(roots.GROWTH, 0.1, -0.513, 0.507), (roots.GROWTH, 0.1, -0.3, 0.5), (roots.GROWTH, 0.1, 0.0, 0.2), (roots.REINVESTMENT, 0.05, -0.21, 0.433), (roots.MARGIN, 0.2, 0.013, 0.907)])
def test_each_variable_meets_the_target(spark, variable, want, low, high):
    r = solved(spark, low, high, variable, **FADE)
    assert r.state == "converged" and r.solution == pytest.approx(want, abs=1e-8) and not r.unresolved
    (found,) = r.roots
    assert found.low <= r.solution <= found.high and found.high - found.low <= 1e-9


def test_a_faded_margin_has_a_linear_solution(spark):
    r = solved(spark, 0.1, 0.4, roots.MARGIN, weights=[0.0, 0.25, 0.5, 0.75, 1.0], anchor_margin=0.1)
    assert r.state == "converged" and r.solution == pytest.approx(213 / 965, abs=1e-8)  # the value is 904.6875 m - 6.25


def test_a_fade_through_zero_has_its_kinks_cut_out(spark):
    r = solved(spark, 0.05, 0.9, roots.MARGIN, weights=[0.3, 0.4, 0.5, 0.7, 1.0], anchor_margin=-0.2)
    again = valuation.forward(valuation.with_parameter(spark.createDataFrame([row(weights=[0.3, 0.4, 0.5, 0.7, 1.0], anchor_margin=-0.2)]), roots.MARGIN, F.lit(r.solution))).first()
    assert r.state == "converged" and again.ev == pytest.approx(193.4375, abs=1e-5) and r.subdivisions > 0


def test_no_solution_is_proven(spark):
    r = solved(spark, 0.0, 0.1, roots.REINVESTMENT, target=1000.0)
    assert r.state == "no_solution" and r.solution is None and not r.roots and not r.unresolved


def square(target):
    """A value of growth ** 2 - 1."""
    return {"margins": [-0.022, 0.0121, 0.0, 0.0, -1.0], "taxes": [0.0] * 5, "reinvestment": [0.0] * 5, "terminal_margin": 0.1, "terminal_tax": 0.0, "terminal_growth": 0.0, "target": target}


@pytest.mark.parametrize(("above", "state"), [(1e-4, "non_unique"), (1e-5, "non_unique"), (1e-6, "non_unique"), (-1e-6, "no_solution"), (0.0, "inconclusive")])
def test_two_near_roots_are_never_no_solution(spark, above, state):
    r = solved(spark, -0.5, 0.5, bounds=roots.Bounds(absolute=1e-9), **square(-1.0 + above))
    assert r.state == state
    if state == "non_unique":
        assert [(x.low + x.high) / 2 for x in r.roots] == pytest.approx([-(above**0.5), above**0.5], abs=1e-8)
    if state == "inconclusive":
        assert any(x.low <= 0.0 <= x.high for x in r.unresolved)


def test_a_value_that_is_the_target_everywhere_is_inconclusive(spark):
    flat = square(0.0) | {"margins": [0.0] * 5, "terminal_margin": 0.0}
    r = solved(spark, -0.5, 0.5, bounds=roots.Bounds(evaluations=100), **flat)
    assert r.state == "inconclusive" and (r.unresolved[0].low, r.unresolved[-1].high) == (-0.5, 0.5) and r.evaluations <= 100


def test_a_root_at_an_end_is_inconclusive(spark):
    r = solved(spark, 0.1, 0.2)
    assert r.state == "inconclusive" and r.solution is None and r.unresolved


@pytest.mark.parametrize("bounds", [roots.Bounds(evaluations=1), roots.Bounds(evaluations=20, absolute=1e-40, relative=0.0, width=1.0), roots.Bounds(evaluations=20, absolute=1e9, width=1e-40)])
def test_a_spent_budget_has_no_headline(spark, bounds):
    r = solved(spark, 0.0, 0.2, bounds=bounds)
    assert r.state == "inconclusive" and r.solution is None and r.unresolved and r.evaluations <= bounds.evaluations


def test_missing_and_mixed_inputs_are_rows_of_their_own(spark):
    rows = [row(k=1), row(k=2, target=None), row(3, k=3, target=173.4375), row(k=4, growth=None), row(k=5, growth=[0.1] * 3), row(k=6, margins=[0.2, None, 0.2, 0.2, 0.2])]
    schema = "k int, revenue double, wacc double, risk_free double, terminal_growth double, terminal_margin double, terminal_tax double, terminal_roic double, target double, growth array<double>, margins array<double>, taxes array<double>, reinvestment array<double>"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = {r.k: (r.state, r.solution) for r in valuation.reverse_solve(df, roots.GROWTH, -0.3, 0.5).collect()}
    assert {k: s for k, (s, _) in got.items()} == {1: "converged", 2: "no_input", 3: "converged", 4: "no_input", 5: "no_input", 6: "no_input"}
    assert got[1][1] == pytest.approx(0.1) and got[3][1] == pytest.approx(0.1)
    assert valuation.reverse_solve(df.limit(0), roots.GROWTH, -0.3, 0.5).count() == 0
    with pytest.raises(ValueError):
        roots.solver("margins", 0.0, 1.0)


def exact_value(r, variable, x):
    """The value less the target in fractions."""
    f = lambda v: Fraction(float(v))
    revenue, total, discount = f(r["revenue"]), Fraction(0), Fraction(1)
    for k in range(len(r["growth"])):
        revenue *= 1 + (x if variable == roots.GROWTH else f(r["growth"][k]))
        margin = (1 - f(r["weights"][k])) * f(r["anchor_margin"]) + f(r["weights"][k]) * x if variable == roots.MARGIN else f(r["margins"][k])
        profit = revenue * margin
        discount *= 1 + f(r["wacc"])
        total += (profit - max(profit, 0) * f(r["taxes"][k]) - revenue * (x if variable == roots.REINVESTMENT else f(r["reinvestment"][k]))) / discount
    last = revenue * (1 + f(r["terminal_growth"])) * (x if variable == roots.MARGIN else f(r["terminal_margin"])) * (1 - f(r["terminal_tax"]))
    return total + last * (1 - f(r["terminal_growth"]) / f(r["terminal_roic"])) / (f(r["wacc"]) - f(r["terminal_growth"])) / discount - f(r["target"])


@pytest.mark.parametrize("variable", roots.VARIABLES)
def test_enclosures_hold_the_exact_value(variable):
    rng = random.Random(3)
    for _ in range(30):
        many = [rng.uniform(-0.4, 0.5) for _ in range(16)]
        r = row(4, growth=many[:4], margins=many[4:8], reinvestment=many[8:12], taxes=[0.25] * 4, weights=[0.2, 0.5, 0.8, 1.0], anchor_margin=many[12], target=rng.uniform(-50, 300))
        rows = {k: np.array([v], float) for k, v in r.items()}
        low = rng.uniform(-0.4, 0.4)
        ends = np.array([low]), np.array([low + 0.05])
        powers = roots.polynomials(rows, variable, np.array([0]), *ends)
        value, slope = roots.enclosed([roots.Span(np.broadcast_to(p.low, 1), np.broadcast_to(p.high, 1)) for p in powers], *ends)
        points = [Fraction(low) + Fraction(k, 200) for k in range(10)]
        exact = [exact_value(r, variable, x) for x in points]
        assert all(Fraction(value.low[0]) <= v <= Fraction(value.high[0]) for v in exact)
        assert all(Fraction(slope.low[0]) <= (b - a) * 200 <= Fraction(slope.high[0]) for a, b in zip(exact, exact[1:]))


def test_scenarios_are_valued_again_at_the_solution(spark):
    rows = spark.createDataFrame([row(shares=10.0)])
    r = valuation.scenario_results(rows, roots.GROWTH, -0.513, 0.507).first()
    assert r.state == "converged" and r.per_share == pytest.approx(19.34375, abs=1e-6)
    assert valuation.scenario_results(rows.withColumn("target", F.lit(1e12)), roots.GROWTH, -0.5, 0.5).first().per_share is None


def test_solutions_are_as_exact_as_doubles(spark):
    found = [solved(spark, low, high, variable, **FADE) for variable, low, high in ((roots.GROWTH, -0.513, 0.507), (roots.REINVESTMENT, -0.21, 0.433), (roots.MARGIN, 0.013, 0.907))]
    assert [r.solution for r in found] == pytest.approx([0.1, 0.05, 0.2], abs=1e-13)
    assert all(x.low <= r.solution <= x.high and r.evaluations < 40 for r in found for x in r.roots)
    many = spark.range(1, 2000).selectExpr("*", "1e6 + id * 1234.56789 as target").crossJoin(spark.createDataFrame([row(shares=1.0, revenue=1e6, **FADE)]).drop("target"))
    again = valuation.scenario_results(many, roots.MARGIN, 0.01, 1.0).filter("state = 'converged'")
    assert again.count() > 1000 and again.filter("abs(ev - target) > 1e-8").count() == 0


def test_cells_are_solved_one_by_one(spark):
    rows = spark.createDataFrame([row(**FADE)]).withColumn("shares", F.lit(1.0))
    cells = valuation.sensitivity(rows, ("growth", [0.05, 0.1]), ("wacc", [0.1, 0.12]), (roots.MARGIN, 0.01, 1.0)).collect()
    assert len(cells) == 4 and {(c.x, c.y) for c in cells} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all(c.state == "converged" and c.ev == pytest.approx(193.4375, abs=1e-5) for c in cells)
    assert next(c for c in cells if (c.x, c.y) == (1, 0)).solution == pytest.approx(0.2, abs=1e-8)


def test_a_batch_is_solved_from_columns_to_columns():
    """No row becomes a Python object: parts of a batch, lists of several lengths and nulls keep their places."""
    many = [row(**FADE), row(target=None, **FADE), row(3, target=173.4375, weights=[1.0] * 3, anchor_margin=0.2), row(growth=None, **FADE), row(**FADE | {"weights": [1.0, None, 1.0, 1.0, 1.0]}), row(**square(-1.0 + 1e-4), **FADE), row(target=1e9, **FADE), row(**square(-1.0), **FADE), row(**FADE | {"taxes": []})]
    kinds = {k: pa.list_(pa.float64()) if isinstance(v, list) else pa.float64() for k, v in many[0].items()}
    batch = pa.StructArray.from_arrays([pa.array([r[k] for r in many], t) for k, t in kinds.items()], list(kinds))
    got = roots.solve_batch(batch, roots.GROWTH, -0.5, 0.5)
    assert [r["state"] for r in got.to_pylist()] == ["converged", "no_input", "converged", "no_input", "converged", "non_unique", "no_solution", "inconclusive", "no_input"]
    for r in got.to_pylist():
        assert (r["solution"] is not None) == (r["state"] == "converged")
        assert all((r[k] is None) == (r["state"] == "no_input") for k in ("roots", "unresolved", "evaluations", "subdivisions"))
        assert r["state"] == "no_input" or (len(r["roots"]), bool(r["unresolved"])) == {"converged": (1, False), "non_unique": (2, False), "no_solution": (0, False), "inconclusive": (0, True)}[r["state"]]
    assert roots.solve_batch(batch, roots.MARGIN, 0.01, 1.0)[4].as_py()["state"] == "no_input"
    assert roots.solve_batch(batch.slice(2, 5), roots.GROWTH, -0.5, 0.5).equals(got.slice(2, 5))
    assert len(roots.solve_batch(batch.slice(0, 0), roots.GROWTH, -0.5, 0.5)) == 0


def test_neighbouring_open_domains_are_one():
    rows = {k: np.array([v, v], float) for k, v in row().items()}
    search = roots.Search(rows, roots.GROWTH, -0.3, 0.5, roots.Bounds())
    search.give_up(np.array([1, 0, 1]), np.array([0.25, 0.1, 0.0]), np.array([0.5, 0.2, 0.25]))
    search.give_up(np.array([0, 1]), np.array([0.0, 0.75]), np.array([0.05, 0.8]))
    assert [c.tolist() for c in search.unresolved()] == [[0, 0, 1, 1], [0.0, 0.1, 0.0, 0.75], [0.05, 0.2, 0.5, 0.8]]


def test_a_known_horizon_values_as_the_fold_does(spark):
    rows = spark.createDataFrame([row(k=1), row(k=2, revenue=-3.7), row(k=3, margins=[0.3, -0.4, 0.1, 0.0, 0.2]), row(4, k=4)])
    whole = {r.k: (r.ev, r.explicit_pv, r.terminal_pv, r.terminal_share, r.dominant) for r in valuation.forward(rows).collect()}
    known = {r.k: (r.ev, r.explicit_pv, r.terminal_pv, r.terminal_share, r.dominant) for r in valuation.forward(rows, 5).collect()}
    assert whole[1][0] == pytest.approx(193.4375) and whole[4][0] is not None
    assert known == whole | {4: (None,) * 5}

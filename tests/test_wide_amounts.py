"""Amounts beyond 38 digits against Python's own decimals."""

from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitspark.functions import scalar, wide


def states(spark, *texts):
    return [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", wide.state(F.col("t")).alias("s")).orderBy("i").collect()]


def test_states_by_digits_exponent_and_magnitude(spark):
    cases = {
        None: "missing", "": "not_numeric", ".": "not_numeric", "-": "not_numeric", "1e": "not_numeric", "E5": "not_numeric", "NaN": "not_numeric", "1 2": "not_numeric", "0": "observed", "-.5": "observed", "+7.": "observed", "00012": "observed",
        "9" * 1000: "observed", "9" * 1001: "numeric_range_exceeded", "0" * 2000 + "1": "observed", "1E1000": "observed", "1E1001": "numeric_range_exceeded", "1E-1000": "observed", "1E-1001": "numeric_range_exceeded",
        "12E1000": "numeric_range_exceeded", "0." + "0" * 999 + "1": "observed", "0." + "0" * 1000 + "1": "numeric_range_exceeded", "1E99999999999999999999": "numeric_range_exceeded",
    }
    assert dict(zip(cases, states(spark, *cases), strict=True)) == cases


def exact(texts):
    with localcontext(Context(prec=5000)):
        return sum((Decimal(t) for t in texts), Decimal(0))


AMOUNT = st.builds(lambda s, d, p, e: f"{s}{d[:p]}{'.' + d[p:] if p < len(d) else ''}{e}", st.sampled_from(["", "-", "+"]), st.text("0123456789", min_size=1, max_size=90), st.integers(0, 90), st.sampled_from(["", "E0", "E-7", "e+31", "E-300", "E299"]))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(AMOUNT, max_size=8), min_size=1, max_size=12))
def test_totals_are_exact(spark, groups):
    rows = [(g, t) for g, texts in enumerate(groups) for t in texts]
    got = {r.g: r for r in wide.exact_totals(spark.createDataFrame(rows, "g int, t string"), ["g"], ["t"]).collect()}
    for g, texts in enumerate(groups):
        assert (g in got) == bool(texts)
        if texts:
            assert got[g].t_observed == len(texts) and Decimal(got[g].t_total) == exact(texts)


def test_plain_text_and_counts_by_state(spark):
    rows = [("a", "1E-3"), ("a", "0.50"), ("a", None), ("a", "x"), ("a", "1E4000"), ("b", None), (None, "-1E40"), (None, "1E40"), ("c", "-1"), ("c", "1E-50")]
    got = {r[0]: tuple(r)[1:] for r in wide.exact_totals(spark.createDataFrame(rows, "amount string, place string"), ["amount"], ["place"]).collect()}
    assert got == {"a": ("0.501", 2, 1, 1, 1), "b": (None, 0, 1, 0, 0), None: ("0", 2, 0, 0, 0), "c": ("-0." + "9" * 50, 2, 0, 0, 0)}


@pytest.mark.parametrize("a, b", [("1", "3"), ("-2", "3"), ("1" + "0" * 60, "7E-20"), ("5E-400", "3E300"), ("0", "9"), ("12345678901234567890123456789012345678901234567890123", "1.5")])
def test_quotients_at_fifty_digits(spark, a, b):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(wide.quotient("a", "b").alias("q")).first().q
    assert not got.exceeded and Decimal(got.value) == Context(prec=50, rounding=ROUND_HALF_EVEN, Emin=-999, Emax=999).divide(Decimal(a), Decimal(b))


def test_ratio_keeps_sign_and_says_what_does_not_fit(spark):
    rows = [
        ("sign", "1E30", "2"), ("sign", "-1E30", "2"), ("sign", "-1E-400", "1"), ("zero", "5", "0"), ("minus", "5", "-1"), ("none", None, "1"), ("none", "1", None),
        ("over", "1E5000", "1"), ("over", "4", "8"), ("far", "1E900", "1E-900"), ("half", "1", "4"), ("half", "2", None),
    ]
    got = {r.g: r for r in wide.exact_ratio(spark.createDataFrame(rows, "g string, n string, d string"), ["g"], "n", "d").collect()}
    assert (got["sign"].sign, got["sign"].ratio, got["sign"].v) == (-1, 0.0, 3) and Decimal(got["sign"].ratio_text) == Decimal("-2E-401")
    assert got["zero"].reasons == got["minus"].reasons == ["denominator_nonpositive"] and got["none"].reasons == ["no_contributors"]
    assert (got["over"].ratio, got["over"].exceeded, got["over"].reasons) == (0.5, 1, ["numeric_range_exceeded"])
    assert (got["far"].ratio_text, got["far"].reasons) == (None, ["numeric_range_exceeded"]) and (got["half"].ratio_text, got["half"].v, got["half"].reasons) == ("0.25", 1, [])
    assert wide.exact_ratio(spark.createDataFrame([], "g string, n string, d string"), ["g"], "n", "d").count() == 0


def test_scaled_text_moves_digits_beyond_the_decimals(spark):
    row = spark.range(1).select(scalar.scaled_text(F.lit("1,234.5"), F.lit(60), F.lit("-"), F.lit("num-dot-decimal")).alias("t")).first()
    assert Decimal(row.t) == Decimal("-1234.5E60") and states(spark, row.t) == ["observed"]


def test_tasks_read_amounts_as_columns_do_and_hand_on_sums(spark):
    """Rows of one key leave a task as a row a state and place, however many they are."""
    texts = [None, "", ".", "-.5", "+7.", "12\n", "1 2", "1e", "1E1000", "1E1001", "12E1000", "-1E-1000", "1E-1001", "1E+0000000000000000012", "1E-99999999999999999999", "0" * 5000 + "3", "9" * 1001, "\u0661"]
    assert [wide.read_amount(t)[0] for t in texts] == states(spark, *texts)
    schema = pa.schema([("_0", pa.int64()), ("amount", pa.int32()), ("state", pa.string()), ("place", pa.int32()), ("value", pa.int64())])
    batches = [pa.RecordBatch.from_pydict({"k": [1, 2] * 5000, "a": ["1E-18", "12345678901234567890E-3"] * 5000}) for _ in range(3)]
    told = [r for b in wide._summed(1, False, schema)(iter(batches)) for r in b.to_pylist()]
    assert len(told) < 15 and sum(r["value"] for r in told if r["state"] == "observed") == 30000
    keys = spark.createDataFrame([([1, 2], "1"), ([1, 2], "2"), ([1, None], "5"), (None, "7")], "k array<int>, t string")
    assert {tuple(r.k or ()): r.t_total for r in wide.exact_totals(keys, ["k"], ["t"]).collect()} == {(1, 2): "3", (1, None): "5", (): "7"}

"""Exact amounts of any length: decimals beyond Spark's 38 digits as sums of limbs.

An amount is text as it was written. It is cut into limbs of six decimal digits, each with its place (limb p
counts 10^(6p)); a group's total is the sum of its limbs by place. Tasks read each text once and hand on sums,
which meet in map-side combines like any other, and a group comes out of the shuffle as one row a place. Limits (fixed values): 1,000 digits,
exponents and magnitudes from -1,000 to 1,000; so a group has at most 400 places. A limb's sum holds nine
million million rows; beyond, Spark's own overflow error ends the job rather than give a wrong total.
"""

from __future__ import annotations

import re
from collections import defaultdict
from decimal import ROUND_HALF_EVEN, Context, Decimal, DecimalException, DivisionByZero, InvalidOperation, Overflow, Subnormal, Underflow
from functools import lru_cache
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from pitspark.functions import flags

#: Most digits, and the largest exponent and magnitude, of an amount (fixed values).
MOST = 1000
#: Digits of a quotient and the exponents it may have (fixed values).
QUOTIENT_DIGITS, QUOTIENT_EXPONENT = 50, 999

WRITTEN = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$"
LIMB = 6


def _parts(text: Column) -> dict[str, Column]:
    """Digits without leading zeros, the power of ten of the last one, and the sign."""
    group = lambda k: F.regexp_extract(text, WRITTEN, k)
    digits = F.ltrim(F.concat(group(2), group(3)), F.lit("0"))
    written = F.when(group(4) == "", "0").otherwise(group(4))
    return {"digits": F.when(digits == "", "0").otherwise(digits), "last": written.try_cast("int") - F.length(group(3)), "negative": group(1) == "-"}


def state(text: Column) -> Column:
    """missing, not_numeric, numeric_range_exceeded or observed."""
    p = _parts(text)
    numeric = text.rlike(WRITTEN) & text.rlike(r"^[+-]?\.?[0-9]")
    top = p["last"] + F.length(p["digits"]) - 1
    within = (F.length(p["digits"]) <= MOST) & (F.abs(p["last"]) <= MOST) & (F.abs(top) <= MOST)
    return F.when(text.isNull(), "missing").when(~numeric, "not_numeric").when(F.coalesce(within, F.lit(False)), "observed").otherwise("numeric_range_exceeded")


def _plain(value: Decimal) -> str:
    """A decimal without an exponent and without zeros at the end."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


@F.pandas_udf(StringType())
def total_text(places: pd.Series) -> pd.Series:
    """The exact total of summed limbs (place, value) as plain text; zero for none."""

    def one(found) -> str:
        low = min((int(x["place"]) for x in found), default=0)
        total = sum(int(x["value"]) * 10 ** (LIMB * (int(x["place"]) - low)) for x in found)
        return _plain(Decimal((int(total < 0), tuple(map(int, str(abs(total)))), LIMB * low)))

    return places.map(one)


@F.pandas_udf(StructType().add("value", StringType()).add("exceeded", BooleanType()))
def quotient(numerator: pd.Series, denominator: pd.Series) -> pd.DataFrame:
    """A quotient of two amounts at 50 digits, half to even, in plain text; null where one is null or the
    denominator is zero. A quotient that does not fit the exponents is exceeded."""
    context = Context(prec=QUOTIENT_DIGITS, rounding=ROUND_HALF_EVEN, Emin=-QUOTIENT_EXPONENT, Emax=QUOTIENT_EXPONENT, traps=[Overflow, Underflow, Subnormal, DivisionByZero, InvalidOperation])

    def one(a, b):
        if a is None or b is None or Decimal(b).is_zero():
            return None, False
        try:
            return _plain(context.divide(Decimal(a), Decimal(b))), False
        except DecimalException:
            return None, True

    return pd.DataFrame([one(a, b) for a, b in zip(numerator, denominator, strict=True)], columns=["value", "exceeded"])


#: The same texts as :data:`WRITTEN` with a digit, for tasks in Python; Java's end of a text may have a line's end before it.
READ = re.compile(r"([+-]?)(?=\.?[0-9])([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z")
#: Sums that a task holds before it hands them on (a fixed value).
HELD = 200_000
ABSENT, BEYOND, ONE = ("missing", 0, 0), ("numeric_range_exceeded", 0, 0), ("observed", 1, 0)


def read_amount(text: str | None) -> tuple[str, int, int]:
    """An amount's :func:`state`, and if it is observed its value as a number times a power of 10 ** 6."""
    if text is None:
        return ABSENT
    found = READ.match(text)
    if found is None:
        return "not_numeric", 0, 0
    sign, whole, part, power = found.groups("")
    digits, far = (whole + part).lstrip("0") or "0", int(power.lstrip("+-").lstrip("0")[:11] or "0")
    last = (-far if power.startswith("-") else far) - len(part)
    if len(digits) > MOST or abs(last) > MOST or abs(last + len(digits) - 1) > MOST:
        return BEYOND
    value = int(digits) * 10 ** (last % LIMB)
    return "observed", -value if sign == "-" else value, last // LIMB


def _both(amounts: list[tuple]) -> list[tuple]:
    """A quotient's two amounts where both are observed, and one where either is beyond the limits."""
    states = [a[0] for a in amounts]
    return [*(amounts if states == ["observed", "observed"] else (ABSENT, ABSENT)), ONE if BEYOND[0] in states else ABSENT]


def _summed(keys: int, pairs: bool, schema: pa.Schema):
    """A task's rows (keys, then amounts) as sums by key, amount and state or place, which later combine."""

    def out(counts: dict, sums: dict, names: dict):
        rows = [[] for _ in schema]

        def add(key, *entry):
            for column, v in zip(rows, (*names.get(key, key), *entry)):
                column.append(v)

        for (key, states), many in counts.items():
            for k, state_ in enumerate(states):
                add(key, k, state_, None, many)
        for (key, k, place), value in sums.items():
            rest = abs(value)
            while rest:
                rest, limb = divmod(rest, 10**LIMB)
                if limb:
                    add(key, k, None, place, -limb if value < 0 else limb)
                place += 1
        table = pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)
        yield from table.to_batches(max_chunksize=50_000)

    def run(batches):
        nested, read = any(pa.types.is_nested(f.type) for f in list(schema)[:keys]), lru_cache(maxsize=1024)(read_amount)
        counts, sums, names = defaultdict(int), defaultdict(int), {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, texts in zip(zip(*columns[:keys]) if keys else repeat((), batch.num_rows), zip(*columns[keys:])):
                if nested:  # lists and dicts are no keys of a dict
                    names[repr(key)] = key
                    key = repr(key)
                amounts = [read(t) for t in texts]
                if pairs:
                    amounts = _both(amounts)
                counts[key, tuple([a[0] for a in amounts])] += 1
                for k, (_, value, low) in enumerate(amounts):
                    if value:
                        sums[key, k, low] += value
                if len(counts) + len(sums) >= HELD:
                    yield from out(counts, sums, names)
                    counts, sums, names = defaultdict(int), defaultdict(int), {}
        yield from out(counts, sums, names)

    return run


def exact_totals(rows: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """One row for each group: for each amount (text) its exact total ``{a}_total`` in plain text, null without
    an observed one, and the numbers of amounts by state, ``{a}_observed``, ``{a}_missing``, ``{a}_not_numeric``,
    ``{a}_exceeded``. Places meet by (group, amount, place), so a group of many rows is a row a place."""
    return _totals(rows.select(*by, *[F.col(a).cast("string") for a in amounts]), by, amounts, pairs=False)


def _totals(rows: DataFrame, by: list[str], amounts: list[str], pairs: bool) -> DataFrame:
    """:func:`exact_totals` of rows of keys and amounts; with ``pairs`` of two amounts as :func:`_both` marks them."""
    kinds = {"observed": "observed", "missing": "missing", "not_numeric": "not_numeric", "numeric_range_exceeded": "exceeded"}
    names = [f"_{k}" for k in range(len(by))]
    told = StructType([StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)])
    told = told.add("amount", "integer").add("state", "string").add("place", "integer").add("value", "long")
    each = rows.mapInArrow(_summed(len(by), pairs, to_arrow_schema(told)), told)
    placed = each.groupBy(*names, "amount", "state", "place").agg(F.sum("value").alias("value"))
    found = []
    for k, a in enumerate(amounts):
        mine = F.col("amount") == k
        found.append(F.collect_list(F.when(mine & F.col("place").isNotNull(), F.struct("place", "value"))).alias(f"{a}_places"))
        found += [F.coalesce(F.sum(F.when(mine & (F.col("state") == s), F.col("value"))), F.lit(0)).alias(f"{a}_{label}") for s, label in kinds.items()]
    wide = placed.groupBy(*names).agg(*found)
    totals = [F.when(F.col(f"{a}_observed") > 0, total_text(F.col(f"{a}_places"))).alias(f"{a}_total") for a in amounts]
    return wide.select(*[F.col(n).alias(b) for n, b in zip(names, by, strict=True)], *totals, *[F.col(f"{a}_{label}") for a in amounts for label in kinds.values()])


def exact_ratio(rows: DataFrame, by: list[str], numerator: str, denominator: str) -> DataFrame:
    """Each group's total of ``numerator`` over its total of ``denominator``, from the rows where both are
    observed: v of them, exact totals, ``sign`` of the numerator's total (of the exact one, so a total that a
    double takes for zero keeps it), the quotient as text and as double, and reasons."""
    asked = rows.select(*by, F.col(numerator).cast("string"), F.col(denominator).cast("string"))
    out = _totals(asked, by, ["num", "den", "over"], pairs=True)
    positive = ~F.col("den_total").startswith("-") & (F.col("den_total") != "0")
    out = out.withColumn("q", quotient(F.when(positive, F.col("num_total")), F.col("den_total")))
    why = flags.reasons(no_contributors=F.col("num_observed") == 0, denominator_nonpositive=~positive, numeric_range_exceeded=(F.col("over_observed") > 0) | F.col("q.exceeded"))
    sign = F.when(F.col("num_total") == "0", 0).when(F.col("num_total").startswith("-"), -1).when(F.col("num_total").isNotNull(), 1)
    return out.select(*by, F.col("num_observed").alias("v"), "num_total", "den_total", sign.alias("sign"), F.col("q.value").alias("ratio_text"), F.col("q.value").try_cast("double").alias("ratio"), F.col("over_observed").alias("exceeded"), why.alias("reasons"))

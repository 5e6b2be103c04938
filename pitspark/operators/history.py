"""A metric against its own past: bands, comparisons and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar, wide


def quarter_end(day: Column) -> Column:
    """Whether a date is one of the four calendar quarters' ends."""
    return (day == F.last_day(day)) & (F.month(day) % 3 == 0)


def sampled(points: DataFrame, by: list[str], series_key: Column | None = None) -> DataFrame:
    """All reasons for which a point is left out of a band, as a sorted array; none means that it counts.

    A point's identity is its value, input hash and flags (the columns ``input_hash`` and ``flags`` where
    there are such). Points of one quarter with several identities conflict, all of them; of equal ones
    without another reason the first counts. ``series_key`` says whether a point is of the series asked for.
    A value may be text as written, of any length: what is no number or out of range has its reason.
    """
    written = dict(points.dtypes)["value"] == "string"
    number = wide.state(F.col("value")) if written else F.lit("observed")
    amount = F.col("value").try_cast("double") if written else F.col("value").cast("double")
    carried = F.col("flags") if "flags" in points.columns else F.array().cast("array<string>")
    lineage = F.col("input_hash") if "input_hash" in points.columns else F.lit("-")
    same = F.lit(True) if series_key is None else F.coalesce(series_key, F.lit(False))
    quarter = Window.partitionBy(*by, "quarter_end")
    identity = F.when(same, F.struct(F.col("value"), lineage.alias("h"), F.array_sort(carried).alias("f")))
    variants = F.size(F.collect_set(identity).over(quarter))
    own = flags.reasons(
        not_quarter_end=~quarter_end(F.col("quarter_end")), incompatible_series=~same, missing_lineage=F.coalesce(F.trim(lineage), F.lit("")) == "",
        missing_value=F.col("value").isNull(), nonfinite_value=(number == "observed") & ~F.lit(written) & (amount.isin(float("inf"), float("-inf")) | F.isnan(amount)), invalid_value_type=number == "not_numeric", numeric_range_exceeded=number == "numeric_range_exceeded",
        conflicting_quarter=same & (variants > 1),
    )
    found = points.withColumn("reasons", flags.union(carried, own))
    clear = F.size("reasons") == 0
    nth = F.row_number().over(Window.partitionBy(*by, "quarter_end", clear).orderBy("point_id"))
    return found.withColumn("reasons", F.when(clear & (nth > 1), F.array(F.lit("duplicate_sample"))).otherwise(F.col("reasons")))


def bands(points: DataFrame, as_of: DataFrame, by: list[str], years: int, least: int) -> DataFrame:
    """Quartiles of the eligible points in the window (start excluded) of each date; null under ``least``.

    Also how many quarter ends the window holds and how many of them have no eligible point. A point meets
    dates of its key and of its own or the following years up to the window only. A date asked twice counts once.
    """
    good = points.filter(F.size("reasons") == 0).select(*by, "quarter_end", F.col("value").cast("double").alias("value"))
    near = good.withColumn("_year", F.explode(F.sequence(F.year("quarter_end"), F.year("quarter_end") + years)))
    start = scalar.window_start(F.col("as_of"), years)
    held = as_of.select(*by, "as_of").distinct().withColumn("_year", F.year("as_of")).join(near, [*by, "_year"], "left")
    inside = (F.col("quarter_end") > start) & (F.col("quarter_end") <= F.col("as_of"))
    out = held.withColumn("value", F.when(inside, F.col("value"))).groupBy(*by, "as_of").agg(F.count("value").alias("samples"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    enough = F.col("samples") >= least
    quarters = lambda d: F.floor(F.months_between(F.trunc(F.date_add(d, 1), "quarter"), F.lit("1900-01-01").cast("date")) / 3)
    expected = (quarters(F.col("as_of")) - quarters(start)).cast("int")
    return out.select(*by, "as_of", "samples", expected.alias("expected"), (expected - F.col("samples")).alias("missing"), *[F.when(enough, F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], F.when(~enough, "insufficient_history").alias("reason"))


def exclusions(points: DataFrame, as_of: DataFrame, by: list[str], years: int) -> DataFrame:
    """(by, as_of, reason, points): how many of a key's points each reason keeps out of the band of each date.

    ``points`` come from :func:`sampled`. Points up to the window's start are ``outside_window``, those after
    the date ``after_as_of``; they have their own reasons too, but for a conflict or a repeat, which only the
    window's points can have. Points are counted by quarter end and reason first, so a date meets days, not
    points, and a reason's days before and after are running sums.
    """
    told = points.select(*by, "quarter_end", F.explode(F.concat(F.array(F.lit("")), F.col("reasons"))).alias("reason"))
    per_day = told.groupBy(*by, "quarter_end", "reason").agg(F.count("*").alias("n"))
    dates = as_of.select(*by, "as_of").distinct()
    start = scalar.window_start(F.col("as_of"), years)
    none = F.lit(None).cast("date")
    # of one day: its points, then the dates that ask how many there are up to it
    ticks = per_day.select(*by, "reason", F.col("quarter_end").alias("day"), F.lit(0).alias("turn"), "n", none.alias("as_of"))
    reasons = per_day.select(*by, "reason").distinct()
    asked = dates.join(reasons, by).select(*by, "reason", "as_of", F.explode(F.array(F.struct(start.alias("day"), F.lit(1).alias("turn")), F.struct(F.col("as_of").alias("day"), F.lit(2).alias("turn")))).alias("x"))
    ticks = ticks.unionByName(asked.select(*by, "reason", F.col("x.day").alias("day"), F.col("x.turn").alias("turn"), F.lit(0).cast("long").alias("n"), "as_of"))
    key = Window.partitionBy(*by, "reason")
    counted = ticks.withColumns({"upto": F.sum("n").over(key.orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(key)}).filter(F.col("turn") > 0)
    each = counted.groupBy(*by, "reason", "as_of").agg(F.max(F.when(F.col("turn") == 1, F.col("upto"))).alias("before"), F.max(F.when(F.col("turn") == 2, F.col("upto"))).alias("upto"), F.max("total").alias("total"))
    inside = F.col("upto") - F.col("before")
    entry = lambda reason, n: F.struct(reason.alias("reason"), n.alias("points"))
    everything, window_only = F.col("reason") == "", F.col("reason").isin("conflicting_quarter", "duplicate_sample")
    found = F.when(everything, F.array(entry(F.lit("outside_window"), F.col("before")), entry(F.lit("after_as_of"), F.col("total") - F.col("upto")))).when(window_only, F.array(entry(F.col("reason"), inside))).otherwise(F.array(entry(F.col("reason"), F.col("total"))))
    return each.select(*by, "as_of", F.inline(found)).filter(F.col("points") > 0)


def compared_to_band(value: Column) -> Column:
    """below, within or above; equality is within."""
    return F.when(value.isNull() | F.col("p25").isNull(), "unavailable").when(value < F.col("p25"), "below").when(value > F.col("p75"), "above").otherwise("within")


def trend(rows: DataFrame, by: list[str], rate: str, tolerance: float) -> DataFrame:
    """The direction of three rates of quarters that follow each other (period_start, period_end).

    rising asks that both changes exceed the tolerance, falling that both fall below its negative,
    broadly_stable that neither does either; else mixed. A missing rate or a gap between quarters is a reason.
    """
    order = Window.partitionBy(*by).orderBy("period_end")
    first, second = F.lag(rate, 1).over(order) - F.lag(rate, 2).over(order), F.col(rate) - F.lag(rate, 1).over(order)
    touches = lambda n: F.lag("period_end", n).over(order) == F.date_sub(F.lag("period_start", n - 1).over(order) if n > 1 else F.col("period_start"), 1)
    codes = flags.reasons(
        three_quarterly_rates_required=F.lag("period_end", 2).over(order).isNull(), nonconsecutive_trend_quarters=~touches(1) | ~touches(2),
        trend_input_unavailable=F.lag("period_end", 2).over(order).isNotNull() & (first.isNull() | second.isNull()),
    )
    word = F.when((first > tolerance) & (second > tolerance), "rising").when((first < -tolerance) & (second < -tolerance), "falling").when((F.abs(first) <= tolerance) & (F.abs(second) <= tolerance), "broadly_stable").otherwise("mixed")
    found = rows.withColumn("reasons", codes)
    return found.withColumn("trend", F.when(F.size("reasons") == 0, word))

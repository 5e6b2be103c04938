"""Periods: twelve months from quarters, quarters from year-to-date, comparisons and the quarter grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar, wide


def four_quarters(flows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Sums of four quarters that follow each other day by day; null where one is missing."""
    order = Window.partitionBy(*by).orderBy("period_end")
    frame = order.rowsBetween(-3, 0)
    touching = F.lag("period_end", 1).over(order) == F.date_sub("period_start", 1)
    held = flows.withColumn("touch", F.coalesce(touching, F.lit(False)).cast("int"))
    whole = (F.count("*").over(frame) == 4) & (F.sum("touch").over(order.rowsBetween(-2, 0)) == 3)
    return held.select(*by, "period_end", whole.alias("whole"), *[F.when(whole, F.sum(v).over(frame)).alias(v) for v in values])


def year_to_date(flows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Cumulative amounts of each calendar year that begins with its first quarter."""
    year = Window.partitionBy(*by, F.year("period_end")).orderBy("period_end")
    first = F.min("period_start").over(year)
    n = F.count("*").over(year.rowsBetween(Window.unboundedPreceding, 0))
    sums = [F.sum(v).over(year.rowsBetween(Window.unboundedPreceding, 0)).alias(v) for v in values]
    rows = flows.select(*by, first.alias("start"), F.col("period_end").alias("end"), n.alias("quarters"), *sums)
    return rows.filter((F.month("start") == 1) & (F.quarter("end") == F.col("quarters")))


def quarter_from_year_to_date(ytd: DataFrame, by: list[str], value: str, same: tuple[str, ...] = ()) -> DataFrame:
    """A quarter's amount: a year-to-date amount less the one before it with the same start.

    ``same`` columns (edition, basis) have to agree in both, else there is no amount."""
    before = ytd.select(*by, "start", (F.col("quarters") + 1).alias("quarters"), F.col(value).alias("before"), *[F.col(c).alias(f"_{c}") for c in same])
    joined = ytd.join(before, [*by, "start", "quarters"], "left")
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    amount = F.when(F.col("quarters") == 1, F.col(value)).otherwise(F.when(agree, F.col(value) - F.col("before")))
    return joined.select(*by, "end", amount.alias(value))


def annual_bridge(ytd: DataFrame, by: list[str], value: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Twelve months to a quarter end: last year's whole, plus this year to date, less last year to date;
    null where the three do not agree in the ``same`` columns."""
    year = F.year("end")
    now = ytd.filter("quarters < 4").select(*by, year.alias("year"), "quarters", "end", F.col(value).alias("now"), *same)
    prior = ytd.select(*by, (year + 1).alias("year"), "quarters", F.col(value).alias("prior"), *[F.col(c).alias(f"_{c}") for c in same])
    whole = ytd.filter("quarters = 4").select(*by, (year + 1).alias("year"), F.col(value).alias("whole"), *[F.col(c).alias(f"__{c}") for c in same])
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}")) & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = now.join(prior, [*by, "year", "quarters"]).join(whole, [*by, "year"])
    return joined.select(*by, "end", F.when(agree, F.col("whole") + F.col("now") - F.col("prior")).alias(value))


def compared(flows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each period with the same calendar quarter or year of the year before, and the growth.

    Both starts and both ends have to fit, so that a year never meets a quarter; periods other than whole
    calendar quarters and twelve months have no comparison."""
    months = scalar.month_span(F.col("period_start"), F.col("period_end"))
    fits = (months == 12) | ((months == 3) & (F.month("period_start") % 3 == 1))
    prior = flows.filter(fits).select(*by, F.add_months("period_start", 12).alias("period_start"), F.last_day(F.add_months("period_end", 12)).alias("period_end"), F.col(value).alias("prior"))
    joined = flows.select(*by, "period_start", "period_end", value).join(prior, [*by, "period_start", "period_end"], "left")
    growth = F.when(F.col("prior") > 0, scalar.ratio(F.col(value) - F.col("prior"), F.col("prior")))
    return joined.withColumn("growth", growth)


def balances(income: DataFrame, assets: DataFrame, by: list[str]) -> DataFrame:
    """Income with the balance on the day before its period and the balance at its end."""
    opening = assets.select(*by, F.date_add("at", 1).alias("period_start"), F.col("assets").alias("opening"))
    closing = assets.select(*by, F.col("at").alias("period_end"), F.col("assets").alias("closing"))
    return income.join(opening, [*by, "period_start"], "left").join(closing, [*by, "period_end"], "left")


def quarter_grid(flows: DataFrame, by: list[str]) -> DataFrame:
    """Every quarter end between a key's first and last, and whether it is missing."""
    span = flows.groupBy(*by).agg(F.min("period_end").alias("low"), F.max("period_end").alias("high"))
    # from the first day of the quarter, as steps from a month's end would keep its day
    starts = F.sequence(F.trunc("low", "quarter"), F.trunc("high", "quarter"), F.expr("interval 3 months"))
    grid = span.select(*by, F.explode(F.transform(starts, lambda d: F.last_day(F.add_months(d, 2)))).alias("period_end"))
    return grid.join(flows.select(*by, "period_end", F.lit(True).alias("there")), [*by, "period_end"], "left").select(*by, "period_end", F.col("there").isNull().alias("missing"))


def segments(points: DataFrame, by: list[str], date: str, value: str, gap_days: int) -> DataFrame:
    """Number of the unbroken run that each point is in: a null value or a long gap begins a new one."""
    order = Window.partitionBy(*by).orderBy(date)
    broken = (F.datediff(F.col(date), F.lag(date).over(order)) > gap_days) | F.col(value).isNull() | F.lag(F.col(value).isNull()).over(order)
    marked = points.withColumn("broken", F.coalesce(broken, F.lit(False)).cast("int"))
    return marked.withColumn("segment", F.sum("broken").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("broken")


def calendar_match(flows: DataFrame, calendar: DataFrame, by: list[str]) -> DataFrame:
    """Fiscal year and quarter of each period in a reviewed calendar; null where it has none."""
    return flows.join(calendar, [*by, "period_start", "period_end"], "left")


def monthly_windows(rows: DataFrame, by: list[str], most: int = 120) -> DataFrame:
    """A range (start, stop) clipped to calendar months; one of more than ``most`` months, or whose ends
    are crossed, gives one row with a reason."""
    months = F.months_between(F.trunc("stop", "month"), F.trunc("start", "month")) + 1
    reason = F.when(F.col("start") > F.col("stop"), "ends_crossed").when(months > most, "too_many_months").otherwise("")
    every = F.when(reason == "", F.sequence(F.trunc("start", "month"), F.col("stop"), F.expr("interval 1 month")))
    found = rows.select(*by, "start", "stop", reason.alias("reason"), F.explode_outer(every).alias("_m"))
    clipped = [F.when(F.col("reason") == "", c) for c in (F.greatest("start", "_m"), F.least("stop", F.last_day("_m")))]
    return found.select(*by, clipped[0].alias("start"), clipped[1].alias("stop"), "reason")


def supported_span(start: Column, end: Column) -> Column:
    """Quarters of 13 or 14 weeks or whole months, years of 52 or 53 weeks or twelve months."""
    days = F.datediff(end, start) + 1
    months = scalar.month_span(start, end)
    return F.when(months.isin(3, 12), F.concat(F.lit("months_"), months)).when(days.isin(91, 98), "quarter_weeks").when(days.isin(364, 371), "year_weeks").otherwise("unsupported")


def fiscal_year(ends: Column, start: Column) -> Column:
    """The kind of a fiscal year given its start and the ends of its four quarters, or unsupported: months,
    or weeks with three quarters of 13 and at most one of 14, which make 364 or 371 days."""
    starts = F.concat(F.array(start), F.transform(F.slice(ends, 1, 3), lambda e: F.date_add(e, 1)))
    kinds = F.zip_with(starts, ends, supported_span)
    days = F.zip_with(starts, ends, lambda s, e: F.datediff(e, s) + 1)
    long = F.size(F.filter(days, lambda d: d == 98))
    whole = F.size(ends) == 4
    return F.when(whole & F.forall(kinds, lambda k: k == "months_3"), "months").when(whole & F.forall(days, lambda d: d.isin(91, 98)) & (long <= 1), F.when(long == 1, "weeks_53").otherwise("weeks_52")).otherwise("unsupported")


def annual_amounts(rows: DataFrame) -> DataFrame:
    """Amounts (period_start, period_end, value, problems) that are a year's by themselves: ``value`` and sorted
    ``problems``, to which a period of other than twelve whole months adds ``unsupported_annual_period``; any
    problem leaves no value."""
    odd = ~F.coalesce(scalar.month_span(F.col("period_start"), F.col("period_end")) == 12, F.lit(False))
    found = flags.union(F.coalesce("problems", F.array().cast("array<string>")), flags.reasons(unsupported_annual_period=odd))
    return rows.withColumn("problems", found).withColumn("value", F.when(F.size("problems") == 0, F.col("value")))


def assembled(sources: DataFrame, by: list[str]) -> DataFrame:
    """One amount from each group of sources (value, error, coefficient of 1 or -1, problems, flags): the exact
    ``value`` as text, however long; ``error``, the sum of the sources' absolute errors, null if one is unknown;
    ``flags``, those of all sources and their problems. A problem leaves neither value nor error, and so does a
    value that is missing (``source_value_missing``) or an amount out of range (``unsupported_numeric_range``).
    Where sources have a ``concept``, a negative total of capital expenditures is a flag and no value."""
    text = F.col("value").cast("string")
    negated = F.when(text.startswith("-"), F.substring(text, 2, 1_000_000)).otherwise(F.concat(F.lit("-"), F.ltrim(text, F.lit("+"))))
    none = F.array().cast("array<string>")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = sources.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.when(F.col("coefficient") == -1, negated).otherwise(text).alias("v"), F.col("error").cast("string").alias("e"), F.coalesce("problems", none).alias("p"), F.coalesce("flags", none).alias("f"), (F.col("concept") if "concept" in sources.columns else F.lit(None).cast("string")).alias("c"))
    told = rows.groupBy(*keys).agg(flags.normal(F.flatten(F.collect_set("p"))).alias("p"), flags.normal(F.flatten(F.collect_set("f"))).alias("f"), F.min("c").alias("c"))
    sums = wide.exact_totals(rows, keys, ["v", "e"])
    same = F.lit(True)
    for k in keys:
        same &= sums[k].eqNullSafe(told[k])
    found = sums.join(told.select(*keys, "p", "f", "c"), same)
    found = found.select(*[sums[k] for k in keys], "v_total", "e_total", "v_missing", "v_not_numeric", "v_exceeded", "e_missing", "e_not_numeric", "e_exceeded", "p", "f", "c")
    all_errors = F.col("e_missing") + F.col("e_not_numeric") == 0
    bad = flags.union(F.col("p"), flags.reasons(source_value_missing=F.col("v_missing") + F.col("v_not_numeric") > 0, unsupported_numeric_range=(F.col("v_exceeded") > 0) | (all_errors & (F.col("e_exceeded") > 0))))
    clear = F.size(bad) == 0
    spent = clear & F.coalesce((F.col("c") == "capital_expenditures_ppe") & F.col("v_total").startswith("-"), F.lit(False))
    known = clear & all_errors
    return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], F.when(clear & ~spent, F.col("v_total")).alias("value"), F.when(known, F.col("e_total")).alias("error"), flags.union(bad, F.col("f"), flags.reasons(negative_cash_ppe_capex=spent)).alias("flags"))

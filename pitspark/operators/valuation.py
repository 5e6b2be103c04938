"""Discounted cash flows over tables of companies and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.operators import roots

#: Claims of the bridge from enterprise value to equity: two add, five subtract (fixed values).
ADDED, SUBTRACTED = ("cash", "non_operating_assets"), ("debt", "leases", "preferred", "minorities", "pensions")
DOMINANT = 0.75


def forward(rows: DataFrame, horizon: int | None = None) -> DataFrame:
    """Enterprise value of each row (revenue, growth, margins, taxes, reinvestment arrays and the terminal
    parameters): cash flows by year in one fold over the arrays, then the terminal value.

    Where all arrays are known to have ``horizon`` years, the same steps are columns of their own, which Spark
    compiles; the fold's function is interpreted for each year of each row. Rows of another length have no value.
    """
    years = F.arrays_zip("growth", "margins", "taxes", "reinvestment")
    start = F.struct(F.col("revenue").cast("double").alias("rev"), F.lit(0.0).alias("pv"), F.lit(1.0).alias("disc"))

    def year(state: Column, y: Column) -> Column:
        rev = state["rev"] * (1 + y["growth"])
        ebit = rev * y["margins"]
        flow = ebit - F.greatest(ebit, F.lit(0.0)) * y["taxes"] - rev * y["reinvestment"]
        disc = state["disc"] * (1 + F.col("wacc"))
        return F.struct(rev.alias("rev"), (state["pv"] + flow / disc).alias("pv"), disc.alias("disc"))

    if horizon is None:
        out = rows.withColumn("_x", F.aggregate(years, start, year))
    else:
        lengths = [F.size(name) == horizon for name in roots.YEARLY]
        out = rows.withColumn("_x", F.when(lengths[0] & lengths[1] & lengths[2] & lengths[3], start))
        for k in range(horizon):
            at = {name: F.get(name, F.lit(k)) for name in roots.YEARLY}
            out = out.withColumn("_x", year(F.col("_x"), at))
    nopat = F.col("_x.rev") * (1 + F.col("terminal_growth")) * F.col("terminal_margin") * (1 - F.col("terminal_tax"))
    terminal = (nopat - nopat * F.col("terminal_growth") / F.col("terminal_roic")) / (F.col("wacc") - F.col("terminal_growth")) / F.col("_x.disc")
    value = F.col("_x.pv") + terminal
    share = F.when(value > 0, terminal / value)
    return out.withColumns({"explicit_pv": F.col("_x.pv"), "terminal_pv": terminal, "ev": value, "terminal_share": share, "dominant": share > DOMINANT}).drop("_x")


def domain_reasons() -> Column:
    return flags.reasons(
        wacc_not_above_growth=F.col("wacc") <= F.col("terminal_growth"),
        growth_above_risk_free=F.col("terminal_growth") > F.col("risk_free"),
        roic_nonpositive=F.col("terminal_roic") <= 0,
        tax_out_of_range=(F.col("terminal_tax") < 0) | (F.col("terminal_tax") > 1),
        horizon_out_of_range=~F.size("growth").between(1, 10),
        revenue_nonpositive=F.col("revenue") <= 0,
    )


def bridge(values: DataFrame, claims: DataFrame, key: list[str], currency: Column, at: Column, most_age: int) -> DataFrame:
    """Equity from enterprise value, all or nothing: null with reasons unless every one of the seven kinds of
    claim (key, kind, amount, state, currency, known_at, as_of) is there once, eligible, in the currency,
    known at the valuation and no older than ``most_age`` days. No claim counts as zero for being absent."""
    day = F.to_date(at)
    asked = claims.join(values.select(*key, currency.alias("_currency"), at.alias("_at"), day.alias("_day")).distinct(), key)
    age = F.datediff("_day", "as_of")
    good = (F.col("state") != "unavailable") & F.col("amount").isNotNull() & (F.col("currency") == F.col("_currency")) & (F.col("known_at") <= F.col("_at")) & (age >= 0) & (age <= most_age)
    sign = F.when(F.col("kind").isin(*ADDED), 1).otherwise(-1)
    kinds = [*ADDED, *SUBTRACTED]
    counted = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds] + [F.count_if((F.col("kind") == k) & ~F.coalesce(good, F.lit(False))).alias(f"bad_{k}") for k in kinds]
    summed = asked.groupBy(*key).agg(F.sum(F.col("amount") * sign).alias("net"), *counted)
    joined = values.join(summed, key, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    codes = flags.reasons(**{f"claim_missing:{k}": none(f"n_{k}") == 0 for k in kinds}, **{f"claim_repeated:{k}": none(f"n_{k}") > 1 for k in kinds}, **{f"ineligible_claim:{k}": none(f"bad_{k}") > 0 for k in kinds})
    out = joined.withColumn("reasons", codes).withColumn("equity", F.when(F.size("reasons") == 0, F.col("ev") + F.col("net").cast("double")))
    return out.drop(*[f"{p}_{k}" for p in ("n", "bad") for k in kinds])


def quote_reasons(price: Column, share: Column, currency: Column, at: Column, quote_age: int, share_age: int) -> Column:
    """Why a price (value, currency, reference_date, known_at, action_basis, usable) and a share count (basic,
    diluted, currency, as_of, known_at, action_basis) cannot give a market value at ``at``."""
    day = F.to_date(at)
    within = lambda date, most: F.coalesce(F.datediff(day, date).between(0, most), F.lit(False))
    return flags.reasons(
        ineligible_quote=~F.coalesce(price["usable"] & (price["value"] > 0) & (price["currency"] == currency), F.lit(False)),
        quote_time_or_freshness=~F.coalesce(price["known_at"] <= at, F.lit(False)) | ~within(price["reference_date"], quote_age),
        ineligible_common_pool=~F.coalesce((share["basic"] > 0) & (share["basic"] == share["diluted"]) & (share["currency"] == currency), F.lit(False)),
        share_time_or_freshness=~F.coalesce(share["known_at"] <= at, F.lit(False)) | ~within(share["as_of"], share_age),
        price_share_action_mismatch=~F.coalesce(price["action_basis"] == share["action_basis"], F.lit(False)),
    )


def sensitivity(rows: DataFrame, x: tuple[str, list[float]], y: tuple[str, list[float]], reverse: tuple[str, float, float] | None = None) -> DataFrame:
    """Cells of two parameters: every row with each value of both (columns x and y hold the places), valued
    again, or with ``reverse`` (variable, low, high) solved for its target in each cell."""
    axis = lambda values: F.posexplode(F.array(*[F.lit(float(v)) for v in values]))
    cells = rows.select("*", axis(x[1]).alias("x", "_x")).select("*", axis(y[1]).alias("y", "_y"))
    cells = with_parameter(with_parameter(cells, x[0], F.col("_x")), y[0], F.col("_y")).drop("_x", "_y")
    if reverse is None:
        return forward(cells)
    return scenario_results(cells, *reverse)


def with_parameter(rows: DataFrame, parameter: str, value: Column) -> DataFrame:
    """``rows`` with a parameter set to ``value``, in every year where it goes by year.

    The names of the solver's variables stand for what it varies: growth or reinvestment in every year, or
    the terminal margin, towards which the years' margins fade from ``anchor_margin`` by ``weights``.
    """
    if parameter == roots.MARGIN:
        path = faded(F.col("anchor_margin"), F.transform("weights", lambda _: value), F.col("weights"))
        return rows.withColumns({"margins": path, "terminal_margin": value})
    name = {roots.GROWTH: "growth", roots.REINVESTMENT: "reinvestment"}.get(parameter, parameter)
    return rows.withColumn(name, F.transform(name, lambda _: value) if name in roots.YEARLY else value)


def reverse_solve(rows: DataFrame, variable: str, low: float, high: float, bounds: roots.Bounds = roots.Bounds()) -> DataFrame:
    """``rows`` with the variable's value at which they meet ``target``: state, solution, roots, unresolved,
    evaluations and subdivisions.

    Every domain is proven to hold no root or one (:mod:`pitspark.operators.roots`): converged has one root,
    non_unique several, no_solution none anywhere; whatever was not proven within the budget, as a root that
    only touches or lies at an end, leaves inconclusive with the domains in question; a null or an array of
    another length is no_input. Within the row, so there is no join and no shuffle.
    """
    found = rows.withColumn("_found", roots.solver(variable, low, high, bounds)(roots.inputs(rows.columns)))
    return found.select(*rows.columns, "_found.*")


def scenario_results(rows: DataFrame, variable: str, low: float, high: float) -> DataFrame:
    """Solved scenarios, valued again at the solution, for each share (``shares``); null unless converged."""
    solved = reverse_solve(rows, variable, low, high)
    priced = forward(with_parameter(solved, variable, F.coalesce("solution", F.lit(0.0))))
    good = F.col("state") == "converged"
    return priced.withColumns({"ev": F.when(good, F.col("ev")), "per_share": F.when(good & (F.col("shares") > 0), F.col("ev") / F.col("shares"))})


def faded(anchor: Column, values: Column, weights: Column) -> Column:
    """(1 - w) * anchor + w * x for each year."""
    return F.zip_with(values, weights, lambda x, w: (1 - w) * anchor + w * x)


def elasticity(x: tuple[Column, Column, Column], y: tuple[Column, Column, Column]) -> Column:
    """Relative change of y over that of x, from three points."""
    return F.try_divide(F.try_divide(y[2] - y[0], y[1]), F.try_divide(x[2] - x[0], x[1]))


def ranked(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rank by size, ties alike; a null has no rank."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(F.abs(F.col(value))))
    return rows.withColumn("rank", F.when(F.col(value).isNotNull(), F.rank().over(order)))


def span(rows: DataFrame, by: list[str], value: str, state: str) -> DataFrame:
    """Least and greatest value over scenarios; null unless all converged and there are two or more."""
    whole = F.bool_and(F.col(state) == "converged") & (F.count("*") >= 2)
    return rows.groupBy(*by).agg(F.when(whole, F.min(value)).alias("low"), F.when(whole, F.max(value)).alias("high"))


def anchor_reasons(issues: Column, filed: Column, valuation_at: Column, period: Column, asked: Column, value: Column, error: Column) -> Column:
    """Why revenue cannot anchor a valuation: the input's own ``issues``; not filed on a day before the
    valuation's (UTC), so that its order within the day is unknown; another period (start, end) than twelve
    whole months, or than the one asked for; an error that is unknown, or that the value does not exceed."""
    year = (scalar.month_span(period["start"], period["end"]) == 12) & (period["start"] == asked["start"]) & (period["end"] == asked["end"])
    own = flags.reasons(
        anchor_intraday_publication_unproven=~F.coalesce(filed < F.to_date(valuation_at), F.lit(False)), unsupported_anchor_calendar=~F.coalesce(year, F.lit(False)),
        anchor_precision_unknown=error.isNull(), anchor_not_distinguishable_from_zero=value <= error,
    )
    return flags.union(issues, own)

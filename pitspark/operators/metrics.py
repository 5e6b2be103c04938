"""Company metrics: a registry of formulas, their reasons, statuses and observations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar


@dataclass(frozen=True)
class MetricSpec:
    """Inputs of a metric, its value and its reasons, as column builders."""

    inputs: tuple[str, ...]
    value: Callable[..., Column]
    reasons: Callable[..., dict[str, Column]]


def _margin(numerator: Callable[..., Column]):
    return lambda *c: scalar.ratio(numerator(*c), c[-1])


def _revenue_reasons(*c: Column) -> dict[str, Column]:
    return {"denominator_missing": c[-1].isNull(), "denominator_nonpositive": c[-1] <= 0}


def _margin_reasons(numerator: Callable[..., Column]):
    def found(*c: Column) -> dict[str, Column]:
        return {**_revenue_reasons(*c), "extreme_margin": (c[-1] > 0) & (F.abs(numerator(*c)) > c[-1])}

    return found


def _first(*c: Column) -> Column:
    return c[0]


def _less(*c: Column) -> Column:
    return c[0] - c[1]


def _after(*c: Column) -> Column:
    return c[1] - c[0]


#: Every metric that a company row can be asked for; margins take revenue last.
REGISTRY: dict[str, MetricSpec] = {
    "net_margin": MetricSpec(("income", "revenue"), _margin(_first), _margin_reasons(_first)),
    "operating_margin": MetricSpec(("operating_income", "revenue"), _margin(_first), _margin_reasons(_first)),
    "gross_margin": MetricSpec(("gross", "revenue"), _margin(_first), _margin_reasons(_first)),
    "derived_gross_margin": MetricSpec(("cost", "revenue"), _margin(_after), lambda *c: {**_margin_reasons(_after)(*c), "gross_profit_derived": F.lit(True)}),
    "free_cash_flow": MetricSpec(("cfo", "capex"), lambda a, b: (a - b).cast("double"), lambda a, b: {"input_missing": a.isNull() | b.isNull(), "capex_negative": b < 0}),
    "free_cash_flow_margin": MetricSpec(("cfo", "capex", "revenue"), _margin(_less), lambda *c: {**_revenue_reasons(*c), "capex_negative": c[1] < 0}),
    "current_ratio": MetricSpec(("current_assets", "current_liabilities"), scalar.ratio, lambda a, b: {"balance_negative": (a < 0) | (b < 0), "denominator_nonpositive": b <= 0}),
    "net_working_capital": MetricSpec(("current_assets", "current_liabilities"), lambda a, b: (a - b).cast("double"), lambda a, b: {"balance_negative": (a < 0) | (b < 0)}),
    "return_on_assets": MetricSpec(("income", "opening", "closing"), lambda i, o, c: scalar.ratio(i.cast("double"), (o.cast("double") + c.cast("double")) / 2), lambda i, o, c: {"balance_missing": o.isNull() | c.isNull(), "denominator_nonpositive": o + c <= 0}),
    "revenue_growth": MetricSpec(("revenue", "prior_revenue"), lambda a, b: scalar.ratio(a - b, b), lambda a, b: {"comparison_missing": b.isNull(), "denominator_nonpositive": b <= 0}),
    "price_earnings": MetricSpec(("cap", "income"), scalar.ratio, lambda a, b: {"market_cap_nonpositive": a <= 0, "denominator_missing": b.isNull(), "denominator_nonpositive": b <= 0}),
    "price_sales": MetricSpec(("cap", "revenue"), scalar.ratio, lambda a, b: {"market_cap_nonpositive": a <= 0, "denominator_missing": b.isNull(), "denominator_nonpositive": b <= 0}),
    "price_fcf": MetricSpec(("cap", "fcf"), scalar.ratio, lambda a, b: {"market_cap_nonpositive": a <= 0, "denominator_missing": b.isNull(), "denominator_nonpositive": b <= 0}),
}


def _codes(rows: DataFrame, spec: MetricSpec) -> Column:
    """The reasons of a metric; where there are columns ``<input>_error`` and ``<input>_issues`` for its
    inputs, also a last input (the denominator) within its error, and the evidence issues of each."""
    found = spec.reasons(*[F.col(c) for c in spec.inputs])
    last, error = F.col(spec.inputs[-1]), f"{spec.inputs[-1]}_error"
    if "denominator_nonpositive" in found and error in rows.columns:
        found["denominator_within_error"] = (last > 0) & (last <= F.col(error))
    issues = [F.coalesce(F.col(f"{c}_issues"), F.array().cast("array<string>")) for c in spec.inputs if f"{c}_issues" in rows.columns]
    return flags.union(flags.reasons(**found), *issues)


def metric(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with value and reasons of a metric; the value is null where a reason blocks."""
    spec = REGISTRY[name]
    inputs = [F.col(c) for c in spec.inputs]
    codes = _codes(rows, spec)
    return rows.withColumns({"value": scalar.guarded(spec.value(*inputs), codes), "reasons": codes})


def long_metrics(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row for each company row and metric, from one pass over the rows."""
    found = []
    for name in names:
        spec = REGISTRY[name]
        inputs = [F.col(c) for c in spec.inputs]
        codes = _codes(rows, spec)
        found.append(F.struct(F.lit(name).alias("metric"), scalar.guarded(spec.value(*inputs), codes).cast("double").alias("value"), codes.alias("reasons")))
    return rows.select(*keys, F.explode(F.array(*found)).alias("m")).select(*keys, "m.*")


def status(value: Column, codes: Column, age_days: Column, most_days: int, applicable: Column | None = None, problems: Column | None = None, missing: Column | None = None, precise: Column | None = None, overdue: Column | None = None) -> Column:
    """valid, not_meaningful, missing, invalid, stale, unsupported or inapplicable, by priority.

    ``problems`` are codes of the profile and the cutoffs, ``missing`` says that an input has no value,
    ``precise`` that every input's error is known, ``overdue`` that a filing was expected by now. A null
    value is not meaningful for reasons of its denominator only, and only if all inputs are precise.
    """
    none = F.array().cast("array<string>")
    applicable, problems = F.lit(True) if applicable is None else applicable, none if problems is None else problems
    precise, overdue = F.lit(True) if precise is None else precise, F.lit(False) if overdue is None else overdue
    own = flags.blocking(codes, flags.METRIC_INFORMATIONAL)
    missing = F.exists(own, lambda c: c.contains("missing")) if missing is None else missing
    of_denominator = F.forall(own, lambda c: c.contains("nonpositive") | c.contains("within_error"))
    empty = (
        F.when((F.size(own) > 0) & of_denominator & precise, "not_meaningful")
        .when(missing | F.array_contains(own, "denominator_precision_unknown") | of_denominator, "missing")
        .when(F.exists(own, lambda c: c.startswith("unsupported_") | c.isin("revision_compatibility_unproven", "incompatible_comparison_basis")), "unsupported")
        .otherwise("invalid")
    )
    first = (
        F.when(F.size(problems) > 0, F.when(F.forall(problems, lambda c: c.startswith("unsupported_")), "unsupported").otherwise("invalid"))
        .when(applicable.isNull(), "unsupported")
        .when(~applicable, "inapplicable")
        .when(value.isNull(), empty)
        .when(F.size(own) > 0, "invalid")
        .otherwise("valid")
    )
    return F.when(first.isin("valid", "not_meaningful") & ((age_days > most_days) | overdue), "stale").otherwise(first)


#: Observation, topic and category by metric and sign (fixed values); the first sign that fits counts.
OBSERVED = (
    ("revenue_growth", ">", "revenue_grew", "revenue", "operating"),
    ("revenue_growth", "<", "revenue_declined", "revenue", "operating"),
    ("revenue_growth", "=", "revenue_unchanged", "revenue", "operating"),
    ("free_cash_flow", "<", "cash_spending_gap", "cash_generation", "cash"),
    ("free_cash_flow_margin", "<", "cash_spending_gap", "cash_generation", "cash"),
    ("operating_margin", "<", "operating_loss", "earnings", "operating"),
    ("net_margin", "<", "consolidated_loss", "earnings", "operating"),
    ("return_on_assets", "<", "consolidated_loss", "earnings", "operating"),
)


def observed(long: DataFrame) -> DataFrame:
    """Neutral observations of usable metrics (metric, value, usable): rule, topic and category by sign."""
    out = F.lit(None).cast("struct<rule:string,topic:string,category:string>")
    for metric_, sign, rule, topic, category in OBSERVED:
        fits = {">": F.col("value") > 0, "<": F.col("value") < 0, "=": F.col("value") == 0}[sign]
        out = F.when((F.col("metric") == metric_) & fits, F.struct(F.lit(rule).alias("rule"), F.lit(topic).alias("topic"), F.lit(category).alias("category"))).otherwise(out)
    return long.withColumn("o", F.when(F.col("usable"), out)).filter("o is not null").select("*", "o.*").drop("o")


def review_items(long: DataFrame, by: list[str], many: int = 3) -> DataFrame:
    """At most ``many`` topics of each company row, data before cash before operating, each once, with the
    metrics behind it. Metrics that cannot be used, and extreme margins, are topics of their own."""
    facts = observed(long).filter(~F.col("rule").isin("revenue_grew", "revenue_unchanged")).select(*by, "metric", "rule", "topic", "category")
    data = F.when(~F.col("usable"), F.struct(F.lit("data_review").alias("rule"), F.lit("data_availability").alias("topic"))).when(F.array_contains("reasons", "extreme_margin"), F.struct(F.lit("extreme_margin_review").alias("rule"), F.lit("extreme_margin").alias("topic")))
    doubts = long.withColumn("d", data).filter("d is not null").select(*by, "metric", "d.rule", "d.topic", F.lit("data").alias("category"))
    rank = F.when(F.col("category") == "data", 0).when(F.col("category") == "cash", 1).otherwise(2)
    topics = facts.unionByName(doubts).groupBy(*by, "topic").agg(F.min(F.struct(rank.alias("rank"), "rule")).alias("first"), F.array_sort(F.collect_set("metric")).alias("metrics"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("first.rank", "first.rule"))
    return topics.withColumn("place", place).filter(F.col("place") <= many).select(*by, "topic", "first.rule", "metrics", "place")


def identity_gap(assets: Column, liabilities: Column, equity: Column, error: Column) -> Column:
    """Whether assets equal liabilities and equity within the summed absolute errors, in exact decimals."""
    gap = F.abs(assets - liabilities - equity)
    return F.when(gap.isNull() | error.isNull(), "unknown").when(gap <= error, "balanced").otherwise("unbalanced")

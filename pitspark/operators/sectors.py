"""Sector aggregation: cohorts, totals, means, percentiles, coverage, gates and concentration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.functions.storage import stored, work_dir


@dataclass(frozen=True)
class SectorMetric:
    """Inputs of a sector metric and what its signs are counted on.

    A multiple counts the signs of its denominator, a margin those of its numerator, growth those of the
    companies' growth. ``breadth`` is the share of positive signs; without a denominator it counts the
    numerator's."""

    numerator: str
    denominator: str | None = None
    kind: str = "margin"  # or multiple, growth
    breadth: bool = False


@dataclass(frozen=True)
class Policy:
    """Gates of comparability, all by >=."""

    least_contributors: int = 3
    issuer_coverage: float = 0.6
    cap_coverage: float = 0.6


METRICS = {
    "price_earnings": SectorMetric("cap", "income", "multiple"),
    "price_sales": SectorMetric("cap", "revenue", "multiple"),
    "price_fcf": SectorMetric("cap", "fcf", "multiple"),
    "operating_margin": SectorMetric("operating_income", "revenue"),
    "net_margin": SectorMetric("income", "revenue"),
    "gross_margin": SectorMetric("gross", "revenue"),
    "fcf_margin": SectorMetric("fcf", "revenue"),
    "revenue_growth": SectorMetric("revenue", "prior_revenue", "growth"),
    "growth_breadth": SectorMetric("revenue", "prior_revenue", "growth", breadth=True),
    "profit_breadth": SectorMetric("income", breadth=True),
    "cash_breadth": SectorMetric("fcf", breadth=True),
}

#: Basis that an input's evidence must have; other flows are consolidated (fixed values).
BASES = {"cap": "common_equity", "income": "income_available_common", "fcf": "cash_ppe_fcf"}


def evidence_issues(e: Column, basis: Column | str, evaluated: Column, instant: bool = False, need_precision: bool = True) -> Column:
    """Why an evidence value cannot be used, by the struct ``e`` (value, absolute_error, currency, basis,
    input_hash, usable, period_start, period_end, flags): its own blocking flags, hash, currency, basis,
    precision, and exact date (an instant) or twelve whole months up to the evaluation (a flow)."""
    basis = F.lit(basis) if isinstance(basis, str) else basis
    start, end, error = e["period_start"], e["period_end"], e["absolute_error"]
    found = {
        "evidence_unusable": ~F.coalesce(e["usable"], F.lit(False)),
        "evidence_hash_invalid": ~F.coalesce(e["input_hash"].rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "evidence_value_invalid": e["value"].isNull(),
        "unsupported_currency": ~e["currency"].eqNullSafe(F.lit("USD")),
        "incompatible_evidence_basis": ~e["basis"].eqNullSafe(basis),
        "source_precision_unknown": error.isNull() & F.lit(need_precision),
        "source_precision_invalid": error < 0,
    }
    if instant:
        found["incompatible_equity_date"] = start.isNotNull() | ~end.eqNullSafe(evaluated)
    else:
        found["unsupported_flow_period"] = ~F.coalesce((end <= evaluated) & (scalar.month_span(start, end) == 12), F.lit(False))
    return flags.union(flags.blocking(e["flags"], flags.METRIC_INFORMATIONAL), flags.reasons(**found))


def one_snapshot(companies: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each issuer of a group (``keys`` end in the issuer), with ``snapshot_issues``.

    Equal rows are one snapshot; rows that differ are a conflict, in which none is chosen: the issuer stays on
    the roster and nothing of it is used.
    """
    if "issuer" not in companies.columns or "snapshot_issues" in companies.columns:
        return companies
    others = [c for c in companies.columns if c not in keys]
    found = companies.withColumn("_sign", F.xxhash64(*others)).groupBy(*keys).agg(F.min("_sign").alias("_low"), F.max("_sign").alias("_high"), *[F.first(c).alias(c) for c in others])
    issues = F.when(F.col("_low") != F.col("_high"), F.array(F.lit("conflicting_issuer_snapshots")))
    return found.withColumn("snapshot_issues", issues).drop("_low", "_high")


def sound_cap(companies: DataFrame, cap: str = "cap") -> Column:
    """Whether a cap is known: positive, without issues of its own or of its snapshot."""
    issues = [F.coalesce(F.size(_or_null(companies, c, "array<string>")), F.lit(0)) <= 0 for c in (f"{cap}_issues", "snapshot_issues")]
    return F.coalesce(F.col(cap) > 0, F.lit(False)) & issues[0] & issues[1]


def _or_null(companies: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in companies.columns else F.lit(None).cast(kind)


def assessed(companies: DataFrame, metric: SectorMetric, name: str = "m") -> DataFrame:
    """Adds a struct ``name`` to each roster row: num, den, error, sign, complete (K), valid (the company's
    own ratio counts), in_total, ratio, reasons (not in the total) and ratio_reasons (not in a distribution).

    ``name`` is the metric in ``applicable``, the profile's list, where there is such a column; flows whose
    ``<input>_period`` differ are incompatible. Absolute errors are read from ``<denominator>_error`` and evidence issues from ``<input>_issues``
    where there are such columns; a missing error counts as none."""
    num = F.col(metric.numerator)
    den = F.col(metric.denominator) if metric.denominator else F.lit(None).cast("decimal(38,4)")
    inputs = [c for c in (metric.numerator, metric.denominator) if c]
    own = [_or_null(companies, f"{c}_issues", "array<string>") for c in inputs]
    if "applicable" in companies.columns:
        own.append(flags.reasons(unsupported_profile=~F.array_contains("applicable", name)))
    spans = [F.col(f"{c}_period") for c in inputs if c not in ("cap", "prior_revenue") and f"{c}_period" in companies.columns]
    if len(spans) > 1:
        own.append(flags.reasons(incompatible_periods=F.size(F.array_distinct(F.array(*spans))) > 1))
    issues = flags.union(
        *[F.coalesce(c, F.array().cast("array<string>")) for c in own],
        flags.reasons(company_snapshot_missing=F.forall(F.array(*[F.col(c).isNull() for c in inputs]), lambda x: x), input_missing=F.exists(F.array(*[F.col(c).isNull() for c in inputs]), lambda x: x)),
    )
    issues = F.when(F.array_contains(issues, "company_snapshot_missing"), F.array_remove(issues, "input_missing")).otherwise(issues)
    if metric.numerator == "cap":
        issues = F.when((F.size(issues) == 0) & (num <= 0), F.array(F.lit("market_cap_nonpositive"))).otherwise(issues)
    rejected = _or_null(companies, "snapshot_issues", "array<string>")
    issues = F.when(F.coalesce(F.size(rejected), F.lit(0)) > 0, rejected).otherwise(issues)
    complete = F.size(issues) == 0
    error = F.coalesce(_or_null(companies, f"{metric.denominator}_error", "decimal(38,4)"), F.lit(0))
    dividend = num - den if metric.kind == "growth" else num
    ratio = scalar.ratio(dividend, den)
    if metric.denominator:
        why = F.when(den <= 0, "company_denominator_nonpositive").when(den <= error, "company_denominator_indistinguishable_from_zero")
        valid = complete & why.isNull()
    else:
        why, valid = F.lit(None).cast("string"), complete
    in_total = valid if metric.kind == "growth" else complete
    sign = F.when(valid, ratio) if metric.kind == "growth" else (den if metric.kind == "multiple" else num)
    unusable = F.when(complete, F.when(valid, F.array().cast("array<string>")).otherwise(F.array(why))).otherwise(issues)
    struct = F.struct(
        num.alias("num"), den.alias("den"), error.cast("decimal(38,4)").alias("error"), sign.cast("double").alias("sign"), complete.alias("complete"), valid.alias("valid"), in_total.alias("in_total"),
        F.when(valid, ratio).alias("ratio"), F.when(in_total, F.array().cast("array<string>")).otherwise(unusable if metric.kind == "growth" else issues).alias("reasons"), unusable.alias("ratio_reasons"),
    )
    return companies.withColumn(name, struct)


def _values(metric: SectorMetric, m: str) -> list[Column]:
    """Aggregates of one metric over the struct ``m``: sums and counts of both cohorts."""
    c = lambda f: F.col(f"{m}.{f}")
    known = F.bool_and("_sound_cap")
    ends = F.array("period_end", "prior_end") if metric.kind == "growth" else F.array("period_end")
    out = {
        "n": F.count("*"), "k": F.count_if(c("complete")), "v": F.count_if(c("in_total")), "v_ratio": F.count_if(c("valid")),
        "total_num": F.sum(F.when(c("in_total"), c("num"))), "total_den": F.sum(F.when(c("in_total"), c("den"))), "total_error": F.sum(F.when(c("in_total"), c("error"))),
        "mean": F.avg(c("ratio")), "q": F.percentile(c("ratio"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
        "positive": F.count_if(c("in_total") & (c("sign") > 0)), "zero": F.count_if(c("in_total") & (c("sign") == 0)), "negative": F.count_if(c("in_total") & (c("sign") < 0)),
        "zero_denominators": F.count_if(c("complete") & (c("den") == 0)),
        "full_cap": F.when(known, F.sum("cap")), "cap_in_total": F.when(known, F.sum(F.when(c("in_total"), F.col("cap")))), "cap_in_ratio": F.when(known, F.sum(F.when(c("valid"), F.col("cap")))),
        "first_end": F.min(F.when(c("in_total"), F.array_min(ends))), "last_end": F.max(F.when(c("in_total"), F.array_max(ends))),
        "first_quote": F.min(F.when(c("in_total"), F.col("cap_date"))), "last_quote": F.max(F.when(c("in_total"), F.col("cap_date"))),
        "roster_complete": F.bool_and("roster_complete"),
    }
    return [v.alias(k) for k, v in out.items()]


def sector_values(companies: DataFrame, by: list[str], metrics: dict[str, SectorMetric], policy: Policy = Policy()) -> DataFrame:
    """One row for each group and metric, all metrics from one aggregation: one shuffle.

    n is the roster, k those with complete inputs, v those in the total (growth also asks for a valid
    company growth), v_ratio those in the mean and the percentiles. Each method's coverage and gate go by
    its own cohort. Where there is an issuer, a group has one snapshot of each (:func:`one_snapshot`); the
    full cap is known only if every issuer's is, without issues. Optional columns: cap_date, prior_end,
    roster_complete, errors and issues of inputs, cap_issues, snapshot_issues, applicable, periods.
    """
    for name, kind in (("cap_date", "date"), ("prior_end", "date")):
        companies = companies.withColumn(name, _or_null(companies, name, kind))
    companies = companies.withColumn("roster_complete", F.coalesce(_or_null(companies, "roster_complete", "boolean"), F.lit(True)))
    rows = one_snapshot(companies, [*by, "issuer"])
    rows = rows.withColumn("_sound_cap", sound_cap(rows))
    for name, metric in metrics.items():
        rows = assessed(rows, metric, name)
    every = rows.groupBy(*by).agg(*[F.struct(*_values(metric, name)).alias(name) for name, metric in metrics.items()])
    long = every.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(m.kind).alias("kind"), F.lit(m.breadth).alias("is_breadth"), F.col(f"{name}.*")) for name, m in metrics.items()])).alias("s")).select(*by, "s.*")
    dividend = F.when(F.col("kind") == "growth", F.col("total_num") - F.col("total_den")).otherwise(F.col("total_num"))
    breadth = F.when(F.col("v") > 0, F.col("positive") / F.col("v"))
    total = F.when((F.col("total_den") > 0) & (F.col("total_den") > F.col("total_error")), scalar.ratio(dividend, F.col("total_den")))
    long = long.withColumns({"total": F.when(F.col("is_breadth"), breadth).otherwise(total), "p25": F.get("q", F.lit(0)), "median": F.get("q", F.lit(1)), "p75": F.get("q", F.lit(2)), "breadth": breadth, "issuer_coverage": F.col("k") / F.col("n"), "ratio_eligibility": F.when(F.col("k") > 0, F.col("v_ratio") / F.col("k"))})
    gates = {}
    for method, v, cap, value in (("", "v", "cap_in_total", "total"), ("_ratio", "v_ratio", "cap_in_ratio", "median")):
        share = scalar.ratio(F.col(cap), F.col("full_cap"))
        gates[f"cap_coverage{method}"] = share
        gates[f"comparable{method}"] = F.col("roster_complete") & F.col(value).isNotNull() & (F.col(v) >= policy.least_contributors) & (F.col("issuer_coverage") >= policy.issuer_coverage) & F.coalesce(share >= policy.cap_coverage, F.lit(False))
    why = flags.reasons(
        no_contributors=F.col("v") == 0, denominator_nonpositive=~F.col("is_breadth") & (F.col("v") > 0) & (F.col("total_den") <= 0),
        denominator_indistinguishable_from_zero=~F.col("is_breadth") & (F.col("total_den") > 0) & (F.col("total_den") <= F.col("total_error")), full_capitalization_unknown=F.col("full_cap").isNull(),
        small_sample=F.col("v") < policy.least_contributors, partial_sector_universe=~F.col("roster_complete"), limited_coverage=~F.col("comparable"),
    )
    return long.withColumns(gates).withColumn("flags", why).drop("q", "kind", "is_breadth")


def roster_companies(roster: DataFrame, snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Every roster row with its snapshot, or with nulls: an absent company stays visible."""
    return roster.join(snapshots, keys, "left")


LEVELS = ("industry", "sector", "market")


def multi_level(companies: DataFrame, by: list[str], metrics: dict[str, SectorMetric], policy: Policy = Policy()) -> DataFrame:
    """Industry, sector and market values, each computed from companies: every row goes to its three groups."""
    up = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("sector") if k < 2 else F.lit(None).cast("int")).alias("in_sector"), (F.col("industry") if k < 1 else F.lit(None).cast("int")).alias("in_industry")) for k in range(3)]))
    rows = one_snapshot(companies, [*by, "issuer"]).withColumn("up", up)
    found = sector_values(rows.withColumns({"level": F.col("up.level"), "in_sector": F.col("up.in_sector"), "in_industry": F.col("up.in_industry")}), [*by, "level", "in_sector", "in_industry"], metrics, policy)
    name = F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return found.withColumns({"level": name, "sector": F.col("in_sector"), "industry": F.col("in_industry")}).drop("in_sector", "in_industry")


def leaders(rows: DataFrame, by: list[str], cap: str = "cap", many: int = 5) -> DataFrame:
    """rank of the largest of each group, ties by issuer; each task keeps ``many`` rows of a group before the shuffle."""
    ranked = rows.filter(F.col(cap) > 0).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(cap), "issuer")))
    return ranked.filter(F.col("rank") <= many).select(*by, "issuer", cap, "rank")


def known_caps(rows: DataFrame, by: list[str], cap: str = "cap") -> DataFrame:
    """The full cap of the groups in which every one is known."""
    found = rows.groupBy(*by).agg(F.bool_and(sound_cap(rows, cap)).alias("known"), F.sum(cap).alias("full"))
    return found.filter("known").select(*by, "full")


def top_by_cap(rows: DataFrame, by: list[str], many: int = 5) -> DataFrame:
    """rank within each group by cap; groups with an unknown cap give no row."""
    rows = one_snapshot(rows, [*by, "issuer"])
    return leaders(rows, by, "cap", many).join(known_caps(rows, by), by).drop("full")


def concentration(companies: DataFrame, by: list[str], many: int = 5, policy: Policy = Policy()) -> DataFrame:
    """Share of cap in today's largest companies, and total growth with and without those that were the
    largest at the prior date.

    All three are null unless the roster is complete and no snapshot rejected, as the largest of a known part
    are not the largest; a share needs every cap of its date known without issues. Snapshots are stored once
    for the four readings; both growths come from one aggregation, the second of columns that are null for
    the leaders."""
    rows = stored(one_snapshot(companies, [*by, "issuer"]), "snapshots")
    whole = F.coalesce(_or_null(rows, "roster_complete", "boolean"), F.lit(True)) & (F.coalesce(F.size(_or_null(rows, "snapshot_issues", "array<string>")), F.lit(0)) <= 0)
    known = rows.groupBy(*by).agg(F.bool_and(whole).alias("whole"), F.bool_and(sound_cap(rows)).alias("known"), F.bool_and(sound_cap(rows, "prior_cap")).alias("known_then"), F.sum("cap").alias("full"))
    held = leaders(rows, by, "cap", many).groupBy(*by).agg(F.sum("cap").alias("held"))
    gone = leaders(rows, by, "prior_cap", many).select(*by, "issuer", F.lit(True).alias("_gone"))
    rest = {f"rest_{c}": F.when(F.col("_gone").isNull(), F.col(c)) for c in ("revenue", "prior_revenue", "prior_revenue_error") if c in rows.columns}
    marked = rows.join(gone, [*by, "issuer"], "left").withColumns(rest)
    both = sector_values(marked, by, {"growth": METRICS["revenue_growth"], "rest": SectorMetric("rest_revenue", "rest_prior_revenue", "growth")}, policy)
    growth = both.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("total"))).alias(m) for m in ("growth", "rest")])
    out = growth.join(known, by).join(held, by, "left")
    return out.select(*by, F.when(F.col("whole") & F.col("known"), scalar.ratio(F.col("held"), F.col("full"))).alias("top_share"), F.when(F.col("whole"), F.col("growth")).alias("growth"), F.when(F.col("whole") & F.col("known_then"), F.col("rest")).alias("growth_without_top"))


def histogram(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts over equal widths, left-closed, the last closed; a group of one value has one bin."""
    there = rows.filter(F.col(value).isNotNull())
    ends = there.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    spread = there.join(ends, by)
    place = F.least(F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins).cast("int"), F.lit(bins - 1))
    place = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(place)
    return spread.withColumn("bin", place).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.min("high").alias("high"))


def exclusion_counts(rows: DataFrame, by: list[str], reasons: str = "reasons") -> DataFrame:
    return rows.select(*by, F.explode(reasons).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def membership_at(issuers: DataFrame, assignments: DataFrame, dates: DataFrame, known_before: Column) -> DataFrame:
    """The class of each issuer on each date, by what was known then; every issuer and date gives a row.

    ``assignments`` (issuer, class, effective_from, effective_to, known_at) count where the date is in
    [from, to) and they were known by the end of that day (UTC) and by ``known_before``. None is
    ``classification_unavailable``; two at once are a conflict, never a choice. The dates of a request
    are few: they go to each assignment as an array, and rows are made for matching dates only.
    """
    every = scalar.asked_for(dates, "as_of", "dates")
    inside = assignments.filter(F.col("known_at") <= known_before).crossJoin(every)
    ends = F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
    fits = F.filter("dates", lambda d: (F.col("effective_from") <= d) & (d < ends) & (F.col("known_at") < F.date_add(d, 1)))
    held = inside.select("issuer", "class", F.explode(fits).alias("as_of"))
    asked = issuers.select("issuer").distinct().crossJoin(every).select("issuer", F.explode("dates").alias("as_of"), F.lit(None).cast("string").alias("class"))
    found = held.select("issuer", "as_of", "class").unionByName(asked).groupBy("issuer", "as_of").agg(F.count_distinct("class").alias("classes"), F.min("class").alias("class"))
    reason = F.when(F.col("classes") == 0, "classification_unavailable").when(F.col("classes") > 1, "classification_conflict")
    return found.select("issuer", "as_of", F.when(F.col("classes") == 1, F.col("class")).alias("class"), reason.alias("reason"))


def display_status(value: Column, codes: Column, comparable: Column) -> Column:
    """eligible or limited with a value, else the gravest of stale, unsupported, not meaningful, missing."""

    def has(part: str) -> Column:
        return F.exists(codes, lambda c: c.contains(part))

    return F.when(value.isNotNull(), F.when(comparable, "eligible").otherwise("limited")).when(has("stale"), "stale").when(has("unsupported"), "unsupported").when(has("nonpositive") | has("indistinguishable"), "not_meaningful").otherwise("missing")


def growth_observations(total: Column, median: Column, positive: Column, zero: Column, negative: Column, v: Column, comparable: Column) -> Column:
    """What growth in total, of the median company and in breadth say together; nothing unless comparable."""
    aggregate = F.when((total > 0) & (negative * 2 > v), "aggregate_grew_most_declined").when(total > 0, "aggregate_expanding").when(total < 0, "aggregate_contracting").otherwise("aggregate_unchanged")
    typical = F.when(median > 0, "median_grew").when(median < 0, "median_declined").otherwise("median_unchanged")
    counts = F.concat_ws("/", positive, zero, negative, v)
    return F.when(comparable & total.isNotNull() & median.isNotNull(), F.array(aggregate, typical, counts)).otherwise(F.array().cast("array<string>"))


def axis_ticks(rows: DataFrame, by: list[str], value: str, many: int = 5) -> DataFrame:
    """The domain of a value with zero in it, 5 % above (and below where it is negative), and evenly
    spaced ticks. Values that are all zero give 0 to 1."""
    low, high = F.least(F.coalesce(F.min(value), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(F.max(value), F.lit(0.0)), F.lit(0.0))
    ends = rows.groupBy(*by).agg(low.alias("low"), high.alias("high"))
    pad, flat = (F.col("high") - F.col("low")) / 20, F.col("low") == F.col("high")
    domain = ends.select(*by, F.when(F.col("low") < 0, F.col("low") - pad).otherwise(F.col("low")).alias("start"), F.when(flat, F.lit(1.0)).otherwise(F.col("high") + pad).alias("stop"))
    step = (F.col("stop") - F.col("start")) / (many - 1)
    return domain.select(*by, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.col("start") + i * step)).alias("tick", "value"))


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 in ``order``.

    Ranges of the order are numbered apart, each from the number of rows before it. They are stored once,
    as drawing the ranges anew could deal rows differently.
    """
    path = work_dir(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    before, starts = 0, []
    for r in stored.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["count"]
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _before long"))
    numbered = stored.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return numbered.join(first, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_range", "_before")


def exported(records: DataFrame, by: list[str]) -> DataFrame:
    """``records`` written as a bundle, a folder for each value of ``by``, and read back with its own types."""
    path = work_dir(records.sparkSession, "bundle")
    records.repartition(*by).write.partitionBy(*by).parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)

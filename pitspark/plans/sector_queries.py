"""Sector queries over suppliers by nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.operators import sectors
from pitspark.plans.bridge import VIEWS
from pitspark.plans.registry import Data, query

VIEWS["pe_rows"] = """
    select *, coalesce(not conflict and cap_issue is null and cap > 0 and income is not null, false) as complete, coalesce(not conflict and cap_issue is null and cap > 0 and income > 0 and income > income_error, false) as valid,
      case when not conflict and cap_issue is null and cap > 0 and income > 0 and income > income_error then cast(cap as double) / cast(income as double) end as ratio
    from {rostered}"""
VIEWS["growth_rows"] = """
    select *, not conflict and prior_revenue is not null as complete, coalesce(not conflict and prior_revenue > 0 and prior_revenue > prior_revenue_error, false) as valid,
      case when not conflict and prior_revenue > 0 and prior_revenue > prior_revenue_error then cast(revenue - prior_revenue as double) / cast(prior_revenue as double) end as ratio
    from {rostered}"""
BY = ["sector", "qidx"]
PE, GROWTH = sectors.METRICS["price_earnings"], sectors.METRICS["revenue_growth"]


def r6(name: str, out: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(out or name)


def companies(t: Data) -> DataFrame:
    """Snapshots of issuers, some of them twice, with what speaks against their caps."""
    return t.snapshot_rows.withColumn("cap_issues", F.when(F.col("cap_issue").isNotNull(), F.array("cap_issue"))).drop("cap_issue")


def pe(t: Data) -> DataFrame:
    return sectors.assessed(sectors.one_snapshot(companies(t), [*BY, "issuer"]), PE).select("*", "m.ratio", "m.reasons", "m.ratio_reasons")


def values(t: Data, *names: str) -> DataFrame:
    return sectors.sector_values(companies(t), BY, {name: sectors.METRICS[name] for name in names})


def pe_values(t: Data) -> DataFrame:
    return values(t, "price_earnings").drop("metric")


def growth_values(t: Data) -> DataFrame:
    return values(t, "revenue_growth").drop("metric")


TOTAL_PE = """case when sum(case when complete then income end) > 0 and sum(case when complete then income end) > sum(case when complete then income_error end)
    then cast(sum(case when complete then cap end) as double) / cast(sum(case when complete then income end) as double) end"""
TOTAL_GROWTH = """case when sum(case when valid then prior_revenue end) > 0 and sum(case when valid then prior_revenue end) > sum(case when valid then prior_revenue_error end)
    then cast(sum(case when valid then revenue - prior_revenue end) as double) / cast(sum(case when valid then prior_revenue end) as double) end"""
BREADTH = "case when count(case when valid then 1 end) > 0 then cast(count(case when valid and ratio > 0 then 1 end) as double) / count(case when valid then 1 end) end"
COVER = "case when bool_and(coalesce(cap > 0 and cap_issue is null and not conflict, false)) then cast(sum(case when {cohort} then cap end) as double) / cast(sum(cap) as double) end"


@query("A5_sector_total", f"select sector, qidx, round({TOTAL_PE}, 6) as total from {{pe_rows}} group by 1, 2")
def a5(t: Data) -> DataFrame:
    return pe_values(t).select(*BY, r6("total"))


@query("A5_sector_growth_total", f"select sector, qidx, round({TOTAL_GROWTH}, 6) as total from {{growth_rows}} group by 1, 2")
def a5_growth(t: Data) -> DataFrame:
    return growth_values(t).select(*BY, r6("total"))


@query("A6_sector_mean", """select sector, qidx, round(avg(ratio), 4) as mean from {pe_rows} group by 1, 2""")
def a6(t: Data) -> DataFrame:
    return pe_values(t).select(*BY, F.round("mean", 4).alias("mean"))


@query("A7_sector_percentiles", """select sector, qidx, round(quantile_cont(ratio, 0.25), 6) as p25, round(quantile_cont(ratio, 0.5), 6) as median, round(quantile_cont(ratio, 0.75), 6) as p75 from {pe_rows} group by 1, 2""")
def a7(t: Data) -> DataFrame:
    return pe_values(t).select(*BY, r6("p25"), r6("median"), r6("p75"))


@query("A8_sector_breadth", f"""select sector, qidx, 'growth_breadth' as metric, round({BREADTH}, 6) as breadth from {{growth_rows}} group by 1, 2
  union all select sector, qidx, 'profit_breadth', round(cast(count(case when income > 0 and not conflict then 1 end) as double) / nullif(count(case when not conflict then income end), 0), 6) from {{rostered}} group by 1, 2
  union all select sector, qidx, 'cash_breadth', round(cast(count(case when cfo > capex and not conflict then 1 end) as double) / nullif(count(case when not conflict then fcf end), 0), 6) from {{rostered}} group by 1, 2""")
def a8(t: Data) -> DataFrame:
    return values(t, "growth_breadth", "profit_breadth", "cash_breadth").select(*BY, "metric", r6("total", "breadth"))


@query("A9_sector_counts", """select sector, qidx, 'price_earnings' as metric, count(*) as n, count(case when complete then 1 end) as k, count(case when complete then 1 end) as v, count(case when valid then 1 end) as v_ratio,
  count(case when complete and income > 0 then 1 end) as positive, count(case when complete and income < 0 then 1 end) as negative, count(case when complete and income = 0 then 1 end) as zero, count(case when complete and income = 0 then 1 end) as zero_denominators from {pe_rows} group by 1, 2
  union all select sector, qidx, 'operating_margin', count(*), count(case when not conflict then 1 end), count(case when not conflict then 1 end), count(case when not conflict and revenue > revenue_error then 1 end), count(case when not conflict and operating_income > 0 then 1 end), count(case when not conflict and operating_income < 0 then 1 end), count(case when not conflict and operating_income = 0 then 1 end), count(case when not conflict and revenue = 0 then 1 end) from {rostered} group by 1, 2
  union all select sector, qidx, 'revenue_growth', count(*), count(case when complete then 1 end), count(case when valid then 1 end), count(case when valid then 1 end), count(case when ratio > 0 then 1 end), count(case when ratio < 0 then 1 end), count(case when ratio = 0 then 1 end), count(case when complete and prior_revenue = 0 then 1 end) from {growth_rows} group by 1, 2""")
def a9(t: Data) -> DataFrame:
    return values(t, "price_earnings", "operating_margin", "revenue_growth").select(*BY, "metric", "n", "k", "v", "v_ratio", "positive", "negative", "zero", "zero_denominators")


@query("A10_sector_coverage", f"""select sector, qidx, round(cast(count(case when complete then 1 end) as double) / count(*), 6) as issuer_coverage,
  round({COVER.replace("{cohort}", "complete")}, 6) as cap_coverage, round({COVER.replace("{cohort}", "valid")}, 6) as cap_coverage_ratio, round(cast(count(case when valid then 1 end) as double) / nullif(count(case when complete then 1 end), 0), 6) as ratio_eligibility from {{pe_rows}} group by 1, 2""")
def a10(t: Data) -> DataFrame:
    return pe_values(t).select(*BY, r6("issuer_coverage"), r6("cap_coverage"), r6("cap_coverage_ratio"), r6("ratio_eligibility"))


GATE = "coalesce(count(case when {cohort} then 1 end) >= 3 and cast(count(case when complete then 1 end) as double) / count(*) >= 0.6 and " + COVER + " >= 0.6 and ({value}) is not null, false)"
VIEWS["pe_gate"] = f"""select sector, qidx, {GATE.replace("{cohort}", "complete").replace("{value}", TOTAL_PE)} as comparable, {GATE.replace("{cohort}", "valid").replace("{value}", "min(ratio)")} as comparable_ratio, round({TOTAL_PE}, 6) as total from {{pe_rows}} group by 1, 2"""


@query("A11_comparison_gate", "select sector, qidx, comparable, comparable_ratio, total from {pe_gate}")
def a11(t: Data) -> DataFrame:
    return pe_values(t).select(*BY, "comparable", "comparable_ratio", r6("total"))


@query("A12_date_ranges", """select sector, qidx, 'price_earnings' as metric, min(case when complete then period_end end) as first_end, max(case when complete then period_end end) as last_end, min(case when complete then cap_date end) as first_quote, max(case when complete then cap_date end) as last_quote from {pe_rows} group by 1, 2
  union all select sector, qidx, 'revenue_growth', min(case when valid then prior_end end), max(case when valid then period_end end), min(case when valid then cap_date end), max(case when valid then cap_date end) from {growth_rows} group by 1, 2""")
def a12(t: Data) -> DataFrame:
    return values(t, "price_earnings", "revenue_growth").select(*BY, "metric", "first_end", "last_end", "first_quote", "last_quote")


VIEWS["top_caps"] = """
    select sector, qidx, issuer, cap, rank from (select *, row_number() over (partition by sector, qidx order by cap desc, issuer) as rank,
      min(case when cap > 0 and cap_issue is null and not conflict then 1 else 0 end) over (partition by sector, qidx) as known from {rostered}) where known = 1 and rank <= 5"""
VIEWS["top_prior"] = """
    select sector, qidx, issuer, rank <= 5 as leads from (select sector, qidx, issuer, row_number() over (partition by sector, qidx order by prior_cap desc, issuer) as rank,
      min(case when prior_cap > 0 and not conflict then 1 else 0 end) over (partition by sector, qidx) as known from {rostered}) where known = 1"""


@query("A13_concentration", f"""select a.sector, a.qidx, t.top_share, a.growth, w.growth_without_top from (select sector, qidx, case when not bool_or(conflict) then round({TOTAL_GROWTH}, 6) end as growth from {{growth_rows}} group by 1, 2) a
  left join (select c.sector, c.qidx, round(cast(c.held as double) / cast(f.full_cap as double), 6) as top_share from (select sector, qidx, sum(cap) as held from {{top_caps}} group by 1, 2) c join (select sector, qidx, sum(cap) as full_cap from {{snapshots}} group by 1, 2) f on f.sector = c.sector and f.qidx = c.qidx) t on t.sector = a.sector and t.qidx = a.qidx
  left join (select g.sector, g.qidx, round({TOTAL_GROWTH}, 6) as growth_without_top from {{growth_rows}} g join {{top_prior}} p on p.sector = g.sector and p.qidx = g.qidx and p.issuer = g.issuer where not p.leads group by 1, 2) w on w.sector = a.sector and w.qidx = a.qidx""")
def a13(t: Data) -> DataFrame:
    return sectors.concentration(companies(t), BY).select(*BY, r6("top_share"), r6("growth"), r6("growth_without_top"))


@query("O1_top_five_by_cap", "select sector, qidx, issuer, cast(cap as double) as cap, cast(rank as int) as rank from {top_caps}")
def o1(t: Data) -> DataFrame:
    return sectors.top_by_cap(companies(t), BY).select(*BY, "issuer", F.col("cap").cast("double").alias("cap"), "rank")


@query("A14_histogram", """with g as (select sector, qidx, ratio, min(ratio) over (partition by sector, qidx) as low, max(ratio) over (partition by sector, qidx) as high from {pe_rows} where ratio is not null)
  select sector, qidx, cast(case when high = low then 0 else least(floor((ratio - low) / (high - low) * 8), 7) end as int) as bin, count(*) as n, round(min(low), 6) as low, round(min(high), 6) as high from g group by 1, 2, 3""")
def a14(t: Data) -> DataFrame:
    return sectors.histogram(pe(t), BY, "ratio", 8).select(*BY, "bin", "n", r6("low"), r6("high"))


@query("A15_exclusion_reasons", """select sector, qidx, reason, count(*) as n from (
    select sector, qidx, 'conflicting_issuer_snapshots' as reason from {rostered} where conflict
    union all select sector, qidx, cap_issue from {rostered} where not conflict and cap_issue is not null
    union all select sector, qidx, 'company_denominator_nonpositive' from {rostered} where not conflict and cap_issue is null and cap > 0 and income <= 0
    union all select sector, qidx, 'company_denominator_indistinguishable_from_zero' from {rostered} where not conflict and cap_issue is null and cap > 0 and income > 0 and income <= income_error
    union all select sector, qidx, 'market_cap_nonpositive' from {rostered} where not conflict and cap_issue is null and cap <= 0 and income is not null) group by 1, 2, 3""")
def a15(t: Data) -> DataFrame:
    return sectors.exclusion_counts(pe(t), BY, "ratio_reasons")


@query("A18_three_levels", f"""select qidx, sector, industry, case when grouping(industry) = 0 then 'industry' when grouping(sector) = 0 then 'sector' else 'market' end as level, 'price_earnings' as metric, count(*) as n, count(case when complete then 1 end) as k, count(case when valid then 1 end) as v_ratio,
  round({TOTAL_PE}, 6) as total, round(quantile_cont(ratio, 0.5), 6) as median from {{pe_rows}} group by grouping sets ((qidx, sector, industry), (qidx, sector), (qidx))
  union all select qidx, sector, industry, case when grouping(industry) = 0 then 'industry' when grouping(sector) = 0 then 'sector' else 'market' end, 'revenue_growth', count(*), count(case when complete then 1 end), count(case when valid then 1 end),
  round({TOTAL_GROWTH}, 6), round(quantile_cont(ratio, 0.5), 6) from {{growth_rows}} group by grouping sets ((qidx, sector, industry), (qidx, sector), (qidx))""")
def a18(t: Data) -> DataFrame:
    names = ("price_earnings", "revenue_growth")
    return sectors.multi_level(companies(t), ["qidx"], {n: sectors.METRICS[n] for n in names}).select("qidx", "sector", "industry", "level", "metric", "n", "k", "v_ratio", r6("total"), r6("median"))


VIEWS["quarters"] = "select distinct qidx from {flows}"


@query("J19_roster_left_join", """select i.issuer, q.qidx, round(cast(s.revenue as double), 2) as revenue, case when s.issuer is null then 'company_snapshot_missing' else '' end as reasons
  from {issuers} i cross join {quarters} q left join {snapshots} s on s.issuer = i.issuer and s.qidx = q.qidx""")
def j19(t: Data) -> DataFrame:
    roster = t.issuers.select("issuer").crossJoin(F.broadcast(t.quarters))
    joined = sectors.roster_companies(roster, t.snapshots.select("issuer", "qidx", "revenue", F.lit(True).alias("there")), ["issuer", "qidx"])
    codes = flags.reasons(company_snapshot_missing=F.col("there").isNull())
    return joined.select("issuer", "qidx", F.round(F.col("revenue").cast("double"), 2).alias("revenue"), flags.text(codes).alias("reasons"))


VIEWS["membership_dates"] = "select cast('1996-06-30' as date) as as_of union all select cast('1998-12-31' as date) union all select cast('2000-03-15' as date)"


@query("J9_membership_as_of", """select i.issuer, d.as_of, case when count(distinct m.class) = 1 then min(m.class) end as class, case when count(distinct m.class) = 0 then 'classification_unavailable' when count(distinct m.class) > 1 then 'classification_conflict' end as reason
  from (select c_custkey as issuer from {customer}) i cross join {membership_dates} d left join {membership} m on m.issuer = i.issuer and m.effective_from <= d.as_of and (m.effective_to is null or d.as_of < m.effective_to)
    and m.known_at < cast(d.as_of as timestamp) + interval 1 day and m.known_at <= timestamp '1999-06-30 00:00:00' group by 1, 2""")
def j9(t: Data) -> DataFrame:
    issuers = t.customer.select(F.col("c_custkey").alias("issuer"))
    return sectors.membership_at(issuers, t.membership, t.membership_dates, F.lit("1999-06-30 00:00:00").cast("timestamp"))


VIEWS["sector_growth"] = f"""select sector, qidx, {TOTAL_GROWTH} as total, quantile_cont(ratio, 0.5) as median, {GATE.replace("{cohort}", "valid").replace("{value}", TOTAL_GROWTH)} as comparable,
    count(case when ratio > 0 then 1 end) as positive, count(case when ratio = 0 then 1 end) as zero, count(case when ratio < 0 then 1 end) as negative, count(ratio) as v from {{growth_rows}} group by 1, 2"""


@query("J20_matched_metrics", """select g.sector, g.qidx, round(g.total, 6) as growth, p.total as price_earnings, concat_ws('|', case when not g.comparable then 'growth_limited' end, case when g.total is null then 'growth_unavailable' end, case when not p.comparable then 'price_earnings_limited' end, case when p.total is null then 'price_earnings_unavailable' end) as reasons
  from {sector_growth} g full outer join {pe_gate} p on g.sector = p.sector and g.qidx = p.qidx""")
def j20(t: Data) -> DataFrame:
    """Sectors with both metrics on one row, by one aggregation; what keeps one off the plot is in its reasons."""
    both = values(t, "revenue_growth", "price_earnings").groupBy(*BY).pivot("metric", ["revenue_growth", "price_earnings"]).agg(F.first("total").alias("total"), F.first("comparable").alias("comparable"))
    growth, price = F.col("revenue_growth_total"), F.col("price_earnings_total")
    codes = flags.reasons(growth_limited=~F.col("revenue_growth_comparable"), growth_unavailable=growth.isNull(), price_earnings_limited=~F.col("price_earnings_comparable"), price_earnings_unavailable=price.isNull())
    return both.select(*BY, r6("revenue_growth_total", "growth"), r6("price_earnings_total", "price_earnings"), flags.text(codes).alias("reasons"))


@query("F18_growth_observation", """select sector, qidx, case when comparable and total is not null and median is not null then concat_ws('|', case when total > 0 and negative * 2 > v then 'aggregate_grew_most_declined' when total > 0 then 'aggregate_expanding' when total < 0 then 'aggregate_contracting' else 'aggregate_unchanged' end,
  case when median > 0 then 'median_grew' when median < 0 then 'median_declined' else 'median_unchanged' end, concat_ws('/', cast(positive as varchar), cast(zero as varchar), cast(negative as varchar), cast(v as varchar))) else '' end as observations from {sector_growth}""")
def f18(t: Data) -> DataFrame:
    g = growth_values(t)
    said = sectors.growth_observations(F.col("total"), F.col("median"), F.col("positive"), F.col("zero"), F.col("negative"), F.col("v"), F.col("comparable") & F.col("comparable_ratio"))
    return g.select(*BY, flags.text(said).alias("observations"))


@query("F21_axis_ticks", """with e as (select sector, least(coalesce(min(ratio), 0), 0) as low, greatest(coalesce(max(ratio), 0), 0) as high from {growth_rows} group by 1), d as (select sector, case when low < 0 then low - (high - low) / 20 else low end as a, case when low = high then 1 else high + (high - low) / 20 end as b from e)
  select sector, cast(i as int) as tick, round(a + i * ((b - a) / 4), 6) as value from d cross join range(0, 5) t(i)""")
def f21(t: Data) -> DataFrame:
    return sectors.axis_ticks(sectors.assessed(sectors.one_snapshot(companies(t), [*BY, "issuer"]), GROWTH).select("sector", "m.ratio"), ["sector"], "ratio").select("sector", "tick", r6("value"))


VIEWS["evidence"] = """select o_orderkey as amount, case when o_orderstatus = 'P' then null else cast(o_totalprice as decimal(18,4)) end as value, case o_orderpriority when '2-HIGH' then null when '3-MEDIUM' then cast(-1 as decimal(18,4)) else cast(0.5 as decimal(18,4)) end as absolute_error,
    case o_orderpriority when '1-URGENT' then 'EUR' else 'USD' end as currency, case when o_custkey % 7 = 0 then 'segment' else 'income_available_common' end as basis, case when o_totalprice > 300000 then 'manual' else md5(cast(o_orderkey as varchar(20))) || md5(o_orderpriority) end as input_hash,
    o_orderstatus <> 'P' as usable, cast(case when day(o_orderdate) < 10 then o_orderdate else date_trunc('month', o_orderdate) end as date) as period_start, last_day(cast(cast(date_trunc('month', o_orderdate) as date) + interval 11 month as date)) as period_end, o_orderpriority as flag
  from {orders}"""


@query("P14_evidence_reasons", """select amount, concat_ws('|', case when flag = '4-NOT SPECIFIED' then 'carried_flag' end, case when input_hash = 'manual' then 'evidence_hash_invalid' end, case when not usable then 'evidence_unusable' end, case when value is null then 'evidence_value_invalid' end, case when basis = 'segment' then 'incompatible_evidence_basis' end,
  case when absolute_error < 0 then 'source_precision_invalid' end, case when absolute_error is null then 'source_precision_unknown' end, case when currency <> 'USD' then 'unsupported_currency' end, case when day(period_start) <> 1 or period_end > date '1998-12-31' then 'unsupported_flow_period' end) as reasons from {evidence}""")
def p14(t: Data) -> DataFrame:
    own = F.when(F.col("flag") == "4-NOT SPECIFIED", F.array(F.lit("carried_flag"), F.lit("revised_view"))).otherwise(F.array(F.lit("revised_view")))
    rows = t.evidence.select("amount", F.struct("value", "absolute_error", "currency", "basis", "input_hash", "usable", "period_start", "period_end", own.alias("flags")).alias("e"))
    codes = sectors.evidence_issues(F.col("e"), "income_available_common", F.lit("1998-12-31").cast("date"))
    return rows.select("amount", F.array_join(F.sort_array(codes), "|").alias("reasons"))


@query("P20_display_status", """select issuer, qidx, case when ratio is not null then 'eligible' when not conflict and cap_issue is null and (income <= income_error or cap <= 0) then 'not_meaningful' else 'missing' end as status from {pe_rows}""")
def p20(t: Data) -> DataFrame:
    return pe(t).select("issuer", "qidx", sectors.display_status(F.col("ratio"), F.col("ratio_reasons"), F.lit(True)).alias("status"))


@query("P22_company_search", """select s_suppkey as issuer, s_name as name from {supplier} where contains(lower(s_name), '#00000000')""")
def p22(t: Data) -> DataFrame:
    return t.supplier.filter(F.lower("s_name").contains("#00000000")).select(F.col("s_suppkey").alias("issuer"), F.col("s_name").alias("name"))


@query("P23_drill_down", "select issuer, industry from {issuers} where sector = 1")
def p23(t: Data) -> DataFrame:
    return t.issuers.filter("sector = 1").select("issuer", "industry")


@query("P24_topic_filter", "select event_id, user_id from {events} where user_id = 7 and event_type in ('error', 'purchase')")
def p24(t: Data) -> DataFrame:
    return t.events.filter((F.col("user_id") == 7) & F.col("event_type").isin("error", "purchase")).select("event_id", "user_id")


@query("O3_ordered_with_gaps_last", "select sector, qidx, total, cast(row_number() over (order by total desc nulls last, sector, qidx) as int) as place from {pe_gate}")
def o3(t: Data) -> DataFrame:
    return sectors.placed(pe_values(t).select(*BY, r6("total")), [F.desc_nulls_last("total"), F.asc("sector"), F.asc("qidx")], "place")


@query("S10_export_bundle", """select qidx, metric, method, sector, value from (
  select qidx, 'price_earnings' as metric, 'total' as method, sector, total as value from {pe_gate} union all select qidx, 'price_earnings', 'median', sector, round(quantile_cont(ratio, 0.5), 6) from {pe_rows} group by 1, 4
  union all select qidx, 'revenue_growth', 'total', sector, round(total, 6) from {sector_growth} union all select qidx, 'revenue_growth', 'median', sector, round(median, 6) from {sector_growth})""")
def s10(t: Data) -> DataFrame:
    """View records of each date, metric and method from one aggregation, written as a bundle of folders and read back."""
    found = values(t, "price_earnings", "revenue_growth").select("qidx", "sector", "metric", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), r6(m, "value")) for m in ("total", "median")])).alias("v"))
    return sectors.exported(found.select("qidx", "metric", "v.method", "sector", "v.value"), ["qidx", "metric", "method"])


def flagship(t: Data) -> DataFrame:
    """Price/earnings of each sector and quarter: total, distribution, coverage and gate."""
    return pe_values(t)

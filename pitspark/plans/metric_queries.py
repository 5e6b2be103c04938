"""Periods, company metrics and history over supplier quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.operators import history, inputs, metrics, periods, selection
from pitspark.plans.bridge import VIEWS
from pitspark.plans.registry import Data, query
from pitspark.plans.sector_queries import r6

KEYS = ["issuer", "qidx"]
FLOWS = ["revenue", "cost", "cfo", "capex", "income"]
VIEWS["gapped"] = "select * from {flows} where (issuer * 31 + qidx) % 13 <> 0"


def f2(name: str, out: str | None = None):
    return F.col(name).cast("double").alias(out or name)


@query("W5_four_quarters", """with x as (select issuer, period_end, count(*) over w as n, min(qidx) over w as first, qidx, sum(revenue) over w as r, sum(income) over w as i from {gapped} window w as (partition by issuer order by period_end rows between 3 preceding and current row))
  select issuer, period_end, cast(case when n = 4 and qidx - first = 3 then r end as double) as revenue, cast(case when n = 4 and qidx - first = 3 then i end as double) as income from x""")
def w5(t: Data) -> DataFrame:
    return periods.four_quarters(t.gapped, ["issuer"], ["revenue", "income"]).select("issuer", "period_end", f2("revenue"), f2("income"))


VIEWS["ytd"] = """select * from (select issuer, min(period_start) over (partition by issuer, year(period_end)) as start_, period_end as end_, count(*) over (partition by issuer, year(period_end) order by period_end) as quarters,
   sum(revenue) over (partition by issuer, year(period_end) order by period_end) as revenue, cap_date = period_end as edition from {gapped}) where month(start_) = 1 and quarter(end_) = quarters"""


def editions(t: Data) -> DataFrame:
    """Year-to-date amounts; those whose last line was shipped on the quarter's last day are of one edition."""
    last = t.gapped.select("issuer", F.col("period_end").alias("end"), (F.col("cap_date") == F.col("period_end")).alias("edition"))
    return periods.year_to_date(t.gapped, ["issuer"], ["revenue"]).join(last, ["issuer", "end"])


@query("J17_quarter_from_ytd", """select a.issuer, a.end_ as "end", cast(case when a.quarters = 1 then a.revenue when a.edition = b.edition then a.revenue - b.revenue end as double) as revenue from {ytd} a left join {ytd} b on a.issuer = b.issuer and a.start_ = b.start_ and a.quarters = b.quarters + 1""")
def j17(t: Data) -> DataFrame:
    return periods.quarter_from_year_to_date(editions(t), ["issuer"], "revenue", ("edition",)).select("issuer", "end", f2("revenue"))


@query("J16_annual_bridge", """select a.issuer, a.end_ as "end", cast(case when a.edition = b.edition and a.edition = w.edition then w.revenue + a.revenue - b.revenue end as double) as revenue from {ytd} a join {ytd} b on a.issuer = b.issuer and year(a.end_) = year(b.end_) + 1 and a.quarters = b.quarters join {ytd} w on w.issuer = a.issuer and year(a.end_) = year(w.end_) + 1 and w.quarters = 4 where a.quarters < 4""")
def j16(t: Data) -> DataFrame:
    return periods.annual_bridge(editions(t), ["issuer"], "revenue", ("edition",)).select("issuer", "end", f2("revenue"))


@query("J15_comparable_period", """select a.issuer, a.period_end, cast(b.revenue as double) as prior, round(case when b.revenue > 0 then cast(a.revenue - b.revenue as double) / cast(b.revenue as double) end, 6) as growth from {gapped} a left join {gapped} b on a.issuer = b.issuer and a.qidx = b.qidx + 4""")
def j15(t: Data) -> DataFrame:
    return periods.compared(t.gapped, ["issuer"], "revenue").select("issuer", "period_end", f2("prior"), r6("growth"))


VIEWS["assets"] = "select issuer, period_end as at, cast(revenue * 3 as decimal(18,4)) as assets from {gapped}"


@query("J29_opening_and_closing", """select f.issuer, f.qidx, cast(o.assets as double) as opening, cast(c.assets as double) as closing from {flows} f left join {assets} o on o.issuer = f.issuer and o.at = f.period_start - 1 left join {assets} c on c.issuer = f.issuer and c.at = f.period_end""")
def j29(t: Data) -> DataFrame:
    return periods.balances(t.flows, t.assets, ["issuer"]).select(*KEYS, f2("opening"), f2("closing"))


@query("F6_return_on_assets", """select f.issuer, f.qidx, round(cast(f.income as double) / ((cast(o.assets as double) + cast(c.assets as double)) / 2), 6) as value, case when o.assets is null or c.assets is null then 'balance_missing' else '' end as reasons from {flows} f left join {assets} o on o.issuer = f.issuer and o.at = f.period_start - 1 left join {assets} c on c.issuer = f.issuer and c.at = f.period_end""")
def f6(t: Data) -> DataFrame:
    rows = periods.balances(t.flows, t.assets, ["issuer"])
    return metrics.metric(rows, "return_on_assets").select(*KEYS, r6("value"), flags.text(F.col("reasons")).alias("reasons"))


@query("J18_fiscal_calendar", """select g.issuer, g.qidx, case when g.issuer % 3 <> 0 then cast(g.qidx // 4 as int) end as fiscal_year, case when g.issuer % 3 <> 0 then cast(g.qidx % 4 + 1 as int) end as fiscal_quarter from {gapped} g""")
def j18(t: Data) -> DataFrame:
    reviewed = t.flows.filter("issuer % 3 <> 0").select("issuer", "period_start", "period_end", F.floor(F.col("qidx") / 4).cast("int").alias("fiscal_year"), (F.col("qidx") % 4 + 1).cast("int").alias("fiscal_quarter"))
    return periods.calendar_match(t.gapped, reviewed, ["issuer"]).select(*KEYS, "fiscal_year", "fiscal_quarter")


@query("W8_quarter_grid", """with e as (select issuer, min(qidx) as a, max(qidx) as b from {gapped} group by 1), g as (select issuer, unnest(range(a, b + 1)) as qidx from e)
  select g.issuer, last_day(make_date(cast(g.qidx // 4 as int), cast(g.qidx % 4 * 3 + 3 as int), 1)) as period_end, f.issuer is null as missing from g left join {gapped} f on f.issuer = g.issuer and f.qidx = g.qidx""")
def w8(t: Data) -> DataFrame:
    return periods.quarter_grid(t.gapped, ["issuer"])


@query("W9_gap_segments", """with x as (select issuer, period_end, case when coalesce(period_end - lag(period_end) over w > 100, false) or income < 0 or coalesce(lag(income < 0) over w, false) then 1 else 0 end as broken from {gapped} window w as (partition by issuer order by period_end))
  select issuer, period_end, cast(sum(broken) over (partition by issuer order by period_end) as bigint) as segment from x""")
def w9(t: Data) -> DataFrame:
    points = t.gapped.select("issuer", "period_end", F.when(F.col("income") >= 0, F.col("income")).alias("value"))
    return periods.segments(points, ["issuer"], "period_end", "value", 100).select("issuer", "period_end", "segment")


@query("F12_period_support", """select issuer, year, case when quarters <> 4 then 'unsupported' else 'months' end as kind, case when quarters <> 4 then 'unsupported' when odd = 0 then 'weeks_52' when odd = 1 then 'weeks_53' else 'unsupported' end as weeks
  from (select issuer, cast(qidx // 4 as int) as year, count(*) as quarters, count(case when income < 0 then 1 end) as odd from {flows} group by 1, 2)""")
def f12(t: Data) -> DataFrame:
    """Years as they are, and as if a quarter had 13 weeks, or 14 where it made a loss."""
    year = t.flows.withColumn("year", F.floor(F.col("qidx") / 4).cast("int")).groupBy("issuer", "year").agg(F.array_sort(F.collect_list(F.struct("qidx", "period_start", "period_end", (F.col("income") < 0).alias("loss")))).alias("q"))
    start = F.get("q", F.lit(0))["period_start"]
    weeks = F.transform("q", lambda x: F.when(x["loss"], 98).otherwise(91))
    ends = F.transform(F.sequence(F.lit(1), F.size("q")), lambda n: F.date_add(start, F.aggregate(F.slice(weeks, F.lit(1), n), F.lit(-1), lambda a, b: a + b)))
    return year.select("issuer", "year", periods.fiscal_year(F.transform("q", lambda x: x["period_end"]), start).alias("kind"), periods.fiscal_year(ends, start).alias("weeks"))


@query("F13_month_span", "select issuer, qidx, 3 as months from {flows}")
def f13(t: Data) -> DataFrame:
    return t.flows.select(*KEYS, scalar.month_span(F.col("period_start"), F.col("period_end")).alias("months"))


@query("F11_annual_amounts", "select issuer, qidx, cast(revenue as double) as revenue from {ttm} where qidx % 4 = 3")
def f11(t: Data) -> DataFrame:
    start = F.add_months(F.date_add("period_end", 1), -12)
    return t.ttm.filter((scalar.month_span(start, F.col("period_end")) == 12) & (F.month("period_end") == 12)).select(*KEYS, f2("revenue"))


@query("F14_summed_errors", "select issuer, count(case when cost > 20 * cfo then 1 end) as unknown, cast(case when count(case when cost > 20 * cfo then 1 end) = 0 then sum(error) end as double) as error from {gapped} group by 1")
def f14(t: Data) -> DataFrame:
    """Errors add up; one unknown error leaves the sum unknown."""
    error = F.when(F.col("cost") <= 20 * F.col("cfo"), F.col("error"))
    return t.gapped.groupBy("issuer").agg(F.count_if(error.isNull()).alias("unknown"), F.when(F.count_if(error.isNull()) == 0, F.sum(error)).cast("double").alias("error"))


def metric_sql(value: str, reasons: str) -> str:
    return f"select issuer, qidx, round({value}, 6) as value, {reasons} as reasons from {{snapshots}}"


def registered(name: str, metric: str, value: str, reasons: str, derive=None) -> None:
    @query(name, metric_sql(value, reasons))
    def run(t: Data) -> DataFrame:
        rows = t.snapshots if derive is None else derive(t.snapshots)
        return metrics.metric(rows, metric).select(*KEYS, r6("value"), flags.text(F.col("reasons")).alias("reasons"))


NONE = "''"
registered("F1_net_margin", "net_margin", "cast(income as double) / cast(revenue as double)", "case when abs(income) > revenue then 'extreme_margin' else '' end")
registered("F1_operating_margin", "operating_margin", "cast(operating_income as double) / cast(revenue as double)", "case when abs(operating_income) > revenue then 'extreme_margin' else '' end")
registered("F1_gross_margin", "gross_margin", "cast(revenue - cost as double) / cast(revenue as double)", "case when abs(revenue - cost) > revenue then 'extreme_margin' else '' end", lambda s: s.withColumn("gross", F.col("revenue") - F.col("cost")))
registered("F2_derived_gross_margin", "derived_gross_margin", "cast(revenue - cost as double) / cast(revenue as double)", "'gross_profit_derived'")
registered("F3_free_cash_flow", "free_cash_flow", "cast(cfo - capex as double)", NONE)
registered("F4_free_cash_flow_margin", "free_cash_flow_margin", "cast(cfo - capex as double) / cast(revenue as double)", NONE)
CURRENT = lambda s: s.withColumns({"current_assets": F.col("cfo"), "current_liabilities": F.col("capex")})
registered("F5_current_ratio", "current_ratio", "case when capex > 0 then cast(cfo as double) / cast(capex as double) end", "case when capex <= 0 then 'denominator_nonpositive' else '' end", CURRENT)
registered("F5_net_working_capital", "net_working_capital", "cast(cfo - capex as double)", NONE, CURRENT)
MULTIPLE = "concat_ws('|', case when {d} <= 0 then 'denominator_nonpositive' end, case when {d} > 0 and {d} <= {d}_error then 'denominator_within_error' end, case when cap <= 0 then 'market_cap_nonpositive' end)"
for _id, _metric, _den in (("F9_price_earnings", "price_earnings", "income"), ("F9_price_sales", "price_sales", "revenue"), ("F9_price_fcf", "price_fcf", "fcf")):
    registered(_id, _metric, f"case when cap > 0 and {_den} > {_den}_error then cast(cap as double) / cast({_den} as double) end", MULTIPLE.replace("{d}", _den))


@query("F7_revenue_growth", "select issuer, qidx, round(case when prior_revenue > prior_revenue_error then cast(revenue - prior_revenue as double) / cast(prior_revenue as double) end, 6) as value, case when prior_revenue is null then 'comparison_missing' when prior_revenue <= 0 then 'denominator_nonpositive' when prior_revenue <= prior_revenue_error then 'denominator_within_error' else '' end as reasons from {snapshots}")
def f7(t: Data) -> DataFrame:
    return metrics.metric(t.snapshots, "revenue_growth").select(*KEYS, r6("value"), flags.text(F.col("reasons")).alias("reasons"))


@query("F8_reported_amounts", " union all ".join(f"select issuer, qidx, '{c}' as concept, cast({c} as double) as value from {{flows}}" for c in FLOWS))
def f8(t: Data) -> DataFrame:
    return t.flows.unpivot(KEYS, [F.col(c).cast("double").alias(c) for c in FLOWS], "concept", "value")


@query("F10_balance_sheet_identity", "select issuer, qidx, case when abs(revenue - cost - cfo) <= case when qidx % 2 = 0 then 0.0000 else -1 end then 'balanced' else 'unbalanced' end as state from {flows}")
def f10(t: Data) -> DataFrame:
    error = F.when(F.col("qidx") % 2 == 0, F.lit(0)).otherwise(F.lit(-1)).cast("decimal(18,4)")
    return t.flows.select(*KEYS, metrics.identity_gap(F.col("revenue"), F.col("cost"), F.col("cfo"), error).alias("state"))


@query("F15_metric_status", """select issuer, qidx, case when first in ('valid', 'not_meaningful') and (qidx < 7985 or (qidx < 7990 and sector = 2)) then 'stale' else first end as status from (
  select issuer, qidx, sector, case when industry = 4 then case when cap > 60000 then 'invalid' else 'unsupported' end when industry = 5 then 'unsupported' when industry = 6 then 'inapplicable' when cap <= 0 or income <= income_error then case when cost > 20 * cfo then 'missing' else 'not_meaningful' end else 'valid' end as first from {snapshots}) s""")
def f15(t: Data) -> DataFrame:
    """One industry has no profile, one was not reviewed, one does not apply; costly companies have no precision."""
    rows = metrics.metric(t.snapshots, "price_earnings")
    industry = F.col("industry")
    problems = flags.reasons(unsupported_profile_instrument_basis=industry == 4, input_after_evaluation_cutoff=(industry == 4) & (F.col("cap") > 60000))
    applicable = F.when(industry == 5, F.lit(None).cast("boolean")).otherwise(industry != 6)
    found = metrics.status(F.col("value"), F.col("reasons"), (F.lit(7985) - F.col("qidx")) * 91, 0, applicable, problems, precise=F.col("cost") <= 20 * F.col("cfo"), overdue=(F.col("sector") == 2) & (F.col("qidx") < 7990))
    return rows.select(*KEYS, found.alias("status"))


SEEN = ["revenue_growth", "free_cash_flow", "free_cash_flow_margin", "operating_margin", "net_margin"]
VIEWS["seen"] = """select issuer, qidx, 'revenue_growth' as metric, case when prior_revenue > prior_revenue_error then cast(revenue - prior_revenue as double) / cast(prior_revenue as double) end as value, false as extreme from {snapshots}
  union all select issuer, qidx, 'free_cash_flow', case when capex >= 0 then cast(fcf as double) end, false from {snapshots} union all select issuer, qidx, 'free_cash_flow_margin', case when capex >= 0 then cast(fcf as double) / cast(revenue as double) end, false from {snapshots}
  union all select issuer, qidx, 'operating_margin', cast(operating_income as double) / cast(revenue as double), abs(operating_income) > revenue from {snapshots} union all select issuer, qidx, 'net_margin', cast(income as double) / cast(revenue as double), abs(income) > revenue from {snapshots}"""
VIEWS["rules"] = """select issuer, qidx, metric, value, extreme, case when metric = 'revenue_growth' then case when value > 0 then 'revenue_grew' when value < 0 then 'revenue_declined' when value = 0 then 'revenue_unchanged' end
    when value < 0 then case metric when 'operating_margin' then 'operating_loss' when 'net_margin' then 'consolidated_loss' else 'cash_spending_gap' end end as rule from {seen}"""


def seen(t: Data) -> DataFrame:
    return metrics.long_metrics(t.snapshots, SEEN, KEYS).withColumn("usable", F.col("value").isNotNull())


@query("F16_observations", "select issuer, qidx, metric, rule from {rules} where rule is not null")
def f16(t: Data) -> DataFrame:
    return metrics.observed(seen(t)).select(*KEYS, "metric", "rule")


VIEWS["assessed"] = """select s.issuer, s.qidx, case when s.cap <= 0 or s.income <= s.income_error then case when s.qidx < 7980 then 'stale' else 'not_meaningful' end when s.qidx < 7980 then 'stale' else 'valid' end as status from {snapshots} s"""


#: Industry 3 of seven does not apply; the market of an issuer with a negative account is not reviewed in early quarters.
VIEWS["metric_roster"] = "select q.qidx, i.issuer, case when s_acctbal < 0 and q.qidx < 7984 then null else i.industry % 7 <> 3 end as applicable from {issuers} i join {supplier} on s_suppkey = i.issuer cross join (select distinct qidx from {flows}) q"


@query("A16_status_counts", """select qidx, members, valid, not_meaningful, missing, 0::bigint as invalid, stale, unreviewed as unsupported, members - applicable - unreviewed as inapplicable, applicable, unreviewed, case when unreviewed = 0 and applicable > 0 then round(cast(valid + not_meaningful as double) / applicable, 6) end as covered
  from (select r.qidx, count(*) as members, count(case when applicable and a.status = 'valid' then 1 end) as valid, count(case when applicable and a.status = 'not_meaningful' then 1 end) as not_meaningful, count(case when applicable and a.status is null then 1 end) as missing, count(case when applicable and a.status = 'stale' then 1 end) as stale,
    count(case when applicable then 1 end) as applicable, count(case when applicable is null then 1 end) as unreviewed from {metric_roster} r left join {assessed} a on a.issuer = r.issuer and a.qidx = r.qidx group by 1)""")
def a16(t: Data) -> DataFrame:
    """Every status over the whole roster of issuers and quarters; quarters before twelve months are full are missing."""
    rows = metrics.metric(t.snapshots, "price_earnings")
    assessed = rows.select(*KEYS, metrics.status(F.col("value"), F.col("reasons"), (F.lit(7980) - F.col("qidx")) * 91, 0, F.lit(True)).alias("status"))
    return inputs.status_counts(assessed, t.metric_roster, ["qidx"], ["issuer"]).withColumn("covered", F.round("covered", 6))


@query("O2_review_topics", """with c as (select issuer, qidx, metric, rule, case rule when 'cash_spending_gap' then 'cash_generation' when 'revenue_declined' then 'revenue' else 'earnings' end as topic, case rule when 'cash_spending_gap' then 1 else 2 end as rank from {rules} where rule in ('cash_spending_gap', 'revenue_declined', 'operating_loss', 'consolidated_loss')
    union all select issuer, qidx, metric, case when value is null then 'data_review' else 'extreme_margin_review' end, case when value is null then 'data_availability' else 'extreme_margin' end, 0 from {seen} where value is null or extreme),
  g as (select issuer, qidx, topic, min(rank || ':' || rule) as first, array_to_string(list_sort(list_distinct(list(metric))), '|') as metrics from c group by 1, 2, 3)
  select * from (select issuer, qidx, topic, substr(first, 3) as rule, metrics, cast(row_number() over (partition by issuer, qidx order by first) as int) as place from g) where place <= 3""")
def o2(t: Data) -> DataFrame:
    return metrics.review_items(seen(t), KEYS).select(*KEYS, "topic", "rule", flags.text(F.col("metrics")).alias("metrics"), "place")


#: A line of an order as a selected input: its columns decide what is wrong with it.
VIEWS["input_rows"] = """select l_orderkey as request, l_linenumber as line, l_suppkey as issuer, case l_returnflag when 'N' then 'cash_from_operating_activities' when 'A' then 'capital_expenditures_ppe' else 'cost' end as concept, cast(round(l_discount * 100) as int) as d, cast(round(l_tax * 100) as int) as x, cast(l_quantity as int) as q,
    cast(l_extendedprice as decimal(18,4)) as value, cast(date_trunc('quarter', l_shipdate) as date) as quarter_start, cast(l_shipdate as date) as day, l_linestatus as link from {lineitem}"""


def input_parts(t: Data) -> DataFrame:
    d, x, q = F.col("d"), F.col("x"), F.col("q")
    rows = t.input_rows
    unit = F.when(d == 0, "shares").when(d == 1, "USD/shares").when(d == 2, "usd").otherwise("USD")
    numerators = F.when(d == 0, F.array(F.lit("xbrli:shares"))).when(d == 3, F.array(F.lit("iso4217:EUR"))).otherwise(F.array(F.lit("iso4217:USD")))
    descriptor = F.concat(F.lit('{"consolidation":"consolidated","instrument":null,"scope_evidence":"'), F.when(x == 3, " ").otherwise("statement"), F.lit('"}'))
    start = F.when(q == 1, F.date_add("day", 1)).otherwise(F.col("quarter_start"))
    return rows.select(
        "request", "line", "concept", "value", "link", "day", "quarter_start", d.alias("d"), x.alias("x"), q.alias("q"),
        F.struct(F.col("issuer").alias("issuer"), F.array(F.lit("cash_from_operating_activities"), F.lit("capital_expenditures_ppe")).alias("concepts"), F.col("quarter_start").alias("period"), F.when(d == 0, "shares").otherwise("USD").alias("unit"), F.when(d == 4, "EUR").alias("currency"), F.lit("consolidated").alias("scope"), F.array(F.col("request")).alias("captures"), F.lit("1998-06-30 12:00:00").cast("timestamp").alias("captured_before"), F.lit(None).cast("date").alias("filed_cutoff")).alias("asked"),
        F.struct(F.when(q > 45, F.add_months("quarter_start", 3)).otherwise(F.col("quarter_start")).alias("id"), F.lit("duration").alias("kind"), start.alias("start"), F.col("day").alias("end")).alias("period"),
        F.struct(unit.alias("key"), numerators.alias("numerators"), F.when(d == 1, F.array(F.lit("xbrli:shares"))).alias("denominators")).alias("unit"),
        F.struct(F.when((x == 0) & (F.col("link") == "O"), "segment").otherwise("consolidated").alias("id"), F.when(x == 1, F.col("issuer") + 1).otherwise(F.col("issuer")).alias("issuer"), F.lit("consolidated").alias("kind"), F.lit(None).cast("string").alias("instrument"), descriptor.alias("descriptor"), F.sha2(F.when(x == 2, F.reverse(descriptor)).otherwise(descriptor), 256).alias("sha256")).alias("scope"),
        F.struct("concept", F.when(q != 2, F.col("value")).alias("value"), F.when(q == 2, "missing").otherwise("observed").alias("status"), F.col("request").alias("capture"), F.concat(F.lpad(F.col("request").cast("string"), 10, "0"), F.when(x == 4, "/").otherwise("-24-00000"), "line").alias("accession"), F.col("day").alias("filed"),
                 F.when(x == 5, "https://user@host/a").otherwise("https://host/a").alias("source_url"), F.lit("/facts/0").alias("locator"), F.sha2(F.col("request").cast("string"), 256).alias("source_sha256"), F.lit("a:X").alias("tag"), F.col("value").cast("string").alias("text")).alias("fact"),
    )


@query("P15_input_context", """select request, line, concat_ws('|', case when concept = 'cost' then 'input_concept_mismatch' end, case when q = 2 then 'input_fact_not_observed' end, case when q = 1 then 'input_period_invalid' end, case when q > 45 then 'input_period_mismatch' end, case when x in (4, 5) or day > date '1998-06-30' then 'input_provenance_invalid' end,
  case when d = 4 then 'input_reporting_currency_mismatch' end, case when x in (2, 3) then 'input_scope_invalid' end, case when x = 1 or (x = 0 and link = 'O') then 'input_scope_mismatch' end, case when d in (2, 3) then 'input_unit_invalid' end, case when d in (1, 2) then 'input_unit_mismatch' end, case when q = 2 then 'input_value_invalid' end) as reasons from {input_rows}""")
def p15(t: Data) -> DataFrame:
    codes = inputs.input_issues(*map(F.col, ("asked", "period", "unit", "scope", "fact")))
    return input_parts(t).select("request", "line", flags.text(codes).alias("reasons"))


@query("P16_operand_compatibility", """select a.request, concat_ws('|', case when a.day <> b.day or a.quarter_start <> b.quarter_start then 'incompatible_periods' end, case when a.link <> b.link then 'incompatible_reporting_basis' end, case when a.concept not in ('cash_from_operating_activities', 'capital_expenditures_ppe') or b.concept not in ('cash_from_operating_activities', 'capital_expenditures_ppe') or a.x = 0 or b.x = 0 then 'incompatible_statement_family' end,
  case when a.u <> b.u or a.d in (1, 2) or b.d in (1, 2) then 'incompatible_units' end, case when a.q = 2 or b.q = 2 then 'source_input_unavailable' end, case when a.concept <> 'cash_from_operating_activities' or b.concept <> 'capital_expenditures_ppe' then 'unexpected_concept' end, case when a.d = 4 or b.d = 4 then 'unsupported_semantic_scope' end) as reasons
  from (select *, case d when 1 then 'USD/shares' when 2 then 'usd' else 'USD' end as u from {input_rows}) a join (select *, case d when 1 then 'USD/shares' when 2 then 'usd' else 'USD' end as u from {input_rows}) b on a.request = b.request and a.line = 1 and b.line = 2""")
def p16(t: Data) -> DataFrame:
    d = F.col("d")
    one = F.struct(
        "line", "concept", F.when(F.col("q") != 2, F.col("value")).alias("value"), F.array(F.lit("revised_view")).alias("issues"), F.lit("own").alias("history_key"), F.when(F.col("link") == "O", "us_gaap").otherwise("ifrs").alias("basis"), F.when(d == 1, "USD/shares").when(d == 2, "usd").otherwise("USD").alias("unit"),
        F.lit("duration").alias("kind"), F.col("quarter_start").alias("start"), F.col("day").alias("end"), F.col("request").alias("edition"), F.when((F.col("x") == 0) | ~F.col("concept").isin("cash_from_operating_activities", "capital_expenditures_ppe"), "notes").otherwise("cash_flow").alias("family"), F.when(d == 4, "segment").otherwise("consolidated").alias("scope"),
    )
    rows = input_parts(t).select("request", "line", one.alias("o"))
    first, second = (rows.filter(F.col("line") == k).select("request", F.col("o").alias(f"o{k}")) for k in (1, 2))
    pairs = first.join(second, "request").withColumn("operands", F.array("o1", "o2"))
    return pairs.select("request", flags.text(inputs.operand_issues(F.col("operands"), ["cash_from_operating_activities", "capital_expenditures_ppe"])).alias("reasons"))


@query("P17_numeric_limits", "select event_id, case when event_type = 'error' then false when event_type = 'click' then event_id % 2 = 0 else true end as within from {events}")
def p17(t: Data) -> DataFrame:
    """Errors have exponents out of bounds, every other click too many digits."""
    digits = F.repeat(F.lit("7"), F.when(F.col("event_id") % 2 == 0, 999).otherwise(1001).cast("int"))
    power = F.when(F.col("event_id") % 2 == 0, "E1000").otherwise("E-1003")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("1234.5"), power)).when(F.col("event_type") == "click", digits).otherwise(F.concat(F.lit("-0.00"), F.col("event_id"), F.lit("E900")))
    return t.events.select("event_id", inputs.within_limits(text).alias("within"))


@query("P18_denominator", "select issuer, qidx, concat_ws('|', case when income <= 0 then 'denominator_nonpositive' end, case when qidx % 5 = 0 then 'denominator_precision_unknown' end, case when income > 0 and qidx % 5 <> 0 and income <= 1000 then 'denominator_within_error' end) as reasons from {flows}")
def p18(t: Data) -> DataFrame:
    error = F.when(F.col("qidx") % 5 != 0, F.lit(1000))
    codes = scalar.denominator_reasons(F.col("income"), error)
    return t.flows.select(*KEYS, flags.text(F.filter(flags.normal(codes), lambda c: c.isNotNull())).alias("reasons")).withColumn("reasons", F.expr("array_join(array_sort(split(reasons, '[|]')), '|')"))


def flow_hash(name: str):
    return F.sha2(F.concat_ws(":", F.lit(name), "issuer", "qidx", F.col(name).cast("string")), 256)


HASH = "sha256('{c}:' || cast(issuer as varchar) || ':' || cast(qidx as varchar) || ':' || cast({c} as varchar))"


@query("P28_evidence_rows", f"select issuer, qidx, cast(case when capex >= 0 then fcf end as double) as value, cast(error * 2 as double) as error, sha256({HASH.format(c='cfo')} || '|' || {HASH.format(c='capex')}) as input_hash, cast(period_end + 1 - interval 12 month as date) as period_start, period_end, case when capex < 0 then 'capex_negative' else '' end as flags, capex >= 0 as usable from {{snapshots}}")
def p28(t: Data) -> DataFrame:
    """Free cash flow as an evidence value: both operands' errors add up."""
    codes = flags.reasons(capex_negative=F.col("capex") < 0)
    e = inputs.evidence(F.when(F.col("capex") >= 0, F.col("fcf")), F.col("error") * 2, [flow_hash("cfo"), flow_hash("capex")], F.col("period_end"), 12, codes, "cash_ppe_fcf")
    rows = t.snapshots.select(*KEYS, e.alias("e"))
    return rows.select(*KEYS, F.col("e.value").cast("double").alias("value"), F.col("e.absolute_error").cast("double").alias("error"), "e.input_hash", "e.period_start", "e.period_end", flags.text(F.col("e.flags")).alias("flags"), "e.usable")


@query("P29_operand_hashes", "select issuer, qidx, concat_ws('|', case when cap <= 0 or income < 0 then 'company_metric_input_mismatch' end, case when cap <= 0 then 'company_metric_input_missing' end) as reasons from {snapshots}")
def p29(t: Data) -> DataFrame:
    """A metric that was computed before its income was restated (here: a loss), or without a cap, is refused."""
    stale = F.sha2(F.lit("before"), 256)
    rows = t.snapshots
    declared = rows.select(*KEYS, F.lit("price_earnings").alias("metric"), F.array(F.lit("cap"), F.lit("income")).alias("fields"), F.array(flow_hash("cap"), F.when(F.col("income") < 0, stale).otherwise(flow_hash("income"))).alias("operand_hashes"))
    held = rows.filter("cap > 0").select(*KEYS, F.lit("cap").alias("field"), flow_hash("cap").alias("input_hash")).unionByName(rows.select(*KEYS, F.lit("income").alias("field"), flow_hash("income").alias("input_hash")))
    return inputs.accepted_metrics(declared, held, KEYS).select(*KEYS, flags.text(F.col("reasons")).alias("reasons"))


@query("U4_flag_sets", "select issuer, qidx, concat_ws('|', case when income < 0 then 'loss' end, case when fcf < 0 then 'outflow' end) as every, case when income < 0 and not fcf < 0 then 'loss' else '' end as only_first, not (income < 0) or fcf < 0 as subset from {snapshots}")
def u4(t: Data) -> DataFrame:
    a, b = flags.reasons(loss=F.col("income") < 0), flags.reasons(outflow=F.col("fcf") < 0)
    mapped = F.when(F.col("fcf") < 0, F.array(F.lit("loss"))).otherwise(F.array().cast("array<string>"))
    return t.snapshots.select(*KEYS, flags.text(flags.union(a, b)).alias("every"), flags.text(F.array_except(a, mapped)).alias("only_first"), flags.is_subset(a, mapped).alias("subset"))


@query("U3_exact_duplicates", "select text_hash, count(*) as copies, case when count(distinct lang) = 1 then min(lang) end as lang, case when count(distinct lang) > 1 then 'conflicting_duplicates' end as reason from (select md5(text) as text_hash, lang from {documents}) group by 1")
def u3(t: Data) -> DataFrame:
    """One row for each text; copies that differ in language are rejected."""
    return selection.without_duplicates(t.documents.select(F.md5("text").alias("text_hash"), "lang"), ["text_hash"], ["lang"])


VIEWS["points"] = """select issuer, period_end as quarter_end, qidx, cast(income as double) as value, md5(cast(revenue as varchar(40))) as input_hash, qidx * 10 as point_id from {flows} union all select issuer, period_end, qidx, cast(income as double), md5(cast(revenue as varchar(40))), qidx * 10 + 1 from {flows} where qidx % 5 = 0
  union all select issuer, period_end, qidx, cast(income as double) + 1, md5(cast(revenue as varchar(40))), qidx * 10 + 2 from {flows} where qidx % 11 = 0 union all select issuer, period_start, qidx, cast(income as double), md5(cast(revenue as varchar(40))), qidx * 10 + 3 from {flows} where qidx % 7 = 0
  union all select issuer, last_day(period_start), qidx, cast(income as double), md5(cast(cost as varchar(40))), qidx * 10 + 4 from {flows} where qidx % 7 = 1 union all select issuer, period_end, qidx, cast(income as double), md5(cast(cost as varchar(40))), qidx * 10 + 5 from {flows} where income < cfo / -5 union all select issuer, period_end, qidx, null, ' ', qidx * 10 + 6 from {flows} where qidx % 12 = 3"""
VIEWS["sampled"] = """with v as (select issuer as i, quarter_end as q, count(distinct (value, input_hash)) as variants from {points} group by 1, 2),
  r as (select p.*, concat_ws('|', case when variants > 1 then 'conflicting_quarter' end, case when trim(input_hash) = '' then 'missing_lineage' end, case when value is null then 'missing_value' end, case when (month(quarter_end), day(quarter_end)) not in ((3, 31), (6, 30), (9, 30), (12, 31)) then 'not_quarter_end' end) as own from {points} p join v on v.i = p.issuer and v.q = p.quarter_end)
  select issuer, quarter_end, qidx, value, point_id, case when own = '' and row_number() over (partition by issuer, quarter_end, own = '' order by point_id) > 1 then 'duplicate_sample' else own end as reasons from r"""


@query("W6_sample_rules", "select issuer, point_id, reasons from {sampled}")
def w6(t: Data) -> DataFrame:
    return sampled(t.once("flows")).select("issuer", "point_id", flags.text(F.col("reasons")).alias("reasons"))


def sampled(t: Data) -> DataFrame:
    """Points are made of flows in seven ways: give tables that hold the flows (:meth:`Data.once`)."""
    return history.sampled(t.points, ["issuer"])


VIEWS["band_dates"] = "select distinct issuer, period_end as as_of from {flows}"
VIEWS["bands"] = """select d.issuer, d.as_of, count(s.value) as samples, cast(datediff('quarter', d.as_of - interval 3 years, d.as_of) as int) as expected, case when count(s.value) >= 4 then quantile_cont(s.value, 0.25) end as p25, case when count(s.value) >= 4 then quantile_cont(s.value, 0.5) end as p50, case when count(s.value) >= 4 then quantile_cont(s.value, 0.75) end as p75, case when count(s.value) < 4 then 'insufficient_history' end as reason
  from {band_dates} d left join (select * from {sampled} where reasons = '') s on s.issuer = d.issuer and s.quarter_end <= d.as_of and s.quarter_end > d.as_of - interval 3 years group by 1, 2"""


def band_rows(t: Data) -> DataFrame:
    t = t.once("flows")
    return history.bands(sampled(t), t.band_dates, ["issuer"], 3, 4)


@query("A17_history_band", "select issuer, as_of, samples, expected, cast(expected - samples as bigint) as missing, round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75, reason from {bands}")
def a17(t: Data) -> DataFrame:
    return band_rows(t).select("issuer", "as_of", "samples", "expected", "missing", r6("p25"), r6("p50"), r6("p75"), "reason")


@query("A17_exclusions", """with e as (select d.issuer, d.as_of, p.quarter_end <= d.as_of - interval 3 years as outside, p.quarter_end > d.as_of as late, p.reasons from {band_dates} d join {sampled} p on p.issuer = d.issuer)
  select issuer, as_of, 'outside_window' as reason, count(*) as points from e where outside group by 1, 2 union all select issuer, as_of, 'after_as_of', count(*) from e where late group by 1, 2
  union all select issuer, as_of, r, count(*) from (select issuer, as_of, outside or late as away, unnest(string_split(reasons, '|')) as r from e) x where r <> '' and not (away and r in ('conflicting_quarter', 'duplicate_sample')) group by 1, 2, 3""")
def a17_exclusions(t: Data) -> DataFrame:
    t = t.once("flows")
    return history.exclusions(sampled(t), t.band_dates, ["issuer"], 3)


@query("F17_compared_to_history", "select b.issuer, b.as_of, case when b.p25 is null then 'unavailable' when cast(f.income as double) < b.p25 then 'below' when cast(f.income as double) > b.p75 then 'above' else 'within' end as place from {bands} b join {flows} f on f.issuer = b.issuer and f.period_end = b.as_of")
def f17(t: Data) -> DataFrame:
    t = t.once("flows")
    joined = band_rows(t).join(t.flows.select("issuer", F.col("period_end").alias("as_of"), F.col("income").cast("double").alias("now")), ["issuer", "as_of"])
    return joined.select("issuer", "as_of", history.compared_to_band(F.col("now")).alias("place"))


@query("W12_sector_history_points", "select b.issuer, b.as_of, round(b.p50, 6) as middle, case when i.cap < 0 then 'band_suppressed' when b.p50 is null then 'gap' else 'point' end as state from {bands} b join {issuers} i on i.issuer = b.issuer")
def w12(t: Data) -> DataFrame:
    """Points with their band; a backcast with current members shows no band."""
    rows = band_rows(t).join(t.issuers.select("issuer", (F.col("cap") < 0).alias("backcast")), "issuer")
    return rows.select("issuer", "as_of", r6("p50", "middle"), F.when(F.col("backcast"), "band_suppressed").when(F.col("p50").isNull(), "gap").otherwise("point").alias("state"))


@query("W7_growth_trend", """with g as (select a.issuer, a.period_end, a.qidx, case when b.revenue > 0 then cast(a.revenue - b.revenue as double) / cast(b.revenue as double) end as rate from {gapped} a left join {gapped} b on a.issuer = b.issuer and a.qidx = b.qidx + 4),
  x as (select issuer, period_end, rate - lag(rate) over w as second, lag(rate) over w - lag(rate, 2) over w as first, qidx - lag(qidx) over w as s1, lag(qidx) over w - lag(qidx, 2) over w as s2, lag(qidx, 2) over w as far from g window w as (partition by issuer order by period_end)),
  y as (select *, concat_ws('|', case when s1 <> 1 or s2 <> 1 then 'nonconsecutive_trend_quarters' end, case when far is null then 'three_quarterly_rates_required' end, case when far is not null and (first is null or second is null) then 'trend_input_unavailable' end) as reasons from x)
  select issuer, period_end, reasons, case when reasons = '' then case when first > 0.02 and second > 0.02 then 'rising' when first < -0.02 and second < -0.02 then 'falling' when abs(first) <= 0.02 and abs(second) <= 0.02 then 'broadly_stable' else 'mixed' end end as trend from y""")
def w7(t: Data) -> DataFrame:
    rates = periods.compared(t.gapped, ["issuer"], "revenue")
    return history.trend(rates, ["issuer"], "growth", 0.02).select("issuer", "period_end", flags.text(F.col("reasons")).alias("reasons"), "trend")


@query("P21_history_window", "select issuer, qidx from {snapshots} where period_end > date '1997-12-31' and period_end <= date '1999-12-31'")
def p21(t: Data) -> DataFrame:
    end = F.lit("1999-12-31").cast("date")
    return t.snapshots.filter((F.col("period_end") > scalar.window_start(end, 2)) & (F.col("period_end") <= end)).select(*KEYS)


@query("F20_window_start", "select event_id, cast(cast(ts as date) + interval 31 day - interval 3 years as date) as start from {events}")
def f20(t: Data) -> DataFrame:
    return t.events.select("event_id", scalar.window_start(F.date_add(F.to_date("ts"), 31), 3).alias("start"))


@query("J31_history_points", """select a.issuer, a.qidx, b.qidx as then, cast(case when b.cap > 0 then b.income end as double) as value, concat_ws('|', case when b.cap_date <> b.period_end then 'historical_evaluation_date_mismatch' end, case when b.cap <= 0 then 'historical_metric_unavailable' end, case when (a.cap > 50000) <> (b.cap > 50000) then 'incompatible_series' end) as reasons
  from {snapshots} a join {snapshots} b on a.issuer = b.issuer and b.qidx < a.qidx and b.qidx >= a.qidx - 12""")
def j31(t: Data) -> DataFrame:
    """Points of the last three years; a company that crossed a size limit has another context."""
    rows = t.snapshots.select(*KEYS, F.when(F.col("cap") > 50000, "large").otherwise("small").alias("context"), F.col("cap_date").alias("evaluated"), "period_end", F.when(F.col("cap") > 0, F.col("income").cast("double")).alias("value"))
    return inputs.history_points(rows, rows, ["issuer"], 12).select(*KEYS, "then", "value", flags.text(F.col("reasons")).alias("reasons"))

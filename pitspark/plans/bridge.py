"""Views that give the driver's tables the shapes of filings, prices and companies.

Suppliers stand for issuers, nations for industries, regions for sectors; lines of a supplier in a
quarter for its reported flows; events for captures and series; orders of a customer for membership.
"""

from __future__ import annotations

PRICE = "cast(l_extendedprice as decimal(12,2))"
DISC = "cast(l_discount as decimal(4,2))"
TAX = "cast(l_tax as decimal(4,2))"

VIEWS = {
    "issuers": "select s_suppkey as issuer, n_nationkey as industry, n_regionkey as sector, cast(s_acctbal as decimal(18,2)) as cap from {supplier} join {nation} on s_nationkey = n_nationkey",
    "flows": f"""
        select l_suppkey as issuer, cast(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as int) as qidx,
          make_date(cast(year(l_shipdate) as int), cast(quarter(l_shipdate) * 3 - 2 as int), 1) as period_start,
          last_day(make_date(cast(year(l_shipdate) as int), cast(quarter(l_shipdate) * 3 as int), 1)) as period_end,
          cast(sum({PRICE}) as decimal(18,4)) as revenue,
          cast(sum({PRICE} * (1 - {DISC})) as decimal(18,4)) as cost,
          cast(sum({PRICE} * {DISC}) as decimal(18,4)) as cfo,
          cast(sum({PRICE} * {TAX}) as decimal(18,4)) as capex,
          cast(sum(case when l_returnflag = 'N' then {PRICE} * ({DISC} - {TAX}) else 0 end) as decimal(18,4)) as income,
          cast(sum(case when l_linestatus = 'O' then {PRICE} * ({DISC} - {TAX}) else {PRICE} * {DISC} end) as decimal(18,4)) as operating_income,
          cast(count(*) * 0.005 as decimal(18,4)) as error, cast(max(l_shipdate) as date) as cap_date
        from {{lineitem}} group by 1, 2, 3, 4""",
    "ttm": """
        select issuer, qidx, period_end, cap_date, revenue, cost, cfo, capex, income, operating_income, error from (
          select issuer, qidx, period_end, cap_date, count(*) over w as n, min(qidx) over w as first_qidx, cast(sum(revenue) over w as decimal(18,4)) as revenue, cast(sum(cost) over w as decimal(18,4)) as cost, cast(sum(cfo) over w as decimal(18,4)) as cfo,
            cast(sum(capex) over w as decimal(18,4)) as capex, cast(sum(income) over w as decimal(18,4)) as income, cast(sum(operating_income) over w as decimal(18,4)) as operating_income, cast(sum(error) over w as decimal(18,4)) as error
          from {flows} window w as (partition by issuer order by qidx rows between 3 preceding and current row)) x
        where n = 4 and qidx - first_qidx = 3""",
    "snapshots": """
        select t.*, cast(t.cfo - t.capex as decimal(18,4)) as fcf, i.industry, i.sector, cast(i.cap + t.cfo - t.capex as decimal(18,4)) as cap, cast(i.cap + t.prior_cash as decimal(18,4)) as prior_cap,
          t.error as income_error, t.error as revenue_error, t.error as fcf_error, t.prior_error as prior_revenue_error
        from (select *, max(revenue) over p as prior_revenue, max(error) over p as prior_error, max(cfo - capex) over p as prior_cash, max(period_end) over p as prior_end
          from {ttm} window p as (partition by issuer order by qidx range between 4 preceding and 4 preceding)) t join {issuers} i on t.issuer = i.issuer""",
    # a cap of a day long before the quarter's end is no evidence of that end; some snapshots come twice, some of these differ
    "snapshot_rows": """
        select issuer, qidx, period_end, cap_date, case when k = 2 then cost else revenue end as revenue, cost, cfo, capex, income, operating_income, error, prior_revenue, prior_error, prior_cash, prior_end, fcf, industry, sector, cap, prior_cap, income_error, revenue_error, fcf_error, prior_revenue_error, case when cap_date < period_end - interval 25 day then 'incompatible_equity_date' end as cap_issue
        from {snapshots} cross join (values (0), (1), (2)) as copies(k) where k = 0 or (k = 1 and revenue > 4 * income and cap_date = period_end) or (k = 2 and error >= 0.52)""",
    "rostered": """
        select s.*, c.cap_issue, c.conflict from {snapshots} s join (select issuer, qidx, max(cap_issue) as cap_issue, count(distinct revenue) > 1 as conflict from {snapshot_rows} group by 1, 2) c on c.issuer = s.issuer and c.qidx = s.qidx""",
    "editions": """
        select cast(l_orderkey as bigint) as fact, l_linenumber as line, cast(l_shipdate as date) as filed, cast(l_extendedprice as decimal(12,2)) as value, l_returnflag as form, l_suppkey as issuer
        from {lineitem}""",
    "captures": """
        select event_id as capture, user_id as object_key, event_type as source, ts as fetched_at, case when event_type = 'error' then 500 else 200 end as http_status,
          md5(cast(cast(value as decimal(12,2)) as varchar(20))) as body_hash, cast(value as decimal(12,2)) as value
        from {events}""",
    "series": """
        select event_id as response, user_id as issuer, event_type as series, cast(ts as date) as reference_date, ts as retrieved_at,
          case when event_type = 'error' then null else cast(value as decimal(12,2)) end as value
        from {events}""",
    "membership": """
        select o_custkey as issuer, o_orderpriority as class, o_orderdate + case when o_orderstatus = 'P' then interval 200 day else interval 0 day end as known_at, cast(o_orderdate as date) as effective_from,
          cast(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as effective_to, o_orderkey as source_ref
        from {orders}""",
}

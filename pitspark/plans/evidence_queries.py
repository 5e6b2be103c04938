"""Evidence queries: complete batches, pointers, frozen selections and amounts beyond 38 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags, wide
from pitspark.functions.storage import work_dir
from pitspark.operators import changes, frozen, periods
from pitspark.plans.bridge import PRICE, VIEWS
from pitspark.plans.registry import Data, query
from pitspark.sources import publication

# orders are batches, their lines' parts the captures that went in; some captures failed or were not stored
VIEWS["publish_captures"] = "select p_partkey as capture, case when p_size = 3 then null else timestamp '2024-01-01 00:00:00' end as completed_at, timestamp '2024-01-01 00:00:00' as fetched_at, case when p_size = 1 then 500 else 200 end as http_status, md5(p_name) as body_hash, case when p_size = 2 then null else p_name end as blob_key, length(p_name) as byte_count from {part}"
VIEWS["publish_inputs"] = "select l_orderkey as batch, l_partkey as capture from {lineitem}"
VIEWS["publish_coverage"] = "select l_orderkey as batch, case when l_quantity > 45 then l_suppkey else l_partkey end as capture from {lineitem} where l_linenumber = 1 and l_discount > 0"
VIEWS["publish_observations"] = "select l_orderkey as batch, case when l_quantity < 2 then l_suppkey else l_partkey end as capture from {lineitem}"
VIEWS["publish_resolutions"] = "select l_orderkey as batch, case when l_returnflag = 'R' then 'ambiguous' else 'observed' end as status, l_tax > 0 as flagged from {lineitem}"

OUTSIDE = "select e.batch from {{{0}}} e left join (select distinct batch, capture from {{publish_inputs}}) i on i.batch = e.batch and i.capture = e.capture where i.capture is null"
AGAINST = f"""select o_orderkey as batch, concat_ws('|',
    case when o_orderkey in (select batch from {{publish_inputs}} left join {{publish_captures}} c using (capture) where not coalesce(c.completed_at is not null and c.http_status between 200 and 299 and c.blob_key is not null, false)) then 'capture_not_archived' end,
    case when o_orderkey in ({OUTSIDE.format('publish_coverage')}) then 'metadata_capture_outside_inputs' end, case when o_orderkey not in (select batch from {{publish_coverage}}) then 'no_coverage' end,
    case when o_orderkey not in (select batch from {{publish_inputs}}) then 'no_input' end, case when o_orderkey in ({OUTSIDE.format('publish_observations')}) then 'observation_capture_outside_inputs' end,
    case when o_orderkey in (select batch from {{publish_resolutions}} where status <> 'observed' and not flagged) then 'unresolved_without_flag' end) as reasons from {{orders}}"""


def problems(t: Data) -> DataFrame:
    return publication.publication_problems(t.orders.select(F.col("o_orderkey").alias("batch")), t.publish_inputs, t.publish_captures, t.publish_coverage, t.publish_observations, t.publish_resolutions)


@query("A24_publication_problems", AGAINST)
def a24_problems(t: Data) -> DataFrame:
    return problems(t).select("batch", flags.text(F.col("reasons")).alias("reasons"))


@query("S9_pointer_editions", f"""with p as (select o_custkey as customer, case when o_totalprice >= 150000 then 1 else 0 end as family, max(o_orderkey) as sequence from {{orders}} where o_orderstatus = 'F' group by 1, 2),
    o as (select o_custkey as customer, case when o_totalprice >= 150000 then 1 else 0 end as family, max(o_orderkey) as sequence from {{orders}} where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey in (select batch from ({AGAINST}) a where reasons = '') group by 1, 2)
  select coalesce(p.customer, o.customer) as customer, coalesce(p.family, o.family) as family, greatest(coalesce(p.sequence, -1), coalesce(o.sequence, -1)) as sequence, case when o.sequence > coalesce(p.sequence, -1) then 'late' else 'early' end as snapshot, case when o.sequence is null then 'unchanged' when o.sequence > coalesce(p.sequence, -1) then 'moved' else 'kept' end as action
  from p full outer join o on o.customer = p.customer and o.family = p.family""")
def s9_editions(t: Data) -> DataFrame:
    """Two editions of a stored pointer: filled orders first, then those urgent ones whose batch is complete."""

    def offers(rows: DataFrame, snapshot: str) -> DataFrame:
        return rows.select(F.col("o_custkey").alias("customer"), F.when(F.col("o_totalprice") >= 150000, 1).otherwise(0).alias("family"), F.col("o_orderkey").cast("long").alias("sequence"), F.lit(snapshot).alias("snapshot"), F.col("o_orderkey").alias("batch"))

    pointers = publication.Pointers(t.spark, work_dir(t.spark, "pointers"), ["customer", "family"])
    pointers.publish(offers(t.orders.filter("o_orderstatus = 'F'"), "early"))
    return publication.publish_complete(pointers, offers(t.orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')"), "late"), problems(t))


CUTOFF = "1996-06-30"
# what became of the evidence after the selection was frozen
VIEWS["later_editions"] = "select fact, line, filed, case when fact % 101 = 0 then value + 1 else value end as value, form from {editions} where not (fact % 97 = 0 and line = 1)"
CHOSEN = "select fact, form, max(filed) as filed, max(line) as line, max(value) as value from (select *, row_number() over (partition by fact, form order by filed desc, line desc) as rank from {{{0}}} where filed <= date '" + CUTOFF + "' and form <> 'N') r where rank = 1 group by 1, 2"


@query("J32_replayed_selection", f"""select coalesce(a.fact, b.fact) as fact, coalesce(a.form, b.form) as form, case when b.fact is null then 'removed' when a.fact is null then 'added' else 'altered' end as state
  from ({CHOSEN.format('editions')}) a full outer join ({CHOSEN.format('later_editions')}) b on a.fact = b.fact and a.form = b.form where a.filed is distinct from b.filed or a.line is distinct from b.line or a.value is distinct from b.value""")
def j32_replayed(t: Data) -> DataFrame:
    """The newest edition of each fact and form as of a date, frozen, and chosen again from altered evidence."""

    def choice(evidence: DataFrame):
        def select(request: DataFrame) -> DataFrame:
            asked = request.select(F.explode("forms").alias("form"), "cutoff")
            rows = evidence.join(F.broadcast(asked), "form").filter(F.col("filed") <= F.col("cutoff"))
            return rows.groupBy("fact", "form").agg(F.max(F.struct("filed", "line", "value")).alias("x")).select("fact", "form", "x.*")

        return select

    request = t.spark.range(1).select(F.lit(CUTOFF).cast("date").alias("cutoff"), F.array(F.lit("A"), F.lit("R")).alias("forms"))
    path = work_dir(t.spark, "frozen")
    frozen.freeze(choice(t.editions)(request), ["fact", "form"], request, path)
    return frozen.Frozen(t.spark, path).replay(choice(t.later_editions)).select("fact", "form", "state")


P36 = "cast('1' || repeat('0', 36) as hugeint)"
# amounts of some 44 digits: cents, then the order in 36 digits, 18 of them behind the point; a few are out of range
VIEWS["long_amounts"] = f"""select l_suppkey as issuer, case when l_tax = 0 and l_linenumber = 2 then null else case when l_returnflag = 'R' then '-' else '' end || cast(cast({PRICE} * 100 as bigint) as varchar(20)) || lpad(cast(l_orderkey as varchar(20)), 36, '0') || case when l_linenumber = 7 and l_quantity > 40 then 'E2000' else 'E-18' end end as amount,
  cast(cast(l_quantity as int) as varchar(20)) || 'E18' as shares from {{lineitem}}"""
SUMS = f"""select l_suppkey as issuer, count(*) filter (where kept) as v, count(*) filter (where not kept and not gone) as exceeded, sum(case when kept then cents end)::hugeint as h, sum(case when kept then k end)::hugeint as l, sum(case when kept then cast(l_quantity as int) end) as q
  from (select *, cast({PRICE} * 100 as bigint) * s as cents, l_orderkey * s as k, not gone and not (l_linenumber = 7 and l_quantity > 40) as kept from (select *, l_tax = 0 and l_linenumber = 2 as gone, case when l_returnflag = 'R' then -1 else 1 end as s from {{lineitem}}) a) b group by 1"""


@query("A5_exact_totals", f"""with s as ({SUMS}), n as (select issuer, v, exceeded, q, h, l, case when h > 0 and l < 0 then h - 1 when h < 0 and l > 0 then h + 1 else h end as a, case when h > 0 and l < 0 then l + {P36} when h < 0 and l > 0 then l - {P36} else l end as b from s),
    d as (select *, case when a < 0 or b < 0 then -1 when a > 0 or b > 0 then 1 else 0 end as sign, ltrim(cast(abs(a) as varchar) || substr(lpad(cast(abs(b) as varchar), 36, '0'), 1, 18), '0') as whole, rtrim(substr(lpad(cast(abs(b) as varchar), 36, '0'), 19), '0') as part from n)
  select issuer, v, exceeded, case when v > 0 then sign end as sign, case when v > 0 then case when sign < 0 then '-' else '' end || case when whole = '' then '0' else whole end || case when part = '' then '' else '.' || part end end as num_total, case when v > 0 then cast(q as varchar) || repeat('0', 18) end as den_total,
    case when v > 0 then round(cast(h as double) / q + 1.7e-6, 4) end as ratio, concat_ws('|', case when v = 0 then 'no_contributors' end, case when exceeded > 0 then 'numeric_range_exceeded' end) as reasons from d""")
def a5_exact(t: Data) -> DataFrame:
    """Totals of amounts that no decimal of Spark holds, and their quotient by shares."""
    found = wide.exact_ratio(t.long_amounts, ["issuer"], "amount", "shares")
    return found.select("issuer", "v", "exceeded", "sign", "num_total", "den_total", F.round(F.col("ratio") + 1.7e-6, 4).alias("ratio"), flags.text(F.col("reasons")).alias("reasons"))


VIEWS["accepted"] = "select o_orderkey as accession, o_orderstatus as form, case when o_totalprice < 30000 then null else o_orderdate end as acceptance_at, case when o_orderpriority = '5-LOW' then 'date_only' when o_orderpriority <> '4-NOT SPECIFIED' then 'verified_timezone' end as acceptance_time_basis from {orders}"


@query("P19_verified_inventory", "select accession, case when acceptance_at is null or coalesce(acceptance_time_basis, '') <> 'verified_timezone' then 'acceptance_unverified' when acceptance_at > timestamp '1998-01-01 00:00:00' then 'excluded_after_cutoff' else 'selected' end as state from {accepted} where form in ('F', 'P')")
def p19_verified(t: Data) -> DataFrame:
    return changes.at_cutoff(t.accepted, ["F", "P"], F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("accession", "state")


@query("F11_annual_reasons", """select issuer, qidx, k, cast(case when k = 4 and income >= 0 then revenue end as double) as value, concat_ws('|', case when income < 0 then 'input_value_invalid' end, case when k <> 4 then 'unsupported_annual_period' end) as problems from (select *, 1 as k from {flows} union all select *, 4 from {flows}) x""")
def f11_reasons(t: Data) -> DataFrame:
    """Each quarter's amount as one of three and of twelve months."""
    rows = t.flows.withColumn("k", F.explode(F.array(F.lit(1), F.lit(4)))).withColumn("period_start", F.add_months(F.date_add("period_end", 1), F.col("k") * -3))
    rows = rows.select("issuer", "qidx", "k", "period_start", "period_end", F.col("revenue").alias("value"), flags.reasons(input_value_invalid=F.col("income") < 0).alias("problems"))
    return periods.annual_amounts(rows).select("issuer", "qidx", "k", F.col("value").cast("double").alias("value"), flags.text(F.col("problems")).alias("problems"))


@query("F14_assembled_amounts", """select issuer, fiscal_year, cast(case when count(case when income < cfo / -8 then 1 end) = 0 then sum(case when place = 0 then -revenue else revenue end) end as double) as value,
    cast(case when count(case when income < cfo / -8 or capex > cfo then 1 end) = 0 then sum(error) end as double) as error, concat_ws('|', case when count(case when income < cfo / -8 then 1 end) > 0 then 'input_value_invalid' end, case when count(case when cost > 20 * cfo then 1 end) > 0 then 'revised_view' end) as flags
  from (select *, cast(floor(qidx / 4) as int) as fiscal_year, qidx % 4 as place from {flows}) x group by 1, 2""")
def f14_assembled(t: Data) -> DataFrame:
    """Years from quarters, the first of which is subtracted."""
    rows = t.flows.select(
        "issuer", F.floor(F.col("qidx") / 4).cast("int").alias("fiscal_year"), F.col("revenue").alias("value"), F.when(~(F.col("capex") > F.col("cfo")), F.col("error")).alias("error"), F.when(F.col("qidx") % 4 == 0, -1).otherwise(1).alias("coefficient"),
        flags.reasons(input_value_invalid=F.col("income") < F.col("cfo") / -8).alias("problems"), flags.reasons(revised_view=F.col("cost") > 20 * F.col("cfo")).alias("flags"),
    )
    found = periods.assembled(rows, ["issuer", "fiscal_year"])
    return found.select("issuer", "fiscal_year", F.col("value").cast("double").alias("value"), F.col("error").cast("double").alias("error"), flags.text(F.col("flags")).alias("flags"))

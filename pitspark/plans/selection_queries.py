"""Point-in-time queries: facts with editions, captures, and series as of a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.operators import observations, selection
from pitspark.plans.bridge import VIEWS
from pitspark.plans.registry import Data, query

VIEWS["cutoffs"] = "select cast('2024-01-10 00:00:00' as timestamp) as cutoff union all select cast('2024-01-20 12:00:00' as timestamp) union all select cast('2024-02-01 00:00:00' as timestamp)"
CUTOFF = "2024-01-20 12:00:00"
KEY = ["fact", "line"]


def d2(name: str):
    return F.col(name).cast("double").alias(name)


VIEWS["versions"] = """select l_suppkey as issuer, l_orderkey as version, cast(l_shipdate as date) as filed, case when l_quantity >= 48 then null else l_shipdate + interval 1 hour * cast(l_quantity as int) end as acceptance_at,
    case when l_tax >= 0.08 then 'ifrs' when l_tax > 0.01 then 'us_gaap' end as basis, case when l_discount >= 0.10 then null else 'USD' end as currency, case when l_quantity < 3 then 'partial' else 'covered' end as state, s_acctbal >= 0 as complete from {lineitem} join {supplier} on s_suppkey = l_suppkey"""


def version_sql(pick: str, mode: str) -> str:
    return f"""with e as (select * from (select *, {pick}(filed) over (partition by issuer) as f from {{versions}}) where filed = f), g as (select issuer, count(distinct version) as v, bool_and(acceptance_at is not null) as ok, {pick}(acceptance_at) as a from e group by 1),
      k as (select issuer, count(distinct version) as n from e join g using (issuer) where e.acceptance_at = g.a group by 1),
      h as (select e.*, v > 1 as several, v > 1 and ok and k.n = 1 as timed from e join g using (issuer) left join k using (issuer) where not (v > 1 and ok and k.n = 1) or e.acceptance_at = g.a)
      select issuer, filed, case when count(distinct version) = 1 then min(version) end as version, case when bool_or(several and not timed) then 'ambiguous_filing_order' when count(distinct coalesce(basis, '')) > 1 then 'incompatible_reporting_basis' when bool_or(currency is null or state <> 'covered') then 'unresolved_coverage' end as reason, {mode} as mode from h group by 1, 2"""


@query("W1_original_edition", version_sql("min", "case when not bool_and(complete) then 'earliest_available' end"))
def w1(t: Data) -> DataFrame:
    return selection.chosen_versions(t.versions, ["issuer"], latest=False)


@query("W1_latest_edition", version_sql("max", "'revised_view'"))
def w1_latest(t: Data) -> DataFrame:
    return selection.chosen_versions(t.versions, ["issuer"], latest=True)


@query("A1_fact_conflicts", "select fact, line, count(distinct (value, form)) as signatures, count(distinct (value, form)) > 1 as conflict from {editions} group by 1, 2")
def a1(t: Data) -> DataFrame:
    return selection.conflicts(t.editions, KEY, [F.col("value"), F.col("form")])


@query("A4_nondeterminism", "select body_hash, count(distinct object_key) as outputs from {captures} group by 1 having count(distinct object_key) > 1")
def a4(t: Data) -> DataFrame:
    return t.captures.groupBy("body_hash").agg(F.count_distinct("object_key").alias("outputs")).filter("outputs > 1")


@query("P1_successful_captures", f"select capture, object_key from {{captures}} where http_status between 200 and 299 and fetched_at <= cast('{CUTOFF}' as timestamp) and body_hash is not null")
def p1(t: Data) -> DataFrame:
    return selection.successful(t.captures, F.lit(CUTOFF).cast("timestamp")).select("capture", "object_key")


VIEWS["role_captures"] = "select user_id as object_key, 'facts' as role, event_id as capture, date_trunc('hour', ts) as fetched_at, md5(event_type) as body_hash from {events} where event_type <> 'error' union all select user_id, 'index', event_id, date_trunc('hour', ts), md5(event_type) from {events} where event_type in ('purchase', 'signup')"


@query("W2_newest_capture", """with x as (select *, max(fetched_at) over (partition by object_key, role) as newest from {role_captures}), c as (select object_key, capture from x group by 1, 2 having bool_or(fetched_at = newest) and bool_or(fetched_at < newest))
  select object_key, role, fetched_at, case when count(distinct body_hash) = 1 and object_key not in (select object_key from c) then min(body_hash) end as body_hash, case when count(distinct body_hash) > 1 then 'ambiguous_capture_vintage' when object_key in (select object_key from c) then 'incompatible_source_roles' end as reason from x where fetched_at = newest group by 1, 2, 3""")
def w2(t: Data) -> DataFrame:
    return selection.source_captures(t.role_captures, ["object_key"]).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


VIEWS["attempts"] = """select user_id as object_key, case event_type when 'view' then 'success' when 'click' then 'not_modified' when 'error' then 'http_error' when 'purchase' then 'archive_error' else 'interrupted_unknown' end as state, case when event_type = 'purchase' and value > 150 then null else ts end as finished_at from {events}"""


@query("W4_freshness_boundary", f"""with k as (select *, coalesce(finished_at <= timestamp '{CUTOFF}', false) as known from {{attempts}}), e as (select object_key, max(case when known and state = 'success' then finished_at end) as newest, max(case when known and state = 'not_modified' then finished_at end) as validated, bool_or(not known or state = 'interrupted_unknown') as unknown from k group by 1),
  b as (select object_key, newest, unknown, case when newest is not null then greatest(newest, coalesce(validated, newest)) end as boundary from e),
  f as (select b.object_key, newest, unknown, boundary, count(case when known and state in ('http_error', 'archive_error') and (boundary is null or finished_at >= boundary) then 1 end) as failures from b join k using (object_key) group by 1, 2, 3, 4)
  select object_key, boundary, failures, concat_ws('|', case when failures > 0 and newest is null then 'capture_failed' end, case when newest is null then 'capture_unavailable' end, case when failures > 0 and newest is not null then 'newer_capture_failed' end, case when unknown then 'source_attempt_outcome_unknown' end) as flags from f""")
def w4(t: Data) -> DataFrame:
    return selection.freshness(t.attempts, ["object_key"], F.lit(CUTOFF).cast("timestamp_ntz")).select("object_key", "boundary", "failures", flags.text(F.col("flags")).alias("flags"))


VIEWS["nullable_keys"] = "select event_id, case when user_id % 5 = 0 then null else user_id end as k, case when event_type = 'error' then null else event_type end as e from {events}"


@query("J4_null_safe_join", "select a.event_id, count(*) as matches from {nullable_keys} a join {nullable_keys} b on a.k is not distinct from b.k and a.e is not distinct from b.e group by 1")
def j4(t: Data) -> DataFrame:
    left, right = t.nullable_keys.alias("a"), t.nullable_keys.groupBy("k", "e").agg(F.count("*").alias("n")).alias("b")
    joined = left.join(right, F.col("a.k").eqNullSafe(F.col("b.k")) & F.col("a.e").eqNullSafe(F.col("b.e")))
    return joined.select("event_id", F.col("n").alias("matches"))


@query("J6_flags_by_batch_or_period", "select distinct issuer, qidx, flag from (select issuer, qidx, 'batch_low' as flag from {flows} join (select issuer as i from {flows} group by 1 having min(revenue) < 100000) on i = issuer union all select issuer, qidx, 'period_loss' from {flows} where income < 0)")
def j6(t: Data) -> DataFrame:
    flows = t.flows
    batch = flows.groupBy("issuer").agg(F.min("revenue").alias("low")).filter("low < 100000").select("issuer")
    first = flows.join(batch, "issuer", "left_semi").select("issuer", "qidx", F.lit("batch_low").alias("flag"))
    return first.unionByName(flows.filter("income < 0").select("issuer", "qidx", F.lit("period_loss").alias("flag"))).distinct()


BATCH_DAYS = "case event_type when 'view' then 4 when 'click' then 1 when 'signup' then 12 else 2 end"
VIEWS["batches"] = f"""select user_id as issuer, event_id as batch, date_trunc('hour', ts) as response_at, date_trunc('hour', ts) + case when event_type = 'signup' then interval 30 hour else interval 0 hour end as known_at, ts as published_at,
  case when event_type = 'purchase' then 'one answer' else cast(event_id as varchar(20)) end as answers, cast(cast(ts as date) - {BATCH_DAYS} * interval 1 day as date) as window_from, cast(cast(ts as date) + case when event_type = 'view' then interval 3 day else interval 0 day end as date) as window_to,
  case when event_id % 11 = 0 then 'partial' else 'complete' end as coverage_state from {{events}}"""
VIEWS["held_observations"] = """select user_id as issuer, event_id as batch, cast(cast(ts as date) - case event_type when 'view' then interval 1 day when 'click' then interval 3 day else interval 0 day end as date) as reference_date,
  case when event_id % 13 = 5 then null else cast(value as decimal(12,2)) end as value, case when event_id % 13 = 5 then 'source_null' else 'observed' end as value_state from {events} where event_type <> 'error'
  union all select user_id, event_id, cast(ts as date), cast(value + 1 as decimal(12,2)), 'observed' from {events} where event_id % 7 = 3 and event_type <> 'error'"""
VIEWS["batch_quality"] = "select event_id as batch, case when value > 60 then 'outlier' else 'rounded' end as rule, case when value > 60 then 'error' else 'warning' end as severity, case when event_id % 2 = 0 then cast(null as date) else cast(ts as date) end as reference_date from {events} where event_id % 5 = 1"
VIEWS["asks"] = """select issuer, cast(s as date) as selected, cast(c as timestamp) as cutoff from (select distinct user_id as issuer from {events} union select c_custkey from {customer} where c_custkey % 40 = 0) i
  cross join (select '2024-01-05' as s union all select '2024-01-09' union all select '2024-01-17' union all select '2024-01-30') d cross join (select '2024-01-10 00:00:00' as c union all select '2024-01-20 12:00:00' union all select '2024-02-01 00:00:00') e"""


def observed_sql(age: int | None) -> str:
    """The definition, by joining every ask with all batches of its key."""
    days = age or 0
    day = "q.selected" if age is None else "coalesce(d.reference_date, q.selected)"
    reach = "true" if age is None else "(d.reference_date is null or b.window_to >= d.reference_date)"
    return f"""with e as (select q.*, b.batch, b.response_at, b.published_at, b.answers, b.window_to, b.coverage_state from {{asks}} q join {{batches}} b on b.issuer = q.issuer and b.known_at <= q.cutoff and b.window_from <= q.selected and b.window_to >= q.selected - {days}),
      d as (select e.issuer, e.selected, e.cutoff, max(o.reference_date) as reference_date from e join {{held_observations}} o on o.batch = e.batch and o.reference_date between e.selected - {days} and e.selected group by 1, 2, 3),
      k as (select b.*, {day} as day, rank() over (partition by b.issuer, b.selected, b.cutoff order by b.response_at desc) as k from e b join {{asks}} q using (issuer, selected, cutoff) left join d using (issuer, selected, cutoff) where {reach}),
      t as (select issuer, selected, cutoff, day, max(response_at) as response_at, count(distinct answers) > 1 as tied, arg_max(batch, (published_at, batch)) as batch from k where k = 1 group by 1, 2, 3, 4),
      o as (select batch, reference_date, count(*) as n, min(value) as value, min(value_state) as value_state from {{held_observations}} group by 1, 2),
      r as (select q.*, coalesce(t.day, q.selected) as day, t.response_at, coalesce(t.tied, false) as tied, case when not t.tied then t.batch end as batch from {{asks}} q left join t using (issuer, selected, cutoff)),
      u as (select r.*, b.coverage_state, o.n, o.value, o.value_state, (select string_agg(distinct f.rule, '|') from {{batch_quality}} f where f.batch = r.batch and (f.reference_date is null or f.reference_date = r.day)) as rules,
          (select count(*) from {{batch_quality}} f where f.batch = r.batch and (f.reference_date is null or f.reference_date = r.day) and f.severity = 'error') > 0 as blocked
        from r left join {{batches}} b on b.batch = r.batch left join o on o.batch = r.batch and o.reference_date = r.day),
      w as (select *, coalesce(n, 0) = 1 as one from u)
    select issuer, selected, cutoff, day as reference_date, case when one then date_diff('day', day, selected) end as age_days, batch, response_at, coverage_state, cast(case when one then value end as double) as value, case when one then value_state end as value_state,
      array_to_string(list_sort(list_filter([case when response_at is null then 'no_eligible_batch' end, case when tied then 'ambiguous_batch' end, case when batch is not null and n is null then 'missing_observation' end, case when n > 1 then 'ambiguous_observation' end,
        case when one and coverage_state <> 'complete' then 'incomplete_coverage' end, case when one and day <> selected then 'backward_selected' end, case when one and value_state <> 'observed' then value_state end, case when one then rules end], lambda x: x is not null)), '|') as flags,
      one and value_state = 'observed' and coverage_state = 'complete' and not blocked as usable from w"""


def observed_query(t: Data, age: int | None) -> DataFrame:
    found = observations.observed(t.asks, t.batches, t.held_observations, t.batch_quality, ["issuer"], age)
    return found.select("issuer", "selected", "cutoff", "reference_date", "age_days", "batch", "response_at", "coverage_state", d2("value"), "value_state", flags.text(F.col("flags")).alias("flags"), "usable")


@query("J7_response_as_of", observed_sql(None))
def j7(t: Data) -> DataFrame:
    return observed_query(t, None)


@query("W3_newest_response", """with k as (select *, rank() over (partition by series, reference_date order by retrieved_at desc) as r from {series})
  select series, reference_date, retrieved_at, count(distinct response) > 1 as ambiguous from k where r = 1 group by 1, 2, 3""")
def w3(t: Data) -> DataFrame:
    return selection.newest(t.series, ["series", "reference_date"], "retrieved_at", F.col("response")).select("series", "reference_date", "retrieved_at", "ambiguous")


@query("J8_bounded_backward_as_of", observed_sql(6))
def j8(t: Data) -> DataFrame:
    return observed_query(t, 6)


#: An account in debt closes its large bindings ahead of their end, or after it.
VIEWS["closures"] = "select source_ref as binding, effective_from + 60 as closed_on from {membership} join {customer} on c_custkey = issuer where c_acctbal < 0 and class <> '5-LOW'"


@query("J10_interval_containment", """select l_suppkey as issuer, l_orderkey as fact, l_linenumber as line, m.source_ref as binding, m.class from {lineitem} join {orders} on o_orderkey = l_orderkey join {membership} m on m.issuer = o_custkey left join {closures} c on c.binding = m.source_ref
  where cast(l_shipdate as date) >= m.effective_from and cast(l_shipdate as date) < coalesce(c.closed_on, m.effective_to, date '9999-12-31')""")
def j10(t: Data) -> DataFrame:
    facts = t.lineitem.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("owner")), F.col("o_orderkey") == F.col("l_orderkey"))
    facts = facts.select("owner", F.to_date("l_shipdate").alias("day"), F.col("l_suppkey").alias("issuer"), F.col("l_orderkey").alias("fact"), F.col("l_linenumber").alias("line"))
    bindings = t.membership.select(F.col("issuer").alias("owner"), F.col("source_ref").alias("binding"), "class", F.col("effective_from").alias("valid_from"), F.col("effective_to").alias("valid_to"))
    return observations.contained(facts, bindings, ["owner"], "day", t.closures, "binding").select("issuer", "fact", "line", "binding", "class")


VIEWS["vintages"] = "select issuer, series, reference_date, value, reference_date as realtime_start, lead(reference_date) over (partition by issuer, series order by retrieved_at, response) - 1 as realtime_end from {series}"
VIEWS["vintages_spark"] = "select issuer, series, reference_date, value, reference_date as realtime_start, date_sub(lead(reference_date) over (partition by issuer, series order by retrieved_at, response), 1) as realtime_end from {series}"


@query("J11_realtime_interval", "select issuer, series, reference_date, cast(value as double) as value from {vintages} where date '2024-01-15' between realtime_start and coalesce(realtime_end, date '9999-12-31')")
def j11(t: Data) -> DataFrame:
    inside = F.lit("2024-01-15").cast("date").between(F.col("realtime_start"), F.coalesce("realtime_end", F.lit("9999-12-31").cast("date")))
    return t.vintages_spark.filter(inside).select("issuer", "series", "reference_date", d2("value"))


VIEWS["definitions"] = "select event_type as series, cast(min(ts) as date) + 5 as known_on, 1 as definition from {events} where event_type <> 'signup' group by 1 union all select event_type, cast(min(ts) as date) + 20, 2 from {events} where event_type in ('view', 'click') group by 1"


@query("J12_series_definition", """select response, case when s.series in (select series from {definitions}) then case when max(d.known_on) is null then 'definition_from_future' end else 'definition_missing' end as reason, max(d.definition) as definition from {series} s left join {definitions} d on d.series = s.series and d.known_on <= s.reference_date group by response, s.series""")
def j12(t: Data) -> DataFrame:
    known = t.events.groupBy(F.col("event_type").alias("series")).agg(F.to_date(F.min("ts")).alias("first")).filter("series <> 'signup'")
    later = F.array(F.struct(F.date_add("first", 5).alias("known_on"), F.lit(1).alias("definition")), F.struct(F.when(F.col("series").isin("view", "click"), F.date_add("first", 20)).alias("known_on"), F.lit(2).alias("definition")))
    definitions = known.select("series", F.explode(later).alias("d")).select("series", "d.*").filter("known_on is not null")
    return selection.with_definition(t.series, definitions, ["series"]).select("response", "reason", "definition")


VIEWS["publications"] = """select event_id as response, case event_type when 'view' then 'instant' when 'click' then 'date' else 'unknown' end as precision, case when event_type = 'view' then ts + interval 1 hour * cast(floor(value) as int) end as published_at, case when event_type = 'click' then cast(ts as date) end as published_on,
  case when value > 90 then cast(ts as date) end as realtime_start, case when value < 10 then cast(ts as date) end as source_as_of from {events}"""


@query("P12_publication_knowledge", f"""select response, case when source_as_of >= date '2024-01-20' or realtime_start >= date '2024-01-20' then 'ambiguous_source_vintage_at_instant' when precision = 'instant' then case when published_at > timestamp '{CUTOFF}' then 'source_publication_after_cutoff' end
  when precision = 'date' then case when published_on >= date '2024-01-20' then 'ambiguous_source_publication_date' end else 'unknown_source_publication_time' end as reason from {{publications}}""")
def p12(t: Data) -> DataFrame:
    columns = [F.col(c) for c in ("precision", "published_at", "published_on", "realtime_start")]
    return t.publications.select("response", observations.publication_problem(*columns, F.lit(CUTOFF).cast("timestamp"), F.col("source_as_of")).alias("reason"))


VIEWS["listings"] = "select c_custkey as issuer, date '2024-01-02' + cast(c_nationkey as int) as valid_from, case when c_mktsegment = 'BUILDING' then null else date '2024-01-20' + cast(c_nationkey as int) end as valid_to, case when c_acctbal < 2000 then date '2024-01-24' end as closed_on from {customer}"


@query("P11_session_in_binding", "select s.response from {series} s join {listings} b on b.issuer = s.issuer and s.reference_date >= b.valid_from and s.reference_date < least(coalesce(b.valid_to, date '9999-12-31'), coalesce(b.closed_on, date '9999-12-31'))")
def p11(t: Data) -> DataFrame:
    nation = F.col("c_nationkey").cast("int")
    listings = t.customer.select(F.col("c_custkey").alias("issuer"), F.date_add(F.lit("2024-01-02").cast("date"), nation).alias("valid_from"), F.when(F.col("c_mktsegment") != "BUILDING", F.date_add(F.lit("2024-01-20").cast("date"), nation)).alias("valid_to"), F.when(F.col("c_acctbal") < 2000, F.lit("2024-01-24").cast("date")).alias("closed_on"))
    return selection.sessions_in_binding(t.series.withColumn("session", F.col("reference_date")), listings, ["issuer"]).select("response")


VIEWS["coverage"] = "select l_orderkey as fact, l_linenumber as line, cast(l_shipdate as date) as filed, case l_returnflag when 'N' then 'periodic_complete' when 'A' then 'reviewed_equivalent' else 'partial' end as authority, case when l_linestatus = 'F' then 'audited' else 'unaudited' end as assurance from {lineitem}"


@query("P13_eligible_coverage", """select 'plain' as ask, fact, line, filed from {coverage} where authority = 'periodic_complete' and filed <= date '1998-06-30' union all select 'reviewed', fact, line, filed from {coverage} where authority in ('periodic_complete', 'reviewed_equivalent') and filed <= date '1998-06-30'
  union all select 'audited', fact, line, filed from {coverage} where authority in ('periodic_complete', 'reviewed_equivalent') and assurance = 'audited' and filed <= date '1998-06-30'""")
def p13(t: Data) -> DataFrame:
    cutoff = F.lit("1998-06-30").cast("date")
    asks = [("plain", False, False), ("reviewed", True, False), ("audited", True, True)]
    found = [selection.eligible_coverage(t.coverage, reviewed, audited, cutoff).select(F.lit(name).alias("ask"), "fact", "line", "filed") for name, reviewed, audited in asks]
    return found[0].unionByName(found[1]).unionByName(found[2])


VIEWS["batch_inputs"] = "select user_id as batch, event_id as response, case event_type when 'view' then 'observations' when 'error' then 'fetch_outcome' else 'metadata' end as role, case when event_type = 'signup' and value > 190 then null else ts end as ended_at from {events}"


@query("A2_batch_eligibility", """select batch, max(case when role <> 'metadata' then ended_at end) as response_at, max(ended_at) as known_at, bool_and(coalesce(ended_at <= timestamp '2024-01-31 00:00:00', false)) and max(case when role <> 'metadata' then ended_at end) is not null as eligible, coalesce(array_to_string(list_sort(list(response) filter (role <> 'metadata')), ','), '') as responses from {batch_inputs} group by 1""")
def a2(t: Data) -> DataFrame:
    found = selection.eligible_batches(t.batch_inputs, ["batch"], F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return found.withColumn("responses", F.array_join(F.transform("responses", lambda x: x.cast("string")), ","))


VIEWS["statements"] = "select l_suppkey as issuer, cast(l_shipdate as date) as period_end, case when l_tax >= 0.08 then 'ifrs' else 'us_gaap' end as basis, l_returnflag as family, l_orderkey as edition, case when l_discount = 0 then 'segment' else 'consolidated' end as scope, case when l_quantity > 48 then 'EUR' else 'USD' end as currency from {lineitem}"


@query("A23_statement_coherence", """select issuer, period_end, concat_ws('|', case when count(distinct basis) > 1 then 'incompatible_reporting_basis' end, case when count(distinct family) > 1 and count(distinct scope) > 1 then 'incompatible_semantic_scopes' end, case when count(distinct family) > 1 and count(distinct currency) > 1 then 'incompatible_statement_currencies' end,
  case when count(distinct family) > 1 and count(distinct edition) > 1 then 'mixed_statement_editions' end) as flags from {statements} group by 1, 2""")
def a23(t: Data) -> DataFrame:
    return selection.statement_coherence(t.statements, ["issuer", "period_end"]).select("issuer", "period_end", flags.text(F.col("flags")).alias("flags"))


@query("O4_latest_per_key", "select object_key, max_by(capture, (fetched_at, capture)) as capture from {captures} group by 1")
def o4(t: Data) -> DataFrame:
    return t.captures.groupBy("object_key").agg(F.max_by("capture", F.struct("fetched_at", "capture")).alias("capture"))


@query("J24_reviewed_policy", "select capture, case when source in ('view', 'click') then 'reviewed' else 'unreviewed' end as review from {captures}")
def j24(t: Data) -> DataFrame:
    links = t.spark.createDataFrame([("view", True), ("click", True)], "source string, linked boolean")
    return t.captures.join(F.broadcast(links), "source", "left").select("capture", F.when(F.col("linked"), "reviewed").otherwise("unreviewed").alias("review"))


@query("J25_attempts_to_last_completed", "with m as (select object_key, max(case when http_status = 200 then capture end) as last from {captures} group by 1) select c.capture from {captures} c join m using (object_key) where c.capture <= m.last")
def j25(t: Data) -> DataFrame:
    last = F.max(F.when(F.col("http_status") == 200, F.col("capture"))).over(Window.partitionBy("object_key"))
    return t.captures.withColumn("last", last).filter("capture <= last").select("capture")


VIEWS["bindings"] = "select issuer, effective_from as valid_from, effective_to as valid_to, source_ref from {membership}"


@query("J26_overlapping_intervals", "select issuer, source_ref from (select *, lead(effective_from) over (partition by issuer order by effective_from, effective_to, source_ref) as nf, effective_from as valid_from from (select issuer, source_ref, effective_from, effective_from + 30 as effective_to from {membership})) where nf < effective_to")
def j26(t: Data) -> DataFrame:
    rows = t.membership.select("issuer", "source_ref", F.col("effective_from").alias("valid_from"), F.date_add("effective_from", 30).alias("valid_to"))
    return selection.validity_overlaps(rows, ["issuer"], ["source_ref"]).select("issuer", "source_ref")


@query("J27_revision_lineage", "with recursive e as (select o_custkey as parent, o_custkey // 2 as child from {orders} where o_custkey > 0 group by 1, 2), w(node, depth) as (select distinct o_custkey, 0 from {orders} union all select e.child, w.depth + 1 from w join e on e.parent = w.node where w.depth < 40) select node, max(depth) as depth from w group by 1")
def j27(t: Data) -> DataFrame:
    edges = t.orders.filter("o_custkey > 0").select(F.col("o_custkey").alias("parent"), F.floor(F.col("o_custkey") / 2).alias("child")).distinct()
    roots = t.orders.select(F.col("o_custkey").alias("node")).distinct()
    return selection.acyclic_levels(edges, roots, 40)


@query("J28_outside_manifest", """select o_orderkey as key, 'resolution_unflagged' as reason from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey) union all select distinct l_suppkey, 'coverage_outside_manifest' from {lineitem} where l_suppkey not in (select s_suppkey from {supplier} where s_acctbal > 0)
  union all select distinct user_id, 'capture_outside_manifest' from {events} where user_id not in (select c_custkey from {customer} where c_acctbal > 0)""")
def j28(t: Data) -> DataFrame:
    checks = [
        (t.orders.select(F.col("o_orderkey").alias("key")), t.lineitem.select(F.col("l_orderkey").alias("key")), "resolution_unflagged"),
        (t.lineitem.select(F.col("l_suppkey").alias("key")), t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("key")), "coverage_outside_manifest"),
        (t.events.select(F.col("user_id").alias("key")), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "capture_outside_manifest"),
    ]
    found = [selection.outside(rows, manifest, ["key"], reason) for rows, manifest, reason in checks]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("J30_details_for_every_record", "select distinct l_partkey as record from {lineitem} where not exists (select 1 from {part} where p_partkey = l_partkey and p_size > 1)")
def j30(t: Data) -> DataFrame:
    details = t.part.filter("p_size > 1").select(F.col("p_partkey").alias("record"))
    return t.lineitem.select(F.col("l_partkey").alias("record")).distinct().join(details, "record", "left_anti")


@query("J32_frozen_against_stored", "select coalesce(a.issuer, b.issuer) as issuer, coalesce(a.qidx, b.qidx) as qidx from {flows} a full outer join (select issuer, qidx, case when qidx % 7 = 0 then revenue + 1 else revenue end as revenue from {flows} where qidx % 11 <> 0) b on a.issuer = b.issuer and a.qidx = b.qidx where a.revenue is distinct from b.revenue")
def j32(t: Data) -> DataFrame:
    frozen = t.flows.select("issuer", "qidx", "revenue")
    stored = frozen.filter("qidx % 11 <> 0").select("issuer", "qidx", F.when(F.col("qidx") % 7 == 0, F.col("revenue") + 1).otherwise(F.col("revenue")).alias("stored"))
    return frozen.join(stored, ["issuer", "qidx"], "full_outer").filter(~F.col("revenue").eqNullSafe(F.col("stored"))).select("issuer", "qidx")


@query("A22_one_history_each", "select issuer, qidx, concat_ws('|', case when cap <= 0 then 'mixed_editions' end, case when last_day(cap_date) <> period_end then 'mixed_period_ends' end, case when income < 0 then 'mixed_windows' end) as reasons from {snapshots}")
def a22(t: Data) -> DataFrame:
    """A multiple ends with its quote's month; a loss is taken over a quarter; without a cap an older edition stands."""
    rows = t.snapshots
    flow = rows.select("issuer", "qidx", F.lit("margin").alias("metric"), F.lit("own").alias("history"), "period_end", F.lit("year").alias("window"), F.lit(1).alias("edition"))
    price = rows.select("issuer", "qidx", F.lit("multiple").alias("metric"), F.lit("own").alias("history"), F.last_day("cap_date").alias("period_end"), F.when(F.col("income") < 0, "quarter").otherwise("year").alias("window"), F.when(F.col("cap") <= 0, 0).otherwise(1).alias("edition"))
    found = selection.coherent(flow.unionByName(price), ["issuer", "qidx"], {"mixed_histories": "history", "mixed_period_ends": "period_end", "mixed_windows": "window", "mixed_editions": "edition"})
    return found.select("issuer", "qidx", flags.text(F.col("reasons")).alias("reasons"))


@query("A24_publication_completeness", "select o_orderkey as batch, count(l_orderkey) > 0 and count(case when l_quantity is null then 1 end) = 0 as complete from {orders} left join {lineitem} on l_orderkey = o_orderkey group by 1")
def a24(t: Data) -> DataFrame:
    inputs = t.lineitem.groupBy(F.col("l_orderkey").alias("batch")).agg(F.count_if(F.col("l_quantity").isNull()).alias("gaps"))
    return t.orders.select(F.col("o_orderkey").alias("batch")).join(inputs, "batch", "left").select("batch", (F.coalesce("gaps", F.lit(1)) == 0).alias("complete"))


@query("U5_manifest_equality", "select coalesce(a.k, b.k) as capture, case when a.k is null then 'not_requested' else 'not_delivered' end as reason from (select distinct user_id as k from {events} where event_type = 'view') a full outer join (select distinct user_id as k from {events} where event_type = 'click' and user_id % 9 <> 1) b on a.k = b.k where a.k is null or b.k is null")
def u5(t: Data) -> DataFrame:
    wanted = t.events.filter("event_type = 'view'").select(F.col("user_id").alias("capture")).distinct().withColumn("asked", F.lit(True))
    given = t.events.filter("event_type = 'click' and user_id % 9 <> 1").select(F.col("user_id").alias("capture")).distinct().withColumn("given", F.lit(True))
    off = wanted.join(given, "capture", "full_outer").filter("asked is null or given is null")
    return off.select("capture", F.when(F.col("asked").isNull(), "not_requested").otherwise("not_delivered").alias("reason"))

"""The composed statement read: requests over evidence made from suppliers' lines.

A supplier is an issuer, its part of an order a filing of the quarters in which lines were shipped, and a line
a resolution with its observation. Nations differ in what is wrong with their evidence, so that every reason
of the read occurs; other faults follow the orders' numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.functions.storage import stored
from pitspark.operators import statements
from pitspark.plans.bridge import VIEWS
from pitspark.plans.registry import Data, query

VERSION = "cast(l_suppkey as bigint) * 100000000 + l_orderkey"
QUARTER = "cast(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 as int)"
VIEWS["st_lines"] = f"select cast(l_suppkey as bigint) as issuer, l_orderkey as ord, {VERSION} as version, cast(l_linenumber as int) as line, {QUARTER} as period, cast(l_shipdate as date) as day, l_returnflag as concept, cast(l_extendedprice as decimal(12,2)) as price, l_tax as tax, l_quantity as quantity from {{lineitem}}"
VIEWS["st_batches"] = """select cast(s_suppkey * 2 + k as bigint) as batch, cast(s_suppkey as bigint) as issuer, case when s_nationkey = 2 and k = 1 then 2 else 1 end as mapping, 'n1' as normalizer, 'p1' as policy, case when s_nationkey = 1 and k = 1 then 'pending' else 'published' end as state,
  concat('in', s_suppkey) as input_hash, case when s_nationkey = 3 and k = 1 then 'out2' else 'out1' end as output_hash from {supplier} cross join (values (0), (1)) as b(k)"""
VIEWS["st_captures"] = """select cast(s_suppkey * 10 + j as bigint) as capture, s_nationkey as nation, 'source' as source, case j when 0 then 'index' when 3 then 'notes' else 'facts' end as object_key, timestamp '2001-01-01 00:00:00' + interval 1 day * case when s_nationkey = 5 and j = 1 then 2 else j end as fetched_at,
  case when s_nationkey = 4 and j = 3 then null else timestamp '2001-01-01 01:00:00' + interval 1 day * j end as completed_at, concat('h', s_suppkey * 10 + j) as body_hash from {supplier} cross join (values (0), (1), (2), (3)) as c(j)"""
VIEWS["st_inputs"] = """select cast(s_suppkey * 2 + k as bigint) as batch, role, cast(s_suppkey * 10 + j as bigint) as capture from {supplier} cross join (values (0, 0, 'metadata'), (0, 1, 'facts'), (0, 2, 'facts'), (0, 3, 'facts'), (1, 0, 'metadata'), (1, 1, 'index')) as i(k, j, role) where role <> 'index' or s_nationkey = 6"""
VIEWS["st_filings"] = """select version, version as filing, issuer, max(day) as filed, case when ord % 5 = 0 then null else cast(max(day) as timestamp) + interval 1 hour * cast(ord % 24 as int) end as acceptance_at, issuer * 10 + case when ord % 97 = 0 then 1 else 0 end as metadata_capture from {st_lines} group by version, issuer, ord"""
VIEWS["st_coverage"] = """select distinct concat(version, '-', period) as coverage, issuer * 2 + ord % 2 as batch, version, period, 'income' as family, 'whole' as scope, case when ord % 31 = 0 then null when ord % 37 = 0 then 'EUR' else 'USD' end as currency,
  case when ord % 7 = 0 then 'reviewed_equivalent' when ord % 11 = 0 then 'partial' else 'periodic_complete' end as authority, case when ord % 3 = 0 then 'unaudited' else 'audited' end as assurance, case when ord % 41 = 0 then 'partial' else 'covered' end as state, case when ord % 43 = 0 then null when period % 2 = 0 and ord % 47 = 0 then 'ifrs' else 'us_gaap' end as basis from {st_lines}
  union all select distinct concat(version, '-', period, '-b'), issuer * 2, version, period, 'income', 'whole', 'USD', 'periodic_complete', 'audited', 'covered', 'ifrs' from {st_lines} where ord % 29 = 0"""
VIEWS["st_resolutions"] = """select cast(ord * 10 + line as bigint) as resolution, concat(version, '-', period) as coverage, concept, 'whole' as scope, 'USD' as unit, case when tax >= 0.08 then 'common' end as instrument, case when quantity < 3 then 'missing' else 'observed' end as status, case when quantity < 3 then null else cast(ord * 10 + line as bigint) end as observation from {st_lines}
  union all select cast(ord * 10 + line as bigint) + 1000000000000, concat(version, '-', period), concept, 'whole', 'USD', case when tax >= 0.08 then 'common' end, 'missing', null from {st_lines} where ord % 23 = 0"""
VIEWS["st_observations"] = "select cast(ord * 10 + line as bigint) as observation, issuer * 10 + case when line = 3 then 1 when line = 4 then 3 else 2 end as capture, price as value from {st_lines}"
VIEWS["st_events"] = "select version as event, issuer, case when ord % 2 = 0 then 'withdrawal' else 'non_reliance' end as kind, max(day) + 30 as announced, version from {st_lines} where ord % 13 = 0 or ord % 97 = 0 group by version, issuer, ord"
VIEWS["st_event_scopes"] = "select version as event, version as filing, case when ord % 4 = 0 then null else period end as period, case when ord % 3 = 1 then 'N' end as concept from {st_lines} where ord % 13 = 0 or ord % 97 = 0"
VIEWS["st_quality"] = "select distinct version * 100 + period % 100 as flag, issuer, issuer * 2 + ord % 2 as batch, case when ord % 51 = 0 and issuer % 9 = 0 then null else period end as period, cast(null as varchar(9)) as security, case when ord % 2 = 1 then cast(ord * 10 + 1 as bigint) end as resolution, case when ord % 3 = 0 then 'error' else 'warning' end as severity from {st_lines} where ord % 17 = 0"
VIEWS["st_pinned_captures"] = "select cast(s_suppkey as bigint) as issuer, array_agg(cast(s_suppkey * 10 + j as bigint)) as captures from {supplier} cross join (values (0), (1), (2), (3)) as c(j) where not (s_nationkey = 7 and j = 3) group by 1"
VIEWS["st_pinned_events"] = "select issuer, period, array_agg(distinct event) as events from (select case when n = 8 then issuer + 1 else issuer end as issuer, period, event from (select l.issuer, l.period, l.version as event, l.ord, s_nationkey as n from {st_lines} l join {supplier} on s_suppkey = l.issuer) x where (ord % 13 = 0 and ord % 97 <> 0) or (ord % 97 = 0 and n = 9)) y group by 1, 2"
VIEWS["st_pinned_quality"] = "select issuer, period, array_agg(distinct flag) as quality from (select q.issuer, case when n.s_nationkey = 10 then q.period + 1 else q.period end as period, q.flag from {st_quality} q join {supplier} n on n.s_suppkey = q.issuer where q.period is not null) x group by 1, 2"
VIEWS["st_requests"] = """select concat(p.issuer, '-', p.period, '-', mode) as request, p.issuer, cast(null as varchar(9)) as security, 1 as mapping, 'n1' as normalizer, 'p1' as policy, p.period, 'income' as family, 'whole' as scope, 'USD' as unit, 'USD' as currency, cast(null as varchar(9)) as instrument, mode, p.period % 3 = 0 as history_complete,
  case when mode = 'as_filed_by_date' then cast(concat(cast(cast(floor(p.period / 4) as int) as varchar(4)), '-10-02') as date) end as filed_cutoff, timestamp '2001-02-01 00:00:00' as captured_before, p.period % 9 = 0 as audited, p.period % 2 = 0 as allow_reviewed, case when p.period % 4 = 0 then single else concepts end as concepts, b.batches, c.captures, coalesce(e.events, none) as events, coalesce(q.quality, none) as quality
  from (select distinct issuer, period from {st_lines}) p cross join (values ('as_filed_by_date'), ('original_as_filed'), ('latest_reported')) as m(mode) cross join (select array_agg(c) as concepts, array_agg(c) filter (where c = 'R') as single from (values ('A'), ('N'), ('R')) as v(c)) n
  join (select issuer, array_agg(batch) as batches from {st_batches} group by 1) b on b.issuer = p.issuer join {st_pinned_captures} c on c.issuer = p.issuer cross join (select array_agg(cast(k as bigint)) as none from (values (1)) as z(k) where k > 1) o
  left join {st_pinned_events} e on e.issuer = p.issuer and e.period = p.period left join {st_pinned_quality} q on q.issuer = p.issuer and q.period = p.period"""

#: Every step by its definition; the first reason of a request ends it.
READ = """with r as (select * replace (coalesce(events, []) as events, coalesce(quality, []) as quality) from {st_requests}), rb as (select request, issuer, mapping, normalizer, policy, unnest(batches) as batch from r),
  b as (select request, bool_or(b.state is distinct from 'published') as lost, bool_or(b.issuer is distinct from rb.issuer or b.mapping is distinct from rb.mapping or b.normalizer is distinct from rb.normalizer or b.policy is distinct from rb.policy) as other from rb left join {st_batches} b using (batch) group by 1),
  odd as (select distinct request from (select request from rb join {st_batches} b using (batch) group by request, input_hash having count(distinct output_hash) > 1)),
  pin as (select rb.request, i.role, c.* from rb join {st_inputs} i using (batch) join {st_captures} c using (capture)),
  pc as (select p.request, list_sort(list_distinct(list(capture))) as held, bool_or(fetched_at is null or fetched_at > r.captured_before or completed_at is null or completed_at > r.captured_before) as late from pin p join r using (request) group by 1),
  vin as (select *, fetched_at = max(fetched_at) over w as newest from pin window w as (partition by request, source, object_key, role)),
  tied as (select distinct request from (select request from vin where newest group by request, source, object_key, role having count(distinct body_hash) > 1)), torn as (select distinct request from (select request from vin group by request, capture having bool_or(newest) and bool_or(not newest))),
  chosen as (select distinct request, capture from vin where newest),
  re as (select request, issuer, captures, unnest(events) as event from r),
  ev as (select re.request, bool_or(e.issuer is distinct from re.issuer or not list_contains(re.captures, f.metadata_capture)) as alien, bool_or(ch.capture is null) as outdated from re left join {st_events} e on e.event = re.event left join {st_filings} f on f.version = e.version left join chosen ch on ch.request = re.request and ch.capture = f.metadata_capture group by 1),
  rq as (select request, issuer, period, batches, unnest(quality) as flag from r),
  qu as (select rq.request, bool_or(q.issuer is distinct from rq.issuer or (q.period is not null and q.period <> rq.period) or q.security is not null or (q.batch is not null and not list_contains(rq.batches, q.batch))) as misplaced from rq left join {st_quality} q using (flag) group by 1),
  s as (select r.*, case when b.lost then 'unpublished_or_missing_batch' when b.other then 'incompatible_batch_revision' when r.request in (select request from odd) then 'nondeterministic_normalization' when pc.held is distinct from list_sort(r.captures) then 'incompatible_capture_manifest' when pc.late then 'capture_unavailable' when ev.alien then 'incompatible_event_manifest'
      when qu.misplaced then 'incompatible_quality_manifest' when r.request in (select request from tied) then 'ambiguous_capture_vintage' when r.request in (select request from torn) then 'incompatible_source_roles' when ev.outdated then 'incompatible_event_vintage' end as reason
    from r left join b using (request) left join pc using (request) left join ev using (request) left join qu using (request)),
  c as (select s.request, s.mode, c.coverage, c.version, f.filing, f.filed, f.acceptance_at, c.currency, c.state, coalesce(c.basis, '') as basis from s join {st_coverage} c on list_contains(s.batches, c.batch) and c.period = s.period and c.family = s.family and c.scope = s.scope and (c.currency is null or c.currency = s.currency) join {st_filings} f on f.version = c.version join chosen ch on ch.request = s.request and ch.capture = f.metadata_capture
    where s.reason is null and (c.authority = 'periodic_complete' or (s.allow_reviewed and c.authority = 'reviewed_equivalent')) and (not s.audited or c.assurance = 'audited') and (s.filed_cutoff is null or f.filed <= s.filed_cutoff)),
  d as (select * from (select *, case when mode = 'original_as_filed' then min(filed) over w else max(filed) over w end as top from c window w as (partition by request)) where filed = top),
  t as (select request, count(distinct version) > 1 as several, bool_and(acceptance_at is not null) as timed, case when max(mode) = 'original_as_filed' then min(acceptance_at) else max(acceptance_at) end as moment from d group by 1),
  x as (select d.* from d join t using (request) where not (several and timed) or acceptance_at = moment),
  g as (select request, max(filed) as filed, nullif(max(basis), '') as basis, list_sort(list_distinct(list(version))) as versions, case when count(distinct version) > 1 then 'ambiguous_filing_order' when count(distinct basis) > 1 then 'incompatible_reporting_basis' when bool_or(currency is null or state <> 'covered') then 'unresolved_coverage' end as edition_reason from x group by 1),
  a as (select g.request, s.scope, s.unit, s.instrument, unnest(s.concepts) as concept from g join s using (request) where edition_reason is null),
  m as (select a.request, a.concept, v.resolution, v.status, o.value, v.observation, v.observation is not null and ch.capture is null as stale from a join x using (request) join {st_resolutions} v on v.coverage = x.coverage and v.concept = a.concept and v.scope = a.scope and v.unit = a.unit and v.instrument is not distinct from a.instrument left join {st_observations} o on o.observation = v.observation left join chosen ch on ch.request = a.request and ch.capture = o.capture),
  n as (select request, concept, count(distinct (status, value, observation)) as signs, min(status) as status, min(value) as value, bool_or(stale) as stale from m group by 1, 2),
  f as (select a.request, a.concept, case when n.signs is null then 'missing' when signs > 1 then 'ambiguous' when stale then 'stale_source' else status end as status, value from a left join n using (request, concept)),
  k as (select request, bool_or(status = 'ambiguous') as ambiguous, bool_or(status not in ('observed', 'ambiguous')) as unresolved, bool_and(status = 'observed') as whole from f group by 1),
  z as (select distinct s.request from s join {st_quality} q on q.severity in ('error', 'blocking') and (list_contains(s.quality, q.flag) or (list_contains(s.batches, q.batch) and ((q.resolution is null and (q.period is null or q.period = s.period)) or exists (select 1 from m where m.request = s.request and m.resolution = q.resolution)))) where s.reason is null),
  y as (select distinct s.request, e.kind from s join {st_events} e on list_contains(s.events, e.event) and e.issuer = s.issuer and (s.filed_cutoff is null or e.announced <= s.filed_cutoff) join {st_filings} i on i.version = e.version join chosen ch on ch.request = s.request and ch.capture = i.metadata_capture join {st_event_scopes} o on o.event = e.event join x on x.request = s.request and x.filing = o.filing
    where s.reason is null and (o.period is null or o.period = s.period) and (o.concept is null or list_contains(s.concepts, o.concept))),
  w as (select s.request, s.mode, s.concepts, g.filed, g.basis, g.versions, k.whole, list_sort(list_filter([s.reason, g.edition_reason, case when s.reason is null and g.versions is null then 'coverage_unavailable' end, case when k.ambiguous then 'ambiguous_resolution' end, case when k.unresolved then 'unresolved_concept' end, case when k.whole is not null and s.request in (select request from z) then 'blocking_quality_flag' end,
      case when k.whole is not null and s.mode = 'original_as_filed' and not s.history_complete then 'earliest_available' end, case when k.whole is not null and s.mode = 'latest_reported' then 'revised_view' end, case when k.whole is not null and (s.request, 'withdrawal') in (select (request, kind) from y) then 'withdrawal' end, case when k.whole is not null and (s.request, 'non_reliance') in (select (request, kind) from y) then 'non_reliance' end], lambda q: q is not null)) as flags
    from s left join g using (request) left join k using (request))"""
USABLE = "coalesce(whole, false) and len(list_filter(flags, lambda q: q not in ('revised_view', 'earliest_available'))) = 0"


def evidence(t: Data) -> statements.Evidence:
    """Filings, their coverage and events are made of the lines of a version, so that lines move there once."""
    names, by_version = ("batches", "inputs", "captures", "resolutions", "observations", "event_scopes", "quality"), t.grouped("st_lines", "version")
    return statements.Evidence(**{name: getattr(t, f"st_{name}") for name in names}, **{name: getattr(by_version, f"st_{name}") for name in ("filings", "coverage", "events")})


@query("J2_coverage_chain", READ + " select request, coverage, version, filed, currency, basis from c")
def j2(t: Data) -> DataFrame:
    requests, e = stored(t.st_requests, "requests"), evidence(t)
    rows = statements.covered(statements.sound(requests, statements.bundles(requests, e)), e)
    return rows.select("request", "coverage", "version", "filed", "currency", F.coalesce("basis", F.lit("")).alias("basis"))


@query("J3_resolution_observation_capture", READ + f""", u as (select request, unnest(concepts) as concept from w)
  select request, u.concept, coalesce(f.status, 'unavailable') as status, cast(case when f.status = 'observed' then f.value end as double) as value, filed, basis, cast(len(coalesce(versions, [])) as bigint) as versions, array_to_string(flags, '|') as flags, {USABLE} as usable
  from w join u using (request) left join f using (request, concept)""")
def j3(t: Data) -> DataFrame:
    found = statements.read(t.st_requests, evidence(t))
    rows = found.select("request", F.explode("facts").alias("f"), "filed", "basis", F.size("versions").cast("long").alias("versions"), flags.text(F.col("flags")).alias("flags"), "usable")
    return rows.select("request", "f.concept", "f.status", F.col("f.value").cast("double").alias("value"), "filed", "basis", "versions", "flags", "usable")


@query("J5_event_scope", READ + " select request, kind from y where request in (select request from g where edition_reason is null)")
def j5(t: Data) -> DataFrame:
    requests, e = stored(t.st_requests, "requests"), statements.sourced(evidence(t))
    sound = statements.sound(requests, statements.bundles(requests, e))
    editions = statements.edition(statements.covered(sound, e)).filter("reason is null")
    return statements.taken_back(sound, editions, e)


@query("J1_requirements_and_captures", READ + " select request, reason from s")
def j1(t: Data) -> DataFrame:
    """The state of each request's pinned evidence."""
    return statements.bundles(stored(t.st_requests, "requests"), evidence(t)).select("request", "reason")

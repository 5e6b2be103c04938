"""Source queries: bodies are made from the driver's tables and scanned back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.functions.concepts import CONCEPTS, expected_unit
from pitspark.functions.storage import work_dir
from pitspark.operators import selection
from pitspark.plans.bridge import VIEWS
from pitspark.plans.registry import Data, query
from pitspark.sources import bodies, inline
from pitspark.streaming.change_feed import ChangeFeed
from pitspark.streaming.series_feed import SeriesFeed


def fact_bodies(t: Data) -> DataFrame:
    rows = t.flows.select("issuer", "qidx", F.explode(F.array(*[F.struct(F.lit(c).alias("tag"), F.col(c).alias("val")) for c in ("revenue", "cost")])).alias("x"), F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"))
    one = F.struct("start", "end", F.col("x.val").alias("val"), F.concat_ws("-", "issuer", "qidx").alias("accn"), F.lit("10-Q").alias("form"), F.col("end").alias("filed"))
    tags = rows.groupBy("issuer", F.col("x.tag").alias("tag")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    entry = F.struct("tag", F.struct(F.create_map(F.lit("USD"), F.col("rows")).alias("units")).alias("v"))
    return tags.groupBy("issuer").agg(F.to_json(F.struct(F.create_map(F.lit("gaap"), F.map_from_entries(F.collect_list(entry))).alias("facts"))).alias("body"))


@query("S1_scan_company_facts", """select issuer, tag, '/facts/gaap/' || tag || '/units/USD/' || cast(row_number() over (partition by issuer, tag order by period_start) - 1 as varchar) as locator, cast(val as double) as val, cast(val as varchar) as text, period_end as filed, 'observed' as state, null::varchar as problem
  from (select issuer, 'revenue' as tag, revenue as val, period_start, period_end from {flows} union all select issuer, 'cost', cost, period_start, period_end from {flows}) where issuer not in (select issuer from {issuers} where cap < 0) union all select issuer, null, null, null, null, null, null, 'body_malformed' from {issuers} where cap < 0""")
def s1(t: Data) -> DataFrame:
    """Bodies of issuers with a negative cap repeat a key."""
    torn = t.issuers.select("issuer", (F.col("cap") < 0).alias("torn"))
    made = fact_bodies(t).join(torn, "issuer").withColumn("body", F.when(F.col("torn"), F.concat(F.lit('{"facts":{},'), F.substr("body", F.lit(2)))).otherwise(F.col("body")))
    return bodies.company_facts(made, ["issuer"]).select("issuer", "tag", "locator", F.col("val").cast("double").alias("val"), "text", F.to_date("filed").alias("filed"), "state", "problem")


VIEWS["order_rows"] = "select o_custkey as issuer, cast(o_orderkey as varchar(20)) as accession, o_orderstatus as form, cast(o_orderdate as date) as filed, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from {orders}"


def filing_bodies(t: Data) -> DataFrame:
    order = F.sort_array(F.collect_list(F.struct("i", "accession", "form", F.col("filed").cast("string").alias("filed"))))
    held = t.order_rows.groupBy("issuer").agg(order.alias("x"))
    dates = F.when(F.col("issuer") % 10 == 0, F.slice("x.filed", 2, 1000000)).otherwise(F.col("x.filed"))
    recent = F.struct(F.col("x.accession").alias("accessionNumber"), F.col("x.form").alias("form"), dates.alias("filingDate"))
    return held.select("issuer", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body"))


@query("S2_scan_filing_index", """select issuer, cast(i as int) as i, accession, form, filed, null::varchar as problem from {order_rows} where issuer % 10 <> 0 union all select distinct issuer, null::int, null, null, null::date, 'array_length_mismatch' from {order_rows} where issuer % 10 = 0""")
def s2(t: Data) -> DataFrame:
    return bodies.filing_index(filing_bodies(t), ["issuer"])


VIEWS["bars"] = "select user_id as issuer, cast(ts as date) as session, event_id, cast(min(value) over w as decimal(12,2)) as low, cast(max(value) over w as decimal(12,2)) as high, cast(value as decimal(12,2)) as close, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as n from {events} window w as (partition by user_id, cast(ts as date))"


def price_bodies(t: Data) -> DataFrame:
    close = F.when(F.col("event_id") % 7 == 0, F.lit("null")).when(F.col("event_id") % 7 == 1, F.lit("true")).when(F.col("event_id") % 7 == 2, F.lit("-1")).when(F.col("event_id") % 7 == 4, F.concat(F.lit('"'), F.col("close").cast("string"), F.lit('"'))).otherwise(F.col("close").cast("string"))
    pair = F.when(F.col("event_id") % 7 == 3, F.lit("")).otherwise(F.concat(F.lit(',"close":'), close))
    text = F.concat(F.lit('{"date":"'), F.col("session").cast("string"), F.lit('T00:00:00Z","open":'), F.col("low").cast("string"), F.lit(',"high":'), F.col("high").cast("string"), F.lit(',"low":'), F.col("low").cast("string"), F.lit(',"adjClose":'), F.col("high").cast("string"), F.lit(',"splitFactor":1.0'), pair, F.lit("}"))
    return t.bars.filter("n = 1").withColumn("text", text).groupBy("issuer").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("text")), ","), F.lit("]")).alias("body"))


PRICE_STATE = "case event_id % 7 when 3 then 'missing' when 0 then 'source_null' when 1 then 'unparseable' when 2 then 'unparseable' when 4 then 'unparseable' else 'observed' end"


def prices(t: Data) -> DataFrame:
    return bodies.eod_prices(price_bodies(t), ["issuer"], "2024-01-03", "2024-01-20")


@query("S3_scan_eod_prices", f"select issuer, session, cast(high as double) as high, {PRICE_STATE} as close_state, cast(case when event_id % 7 > 4 then close end as double) as close, 'missing' as volume_state, cast(high as double) as adj_close, 1.0::double as split_factor, null::varchar as problem from {{bars}} where n = 1 and session between date '2024-01-03' and date '2024-01-20'")
def s3(t: Data) -> DataFrame:
    return prices(t).select("issuer", "session", F.col("high").cast("double").alias("high"), "close_state", F.col("close").cast("double").alias("close"), "volume_state", F.col("adjClose").cast("double").alias("adj_close"), F.col("splitFactor").cast("double").alias("split_factor"), "problem")


@query("P2_tri_state_numbers", f"select issuer, {PRICE_STATE} as state, count(*) as n from {{bars}} where n = 1 and session between date '2024-01-03' and date '2024-01-20' group by 1, 2")
def p2(t: Data) -> DataFrame:
    return prices(t).groupBy("issuer", F.col("close_state").alias("state")).agg(F.count("*").alias("n"))


@query("P9_ohlc_consistency", "select event_id, field from (select event_id, low + case when event_id % 4 = 0 then high else 0 end as low, high, close from {bars}) cross join (values ('close'), ('high'), ('low'), ('open')) f(field) where high < low or not close between low and high")
def p9(t: Data) -> DataFrame:
    rows = t.bars.withColumns({"low": F.col("low") + F.when(F.col("event_id") % 4 == 0, F.col("high")).otherwise(F.lit(0).cast("decimal(12,2)"))}).withColumn("open", F.col("close"))
    return rows.select("event_id", F.explode(bodies.ohlc_flags()).alias("field"))


VIEWS["observation_rows"] = "select user_id as series, event_id, cast(ts as date) as reference_date, cast(value as decimal(12,2)) as value, row_number() over (partition by user_id order by ts, event_id) - 1 as place, count(*) over (partition by user_id) as total from {events}"


def macro_bodies(t: Data) -> DataFrame:
    rows = t.observation_rows.withColumn("offset", F.floor(F.col("place") / 20) * 20)
    one = F.struct("place", F.col("reference_date").cast("string").alias("date"), F.when(F.col("event_id") % 9 == 0, ".").when(F.col("event_id") % 9 == 1, "NaN").otherwise(F.col("value").cast("string")).alias("value"))
    held = rows.groupBy("series", "offset", "total").agg(F.sort_array(F.collect_list(one)).alias("o"))
    shifted = F.when((F.col("series") % 8 == 0) & (F.col("offset") > 0), F.col("offset") + 1).otherwise(F.col("offset"))
    total = F.when((F.col("series") % 8 == 1) & (F.col("offset") > 0), F.col("total") + 1).otherwise(F.col("total"))
    return held.select("series", F.to_json(F.struct(shifted.alias("offset"), total.alias("count"), F.transform("o", lambda x: F.struct(x["date"].alias("date"), x["value"].alias("value"))).alias("observations"))).alias("body"))


def macro(t: Data) -> DataFrame:
    return bodies.macro_pages(macro_bodies(t), ["series"])


@query("S4_scan_macro_pages", """select series, place, reference_date, cast(case when event_id % 9 > 1 then value end as double) as value, case event_id % 9 when 0 then 'source_missing' when 1 then 'unparseable' else 'observed' end as state from {observation_rows} where total <= 20 or series % 8 > 1""")
def s4(t: Data) -> DataFrame:
    return macro(t).filter("problem is null").select("series", "place", "reference_date", F.col("value").cast("double").alias("value"), "state")


@query("W11_page_contiguity", "select series, case series % 8 when 0 then 'offset_gap' else 'total_changed' end as problem from {observation_rows} where total > 20 and series % 8 <= 1 group by 1, 2")
def w11(t: Data) -> DataFrame:
    return macro(t).filter("problem is not null").select("series", "problem").distinct()


@query("S5_scan_yield_xml", "select issuer, period_end as reference_date, cast(case when qidx % 6 <> 0 then cast(qidx % 100 as decimal(9,4)) / 16 end as double) as value, case when qidx % 6 = 0 then 'source_null' else 'observed' end as state from {flows}")
def s5(t: Data) -> DataFrame:
    value = F.when(F.col("qidx") % 6 != 0, ((F.col("qidx") % 100) / 16).cast("decimal(9,4)").cast("string")).otherwise("")
    entry = F.concat(F.lit("<entry><content><properties><NEW_DATE>"), F.col("period_end").cast("string"), F.lit("T00:00:00</NEW_DATE><BC_10YEAR>"), value, F.lit("</BC_10YEAR></properties></content></entry>"))
    feed = t.flows.withColumn("e", entry).groupBy("issuer").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("e"), ""), F.lit("</feed>")).alias("body"))
    return bodies.yield_xml(feed, ["issuer"], "BC_10YEAR").select("issuer", "reference_date", F.col("value").cast("double").alias("value"), "state")


SPACES = " ".join(f'xmlns:{k}="{v}"' for k, v in {"ix": inline.IX, "xbrli": inline.XBRLI, "xbrldi": inline.XBRLDI, "xsi": inline.XSI, "iso4217": inline.ISO4217, "ixt": inline.TRANSFORMS[0], "gaap": "urn:gaap", "d": "urn:d"}.items())
_OWNER = "lpad(cast(issuer as string), 10, '0')"


def inline_documents(t: Data) -> DataFrame:
    """A filing for each flow: a duration and an instant, a currency and a currency for each share, an amount, an
    amount for each share, and a note in two parts; some are cut short, or have another entity, a scale that is no
    number, or a continuation that leads to itself."""
    case = lambda k, odd, usual: F.when(F.col("qidx") % 10 == k, F.lit(odd)).otherwise(F.lit(usual))
    amount = F.format_number(F.abs(F.round("income", 0)), 0)
    owner = F.when(F.col("qidx") % 10 == 7, "9999999999").otherwise(F.expr(_OWNER))
    context = lambda id_, period, members: F.concat(F.lit(f'<xbrli:context id="{id_}"><xbrli:entity><xbrli:identifier scheme="{inline.SCHEME}">'), owner, F.lit(f"</xbrli:identifier>{members}</xbrli:entity><xbrli:period>"), *period, F.lit("</xbrli:period></xbrli:context>"))
    day = lambda tag, column: F.concat(F.lit(f"<xbrli:{tag}>"), F.col(column).cast("string"), F.lit(f"</xbrli:{tag}>"))
    members = '<xbrli:segment><xbrldi:explicitMember dimension="d:B">d:two</xbrldi:explicitMember><xbrldi:explicitMember dimension="d:A">d:one</xbrldi:explicitMember></xbrli:segment>'
    body = F.concat(
        F.lit(f'<html xmlns="{inline.XHTML}" {SPACES}><body><ix:header><ix:resources>'), context("c1", [day("startDate", "period_start"), day("endDate", "period_end")], members), context("c2", [day("instant", "period_end")], ""),
        F.lit('<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="u2"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit></ix:resources></ix:header>'),
        F.lit('<p><ix:nonFraction id="f1" name="gaap:Income" contextRef="c1" unitRef="u1" decimals="-3" format="ixt:num-dot-decimal" scale="'), case(5, "--5", "3"), F.when(F.col("income") < 0, F.lit('" sign="-">')).otherwise('">'), amount,
        F.lit('</ix:nonFraction><ix:nonFraction name="gaap:PerShare" contextRef="c1" unitRef="u2" decimals="2">1.25</ix:nonFraction><ix:nonFraction name="gaap:Assets" contextRef="c2" unitRef="u1" xsi:nil="true"/></p>'),
        F.lit('<ix:nonNumeric name="gaap:Note" contextRef="c1" continuedAt="k">Part <ix:exclude>page 7</ix:exclude>one</ix:nonNumeric><p>between</p><ix:continuation id="k"'), case(3, ' continuedAt="k"', ""), F.lit("> and two</ix:continuation>"), case(0, "<br>", ""), F.lit("</body></html>"),
    )
    return t.dealt(t.flows, "issuer", "qidx").select((F.col("issuer") * 100000 + F.col("qidx")).alias("doc"), body.alias("body"), F.expr(_OWNER).alias("owner"))


INLINE = "issuer * 100000 + qidx as doc"
_WRONG = "qidx % 10 = 7"


@query("S6_extract_inline_facts", f"""select {INLINE}, 'problem' as kind, null as name, null as text, null as state, 'malformed_xml' as problem, null as period_kind, null as start_date, null as end_date, '' as dimensions, '' as measures from {{flows}} where qidx % 10 = 0
  union all select {INLINE}, 'fact', '{{urn:gaap}}' || n, case when n = 'PerShare' then '1.25' when n = 'Assets' then '' when n = 'Note' then case when {_WRONG} or qidx % 10 = 3 then 'Part page 7one' else 'Part one and two' end end, case when {_WRONG} or (n = 'Income' and qidx % 10 = 5) or (n = 'Note' and qidx % 10 = 3) then 'unsupported' when n = 'Assets' then 'source_nil' when n = 'Note' then 'text' else 'observed' end,
      case when {_WRONG} then 'invalid_context' when n = 'Income' and qidx % 10 = 5 then 'invalid_scale' when n = 'Note' and qidx % 10 = 3 then 'invalid_continuation' end, null, null, null, '', '' from {{flows}} cross join (values ('Income'), ('PerShare'), ('Assets'), ('Note')) v(n) where qidx % 10 <> 0
  union all select {INLINE}, 'context', null, null, null, case when {_WRONG} then 'wrong_entity' end, case when {_WRONG} then null when k = 1 then 'duration' else 'instant' end, case when k = 1 and not {_WRONG} then period_start end, case when not {_WRONG} then period_end end, case when k = 1 and not {_WRONG} then '{{urn:d}}A={{urn:d}}one@segment|{{urn:d}}B={{urn:d}}two@segment' else '' end, '' from {{flows}} cross join (values (1), (2)) v(k) where qidx % 10 <> 0
  union all select {INLINE}, 'unit', null, null, null, null, null, null, null, '', '{{{inline.ISO4217}}}USD' || case when k = 2 then '/{{{inline.XBRLI}}}shares' else '' end from {{flows}} cross join (values (1), (2)) v(k) where qidx % 10 <> 0""")
def s6(t: Data) -> DataFrame:
    rows = inline.inline_facts(inline_documents(t), "doc", "owner")
    shown = F.when(F.coalesce(F.col("name") != "{urn:gaap}Income", F.lit(True)), F.col("text"))  # amounts are in J22
    measures = F.concat_ws("/", F.array_join("numerators", "*"), F.when(F.size("denominators") > 0, F.array_join("denominators", "*")))
    return rows.select("doc", "kind", "name", shown.alias("text"), "state", "problem", "period_kind", "start_date", "end_date", F.coalesce(flags.text(F.col("dimensions")), F.lit("")).alias("dimensions"), measures.alias("measures"))


@query("J22_fact_context_unit", f"select {INLINE}, case when not {_WRONG} then period_start end as start_date, case when not {_WRONG} then period_end end as end_date, '{inline.ISO4217}' as space, case when {_WRONG} or qidx % 10 = 5 then 'unsupported' else 'observed' end as state, case when not {_WRONG} and qidx % 10 <> 5 then cast(round(income, 0) as double) * 1000 end as value from {{flows}} where qidx % 10 <> 0")
def j22(t: Data) -> DataFrame:
    income = "{urn:gaap}Income"
    found = inline.document_facts(inline_documents(t), "doc", "owner", income)
    facts = inline.selected_facts(found, income, ["{urn:d}B={urn:d}two@segment", "{urn:d}A={urn:d}one@segment"])
    value = scalar.scaled_number(F.col("text"), F.col("scale"), F.col("sign"), F.element_at(F.split("form", "}"), -1))
    return facts.select("doc", "start_date", "end_date", F.regexp_extract(F.col("numerators")[0], r"\{(.*)\}USD", 1).alias("space"), "state", (value.cast("double") + F.lit(0.0)).alias("value"))


@query("F19_scaled_numbers", """select event_id, case when event_type = 'error' then 0.0 when event_type = 'click' and event_id % 5 = 0 then null else cast(w as double) * case event_id % 3 when 0 then 1 when 1 then 1000 else 1 end / case when event_id % 3 = 2 then 100 else 1 end * case when event_id % 2 = 0 then 1 else -1 end end as value
  from (select event_id, event_type, cast(round(value * 100) as bigint) as w from {events})""")
def f19(t: Data) -> DataFrame:
    """Errors show a dash that stands for zero, clicks bare digits (some with commas, not a number there),
    purchases a plus sign and a point, others commas under a transform."""
    whole = F.round(F.col("value") * 100, 0).cast("long")
    shown = F.format_number(whole, 0)
    kind, fifth = F.col("event_type"), F.col("event_id") % 5 == 0
    text = F.when(kind == "error", "-").when(kind == "click", F.when(fifth, F.concat(F.lit("1,"), shown)).otherwise(whole.cast("string"))).when(kind == "purchase", F.concat(F.lit(" +"), whole.cast("string"), F.lit(".\n"))).otherwise(shown)
    form = F.when(kind == "error", "fixed-zero").when(kind.isin("click", "purchase"), F.lit(None)).otherwise("num-dot-decimal")
    scale = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 3).otherwise(-2)
    value = scalar.scaled_number(text, scale, F.when(F.col("event_id") % 2 == 1, "-"), form)
    return t.events.select("event_id", (value.cast("double") + F.lit(0.0)).alias("value"))


@query("S7_read_years", "select year(l_shipdate) as year, count(*) as n from {lineitem} where l_shipdate >= timestamp '1997-01-01 00:00:00' and l_shipdate < timestamp '1999-01-01 00:00:00' group by 1")
def s7(t: Data) -> DataFrame:
    """Written by year once; the filter on the partition column prunes folders."""
    path = work_dir(t.spark, "by-year")
    bodies.write_by_year(t.lineitem.select("l_orderkey", "l_shipdate"), "l_shipdate", path)
    kept = t.spark.read.schema("l_orderkey long, l_shipdate timestamp_ntz, year int").parquet(path).filter("year between 1997 and 1998")
    return kept.groupBy(F.col("year").cast("long").alias("year")).agg(F.count("*").alias("n"))


def publication(t: Data) -> tuple[DataFrame, DataFrame]:
    batch = t.orders.select(F.col("o_orderkey").alias("input_hash"), F.col("o_orderstatus").alias("output_hash"))
    published = batch.filter("input_hash % 3 = 0").withColumn("output_hash", F.when(F.col("input_hash") % 30 == 0, "other").otherwise(F.col("output_hash")))
    return bodies.to_publish(batch, published, ["input_hash"], "output_hash")


@query("S8_publish_batch", "select o_orderkey as input_hash, case when o_orderkey % 3 <> 0 then 'append' else 'conflict' end as action from {orders} where o_orderkey % 3 <> 0 or o_orderkey % 30 = 0")
def s8(t: Data) -> DataFrame:
    new, conflict = publication(t)
    return new.select("input_hash", F.lit("append").alias("action")).unionByName(conflict.select("input_hash", F.lit("conflict").alias("action")))


@query("S9_publish_latest", """select coalesce(p.scope, o.scope) as scope, case when o.sequence > coalesce(p.sequence, -1) then o.sequence else p.sequence end as sequence, case when o.sequence > coalesce(p.sequence, -1) then o.snapshot else p.snapshot end as snapshot, case when o.scope is null then 'unchanged' when o.sequence > coalesce(p.sequence, -1) then 'moved' else 'kept' end as action
  from (select o_custkey as scope, max(o_orderkey) as sequence, max(o_orderkey) * 10 as snapshot from {orders} where o_orderstatus = 'F' group by 1) p full outer join (select o_custkey as scope, max(o_orderkey) as sequence, max(o_orderkey) * 10 + 1 as snapshot from {orders} where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1) o on o.scope = p.scope""")
def s9(t: Data) -> DataFrame:
    """Offers of urgent orders to the pointers of filled ones: a lower or equal sequence does not move them."""

    def pointers(rows: DataFrame, add: int) -> DataFrame:
        return rows.groupBy(F.col("o_custkey").alias("scope")).agg(F.max("o_orderkey").alias("sequence")).withColumn("snapshot", F.col("sequence") * 10 + add)

    return selection.forward_only(pointers(t.orders.filter("o_orderstatus = 'F'"), 0), pointers(t.orders.filter("o_orderpriority in ('1-URGENT', '2-HIGH')"), 1), ["scope"])


@query("S12_verify_bodies", "select page_id, case when page_id % 5 = 0 then 'hash_mismatch' when page_id % 5 = 1 then 'size_mismatch' end as problem from {pages}")
def s12(t: Data) -> DataFrame:
    digest = F.sha2(F.col("html").cast("binary"), 256)
    rows = t.pages.select("page_id", F.col("html").alias("body"), F.when(F.col("page_id") % 5 == 0, F.reverse(digest)).otherwise(digest).alias("expected_sha256"), (F.octet_length("html") + F.when(F.col("page_id") % 5 == 1, 1).otherwise(0)).alias("expected_bytes"))
    return bodies.verified(rows).select("page_id", "problem")


@query("S13_unavailable_batch", "select distinct user_id as request, 'source_unavailable' as flag, 0 as observations from {events} where event_type = 'error'")
def s13(t: Data) -> DataFrame:
    failed = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("request")).distinct()
    return failed.select("request", F.lit("source_unavailable").alias("flag"), F.lit(0).alias("observations"))


@query("P3_fact_numbers", """select event_id, state, case when state in ('observed', 'numeric_range_exceeded') then text when state = 'nonfinite' then 'NaN' when state = 'not_numeric' then w end as text, cast(case when state = 'observed' then number end as double) as number from (select *, case event_type when 'signup' then 'missing_field' when 'error' then 'null_value' when 'click' then 'nonfinite' when 'purchase' then case when value > 100 then 'not_numeric' else 'numeric_range_exceeded' end else 'observed' end as state,
    case event_type when 'purchase' then w || '00000000001' else w || '0E+1' end as text, cast(w as double) * 10 as number from (select *, case when value < 0 then '-' else '' end || cast(cast(floor(abs(value)) as bigint) as varchar(20)) || '.' || lpad(cast(cast(round(abs(value) * 100) as bigint) % 100 as varchar(2)), 2, '0') as w from {events}))""")
def p3(t: Data) -> DataFrame:
    """Numbers with a trailing zero and an exponent; purchases have thirteen places, or a number in quotes."""
    kind, size = F.col("event_type"), F.abs("value")
    plain = F.concat(F.when(F.col("value") < 0, "-").otherwise(""), F.floor(size).cast("string"), F.lit("."), F.lpad((F.round(size * 100).cast("long") % 100).cast("string"), 2, "0"))
    number = F.when(kind == "purchase", F.concat(plain, F.lit("00000000001"))).otherwise(F.concat(plain, F.lit("0E+1")))
    text = F.when(kind == "error", "null").when(kind == "click", '"NaN"').when((kind == "purchase") & (F.col("value") > 100), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(number)
    body = F.when(kind == "signup", '{"end":"x"}').otherwise(F.concat(F.lit('{"val":'), text, F.lit("}")))
    state, value, written = bodies.fact_number(F.parse_json(bodies.with_written_numbers(body, "val")), "val")
    return t.events.select("event_id", state.alias("state"), written.alias("text"), value.cast("double").alias("number"))


@query("P4_daily_labels", "select event_id, case when event_type in ('view', 'click', 'error') then cast(ts as date) end as day from {events}")
def p4(t: Data) -> DataFrame:
    day, kind = F.to_date("ts").cast("string"), F.col("event_type")
    label = F.when(kind == "view", F.concat(day, F.lit("T00:00:00Z"))).when(kind == "click", day).when(kind == "error", F.concat(day, F.lit("T00:00:00.000+05:30"))).when(kind == "purchase", F.concat(day, F.lit("T09:30:00Z"))).otherwise(F.lit("2024-02-30"))
    return t.events.select("event_id", bodies.day_label(label).alias("day"))


@query("P5_period_kinds", "select issuer, qidx, case when qidx % 5 = 0 then 'instant' when qidx % 5 = 1 then 'start_after_end' else 'duration' end as kind from {flows}")
def p5(t: Data) -> DataFrame:
    start = F.when(F.col("qidx") % 5 == 0, F.lit(None)).when(F.col("qidx") % 5 == 1, F.date_add("period_end", 1)).otherwise(F.col("period_start")).cast("date")
    return t.flows.select("issuer", "qidx", bodies.period(start, F.col("period_end")).alias("kind"))


@query("P6_unit_measures", "select p_partkey, case p_partkey % 4 when 0 then 'shares|' when 1 then 'USD|' when 2 then 'USD|shares' else 'unsupported' end as measures from {part}")
def p6(t: Data) -> DataFrame:
    key = F.when(F.col("p_partkey") % 4 == 0, "shares").when(F.col("p_partkey") % 4 == 1, "USD").when(F.col("p_partkey") % 4 == 2, "USD/shares").otherwise("pure")
    return t.part.select("p_partkey", scalar.unit_measures(key).alias("measures"))


@query("P7_issuer_ids", "select s_suppkey, case when s_suppkey % 2 = 0 then lpad(cast(s_suppkey as varchar), 10, '0') end as id from {supplier}")
def p7(t: Data) -> DataFrame:
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("s_suppkey")))
    return t.supplier.select("s_suppkey", scalar.issuer_id(raw).alias("id"))


@query("P8_concept_units", "select s_suppkey as issuer, concept, case when concept in ('weighted_average_shares_basic', 'weighted_average_shares_diluted', 'common_shares_outstanding') then 'shares' when concept in ('eps_basic', 'eps_diluted') then (case when s_nationkey < 12 then 'USD' else 'EUR' end) || '/shares' when concept = 'other' then null else case when s_nationkey < 12 then 'USD' else 'EUR' end end as unit from {supplier} cross join (select unnest([" + ", ".join(f"'{c}'" for c in (*CONCEPTS, "other")) + "]) as concept) c")
def p8(t: Data) -> DataFrame:
    currency = F.when(F.col("s_nationkey") < 12, "USD").otherwise("EUR")
    asked = t.supplier.select(F.col("s_suppkey").alias("issuer"), currency.alias("currency"), F.explode(F.array(*[F.lit(c) for c in (*CONCEPTS, "other")])).alias("concept"))
    return asked.select("issuer", "concept", expected_unit(F.col("concept"), F.col("currency")).alias("unit"))


@query("P10_reference_date_fits", "select issuer, qidx, frequency, case frequency when 'daily' then true when 'monthly' then true when 'quarterly' then true else month(period_start) = 1 end as fits, false as end_fits from {flows} cross join (values ('monthly'), ('quarterly'), ('yearly')) f(frequency)")
def p10(t: Data) -> DataFrame:
    rows = t.flows.select("issuer", "qidx", "period_start", "period_end", F.explode(F.array(F.lit("monthly"), F.lit("quarterly"), F.lit("yearly"))).alias("frequency"))
    return rows.select("issuer", "qidx", "frequency", bodies.date_fits(F.col("period_start"), F.col("frequency")).alias("fits"), bodies.date_fits(F.col("period_end"), F.col("frequency")).alias("end_fits"))


@query("P26_filing_fields", """select o_orderkey, concat_ws('|', case when o_orderpriority = '1-URGENT' then 'acceptance_timezone_unverified' end, case when o_orderpriority = '2-HIGH' then 'accession_malformed' end, case when o_orderpriority = '3-MEDIUM' then 'unsafe_document_path' end) as reasons, case when o_orderpriority <> '1-URGENT' then o_orderdate - interval 5 hour end as acceptance_at from {orders}""")
def p26(t: Data) -> DataFrame:
    kind = F.col("o_orderpriority")
    accession = F.when(kind == "2-HIGH", F.lit("12-3")).otherwise(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-24-000001")))
    path = F.when(kind == "3-MEDIUM", F.lit("../a.htm")).otherwise(F.lit("a.htm"))
    label = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(kind == "1-URGENT", "").otherwise("+05:00"))
    at, codes = bodies.filing_fields(accession, path, label)
    return t.orders.select("o_orderkey", flags.text(codes).alias("reasons"), at.cast("timestamp_ntz").alias("acceptance_at"))


@query("P27_history_completeness", """select issuer, source_ref, concat_ws('|', case when b + 200 < greatest(d, date '1999-12-31') or a > least(c, d) then 'event_history_incomplete' end, case when a > least(c, d) or b < greatest(d, date '1999-12-31') then 'filing_history_incomplete' end) as reasons
  from (select issuer, source_ref, date '1996-01-01' + cast(issuer % 400 as int) as a, date '2000-06-01' - cast(issuer % 300 as int) as b, last_day(effective_from) as c, effective_from + 40 as d from {membership})""")
def p27(t: Data) -> DataFrame:
    """Inventories and event reviews of each issuer span different dates; a fact asks for those between its
    period or filing and its filing or retrieval."""
    low, high = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("issuer") % 400).cast("int")), F.date_sub(F.lit("2000-06-01").cast("date"), (F.col("issuer") % 300).cast("int"))
    codes = bodies.history_gaps(F.last_day("effective_from"), F.date_add("effective_from", 40), F.lit("1999-12-31").cast("date"), (low, high), (low, F.date_add(high, 200)))
    return t.membership.select("issuer", "source_ref", flags.text(codes).alias("reasons"))


VIEWS["mapping_rules"] = "select o_orderstatus as status, o_orderpriority as priority, cast(year(o_orderdate) as int) as year from {orders} where o_totalprice > 180000 and o_orderstatus <> 'O' group by 1, 2, 3 union all select o_orderstatus, o_orderpriority, cast(year(o_orderdate) as int) from {orders} where o_orderstatus = 'F' group by 1, 2, 3 having max(o_totalprice) > 250000"


@query("J23_mapping_rules", "select o_orderkey as request, case when count(r.status) = 0 then 'unsupported_scope' when count(r.status) > 1 then 'rule_conflict' else 'mapped' end as state from {orders} left join {mapping_rules} r on r.status = o_orderstatus and r.priority = o_orderpriority and r.year = year(o_orderdate) group by 1")
def j23(t: Data) -> DataFrame:
    asked = t.orders.select(F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    return selection.rule_states(asked, t.mapping_rules, ["status", "priority", "year"]).select("request", "state")


VIEWS["resolution_rows"] = """select l_orderkey as request, l_linenumber % 3 as concept, l_returnflag as tag, l_linestatus as detail, cast(case when l_partkey % 50 = 0 then null else round(l_quantity / 25) end as int) as value, l_suppkey * 1000000 + l_partkey as place,
    case when o_orderpriority = '5-LOW' then case when o_orderstatus = 'P' then 'source_missing' else 'partial' end else 'covered' end as coverage, case o_orderpriority when '4-NOT SPECIFIED' then 0 when '3-MEDIUM' then case when o_orderstatus = 'P' then 2 else 1 end else 1 end as rules, l_tax > 0.07 as conflict, case when o_orderpriority = '2-HIGH' then 'N' end as preferred from {lineitem} join {orders} on o_orderkey = l_orderkey"""


@query("A3_observation_resolution", """with g as (select request, concept, min(coverage) as c, max(rules) as rules, bool_or(conflict) as conflict, count(case when value is null then 1 end) as gaps, count(distinct value) as n, count(distinct tag) as tags, count(distinct detail) as details, coalesce(bool_or(tag = preferred), false) as has, count(distinct case when tag = preferred then detail end) as own, min(value) as v from {resolution_rows} group by 1, 2)
  select request, concept, case when c <> 'covered' then 'missing' when rules = 0 then 'unsupported_scope' when rules > 1 or conflict then 'ambiguous' when gaps > 0 then 'missing' when n > 1 or (tags > 1 and not has) or (case when has then own else details end) > 1 then 'ambiguous' else 'observed' end as state,
    case when c = 'source_missing' then c when c <> 'covered' then 'unresolved_coverage' when rules = 0 then 'no_reviewed_complete_scope_tag' when rules > 1 then 'conflicting_mapping_rules' when conflict then 'filing_metadata_conflict' when gaps > 0 then 'missing_value' when n > 1 then 'conflicting_reviewed_observations' when tags > 1 and not has then 'equivalent_tags_without_reviewed_preference' when (case when has then own else details end) > 1 then 'same_value_different_source_metadata' end as reason,
    case when c = 'covered' and rules = 1 and not conflict and gaps = 0 and n = 1 and (tags = 1 or has) and (case when has then own else details end) = 1 then v end as value from g""")
def a3(t: Data) -> DataFrame:
    return bodies.resolution(t.resolution_rows, ["request", "concept"])


FORM = "case when o_orderpriority = '1-URGENT' then '10-K/A' when o_orderpriority = '5-LOW' then '8-K' else '10-K' end"
VIEWS["filed_orders"] = f"select o_custkey as issuer, o_orderkey as accession, {FORM} as form, o_orderdate as day, o_totalprice as price, o_orderstatus as status from {{orders}}"


@query("R1_filing_change_feed", """with o as (select *, form in ('10-K', '10-K/A') as counts from {filed_orders}), b0 as (select issuer, accession, counts, 'as filed' as content from o where day < timestamp '2000-01-01 00:00:00'),
  p1 as (select issuer, accession, form, counts, case when price > 300000 then 'amended' else 'as filed' end as content, status <> 'P' as complete from o where day < timestamp '2000-07-01 00:00:00' and price >= 20000),
  f1 as (select issuer, bool_or(not complete) as part, count(case when counts and accession not in (select accession from b0) then 1 end) as added, count(case when form = '10-K/A' and accession not in (select accession from b0) then 1 end) as amended, bool_or(counts and content = 'amended' and accession in (select accession from b0)) as changed from p1 group by 1),
  g1 as (select f1.*, issuer in (select issuer from b0) as known, issuer in (select issuer from b0 where counts and accession not in (select accession from p1)) as gone from f1),
  r1 as (select *, concat_ws('|', case when gone then 'baseline_accession_missing' end, case when part then 'current_inventory_incomplete' end, case when changed then 'existing_accession_metadata_changed' end) as flags from g1),
  b1 as (select * from b0 where issuer not in (select issuer from r1 where flags = '') union all select issuer, accession, counts, content from p1 where issuer in (select issuer from r1 where flags = '')),
  f2 as (select o.issuer, count(case when o.counts and b1.accession is null then 1 end) as added, count(case when form = '10-K/A' and b1.accession is null then 1 end) as amended, bool_or(o.counts and coalesce(b1.content = 'amended', false)) as changed from o left join b1 on b1.accession = o.accession group by 1),
  r2 as (select *, issuer in (select issuer from b1) as known, case when changed then 'existing_accession_metadata_changed' else '' end as flags from f2),
  e as (select issuer, 0 as poll, false as known, 0 as added, 0 as amended, '' as flags from b0 group by 1 union all select issuer, 1, known, added, amended, flags from r1 union all select issuer, 2, known, added, amended, flags from r2)
  select issuer, cast(poll as bigint) as poll, case when not known and flags = '' then 0 else added - amended end as originals, case when not known and flags = '' then 0 else amended end as amendments, flags, case when flags <> '' then 'incomplete' when not known then 'baseline' when added > amended and amended > 0 then 'mixed_changes' when added > amended then 'new_filing' when amended > 0 then 'amendment' else 'no_change' end as outcome from e""")
def r1(t: Data) -> DataFrame:
    """Three polls: a stream over the filings up to a day; half a year later, with small filings gone, large ones
    amended and some issuers' answers not complete; and all filings as they were."""
    form = F.expr(FORM)

    def polled(rows: DataFrame, content=F.lit("as filed"), complete=F.lit(True)) -> DataFrame:
        return rows.select(F.col("o_custkey").alias("issuer"), F.col("o_orderkey").alias("accession"), form.alias("form"), F.col("o_orderdate").alias("acceptance_at"), F.lit("2100-01-01 00:00:00").cast("timestamp_ntz").alias("cutoff"), content.alias("content"), complete.alias("complete"), F.lit(True).alias("described"))

    stream = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.sf_dir}/orders.parquet*").filter("o_orderdate < timestamp_ntz '2000-01-01 00:00:00'")
    feed = ChangeFeed(t.spark, work_dir(t.spark, "feed"))
    feed.start(polled(stream)).awaitTermination()
    second = t.orders.filter("o_orderdate < timestamp_ntz '2000-07-01 00:00:00' and o_totalprice >= 20000")
    feed.apply(polled(second, F.when(F.col("o_totalprice") > 300000, "amended").otherwise("as filed"), F.col("o_orderstatus") != "P"), 1)
    feed.apply(polled(t.orders), 2)
    return feed.outcomes().select("issuer", "poll", "originals", "amendments", flags.text(F.col("flags")).alias("flags"), "outcome")


@query("R2_backfill_keeps_newest", """with s as (select issuer, series, reference_date, response % 3 as part from {series}), k as (select *, (select max(reference_date) from s b where b.issuer = a.issuer and b.series = a.series and b.part < a.part) as before from s a)
  select issuer, series, max(reference_date) as reference_date, count(*) as observations, count(case when reference_date < before then 1 end) as late from k group by 1, 2""")
def r2(t: Data) -> DataFrame:
    """Three parts of the observations, one after another, the stream begun again for each."""
    source, feed = work_dir(t.spark, "observations"), SeriesFeed(t.spark, work_dir(t.spark, "series"), ["issuer", "series"])
    for part in range(3):
        t.series.filter(F.col("response") % 3 == part).select("issuer", "series", "reference_date").write.parquet(f"{source}/part={part}")
        rows = t.spark.readStream.schema("issuer long, series string, reference_date date").option("recursiveFileLookup", "true").parquet(source)
        feed.start(rows).awaitTermination()
    return feed.newest()

"""Statements as known to a request: from its pinned evidence to the facts of one edition, with reasons.

A request pins batches, captures, events and quality flags and names a period, a scope and concepts. Each
step joins only what the requests still in play can reach, by their keys, and adds to their state; the
first step that fails ends a request with its one reason, and all its facts are unavailable. Requests are
rows, so a job reads any number of them at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.functions.storage import stored

ORIGINAL, LATEST = "original_as_filed", "latest_reported"
#: Events that take back what a filing said (fixed values).
TAKEN_BACK = ("non_reliance", "withdrawal")
SEVERE = ("error", "blocking")


@dataclass(frozen=True)
class Evidence:
    """The tables of evidence.

    batches: batch, issuer, mapping, normalizer, policy, state, input_hash, output_hash. inputs: batch, role,
    capture. captures: capture, source, object_key, fetched_at, completed_at, body_hash. filings: version,
    filing, issuer, filed, acceptance_at (null unless its zone is verified), metadata_capture. coverage:
    coverage, batch, version, period, family, scope, currency, authority, assurance, state, basis.
    resolutions: resolution, coverage, concept, scope, unit, instrument, status, observation. observations:
    observation, capture, value. events: event, issuer, kind, announced, version; event_scopes: event,
    filing, period, concept. quality: flag, issuer, batch, period, security, resolution, severity.
    """

    batches: DataFrame
    inputs: DataFrame
    captures: DataFrame
    filings: DataFrame
    coverage: DataFrame
    resolutions: DataFrame
    observations: DataFrame
    events: DataFrame
    event_scopes: DataFrame
    quality: DataFrame


def _first(**when: Column) -> Column:
    """The first code, in the order given, whose condition holds."""
    out = F.lit(None).cast("string")
    for code, condition in reversed(when.items()):
        out = F.when(F.coalesce(condition, F.lit(False)), code).otherwise(out)
    return out


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _of(requests: DataFrame, names: str, name: str, *more: str) -> DataFrame:
    """A row for each member of a request's list."""
    return requests.select("request", *more, F.explode(names).alias(name))


#: Places of the map that :func:`reached` asks, whatever the number of keys.
PLACES = 1 << 26


def reached(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` less most of those whose key is not among ``keys``, before a join moves them.

    The places of the keys' hashes are marked in a map of fixed size, which is broadcast. It loses no row that
    the join finds: keys that share a place let each other's rows through. Keys of two types are left to the join.
    """
    if rows.schema[key].dataType != keys.schema[key].dataType:
        return rows
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    bit = F.expr("shiftleft(1L, cast(_place % 64 as int))")
    marks = keys.select(place.alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_marks"))
    here = F.expr(f"shiftright(pmod(xxhash64({key}), {PLACES}L), 6)") == F.col("_word")
    marked = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64L) as int)) & _marks") != 0
    return rows.join(F.broadcast(marks), here & marked, "left_semi")


def source_vintages(pinned: DataFrame, by: str) -> DataFrame:
    """by, capture, chosen and torn of each capture (by, source, object_key, role, capture, fetched_at, body_hash).

    The newest capture of each object and role is chosen; different bytes at that time are ambiguous. A capture
    that is chosen in one role and superseded in another tears its request.
    """
    role = Window.partitionBy(by, "source", "object_key", "role")
    marked = pinned.withColumn("newest", F.col("fetched_at") == F.max("fetched_at").over(role))
    at = F.when(F.col("newest"), F.col("body_hash"))
    marked = marked.withColumn("tied", F.min(at).over(role) != F.max(at).over(role))
    return marked.groupBy(by, "capture").agg(_any(F.col("newest")).alias("chosen"), (_any(F.col("newest")) & _any(~F.col("newest"))).alias("torn"), _any(F.col("tied")).alias("tied"))


def sourced(e: Evidence) -> Evidence:
    """The same evidence, its events with their filing's metadata capture (null without a filing); they meet the filings once."""
    if "metadata_capture" in e.events.columns:
        return e
    events = stored(e.events, "events")
    filings = reached(e.filings.select("version", "metadata_capture"), events, "version")
    return replace(e, events=stored(events.join(filings, "version", "left"), "sourced"))


#: What requests of one pin, and of one case, share.
PIN = ("issuer", "mapping", "normalizer", "policy", "captured_before", "batches", "captures")
CASE = (*PIN, "period", "security", "events", "quality")


def _id(columns: tuple[str, ...]) -> Column:
    """Sixteen bytes for a row's values."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def bundles(requests: DataFrame, e: Evidence) -> DataFrame:
    """The first reason against each request's evidence, and its chosen captures: request, reason, chosen.

    Requests mostly pin the same as others, so evidence meets each distinct pin (batches and captures) or case
    (with events and quality flags) once, and the requests meet the outcome of their case.
    """
    same = ("issuer", "mapping", "normalizer", "policy")
    cases = stored(requests.select(*CASE).distinct().select(_id(CASE).alias("case"), _id(PIN).alias("pin"), *CASE), "cases")
    pins = cases.select("pin", *PIN).distinct()
    batches = pins.select("pin", F.explode("batches").alias("batch"), *[F.col(c).alias(f"_{c}") for c in same])
    met = batches.join(e.batches, "batch", "left").withColumn("lost", ~F.col("state").eqNullSafe(F.lit("published")))
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(f"_{c}").eqNullSafe(F.col(c))
    twice = Window.partitionBy("pin", "input_hash")
    met = met.withColumns({"other": differs, "odd": F.min("output_hash").over(twice) != F.max("output_hash").over(twice)})
    by_batch = met.groupBy("pin").agg(_any(F.col("lost")).alias("lost"), _any(F.col("other")).alias("other"), _any(F.col("odd")).alias("odd"))

    pinned = batches.select("pin", "batch").join(e.inputs, "batch").join(e.captures, "capture").join(pins.select("pin", "captured_before"), "pin")
    late = ~F.coalesce((F.col("fetched_at") <= F.col("captured_before")) & (F.col("completed_at") <= F.col("captured_before")), F.lit(False))
    vintages = stored(source_vintages(pinned, "pin"), "vintages")
    by_capture = pinned.groupBy("pin").agg(F.array_sort(F.collect_set("capture")).alias("held"), _any(late).alias("late"))
    by_vintage = vintages.groupBy("pin").agg(_any(F.col("tied")).alias("tied"), _any(F.col("torn")).alias("torn"), F.collect_list(F.when(F.col("chosen"), F.col("capture"))).alias("chosen"))
    outcome = pins.select("pin", "captures")
    for found in (by_batch, by_capture, by_vintage):
        outcome = outcome.join(found, "pin", "left")
    manifest = ~F.coalesce(F.col("held") == F.array_sort(F.array_distinct("captures")), F.lit(False))
    chosen = F.coalesce("chosen", F.array().cast(vintages.select(F.array("capture").alias("c")).schema["c"].dataType))
    outcome = stored(outcome.select("pin", F.coalesce("lost", F.lit(True)).alias("lost"), "other", "odd", manifest.alias("manifest"), "late", "tied", "torn", chosen.alias("chosen")), "outcome")

    events = cases.select("case", "pin", F.explode("events").alias("event"), F.col("issuer").alias("_issuer"))
    seen = events.join(sourced(e).events.select("event", "issuer", "metadata_capture"), "event", "left").join(pins.select("pin", "captures").join(outcome.select("pin", "chosen"), "pin"), "pin")
    held = lambda captures: F.coalesce(F.array_contains(captures, F.col("metadata_capture")), F.lit(False))
    foreign = ~(F.col("issuer").eqNullSafe(F.col("_issuer")) & held("captures"))
    by_event = seen.groupBy("case").agg(_any(foreign).alias("foreign"), _any(~held("chosen")).alias("outdated"))

    quality = cases.select("case", F.explode("quality").alias("flag"), "batches", *[F.col(c).alias(f"_{c}") for c in ("issuer", "period", "security")])
    noted = quality.join(e.quality, "flag", "left")
    fits = F.col("issuer").eqNullSafe(F.col("_issuer"))
    for c, scope in (("period", F.col("period").eqNullSafe(F.col("_period"))), ("security", F.col("security").eqNullSafe(F.col("_security"))), ("batch", F.coalesce(F.array_contains("batches", F.col("batch")), F.lit(False)))):
        fits = fits & (F.col(c).isNull() | scope)
    by_quality = noted.groupBy("case").agg(_any(~fits).alias("misplaced"))

    every = cases.select("case", "pin").join(by_event, "case", "left").join(by_quality, "case", "left").join(outcome, "pin")
    reason = _first(
        unpublished_or_missing_batch=F.col("lost"), incompatible_batch_revision=F.col("other"), nondeterministic_normalization=F.col("odd"),
        incompatible_capture_manifest=F.col("manifest"), capture_unavailable=F.col("late"), incompatible_event_manifest=F.col("foreign"),
        incompatible_quality_manifest=F.col("misplaced"), ambiguous_capture_vintage=F.col("tied"), incompatible_source_roles=F.col("torn"), incompatible_event_vintage=F.col("outdated"),
    )
    asked = requests.select("request", _id(CASE).alias("case"))
    return stored(asked.join(every.select("case", reason.alias("reason"), "chosen"), "case").select("request", "reason", "chosen"), "reasons")


def sound(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests that nothing is held against, with their chosen captures."""
    return requests.join(states.filter("reason is null").select("request", "chosen"), "request")


def covered(requests: DataFrame, e: Evidence) -> DataFrame:
    """The eligible coverage of each sound request with its filing: of its batches, period, family and scope, in its
    currency or none, from a chosen metadata capture, of an allowed authority, audited if asked, filed by the cutoff."""
    asked = requests.select("request", F.explode("batches").alias("batch"), "period", "family", "scope", F.col("currency").alias("_currency"), "mode", "filed_cutoff", "audited", "allow_reviewed", "chosen")
    asked = stored(asked, "asked")  # dealt by the keys it meets coverage by, of whatever size, as the edition is looked for there
    filings = e.filings.select("version", "filing", "filed", "acceptance_at", F.col("metadata_capture").alias("capture"))
    filed = reached(e.coverage, asked, "batch").filter(F.col("authority").isin("periodic_complete", "reviewed_equivalent")).join(filings, "version")  # once, not for each request
    filed = filed.withColumns({"reviewed": F.col("authority") == "reviewed_equivalent", "unaudited": ~F.col("assurance").eqNullSafe(F.lit("audited")), "unresolved": F.col("currency").isNull() | ~F.col("state").eqNullSafe(F.lit("covered"))}).drop("authority", "assurance", "state")
    rows = asked.hint("merge").join(filed, ["batch", "period", "family", "scope"]).filter(F.col("currency").isNull() | (F.col("currency") == F.col("_currency")))
    allowed = ~F.col("reviewed") | F.col("allow_reviewed")
    return rows.filter(F.array_contains("chosen", F.col("capture")) & allowed & ~(F.col("audited") & F.col("unaudited")) & (F.col("filed_cutoff").isNull() | (F.col("filed") <= F.col("filed_cutoff"))))


def edition(rows: DataFrame) -> DataFrame:
    """The coverage of the first or last filing date of each request, and the reason against it.

    Several versions of that date go by acceptance times, if all are verified, else their order is ambiguous. Rows
    lie by the keys that coverage meets requests by; those that are not at the extreme there go no further.
    """
    ask, near = Window.partitionBy("request"), Window.partitionBy("request", "batch", "period", "family", "scope")
    turn = F.when(F.col("mode") == ORIGINAL, -1).otherwise(1)
    ends = rows.withColumn("_day", turn * F.unix_date("filed")).withColumn("_time", turn * F.unix_micros(F.col("acceptance_at").cast("timestamp")))
    ends = ends.withColumn("_near", F.max("_day").over(near)).filter(F.col("_day") == F.col("_near")).select("request", "coverage", "version", "filing", "filed", "basis", "unresolved", "_day", "_time")
    ends = ends.withColumn("_last", F.max("_day").over(ask)).filter(F.col("_day") == F.col("_last"))
    ends = ends.withColumns({"_several": F.min("version").over(ask) != F.max("version").over(ask), "_timed": F.count("_time").over(ask) == F.count(F.lit(1)).over(ask), "_latest": F.max("_time").over(ask)})
    ends = ends.filter(~F.col("_several") | ~F.col("_timed") | (F.col("_time") == F.col("_latest")))
    ends = ends.withColumn("_open", F.min("version").over(ask) != F.max("version").over(ask))
    basis = F.coalesce("basis", F.lit(""))  # none beside another one differs from it
    reason = _first(ambiguous_filing_order=F.col("_open"), incompatible_reporting_basis=F.min(basis).over(ask) != F.max(basis).over(ask), unresolved_coverage=F.bool_or("unresolved").over(ask))
    return ends.select("request", "coverage", "version", "filing", "filed", "basis", reason.alias("reason"))


def facts(requests: DataFrame, editions: DataFrame, e: Evidence) -> DataFrame:
    """request, concept, status, value and resolutions of every concept asked of an edition.

    No resolution is missing, differing ones are ambiguous; a value from a capture that is not chosen is stale.
    """
    of = editions.groupBy("request").agg(F.collect_set("coverage").alias("coverages"))
    asked = stored(requests.select("request", "concepts", "scope", "unit", "instrument", "chosen").join(of, "request"), "asked").withColumn("concept", F.explode("concepts"))
    found = asked.select("request", "concept", "scope", "unit", "instrument", "chosen", F.explode("coverages").alias("coverage")).join(reached(e.resolutions, editions, "coverage").withColumnRenamed("instrument", "_instrument"), ["coverage", "concept", "scope", "unit"])
    found = stored(found.filter(F.col("_instrument").eqNullSafe(F.col("instrument"))).select("request", "concept", "chosen", "resolution", "status", "observation"), "found")
    found = found.join(reached(e.observations.select("observation", "capture", "value"), found, "observation"), "observation", "left")
    sign = F.struct("status", "value", "observation")
    stale = F.col("observation").isNotNull() & ~F.coalesce(F.array_contains("chosen", F.col("capture")), F.lit(False))
    grouped = found.groupBy("request", "concept").agg(F.min(sign).alias("low"), F.max(sign).alias("high"), _any(stale).alias("stale"), F.array_sort(F.collect_set("resolution")).alias("resolutions"))
    whole = asked.select("request", "concept").join(grouped, ["request", "concept"], "left")
    status = F.when(F.col("resolutions").isNull(), "missing").when(~F.col("low").eqNullSafe(F.col("high")), "ambiguous").when(F.col("stale"), "stale_source").otherwise(F.col("low.status"))
    return whole.select("request", "concept", status.alias("status"), F.when(status == "observed", F.col("low.value")).alias("value"), F.coalesce("resolutions", F.array().cast(grouped.schema["resolutions"].dataType)).alias("resolutions"))


def severe_quality(requests: DataFrame, found: DataFrame, e: Evidence) -> DataFrame:
    """Requests with an error among the flags they pin, their batches' flags for all or their period, or those of
    their resolutions: three equi joins, united."""
    severe = e.quality.filter(F.col("severity").isin(*SEVERE))
    named = _of(requests, "quality", "flag").join(severe.select("flag"), "flag", "left_semi").select("request")
    batches = _of(requests, "batches", "batch", F.col("period").alias("_period"))
    whole = batches.join(severe.filter("resolution is null").select("batch", "period"), "batch").filter(F.col("period").isNull() | (F.col("period") == F.col("_period"))).select("request")
    own = found.select("request", F.explode("resolutions").alias("resolution")).join(batches.select("request", "batch"), "request").join(severe.select("batch", "resolution"), ["batch", "resolution"], "left_semi").select("request")
    return named.unionByName(whole).unionByName(own).distinct()


def taken_back(requests: DataFrame, editions: DataFrame, e: Evidence) -> DataFrame:
    """request and kind of the events, among those pinned, that take back the edition's filing for its period and concepts."""
    asked = _of(requests, "events", "event", F.col("issuer").alias("_issuer"), F.col("period").alias("_period"), "concepts", "filed_cutoff", "chosen")
    kinds = sourced(e).events.filter(F.col("kind").isin(*TAKEN_BACK)).select("event", "issuer", "kind", "announced", F.col("metadata_capture").alias("capture"))
    met = asked.join(kinds, "event").filter((F.col("issuer") == F.col("_issuer")) & (F.col("filed_cutoff").isNull() | (F.col("announced") <= F.col("filed_cutoff"))))
    met = met.filter(F.array_contains("chosen", F.col("capture"))).join(e.event_scopes, "event")
    met = met.filter((F.col("period").isNull() | (F.col("period") == F.col("_period"))) & (F.col("concept").isNull() | F.array_contains("concepts", F.col("concept"))))
    return met.join(editions.select("request", "filing"), ["request", "filing"], "left_semi").select("request", "kind").distinct()


def read(requests: DataFrame, e: Evidence) -> DataFrame:
    """request, flags, usable, basis, filed, versions and facts (concept, status, value, resolutions) of each request.

    ``requests``: request, issuer, security, mapping, normalizer, policy, period, family, scope, unit, currency,
    instrument, mode, history_complete, filed_cutoff, captured_before, audited, allow_reviewed, and the lists
    concepts, batches, captures, events, quality.
    """
    # numbers stand for requests, whatever names them, in all that moves in between
    requests = stored(requests.withColumnRenamed("request", "_name").withColumn("request", F.monotonically_increasing_id()), "requests")
    e = sourced(e)
    reasons = bundles(requests, e)
    good_requests = sound(requests, reasons)
    picked = stored(edition(covered(good_requests, e)), "editions")
    summary = picked.groupBy("request").agg(F.first("reason").alias("edition_reason"), F.max("filed").alias("filed"), F.max("basis").alias("basis"), F.array_sort(F.collect_set("version")).alias("versions"))
    good = picked.filter("reason is null")
    held = stored(facts(good_requests, good, e), "facts")
    shown = held.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("concept", "status", "value", "resolutions"))).alias("facts"), _any(F.col("status") == "ambiguous").alias("ambiguous"), _any(~F.col("status").isin("observed", "ambiguous")).alias("unresolved"))
    severe = severe_quality(good_requests, held, e).withColumn("severe", F.lit(True))
    events = taken_back(good_requests, good, e).groupBy("request").agg(F.collect_set("kind").alias("kinds"))
    whole = requests.select("request", "_name", "concepts", "mode", "history_complete")
    for part in (reasons.drop("chosen"), summary, shown, severe, events):
        whole = whole.join(part, "request", "left")
    read_ = F.col("facts").isNotNull()
    codes = flags.reasons(
        coverage_unavailable=F.col("reason").isNull() & F.col("versions").isNull(), unresolved_concept=F.col("unresolved"), ambiguous_resolution=F.col("ambiguous"), blocking_quality_flag=read_ & F.col("severe"),
        earliest_available=read_ & (F.col("mode") == ORIGINAL) & ~F.col("history_complete"), revised_view=read_ & (F.col("mode") == LATEST),
    )
    nothing = F.array().cast("array<string>")
    codes = flags.union(codes, F.array("reason", "edition_reason"), F.when(read_, F.coalesce("kinds", nothing)).otherwise(nothing))
    kind = shown.schema["facts"].dataType.simpleString()
    absent = F.transform("concepts", lambda c: F.struct(c.alias("concept"), F.lit("unavailable").alias("status"), F.lit(None).alias("value"), F.array().alias("resolutions"))).cast(kind)
    out = whole.select(F.col("_name").alias("request"), codes.alias("flags"), "basis", "filed", F.coalesce("versions", F.array().cast(summary.schema["versions"].dataType)).alias("versions"), F.coalesce("facts", absent).alias("facts"))
    usable = (F.size(flags.blocking(F.col("flags"))) == 0) & F.forall("facts", lambda f: f["status"] == "observed")
    return out.withColumn("usable", usable)

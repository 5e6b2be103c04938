"""Point-in-time selection: versions, editions, captures, responses, conflicts and as-of joins.

One rule throughout: choose the version first and look at its value afterwards; a tie between different
contents is ambiguous and is never broken by the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags
from pitspark.functions.storage import work_dir


def newest(rows: DataFrame, by: list[str], time: str, content: Column, latest: bool = True) -> DataFrame:
    """One row for each group: the newest (or oldest) time, its content, and whether contents differ there.

    One aggregation on the group after a windowless join-free step: the extreme time is found with the
    distinct contents at it, so a hot group is combined before the shuffle.
    """
    extreme = F.max if latest else F.min
    at = rows.groupBy(*by, time).agg(F.min(content).alias("low"), F.max(content).alias("high"), F.count("*").alias("rows_at"))
    packed = at.groupBy(*by).agg(extreme(F.struct(time, "low", "high", "rows_at")).alias("x"))
    tied = F.coalesce(F.col("x.low") != F.col("x.high"), F.lit(False))
    return packed.select(*by, F.col(f"x.{time}").alias(time), F.when(~tied, F.col("x.low")).alias("content"), tied.alias("ambiguous"), F.col("x.rows_at").alias("rows_at"))


def editions(rows: DataFrame, by: list[str], latest: bool) -> DataFrame:
    """The original or latest edition of each fact by filing date; different values on one date are ambiguous."""
    chosen = newest(rows, by, "filed", F.col("value"), latest)
    reason = F.when(F.col("ambiguous"), "ambiguous_filing_order")
    return chosen.select(*by, "filed", F.col("content").alias("value"), reason.alias("reason"))


def chosen_versions(rows: DataFrame, by: list[str], latest: bool) -> DataFrame:
    """The filing version of the extreme filing date of each key, and the reasons against it.

    ``rows`` (by, version, filed, acceptance_at, basis, currency, state, complete): several versions of that date go
    by acceptance time, if all have a verified one (not null), else the order is ambiguous. More than one
    basis, a null currency or a state other than covered leave the choice unusable: an older version never
    stands in. ``revised_view`` informs about the mode, and ``earliest_available`` where the history
    (``complete``, for all rows of a key) does not reach back to the first filing.
    """
    extreme = F.max if latest else F.min
    rows = rows.withColumn("basis", F.coalesce("basis", F.lit("")))  # none beside another one differs from it
    bad = F.bool_or(F.col("currency").isNull() | ~F.col("state").eqNullSafe(F.lit("covered"))).alias("bad")
    ends = [f(c).alias(f"{n}_{c}") for c in ("version", "basis") for n, f in (("low", F.min), ("high", F.max))]
    at = rows.groupBy(*by, "filed", "acceptance_at").agg(*ends, bad, F.bool_and("complete").alias("complete"))
    time = F.struct("acceptance_at", *[f"{n}_{c}" for c in ("version", "basis") for n in ("low", "high")], "bad")
    day = at.groupBy(*by, "filed").agg(
        F.bool_and(F.col("acceptance_at").isNotNull()).alias("verified"), extreme(F.when(F.col("acceptance_at").isNotNull(), time)).alias("at"),
        *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in ("version", "basis") for n, f in (("low", F.min), ("high", F.max))], F.bool_or("bad").alias("bad"), F.bool_and("complete").alias("complete"),
    )
    packed = day.groupBy(*by).agg(extreme(F.struct("filed", *[c for c in day.columns if c not in (*by, "filed", "complete")])).alias("x"), F.bool_and("complete").alias("complete"))
    several = F.col("x.low_version") != F.col("x.high_version")
    by_time = several & F.col("x.verified") & (F.col("x.at.low_version") == F.col("x.at.high_version"))
    end = lambda c: F.when(by_time, F.col(f"x.at.{c}")).otherwise(F.col(f"x.{c}"))
    codes = {"ambiguous_filing_order": several & ~by_time, "incompatible_reporting_basis": end("low_basis") != end("high_basis"), "unresolved_coverage": end("bad")}
    reason = F.lit(None).cast("string")
    for code, condition in reversed(codes.items()):
        reason = F.when(condition, code).otherwise(reason)
    return packed.select(*by, F.col("x.filed").alias("filed"), F.when(~several | by_time, end("low_version")).alias("version"), reason.alias("reason"), (F.lit("revised_view") if latest else F.when(~F.col("complete"), "earliest_available")).alias("mode"))


def source_captures(rows: DataFrame, by: list[str]) -> DataFrame:
    """The newest capture content of each object and role (by, role, capture, fetched_at, body_hash).

    Different contents at one time are ambiguous. A capture that is newest in one role and superseded in
    another makes its object's roles incompatible, rather than giving stale bytes new life.
    """
    chosen = newest(rows, [*by, "role"], "fetched_at", F.col("body_hash"))
    marked = rows.join(chosen.select(*by, "role", F.col("fetched_at").alias("_newest")), [*by, "role"])
    uses = marked.groupBy(*by, "capture").agg(F.max(F.col("fetched_at") == F.col("_newest")).alias("first"), F.max(F.col("fetched_at") < F.col("_newest")).alias("later"))
    torn = uses.filter("first and later").select(*by).distinct().withColumn("_torn", F.lit(True))
    joined = chosen.join(torn, by, "left")
    reason = F.when(F.col("ambiguous"), "ambiguous_capture_vintage").when(F.col("_torn"), "incompatible_source_roles")
    return joined.select(*by, "role", "fetched_at", F.when(reason.isNull(), F.col("content")).alias("body_hash"), reason.alias("reason"))


def freshness(attempts: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """Flags of each object by its attempts (by, state, finished_at): success, not_modified (a revalidation
    of what is held), interrupted_unknown, or a failure.

    The boundary is the last success known at the cutoff, or a later revalidation; failures at or after it
    make it stale. Attempts without an end by the cutoff are unknown.
    """
    known = F.coalesce(F.col("finished_at") <= cutoff, F.lit(False))
    good, again = known & (F.col("state") == "success"), known & (F.col("state") == "not_modified")
    ends = attempts.groupBy(*by).agg(F.max(F.when(good, F.col("finished_at"))).alias("newest"), F.max(F.when(again, F.col("finished_at"))).alias("validated"), F.bool_or(~known | (F.col("state") == "interrupted_unknown")).alias("unknown"))
    ends = ends.withColumn("boundary", F.when(F.col("newest").isNotNull(), F.greatest("newest", "validated")))
    failures = attempts.filter(known & ~F.col("state").isin("success", "not_modified", "interrupted_unknown")).select(*by, "finished_at")
    late = ends.select(*by, "boundary").join(failures, by).filter(F.col("boundary").isNull() | (F.col("finished_at") >= F.col("boundary"))).groupBy(*by).agg(F.count("*").alias("failures"))
    joined = ends.join(late, by, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    codes = flags.reasons(capture_unavailable=F.col("newest").isNull(), source_attempt_outcome_unknown=F.col("unknown"), newer_capture_failed=(F.col("failures") > 0) & F.col("newest").isNotNull(), capture_failed=(F.col("failures") > 0) & F.col("newest").isNull())
    return joined.select(*by, "boundary", "failures", codes.alias("flags"))


def eligible_batches(inputs: DataFrame, by: list[str], cutoff: Column) -> DataFrame:
    """Batches whose inputs (by, response, role, ended_at) all ended by the cutoff, with the time and the
    ids of their responses; metadata inputs decide eligibility and never the rank."""
    answer = F.col("role").isin("observations", "fetch_outcome")
    found = inputs.groupBy(*by).agg(F.max(F.when(answer, F.col("ended_at"))).alias("response_at"), F.max("ended_at").alias("known_at"), F.bool_and(F.coalesce(F.col("ended_at") <= cutoff, F.lit(False))).alias("eligible"), F.array_sort(F.collect_list(F.when(answer, F.col("response")))).alias("responses"))
    return found.withColumn("eligible", F.col("eligible") & F.col("response_at").isNotNull())


def eligible_coverage(rows: DataFrame, allow_reviewed: bool, audited: bool, filed_cutoff: Column) -> DataFrame:
    """Coverage of an allowed authority class (reviewed equivalents if asked for), audited if asked for,
    filed by the cutoff, that day included."""
    allowed = ["periodic_complete", *(["reviewed_equivalent"] if allow_reviewed else [])]
    kept = F.col("authority").isin(*allowed) & (F.col("filed") <= filed_cutoff)
    return rows.filter(kept & (F.col("assurance") == "audited") if audited else kept)


def statement_coherence(statements: DataFrame, by: list[str]) -> DataFrame:
    """Flags of the statements of a period (by, basis, family, edition, scope, currency): bases may never
    differ; editions, scopes and currencies may not where there are several families. A column has several
    values if its least and greatest differ, so a row is not copied for each column."""
    many = {c: F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in ("basis", "family", "edition", "scope", "currency")}
    found = statements.groupBy(*by).agg(*[v.alias(k) for k, v in many.items()])
    codes = {"incompatible_reporting_basis": F.col("basis")} | {name: F.col("family") & F.col(c) for name, c in (("mixed_statement_editions", "edition"), ("incompatible_semantic_scopes", "scope"), ("incompatible_statement_currencies", "currency"))}
    return found.select(*by, flags.reasons(**codes).alias("flags"))


def coherent(rows: DataFrame, by: list[str], reasons: dict[str, str]) -> DataFrame:
    """For each group, the reasons whose column has more than one value in it; a null is a value."""
    many = [F.count_distinct(F.struct(c)).alias(code) for code, c in reasons.items()]
    found = rows.groupBy(*by).agg(*many)
    return found.select(*by, flags.reasons(**{code: F.col(code) > 1 for code in reasons}).alias("reasons"))


def with_definition(observations: DataFrame, definitions: DataFrame, by: list[str]) -> DataFrame:
    """Observations (by, reference_date) with the newest definition (by, known_on, definition) of their
    series by that date; one that came later only is from the future, never used."""
    times = definitions.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("known_on", "definition"))).alias("_all"))
    joined = observations.join(times, by, "left")
    known = F.filter("_all", lambda d: d["known_on"] <= F.col("reference_date"))
    reason = F.when(F.col("_all").isNull(), "definition_missing").when(F.size(known) == 0, "definition_from_future")
    return joined.withColumns({"definition": F.when(reason.isNull(), F.element_at(known, -1)["definition"]), "reason": reason}).drop("_all")


def rule_states(requests: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """How many mapping rules each request meets: none is unsupported, several conflict."""
    counted = rules.groupBy(*by).agg(F.count("*").alias("rules"))
    joined = requests.join(counted, by, "left")
    return joined.withColumn("state", F.when(F.col("rules").isNull(), "unsupported_scope").when(F.col("rules") > 1, "rule_conflict").otherwise("mapped"))


def sessions_in_binding(sessions: DataFrame, bindings: DataFrame, by: list[str]) -> DataFrame:
    """Sessions (by, session) that lie in a binding [valid_from, valid_to) of their key; an end that is
    null or later than the closure's gives way to it."""
    to = F.coalesce(F.least("valid_to", "closed_on"), F.lit("9999-12-31").cast("date"))
    inside = bindings.select(*by, F.col("valid_from").alias("_from"), to.alias("_to"))
    return sessions.join(inside, by).filter((F.col("session") >= F.col("_from")) & (F.col("session") < F.col("_to"))).drop("_from", "_to")


def forward_only(published: DataFrame, offered: DataFrame, by: list[str]) -> DataFrame:
    """The latest pointer of each scope after an offer: (by, sequence, snapshot) of the higher sequence; an
    offer that is not higher does not move it."""
    both = published.select(*by, "sequence", "snapshot", F.lit(0).alias("new")).unionByName(offered.select(*by, "sequence", "snapshot", F.lit(1).alias("new")))
    top = both.groupBy(*by).agg(F.max(F.struct("sequence", (-F.col("new")).alias("held"), "snapshot")).alias("x"), F.max("new").alias("asked"))
    return top.select(*by, "x.sequence", "x.snapshot", F.when(F.col("asked") == 0, "unchanged").when(F.col("x.held") == 0, "kept").otherwise("moved").alias("action"))


def outside(rows: DataFrame, manifest: DataFrame, on: list[str], reason: str) -> DataFrame:
    """Keys of ``rows`` that the manifest lacks, with a reason; there should be none."""
    return rows.select(*on).distinct().join(manifest.select(*on), on, "left_anti").withColumn("reason", F.lit(reason))


def without_duplicates(rows: DataFrame, key: list[str], content: list[str]) -> DataFrame:
    """One row for each key whose rows all agree in ``content``; keys with different contents are rejected
    and have a reason instead."""
    found = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct(*content)).alias("low"), F.max(F.struct(*content)).alias("high"))
    same = F.col("low").eqNullSafe(F.col("high"))
    return found.select(*key, "copies", *[F.when(same, F.col(f"low.{c}")).alias(c) for c in content], F.when(~same, "conflicting_duplicates").alias("reason"))


def conflicts(rows: DataFrame, by: list[str], signature: list[Column]) -> DataFrame:
    """Groups with more than one distinct signature; a null is a signature of its own."""
    return rows.groupBy(*by).agg(F.count_distinct(F.struct(*signature)).alias("signatures")).withColumn("conflict", F.col("signatures") > 1)


def successful(rows: DataFrame, cutoff: Column) -> DataFrame:
    """Captures that ended well by the cutoff and have a body."""
    return rows.filter(F.col("http_status").between(200, 299) & (F.col("fetched_at") <= cutoff) & F.col("body_hash").isNotNull())


def failures_since_success(attempts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """How many attempts of each key failed after its last success, and whether there was one."""
    newest_first = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    marked = attempts.withColumn("good_after", F.max(F.col("ok").cast("int")).over(newest_first.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by).agg(F.count_if(F.coalesce(F.col("good_after"), F.lit(0)) == 0).alias("failures"), F.max("ok").alias("ever_good"))


def validity_overlaps(intervals: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """Intervals whose key's next one begins before they end; there should be none."""
    following = F.lead("valid_from").over(Window.partitionBy(*by).orderBy("valid_from", "valid_to", *tie))
    return intervals.withColumn("next_from", following).filter(F.col("next_from") < F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))


def acyclic_levels(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """The depth of every node that roots lead to; a node as deep as ``most`` shows a cycle.

    One join for each level from the nodes reached last; each level is stored, and a node is in it once
    however many paths lead there."""
    spark = edges.sparkSession
    level = roots.select("node").distinct().withColumn("depth", F.lit(0))
    stored = []
    for depth in range(most + 1):
        path = work_dir(spark, f"level-{depth}")
        level.write.parquet(path)
        level = spark.read.schema(level.schema).parquet(path)
        if level.isEmpty():
            break
        stored.append(path)
        level = level.join(edges, F.col("parent") == F.col("node")).select(F.col("child").alias("node")).distinct().withColumn("depth", F.lit(depth + 1))
    every = spark.read.schema(level.schema).parquet(*stored) if stored else level
    return every.groupBy("node").agg(F.max("depth").alias("depth"))

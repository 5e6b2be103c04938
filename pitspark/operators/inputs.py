"""Inputs and operands of metrics: what a request asked for against what was selected, and operands against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags

BASES = ("us_gaap", "ifrs")
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"


def _no(condition: Column) -> Column:
    """Whether a condition fails; an unknown one fails too."""
    return ~F.coalesce(condition, F.lit(False))


def unit_fits(unit: Column) -> Column:
    """Whether a unit's measures (key, numerators, denominators) are those that its key stands for."""
    currency = F.concat(F.lit("iso4217:"), F.substring(unit["key"], 1, 3))
    none = F.array().cast("array<string>")
    numerators = F.when(unit["key"] == "shares", F.array(F.lit("xbrli:shares"))).when(unit["key"].rlike("^[A-Z]{3}(/shares)?$"), F.array(currency))
    denominators = F.when(unit["key"].endswith("/shares"), F.array(F.lit("xbrli:shares"))).otherwise(none)
    return (unit["numerators"] == numerators) & (F.coalesce(unit["denominators"], none) == denominators)


def scope_fits(scope: Column) -> Column:
    """Whether a scope's descriptor is the one that was hashed and says what the scope says."""
    told = F.from_json(scope["descriptor"], "consolidation string, instrument string, scope_evidence string")
    return (
        (F.sha2(scope["descriptor"], 256) == scope["sha256"]) & (told["consolidation"] == scope["kind"]) & scope["descriptor"].contains('"instrument"')
        & told["instrument"].eqNullSafe(scope["instrument"]) & (F.trim(told["scope_evidence"]) != "")
    )


def provenance_fits(fact: Column, asked: Column) -> Column:
    """Whether a fact names one source of the request's captures, filed by both cutoffs, at a plain address."""
    return (
        F.array_contains(asked["captures"], fact["capture"]) & fact["accession"].rlike(ACCESSION) & (fact["filed"] <= F.to_date(asked["captured_before"]))
        & (asked["filed_cutoff"].isNull() | (fact["filed"] <= asked["filed_cutoff"])) & fact["source_url"].rlike(r"^https?://[^/@?#]+([/?#].*)?$") & (F.trim(fact["locator"]) != "")
        & fact["source_sha256"].rlike("^[0-9a-f]{64}$") & (F.trim(fact["tag"]) != "") & (F.trim(fact["text"]) != "")
    )


def input_issues(asked: Column, period: Column, unit: Column, scope: Column, fact: Column) -> Column:
    """Why a selected fact does not answer its request: identity of concept, period, unit, currency and
    scope; a valid period, unit and scope; a value that was observed, with its provenance."""
    currency = F.coalesce(asked["currency"], asked["unit"])
    whole = unit["key"].rlike("^[A-Z]{3}$")
    kind = ((period["kind"] == "instant") & period["start"].isNull()) | ((period["kind"] == "duration") & (period["start"] <= period["end"]))
    return flags.reasons(
        input_concept_mismatch=_no(F.array_contains(asked["concepts"], fact["concept"])), input_period_mismatch=_no(period["id"] == asked["period"]), input_unit_mismatch=_no(unit["key"] == asked["unit"]),
        input_reporting_currency_mismatch=whole & (currency != unit["key"]), input_scope_mismatch=_no((scope["id"] == asked["scope"]) & (scope["issuer"] == asked["issuer"])),
        input_period_invalid=_no(kind & period["end"].isNotNull()), input_scope_invalid=_no(scope_fits(scope)), input_unit_invalid=_no(unit_fits(unit)),
        input_provenance_invalid=_no(provenance_fits(fact, asked)), input_value_invalid=fact["value"].isNull(), input_fact_not_observed=_no(fact["status"] == "observed"),
    )


#: Concepts of the vocabulary that belong to the cash flow statement (fixed values).
CASH_CONCEPTS = ("cash_from_operating_activities", "capital_expenditures_ppe")


def operand_issues(operands: Column, expected: list[str], balance_sheet: bool = False, same_period: bool = True) -> Column:
    """Why operands cannot go into one formula. ``operands`` is an array of structs (concept, value, issues,
    history_key, basis, unit, kind, start, end, edition, family, scope) in the order of the formula."""

    def several(of) -> Column:
        return F.size(F.array_distinct(F.transform(operands, of))) > 1

    def some(of) -> Column:
        return F.exists(operands, lambda o: F.coalesce(of(o), F.lit(True)))

    def family(o: Column) -> Column:
        return F.lit("balance_sheet") if balance_sheet else F.when(o["concept"].isin(*CASH_CONCEPTS), "cash_flow").otherwise("income")

    kind = "instant" if balance_sheet else "duration"
    found = {
        "source_input_unavailable": F.exists(operands, lambda o: o["value"].isNull()),
        "unexpected_concept": _no(F.transform(operands, lambda o: o["concept"]) == F.array(*[F.lit(c) for c in expected])),
        "incompatible_history_policy": several(lambda o: o["history_key"]), "incompatible_reporting_basis": several(lambda o: o["basis"]),
        "unsupported_reporting_basis": some(lambda o: ~o["basis"].isin(*BASES)), "incompatible_units": several(lambda o: o["unit"]) | some(lambda o: ~o["unit"].rlike("^[A-Z]{3}$")),
        "instant_period_required" if balance_sheet else "flow_period_required": some(lambda o: (o["kind"] != kind) | (o["start"].isNotNull() if balance_sheet else o["start"].isNull())),
        "incompatible_statement_family": some(lambda o: o["family"] != family(o)), "unsupported_semantic_scope": some(lambda o: o["scope"] != "consolidated"),
    }
    if same_period:
        found |= {"incompatible_periods": several(lambda o: F.struct(o["start"], o["end"])), "incompatible_filing_editions": several(lambda o: o["edition"])}
    carried = F.flatten(F.transform(operands, lambda o: flags.blocking(F.coalesce(o["issues"], F.array().cast("array<string>")))))
    return flags.union(carried, flags.reasons(**found))


def within_limits(text: Column, digits: int = 1000, exponent: int = 1000) -> Column:
    """Whether a number as written has at most so many digits, and its last and first digit stand within
    ten to the plus or minus ``exponent``; text that is no number has no limits to be within."""
    shape = r"^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$"
    whole, part, power = (F.regexp_extract(text, shape, k) for k in (1, 2, 3))
    figures = F.greatest(F.length(F.ltrim(F.concat(whole, part), F.lit("0"))), F.lit(1))
    last = F.coalesce(power.try_cast("long"), F.when(power == "", 0).otherwise(exponent * 10)) - F.length(part)
    there = F.length(F.concat(whole, part)) > 0
    return there & (figures <= digits) & (F.abs(last) <= exponent) & (F.abs(last + figures - 1) <= exponent)


def evidence(value: Column, error: Column, hashes: list[Column], end: Column, months: int, codes: Column, basis: str) -> Column:
    """A period amount as an evidence value: its hash is that of its operands' hashes in order."""
    return F.struct(
        value.cast("decimal(38,4)").alias("value"), error.cast("decimal(38,4)").alias("absolute_error"), F.lit("USD").alias("currency"), F.lit(basis).alias("basis"), F.sha2(F.concat_ws("|", *hashes), 256).alias("input_hash"),
        (value.isNotNull() & (F.size(flags.blocking(codes)) == 0)).alias("usable"), F.add_months(F.date_add(end, 1), -months).alias("period_start"), end.alias("period_end"), codes.alias("flags"),
    )


def accepted_metrics(metrics: DataFrame, evidence_rows: DataFrame, by: list[str]) -> DataFrame:
    """Metrics (by, metric, fields, operand_hashes) with the reasons that keep them out: an operand without
    evidence, or hashes that are not those of the evidence (by, field, input_hash) in the metric's order."""
    asked = metrics.select(*by, "metric", F.posexplode("fields").alias("place", "field"))
    met = asked.join(evidence_rows.select(*by, "field", "input_hash"), [*by, "field"], "left")
    held = met.groupBy(*by, "metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "input_hash"))), lambda x: x["input_hash"]).alias("held"))
    joined = metrics.join(held, [*by, "metric"], "left")
    codes = flags.reasons(company_metric_input_missing=F.exists("held", lambda h: h.isNull()), company_metric_input_mismatch=_no(F.col("operand_hashes") == F.col("held")))
    return joined.withColumn("reasons", codes).drop("held")


def history_points(current: DataFrame, snapshots: DataFrame, by: list[str], back: int) -> DataFrame:
    """Every earlier published point of a metric (by, qidx, context, evaluated, period_end, value) up to
    ``back`` quarters before each current row, with its reasons: another context, an evaluation at another
    date than its period's end, or no value."""
    now = current.select(*by, "qidx", F.col("context").alias("_context"))
    then = snapshots.select(*by, F.col("qidx").alias("then"), "context", "evaluated", "period_end", "value").withColumn("qidx", F.explode(F.sequence(F.col("then") + 1, F.col("then") + back)))
    met = now.join(then, [*by, "qidx"])
    codes = flags.reasons(incompatible_series=~F.col("context").eqNullSafe(F.col("_context")), historical_evaluation_date_mismatch=~F.col("evaluated").eqNullSafe(F.col("period_end")), historical_metric_unavailable=F.col("value").isNull())
    return met.select(*by, "qidx", "then", "value", codes.alias("reasons"))


STATUSES = ("valid", "not_meaningful", "missing", "invalid", "stale", "unsupported", "inapplicable")


def status_counts(assessed: DataFrame, roster: DataFrame, by: list[str], member: list[str]) -> DataFrame:
    """Counts of every status over a whole roster (by, member, applicable).

    A member that does not apply is inapplicable and one not reviewed (null) unsupported, whatever was
    computed; an applicable one without a row is missing. ``covered`` is the share of applicable members that
    are valid or not meaningful, null if none applies or one is not reviewed.
    """
    joined = roster.join(assessed, [*by, *member], "left")
    status = F.when(F.col("applicable").isNull(), "unsupported").when(~F.col("applicable"), "inapplicable").otherwise(F.coalesce("status", F.lit("missing")))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    found = joined.withColumn("status", status).groupBy(*by).agg(F.count("*").alias("members"), *counts, F.count_if("applicable").alias("applicable"), F.count_if(F.col("applicable").isNull()).alias("unreviewed"), F.count_if(F.col("applicable") & F.col("status").isin("valid", "not_meaningful")).alias("_done"))
    return found.withColumn("covered", F.when((F.col("unreviewed") == 0) & (F.col("applicable") > 0), F.col("_done") / F.col("applicable"))).drop("_done")

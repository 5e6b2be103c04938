"""Scalar rules on columns: ratios, denominators, dates, numbers and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient in double; null where the denominator is null or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def denominator_reasons(value: Column, error: Column | None = None) -> Column:
    """Why a denominator cannot be used: missing, not positive, or within its absolute error."""
    found = {"denominator_missing": value.isNull(), "denominator_nonpositive": value <= 0}
    if error is not None:
        found |= {"denominator_precision_unknown": value.isNotNull() & error.isNull(), "denominator_within_error": (value > 0) & (value <= error)}
    return flags.reasons(**found)


def guarded(value: Column, codes: Column) -> Column:
    """``value`` where no code blocks, else null."""
    return F.when(F.size(flags.blocking(codes, flags.METRIC_INFORMATIONAL)) == 0, value)


def month_span(start: Column, end: Column) -> Column:
    """Whole months from a month's first day to a month's last; null for other periods."""
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(end))
    return F.when(whole, F.months_between(F.date_add(end, 1), start).cast("int"))


def window_start(as_of: Column, years: int) -> Column:
    """The same day some calendar years before; 29 February becomes the 28th."""
    return F.add_months(as_of, -12 * years)


def tri_state(text: Column, present: Column, missing: str = "missing", null: str = "source_null") -> Column:
    """State of a number as it was written: absent, null, not a number or negative, or observed."""
    number = F.expr("try_cast(NULL as decimal(38,10))") if text is None else F.when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text).try_cast("decimal(38,10)")
    return F.when(~present, missing).when(text.isNull(), null).when(number.isNull() | (number < 0), "unparseable").otherwise("observed")


def content_id(*columns: Column) -> Column:
    """A hash of the columns as JSON, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def scaled_text(lexical: Column, scale: Column, sign: Column, form: Column) -> Column:
    """A displayed number with its transform, power of ten and sign, as text that is exact; null if invalid.

    ``form`` is the transform's local name: null (the number as written), ``num-dot-decimal`` (commas and
    spaces between digits go) or ``fixed-zero`` (zero, whatever is displayed); others are not supported.
    Digits are moved, not multiplied: nothing is rounded.
    """
    text = F.trim(F.regexp_replace(lexical, r"[\t\r\n]", " "))
    spaced = F.when(text.rlike("^[, \u00a00-9]*(\\.[ \u00a00-9]+)?$"), F.regexp_replace(text, "[, \u00a0]", ""))
    plain = F.when(form.isNull(), text).when(form == "fixed-zero", "0").when(form == "num-dot-decimal", spaced)
    number = F.when(plain.rlike(r"^\+?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.ltrim(plain, F.lit("+")))
    return F.concat(F.when(sign == "-", "-").otherwise(""), number, F.lit("E"), scale.cast("string"))


def scaled_number(lexical: Column, scale: Column, sign: Column, form: Column) -> Column:
    """:func:`scaled_text` as a decimal; powers beyond 24 places do not fit and give null. Longer amounts stay
    text and are summed by :mod:`pitspark.functions.wide`."""
    return scaled_text(lexical, scale, sign, form).try_cast("decimal(38,10)")


def issuer_id(text: Column) -> Column:
    """Ten digits with leading zeros; null for anything else."""
    return F.when(text.rlike(r"^\d{1,10}$"), F.lpad(text, 10, "0"))


def unit_measures(key: Column) -> Column:
    """Numerators and denominators of a unit: shares, a currency, or a currency for each share."""
    currency = F.regexp_extract(key, r"^([A-Z]{3})", 1)
    return (
        F.when(key == "shares", F.lit("shares|"))
        .when(key.rlike(r"^[A-Z]{3}$"), F.concat(currency, F.lit("|")))
        .when(key.rlike(r"^[A-Z]{3}/shares$"), F.concat(currency, F.lit("|shares")))
        .otherwise(F.lit("unsupported"))
    )


def slot_due(anchor: Column, slot: Column, cadence_seconds: int, jitter_seconds: int, seed: Column) -> Column:
    """anchor + slot * cadence + a jitter from 0 to ``jitter_seconds`` that a hash of the seed and slot fixes."""
    digits = F.substring(F.sha2(F.concat_ws("\n", seed, slot), 256), 1, 16)
    jitter = F.conv(digits, 16, 10).cast("decimal(20,0)") % F.lit(jitter_seconds + 1)
    return F.timestamp_seconds(F.unix_timestamp(anchor) + slot * cadence_seconds + jitter.cast("long"))


#: Dates or cutoffs of one request; they go to every task.
MOST_ASKED = 100_000


def asked_for(values: DataFrame, column: str, name: str) -> DataFrame:
    """One row that holds the distinct values of a request's column as a sorted array; more than
    :data:`MOST_ASKED` are an error, as the row is broadcast."""
    every = values.agg(F.sort_array(F.collect_set(column)).alias("v"))
    checked = F.when(F.size("v") <= MOST_ASKED, F.col("v")).otherwise(F.raise_error(F.lit(f"a request may ask for {MOST_ASKED} values of {column}")))
    return F.broadcast(every.select(checked.alias(name)))

"""Reason codes: sorted sets of strings beside every value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes that inform and do not block, for facts and for metrics (fixed values).
INFORMATIONAL = ("revised_view", "earliest_available")
METRIC_INFORMATIONAL = (*INFORMATIONAL, "extreme_margin", "gross_profit_derived")


def reasons(**when: Column) -> Column:
    """The codes whose conditions hold, sorted; a condition that is null does not hold."""
    return normal(F.array(*[F.when(condition, F.lit(code)) for code, condition in when.items()]))


def normal(codes: Column) -> Column:
    """Sorted, without nulls and repeats."""
    return F.array_sort(F.array_distinct(F.array_compact(codes)))


def union(*sets: Column) -> Column:
    return normal(F.concat(*sets))


def blocking(codes: Column, informational: tuple[str, ...] = INFORMATIONAL) -> Column:
    return F.array_except(codes, F.array(*[F.lit(c) for c in informational]))


def is_subset(codes: Column, of: Column) -> Column:
    return F.size(F.array_except(codes, of)) == 0


def text(codes: Column) -> Column:
    return F.array_join(codes, "|")


def usable(value: Column, codes: Column) -> Column:
    """A value with no blocking code."""
    return value.isNotNull() & (F.size(blocking(codes)) == 0)

"""Filing inventories: what is new, gone or changed between two, and whether the answer is complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions import flags


def compare(baseline: DataFrame, current: DataFrame, key: list[str], content: str) -> DataFrame:
    """state of every key: new, removed, changed or same."""
    left = baseline.select(*key, F.col(content).alias("was"), F.lit(True).alias("before"))
    right = current.select(*key, F.col(content).alias("now"), F.lit(True).alias("after"))
    joined = left.join(right, key, "full_outer")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed").otherwise("same")
    return joined.select(*key, state.alias("state"))


#: Flags that either side of a comparison can have.
SIDE_FLAGS = ("acceptance_unverified", "duplicate_accession", "inventory_incomplete", "filing_metadata_incomplete")


def at_cutoff(filings: DataFrame, forms: list[str], cutoff: Column) -> DataFrame:
    """Filings (form, acceptance_at, and acceptance_time_basis where there is such) of the forms asked for, with
    ``state``: acceptance_unverified without a time or with a basis other than ``verified_timezone``,
    excluded_after_cutoff, else selected. Other forms are left out."""
    basis = F.col("acceptance_time_basis").eqNullSafe("verified_timezone") if "acceptance_time_basis" in filings.columns else F.lit(True)
    unverified = F.col("acceptance_at").isNull() | ~basis
    return filings.filter(F.col("form").isin(forms)).withColumn("state", F.when(unverified, "acceptance_unverified").when(F.col("acceptance_at") > cutoff, "excluded_after_cutoff").otherwise("selected"))


def compared_filings(baseline: DataFrame, current: DataFrame, by: list[str], forms: list[str], tasks: int | None = None) -> DataFrame:
    """One row for each accession of two inventories: whether it ``was`` and ``is`` held, whether the baseline has
    it at all (``there``), whether its content ``changed``, its form, and the flags of both sides.

    Rows are dealt to ``tasks`` before anything is gathered: an accession comes about once, so a task that
    combined what it had scanned would hold all of it. Strings make this a sort, of a task's share alone.
    """
    told = lambda rows, c: ~F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    mine = F.coalesce(F.col("form").isin(forms), F.lit(False))
    counts = mine & F.coalesce(F.col("acceptance_at") <= F.col("cutoff"), F.lit(False))

    def side(rows: DataFrame, new: bool) -> DataFrame:
        return rows.select(
            *by, "accession", F.lit(new).alias("new"), counts.alias("held"), F.when(mine, F.col("form")).alias("form"), F.when(mine, F.col("content")).alias("content"),
            (mine & F.col("acceptance_at").isNull()).alias("unverified"), told(rows, "complete").alias("partial"), (counts & told(rows, "described")).alias("bare"),
        )

    both = side(baseline, False).unionByName(side(current, True))
    dealt = both.repartition(tasks or int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "accession")
    old, new = ~F.col("new"), F.col("new")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    least = lambda s, c: F.min(F.when(s, F.col(c)))
    flagged = {f"{label}_{n}": any_of(s & F.col(c)) for label, s in (("baseline", old), ("current", new)) for n, c in (("acceptance_unverified", "unverified"), ("inventory_incomplete", "partial"), ("filing_metadata_incomplete", "bare"))}
    twice = {f"{label}_duplicate_accession": F.count(F.when(s, F.col("accession"))) > 1 for label, s in (("baseline", old), ("current", new))}
    each = dealt.groupBy(*by, "accession").agg(
        any_of(old & F.col("held")).alias("was"), any_of(new & F.col("held")).alias("is"), any_of(old).alias("there"), least(old, "content").alias("before"), least(new, "content").alias("after"), least(new, "form").alias("form"),
        *[c.alias(k) for k, c in (flagged | twice).items()],
    )
    changed = F.col("was") & F.col("is") & ~F.col("before").eqNullSafe(F.col("after"))
    return each.withColumn("changed", changed).drop("before", "after")


def compared_inventories(baseline: DataFrame, current: DataFrame, by: list[str], forms: list[str]) -> DataFrame:
    """One row for each inventory pair: flags, numbers of new originals and amendments, and the outcome.

    Rows (by, accession, form, acceptance_at, cutoff, content): other forms are not compared; an acceptance
    time that is null is unverified, a flag; a later one than the cutoff is left out. An accession that comes
    twice, in whatever form, one that is gone and one whose content differs are flags; so are, where rows have
    them, ``complete`` that is false (also on a row without accession, for an answer without filings) and
    ``described`` that is false for a filing that counts (no period end or no document). Any flag makes the
    outcome incomplete, and the baseline does not advance. Forms that end in /A are amendments.
    """
    return outcomes(compared_filings(baseline, current, by, forms), by)


def outcomes(each: DataFrame, by: list[str]) -> DataFrame:
    """One row for each inventory pair of what :func:`compared_filings` tells."""
    added, amendment = F.col("is") & ~F.col("was"), F.coalesce(F.col("form").endswith("/A"), F.lit(False))
    codes = {"baseline_accession_missing": F.col("was") & ~F.col("is"), "existing_accession_metadata_changed": F.col("changed")} | {f"{label}_{what}": F.col(f"{label}_{what}") for label in ("baseline", "current") for what in SIDE_FLAGS}
    out = each.groupBy(*by).agg(F.count_if(added & ~amendment).alias("originals"), F.count_if(added & amendment).alias("amendments"), *[F.bool_or(c).alias(k) for k, c in codes.items()])
    why = flags.reasons(**{k: F.col(k) for k in codes})
    return out.select(*by, "originals", "amendments", why.alias("flags"), outcome(why, F.col("originals"), F.col("amendments")).alias("outcome"))


def outcome(codes: Column, originals: Column, amendments: Column) -> Column:
    """The outcome of a comparison; any flag makes it incomplete and keeps the baseline."""
    return F.when(F.size(codes) > 0, "incomplete").when((originals > 0) & (amendments > 0), "mixed_changes").when(originals > 0, "new_filing").when(amendments > 0, "amendment").otherwise("no_change")


def overlapping(documents: DataFrame, low: Column, high: Column) -> DataFrame:
    return documents.filter((F.col("date_from") <= high) & (F.col("date_to") >= low))


def required_documents(references: DataFrame, fetched: DataFrame, key: list[str], low: Column, high: Column) -> DataFrame:
    """References whose dates meet the window, with state held or missing: whether the document was fetched."""
    there = fetched.select(*key, F.lit(True).alias("_there")).distinct()
    return overlapping(references, low, high).join(there, key, "left").withColumn("state", F.when(F.col("_there"), "held").otherwise("missing")).drop("_there")


def inventory_problems(documents: DataFrame, by: list[str], advertised: DataFrame) -> DataFrame:
    """Reasons against each document (advertised: by, advertised, date_from, date_to): another number of rows
    than it says, a row outside its dates, an accession twice, or one with different content (also elsewhere)."""
    of = documents.groupBy("accession").agg(F.count_distinct("content") > 1).toDF("accession", "differs")
    held = documents.join(of, "accession").join(advertised.select(*by, "date_from", "date_to"), by)
    out = held.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("accession").alias("accessions"), F.bool_or("differs").alias("differs"), F.bool_or(~F.coalesce(F.col("filed").between(F.col("date_from"), F.col("date_to")), F.lit(False))).alias("outside"))
    joined = advertised.select(*by, "advertised").join(out, by, "left")
    n = F.coalesce("n", F.lit(0))
    codes = flags.reasons(inventory_count_mismatch=n != F.col("advertised"), filing_outside_bounds=F.col("outside"), duplicate_accession=n != F.coalesce("accessions", F.lit(0)), conflicting_filing_metadata=F.col("differs"))
    return joined.select(*by, codes.alias("reasons"))


def manifest_hash(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """A hash of each group's rows that their order does not change: of how many there are, and of four sums
    of 60-bit words of their hashes. Sums meet before the shuffle, so a hot group costs a row for each task."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return rows.select(*by, h.alias("h")).groupBy(*by).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *words), 256).alias("manifest"))

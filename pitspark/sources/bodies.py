"""Scans of archived bodies: JSON and XML texts to rows, with states and problems instead of errors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags

FILINGS = "struct<filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>>,files:array<struct<name:string,filingCount:long,filingFrom:string,filingTo:string>>>>"
#: Fields of a session, raw and adjusted, as the source names them (fixed values).
PRICE_FIELDS = ("open", "high", "low", "close", "volume", "adjOpen", "adjHigh", "adjLow", "adjClose", "adjVolume", "divCash", "splitFactor")
MOST_BYTES = 64 << 20


def company_facts(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """One observation for each element of facts.{taxonomy}.{tag}.units.{unit}, with its JSON pointer, the
    number as it was written, its exact value where one fits, and its state. A body that is no JSON object
    with facts, or repeats a key, gives one row with a problem."""
    units = "map<string,map<string,struct<units:map<string,array<variant>>>>>"
    parsed = bodies.select(*keys, F.try_variant_get(F.try_parse_json(with_written_numbers(F.col("body"), "val")), "$.facts", units).alias("f"))
    facts = parsed.select(*keys, F.col("f").isNull().alias("bad"), F.explode_outer("f").alias("taxonomy", "tags")).filter("bad or tags is not null")
    tags = facts.select(*keys, "bad", "taxonomy", F.explode_outer("tags").alias("tag", "x")).select(*keys, "bad", "taxonomy", "tag", F.explode_outer("x.units").alias("unit", "rows"))
    rows = tags.select(*keys, "bad", "taxonomy", "tag", "unit", F.posexplode_outer("rows").alias("i", "r")).filter("bad or r is not null")
    escaped = [F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")) for c in ("taxonomy", "tag", "unit")]
    locator = F.concat_ws("/", F.lit("/facts"), escaped[0], escaped[1], F.lit("units"), escaped[2], "i")
    state, value, text = fact_number(F.col("r"), "val")
    fields = [F.try_variant_get("r", f"$.{c}", "string").alias(c) for c in ("start", "end", "accn", "form", "filed")]
    bad = F.col("bad")
    return rows.select(*keys, "taxonomy", "tag", "unit", F.when(~bad, locator).alias("locator"), *fields, value.alias("val"), text.alias("text"), F.when(~bad, state).alias("state"), F.when(bad, "body_malformed").alias("problem"))


def filing_index(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel arrays to filing rows; arrays of different lengths give one row with a problem."""
    recent = bodies.select(*keys, F.from_json("body", FILINGS).getField("filings").getField("recent").alias("r"))
    a, b, c = (F.col(f"r.{x}") for x in ("accessionNumber", "form", "filingDate"))
    fits = (F.size(a) == F.size(b)) & (F.size(a) == F.size(c))
    rows = F.when(fits, F.arrays_zip(a.alias("accession"), b.alias("form"), c.alias("filed")))
    found = recent.select(*keys, fits.alias("fits"), F.posexplode_outer(rows).alias("i", "x"))
    return found.select(*keys, "i", "x.accession", "x.form", F.to_date("x.filed").alias("filed"), F.when(~F.coalesce("fits", F.lit(False)), "array_length_mismatch").alias("problem"))


def older_documents(bodies: DataFrame, keys: list[str]) -> DataFrame:
    """References to documents with older filings, with their bounds; one without a name or with bounds
    that are missing or crossed has a problem."""
    files = bodies.select(*keys, F.explode(F.from_json("body", FILINGS).getField("filings").getField("files")).alias("f"))
    low, high = (F.col(f"f.{c}").try_cast("date") for c in ("filingFrom", "filingTo"))
    problem = F.when(F.coalesce(F.col("f.name"), F.lit("")) == "", "name_missing").when(low.isNull() | high.isNull(), "bounds_missing").when(low > high, "bounds_crossed")
    return files.select(*keys, F.col("f.name").alias("name"), F.col("f.filingCount").alias("advertised"), low.alias("date_from"), high.alias("date_to"), problem.alias("problem"))


def tri_state(value: Column, present: Column) -> tuple[Column, Column]:
    """(state, number) of a JSON value kept as a variant, so that a number in quotes or a boolean is not a
    number: absent is missing, null is source_null, other types and negative numbers are unparseable."""
    kind = F.schema_of_variant(value)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "decimal(28,6)"))
    state = F.when(~present, "missing").when(F.is_variant_null(value), "source_null").when(number.isNull() | (number < 0), "unparseable").otherwise("observed")
    return state, F.when(state == "observed", number)


#: Put before a number that is kept as it was written; a JSON string holds it only in escaped form.
MARK = "\u0001"


def with_written_numbers(body: Column, field: str) -> Column:
    """A JSON text in which the field's numbers are strings of their own text, after :data:`MARK`, since every
    reader of numbers would round or rewrite some. An escaped quote keeps text within strings from matching."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?=\s*[,}])"
    return F.regexp_replace(body, rf'(?<!\\)"{field}"\s*:\s*{number}', f'"{field}":"\\\\u0001$1"')


def fits_exactly(text: Column, whole: int = 28, places: int = 10) -> Column:
    """Whether a written number has at most so many digits before and behind the point, its exponent counted."""
    digits = F.length(F.regexp_extract(text, "^-?0*([0-9]*)", 1))
    fraction = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*([eE].*)?$", 1))
    power = F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.when(text.rlike("[eE]"), F.lit(1 << 20)).otherwise(0))
    return (digits + power <= whole) & (fraction - power <= places)


def fact_number(row: Column, field: str) -> tuple[Column, Column, Column]:
    """(state, number, text) of a fact's field in the variant of a body :func:`with_written_numbers`.

    Absent, null, not finite or of another type; a number that an exact decimal(38,10) cannot hold is
    ``numeric_range_exceeded`` and has its text alone, else it is observed.
    """
    value = F.try_variant_get(row, f"$.{field}", "variant")
    text = F.try_variant_get(row, f"$.{field}", "string")
    written = F.when(text.startswith(MARK), F.substring(text, 2, 1 << 30))
    fits = fits_exactly(written)
    state = F.when(value.isNull(), "missing_field").when(F.is_variant_null(value), "null_value").when(text.isin("NaN", "Infinity", "-Infinity"), "nonfinite").when(written.isNull(), "not_numeric").when(~fits, "numeric_range_exceeded").otherwise("observed")
    return state, F.when(state == "observed", written.try_cast("decimal(38,10)")), F.coalesce(written, text)


def day_label(text: Column) -> Column:
    """The date of a label that names a day: bare or at midnight. It is taken as written, never shifted by a zone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(T00:00:00(\.0+)?(Z|[+-]\d{2}:\d{2}))?$"), F.substring(text, 1, 10)).try_cast("date")


def filing_fields(accession: Column, document: Column, accepted: Column) -> tuple[Column, Column]:
    """(acceptance time, reasons) of a filing row: a time without a zone is unverified and stays null."""
    zoned = accepted.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    codes = flags.reasons(accession_malformed=~F.coalesce(accession.rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False)), unsafe_document_path=~document.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), acceptance_timezone_unverified=~F.coalesce(zoned, F.lit(False)))
    return F.when(zoned, accepted).try_cast("timestamp"), codes


def history_gaps(period_end: Column, filed: Column, retrieved: Column, inventory: tuple[Column, Column], events: tuple[Column, Column]) -> Column:
    """Which of the filing inventory and the event review do not span a fact's dates: from the earlier of
    its period's end and filing to the later of its filing and retrieval."""
    low, high = F.least(period_end, filed), F.greatest(filed, retrieved)
    return flags.reasons(**{f"{name}_history_incomplete": (span[0] > low) | (span[1] < high) for name, span in (("filing", inventory), ("event", events))})


def eod_prices(bodies: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Sessions within the window, each field with state and value.

    Problems: a body that is not an array of objects, or that repeats a key (one row with
    body_malformed), a date that is not a plain day, and a date that repeats."""
    parsed = bodies.select(*keys, F.expr("try_cast(try_variant_get(try_parse_json(body), '$', 'array<variant>') as array<variant>)").alias("a"))
    rows = parsed.select(*keys, F.col("a").isNull().alias("bad"), F.explode_outer("a").alias("v")).filter("bad or v is not null").select(*keys, "bad", F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m"))
    text = F.try_variant_get(F.col("m")["date"], "$", "string")
    day = day_label(text)
    columns = [day.alias("session"), F.when(F.col("bad") | F.col("m").isNull(), "body_malformed").when(day.isNull(), "date_invalid").alias("problem")]
    for f in PRICE_FIELDS:
        state, value = tri_state(F.col("m")[f], F.map_contains_key("m", f))
        columns += [state.alias(f"{f}_state"), value.alias(f)]
    found = rows.select(*keys, *columns).filter(F.col("session").between(F.lit(low).cast("date"), F.lit(high).cast("date")) | F.col("problem").isNotNull())
    many = F.count("*").over(Window.partitionBy(*keys, "session"))
    return found.withColumn("problem", F.coalesce("problem", F.when(many > 1, "duplicate_session")))


def ohlc_flags(prefix: str = "") -> Column:
    """Fields in doubt where high is under low or open or close outside them; values stay, and volume is
    not in doubt. ``prefix`` is "adj" for the adjusted group."""
    names = {x: f"adj{x.capitalize()}" if prefix else x for x in ("close", "high", "low", "open")}
    close, high, low, open_ = (F.col(names[x]) for x in ("close", "high", "low", "open"))
    broken = (high < low) | ~open_.between(low, high) | ~close.between(low, high)
    return F.when(F.coalesce(broken, F.lit(False)), F.array(*[F.lit(x) for x in names.values()])).otherwise(F.array().cast("array<string>"))


def macro_pages(pages: DataFrame, request: list[str]) -> DataFrame:
    """Observations of pages whose offsets follow each other and whose totals agree, else a problem."""
    held = pages.withColumns({"obs": F.from_json("body", "struct<offset:long,count:long,observations:array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>>")}).select(*request, "obs.*").withColumn("n", F.size("observations").cast("long"))
    order = Window.partitionBy(*request).orderBy("offset")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = held.withColumn("gap", (F.col("offset") != before).cast("int"))
    whole = Window.partitionBy(*request)
    problem = F.when(F.max("gap").over(whole) > 0, "offset_gap").when(F.min("count").over(whole) != F.max("count").over(whole), "total_changed").when(F.sum("n").over(whole) != F.max("count").over(whole), "rows_missing")
    rows = checked.withColumn("problem", problem)
    out = rows.select(*request, "offset", "problem", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("observations"))).alias("i", "o"))
    state = F.when(F.col("o.value") == ".", "source_missing").when(F.col("o.value").try_cast("decimal(18,4)").isNull(), "unparseable").otherwise("observed")
    return out.select(*request, (F.col("offset") + F.col("i")).alias("place"), F.to_date("o.date").alias("reference_date"), F.when(state == "observed", F.col("o.value").try_cast("decimal(18,4)")).alias("value"), F.when(F.col("o").isNotNull(), state).alias("state"), F.to_date("o.realtime_start").alias("realtime_start"), F.to_date("o.realtime_end").alias("realtime_end"), "problem")


def yield_xml(bodies: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Entries of an Atom feed: date and one maturity; a null attribute is source_null."""
    schema = f"entry array<struct<content:struct<properties:struct<NEW_DATE:string,{field}:string>>>>"
    rows = bodies.select(*keys, F.explode(F.from_xml("body", schema).getField("entry")).alias("e"))
    raw = F.col(f"e.content.properties.{field}")
    value = raw.try_cast("decimal(9,4)")
    return rows.select(*keys, F.to_date(F.substring("e.content.properties.NEW_DATE", 1, 10)).alias("reference_date"), value.alias("value"), F.when(raw.isNull() | (raw == ""), "source_null").when(value.isNull(), "unparseable").otherwise("observed").alias("state"))


def verified(bodies: DataFrame) -> DataFrame:
    """problem is set where a body is not the one that was pinned."""
    raw = F.col("body").cast("binary")
    return bodies.withColumn("problem", F.when(F.sha2(raw, 256) != F.col("expected_sha256"), "hash_mismatch").when(F.octet_length(raw) != F.col("expected_bytes"), "size_mismatch"))


def to_publish(batch: DataFrame, published: DataFrame, key: list[str], output: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, and conflicts: the same input published before with another output."""
    conflict = batch.join(published.select(*key, F.col(output).alias("_was")), key).filter(~F.col("_was").eqNullSafe(F.col(output))).drop("_was")
    return batch.join(published, key, "left_anti"), conflict


def _several(value: Column | str) -> Column:
    """Whether a group has more than one value; its ends tell, without a copy of its rows for each column."""
    return F.coalesce(F.min(value) != F.max(value), F.lit(False))


def resolution(rows: DataFrame, by: list[str]) -> DataFrame:
    """The state of each (request, concept) by its considered rows, in this order: coverage that is not
    covered is missing; no mapping rule is unsupported_scope, several are ambiguous; a filing's metadata in
    conflict, then a bad value; more than one value; more than one tag without a preferred one; one value
    with different details. Else the row of the lowest place is observed.

    ``rows`` (by, value, tag, detail, place) may also have coverage (covered or not), rules (their number),
    conflict (a filing's metadata differ), bad (why a value cannot be read) and preferred (a tag).
    """
    has = lambda c, kind, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default).cast(kind)
    held = rows.select(
        *by, "value", "tag", "detail", "place", has("coverage", "string", "covered").alias("coverage"), has("rules", "int", 1).alias("rules"), has("conflict", "boolean", False).alias("conflict"),
        F.coalesce(F.col("bad") if "bad" in rows.columns else F.lit(None), F.when(F.col("value").isNull(), "missing_value")).alias("bad"), (F.col("tag") == (F.col("preferred") if "preferred" in rows.columns else F.lit(None).cast("string"))).alias("wanted"),
    )
    wanted = F.coalesce(F.col("wanted"), F.lit(False))
    grouped = held.groupBy(*by).agg(
        F.min("coverage").alias("c0"), F.max("coverage").alias("c1"), F.max("rules").alias("rules"), F.max("conflict").alias("conflict"), F.min("bad").alias("bad"), _several("value").alias("values"), _several("tag").alias("tags"), _several("detail").alias("details"),
        F.max(wanted).alias("has"), _several(F.when(wanted, F.col("detail"))).alias("own_details"), F.min_by("value", "place").alias("first"), F.min_by(F.when(wanted, F.col("value")), F.when(wanted, F.col("place"))).alias("own"),
    )
    covered = (F.col("c0") == "covered") & (F.col("c1") == "covered")
    chain = [
        (~covered, "missing", F.when(F.col("c1") == "source_missing", "source_missing").otherwise("unresolved_coverage")), (F.col("rules") == 0, "unsupported_scope", F.lit("no_reviewed_complete_scope_tag")), (F.col("rules") > 1, "ambiguous", F.lit("conflicting_mapping_rules")),
        (F.col("conflict"), "ambiguous", F.lit("filing_metadata_conflict")), (F.col("bad").isNotNull(), "missing", F.col("bad")), (F.col("values"), "ambiguous", F.lit("conflicting_reviewed_observations")),
        (F.col("tags") & ~F.col("has"), "ambiguous", F.lit("equivalent_tags_without_reviewed_preference")), (F.when(F.col("has"), F.col("own_details")).otherwise(F.col("details")), "ambiguous", F.lit("same_value_different_source_metadata")),
    ]
    state, reason = F.lit("observed"), F.lit(None).cast("string")
    for condition, s, r in reversed(chain):
        state, reason = F.when(condition, s).otherwise(state), F.when(condition, r).otherwise(reason)
    value = F.when(F.col("has"), F.col("own")).otherwise(F.col("first"))
    return grouped.select(*by, state.alias("state"), reason.alias("reason"), F.when(state == "observed", value).alias("value"))


def period(start: Column, end: Column) -> Column:
    return F.when(end.isNull(), "period_missing").when(start.isNull(), "instant").when(start > end, "start_after_end").otherwise("duration")


def date_fits(day: Column, frequency: Column) -> Column:
    """Whether a reference date is the first day of its month, quarter or year, as its frequency asks."""
    first = F.dayofmonth(day) == 1
    return F.when(frequency == "daily", True).when(frequency == "monthly", first).when(frequency == "quarterly", first & (F.month(day) % 3 == 1)).when(frequency == "yearly", first & (F.month(day) == 1)).otherwise(False)


def write_by_year(rows: DataFrame, date: str, path: str) -> None:
    """Partitioned by year, so a read of some years touches those folders only."""
    rows.withColumn("year", F.year(date)).repartition("year", F.pmod(F.xxhash64(date), F.lit(32))).write.partitionBy("year").mode("append").parquet(path)

"""What a series showed at a date, as answered by the newest response known at a cutoff.

A batch is an answer to a request for a window of dates. Which batch answers is decided by time alone,
before any value, coverage or quality is looked at; so a newer empty answer blocks an older full one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.functions import flags, scalar
from pitspark.functions.storage import stored

#: Powers of two of days that a window is cut into; 2 ** 22 days are more than eleven thousand years.
LEVELS = 23
TOPS = ("newest", "newest_low", "picked")


def _down(days: Column, level: Column) -> Column:
    return F.call_function("shiftright", days, level)


def levels_of(windows: DataFrame, first: Column, last: Column) -> int:
    """How many levels the spans of these windows can have: a longest window is looked for once."""
    longest = windows.agg(F.max(F.date_diff(last, first) + 1)).first()[0] or 1
    return min(LEVELS, max(1, int(longest)).bit_length())


def spans(first: Column, last: Column, most: int = LEVELS) -> Column:
    """The fewest aligned spans of 1, 2, 4, ... days that make up a window: an array of (level, node, held).

    A window of n days has about 2 * log2(n) spans at most, and a date lies in one span of each level. Levels
    are looked at one by one: give their number (:func:`levels_of`) as ``most`` where windows are known to be short.
    """
    low, end = F.unix_date(first), F.unix_date(last) + 1

    def at(level: Column) -> Column:
        left, right = -_down(-low, level), _down(end, level)
        odd_left, odd_right = left.bitwiseAND(F.lit(1)) == 1, right.bitwiseAND(F.lit(1)) == 1
        return F.array(F.struct(level.alias("level"), left.alias("node"), ((left < right) & odd_left).alias("held")), F.struct(level.alias("level"), (right - 1).alias("node"), ((left < right) & odd_right).alias("held")))

    return F.filter(F.flatten(F.transform(F.array(*[F.lit(k) for k in range(most)]), at)), lambda x: x["held"])


def _tops(prefix: str = "") -> list[Column]:
    """The newest answer of a group: by maxima alone, so that parts combine before and after a shuffle.

    ``newest`` and ``newest_low`` end in a hash of the responses and its complement: the largest of each at
    the newest time come from one answer only if all answers of that time have the same responses.
    """
    return [F.max(f"{prefix}{name}").alias(name) for name in TOPS]


def observed(asks: DataFrame, batches: DataFrame, observations: DataFrame, quality: DataFrame, by: list[str], max_age_days: int | None = None) -> DataFrame:
    """One row for each ask (by, selected, cutoff), with its flags and whether its value is usable.

    ``batches`` (by, batch, response_at, known_at, published_at, answers, window_from, window_to,
    coverage_state): known at ``known_at``, when the last of all their inputs had ended; ranked by
    ``response_at``; several of one time are ambiguous if their ``answers`` differ, else the one that was
    published last counts. ``observations`` (by, batch, reference_date, value, value_state) are what they
    hold, ``quality`` (batch, rule, severity, reference_date; a null date means all) what was found in them.

    Without ``max_age_days`` the reference date is the selected one. With it, the reference date is the
    newest one within that age that any known batch holds an observation for, whatever its value; batches
    whose window ends before that date do not count then, and those that begin after the selected one never.

    Cutoffs of a request are few: a batch counts for the first cutoff at or after ``known_at``, and what is
    newest is combined by key, span of days and cutoff before it meets an ask. An ask looks up one span of
    each length that holds its reference date, and the starts of windows between that and its own date. So
    windows are not unrolled into days, and no ask meets all batches of its key.
    """
    backward = max_age_days is not None
    age = max_age_days or 0
    key = [*by, "selected", "cutoff"]
    every = scalar.asked_for(asks.select("cutoff"), "cutoff", "_all")
    asked = asks.select(*key).distinct().crossJoin(every).withColumn("_j", F.array_position("_all", F.col("cutoff")).cast("int") - 1).drop("_all")
    first = F.array_position(F.transform("_all", lambda c: c >= F.col("known_at")), True).cast("int") - 1
    known = batches.filter("response_at is not null and known_at is not null").crossJoin(every).withColumn("_i", first).filter("_i >= 0")
    # read by several steps with long work for each row: stored once, dealt to all tasks
    known = known.select(*by, "batch", "response_at", "published_at", "window_from", "window_to", "_i", F.xxhash64("answers").alias("_mark"))
    known = stored(known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "batch"), "batches")

    # the reference date
    width = age + 1
    bin_of = lambda date: F.floor(F.unix_date(date) / width)
    oldest = F.date_sub("selected", age)
    if backward:
        inside = F.col("reference_date").between(F.col("window_from"), F.col("window_to"))
        held = observations.select(*by, "batch", "reference_date").join(known.select(*by, "batch", "window_from", "window_to", "_i"), [*by, "batch"])
        # a batch that covers its observation's date is in reach whenever the date is; others have their window asked
        ends = [F.when(~inside, F.col(c)).alias(n) for c, n in (("window_from", "_from"), ("window_to", "_to"))]
        seen = held.groupBy(*by, "reference_date", *ends).agg(F.min("_i").alias("_i")).withColumn("_bin", bin_of(F.col("reference_date")))
        near = asked.withColumn("_bin", F.explode(F.array(bin_of(F.col("selected")), bin_of(F.col("selected")) - 1)))
        fits = F.col("reference_date").between(oldest, F.col("selected")) & (F.col("_i") <= F.col("_j")) & (F.col("_from").isNull() | ((F.col("_from") <= F.col("selected")) & (F.col("_to") >= oldest)))
        dates = near.join(seen, [*by, "_bin"]).filter(fits).groupBy(*key).agg(F.max("reference_date").alias("reference_date"))
        asked = asked.join(dates, key, "left")
    else:
        asked = asked.withColumn("reference_date", F.col("selected"))
    asked = asked.withColumns({"_reach": F.coalesce("reference_date", oldest), "reference_date": F.coalesce("reference_date", "selected")})

    # the newest batch whose window reaches that far: it holds the day, or it begins later and not after the selected day
    mark = F.col("_mark")
    most = levels_of(known, F.col("window_from"), F.col("window_to"))
    ranked = known.withColumns({"newest": F.struct("response_at", mark.alias("h")), "newest_low": F.struct("response_at", F.bitwise_not(mark).alias("h")), "picked": F.struct("response_at", "published_at", "batch")})
    covering = ranked.select(*by, "_i", *TOPS, F.inline(spans(F.col("window_from"), F.col("window_to"), most))).groupBy(*by, "level", "node", "_i").agg(*_tops())
    probes = asked.select(*key, "_j", F.unix_date("_reach").alias("_day"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("level"))
    probes = probes.select(*by, "level", _down(F.col("_day"), F.col("level")).alias("node"), F.col("_j").alias("_i"), F.struct("selected", "cutoff").alias("_ask"))
    upto = Window.partitionBy(*by, "level", "node").orderBy("_i", F.col("_ask").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = covering.withColumn("_ask", F.lit(None).cast(probes.schema["_ask"].dataType)).unionByName(probes, allowMissingColumns=True)
    found = both.withColumns({name: F.max(name).over(upto) for name in TOPS}).filter("_ask is not null and newest is not null").select(*by, "_ask.*", *TOPS)
    if backward:
        starts = ranked.groupBy(*by, "window_from", "_i").agg(*_tops()).withColumn("_bin", bin_of(F.col("window_from")))
        near = asked.withColumn("_bin", F.explode(F.array(bin_of(F.col("selected")), bin_of(F.col("selected")) - 1)))
        later = near.join(starts, [*by, "_bin"]).filter((F.col("window_from") > F.col("_reach")) & (F.col("window_from") <= F.col("selected")) & (F.col("_i") <= F.col("_j")))
        found = found.unionByName(later.select(*key, *TOPS))
    chosen = asked.drop("_j", "_reach").join(found.groupBy(*key).agg(*_tops()), key, "left")
    tied = F.col("newest.h") != F.bitwise_not(F.col("newest_low.h"))
    chosen = chosen.select(*key, "reference_date", F.col("newest.response_at").alias("response_at"), F.when(~tied, F.col("picked.batch")).alias("batch"), F.coalesce(tied, F.lit(False)).alias("_tied"))

    # only now its content
    content = observations.groupBy(*by, "batch", "reference_date").agg(F.count("*").alias("_n"), F.first(F.struct("value", "value_state")).alias("_x"))
    whole = chosen.join(batches.select(*by, "batch", "coverage_state"), [*by, "batch"], "left").join(content, [*by, "batch", "reference_date"], "left")
    doubts = chosen.select(*key, "batch", "reference_date").join(quality.withColumnRenamed("reference_date", "_on"), "batch").filter(F.col("_on").isNull() | (F.col("_on") == F.col("reference_date")))
    doubts = doubts.groupBy(*key).agg(F.collect_set("rule").alias("_rules"), F.bool_or(F.col("severity").isin("error", "blocking")).alias("_blocked"))
    whole = whole.join(doubts, key, "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    state = F.when(one, F.col("_x.value_state"))
    answered = F.col("batch").isNotNull()
    own = flags.reasons(
        no_eligible_batch=F.col("response_at").isNull(), ambiguous_batch=F.col("_tied"), missing_observation=answered & F.col("_n").isNull(), ambiguous_observation=answered & (F.col("_n") > 1),
        incomplete_coverage=one & ~F.col("coverage_state").eqNullSafe(F.lit("complete")), backward_selected=one & (F.col("reference_date") != F.col("selected")),
    )
    more = F.when(one, F.array_append(F.coalesce("_rules", F.array().cast("array<string>")), F.when(state != "observed", state))).otherwise(F.array().cast("array<string>"))
    usable = one & (state == "observed") & F.col("coverage_state").eqNullSafe(F.lit("complete")) & ~F.coalesce("_blocked", F.lit(False))
    return whole.select(
        *key, "reference_date", F.when(one, F.date_diff("selected", "reference_date")).alias("age_days"), "batch", "response_at", "coverage_state", F.when(one, F.col("_x.value")).alias("value"), state.alias("value_state"),
        flags.union(own, more).alias("flags"), F.coalesce(usable, F.lit(False)).alias("usable"),
    )


def publication_problem(precision: Column, published_at: Column, published_on: Column, realtime_start: Column, cutoff: Column, source_as_of: Column) -> Column:
    """Why an observation was not known to the public at a cutoff.

    A vintage or a real-time start that is not before the cutoff's day leaves open what was known at that
    instant, whatever the precision. An instant must not lie after the cutoff, a day must lie before its day.
    """
    day = F.to_date(cutoff)
    vintage = F.coalesce(source_as_of >= day, F.lit(False)) | F.coalesce(realtime_start >= day, F.lit(False))
    return (
        F.when(vintage, "ambiguous_source_vintage_at_instant")
        .when(precision == "instant", F.when(~F.coalesce(published_at <= cutoff, F.lit(False)), "source_publication_after_cutoff"))
        .when(precision == "date", F.when(~F.coalesce(published_on < day, F.lit(False)), "ambiguous_source_publication_date"))
        .otherwise("unknown_source_publication_time")
    )


def contained(facts: DataFrame, intervals: DataFrame, by: list[str], date: str, closures: DataFrame | None = None, interval: str = "interval") -> DataFrame:
    """Facts with every interval [valid_from, valid_to) of their key that holds their date.

    ``closures`` (interval, closed_on) end an interval in place of its own end; one without an end is open.
    Intervals are cut into aligned spans (:func:`spans`), up to the newest date asked for, and each date of a key
    is looked up once, in the one span of each length that holds it; so an open end adds no lengths. So no fact meets an interval that does not hold its date, and a key with
    most rows is dealt by its spans and dates.
    """
    to = F.col("valid_to")
    if closures is not None:
        intervals = intervals.join(closures.select(interval, F.col("closed_on").alias("_closed")), interval, "left")
        to = F.coalesce("_closed", to)
    own = [c for c in intervals.columns if c not in (*by, "_closed")]
    days = stored(facts.select(*by, F.col(date).cast("date").alias("_day")).filter("_day is not null").distinct(), "days")
    newest = days.agg(F.max("_day")).first()[0]
    until = F.date_add(F.lit(newest).cast("date"), 1)
    ended = intervals.withColumn("_to", F.least(F.coalesce(to, until), until)).filter("valid_from < _to")
    # spans of even levels alone: a date has half as many, and a span of an odd level is two of the level below
    part = lambda x, k: F.struct((x["level"] - 1).alias("level"), (x["node"] * 2 + k).alias("node"))
    even = lambda x: F.when(x["level"] % 2 == 1, F.array(part(x, 0), part(x, 1))).otherwise(F.array(F.struct(x["level"].alias("level"), x["node"].alias("node"))))
    most = levels_of(ended, F.col("valid_from"), F.date_sub("_to", 1))
    cut = ended.select(*by, F.struct(*own).alias("_held"), F.inline(F.flatten(F.transform(spans(F.col("valid_from"), F.date_sub("_to", 1), most), even))))
    level = F.explode(F.sequence(F.lit(0), F.lit(most - 1), F.lit(2)))
    probes = days.select(*by, "_day", level.alias("level")).withColumn("node", _down(F.unix_date("_day"), F.col("level")))
    met = probes.join(cut, [*by, "level", "node"]).select(*by, "_day", "_held")
    return facts.withColumn("_day", F.col(date)).join(met, [*by, "_day"]).select(*facts.columns, "_held.*")

"""Quality rules whose thresholds come from quantile sketches of each language and source.

A sketch is a table of counts over fixed bins. Counts of parts add up to the counts of the whole, in any
order, so sketches merge exactly: those of a language's sources give the language's. Measures are whole
numbers without a ceiling; a bin keeps the six highest binary digits of a number, so a quantile read from
a sketch is at most 1/32 below the measured one, and exact up to 63.

A source's upper threshold lies as far above its 90th percentile as that is above its median, plus a
margin, so that it follows the source's own tail also where the median is zero. Its quantiles are first
drawn towards those of its language, by :data:`WEIGHT` rows' worth, so that a small source goes with its
language and no row count flips a rule. What a language takes for normal bounds it: the middle of its
sources' robust fences (from median and upper quartile, where up to a quarter of junk does not count)
plus the margin again. So a source made of junk cannot make junk its norm. Lower thresholds mirror this.

Only DataFrame functions are used. The words of a text are found once and bound to a lambda variable, so
that no expression is evaluated twice; repeated three-word windows are neighbours after a sort of 64-bit
window hashes within the row (two different windows of one text share a hash about once in 10**11 texts
of 20,000 words).

Defined cases: a null text has no words; no words means that the base rules fail; null languages and
sources are groups of their own; rows with equal ids are judged one by one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.common import SPACES, WORD_RE, text_or_empty, written

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WEIGHT = 50
DIGITS = 6
AT = (10, 25, 50, 75, 90)
#: Measure, its margin over a fence, and whether low values are judged too.
RULES = (("symbol_rate", 150, False), ("dup_line_rate", 400, False), ("repeat_rate", 300, False), ("word_length", 150, True))


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that the array holds twice or more."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.transform(F.slice(words, F.lit(1), n), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        def like(x: Column, at: Column) -> Column:
            return F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))

        return F.filter(s, lambda x, k: like(x, k - 1) | like(x, k + 1))

    found = F.transform(F.array(F.sort_array(windows)), twice)[0]
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, then the counts of each text."""
    text = text_or_empty("text")

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RE))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    return docs.select(*keep, F.inline(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))), counts)))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds the measures that thresholds apply to, as whole numbers."""
    parts = {"symbol_rate": (1000, "n_symbols", "n_words"), "dup_line_rate": (1000, "n_dup_lines", "n_lines"), "repeat_rate": (1000, "n_repeat_words", "n_words"), "word_length": (100, "word_chars", "n_words")}
    return counts.withColumns({name: F.expr(f"{factor} * {part} div greatest({whole}, 1)") for name, (factor, part, whole) in parts.items()})


def binned(name: str) -> Column:
    """The low end of a number's bin."""
    width = f"cast(greatest(length(bin({name})) - {DIGITS}, 0) as int)"
    return F.expr(f"shiftleft(shiftright({name}, {width}), {width})")


def sketches(rated: DataFrame, by: list[str]) -> DataFrame:
    """Counts by group, measure and bin, of rows with a word."""
    bins = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), binned(name).alias("bin")) for name, *_ in RULES]))
    return rated.filter("n_words > 0").select(*by, bins.alias("b")).groupBy(*by, "b.measure", "b.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups: counts added up."""
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """rows and q10 to q90 of each group and measure: the first bin that reaches the share."""
    window = Window.partitionBy(*by, "measure")
    steps = sketch.withColumns({"rows": F.sum("n").over(window), "reached": F.sum("n").over(window.orderBy("bin"))})
    at = [F.min(F.when(F.col("reached") * 100 >= F.col("rows") * q, F.col("bin"))).alias(f"q{q}") for q in AT]
    return steps.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), *at)


def _margin() -> Column:
    """The margin of a row's measure."""
    out = F.lit(0)
    for name, margin, _ in RULES:
        out = F.when(F.col("measure") == name, margin).otherwise(out)
    return out


def drawn(source: DataFrame, lang: DataFrame) -> DataFrame:
    """Sources' quantiles, drawn towards their language's, with both kinds of fences."""
    every = lang.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), *[F.col(f"q{q}").alias(f"l{q}") for q in AT])
    both = source.join(every, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
    mixed = both.select("lang", "source", "measure", *[F.expr(f"(rows * q{q} + {WEIGHT} * l{q}) div (rows + {WEIGHT})").alias(f"q{q}") for q in AT])
    margin = _margin()
    return mixed.select(
        "lang", "source", "measure", (2 * F.col("q90") - F.col("q50") + margin).alias("high"), (2 * F.col("q10") - F.col("q50") - margin).alias("low"),
        (3 * F.col("q75") - 2 * F.col("q50") + margin).alias("sure_high"), (3 * F.col("q25") - 2 * F.col("q50") - margin).alias("sure_low"),
    )


def middle(fences: DataFrame, name: str) -> DataFrame:
    """The middle of the sources' fences in each language, each source counted once."""
    return quantiles(fences.groupBy("lang", "measure", F.col(name).alias("bin")).agg(F.count("*").alias("n")), ["lang"]).select(F.col("lang").alias(f"{name}_lang"), F.col("measure").alias(f"{name}_measure"), F.col("q50").alias(f"{name}_middle"))


def thresholds(rated: DataFrame) -> DataFrame:
    """For each language and source: an upper threshold for each measure, and lower ones where they apply."""
    own = written(sketches(rated, ["lang", "source"]), "sketches")
    fences = written(drawn(quantiles(own, ["lang", "source"]), quantiles(merged(own, ["lang"]), ["lang"])), "fences")
    both = fences
    for name in ("sure_high", "sure_low"):
        both = both.join(middle(fences, name), F.col("lang").eqNullSafe(F.col(f"{name}_lang")) & (F.col("measure") == F.col(f"{name}_measure")))
    high, low = F.least("high", F.col("sure_high_middle") + _margin()), F.greatest("low", F.col("sure_low_middle") - _margin())
    columns = []
    for name, _, two_sided in RULES:
        mine = F.col("measure") == name
        columns.append(F.max(F.when(mine, high)).alias(f"{name}_high"))
        if two_sided:
            columns.append(F.max(F.when(mine, low)).alias(f"{name}_low"))
    return both.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(*columns)


def judged(rated: DataFrame) -> DataFrame:
    """``rated`` (a stored table) with base_failed and kept, by a join with the thresholds of its group."""
    limits = thresholds(rated)
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    fits = F.lit(True)
    for name, _, two_sided in RULES:
        fits = fits & (F.col(name) <= F.col(f"{name}_high"))
        if two_sided:
            fits = fits & (F.col(name) >= F.col(f"{name}_low"))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of each row of ``docs`` (doc_id, text, lang, source)."""
    rated = written(rates(measured(docs, ["doc_id", "lang", "source"])), "rated")
    return judged(rated).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Columns go through as one struct, so that no name of theirs can clash with one used here.
    """
    whole = docs.select("lang", "source", "text", F.struct("*").alias("row"))
    rated = written(rates(measured(whole, ["lang", "source", "row"])), "rated", compression="zstd")
    return judged(rated).filter("kept").select("row.*")

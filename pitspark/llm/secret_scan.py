"""Secret scans with an incremental ledger of blobs.

A text's content address is the SHA-256 of its bytes. The ledger holds one row for each pair of a blob
and a rule version that has been scanned, with what was found there. A scan takes the distinct blobs of
all paths and versions given, leaves out the pairs that the ledger has, scans the rest once each, appends
them, and joins findings back to every path. Places in a text come from the lengths of what lies between
matches, summed over the matches of a kind; only DataFrame functions are used.

Defined cases: a null text counts as the empty blob; equal texts under any ids are one blob; spans of
different kinds may overlap; a match that its rule's length bound fails is passed over whole, as the
leftmost search does; a run that is repeated after a lost driver may append a pair twice, which reading
the ledger undoes; an empty table scans nothing and returns nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitspark.llm.common import shared_dir, text_or_empty

MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern``, of whose group ``group`` at least ``least`` characters are asked.

    Where the pattern itself bounds the length, ``least`` is 0. ``base`` rules are those of the contract.
    ``whole`` is what is searched where a secret goes on behind what ``pattern`` matches.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    whole: str = ""

    @property
    def search(self) -> str:
        return self.whole or self.pattern


#: A private key up to the END line of its kind, or else to the end of its base64 lines. Line ends may be
#: written as backslash and letter. Repeats are possessive, which Java's regex walks without recursion.
_BREAK = r"(?:\s|\\[nr])*+"
_LINES = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:(?:{_BREAK}[A-Za-z0-9+/]{{32,}}+={{0,2}}+)++(?:[\x20\t]*+(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]++={{0,2}}+(?=[\x20\t]*+(?:\z|[\r\n\"']|\\[nr])))?+)?+"
_KEY = rf"-----BEGIN ([A-Z ]{{0,40}})PRIVATE KEY-----(?:[^-]*+(?:-{{1,4}}+[^-]++)*+-----END \1PRIVATE KEY-----|{_LINES})"

#: Fixed values. The version of the rules is a hash of this list, so that a changed rule is a new version.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", whole=_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
LEDGER = "blob string, rules string, found array<struct<start:long,rank:int,kind:string,end:long>>"


def version(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.sha2(F.lit(repr(rules)), 256)


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hits(text: Column, rule: Rule, rank: int) -> Column:
    """rank, i, gap before the match, length of the match, and whether it counts, for each match in order."""
    pattern = F.lit(rule.search)
    bound = F.array(F.struct(F.split(text, rule.search, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("asked")))

    def each(x: Column) -> Column:
        return F.transform(
            x["all"],
            lambda hit, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("i"), F.length(F.get(x["gaps"], i)).cast("long").alias("gap"), F.length(hit).cast("long").alias("size"), (F.length(F.get(x["asked"], i)) >= rule.least).alias("counts")
            ),
        )

    return F.transform(bound, each)[0]


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger row for each of ``blobs`` (blob, text; blob distinct)."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    hits = blobs.select("blob", F.explode_outer(F.concat(*[_hits(F.col("text"), r, k) for k, r in enumerate(rules)])).alias("h"))
    upto = Window.partitionBy("blob", "h.rank").orderBy("h.i").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.select("blob", "h.*", F.sum(F.col("h.gap") + F.col("h.size")).over(upto).alias("end"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), F.col("rank"), F.get(kinds, F.col("rank")).alias("kind"), F.col("end"))
    found = placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(F.col("counts"), span))).alias("found"))
    return found.select("blob", version(rules).alias("rules"), "found")


def read_ledger(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and found of all pairs with this version of the rules."""
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == version(rules)).select("blob", "found").dropDuplicates(["blob"])


def update_ledger(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger lacks of the blobs of ``texts`` (text), appends it, and returns the ledger."""
    spark = texts.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    text = text_or_empty("text")
    blobs = texts.select(address(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    unseen = blobs.join(read_ledger(spark, ledger, rules).select("blob"), "blob", "left_anti")
    scanned(unseen, rules).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger, rules)


def secret_findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found (its spans: start, rank of the kind, kind, end) of each row of ``docs``."""
    ledger = ledger or shared_dir(docs.sparkSession, "ledger")
    known = update_ledger(docs.select("text"), ledger, rules).filter(F.size("found") > 0)
    paths = docs.select("doc_id", address(text_or_empty("text")).alias("blob"))
    nothing = F.from_json(F.lit("[]"), "array<struct<start:long,rank:int,kind:string,end:long>>")
    return paths.join(known, "blob", "left").select("doc_id", F.coalesce("found", nothing).alias("found"))


def spans_text(found: Column) -> Column:
    """kind:start:end, comma-joined, in the order of ``found``."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digest(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans, for each row of ``docs``."""
    found = secret_findings(docs, ledger)
    base = {r.kind: k for k, r in enumerate(RULES) if r.base}

    def count(kind: str, rank: int) -> Column:
        return F.size(F.filter("found", lambda x: x["rank"] == rank)).cast("long").alias(f"n_{kind}")

    counts = [count(*item) for item in base.items()]
    of_base = F.filter("found", lambda x: x["rank"] < len(base))
    return found.select("doc_id", *counts, F.sha2(spans_text(of_base), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"))


def _cutter(least: int):
    def cut(x: Column) -> Column:
        kept = F.substr(x["all"], F.lit(1), F.length(x["all"]) - F.length(x["asked"]))
        return F.when(F.length(x["asked"]) >= least, F.concat(kept, F.lit(MARK))).otherwise(x["all"])

    return cut


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``text`` with the asked-for part of each counted match replaced by :data:`MARK`, rule by rule.

    Rules with a ``whole`` come first, so that no other rule's mark cuts their match short.
    """
    for rule in sorted(rules, key=lambda r: not r.whole):
        pattern = F.lit(rule.search)
        if rule.group == 0:
            text = F.regexp_replace(text, rule.search, MARK.replace("[", r"\[").replace("]", r"\]"))
            continue
        hits = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("asked"))
        cut = F.transform(hits, _cutter(rule.least))
        text = F.array_join(F.zip_with(F.split(text, rule.search, -1), cut, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")
    return text


def without_secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """``docs`` with the secrets of each text redacted; other texts and columns are as they were."""
    ledger = ledger or shared_dir(docs.sparkSession, "ledger")
    known = update_ledger(docs.select("text"), ledger).filter(F.size("found") > 0).select(F.col("blob").alias("_blob"))
    whole = docs.select(F.struct("*").alias("row"), address(text_or_empty("text")).alias("_blob"))
    marked = whole.join(known.withColumn("_found", F.lit(True)), "_blob", "left")
    text = F.when(F.col("_found"), redacted(F.col("row.text"))).otherwise(F.col("row.text"))
    return marked.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])

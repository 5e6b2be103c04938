"""SQL for those training-data queries that SQL can express, in the oracle's dialect."""

from __future__ import annotations

from pitspark.llm.i_match import COMMONEST, LEVELS, RAREST, SLOTS
from pitspark.llm.merkle import FAN, HASHED
from pitspark.llm.quality_rules import AT, DIGITS, RULES, SYMBOLS, WEIGHT
from pitspark.llm.secret_scan import RULES as SECRETS
from pitspark.llm.spelling import DELETED_ONE_IN, FORM_TIMES, LEAST_COUNT, LEAST_LETTERS

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

WARC = """
with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, cast(strlen(html) as bigint) as n, sha256(html) as h from p),
  f as (select h, min(page_id) as first from d where n >= 100 group by h having count(*) > 1)
select d.page_id, d.n as payload_bytes, d.h as payload_digest, case when f.first is not null and d.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when f.first is not null and d.page_id is distinct from f.first then f.first end as refers_to
from d left join f on d.h = f.h"""


def quality_rules() -> str:
    rate = {"symbol_rate": "1000 * n_symbols // greatest(n_words, 1)", "dup_line_rate": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeat_rate": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    rates = ", ".join(f"{x} as {name}" for name, x in rate.items())
    low_end = "(({0} >> greatest(length(bin({0})) - " + str(DIGITS) + ", 0)) << greatest(length(bin({0})) - " + str(DIGITS) + ", 0))"
    bins = " union all ".join(f"select lang, source, '{r[0]}' as measure, {low_end.format(r[0])} as bin from rated where n_words > 0" for r in RULES)

    def quantiles(keys: str, table: str = "bins") -> str:
        inner = f"select {keys}, measure, bin, sum(count(*)) over (partition by {keys}, measure order by bin) as reached, sum(count(*)) over (partition by {keys}, measure) as rows from {table} group by {keys}, measure, bin"
        return f"select {keys}, measure, max(rows) as rows, " + ", ".join(f"min(case when reached * 100 >= rows * {q} then bin end) as q{q}" for q in AT) + f" from ({inner}) group by {keys}, measure"

    margin = "case s.measure " + " ".join(f"when '{name}' then {m}" for name, m, _ in RULES) + " end"
    drawn = "select s.lang, s.source, s.measure, " + ", ".join(f"cast((s.rows * s.q{q} + {WEIGHT} * l.q{q}) // (s.rows + {WEIGHT}) as bigint) as q{q}" for q in AT) + " from by_source s join by_lang l on l.lang is not distinct from s.lang and l.measure = s.measure"
    fences = f"select lang, source, measure, 2 * q90 - q50 + {margin} as high, 2 * q10 - q50 - {margin} as low, 3 * q75 - 2 * q50 + {margin} as sure_high, 3 * q25 - 2 * q50 - {margin} as sure_low from drawn s"
    middles = [quantiles("lang", f"(select lang, measure, {name} as bin from fences)") for name in ("sure_high", "sure_low")]
    limit = f"""select s.lang, s.source, s.measure, least(s.high, h.q50 + {margin}) as high, case when s.measure = 'word_length' then greatest(s.low, w.q50 - {margin}) else -1 end as low
      from fences s join middle_high h on h.lang is not distinct from s.lang and h.measure = s.measure join middle_low w on w.lang is not distinct from s.lang and w.measure = s.measure"""
    outside = " or ".join(f"(k.measure = '{name}' and r.{name} not between k.low and k.high)" for name, *_ in RULES)
    return rf"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
  w as (select *, regexp_extract_all(text, '{WORD}') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from t),
  u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
  v as (select doc_id, i, word || ' ' || lead(word) over z || ' ' || lead(word, 2) over z as k from u window z as (partition by doc_id order by i)),
  twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as c from v where k is not null) where c > 1),
  covered as (select doc_id, count(distinct i + d) as n from twice cross join (values (0), (1), (2)) s(d) group by 1),
  counted as (select w.doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(text, '{SPACE}', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines, coalesce(c.n, 0) as n_repeat_words from w left join covered c on c.doc_id = w.doc_id),
  rated as (select *, {rates}, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted),
  bins as ({bins}), by_source as ({quantiles("lang, source")}), by_lang as ({quantiles("lang")}),
  drawn as ({drawn}), fences as ({fences}), middle_high as ({middles[0]}), middle_low as ({middles[1]}), limits as ({limit})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from limits k where k.lang is not distinct from r.lang and k.source is not distinct from r.source and ({outside})) as kept
from rated r"""


def secrets() -> str:
    spans = []
    for rank, r in enumerate(SECRETS):
        pattern = r.pattern.replace("'", "''")
        spans.append(
            f"select doc_id, {rank} as rank, '{r.kind}' as kind, i, length(hits[i]) as size, length(asked[i]) >= {r.least} as counts, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as start "
            f"from (select doc_id, gaps, hits, asked, unnest(range(1, len(hits) + 1)) as i from (select doc_id, string_split_regex(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as hits, regexp_extract_all(text, '{pattern}', {r.group}) as asked from t))"
        )
    base = ", ".join(f"'{r.kind}'" for r in SECRETS if r.base)
    counts = ", ".join(f"count(case when kind = '{r.kind}' then 1 end) as n_{r.kind}" for r in SECRETS if r.base)
    one = "kind || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(start + size as bigint) as varchar)"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents), s as (select * from ({" union all ".join(spans)}) where counts)
select t.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' order by start, rank) filter (where kind in ({base})), '')) as base_sha256, coalesce(string_agg({one}, ',' order by start, rank), '') as spans
from t left join s on s.doc_id = t.doc_id group by t.doc_id"""


NEAR = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as words from documents),
  s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as g from w),
  n as (select doc_id, count(*) as n from s group by 1),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
  e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
  r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from r where r.a = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id"""


def crc32(data: str) -> str:
    """The unsigned CRC-32 of a list of bytes (the reflected polynomial EDB88320, eight bits a byte)."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {data}), lambda c, b: xor(c >> 8, list_extract(cast({table} as bigint[]), xor(c, b) % 256 + 1))), 4294967295)"


def spelling() -> str:
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    octets = "flatten(list_transform(string_split(cast(doc_id as varchar) || ':' || run, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [cast(192 + unicode(c) // 64 as bigint), cast(128 + unicode(c) % 64 as bigint)] end))"
    return f"""
with recursive r as (select doc_id, unnest(regexp_extract_all({lowered}, '[a-zÀ-ÿ]+')) as run from documents),
  u as (select run, count(*) as many, {crc32(octets)} as h from r where length(run) >= {LEAST_LETTERS} group by doc_id, run),
  v as (select case when h % {DELETED_ONE_IN} = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, many from u),
  w as (select word, cast(sum(many) as bigint) as n from v where length(word) >= {LEAST_LETTERS} group by word having sum(many) >= {LEAST_COUNT}),
  x as (select word, n, i, left(word, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from w)),
  e as (select a.word, a.n, b.word as near, b.n as near_n from x a join x b on a.rest = b.rest and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
    union select x.word, x.n, w.word, w.n from x join w on w.word = x.rest union select w.word, w.n, x.word, x.n from x join w on w.word = x.rest),
  b as (select word, n, count(*) as n_near, max(near_n) as most from e group by word, n),
  f as (select b.word, min(near) as form, most as form_n from b join e on e.word = b.word and e.near_n = b.most where most >= {FORM_TIMES} * b.n group by b.word, most),
  c as (select word, form as root, 1 as k from f union all select c.word, f.form, k + 1 from c join f on f.word = c.root),
  t as (select word, arg_max(root, k) as root from c group by word)
select w.word, f.form, coalesce(t.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, f.form_n from w left join b on b.word = w.word left join f on f.word = w.word left join t on t.word = w.word"""


def i_match() -> str:
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"list_filter(list_distinct(string_split_regex({lowered}, '{SPACE}+')), lambda w: w <> '')"
    number = "cast('0x' || substr(md5(term), {}, 8) as bigint)"
    subset = f"substr('{LEVELS}', least(32 - length(bin({number.format(1)})), {len(LEVELS) - 1}) + 1, 1) || lpad(cast({number.format(9)} % {SLOTS} as varchar), 2, '0')"

    def near(a: str, b: str) -> str:
        def entries(x: str) -> str:
            return f"list_filter(string_split(coalesce(string_split({x}, ':')[2], ''), ','), lambda e: e <> '')"

        agree = f"list_intersect({entries(a)}, {entries(b)})"
        ids = f"list_distinct(list_transform(list_concat({entries(a)}, {entries(b)}), lambda e: e[1:3]))"
        at = "len(list_filter({}, lambda e: e[1] = l))"
        sums = [f"list_sum(list_transform({list(LEVELS)}, lambda l: case when {at.format(ids)} * 2 <= {SLOTS} then {at.format(x)} else 0 end))" for x in (agree, ids)]
        return f"case when {a} = {b} then 1.0 else coalesce(cast({sums[0]} as double) / nullif(cast({sums[1]} as double), 0), 0.0) end"

    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
  n as (select doc_id, text, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next, coalesce(lead(doc_id) over (order by doc_id), first_value(doc_id) over (order by doc_id)) as next_id from t),
  e as (select doc_id, next_id, text, cast(length(text) as bigint) as n_chars, left(text, length(text) - length(text) // 2) || left(next, length(text) // 2) as edited from n),
  lex as (select term, {subset} as subset from (select term, count(*) as c from (select unnest({terms.format("text")}) as term from t) group by term)
    where c * {RAREST} >= (select count(*) from t) and c <= (select ceil(count(*) / {COMMONEST}) from t)),
  w as (select doc_id, 0 as kind, unnest({terms.format("text")}) as term from e union all select doc_id, 1, unnest({terms.format("edited")}) from e),
  g as (select doc_id, kind, subset || substr(md5(string_agg(subset || w.term, ' ' order by w.term)), 1, 4) as entry from w join lex on lex.term = w.term group by doc_id, kind, subset),
  p as (select doc_id, kind, string_agg(entry, ',' order by entry) as listed from g group by doc_id, kind),
  f as (select e.doc_id, next_id, n_chars, sha256(edited) as edited_sha256, coalesce(substr(md5(a.listed), 1, 16) || ':' || a.listed, '=' || substr(sha256(text), 1, 16)) as fingerprint, coalesce(substr(md5(b.listed), 1, 16) || ':' || b.listed, '=' || substr(sha256(edited), 1, 16)) as edited_fingerprint
    from e left join p a on a.doc_id = e.doc_id and a.kind = 0 left join p b on b.doc_id = e.doc_id and b.kind = 1)
select f.doc_id, f.n_chars, f.edited_sha256, f.fingerprint, f.edited_fingerprint, {near("f.fingerprint", "f.edited_fingerprint")} as near_edited, {near("f.fingerprint", "x.fingerprint")} as near_next from f join f x on x.doc_id = f.next_id"""


def merkle(levels: int = 6) -> str:
    """Trees of up to FAN ** ``levels`` leaves a source and as many sources."""

    def field(x: str) -> str:
        return f"coalesce(cast(strlen(cast({x} as varchar)) as varchar) || ':' || cast({x} as varchar), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in HASHED) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    code = crc32("list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))")
    steps = []

    def climb(tree: str) -> None:
        """Tables {tree}1.. from {tree}0 (tree, r, h): each node with its siblings; beyond the root a node goes up unchanged."""
        for k in range(levels):
            run = f"partition by tree, r // {FAN} order by r rows between"
            steps.append(
                f"{tree}s{k} as (select tree, r, h, count(*) over (partition by tree) as n, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as lft, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as rgt from {tree}{k})"
            )
            steps.append(f"{tree}{k + 1} as (select tree, r // {FAN} as r, case when n > 1 then sha256(string_agg(h, '' order by r)) else any_value(h) end as h from {tree}s{k} group by tree, r // {FAN}, n)")

    climb("d")
    steps.append(f"t0 as (select 0 as tree, row_number() over (order by tree nulls first) - 1 as r, h, tree as name from d{levels})")
    climb("t")
    joins = " ".join(f"join ds{k} d{k}_ on d{k}_.tree is not distinct from l.source and d{k}_.r = l.r // {FAN**k}" for k in range(levels))
    joins += " join t0 on t0.name is not distinct from l.source " + " ".join(f"join ts{k} t{k}_ on t{k}_.r = t0.r // {FAN**k}" for k in range(levels))
    nodes = [f"d{k}_" for k in range(levels)] + [f"t{k}_" for k in range(levels)]
    sides = "[" + ", ".join(f"{{'n': {x}.n, 'l': {x}.lft, 'r': {x}.rgt}}" for x in nodes) + "]"
    folds = []
    for k in range(2 * levels):
        folds.append(f"f{k + 1} as (select *, case when sides[{k + 1}].n > 1 then sha256(sides[{k + 1}].l || c{k} || sides[{k + 1}].r) else c{k} end as c{k + 1} from f{k})")
    return f"""
with l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r from (select doc_id, source, {leaf("text")} as leaf, case when doc_id is not null and {code} % 5 = 0 then {leaf(lowered)} end as tampered from documents)),
  d0 as (select source as tree, r, leaf as h from l), {", ".join(steps)},
  f0 as (select l.doc_id, l.leaf, t0.h as subroot, (select h from t{levels}) as root, {sides} as sides, coalesce(l.tampered, l.leaf) as c0 from l {joins}), {", ".join(folds)}
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.l || s.r), '')) as proof_sha256, c{2 * levels} as folded_root, c{2 * levels} = root as verified from f{2 * levels}"""


SQL = {"op2_warc": WARC, "op3_quality_rules": quality_rules(), "op8_secret_scan": secrets(), "op10_ngram_join": NEAR, "op11_spelling_variants": spelling(), "op12_i_match": i_match(), "op13_merkle_manifest": merkle()}

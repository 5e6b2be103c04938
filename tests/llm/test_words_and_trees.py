"""Spelling variants, I-Match fingerprints and the Merkle manifest against plain definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pitspark.llm import i_match, merkle, ranking, spelling
from pitspark.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank string, term string, cell string, hash string"
EXTRA = ("t", "r", "m", "c", "h")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, "Straße Grammatik grammatik GRAMMATIK gramatik, Übermut\n", "de", "a", 7),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "grammatik gramatik grammatikk grommatik überfluss überfluss", "de", "b", 2),
    (5, "same words here again and again", "en", "a", 1),
    (5, "same words here again and again", "en", "a", 1),
    (5, "other words under the same number", "en", "a", 1),
    (None, "no id AND capitals", "en", None, 3),
    (None, "no id AND capitals", "en", None, 3),
    (8, "long" * 5000 + " " + "word " * 3000, "en", "b", 4),
    (-9, "𝔘nicode 😀 beyond the plane 😀", "en", "c", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple(map(str, t)))


def some_texts(n=300, seed=4):
    """Invented texts over a skewed vocabulary with typing errors, some of them copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiou" if k % 2 else "bdlmnrstß") for k in range(rng.randint(4, 11))) for _ in range(400)]

    def typed(word):
        k, how = rng.randrange(len(word)), rng.random()
        return word[:k] + word[k + 1 :] if how < 0.03 else word[:k] + "é" + word[k:] if how < 0.06 else word[:k] + "x" + word[k + 1 :] if how < 0.09 else word

    texts = [" ".join(typed(vocabulary[int(rng.random() ** 3 * 400)]).title() for _ in range(rng.randint(0, 120))) for _ in range(n)]
    return [rng.choice(texts) if rng.random() < 0.3 else t for t in texts]


# ---- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return len(long_) == len(short) + 1 and any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda v: (-n[v], v))] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("small", [False, True])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, small):
    if small:  # many cells, parts, nodes and batches
        for name, value in {"SAMPLE": 200, "SAMPLE_LEAF": 4, "CELL_WORDS": 8, "LEAF_WORDS": 3, "QUERIES": 5, "MOST_PAIRS": 7}.items():
            monkeypatch.setattr(spelling, name, value)
    docs = list(enumerate(some_texts()))
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == plain_variants(docs)
    assert sum(r[1] is not None for r in got) > 5


def test_chains_of_forms_lead_to_their_end(spark):
    docs = [(1, "aaaaaaa " * 2 + "aaaaaab " * 20 + "aaaaabb " * 200 + "aaaabbb " * 2000)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {w: r["root"] for w, r in got.items() if r["n"] >= 20} == {w: "aaaabbb" for w in ("aaaaaab", "aaaaabb", "aaaabbb")}
    assert got["aaaaaaa"]["form"] == "aaaaaab" and got["aaaaaaa"]["root"] == "aaaabbb"


def test_variants_of_odd_tables(spark, odd, empty):
    got = rows(spelling.variants(odd).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == plain_variants([(r[0], r[1]) for r in ODD])
    assert spelling.variants(empty).count() == 0


def test_codes_never_lose_a_neighbour():
    rng = np.random.default_rng(1)
    words = ["".join(chr(c) for c in rng.choice([97, 98, 99, 224, 230, 255], 9)) for _ in range(300)]
    points = spelling.codes(spelling.letters(words, 9))
    for i, a in enumerate(words):
        for k in range(9):
            changed = spelling.codes(spelling.letters([a[:k] + "z" + a[k + 1 :]], 9))[0]
            assert np.bitwise_count(points[i] ^ changed) <= 2
    fine = spelling.Fine(pa.array(words), np.ones(300, np.int64), 9)
    found = {(words[q], words[h]) for qs, hs in fine.near(pa.array(words), spelling.SAME) for q, h in zip(qs, hs)}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


# ---- I-Match


def plain_prints(texts):
    """Fingerprints of (order, text) by the definition, with sets and sorting."""
    own = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 2] + own[(i + 1) % len(own)][: len(t) // 2] for i, t in enumerate(own)]

    def terms(t):
        return {w for w in re.split("[ \t-\r]+", t.translate(LOWER)) if w}

    df = Counter(w for t in own for w in terms(t))
    lexicon = {w for w, c in df.items() if c * i_match.RAREST >= len(own) and c <= -(-len(own) // i_match.COMMONEST)}

    def subset(w):
        md5 = hashlib.md5(w.encode()).hexdigest()
        level = min(32 - len(bin(int(md5[:8], 16))) + 2, len(i_match.LEVELS) - 1)
        return i_match.LEVELS[level] + f"{int(md5[8:16], 16) % i_match.SLOTS:02}"

    def printed(t):
        by = {}
        for w in sorted(terms(t) & lexicon, key=lambda w: w.encode()):
            by.setdefault(subset(w), []).append(w)
        listed = ",".join(s + hashlib.md5(" ".join(s + w for w in ws).encode()).hexdigest()[:4] for s, ws in sorted(by.items()))
        return hashlib.md5(listed.encode()).hexdigest()[:16] + ":" + listed if listed else "=" + hashlib.sha256(t.encode()).hexdigest()[:16]

    def near(a, b):
        if a == b:
            return 1.0
        xs, ys = (set(p.split(":")[1].split(",")) if ":" in p else set() for p in (a, b))
        of, agree = Counter(s[0] for s in {e[:3] for e in xs | ys}), Counter(e[0] for e in xs & ys)
        sparse = [k for k in of if 2 * of[k] <= i_match.SLOTS]
        return sum(agree[k] for k in sparse) / sum(of[k] for k in sparse) if sparse else 0.0

    prints, changed = [printed(t) for t in own], [printed(t) for t in edited]
    return [(len(t), hashlib.sha256(e.encode()).hexdigest(), p, c, near(p, c), near(p, prints[(i + 1) % len(own)])) for i, (t, e, p, c) in enumerate(zip(own, edited, prints, changed))]


def close(got, want):
    return len(got) == len(want) and all(a[:-2] == b[:-2] and a[-2:] == pytest.approx(b[-2:]) for a, b in zip(got, want))


@pytest.mark.parametrize("step", [1, 97, 10**15])
def test_fingerprints_follow_the_definition(spark, step):
    texts = some_texts(200)
    got = rows(i_match.fingerprinted(spark.createDataFrame([(i * step - 5, t) for i, t in enumerate(texts)], "doc_id long, text string")).drop("doc_id"))
    want = sorted(plain_prints(texts), key=lambda t: tuple(map(str, t)))
    assert close(got, want)


def test_fingerprints_by_a_shuffled_lexicon(spark, monkeypatch):
    monkeypatch.setattr(i_match, "MOST_BROADCAST", 0)
    texts = some_texts(60)
    got = rows(i_match.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).drop("doc_id"))
    assert close(got, sorted(plain_prints(texts), key=lambda t: tuple(map(str, t))))


def test_fingerprints_of_odd_tables(spark, odd, empty):
    got = i_match.fingerprinted(odd).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((r[0] is not None, r[0] or 0, len(r[1] or "")) for r in ODD)
    numbered = sorted((r for r in ODD if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    nameless = [r for r in ODD if r[0] is None]  # equal rows, so their order does not matter
    want = plain_prints([r[1] for r in nameless + numbered])
    assert close(sorted(tuple(r)[1:] for r in got), sorted(want))
    assert i_match.fingerprinted(empty).count() == 0
    one = i_match.fingerprinted(odd.filter("doc_id = 4")).collect()[0]
    assert one["near_next"] == 1.0


def test_likeness_tells_edited_texts_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = i_match.fingerprinted(docs).toPandas()
    long_ = got[got.n_chars >= 500]
    assert long_.near_edited.mean() > 0.2 > 5 * long_.near_next.mean()
    assert (long_.near_edited > long_.near_next).mean() > 0.95


# ---- the Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_manifest(docs, fan=16):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return sha("".join(field(text if c == "text" else r[c]) for c in merkle.HASHED))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            start = i // fan * fan
            yield "".join(level[start:i]), "".join(level[i + 1 : start + fan])
            i //= fan

    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = {s: tree([h for _, h in by[s]]) for s in names}
    top, out = tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (r, h) in enumerate(by[s]):
            now, steps = h, [*path(trees[s], i), *path(top, k)]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["text"] is not None:
                now = leaf(r, r["text"].translate(LOWER))
            for left, right in steps:
                now = sha(left + now + right)
            out.append((r["doc_id"], h, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), now, now == top[-1][0]))
    return sorted(out, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("digits", [3, 1])
def test_manifest_is_that_of_the_definition(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FAN**digits)
    rng = random.Random(2)
    docs = [{"doc_id": i, "text": f"Text {rng.random()}" if i % 7 else None, "lang": rng.choice(["en", None]), "source": "hot" if i % 3 else rng.choice(["a", "ä", "b", None, f"s{i}"]), "n_chars": i} for i in range(1500)]
    df = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows(merkle.manifest(df))
    assert got == plain_manifest(docs)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_odd_tables(spark, odd, empty):
    names = [f.split()[0] for f in DOCS.split(", ")]
    assert rows(merkle.manifest(odd)) == plain_manifest([dict(zip(names, (*r, *EXTRA))) for r in ODD])
    assert merkle.manifest(empty).count() == 0
    alone = merkle.manifest(odd.filter("doc_id = 4")).collect()[0]
    assert alone["leaf"] == alone["root"] == alone["subroot"] and alone["proof_sha256"] == sha("")


def test_ranks_count_up_within_each_group(spark):
    pairs = [("a" if i % 4 else "b", (i * 7919) % 1000) for i in range(1000)]
    got = ranking.ranked(spark.createDataFrame(pairs, "g string, x long").repartition(9), "g", ["x"], Scratch(spark, "t"), "r").collect()
    for g in "ab":
        want = sorted(x for k, x in pairs if k == g)
        assert [r["x"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want
        assert {r["total"] for r in got if r["g"] == g} == {len(want)}

"""A quality classifier from compressed sizes.

A Zstandard dictionary is made from good and another from bad labelled texts. A text is compressed in
blocks with each, and the difference of the two totals over the larger one says which kind it is more
like. Text that compresses to next to nothing either way (one word again and again) gives no difference,
so the log of its compressed share joins it in the logistic fit that turns both into a score.

The fit reads a bounded sample of labelled rows: :data:`SAMPLE` of each label for the dictionaries and as
many again for the calibration, each text at most :data:`LONGEST` bytes; other rows are scored whole
whatever their size.

Defined cases: a null text counts as empty, and an empty text has no difference and the share 1; labels
that are null or not 0 or 1 are left out; a document with both labels counts under each; with one label
only, or none, every score is the share of label 1 in the sample (0.5 if it is empty).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.common import text_or_empty

SAMPLE = 2000
LONGEST = 32 * 1024
DICTIONARY_BYTES = 32 * 1024
BLOCK = 512
LEVEL = 3


@dataclass(frozen=True)
class Model:
    """Both dictionaries and the weights of the fit (constant, difference, log share)."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard

    blocks = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few texts to train on: their own bytes serve
        return b"".join(blocks)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=4)
def _compressors(model: Model):
    import zstandard

    def made(data: bytes):
        # bytes that train_dictionary made begin with a magic number; others are used as they are
        held = zstandard.ZstdCompressionDict(data)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    return made(model.good), made(model.bad)


def measures(model: Model, text: str) -> tuple[float, float]:
    """The normalised difference of sizes (higher: more like good text) and the log of the smaller share."""
    data = text.encode()
    if not data:
        return 0.0, 0.0
    good, bad = _compressors(model)
    a = b = 0
    for start in range(0, len(data), BLOCK):
        block = data[start : start + BLOCK]
        a += len(good(block))
        b += len(bad(block))
    return (b - a) / max(a, b), float(np.log(min(a, b) / len(data)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labels: DataFrame, usable: Column) -> list:
    """(text, label, part) of the rows to learn from; part 0 is for dictionaries, 1 for the calibration.

    Rows are taken in the order of a hash of doc_id, so the sample is the same each time.
    """
    known = labels.filter(usable & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).filter((F.octet_length("text") <= LONGEST) & (F.octet_length("text") > 0))
    drawn = known.withColumns({"part": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).cast("int"), "draw": F.xxhash64("doc_id")})
    few = []
    for label in (0, 1):
        for part in (0, 1):
            few.append(drawn.filter((F.col("label") == label) & (F.col("part") == part)).orderBy("draw", "doc_id").limit(SAMPLE))
    chosen = few[0].unionByName(few[1]).unionByName(few[2]).unionByName(few[3])
    joined = texts.join(F.broadcast(chosen), "doc_id").orderBy("draw", "doc_id", "text").limit(4 * SAMPLE)
    shares = known.groupBy("label").agg(F.count("*").alias("n"))
    return joined.select("text", "label", "part").collect(), {r["label"]: r["n"] for r in shares.collect()}


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model | float:
    """A model from the labelled rows for which ``usable`` holds, or a constant score."""
    rows, shares = sample(docs, labels, usable)
    prior = shares.get(1, 0) / max(1, sum(shares.values())) if shares else 0.5
    by = {(label, part): [r["text"] for r in rows if (r["label"], r["part"]) == (label, part)] for label in (0, 1) for part in (0, 1)}
    if not all(by.values()):
        return prior
    draft = Model(_dictionary([t.encode() for t in by[1, 0]]), _dictionary([t.encode() for t in by[0, 0]]), (0.0, 0.0, 0.0))
    x = np.array([(1.0, *measures(draft, t)) for label in (0, 1) for t in by[label, 1]])
    y = np.repeat([0.0, 1.0], [len(by[0, 1]), len(by[1, 1])])
    constant, difference, share = _logistic(x, y)
    # the sample holds the labels in other shares than the labelled rows do
    constant += float(np.log(prior / (1 - prior)) - np.log(len(by[1, 1]) / len(by[0, 1])))
    return Model(draft.good, draft.bad, (constant, difference, share))


def score(text: Column, model: Model | float) -> Column:
    """The score of each text, 0 to 1, higher for label 1."""
    if not isinstance(model, Model):
        return F.lit(float(model))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, b, c = model.weights
        for texts in batches:
            found = np.array([measures(model, t) for t in texts]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(a + b * found[:, 0] + c * found[:, 1], -30, 30))))

    return of(text)


def classified(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """``docs`` with score and predicted (1 where the score is 0.5 or more); columns of these names are replaced."""
    model = fit(docs, labels, usable)
    scored = docs.withColumn("score", score(text_or_empty("text"), model))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

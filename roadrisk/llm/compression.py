"""Quality of texts by compression against dictionaries of good and bad text.

Four zstandard dictionaries are built: from good and from bad labelled text, each once from the
text itself and once from its outline (runs of letters and digits written as one sign, so that
layout and punctuation stand out in every language). A text is compressed with each; the
differences of the sizes, divided by its length, are calibrated to a probability by logistic
regression.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.llm.tables import remainder

SAMPLE_DOCS = 3000             #: labelled documents a model is fitted on, at most
DICTIONARY_BYTES = 1 << 16
TRAINING_BYTES = 6 << 20       #: text of one label a model is fitted on, at most
LONGEST_TEXT = TRAINING_BYTES // 8  #: longer labelled texts do not take part in the fit; they are scored like any other
LEVEL = 3
THRESHOLD = 0.3

_SIGN = bytearray(range(256))
for _c in range(256):
    if chr(_c).isdigit() and _c < 128:
        _SIGN[_c] = ord("0")
    elif _c >= 128 or 97 <= _c <= 122:
        _SIGN[_c] = ord("a")
    elif 65 <= _c <= 90:
        _SIGN[_c] = ord("A")
_RUNS = re.compile(rb"a+|A{2,}|0+")
_SHORT = {ord("a"): b"a", ord("A"): b"AA", ord("0"): b"0"}


def outline(text: bytes) -> bytes:
    return _RUNS.sub(lambda m: _SHORT[m[0][0]], text.translate(bytes(_SIGN)))


@dataclass
class Model:
    dictionaries: list[bytes] | None  # good, bad, good outlines, bad outlines; None: a constant score
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples to choose from: take them as they are
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.dictionaries is not None:
            self.packers = [
                zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
                if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False) for d in model.dictionaries]

    def features(self, texts) -> np.ndarray:
        rows = []
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass")
            sketch = outline(raw)
            good, bad = (len(p.compress(raw)) for p in self.packers[:2])
            good2, bad2 = (len(p.compress(sketch)) for p in self.packers[2:])
            n, m = len(raw) + 1, len(sketch) + 1
            rows.append(((good - bad) / n, (good - bad) / (good + bad), good / n, bad / n,
                         (good2 - bad2) / m, (good2 - bad2) / (good2 + bad2), good2 / m, bad2 / m, np.log(n)))
        return np.array(rows).reshape(len(rows), 9)

    def score(self, texts) -> np.ndarray:
        m = self.model
        if m.dictionaries is None:
            return np.full(len(texts), m.weights[0])
        z = (self.features(texts) - m.mean) / m.spread
        return 1 / (1 + np.exp(-np.clip(z @ m.weights[:-1] + m.weights[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, quality 0 or 1) joined to ``docs`` (doc_id,
    text): at most ``sample_docs`` documents and TRAINING_BYTES of each label, whole texts, chosen
    by the hash of the id. Other labels, NULL ids, NULL texts and texts of over LONGEST_TEXT bytes are
    left out of the fit; repeated rows count as often as they stand. With one label only, or none, every text scores that label (or 0.5)."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    sizes = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(None, np.zeros(1), np.ones(1), np.array([float(next(iter(sizes), 0.5))]))
    each = sample_docs // 2
    place = (F.xxhash64("doc_id", F.lit(3)) / F.lit(2.0**64)) + 0.5  # uniform in 0..1
    share = F.when(F.col("quality") == 1, F.lit(min(1.0, each / sizes[1]))).otherwise(F.lit(min(1.0, each / sizes[0])))
    chosen = marks.where(place <= share).limit(2 * sample_docs)  # its size is bounded, so it may be broadcast
    text = F.col("text").isNotNull() & (F.octet_length("text") <= LONGEST_TEXT)
    rows = docs.select("doc_id", "text").where(text).join(F.broadcast(chosen), "doc_id")
    order = F.xxhash64("doc_id", F.lit(4))
    size = F.octet_length("text").cast("long")
    upto = F.sum(size).over(Window.partitionBy("quality").orderBy(order, "doc_id", "text"))
    got = rows.withColumn("_upto", upto).where(F.col("_upto") <= TRAINING_BYTES).select("doc_id", "text", "quality").collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    raw = [r["text"].encode("utf-8", "surrogatepass") for r in got]
    y = np.array([r["quality"] for r in got], float)
    if len(set(y)) < 2:
        return Model(None, np.zeros(1), np.ones(1), np.array([float(y[0]) if len(y) else 0.5]))
    # dictionaries see half of the sample, the calibration the other half, so that it stays honest
    half = np.arange(len(got)) % 2 == 0
    if min(((y == q) & h).sum() for q in (0, 1) for h in (half, ~half)) < 8:
        half[:] = True
    parts = [[t for t, q, h in zip(raw, y, half) if q == want and h] for want in (1, 0)]
    dictionaries = [*map(_dictionary, parts), *(_dictionary([outline(t) for t in p]) for p in parts)]
    model = Model(dictionaries, np.zeros(9), np.ones(9), np.zeros(10))
    rest = ~half if not half.all() else half
    x, y = Scorer(model).features([r["text"] for r, h in zip(got, rest) if h]), y[rest]
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    weight *= len(y) / weight.sum()  # the sample is balanced; the labels are not
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.spread, y, weight)
    return model


def with_quality(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """Add the probability that the text is of good quality; NULL texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four dictionaries of fixed size

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()), dtype="float64")

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col("text")))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 5) != 0)

"""Toxicity of texts by a logistic classifier that is regularised by counterfactuals.

Features are the words of a text and their first four and five letters, present or not; those that
tell the labels apart best are kept. Labelled sentences that name a group of people are copied with
the group's name swapped for the other names of its kind and for a neutral word, and the fit
penalises the squared change of the score between copy and original. What only follows who is
mentioned thereby loses its weight, and neutral mentions are no longer taken for insults.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.llm.tables import remainder, saved

SAMPLE_DOCS = 6000      #: labelled documents a model is fitted on, at most
FEATURES = 1024         #: features a model keeps, at most
LEAST_Z = 4.5           #: how far apart the labels' shares of a feature must be, in standard errors
LEAST_DOCS = 3
RIDGE = 0.02
SWAP_WEIGHT = 100.0     #: weight of the mean squared change of the score under swaps, in documents
THRESHOLD = 0.7
PIECE = 1 << 20

#: Names of groups of people by kind, which may stand for each other in a sentence; a parameter.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf"), ("old", "young"),
)
NEUTRAL = "people"

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str | None) -> set[str]:
    """Distinct runs of letters in lower case."""
    if not text:
        return set()
    if len(text) <= PIECE:
        return set(_WORD.findall(text.lower()))
    return {m[0].lower() for m in _WORD.finditer(text)}


def features(found: Iterable[str]) -> set[str]:
    """``=word``, and ``4`` or ``5`` and the first letters of longer words."""
    out = set()
    for w in found:
        out.add("=" + w)
        if len(w) > 4:
            out.add("4" + w[:4])
            if len(w) > 5:
                out.add("5" + w[:5])
    return out


def swaps(text: str | None, kinds: tuple[tuple[str, ...], ...] = IDENTITIES) -> Iterator[tuple[set[str], set[str]]]:
    """Words of each sentence that names a group, and the same with the name swapped."""
    others = {name: (*(o for o in kind if o != name), NEUTRAL) for kind in kinds for name in kind}
    for sentence in _SENTENCE.split(text or ""):
        own = words(sentence)
        for name in sorted(own & others.keys()):
            for other in others[name]:
                yield own, (own - {name}) | {other}


@dataclass
class Model:
    """``weights`` by feature; a text's score is the logistic of their sum and ``bias``. Without two
    labels to learn from there are no weights, and ``constant`` is every text's score."""

    weights: dict[str, float]
    bias: float
    constant: float | None = None

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        w = self.weights
        total = self.bias + sum(sorted(w[f] for f in features(words(text)) if f in w))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, changes: np.ndarray, times: np.ndarray,
          ridge: float = RIDGE, swap_weight: float = SWAP_WEIGHT) -> np.ndarray:
    """Weights and, last, the bias: Newton steps on the weighted log loss, the ridge, and
    ``swap_weight`` times the mean over all swaps of the squared change of the score."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    fixed = ridge * np.eye(x.shape[1])
    fixed[-1, -1] = 1e-6
    if len(changes):
        d = np.column_stack([changes, np.zeros(len(changes))]).astype(np.float64)
        fixed += swap_weight * (d * (times / times.sum())[:, None]).T @ d
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + w @ fixed @ w / 2)

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + fixed, x.T @ (weight * (y - p)) - fixed @ w)
        size, then = 1.0, None
        while size > 1e-6 and (then := loss(w + size * step)) > now:
            size /= 2
        if then is None or now - then < 1e-9 * max(1.0, now):
            break
        w, now = w + size * step, then
    return w


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> tuple[DataFrame, dict[int, int]]:
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = (F.xxhash64("doc_id", F.lit(11)) / F.lit(2.0**64)) + 0.5  # uniform in 0..1
    each = sample_docs / 2
    share = F.when(F.col("y") == 1, F.lit(min(1.0, each / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, each / sizes.get(0, 1))))
    chosen = marks.where(place <= share).limit(sample_docs + sample_docs // 4)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return saved(rows.select("text", "y").repartition(16), "toxicity-sample"), sizes


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, kinds: tuple[tuple[str, ...], ...] = IDENTITIES,
        swap_weight: float = SWAP_WEIGHT) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic 0 or 1) joined to ``docs`` (doc_id, text):
    about ``sample_docs`` whole texts, half of each label where there are so many, chosen by the hash
    of the id. Other labels, NULL ids and NULL texts are left out; repeated rows count as often as
    they stand. With one label only, or none, every text scores that label (or 0.5)."""
    rows, sizes = _sample(docs, labels, sample_docs)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model({}, 0.0, float(next(iter(n), 0.5)))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                f = sorted(features(words(text)))
                yield pd.DataFrame({"f": f, "y": y})

    one, all_docs = F.sum("y"), F.count(F.lit(1))
    both = n[0] + n[1]
    # how far the shares of the two labels lie apart, over the standard error were they the same
    spread = F.sqrt(F.col("k") / both * (1 - F.col("k") / both) * (1 / n[0] + 1 / n[1]))
    z = (F.col("k1") / n[1] - (F.col("k") - F.col("k1")) / n[0]) / spread
    counted = rows.mapInPandas(listed, "f string, y int").groupBy("f").agg(one.alias("k1"), all_docs.alias("k"))
    best = counted.where((F.col("k") >= LEAST_DOCS) & (F.col("k") < both)).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    names = sorted(r["f"] for r in best.orderBy(F.desc("z"), "f").limit(FEATURES).collect())
    place = {f: i for i, f in enumerate(names)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(place[f] for f in features(words(t)) if f in place) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "at": found})

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                out = []
                for own, other in swaps(text, kinds):
                    a, b = features(own), features(other)
                    gone = sorted(place[f] for f in a - b if f in place)
                    new = sorted(place[f] for f in b - a if f in place)
                    if gone or new:
                        out.append((gone, new))
                if out:
                    yield pd.DataFrame(out, columns=["gone", "new"])

    given = rows.mapInPandas(placed, "y int, at array<int>").collect()
    given.sort(key=lambda r: (r["y"], r["at"]))
    # a change is a set of features of two names: there are no more of them than pairs of names, times
    # the ways in which other words of the sentence hold their first letters
    moved = rows.mapInPandas(changed, "gone array<int>, new array<int>").groupBy("gone", "new").agg(F.count(F.lit(1)).alias("n")).collect()
    moved.sort(key=lambda r: (r["gone"], r["new"]))
    x = np.zeros((len(given), len(names)), np.float32)
    for i, r in enumerate(given):
        x[i, r["at"]] = 1
    d = np.zeros((len(moved), len(names)), np.float32)
    for i, r in enumerate(moved):
        d[i, r["gone"]] -= 1
        d[i, r["new"]] += 1
    y = np.array([r["y"] for r in given], float)
    weight = np.where(y == 1, sizes[1] / n[1], sizes[0] / n[0])
    weight *= len(y) / weight.sum()  # the sample is balanced; the labels are not
    w = solve(x, y, weight, d, np.array([r["n"] for r in moved], float), swap_weight=swap_weight)
    return Model(dict(zip(names, w[:-1].tolist())), float(w[-1]))


def with_toxicity(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """Add the probability that the text is toxic as column ``name`` (replaced where it is there).
    NULL texts count as empty; whole texts are read, whatever their length."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    return docs.withColumn(name, F.pandas_udf(score, "double")(F.col("text")))


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 3) != 1)

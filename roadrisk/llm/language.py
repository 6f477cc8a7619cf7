"""Language identification by error-correcting output codes.

Every learned language has a codeword of -1 and +1; a linear classifier over hashed byte
trigrams predicts each bit, and the language whose codeword has the least weighted loss wins.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.llm.tables import remainder
from roadrisk.llm.words import slices, text_bytes

FEATURES = 1 << 13
SAMPLE_DOCS = 1600  #: most documents a model is fitted on, over all languages
SLICE_BYTES = 1 << 20
AMBIGUOUS = 0.6  #: a score below this flags the answer as ambiguous
UNDETERMINED = "und"

# letters keep their (lower) case; other ASCII bytes count as one space
_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits, -1 or +1
    weights: np.ndarray   # features x bits
    bias: np.ndarray
    trust: np.ndarray     # weight of each bit's loss


def trigram_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature slot at each byte position, and where the trigrams of each text begin and end."""
    raw, offs = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    b = _CLASS[raw]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - 13)).astype(np.int64), offs[:-1], np.maximum(offs[1:] - 2, offs[:-1])


def segment_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each pair; zero for an empty range. Ranges ascend."""
    out = np.zeros((len(start), *values.shape[1:]), np.float64)
    full = start < end
    if full.any():
        cuts = np.stack([start[full], end[full]], 1).ravel()
        last = cuts[-1] == len(values)
        sums = np.add.reduceat(values, cuts[:-1] if last else cuts, axis=0, dtype=np.float64)
        out[full] = sums[::2]
    return out


def codewords(n: int) -> np.ndarray:
    """Exhaustive code up to six languages, else distinct random columns from a fixed seed."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        cols = [[1 if (c >> r) & 1 else -1 for r in range(n - 1)] + [1] for c in range(bits)]
        return np.array(cols, np.float64).T.reshape(n, bits)
    rng, bits = np.random.default_rng(7), 10 * math.ceil(math.log2(n))
    while True:
        code = rng.choice([-1.0, 1.0], (n, bits))
        rows_differ = (code[:, None] != code[None]).sum(2) + np.eye(n) * bits
        if rows_differ.min() >= bits // 4 and (np.abs(code.sum(0)) < n).all():
            return code


def _histograms(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            slot, a, b = trigram_slots(part.column("text"))
            out = []
            for x, y in zip(a, b):
                at, n = np.unique(slot[x:y], return_counts=True)
                out.append(np.stack([at, n]).astype(np.int32).tobytes())
            yield pa.record_batch([part.column("lang"), pa.array(out, pa.binary())], ["lang", "grams"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on a bounded sample of (doc_id, text, lang): at most ``sample_docs`` documents, spread
    evenly over the languages and chosen by the hash of their ids. Rows with NULL text, NULL lang
    or an empty text are left out. A table without such rows gives a model without languages."""
    df = labelled.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1), np.ones(1))
    each = max(1, sample_docs // len(langs))
    place = (F.xxhash64("doc_id", F.lit(10)) / F.lit(2.0**64)) + 0.5  # uniform in 0..1
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, each / sizes[k]))])
    rows = (
        df.where(place <= share[F.col("lang")]).select("lang", "text").limit(2 * sample_docs)
        .mapInArrow(_histograms, "lang string, grams binary").collect()
    )
    rows.sort(key=lambda r: (r["lang"], r["grams"]))
    taken: dict[str, int] = {}
    x, y = [], []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= each:
            at, n = np.frombuffer(r["grams"], np.int32).reshape(2, -1)
            v = np.zeros(FEATURES, np.float32)
            v[at] = n / max(1, n.sum())
            x.append(v)
            y.append(langs.index(r["lang"]))
    langs_seen = sorted({langs[i] for i in y})
    y = np.array([langs_seen.index(langs[i]) for i in y])
    code = codewords(len(langs_seen))
    x = np.array(x)
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    z = x * scale
    target = code[y]
    # ridge regression in its dual form: one small solve for all bits
    gram = (z @ z.T).astype(np.float64) + 1.0
    ridge = 1e-3 * np.trace(gram) / len(gram)
    alpha = np.linalg.solve(gram + ridge * np.eye(len(gram)), target)
    fitted = gram @ alpha
    wrong = np.clip((np.sign(fitted) != target).mean(0), 0.01, 0.49)
    return Model(langs_seen, code, (scale[:, None] * (z.T @ alpha.astype(np.float32))).astype(np.float32),
                 alpha.sum(0), np.log((1 - wrong) / wrong))


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the codeword of least weighted loss, and its share of exp(-loss)."""
    loss = np.log1p(np.exp(-3.0 * model.code[None] * margins[:, None, :])) @ model.trust / model.trust.sum()
    p = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return best, p[np.arange(len(p)), best]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` and ``lang_ambiguous`` to ``docs`` (a column ``text``);
    columns of these names are replaced.

    NULL texts, texts without a letter, and all texts under a model without languages give
    ``und``, score 0, not ambiguous. Ties take the first language in code point order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits numbers, fixed

    def label(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for texts in batches:
            out = []
            for part in slices(pa.record_batch([pa.Array.from_pandas(texts, type=pa.string())], ["text"]), "text", SLICE_BYTES):
                t = part.column("text")
                slot, a, b = trigram_slots(t)
                margins = segment_sums(m.weights[slot], a, b) / np.maximum(b - a, 1)[:, None] + m.bias
                if m.languages:
                    best, score = decode(m, margins)
                else:
                    best, score = np.zeros(len(t), int), np.zeros(len(t))
                lettered = pc.fill_null(pc.match_substring_regex(t, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best = np.where(lettered, best, len(m.languages))
                score = np.where(best == len(m.languages), 0.0, score)
                out.append((names[best], score, (score < AMBIGUOUS) & (best < len(m.languages))))
            if out:
                yield pd.DataFrame({k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("p", "s", "a"))})
            else:
                yield pd.DataFrame({"p": pd.Series([], dtype=object), "s": pd.Series([], dtype=float), "a": pd.Series([], dtype=bool)})

    def series(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from label(batches)

    answer = F.pandas_udf(series, "p string, s double, a boolean")(F.col("text"))
    return (
        docs.withColumn("_language", answer)
        .withColumns({"lang_pred": F.col("_language.p"), "lang_score": F.col("_language.s"), "lang_ambiguous": F.col("_language.a")})
        .drop("_language")
    )


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 4) != 2)

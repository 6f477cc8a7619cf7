import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadrisk.llm import resample
from roadrisk.llm.queries import QUERIES
from roadrisk.llm.tables import saved, table

FOLDER = "/root/testdata/sf0.001"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, buckets=10000):
    have, want = Counter(), Counter()
    for out, texts in ((have, [t for _, t in docs]), (want, target)):
        for t in texts:
            out.update(zlib.crc32(f.encode()) % buckets for f in features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for n, r in enumerate(fit[:25 * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_whole_table(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]
    got = rows_of(QUERIES["op13_resample"](spark, FOLDER))
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 20


def test_odd_rows(spark, odd, no_docs):
    long_words = [(20, "x" * 200 + " " + "é" * 90 + " " + " ".join(f"w{i}" for i in range(30)))] * 3
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame(long_words, "doc_id bigint, text string"))
    target = odd.select("text", "source")
    got = resample.resample(more.selectExpr("*", "'x' AS rank", "'y' AS weight", "1 AS n"), target)
    texts = [tuple(r) for r in more.collect()]
    assert rows_of(got) == brute(texts, [r["text"] for r in target.collect()])
    assert resample.resample(no_docs, target).count() == 0
    assert rows_of(resample.resample(more, no_docs)) == brute(texts, [])
    assert all(r["rank"] is None for r in resample.resample(odd.where("doc_id < 5"), target).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ0é東 _!\n" + "\U0001f600", max_size=300), max_size=6))
def test_buckets(texts):
    one, first, two, pairs = resample.feature_buckets(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        want = [zlib.crc32(f.encode()) % 10000 for f in features(t)[1]]
        assert [*one[first[i]:first[i + 1]], *two[pairs[i]:pairs[i + 1]]] == want


@pytest.mark.parametrize("k", [0, 1, 2, 57, 399, 400, 401])
def test_kth_key(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(i) if i % 7 else None, int(s)) for i, s in zip(rng.integers(0, 90, 400), rng.integers(-3, 3, 400))]
    keyed = resample.with_key(saved(spark.createDataFrame(rows, "doc_id bigint, score bigint"), "keys"))
    want = sorted(tuple(r) for r in keyed.select("_a", "_b", "_c", "_row").collect())
    for pivots in (1, 5) if k in (2, 57) else (63,):
        assert resample.kth_key(keyed, k, pivots) == (want[k - 1] if 1 <= k <= 400 else None)

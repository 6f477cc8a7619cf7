import math
from collections import Counter

import numpy as np
import pytest

from roadrisk.llm import whitening
from roadrisk.llm.queries import QUERIES
from roadrisk.llm.tables import table

FOLDER = "/root/testdata/sf0.01"


def brute(rows, weight="one", components=4):
    """By id: (n, deviation, whitened, explained), from plain sums over the distinct vectors."""
    whole = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows
             if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    times = Counter(x for _, x in whole)
    fit = list(times.elements()) if weight == "count" else list(times)
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    c = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)),
                (np.array(x) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)) for i, x in whole}


def agrees(got, want):
    """Signs of a component may differ, for all rows alike."""
    signs = {}
    for i, k, n, dev, w, explained in got:
        b = want[i]
        assert (n, dev) == b[:2] and explained == pytest.approx(b[3][k - 1], rel=1e-9)
        if abs(b[2][k - 1]) > 1e-3:
            assert signs.setdefault(k, math.copysign(1, w * b[2][k - 1])) == math.copysign(1, w * b[2][k - 1])
        assert abs(w) == pytest.approx(abs(b[2][k - 1]), abs=1e-7)
    assert Counter((g[0], g[1]) for g in got) == Counter((i, k + 1) for i in want for k in range(len(next(iter(want.values()))[3])))


def flat(df):
    return [(r["vec_id"], k + 1, r["w"]["n"], r["w"]["deviation"], v, e) for r in df.selectExpr("vec_id", "whitening AS w").collect()
            for k, (v, e) in enumerate(zip(r["w"]["whitened"], r["w"]["explained"]))]


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    got = QUERIES["op12_whitening"](spark, FOLDER).collect()
    agrees([(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got], brute(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8


@pytest.mark.parametrize("weight", ["one", "count"])
def test_repeated_and_odd_vectors(spark, weight):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)).round(3)
    rows = [(i, [float(v) for v in base[i % 60 if i < 90 else 5]]) for i in range(240)]  # vector 5 holds most rows
    odd = [(1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [-0.0] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS key", "1 AS x", "2 AS n_rows", "'w' AS whitening", "3 AS dim")
    got = whitening.whiten(df, weight=weight)
    assert got.count() == 242 and {"key", "x", "n_rows", "dim"} <= set(got.columns)
    agrees(flat(got), brute(rows + odd, weight))
    assert whitening.whiten(df.repartition(7), weight=weight).count() == 242


def test_lengths_and_sizes(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [4.0, 7.0]), (4, []), (5, [3.0]), (6, [3.0]), (7, [1e300, -1e300, 0.0]), (8, [1e12, 5.0, 0.0]), (9, [0.0, 1.0, 0.0])]
    got = {r["vec_id"]: r["whitening"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 9
    assert [got[i]["n"] for i in (1, 2, 3)] == [3] * 3 and len(got[1]["whitened"]) == 2 and got[1]["identity_error"] < 1e-9
    assert got[4]["n"] is None and got[4]["whitened"] == [] and got[5]["whitened"] == [] and got[5]["n"] == 1 and got[5]["deviation"] == 0
    assert got[7]["deviation"] is None and got[9]["n"] == 3
    empty = whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.count() == 0 and "whitening" in empty.columns


def test_exact_deviation():
    rng = np.random.default_rng(1)
    for top in (10, 10**6, 10**9):
        x = rng.integers(-top, top, (5, 4))
        sums = [int(v) * 3 for v in rng.integers(-top, top, 4)]
        m = whitening.Model(1000, sums, np.eye(4), np.ones(4), 4.0)
        want = [sum((1000 * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening.deviation(m, x) == [v if v < 1 << 63 else None for v in want]

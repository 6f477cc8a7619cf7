import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from roadrisk.llm import decontaminate, mixing
from roadrisk.llm.tables import table
from tests.llm.conftest import SMALL


def normal(text):
    return " ".join((text or "").lower().split()).encode()


def least_edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[at] = rng.choice("qxz")
        elif kind == 1:
            t.insert(at, rng.choice("qxz"))
        else:
            del t[at]
    return "".join(t)


def test_search_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(rng.randrange(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 30)))) for k in range(12)] + [(50, "tiny"), (51, None), (52, ""), (53, "eleven byte")]
    docs = []
    for k in range(60):
        base = " ".join(word() for _ in range(60))
        item = items[k % 12][1]
        n = k % 9
        put = edited(rng, item, n) if k < 50 else ""
        cut = rng.randrange(len(base))
        docs.append((k, base[:cut] + " " + put.upper() + "\n " + base[cut:] if k % 2 else put + " " + base if k % 4 else base + " " + put))
    docs += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, "an ELEVEN  byte text")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {}
    for r in decontaminate.search(d, b).collect():
        key = (r["doc_id"], r["item_id"])
        got[key] = min(got.get(key, 99), r["edits"])
    want = {}
    x = decontaminate.index_of(items)
    budget = dict(zip(x.ids, x.edits))
    for i, text in docs:
        for k, item in items:
            if k in budget:
                e = least_edits(normal(item), normal(text))
                if e <= budget[k]:
                    want[i, k] = e
    assert got == want and len(want) > 30
    assert decontaminate.search(d, b).where("doc_id = 102 AND item_id = 3").count() == 2
    counted = decontaminate.with_match_count(d, b, "n").collect()
    assert sorted({(r["doc_id"]) for r in counted if r["n"]}) == sorted({i for i, _ in want})


def test_item_blocks(spark):
    items = table(spark, SMALL, "benchmark")
    blocks = list(decontaminate.item_blocks(items, 4000))
    assert len(blocks) > 1 and sorted(i for b in blocks for i, _ in b) == sorted(r["item_id"] for r in items.collect())


def test_empty_search(spark, odd, no_docs):
    items = table(spark, SMALL, "benchmark")
    assert decontaminate.search(no_docs, items).count() == 0
    assert decontaminate.search(odd, items.limit(0)).count() == 0
    assert decontaminate.with_match_count(odd, items, "n").count() == odd.count()


def brute_targets(sizes, weights, times=3):
    total, open_, target = Fraction(sum(sizes)), set(range(len(sizes))), {}
    left = total
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > times * sizes[i]]
        if not over:
            return {**target, **share}
        for i in over:
            target[i] = Fraction(times * sizes[i])
            left -= target[i]
            open_.discard(i)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for trial in range(8):
        n = rng.randrange(1, 9)
        sizes = [rng.choice([0, 1, 7, 100, 5000, 100000]) for _ in range(n)]
        rows = [(f"s{k}" if k < n - 1 or trial % 2 else None, s) for k, s in enumerate(sizes)]
        src = mixing.weighted_sources(spark.createDataFrame(rows, "source string, size bigint"))
        got = {r["source_no"]: r["target"] for r in mixing.source_targets(src).collect()}
        want = brute_targets(sizes, [(5, 2, 1)[k % 3] for k in range(n)])
        assert all(abs(got[k] - float(want[k])) < 1e-6 * max(1, sum(sizes)) for k in range(n)), (sizes, got, want)


def test_mix_takes_what_it_should(spark, odd, no_docs):
    for docs in (table(spark, SMALL, "documents"), odd):
        got = mixing.mix(docs, block_words=64).collect()
        assert len(got) == docs.count()
        by = {}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            t = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
            t[0] += r["taken"]
            t[1] += r["size"]
        for taken, size, target, source_size in by.values():
            assert abs(taken - target) <= 1 and size == source_size
    again = sorted(map(str, mixing.mix(table(spark, SMALL, "documents"), block_words=64).collect()))
    assert again == sorted(map(str, mixing.mix(table(spark, SMALL, "documents").repartition(7), block_words=64).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_schedule_is_even(spark):
    src = spark.createDataFrame([(0, 90000, 60000), (1, 50000, 30000), (2, 4000, 10000)], "source_no int, source_size bigint, target_words bigint")
    rows = mixing.schedule(spark, src, 50).orderBy("slot").collect()
    words = np.zeros(3)
    for r in rows:
        words[r["source_no"]] += r["words"]
    assert words.tolist() == [60000, 30000, 10000]
    sources = np.array([r["source_no"] for r in rows])
    for k, share in enumerate((0.6, 0.3, 0.1)):
        upto = np.cumsum(sources == k)
        assert np.abs(upto - share * np.arange(1, len(rows) + 1)).max() < 8
    point = spark.range(1, 2000).select(mixing.golden_point(F.col("id")).alias("p")).toPandas()["p"].values
    assert np.abs(point - (np.arange(1, 2000) * 0.6180339887498949) % 1).max() < 1e-5


def test_normalised():
    data, at = decontaminate.normalised(pa.array(["A  b\n", None, "Ü x"]))
    assert [bytes(data[a:b]).strip() for a, b in zip(at[:-1], at[1:])] == [b"a b", b"", "ü x".encode()]


def test_index_is_not_padded_to_the_longest_item():
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    items = [(i, "".join(rng.choice(letters, n))) for i, n in enumerate([300] * 200 + [6000])]
    x = decontaminate.index_of(items)
    assert x.text.nbytes <= 2 * sum(len(t) for _, t in items)
    texts = ["before " + items[i][1][:100] + "#" + items[i][1][101:] + " after" for i in (3, 200, 150)]
    row, item, edits, _ = decontaminate.matches(x, pa.array(texts))
    assert list(zip(row, x.ids[item], edits)) == [(0, 3, 1), (1, 200, 1), (2, 150, 1)]


def plain_candidates(x, data, at):
    """All pairs of equal q-grams, listed one by one and counted in overlapping bands."""
    h = decontaminate.gram_hashes(data)
    counts = {}
    for r, (a, b) in enumerate(zip(at[:-1], at[1:])):
        for p in range(a, b - decontaminate.Q + 1):
            g = np.searchsorted(x.grams, h[p])
            if g < len(x.grams) and x.grams[g] == h[p]:
                for to in range(x.first[g], x.first[g + 1]):
                    i = int(x.item[to])
                    k = (p - a - int(x.offset[to])) // int(x.band[i])
                    for low in (k, k - 1):
                        counts[r, i, low * int(x.band[i])] = counts.get((r, i, low * int(x.band[i])), 0) + 1
    return {key for key, n in counts.items() if n >= x.bound[key[1]]}


def test_runs_are_counted_as_their_pairs(monkeypatch):
    rng = random.Random(3)
    sign = lambda: rng.choice("-=.ab") * rng.choice([1, 3, 9, 20, 60])
    items = [(k, "".join(sign() for _ in range(6))) for k in range(6)] + [(7, "-" * 200), (8, "ab" * 40), (9, "x" + "-" * 30 + "y")]
    texts = ["".join(sign() for _ in range(20)) for _ in range(12)] + ["-" * 500, "ab" * 150, "", "x" + "-" * 31 + "y", "-" * 19]
    x = decontaminate.index_of(items)
    data, at = decontaminate.normalised(pa.array(texts))
    want = plain_candidates(x, data, at)
    for pairs, run in ((1 << 20, 16), (50, 16), (1 << 20, 9), (7, 1000)):
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        monkeypatch.setattr(decontaminate, "LONG_RUN", run)
        row, item, low = decontaminate._candidates(x, data, at)
        # shifts may move the borders of bands; a band here and one there of which each holds the other's pairs
        found = {(r, i, (v // int(x.band[i])) * int(x.band[i])) for r, i, v in zip(row.tolist(), item.tolist(), low.tolist())}
        assert {(r, i) for r, i, _ in found} == {(r, i) for r, i, _ in want}
        r2, i2, e2, _ = decontaminate.matches(x, pa.array(texts))
        best = {}
        for r, i, e in zip(r2.tolist(), i2.tolist(), e2.tolist()):
            best[r, i] = min(e, best.get((r, i), 99))
        for r, t in enumerate(texts):
            for i, (_, own) in enumerate(items):
                e = least_edits(normal(own), normal(t))
                assert (best.get((r, i)) == e) if e <= x.edits[i] else ((r, i) not in best)


def test_pages_of_one_sign_stay_small():
    import tracemalloc

    x = decontaminate.index_of([(1, "-" * 200), (2, "=-" * 60)])
    tracemalloc.start()
    row, item, edits, _ = decontaminate.matches(x, pa.array(["-" * 2_000_000, "=-" * 20_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(row.tolist(), item.tolist())) == {(0, 0), (1, 1)} and peak < 600e6


def test_short_items_match_as_words(spark):
    items = [(1, "abcdefg"), (2, "ab"), (None, "AB"), (4, " "), (5, "a b"), (6, "é")]
    texts = [(1, "abcdefg"), (2, "xab ab\nabx"), (3, "A  B"), (None, "é"), (5, "aé"), (6, ""), (7, None), (7, "ab"), (7, "ab")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'x' AS item_id", "1 AS edits")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "2 AS doc_id")
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["edits"], r["end_byte"], r["item_bytes"]) for r in decontaminate.search(d, b).collect())
    assert got == sorted([("1", "1", 0, 7, 7), ("2", "2", 0, 6, 2), ("2", "None", 0, 6, 2), ("3", "5", 0, 3, 3), ("None", "6", 0, 2, 2),
                          *[("7", "2", 0, 2, 2), ("7", "None", 0, 2, 2)] * 2])


def test_odd_rows_and_items_together(spark, odd):
    items = spark.createDataFrame([(1, "same words in this text"), (1, "same words in this text"), (None, "no id here at all"), (3, None), (4, ""), (5, "?!"), (None, None)],
                                  "item_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.search(odd, items).collect())
    assert got == sorted([*[(i, "1") for i in ("6", "7", "7") for _ in (0, 1)], ("None", "None"), ("4", "5")])
    counted = decontaminate.with_match_count(odd, items, "source").collect()
    assert len(counted) == odd.count() and sum(r["source"] for r in counted) == len(got)

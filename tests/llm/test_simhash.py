import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadrisk.llm import simhash
from roadrisk.llm.components import components
from roadrisk.llm.tables import table
from tests.llm.conftest import SMALL


def brute_print(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_sets(codes, distance):
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= distance:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def clusters(rng, groups, size, spread):
    out = []
    for _ in range(groups):
        c = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(size):
            for b in rng.integers(0, 64, spread):
                c ^= 1 << int(b)
            out.append(c)
    return sorted(set(out))


def test_fingerprints(spark, odd):
    for docs in (odd, table(spark, SMALL, "documents")):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] is None or len(r["text"]) < 40000]
        got = simhash.fingerprints(docs.where("text IS NULL OR length(text) < 40000")).collect()
        assert sorted((str(r["doc_id"]), r["fp"]) for r in got) == sorted((str(i), signed(brute_print(t))) for i, t in texts)


def test_long_votes_in_pieces():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 300_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    bounds = np.array([0, 5, 5, 200_000, 299_999, 300_000])
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [int(sum(1 << b for b in range(64) if 2 * int(bits[x:y, b].sum()) > y - x)) for x, y in zip(bounds[:-1], bounds[1:])]
    assert simhash.shingle_votes(h, bounds).tolist() == want


def test_gray_rank(spark):
    codes = [0, 1, 2, 3, 5, 1 << 62, (1 << 63) - 1, -1, -(1 << 63)]
    got = spark.createDataFrame([(c,) for c in codes], "c bigint").select("c", simhash.gray_rank(F.col("c")).alias("g")).collect()
    for c, g in got:
        g &= (1 << 64) - 1
        assert g ^ (g >> 1) == c & ((1 << 64) - 1)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(3)
    codes = np.array(clusters(rng, 30, 20, 2), np.uint64)
    index = simhash.GrayIndex(codes)
    for distance in (0, 3, 9):
        q, m = index.within(codes[::7], distance)
        want = {(i, j) for i, c in enumerate(codes[::7]) for j, d in enumerate(codes) if bin(int(c) ^ int(d)).count("1") <= distance}
        assert set(zip(q.tolist(), m.tolist())) == want


def test_links_and_components(spark):
    rng = np.random.default_rng(5)
    # the last group makes one large upper node
    codes = clusters(rng, 25, 12, 2) + [int(c) for c in np.unique((np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 1 << 20, 400).astype(np.uint64))]
    codes = sorted(set(codes))
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp bigint")
    found = {r["node"]: r["root"] for r in components(simhash.links(df)).collect()}
    label = brute_sets(codes, 3)
    groups = {}
    for c, g in zip(codes, label):
        groups.setdefault(g, []).append(signed(c))
    for g in groups.values():
        assert {found.get(c, c) for c in g} == {min(g)}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 601), (601, 600)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 601: 600}


def test_near_duplicates(spark, odd, no_docs):
    for docs in (odd, table(spark, SMALL, "documents"), no_docs):
        rows = docs.select("doc_id", "text").collect()
        got = simhash.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        prints = [simhash.fingerprints(docs).collect()] if rows else [[]]
        codes = [r["fp"] & ((1 << 64) - 1) for r in prints[0]]
        distinct = sorted(set(codes))
        label = dict(zip(distinct, brute_sets(distinct, 3)))
        least = {}
        for r, c in zip(prints[0], codes):
            if r["doc_id"] is not None:
                least[label[c]] = min(least.get(label[c], r["doc_id"]), r["doc_id"])
        want = sorted((str(r["doc_id"]), r["fp"], str(least.get(label[c]))) for r, c in zip(prints[0], codes))
        assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in got) == want


def test_similar_rows(spark):
    rng = np.random.default_rng(2)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 400)] for _ in range(40)]
    rows = []
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w)))
        near = list(w)
        for at in rng.choice(400, 4, replace=False):  # about 20 of 396 shingles change: similarity 0.9
            near[at] = "other"
        rows.append((10 * i + 1, " ".join(near)))
        far = list(w)
        for at in range(0, 400, 8):
            far[at] = f"x{at}"
        rows.append((10 * i + 2, " ".join(far)))
    docs = spark.createDataFrame(rows + [(9000, rows[0][1])], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["component"], r["keeper"]) for r in simhash.similar_rows(docs).collect()}
    assert sum(got[10 * i][0] == got[10 * i + 1][0] for i in range(40)) >= 38
    assert all(got[10 * i][0] != got[10 * i + 2][0] for i in range(40))
    assert got[9000] == (got[0][0], False) and got[0][1]
    kept = {r["doc_id"] for r in simhash.without_copies(docs).collect()}
    assert {10 * i for i in range(40)} | {10 * i + 2 for i in range(40)} <= kept


def test_without_copies_keeps_one_row(spark, odd, no_docs):
    kept = simhash.without_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 9 in ids and 10 in ids
    twice = odd.where("doc_id = 7")
    assert [r["doc_id"] for r in simhash.without_copies(twice).collect()] == [7]
    assert simhash.without_copies(no_docs).count() == 0


def test_bitmaps_never_refuse_a_similar_pair():
    rng = np.random.default_rng(9)
    for n in (1, 3, 20, 400, 3000):
        for share in (0.0, 0.05, 0.1, 0.2):
            one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            other = one.copy()
            other[:int(share * len(one))] = rng.integers(0, 1 << 63, int(share * len(one)), dtype=np.uint64)
            other = np.unique(other)
            h, doc = np.concatenate([one, other]), np.repeat([0, 1], [len(one), len(other)])
            bits = simhash._parities(h, doc, 2)
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert bits.shape == (2, simhash.BITMAP_BITS // 64) and apart <= len(np.setxor1d(one, other))
            both = len(np.intersect1d(one, other))
            if both >= 0.8 * (len(one) + len(other) - both):
                assert simhash._near_bitmaps(np.array([0]), np.array([1]), np.array([len(one), len(other)]), bits, 0.8)[0]


def test_index_gives_the_first_pairs(spark):
    """The pairs of the stage's index join exactly what near fingerprints and bitmaps join, without a circle."""
    rng = np.random.default_rng(11)
    texts = []
    for n in (40, 900):
        for _ in range(30):
            w = [f"w{x}" for x in rng.integers(0, 3000, n)]
            texts += [w, [*w[:-1], "end"], w[: int(0.97 * n)]]
    family = [f"h{x}" for x in range(900)]
    texts += [[*family, f"y{k}"] for k in range(90)]  # over SMALL members of one upper node
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    levels = simhash._frequencies(docs, 5)
    sets = docs.withColumn("_text", F.xxhash64("text")).mapInArrow(
        lambda it: simhash._prefixes(it, 5, 0.8, levels),
        "doc_id bigint, text_hash bigint, cls bigint, n int, fp bigint, bits array<bigint>, prefix array<bigint>").dropDuplicates(["cls"]).cache()
    rows = sets.collect()
    place = {r["cls"]: i for i, r in enumerate(rows)}
    fp = np.array([r["fp"] for r in rows]).view(np.uint64)
    n, bits = np.array([r["n"] for r in rows]), np.array([r["bits"] for r in rows]).view(np.uint64)
    i, j = np.triu_indices(len(rows), 1)
    near = np.bitwise_count(fp[i] ^ fp[j]) <= 3
    near[near] = simhash._near_bitmaps(i[near], j[near], n, bits, 0.8)
    want = simhash._merge(np.arange(len(rows)), i[near], j[near])
    pairs = simhash._indexed(sets, 3, "cls", "n", "bits").mapInArrow(
        lambda it: simhash._index_pairs(it, 3, 0.8), "a bigint, b bigint").distinct().collect()
    a, b = np.array([[place[r["a"]], place[r["b"]]] for r in pairs]).T
    assert set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) <= set(zip(i[near].tolist(), j[near].tolist()))
    assert (simhash._merge(np.arange(len(rows)), a, b) == want).all() and (want != np.arange(len(rows))).sum() > 100
    assert len(pairs) <= 4 * len(rows) < near.sum()


@pytest.mark.parametrize("rows", [2048, 16])
def test_similar_rows_equal_brute_force(spark, monkeypatch, rows):
    """Pairs at 0.75 to 0.9, short texts, and a large family, whole and in blocks, against exact Jaccard."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
    rng = np.random.default_rng(5)
    texts = []
    for n in (5, 6, 8, 9, 12, 24, 60, 150, 300):
        for _ in range(12):
            w = [f"w{x}" for x in rng.integers(0, 3000, n)]
            texts.append(w)
            for share in (0.01, 0.02, 0.03):  # a changed word changes five shingles
                near = list(w)
                for at in rng.choice(n, max(1, int(n * share)), replace=False):
                    near[at] = f"x{rng.integers(0, 3000)}"
                texts.append(near)
            texts += [w + ["end"], w[: int(n * 0.9)], w[1:]]
    hot = [f"h{x}" for x in range(60)]
    for k in range(120):  # one family, of which each pair of members has 0.7 to 0.9 in common
        near = list(hot)
        near[int(rng.integers(0, 60))] = f"y{k}"
        texts.append(near)
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got: dict[int, list[int]] = {}
    for r in simhash.similar_rows(docs).collect():
        got.setdefault(r["component"], []).append(r["doc_id"])
    want: dict[int, list[int]] = {}
    for i in range(len(texts)):
        want.setdefault(root(i), []).append(i)
    assert sorted(sorted(x) for x in got.values()) == sorted(want.values())

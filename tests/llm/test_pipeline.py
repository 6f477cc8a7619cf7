import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from roadrisk.llm import decontaminate
from roadrisk.llm.tables import table
from tests.llm.conftest import SMALL


def test_stages_keep_columns_and_stand_odd_rows(spark, odd, no_docs):
    for docs in (odd, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * docs.count(), name
    assert len(corpus_pipeline.STAGES) == 5


def test_token_stage_of_odd_rows(spark, odd, no_docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(corpus_pipeline.token_stage(spark, odd, SMALL).collect(), key=lambda r: r["start"])
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd.collect())
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id IS NOT NULL").collect()}
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = whole.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert corpus_pipeline.token_stage(spark, no_docs, SMALL).count() == 0


def test_near_duplicate_stage_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(fold)) for _, t in rows]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    holders: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < i)
        near = [j for j, n in common.items() if 10 * n >= 8 * (len(s) + len(sets[j]) - n)] if s else [j for j in range(i) if not sets[j]]
        for j in near:
            a, b = sorted((root(i), root(j)))
            label[b] = a
    want = {rows[i][0] for i in range(len(rows)) if root(i) == i}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).select("doc_id").collect()}
    assert got == want and len(want) < len(rows)


def test_decisions(spark):
    docs = table(spark, SMALL, "documents")
    item = table(spark, SMALL, "benchmark").first()["text"]
    more = spark.createDataFrame([
        (90001, "12 34 !!", "en", "s", 8), (90002, "Clean words before " + item + " and after", "en", "s", 9),
        (90003, docs.first()["text"], "en", "s", 9)], docs.schema)
    rows = docs.unionByName(more)
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert 90001 not in ids(corpus_pipeline.language_stage(spark, rows, SMALL))
    kept = ids(corpus_pipeline.near_duplicate_stage(spark, rows, SMALL))
    assert 90003 not in kept and docs.first()["doc_id"] in kept
    clean = ids(corpus_pipeline.decontamination_stage(spark, rows, SMALL))
    assert 90002 not in clean and {90001, 90003} <= clean
    gone = ids(rows) - clean
    assert gone == {r["doc_id"] for r in decontaminate.search(rows, table(spark, SMALL, "benchmark")).collect()}


def test_run_equals_its_parts(spark):
    got = sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r["start"])
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert [r["doc_id"] for r in got] == [i for i, _ in rows]
    start = 0
    for r, (_, text) in zip(got, rows):
        ids = whole.encode(text, add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert docs.agg(F.count(F.lit(1))).first()[0] == len(got)

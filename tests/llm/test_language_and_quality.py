import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from roadrisk.llm import compression, language, rules
from roadrisk.llm.queries import QUERIES
from roadrisk.llm.tables import table

FOLDER = "/root/testdata/sf0.01"


def test_codewords_lie_apart():
    for n in (1, 2, 3, 4, 6, 9, 40):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        for i in range(n):
            for j in range(i):
                assert (code[i] != code[j]).sum() >= max(1, code.shape[1] // 8)


def test_decoding_mends_a_wrong_bit():
    code = language.codewords(4)
    m = language.Model(list("abcd"), code, None, None, np.ones(code.shape[1]))
    for k in range(4):
        for b in range(code.shape[1]):
            margins = code[k].copy()
            margins[b] *= -0.5
            assert language.decode(m, margins[None])[0][0] == k


def test_held_out_accuracy(spark):
    docs = table(spark, FOLDER, "documents")
    got = QUERIES["op10_language"](spark, FOLDER).join(docs, "doc_id")
    r = got.where("held_out AND length(text) > 200").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert r[0] > 0.95 and r[1] > 100
    for x in got.select("doc_id", "held_out").limit(50).collect():
        assert x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2)


def test_language_of_odd_rows(spark, odd, no_docs):
    model = language.fit(language.training_rows(table(spark, FOLDER, "documents")))
    got = language.identify(odd, model)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and by[4]["lang_score"] == 0
    assert all(0 <= r["lang_score"] <= 1 for r in got.collect())
    assert language.identify(no_docs, model).count() == 0
    nothing = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd, nothing).collect()} == {"und"}
    one = language.fit(odd.where("lang = 'en'"))
    assert one.languages == ["en"]


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op3_quality"](spark, FOLDER).join(table(spark, FOLDER, "labels"), "doc_id").where("held_out").collect()
    good, bad = [[r["predicted"] for r in got if r["quality"] == q] for q in (1, 0)]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_quality_of_odd_rows(spark, odd, no_docs):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = compression.fit(docs, compression.training_labels(labels))
    got = compression.with_quality(odd.select("doc_id", "text"), model).collect()
    assert len(got) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in got)
    assert compression.with_quality(no_docs, model).count() == 0
    same = compression.fit(docs, labels.where("quality = 1"))
    assert {r["quality_score"] for r in compression.with_quality(odd, same).collect()} == {1.0}
    none = compression.fit(no_docs, labels.limit(0))
    assert {r["quality_score"] for r in compression.with_quality(odd, none).collect()} == {0.5}
    few = compression.fit(docs, labels.where("doc_id < 60"))
    assert compression.with_quality(odd.select("doc_id", "text"), few).count() == odd.count()


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_measures(spark, odd, no_docs):
    more = spark.createDataFrame([(50, "a a a a"), (51, "a b c a b c x a b"), (52, "x\n\nx\n \nx"), (53, "a b c"), (54, "# * $ %&|<>")], "doc_id bigint, text string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for docs in (odd, more, table(spark, FOLDER, "documents").where("doc_id < 150")):
        texts = docs.select("doc_id", "text").collect()
        got = rules.filter_quality(docs).collect()
        assert sorted((str(r["doc_id"]), *(r[c] for c in cols)) for r in got) == sorted((str(i), *brute_rules(t)) for i, t in texts)
        assert all(r["kept"] == (r["rejected_by"] is None) and not (r["base_failed"] and r["kept"]) for r in got)
    assert rules.filter_quality(no_docs).count() == 0


def test_order_never_changes_the_verdict(spark):
    m = rules.measures(table(spark, FOLDER, "documents").where("doc_id < 300"))
    one = {r["doc_id"]: r["kept"] for r in rules.judge(m, rules.RULES).collect()}
    two = {r["doc_id"]: r["kept"] for r in rules.judge(m, rules.RULES[::-1]).collect()}
    assert one == two and 0 < sum(one.values()) < len(one)
    found = rules.ordered(rules.RULES, m)
    gain = [share / cost for _, cost, share in found]
    assert gain == sorted(gain, reverse=True)

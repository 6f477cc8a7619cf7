import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadrisk.llm import rangecoder, tokens
from roadrisk.llm.tables import new_folder, table
from roadrisk.llm.words import split
from tests.llm.conftest import ODD_ROWS, SMALL

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "a", " A b  C ", "x\ny\tz", "é  ü\n", "\n\n", "last", "the the", " ", "q"]


def test_words():
    w = split(pa.array(TEXTS))
    data = w.data.tobytes()
    want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in TEXTS]
    assert [data[a:b].decode() for a, b in zip(w.starts, w.ends)] == [x for ws in want for x in ws]
    assert w.counts.tolist() == [len(x) for x in want]
    codes, distinct = w.distinct()
    assert [distinct[int(c)].as_py().decode() for c in codes] == [x for ws in want for x in ws]


@pytest.mark.parametrize("n", [0, 1, 5, 2048, 2049, 13000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.zeros(n, int), np.full(n, 49407), np.resize(rng.integers(0, 300, 37), n), rng.zipf(1.3, n) % 49408):
        payload, crcs = rangecoder.encode(ids.astype(np.int32), 49408)
        assert (rangecoder.decode(payload, crcs, n, 49408) == ids).all()


def test_blocks_stand_alone_and_are_checked():
    ids = np.random.default_rng(1).integers(0, 500, 10000).astype(np.int32)
    payload, crcs = rangecoder.encode(ids, 49408)
    again, _ = rangecoder.encode(ids[2048:4096], 49408)
    assert again[0] == payload[1]
    spoilt = [payload[0][:40] + bytes([payload[0][40] ^ 1]) + payload[0][41:], *payload[1:]]
    with pytest.raises(ValueError, match="block 0"):
        rangecoder.decode(spoilt, crcs, len(ids), 49408)
    with pytest.raises(ValueError):
        rangecoder.encode(np.array([49408], np.int32), 49408)


def test_repeats_cost_little():
    ids = np.resize(np.random.default_rng(1).integers(0, 49408, 100), 20480).astype(np.int32)
    assert sum(map(len, rangecoder.encode(ids, 49408)[0])) * 8 / len(ids) < 2


def test_coder_holds_few_copies_of_the_ids():
    ids = np.resize(np.random.default_rng(4).integers(0, 49408, 65536), 1 << 20).astype(np.int32)
    tracemalloc.start()
    try:
        payload, crcs = rangecoder.encode(ids, 49408)
        encoding = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        rangecoder.decode(payload, crcs, len(ids), 49408)
        decoding = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert encoding < 4.4 * ids.nbytes and decoding < 5 * ids.nbytes


def test_ids_equal_whole_texts(spark):
    texts = [r["text"] for r in table(spark, SMALL, "documents").select("text").collect()]
    texts += [r[1] for r in ODD_ROWS] + ["it's we'll don't", "a b​c", "12 345 ab12", "ΟΔΟΣ Σ", "<|startoftext|>x <|endoftext|>", "<|ENDOFTEXT|>", "É×Ü÷é", "Ãµª ¼½x º", "a,b.C!!d ÀB's d'S 9é", "\u0178 ÿ ž İI ß ẞ", "a\u0301 é\u0301", "…x—y"]
    whole = Tokenizer.from_file(WORD_BPE)
    flat, n = tokens.WordEncoder(WORD_BPE).encode(pa.array(texts))
    cuts = np.cumsum(n)
    for t, end, size in zip(texts, cuts, n):
        assert flat[end - size:end].tolist() == whole.encode(t or "", add_special_tokens=False).ids + [2]


def test_files(spark, odd, no_docs):
    for docs in (odd, no_docs, table(spark, SMALL, "documents")):
        folder = new_folder(spark, "ids")
        tokens.write_ids(docs, WORD_BPE, folder)
        got = sorted(tokens.read_ids(spark, folder).collect(), key=lambda r: r["start"])
        checks = {r["start"]: r["ids_crc32"] for r in tokens.read_ids(spark, folder, digest=True).collect()}
        whole = Tokenizer.from_file(WORD_BPE)
        rows = sorted(((r[0], r[1]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        assert len(got) == len(rows)
        start = 0
        for r, (doc_id, text) in zip(got, rows):
            ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, start, len(ids), ids)
            assert checks[start] == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)


def test_segments_keep_order(spark, monkeypatch):
    monkeypatch.setattr(tokens, "LEAST_BYTES", 20000)
    folder = new_folder(spark, "ids")
    docs = table(spark, SMALL, "documents")
    tokens.write_ids(docs, WORD_BPE, folder)
    assert spark.read.parquet(folder).select("part").distinct().count() > 1
    got = tokens.read_ids(spark, folder, digest=True).orderBy("doc_id").collect()
    upto = 0
    for r in got:
        assert r["start"] == upto
        upto += r["n_tokens"]
    assert docs.select(F.count(F.lit(1))).first()[0] == len(got)


def test_cache_forgets(monkeypatch, spark):
    monkeypatch.setattr(tokens, "CACHED_PARTS", 900)
    encoder, whole = tokens.WordEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = [r["text"] for r in table(spark, SMALL, "documents").select("text").collect()]
    for k in range(0, len(texts), 10):
        flat, n = encoder.encode(pa.array(texts[k:k + 10]))
        want = [i for t in texts[k:k + 10] for i in [*whole.encode(t, add_special_tokens=False).ids, 2]]
        assert flat.tolist() == want

import hashlib
import re

import duckdb
import pytest

from roadrisk.llm import chat, revisit
from roadrisk.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SMALL

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SMALL), con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_events_fold_to_the_last_version(spark):
    rows = [
        (1, 0, 1, 0, "start", "user", "first"), (1, 0, 1, 1, "edit", "user", "second"), (1, 0, 1, 2, "delta", "user", " more"),
        (1, 1, 1, 0, "start", "assistant", ""), (1, 1, 1, 1, "delta", "assistant", "dra"), (1, 1, 1, 2, "regenerate", "assistant", ""),
        *[(1, 1, 1, 3 + k, "delta", "assistant", f"{k},") for k in range(2500)], (2, None, 1, 0, "delta", None, None),
    ]
    got = chat.fold_events(spark.createDataFrame(rows[::-1], "conv_id bigint, turn bigint, copy int, seq int, kind string, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in got}
    assert by == {(1, 0): ("user", "second more"), (1, 1): ("assistant", "".join(f"{k}," for k in range(2500))), (2, None): (None, "")}


def test_round_trip_of_awkward_texts(spark):
    texts = ["", None, "\\", "\\\\", "### a: b", " </turn>\n", "</turn>", "\\### Assistant: </turn> ok", "a\n### user: x </turn>\n", "<", "\\<", "ends \\", "名前: #", "x" * 100000]
    roles = ["user", "assistant", "a: b", "", None, "### x", "assistant", "assistant", "tool", "assistant", "assistant", "assistant", "sys\\tem", "assistant"]
    rows = [(5, k, r, t) for k, (r, t) in enumerate(zip(roles, texts))] + [(6, 1, "user", "same"), (6, 1, "user", "same"), (6, 1, "assistant", "other"), (None, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    shown = chat.render(chat.fold_events(chat.as_events(d)))
    back = {r["conv_id"]: r for r in chat.read_back(shown).collect()}
    assert [(t["role"], t["text"]) for t in back[5]["turns"]] == [(r or "", t or "") for r, t in zip(roles, texts)]
    assert list(back[5]["loss"]) == [t or "" for r, t in zip(roles, texts) if r == "assistant"]
    assert [t["text"] for t in back[6]["turns"]] == ["other", "same", "same"] and len(back[None]["turns"]) == 1
    for r in shown.collect():
        for s in r["loss_mask"]:
            part = r["formatted"][s["start"]:s["start"] + s["length"]]
            assert re.sub(r"\\([\\#<])", r"\1", part) in [t or "" for _, _, role, t in rows if role == "assistant"]
    assert chat.render(chat.fold_events(chat.as_events(d.limit(0)))).count() == 0


@pytest.mark.parametrize("role", ["r" * 200_000, ": " * 3000 + "\\", "\U0001f600\\" * 20_000, "\\\U0001f600: x", ":", " :"])
def test_long_and_odd_roles(spark, role):
    d = spark.createDataFrame([(1, 0, role, "text: one"), (1, 1, "assistant", ": two")], "conv_id bigint, turn bigint, role string, text string")
    back = chat.read_back(chat.render(chat.fold_events(chat.as_events(d)))).first()
    assert [(t["role"], t["text"]) for t in back["turns"]] == [(role, "text: one"), ("assistant", ": two")]


def test_chat_query_hashes(spark):
    r = QUERIES["op5_chat"](spark, SMALL).where("conv_id = -7").first()
    t = "\\### Assistant: </turn> ok"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(t)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_canonical_urls(spark):
    pairs = [
        ("https://WWW.Example.com:443/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"), ("http://example.com", "example.com"),
        ("example.com/a?ref=y", "example.com/a"), ("http://u:p@example.com/A/", "example.com/A"), ("", ""), (None, None),
        ("http://h:8081/x", "h:8081/x"), ("http://h/x", "h/x"), ("https://h:8443/x", "h:8443/x"), ("http://h:80/x", "h/x"), ("https://u:1@h:443", "h"),
        ("http://[::1]:8080/a/", "[::1]:8080/a"), ("http://[::1]/a", "[::1]/a"), ("h:/x", "h/x"),
    ]
    got = spark.createDataFrame([(a,) for a, _ in pairs], "u string").select("u", revisit.canonical_url("u").alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == dict(pairs)


def brute(records):
    out = {}
    for r in records:
        if r[1] != "revisit":
            continue
        before = [o for o in records if o[1] == "response" and None not in (o[2], o[3], r[2], r[3]) and o[2] == r[2] and (o[3], o[0]) < (r[3], r[0])]
        hit = max(before, key=lambda o: (o[3], o[0]), default=None)
        if hit is None:
            out[r[0]] = (None, "no_response", r[4] or {})
            continue
        old, new = hit[4] or {}, r[4] or {}
        status = "no_validator"
        for name, cut in (("etag", 2), ("last-modified", 0)):
            if name in old and name in new:
                plain = [v.removeprefix("W/") if cut else v for v in (old[name], new[name])]
                status = "resolved" if plain[0] == plain[1] else "mismatch"
                break
        merged = {**old, **{k: v for k, v in new.items() if k not in revisit.KEPT_HEADERS}} if status == "resolved" else new
        out[r[0]] = (hit[0], status, merged)
    return out


def test_resolution_equals_brute_force(spark):
    import random

    rng = random.Random(2)
    rows = []
    for k in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        tag = rng.choice(["1", "2", 'W/1'])
        headers = rng.choice([None, {}, {"etag": tag}, {"etag": tag, "content-length": str(k), "date": f"d{k}"}, {"last-modified": rng.choice("ab"), "x": str(k)}])
        # one URL holds most of the captures, spread over many spans; some times are equal
        rows.append((k, kind, rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, *[rng.randrange(0, 200) for _ in range(9)]]), headers))
    d = spark.createDataFrame(rows, "record_id bigint, kind string, url string, ts bigint, headers map<string,string>")
    got = {r["record_id"]: (r["response_id"], r["status"], dict(r["headers"])) for r in revisit.resolve(d, span_seconds=20).collect()}
    assert got == brute(rows)
    assert {s for _, s, _ in got.values()} == {"resolved", "mismatch", "no_response", "no_validator"}
    assert revisit.resolve(d.limit(0)).count() == 0


def test_repeated_records_and_further_columns(spark):
    rows = [(1, "response", "http://h/x", 5, {"etag": "1", "age": "old"}), (1, "response", "http://h/x", 5, {"etag": "1", "age": "old"}),
            (2, "revisit", "http://h:80/x", 9, {"etag": "1"}), (2, "revisit", "http://h/x", 9, {"etag": "1"}), (3, "revisit", "http://h:8081/x", 9, {"etag": "1"})]
    d = spark.createDataFrame(rows, "record_id bigint, kind string, url string, ts bigint, headers map<string,string>").selectExpr(
        "*", "'c' AS canonical_url", "1 AS status", "2 AS response_id", "3 AS _span")
    got = sorted((r["record_id"], r["response_id"], r["status"]) for r in revisit.resolve(d).collect())
    assert got == [(2, 1, "resolved"), (2, 1, "resolved"), (3, None, "no_response")]

"""The registered queries of this folder and, where SQL can say it, their oracle texts."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadrisk.llm import chat, compression, decontaminate, language, mixing, pitman_yor, resample, revisit, rules, simhash, tokens, toxicity, whitening
from roadrisk.llm.tables import new_folder, remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_rows")


@query("op10_language")
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_mixing")
def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op1_token_ids")
def op1_token_ids(spark, sf_dir):
    folder = new_folder(spark, "token-ids")
    tokens.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokens.read_ids(spark, folder, digest=True)


@query("op3_quality")
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, compression.training_labels(table(spark, sf_dir, "labels")))
    scored = compression.with_quality(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= compression.THRESHOLD).cast("int").alias("predicted"))


@query("op8_rules", r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(list) AS word, generate_subscripts(list, 1) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS list FROM d)),
k AS (SELECT rid, i, word, lead(i, 2) OVER o IS NOT NULL AS whole, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS gram
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, i, word, whole AND count(*) OVER (PARTITION BY rid, gram) > 1 AS again FROM k),
c AS (SELECT rid, word, bool_or(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM f),
g AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.text, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN g USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 6 * word_chars OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR 100 * len(regexp_extract_all(text, '!')) > 30 * n_words OR 100 * len(regexp_extract_all(text, '\p{Lu}')) > 60 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * len(regexp_extract_all(text, '\p{L}')) < 50 * word_chars) AS kept
FROM b
""")
def op8_rules(spark, sf_dir):
    return rules.filter_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_chat", r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(role, '([\\#<:])', 'xx', 'g')) + length(regexp_replace(text, '([\\#<])', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""")
def op5_chat(spark, sf_dir):
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string"))
    back = chat.read_back(chat.render(chat.fold_events(chat.as_events(rows))))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.expr("aggregate(loss, 0L, (s, t) -> s + length(t))").alias("loss_chars"),
        F.sha2(F.array_join("loss", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op2_revisit", r"""
WITH p AS (
  SELECT page_id, 1700000000 + page_id * 10 AS ts, '"' || md5(coalesce(html, '')) || '"' AS tag, length(coalesce(html, '')) AS n,
    regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 3)), '^www\.', '')
    || CASE WHEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*):([0-9]+)', 4) IN ('', '80', '443') THEN ''
         ELSE ':' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)?([^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*):([0-9]+)', 4) END
    || regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*([^?#]*)', 2), '/+$', '') AS base,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$'))) AS q
  FROM pages),
u AS (SELECT *, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS curl,
    'day ' || CAST(ts // 86400 AS VARCHAR) AS day, CASE WHEN page_id % 13 = 0 THEN ts - 5 ELSE ts + 5 + (page_id % 7) * 86400 END AS again,
    CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 11 = 0 THEN 2 ELSE 3 END AS form FROM p),
r AS (
  SELECT 2 * page_id AS record_id, curl, ts AS tm, 2 * page_id AS full_id, tag, day, n, form FROM u
  UNION ALL SELECT 2 * page_id + 1, curl, again, NULL, tag, day, n, form FROM u),
w AS (SELECT *, last_value(full_id IGNORE NULLS) OVER (PARTITION BY curl ORDER BY tm, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM r),
j AS (SELECT w.*, o.tag AS otag, o.day AS oday, o.n AS on_ FROM w LEFT JOIN r o ON o.record_id = w.hit AND w.curl IS NOT NULL WHERE w.full_id IS NULL),
s AS (SELECT *, CASE WHEN otag IS NULL THEN 'no_response'
    WHEN form = 1 THEN 'mismatch' WHEN form = 2 THEN CASE WHEN day = oday THEN 'resolved' ELSE 'mismatch' END
    WHEN tag = otag THEN 'resolved' ELSE 'mismatch' END AS status FROM j)
SELECT record_id, curl AS canonical_url, CASE WHEN curl IS NOT NULL THEN hit END AS response_id, status,
  CASE form WHEN 1 THEN '"other"' WHEN 2 THEN CASE WHEN status = 'resolved' THEN otag END ELSE 'W/' || tag END AS etag,
  CASE WHEN status = 'resolved' THEN CAST(on_ AS VARCHAR) ELSE '0' END AS content_length,
  CAST(tm AS VARCHAR) AS date,
  CAST(CASE WHEN status = 'resolved' THEN 5 + (form = 3)::INT ELSE 3 + (form = 3)::INT END AS BIGINT) AS n_headers
FROM s
""")
def op2_revisit(spark, sf_dir):
    found = revisit.resolve(revisit.as_records(table(spark, sf_dir, "pages")))
    return found.select(
        "record_id", "canonical_url", "response_id", "status", F.col("headers")["etag"].alias("etag"),
        F.col("headers")["content-length"].alias("content_length"), F.col("headers")["date"].alias("date"),
        F.size("headers").cast("long").alias("n_headers"))


@query("op6_pitman_yor")
def op6_pitman_yor(spark, sf_dir):
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    found = pitman_yor.score(table(spark, sf_dir, "documents"), ~held_out, order=2)
    return found.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_resample")
def op13_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", F.col("whitening").alias("_w")).select(
        "vec_id", "_w", F.posexplode(F.arrays_zip("_w.whitened", "_w.explained")).alias("_k", "_v")).select(
        "vec_id", (F.col("_k") + 1).alias("component"), "_w.n", "_w.deviation", "_v.whitened", "_v.explained", "_w.identity_error")


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. On a bounded sample the time of each rule and the
share of texts it rejects are measured; the rules then run in the order of rejections per cost,
and a text that one rule rejects meets no later one.
"""
from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.llm.tables import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
SAMPLE_ROWS = 1000  #: rows on which costs and selectivities are estimated


def _repeat_words(words: str, hashes: str, n: str) -> Column:
    """Words in windows of three words that occur twice or more in the text.

    ``hashes`` has one 64-bit hash per window. Where all differ no window repeats, which settles
    most texts; else the windows themselves are sorted and compared.
    """
    marked = f"""
      transform(array(array_sort(transform(sequence(0, {n} - {WINDOW}), i -> named_struct(
        'k', concat_ws(' ', {words}[i], {words}[i + 1], {words}[i + 2]), 'p', i)))), s ->
        array_sort(transform(filter(sequence(0, size(s) - 1), j ->
          (j > 0 AND s[j].k = s[greatest(j - 1, 0)].k) OR (j < size(s) - 1 AND s[j].k = s[least(j + 1, size(s) - 1)].k)),
          j -> s[j].p)))[0]"""
    covered = f"""
      transform(array({marked}), p -> aggregate(sequence(1, size(p)), 0L, (t, i) ->
        t + if(i = size(p), {WINDOW}, least({WINDOW}, p[least(i, size(p) - 1)] - p[i - 1]))))[0]"""
    return F.expr(f"CASE WHEN {n} < {WINDOW} + 1 OR size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE {covered} END")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, text, n_words, word_chars, n_symbols, n_dup_lines,
    n_lines, n_repeat_words); a NULL text counts as empty."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("_w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "_lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    d = d.withColumn("_h", F.expr(
        f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) ELSE array() END"))
    return d.select(
        "doc_id", "text", "n_words",
        F.expr("aggregate(_w, 0L, (t, x) -> t + length(x))").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        _repeat_words("_w", "_h", "size(_w)").cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str  # SQL condition over the columns of ``measures``


BASE = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", "100 * n_symbols > 6 * word_chars"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("exclamations", "100 * regexp_count(text, '!') > 30 * n_words"),
    Rule("capitals", r"100 * regexp_count(text, '\\p{Lu}') > 60 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("few_letters", r"100 * regexp_count(text, '\\p{L}') < 50 * word_chars"),
)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    n = docs.count()
    share = min(1.0, 1.5 * rows / max(n, 1))
    place = F.xxhash64("doc_id", F.lit(8)) / F.lit(2.0**64) + 0.5
    return docs.where(F.coalesce(place, F.lit(0.0)) <= share).limit(rows)


def ordered(rules, measured: DataFrame) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per second on ``measured``, each with its seconds and its share of
    rejected rows. The order decides what is computed, never what is rejected."""
    n = max(1, measured.count())
    found = []
    for r in rules:
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            hits = measured.agg(F.coalesce(F.sum(F.expr(f"CASE WHEN {r.rejects} THEN 1 ELSE 0 END")), F.lit(0))).first()[0]
            best = min(best or 1e9, time.perf_counter() - began)
        found.append((r, best, hits / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def judge(measured: DataFrame, rules, base=BASE) -> DataFrame:
    """Add base_failed, rejected_by (the first rule of the given order, NULL if none) and kept."""
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in base))
    first = F.expr("CASE " + " ".join(f"WHEN {r.rejects} THEN '{r.name}'" for r in (*base, *rules)) + " END")
    return (
        measured.withColumn("base_failed", failed).withColumn("rejected_by", first)
        .withColumn("kept", F.col("rejected_by").isNull())
    )


def filter_quality(docs: DataFrame, rules=RULES, base=BASE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): its measures and the verdict of the cascade.

    Empty and NULL texts fail the base rule on words; repeated rows are judged alike; an empty
    table gives an empty table.
    """
    sample = saved(measures(sample_of(docs, sample_rows)), "rule-sample")
    return judge(measures(docs), [r for r, _, _ in ordered(rules, sample)], base).drop("text")

"""Corpus pipeline: documents by language, without near copies and benchmark passages, mixed to
target weights, written as token ids.

Each stage takes (spark, docs, sf_dir); ``run`` writes what a stage returns as Parquet in the shared
folder and hands the reread rows to the next.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadrisk.llm import decontaminate, language, mixing, simhash, tokens
from roadrisk.llm.tables import new_folder, saved, table

LEAST_SCORE = 0.34  #: a document that no language claims with more than this is rejected


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without letters (``und``) and those that no language
    claims go. An empty table stays empty."""
    model = language.fit(language.training_rows(docs))
    judged = language.identify(docs.select(F.struct("*").alias("_doc"), "text"), model)
    return judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)).select("_doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles: the one
    of the least id, NULL ids last. NULL, empty and wordless texts form one group, rows equal in id and
    text count as copies; an empty table stays empty."""
    return simhash.without_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. NULL and empty texts have none; repeated rows are kept or
    go alike; an empty table stays empty."""
    rows = docs.select(F.struct("*").alias("_doc"), "text")
    counted = decontaminate.with_match_count(rows, table(spark, sf_dir, "benchmark"), "_matches")
    return counted.where("_matches = 0").select("_doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for every time that at least half of its
    words are taken (words taken / size, rounded). Documents without words stay once."""
    taken = mixing.mix(docs, by_row=True).select("doc_id", "row_hash", F.when(
        F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).alias("_times"))
    times = taken.groupBy("doc_id", "row_hash").agg(F.sum("_times").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    own = docs.withColumn("_hash", mixing.row_hash(docs))
    times = times.withColumnsRenamed({"doc_id": "_id", "row_hash": "_other"})
    joined = own.join(times, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_other")))
    # rows equal in id, source and text share their times: each takes an even part, rounded up
    copies = joined.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(ceil(_sum / _rows) as int))")))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as range-coded blocks, read back: doc_id, start, n_tokens, ids_crc32, one row per row.
    NULL and empty texts have the end id alone; ids ascend, NULL ids and repeated rows keep places of
    their own; an empty table gives no rows. Further columns are not read."""
    folder = new_folder(spark, "token-ids")
    tokens.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return tokens.read_ids(spark, folder, digest=True)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Language scores, fingerprints and alignments have no SQL form; ``tests/llm`` holds the rows
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

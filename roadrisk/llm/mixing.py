"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule holds the point frac((i + 1) * golden ratio); the interval of cumulative
target shares in which the point falls names its source, so that every stretch of the schedule
is close to the target mix. The slots of a source, ranked, take the source's blocks in turn:
its documents in hashed order, laid end to end and cut into blocks of equally many words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.llm.tables import saved

BLOCK_WORDS = 512
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BUCKET_ROWS = 2000      #: mean rows of a bucket in which documents are laid end to end
SLOT_SPAN = 1 << 14     #: slots of a span in which ranks are counted
GOLDEN_STEP = 2654435769  #: 2**32 / golden ratio


def golden_point(i: Column) -> Column:
    """Point i of the golden-ratio sequence in 0..1: i * GOLDEN_STEP modulo 2**32, in two halves
    so that no product leaves 64 bits."""
    low = i.bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    high = (low * F.lit(GOLDEN_STEP >> 16)).bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(1 << 16)
    both = (high + low * F.lit(GOLDEN_STEP & 0xFFFF)).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    return both / F.lit(float(1 << 32))


def n_words(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(docs: DataFrame) -> Column:
    """Hash that tells rows of one id apart by text and source."""
    return F.xxhash64(docs["text"], docs["source"])


def source_targets(sizes: DataFrame, times: int = MOST_TIMES) -> DataFrame:
    """(source, weight, source_size) -> adds target, target_words.

    The sources share the sum of all sizes by weight; none gets over ``times`` its own size, and
    what is cut off is shared again by weight. Cut are the sources of least size / weight: the
    first k in that order for which the rest can take its share. Sources are few (one row each).
    """
    low = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = low.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    w = sizes.withColumn("_rank", F.row_number().over(low)).withColumns({
        "_total": F.sum("source_size").over(every), "_weights": F.sum("weight").over(every),
        "_size_upto": F.sum("source_size").over(upto), "_weight_upto": F.sum("weight").over(upto)})
    size_before, weight_before = F.col("_size_upto") - F.col("source_size"), F.col("_weight_upto") - F.col("weight")
    level = (F.col("_total") - times * size_before) / (F.col("_weights") - weight_before)
    # a source is cut if its share of what those before it leave is more than it may take
    w = w.withColumn("_cut", level * F.col("weight") > times * F.col("source_size"))
    w = w.withColumn("_free", F.min(F.when(~F.col("_cut"), F.col("_rank"))).over(every))
    w = w.withColumn("_level", F.max(F.when(F.col("_rank") == F.col("_free"), level)).over(every))
    target = F.when(F.col("_rank") < F.coalesce("_free", F.lit(1 << 30)), (times * F.col("source_size")).cast("double")).otherwise(
        F.col("_level") * F.col("weight"))
    return w.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        *sizes.columns, "target", F.least(F.round("target"), times * F.col("source_size")).cast("long").alias("target_words"))


def weighted_sources(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, size) rows -> (source, source_no, weight, source_size): weights repeat over the
    sources by code point, NULL last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        docs.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")))
    )


def _laid_out(docs: DataFrame, seed: int) -> DataFrame:
    """Add ``at``, the first word of the document in its source's hashed order. Sums over buckets
    of the hash stand between the whole source and the rows, so no task holds a source."""
    rows = docs.count()
    buckets = max(1, rows // BUCKET_ROWS)
    h = docs.withColumn("_h", F.xxhash64("doc_id", "size", "_row", F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("source_no").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = h.groupBy("source_no", "_b").agg(F.sum("size").alias("_s")).select(
        "source_no", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source_no", "_b").orderBy("_h", "_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        h.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(sums, ["source_no", "_b"]).withColumn("at", F.col("_before") + F.col("_in")).drop("_h", "_b", "_in", "_before")
    )


def schedule(spark, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source_no, source_size, target_words) -> (slot, source_no, rank, block, words).

    Each source takes exactly target_words: ranks beyond its need are left out, and where the
    points gave it a few too few, the missing ranks follow after the last slot. The last rank of
    a source, and the last block of a round through it, may be short.
    """
    need = saved(sources.where("target_words > 0").withColumns({
        "_blocks": F.ceil(F.col("source_size") / block_words),
        "_rounds": F.floor(F.col("target_words") / F.col("source_size")),
    }).withColumn("_left", F.col("target_words") - F.col("_rounds") * F.col("source_size")).withColumn(
        "need", F.col("_rounds") * F.col("_blocks") + F.ceil(F.col("_left") / block_words)), "need")
    every = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = need.withColumn("_hi", F.sum("need").over(every)).withColumn("_lo", F.col("_hi") - F.col("need"))
    slots = need.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    ladder = [(r["_hi"], r["source_no"]) for r in bounds.orderBy("_hi").select("_hi", "source_no").collect()]  # one entry per source
    drawn = spark.range(slots).withColumnRenamed("id", "slot")
    steps = F.array(*[F.struct(F.lit(h).cast("long").alias("hi"), F.lit(n).alias("no")) for h, n in ladder])
    place = F.floor(golden_point(F.col("slot") + 1) * F.lit(float(max(slots, 1))))
    drawn = drawn.withColumns({"_place": place, "_steps": steps}).select(
        "slot", F.expr("filter(_steps, x -> x.hi > _place)[0].no").alias("source_no")) if ladder else drawn.withColumn("source_no", F.lit(0))
    drawn = drawn.withColumn("_span", F.floor(F.col("slot") / SLOT_SPAN))
    before = Window.partitionBy("source_no").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = drawn.groupBy("source_no", "_span").agg(F.count(F.lit(1)).alias("_n"))
    starts = spans.select("source_no", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source_no", "_span").orderBy("slot")
    ranked = (
        drawn.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["source_no", "_span"])
        .select("slot", "source_no", (F.col("_before") + F.col("_r")).alias("rank"))
    )
    got = spans.groupBy("source_no").agg(F.sum("_n").alias("_got"))
    short = need.join(got, "source_no", "left").where(F.col("need") > F.coalesce("_got", F.lit(0)))
    extra = short.select(
        F.lit(slots).cast("long").alias("slot"), "source_no",
        F.explode(F.sequence(F.coalesce("_got", F.lit(0)), F.col("need") - 1)).alias("rank"))
    taken = ranked.unionByName(extra).join(need, "source_no").where("rank < need")
    block = F.col("rank") % F.col("_blocks")
    full = F.least(F.lit(block_words), F.col("source_size") - F.col("_block") * block_words)
    last = F.col("_left") - F.col("_block") * block_words
    words = F.when(F.floor(F.col("rank") / F.col("_blocks")) < F.col("_rounds"), full).otherwise(F.least(full, last))
    return taken.withColumn("_block", block).select("slot", "source_no", "rank", F.col("_block").alias("block"), words.alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, times: int = MOST_TIMES, seed: int = 4,
        by_row: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) -> one row per row: doc_id, source, size, source_size,
    target, taken.

    ``size`` counts the words of the text (NULL: 0); ``taken`` the words of the document that
    the schedule takes, repeats counted; never over ``times`` its size. The taken words of a
    source add up to its target, rounded. A NULL source is a source of its own; empty documents
    take nothing; repeated rows count one by one; an empty table gives an empty table. ``by_row``
    adds ``row_hash``, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    sized = saved(docs.select("doc_id", "source", n_words("text").alias("size"), row_hash(docs).alias("_row")), "sizes")
    sources = saved(source_targets(weighted_sources(sized, weights), times), "sources")
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    plan = schedule(spark, sources, block_words)
    # blocks taken whole or in part, and how often; a part is always the head of its block
    rounds = plan.groupBy("source_no", "block").agg(F.collect_list("words").alias("cuts"))
    laid = _laid_out(known.where("size > 0"), seed)
    pieces = laid.select(
        "source_no", "doc_id", "_row", "size", "at",
        F.explode(F.sequence(F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words))).alias("block"))
    head = F.greatest(F.lit(0), F.col("at") - F.col("block") * block_words)
    tail = F.col("at") + F.col("size") - F.col("block") * block_words
    taken = F.expr("aggregate(cuts, 0L, (s, w) -> s + greatest(0L, least(w, _tail) - _head))")
    hit = (
        pieces.join(rounds, ["source_no", "block"]).withColumns({"_head": head, "_tail": tail}).withColumn("taken", taken)
        .groupBy("source_no", "at").agg(F.sum("taken").alias("taken"))
    )
    full = laid.join(hit, ["source_no", "at"], "left")
    cols = ["doc_id", "source", "size", "source_size", "target", *([F.col("_row").alias("row_hash")] if by_row else [])]
    return full.select(*cols, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(
        known.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))

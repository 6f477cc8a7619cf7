"""Ordered computation over trips whose length is not bounded.

A window partitioned by trip alone sends a whole trip to one task. Every ordered operator
here partitions by (trip, segment) instead, a segment being a fixed span of frame numbers,
and passes a boundary table of one row per segment between neighbouring segments:

* ``with_position``  row numbers: local number + rows in earlier segments;
* ``with_halo``      each segment receives the last n rows before it, so that any window
                     reaching at most n rows back is exact;
* ``with_position_halo`` the same for gapless positions, without a boundary table;
* ``last_rows``      the last n rows and the position of each row, after one move;
* ``run_starts``     islands of true rows: local start, else the last start carried over.

The boundary table is SEGMENT_ROWS times smaller than the data; it is the only thing ever
windowed by trip.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.constants import SEGMENT_ROWS
from roadrisk.operators.lineage import shared

SEG = "_seg"


def segmented(df: DataFrame, frame: str = "frame_id", rows: int = SEGMENT_ROWS) -> DataFrame:
    return df.withColumn(SEG, F.floor(F.col(frame) / F.lit(rows)))


def seg_window(keys, order) -> Window:
    return Window.partitionBy(*keys, SEG).orderBy(*order)


def with_position(df, keys, order, frame="frame_id", name="position", rows=SEGMENT_ROWS) -> DataFrame:
    """Add the 0-based row position of each row within its keys."""
    s = segmented(df, frame, rows)
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        s.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, SEG, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    )
    return (
        s.withColumn("_rn", F.row_number().over(seg_window(keys, order)))
        .join(offsets, [*keys, SEG])
        .withColumn(name, F.col("_rn") - 1 + F.col("_off"))
        .drop(SEG, "_rn", "_off")
    )


def with_group_size(df, keys, name="group_size") -> DataFrame:
    """Add the number of rows per key by a combined count and a join, not a window."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), [*keys])


def with_halo(df, keys, order, n, frame="frame_id", rows=SEGMENT_ROWS) -> DataFrame:
    """Add to each segment copies (``_halo`` true) of the n rows that precede it."""
    s = segmented(df, frame, rows)
    back = Window.partitionBy(*keys, SEG).orderBy(*[F.desc(o) for o in order])
    rest = [c for c in s.columns if c not in (*keys, SEG)]
    row = F.struct(*order, *[c for c in rest if c not in order])
    tails = (
        s.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)
        .groupBy(*keys, SEG).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    )
    before = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(-n, -1)
    past = F.flatten(F.collect_list("_rows").over(before))
    halo = (
        tails.select(*keys, SEG, past.alias("_past"))
        .select(*keys, SEG, F.explode(
            F.slice("_past", F.greatest(F.size("_past") - n + 1, F.lit(1)), F.lit(n))).alias("_r"))
        .select(*keys, SEG, *[F.col("_r")[c].alias(c) for c in rest], F.lit(True).alias("_halo"))
    )
    return s.withColumn("_halo", F.lit(False)).unionByName(halo)


def with_position_halo(df, keys, n, pos="position", rows=SEGMENT_ROWS, ahead=False) -> DataFrame:
    """``with_halo`` for positions without gaps (as ``with_position`` numbers them): the last n
    rows of a segment are also handed to the next one, so the rows are read and moved once. With
    ``ahead`` the first row of a segment is handed to the one before it as well."""
    if n > rows:
        raise ValueError(f"a halo of {n} rows needs segments of at least as many")
    at = F.floor(F.col(pos) / F.lit(rows))
    own = F.struct(at.alias("seg"), F.lit(False).alias("halo"))
    last = F.when(F.col(pos) % rows >= rows - n, F.struct((at + 1).alias("seg"), F.lit(True).alias("halo")))
    first = [F.when(F.col(pos) % rows == 0, F.struct((at - 1).alias("seg"), F.lit(True).alias("halo")))] if ahead else []
    both = df.withColumn("_part", F.explode(F.array_compact(F.array(own, last, *first))))
    return both.select(*df.columns, F.col("_part.seg").alias(SEG), F.col("_part.halo").alias("_halo"))


def by_track(df, keys, frame="frame_id", rows=SEGMENT_ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` and segment, the segment as a column: moved once for all that reads it."""
    return shared(segmented(df, frame, rows), *keys, SEG)


def last_rows(s, keys, n, cols: dict[str, str], name="recent", following: dict[str, str] | None = None, order=("frame_id",), keep_segment=False) -> DataFrame:
    """Add the array of the last ``n`` rows of the keys (itself included) as struct of ``cols``, and
    ``position``; ``following`` maps new names to columns of the next row (NULL at the last one).

    s: of ``by_track``; its rows do not move again. Of each segment one row of a boundary table holds
    its size, its first row and its last ``n`` - 1, and brings each segment what came before it.
    """
    order, nxt = list(order), following or {}
    w = seg_window(keys, order)
    entry = F.struct(*[F.col(c).alias(a) for a, c in cols.items()])
    at_end = F.row_number().over(seg_window(keys, [F.desc(o) for o in order])) < n
    first = F.min(F.struct(*order, *[F.col(c).alias(a) for a, c in nxt.items()]))
    tail = F.array_sort(F.collect_list(F.when(F.col("_end"), F.struct(*order, entry.alias("_e")))))
    ends = s.withColumn("_end", at_end).groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"), tail.alias("_tail"))
    run = Window.partitionBy(*keys).orderBy(SEG)
    past = F.flatten(F.collect_list("_tail").over(run.rowsBetween(-(n - 1), -1)))
    edge = ends.select(
        *keys, SEG, F.coalesce(F.sum("_n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.slice(past, F.greatest(F.size(past) - n + 2, F.lit(1)), F.lit(n - 1))["_e"].alias("_past"), F.lead("_first").over(run).alias("_next"))
    own = F.collect_list(entry).over(w.rowsBetween(-(n - 1), 0))
    ahead = {f"_lead_{a}": F.lead(c).over(w) for a, c in nxt.items()}
    f = s.withColumns({"_rn": F.row_number().over(w), "_own": own, "_in": F.lead(F.lit(True)).over(w), **ahead}).join(edge, [*keys, SEG])
    both = F.concat("_past", "_own")
    last = F.when(F.col("_rn") < n, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))).otherwise(F.col("_own"))
    return f.select(*[c for c in s.columns if keep_segment or c != SEG], (F.col("_rn") - 1 + F.col("_off")).alias("position"), last.alias(name),
                    *[F.when(F.col("_in"), F.col(f"_lead_{a}")).otherwise(F.col("_next")[a]).alias(a) for a in nxt])


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", SEG)


def previous(df, keys, order, cols: dict[str, str], frame="frame_id", rows=SEGMENT_ROWS) -> DataFrame:
    """Add ``lag`` of each column: ``cols`` maps the new name to the source column."""
    h = with_halo(df, keys, order, 1, frame, rows)
    w = seg_window(keys, order)
    return drop_halo(h.withColumns({new: F.lag(old).over(w) for new, old in cols.items()}))


def run_starts(df, keys, pos, merge_gap=0, name="run_start", rows=SEGMENT_ROWS) -> DataFrame:
    """Give each (true) row the position at which its run starts.

    Rows belong to one run while at most ``merge_gap`` positions (a number or a column) lie
    between neighbours.
    """
    h = with_halo(df, keys, [pos], 1, pos, rows)
    w = seg_window(keys, [pos])
    back = F.lag(pos).over(w)
    h = h.withColumn(
        "_start", F.when(back.isNull() | (F.col(pos) - back > merge_gap + 1), F.col(pos))
    ).filter(~F.col("_halo")).drop("_halo")
    carried = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        h.groupBy(*keys, SEG).agg(F.max("_start").alias("_m"))
        .select(*keys, SEG, F.max("_m").over(carried).alias("_carry"))
    )
    local = F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        h.withColumn("_local", local)
        .join(carry, [*keys, SEG])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop(SEG, "_start", "_local", "_carry")
    )


def running_total(df, keys, order, value: Column, name, frame="frame_id", rows=SEGMENT_ROWS) -> DataFrame:
    """Running sum of ``value`` in order, including the current row."""
    s = segmented(df, frame, rows).withColumn("_v", value)
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        s.groupBy(*keys, SEG).agg(F.sum("_v").alias("_s"))
        .select(*keys, SEG, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_off"))
    )
    local = F.sum("_v").over(seg_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        s.withColumn("_local", local).join(offsets, [*keys, SEG])
        .withColumn(name, F.col("_local") + F.col("_off"))
        .drop(SEG, "_v", "_local", "_off")
    )


def running_max(df, keys, order, value: Column, name, frame="frame_id", rows=SEGMENT_ROWS) -> DataFrame:
    """Greatest ``value`` so far in order, including the current row; NULLs are passed over. Rows of
    ``by_track`` stay where they are."""
    s = (df if SEG in df.columns else segmented(df, frame, rows)).withColumn("_v", value)
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        s.groupBy(*keys, SEG).agg(F.max("_v").alias("_m"))
        .select(*keys, SEG, F.max("_m").over(earlier).alias("_carry"))
    )
    local = F.max("_v").over(seg_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        s.withColumn("_local", local).join(carry, [*keys, SEG])
        .withColumn(name, F.greatest("_local", "_carry")).drop(SEG, "_v", "_local", "_carry")
    )

"""Recursions along a track or trip of any length, in parallel.

A recursion whose steps can be combined (a linear filter, a decaying sum, a finite automaton) is
cut into segments. Every segment is summed up as one element of a monoid; elements are combined in
a tree of blocks of ``FAN``, so that no row, and no task, holds all segments of a key; going down
the tree again gives each segment the combination of all that came before it. With that entry all
segments are walked at once. Elements are fixed-size arrays of doubles and ``combine`` works on
many pairs at a time.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.operators.lineage import cut

FAN = 64


@dataclass(frozen=True)
class Monoid:
    """``combine(earlier, later)`` of two (n, size) matrices, row by row; ``identity`` changes nothing."""

    identity: tuple[float, ...]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]


def padded(lists: pd.Series, fill: float = 0.0) -> np.ndarray:
    """One row per list, filled up on the right."""
    size = lists.map(len).to_numpy()
    out = np.full((len(lists), int(size.max(initial=0))), fill)
    if len(lists):
        out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate([np.asarray(x, float) for x in lists])
    return out


def ragged(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The rows of ``values``, each cut to its size."""
    return [row[:n] for row, n in zip(values, sizes)]


def _stacked(lists: pd.Series, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, most, size) elements, identity after the last, and how many each list has."""
    flat = [np.concatenate(x) if len(x) else np.zeros(0) for x in lists]
    size = np.array([len(x) // len(identity) for x in flat], int)
    out = np.tile(identity, (len(flat), int(size.max(initial=0)), 1))
    for i, x in enumerate(flat):
        out[i, :size[i]] = x.reshape(-1, len(identity))
    return out, size


def _fold(m: Monoid):
    @F.pandas_udf("array<double>")
    def fold(elements: pd.Series) -> pd.Series:
        parts, _ = _stacked(elements, np.array(m.identity))
        acc = np.tile(np.array(m.identity), (len(parts), 1))
        for j in range(parts.shape[1]):
            acc = m.combine(acc, parts[:, j])
        return pd.Series(list(acc))

    return fold


def _entries(m: Monoid):
    @F.pandas_udf("array<array<double>>")
    def entries(elements: pd.Series, before: pd.Series) -> pd.Series:
        parts, size = _stacked(elements, np.array(m.identity))
        acc, out = np.stack([np.asarray(b, float) for b in before]) if len(before) else np.zeros((0, len(m.identity))), np.empty_like(parts)
        for j in range(parts.shape[1]):
            out[:, j] = acc
            acc = m.combine(acc, parts[:, j])
        return pd.Series([list(o[:n]) for o, n in zip(out, size)])

    return entries


def scan(elements: DataFrame, keys, index: str, monoid: Monoid, name="entry", fan: int = FAN, levels: int | None = None) -> DataFrame:
    """For each (``keys``, ``index``) the combination of all earlier elements of its key.

    elements: keys, ``index`` (whole number, once per key, in order), ``element`` array<double>. They
    are written once and read on every level. A key's first element gets the identity. Levels follow
    from the span of ``index``: 64 segments need one, 4,096 two. NULL keys form a key of their own.

    With ``levels`` nothing is written or counted ahead, so that the elements may come from a shuffle
    that the caller reads as well: ``index`` then runs from 0 to below ``fan ** levels``, or the job fails.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    at = F.col(index).cast("long")
    if levels is not None:
        at = F.when((at >= 0) & (at < fan ** levels), at).otherwise(F.raise_error(F.lit(f"{index} is not below {fan} ** {levels}")))
    base = elements.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], at.alias("_i"), "element")
    if levels is None:
        base = cut(base)
        low, high = base.agg(F.min("_i"), F.max("_i")).first()
    else:
        low, high = 0, fan ** levels - 1
    span = 0 if low is None else high - low
    level = [base.withColumn("_i", F.col("_i") - F.lit(low or 0))]
    blocks = []
    while True:
        rows = F.array_sort(F.collect_list(F.struct("_i", "element")))
        block = level[-1].groupBy(*names, F.floor(F.col("_i") / fan).alias("_b")).agg(rows.alias("_rows"))
        blocks.append(block)
        span //= fan
        if span == 0:
            break
        level.append(block.select(*names, F.col("_b").alias("_i"), _fold(monoid)(F.col("_rows.element")).alias("element")))
    first = F.array(*[F.lit(float(v)) for v in monoid.identity])
    found = None
    for block in reversed(blocks):
        if found is None:  # the top: one block for each key
            block = block.withColumn("_before", first)
        else:
            up = found.select(*[F.col(n).alias(f"{n}u") for n in names], F.col("_i").alias("_bu"), F.col("_entry").alias("_before"))
            on = F.col("_b") == F.col("_bu")
            for n in names:
                on = on & F.col(n).eqNullSafe(F.col(f"{n}u"))
            block = block.join(up, on)
        both = F.arrays_zip(F.col("_rows._i").alias("i"), _entries(monoid)(F.col("_rows.element"), F.col("_before")).alias("e"))
        found = block.select(*names, F.explode(both).alias("_z")).select(*names, F.col("_z.i").alias("_i"), F.col("_z.e").alias("_entry"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], (F.col("_i") + F.lit(low or 0)).alias(index), F.col("_entry").alias(name))


# ---- monoids -----------------------------------------------------------------------------------

def affine() -> Monoid:
    """x -> a x + b as (a, b)."""
    return Monoid((1.0, 0.0), lambda p, q: np.column_stack([p[:, 0] * q[:, 0], q[:, 0] * p[:, 1] + q[:, 1]]))


def mapping(states: int) -> Monoid:
    """Maps of ``states`` numbered states, and a count: the state that each leads to, then the count."""

    def combine(p, q):
        to = np.take_along_axis(q[:, :-1], p[:, :-1].astype(np.int64), 1)
        return np.column_stack([to, p[:, -1] + q[:, -1]])

    return Monoid((*map(float, range(states)), 0.0), combine)


def linear_filter() -> Monoid:
    """Steps of a filter with two states and known noise, in any number.

    An element (transition A, offset b, covariance C, information vector h and matrix J) says how
    observations turn an earlier estimate into a later one: 14 numbers a00 a01 a10 a11 b0 b1 c00 c01
    c11 h0 h1 j00 j01 j11. One with A, h and J zero starts afresh with mean b and covariance C.
    """

    def combine(p, q):
        a00, a01, a10, a11, b0, b1, c00, c01, c11, h0, h1, j00, j01, j11 = p.T
        A00, A01, A10, A11, B0, B1, C00, C01, C11, H0, H1, J00, J01, J11 = q.T
        # m = I + c J; its inverse d; and the inverse of I + J c is d transposed
        m00, m01 = 1 + c00 * J00 + c01 * J01, c00 * J01 + c01 * J11
        m10, m11 = c01 * J00 + c11 * J01, 1 + c01 * J01 + c11 * J11
        det = m00 * m11 - m01 * m10
        d00, d01, d10, d11 = m11 / det, -m01 / det, -m10 / det, m00 / det
        # e = A d
        e00, e01 = A00 * d00 + A01 * d10, A00 * d01 + A01 * d11
        e10, e11 = A10 * d00 + A11 * d10, A10 * d01 + A11 * d11
        y0, y1 = b0 + c00 * H0 + c01 * H1, b1 + c01 * H0 + c11 * H1
        # g = e c, then g A' is symmetric
        g00, g01 = e00 * c00 + e01 * c01, e00 * c01 + e01 * c11
        g10, g11 = e10 * c00 + e11 * c01, e10 * c01 + e11 * c11
        # u = a' d'
        u00, u01 = a00 * d00 + a10 * d01, a00 * d10 + a10 * d11
        u10, u11 = a01 * d00 + a11 * d01, a01 * d10 + a11 * d11
        w0, w1 = H0 - J00 * b0 - J01 * b1, H1 - J01 * b0 - J11 * b1
        # v = u J
        v00, v01 = u00 * J00 + u01 * J01, u00 * J01 + u01 * J11
        v10, v11 = u10 * J00 + u11 * J01, u10 * J01 + u11 * J11
        return np.column_stack([
            e00 * a00 + e01 * a10, e00 * a01 + e01 * a11, e10 * a00 + e11 * a10, e10 * a01 + e11 * a11,
            e00 * y0 + e01 * y1 + B0, e10 * y0 + e11 * y1 + B1,
            g00 * A00 + g01 * A01 + C00, (g00 * A10 + g01 * A11 + g10 * A00 + g11 * A01) / 2 + C01, g10 * A10 + g11 * A11 + C11,
            u00 * w0 + u01 * w1 + h0, u10 * w0 + u11 * w1 + h1,
            v00 * a00 + v01 * a10 + j00, (v00 * a01 + v01 * a11 + v10 * a00 + v11 * a10) / 2 + j01, v10 * a01 + v11 * a11 + j11])

    return Monoid((1.0, 0.0, 0.0, 1.0, *[0.0] * 10), combine)

"""Whitening of embeddings by a covariance over distinct vectors.

Entries become whole numbers, identical vectors are grouped, and the covariance is fitted on the
distinct vectors, each counted once or as often as it occurs. Sums are whole numbers and exact; the
centred products are summed task by task and then in one more step; every distinct vector is
projected once and the result joined back to the rows that hold it.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadrisk.llm.tables import saved, shuffle_partitions

HOT_SHARE = 1000         #: vectors with over one of so many rows are joined apart: there are fewer than so many
BLOCK_ROWS = 4096
LONG = 1 << 63


@dataclass
class Model:
    """Fitted on the vectors of one length: ``n`` by weight, exact ``sums``, mean, and the unit
    eigenvectors (columns) of the covariance with their eigenvalues, falling."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(embeddings: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """Rows whose vector is whole (not NULL, no NULL or non-finite entry), with ``x``, the entries
    times ``scale`` floored, and ``key``, 128 bits of digest of x."""
    c = F.transform(F.col(column), lambda v: v.cast("double"))
    bad = F.exists("_c", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    rows = embeddings.withColumn("_c", c).where(F.col("_c").isNotNull() & ~bad)
    x = F.transform("_c", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return rows.withColumn("x", x).withColumn("key", F.unhex(F.md5(F.array_join("x", ","))))\
        .drop("_c")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, x, dim, n_rows), one row a distinct x, written to the shared folder."""
    found = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows"))
    return saved(found.select(F.unhex(F.md5(F.array_join("x", ","))).alias("key"), "x", F.size("x").alias("dim"), "n_rows"), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Rows of one length at a time: the length, x as a matrix, and the rows."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d)) if len(set(dims)) > 1 else batch
            for at in range(0, part.num_rows, BLOCK_ROWS):
                some = part.slice(at, BLOCK_ROWS)
                yield int(d), some.column("x").flatten().to_numpy().reshape(some.num_rows, int(d)), some


def _summed(df: DataFrame, weight: str, add: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the sum of ``add(length, x, weights)``, vectors of one size: one
    a task, then one for each of a few groups of tasks."""
    def lay(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for d, s in sums.items():
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["dim", "part"])

    def first(batches):
        sums: dict[int, np.ndarray] = {}
        for d, x, rows in _blocks(batches):
            w = rows.column("n_rows").to_numpy() if weight == "count" else np.ones(len(x), np.int64)
            part = add(d, x, w)
            sums[d] = sums[d] + part if d in sums else part
        yield from lay(sums)

    kind = add(0, np.zeros((0, 0), np.int64), np.zeros(0, np.int64)).dtype

    def again(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, raw in zip(batch.column("dim").to_pylist(), batch.column("part").to_pylist()):
                part = np.frombuffer(raw, kind)
                sums[d] = sums[d] + part if d in sums else part
        yield from lay(sums)

    schema = "dim int, part binary"
    parts = df.select("dim", "x", "n_rows").mapInArrow(first, schema)
    groups = max(1, math.isqrt(shuffle_partitions(df.sparkSession)))
    out: dict[int, np.ndarray] = {}
    for r in parts.repartition(groups).mapInArrow(again, schema).collect():
        part = np.frombuffer(r["part"], kind)
        out[r["dim"]] = out[r["dim"]] + part if r["dim"] in out else part
    return out


def fit(distinct: DataFrame, weight: str = "one") -> dict[int, Model]:
    """A model for each length of vector. ``weight``: ``one`` fits on each distinct vector once,
    ``count`` as often as it occurs. Vectors of length zero have no model."""
    assert weight in ("one", "count"), weight

    def totals(d, x, w):  # the parts above and below 2^31 apart, so that no sum of a task leaves 64 bits
        high, low = x >> 31, x & 0x7FFFFFFF
        return np.concatenate([[w.sum()], w @ high, w @ low]).astype(np.int64) if d else np.array([w.sum()], np.int64)

    sums = {}
    for d, v in _summed(distinct, weight, totals).items():
        if d:
            sums[d] = (int(v[0]), [(int(a) << 31) + int(b) for a, b in zip(v[1:d + 1], v[d + 1:])])
    means = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}
    shared = distinct.sparkSession.sparkContext.broadcast(means)

    def products(d, x, w):
        if not d:
            return np.zeros(0)
        c = x - shared.value[d]
        return ((c * w[:, None]).T @ c).ravel()

    out = {}
    for d, v in _summed(distinct, weight, products).items():
        if d:
            n, total = sums[d]
            cov = v.reshape(d, d) / n
            values, vectors = np.linalg.eigh((cov + cov.T) / 2)
            out[d] = Model(n, total, vectors[:, ::-1], values[::-1], float(np.trace(cov)))
    return out


def kept_components(model: Model, most: int) -> int:
    """Components with an eigenvalue above rounding, ``most`` at most."""
    least = max(model.trace, 0.0) * len(model.sums) * np.finfo(float).eps
    return int((model.values[:most] > least).sum())


def deviation(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum of (n*x - S)^2, exact; None where it leaves 64 bits."""
    n, sums = model.n, model.sums
    far = n * int(np.abs(x).max(initial=0) if x.min(initial=0) > -LONG else LONG) + max(map(abs, sums))
    if far * far * len(sums) < LONG:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < LONG else None for e in exact]


def project(distinct: DataFrame, models: dict[int, Model], components: int) -> DataFrame:
    """(key, dim, n_rows, deviation, w): each distinct vector once; w holds up to ``components`` numbers."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def turn(batches):
        for d, x, rows in _blocks(batches):
            if not d:
                continue
            m = shared.value[d]
            k = kept_components(m, components)
            w = (x - m.mean) @ m.vectors[:, :k] / np.sqrt(m.values[:k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel(), pa.float64()))
            yield pa.record_batch([rows.column("key"), rows.column("dim"), rows.column("n_rows"), pa.array(deviation(m, x), pa.int64()), lists],
                                  ["key", "dim", "n_rows", "deviation", "w"])

    return saved(distinct.select("key", "dim", "n_rows", "x").mapInArrow(
        turn, "key binary, dim int, n_rows long, deviation long, w array<double>"), "whitened")


def identity_errors(done: DataFrame, models: dict[int, Model], components: int, weight: str) -> dict[int, float]:
    """Largest absolute entry of the covariance of w minus the identity, for each length; from means
    and then centred products, both by grouped sums."""
    w = F.col("n_rows") if weight == "count" else F.lit(1)
    names = [f"w{i}" for i in range(components)]
    rows = done.select("dim", w.cast("double").alias("_n"), *[F.try_element_at("w", F.lit(i + 1)).alias(c) for i, c in enumerate(names)])
    means = {r["dim"]: r for r in rows.groupBy("dim").agg(*[(F.sum(F.col(c) * F.col("_n")) / F.sum("_n")).alias(c) for c in names]).collect()}
    out = {}
    pairs = [(a, b) for b in range(components) for a in range(b + 1)]
    for d, m in means.items():
        k = kept_components(models[d], components)
        own = [(a, b) for a, b in pairs if b < k]
        if own:
            got = rows.where(F.col("dim") == d).agg(*[
                (F.sum((F.col(names[a]) - m[a + 1]) * (F.col(names[b]) - m[b + 1]) * F.col("_n")) / F.sum("_n")).alias(f"p{a}_{b}") for a, b in own]).first()
            out[d] = max(abs(v - (a == b)) for (a, b), v in zip(own, got))
    return out


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = 4, weight: str = "one", scale: int = 256) -> DataFrame:
    """The rows of ``embeddings`` with whole vectors, and struct ``whitening``: n, deviation, whitened
    and explained (arrays by component) and identity_error.

    Rows whose vector is NULL or holds a NULL or non-finite entry go. Vectors of different lengths
    are whitened apart, each length by its own model. Components without variance (one vector only,
    or fewer dimensions than components) are left out of the arrays; a vector of length zero has
    empty arrays and NULL measures. ``deviation`` is NULL where it leaves 64 bits. Repeated rows stay
    rows; other columns stay, and one named ``whitening`` is replaced. An empty table gives none.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in embeddings.columns if c != "whitening"])
    rows = whole(embeddings.select(own.alias("_row"), F.col(f"`{column}`").alias("_vector")), "_vector", scale)
    distinct = distinct_vectors(rows)
    models = fit(distinct, weight)
    done = project(distinct, models, components)
    errors = identity_errors(done, models, components, weight)
    spark = embeddings.sparkSession
    facts = spark.createDataFrame(
        [(d, m.n, [float(e / m.trace) for e in m.values[:kept_components(m, components)]], errors.get(d)) for d, m in sorted(models.items())],
        "dim int, n long, explained array<double>, identity_error double")
    # one row a length; lengths are few, yet nothing here relies on it
    each = done.join(facts, "dim").select("key", "n_rows", F.struct("n", "deviation", F.col("w").alias("whitened"), "explained", "identity_error").alias("_w"))
    # the key of a hot vector would send its rows to one task: fewer than HOT_SHARE vectors can be hot
    total = distinct.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") * HOT_SHARE > total
    apart = rows.select("_row", "key").join(F.broadcast(each.where(hot).select(F.col("key").alias("_key"), "_w")), F.col("key") == F.col("_key"), "left")
    rest = apart.where(F.col("_key").isNull()).select("_row", "key").join(each.where(~hot).select("key", "_w"), "key", "left")
    found = apart.where(F.col("_key").isNotNull()).select("_row", "_w").unionByName(rest.select("_row", "_w"))
    none = F.struct(F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("deviation"),
                    F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"),
                    F.lit(None).cast("double").alias("identity_error"))
    return found.select("_row.*", F.coalesce("_w", none).alias("whitening"))

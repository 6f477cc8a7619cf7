"""Importance resampling of documents towards a target collection.

Words and pairs of neighbouring words fall into hashed buckets; the two collections' bucket counts
give every bucket a gain, a document weighs the mean gain of its features. A seeded Gumbel draw is
added and the highest scores are drawn without sorting the rest: a distributed quickselect narrows
the range of composite keys (score, id, row) by exact three-way counts around random pivot keys
until it meets the k-th; only the rows before it are sorted and ranked.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.llm.tables import saved, shuffle_partitions
from roadrisk.llm.words import slices, text_bytes

BUCKETS = 10_000
SLICE_BYTES = 1 << 20
PIVOTS = 63       #: random pivot keys in a round of the selection
SHIFTED = 64      #: longest second word whose pair is hashed by table

# digits, a-z and all bytes of other scripts make words; A-Z count as a-z
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, v]: what byte ``v`` at place ``k`` of a crc32 turns into when ``n`` bytes follow.
    crc32(a + b) is crc32(a), so shifted by the length of b, xor crc32(b)."""
    v = np.arange(256, dtype=np.uint32)
    one = v.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    out = np.zeros((SHIFTED + 1, 4, 256), np.uint32)
    out[0] = v[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHIFTED):
        out[n + 1] = (out[n] >> 8) ^ one[out[n] & 255]
    return out


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    flat, base = _shift_tables().reshape(-1), n.astype(np.int64) << 10
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[base + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, words before each text, bucket of each pair, pairs before each text)."""
    raw, offs = text_bytes(texts)
    b = _FOLD[raw]
    word = b > 0
    opens = np.zeros(len(b) + 1, bool)
    opens[offs] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | opens[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | opens[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offs)
    size = ends - starts
    places = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=places[1:])
    flat = b[word].tobytes()
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
    own = np.array([zlib.crc32(w) for w in found.dictionary.to_pylist()], np.uint32)
    crc = own[found.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint32)
    pair = np.ones(max(len(size) - 1, 0), bool)  # word i and the next, unless a text begins between them
    cuts = first[(first > 0) & (first < len(size))]
    pair[cuts - 1] = False
    at = np.flatnonzero(pair)
    left = _shifted(crc[at], np.ones(len(at), np.int64)) ^ np.uint32(zlib.crc32(b" "))
    n = size[at + 1]
    both = _shifted(left, np.minimum(n, SHIFTED)) ^ crc[at + 1]
    for i in np.flatnonzero(n > SHIFTED):
        j = at[i] + 1
        both[i] = zlib.crc32(flat[places[j]:places[j + 1]], int(left[i]))
    return crc % np.uint32(buckets), first, both % np.uint32(buckets), np.searchsorted(at, first)


def _bucket_counts(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                one, _, two, _ = feature_buckets(part.column("text"), buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return count


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: each task counts its own, at most ``buckets`` rows are read back."""
    parts = texts.select("text").mapInArrow(_bucket_counts(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, floored."""
    s, t, k = float(have.sum() + len(have)), float(want.sum() + len(want)), len(have)
    return np.array([math.floor(1000 * math.log(float(want[i] + 1) * s / (float(have[i] + 1) * t))) for i in range(k)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A draw that only the seed and the id decide; a NULL id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def with_weights(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), a row for each of ``docs``. NULL and wordless
    texts have no features and weight 0; whole texts are read in bounded slices."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                one, first, two, pairs = feature_buckets(part.column("text"), len(g))
                sums = np.zeros(part.num_rows, np.int64)
                for at, cut in ((one, first), (two, pairs)):
                    upto = np.zeros(len(at) + 1, np.int64)
                    np.cumsum(g[at], out=upto[1:])
                    sums += upto[cut[1:]] - upto[cut[:-1]]
                words = np.diff(first)
                n = words + np.diff(pairs)
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                ids = part.column("doc_id")
                draw = np.array([gumbel(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.record_batch([ids, *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight, weight + draw))],
                                      ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long, score long")


# ---- selection ---------------------------------------------------------------------------------
Key = tuple[int, int, int, int]
_KEY = ("_a", "_b", "_c", "_row")  # ascending: falling score, NULL ids last, id, row


def with_key(scored: DataFrame) -> DataFrame:
    """Add the composite key: higher scores first, then smaller ids, NULL ids last, then rows as they
    stand in the table, which must be a written one."""
    return scored.withColumns({
        "_a": -F.col("score"), "_b": F.col("doc_id").isNull().cast("int"), "_c": F.coalesce("doc_id", F.lit(0)),
        "_row": F.monotonically_increasing_id()})


def before(key: Key) -> Column:
    """Rows whose composite key comes before ``key``."""
    out = F.lit(False)
    for name, value in reversed(list(zip(_KEY, key))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def same(key: Key) -> Column:
    return (F.col("_row") == key[3]) & (F.col("_a") == key[0]) & (F.col("_b") == key[1]) & (F.col("_c") == key[2])


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS) -> Key | None:
    """The k-th composite key in ascending order, k from 1; None if there are fewer rows or k < 1.

    Each round draws ``pivots`` rows of the range at random (by a hash of row and round), counts
    in one pass the rows before and at each of them, and goes on in the one gap that holds the k-th.
    A round leaves about one part in ``pivots`` of the range, and the driver sees the pivots alone.
    """
    if k < 1:
        return None
    low, high, rest, turn = None, None, k, 0
    while True:
        rows = keyed if low is None else keyed.where(~before(low) & ~same(low))
        rows = rows if high is None else rows.where(before(high))
        drawn = rows.orderBy(F.xxhash64("_row", F.lit(turn)), *_KEY).select(*_KEY).limit(pivots).collect()
        keys = sorted(tuple(r) for r in drawn)
        if not keys:
            return None
        counts = rows.agg(*[F.count_if(before(key)).alias(f"b{i}") for i, key in enumerate(keys)], F.count(F.lit(1)).alias("n")).first()
        if rest > counts["n"]:
            return None
        # rows before key i, key i itself (keys are distinct), rows after it
        i = sum(counts[f"b{i}"] < rest for i in range(len(keys))) - 1
        if i >= 0 and counts[f"b{i}"] + 1 == rest:
            return keys[i]
        if i >= 0:
            low, rest = keys[i], rest - counts[f"b{i}"] - 1
        high = keys[i + 1] if i + 1 < len(keys) else high
        turn += 1


def ranked(winners: DataFrame) -> DataFrame:
    """Add ``rank`` (1, 2, ... by composite key) by a range-partitioned sort: each partition numbers its
    rows, and the partitions' sizes (one row each) give what stands before."""
    n = shuffle_partitions(winners.sparkSession)
    place = F.monotonically_increasing_id()
    rows = saved(
        winners.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)
        .withColumns({"_part": F.spark_partition_id(), "_in": F.pmod(place, F.lit(1 << 33))}), "ranked")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    above = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_above"))
    return rows.join(F.broadcast(above), "_part").withColumn("rank", F.col("_above") + F.col("_in") + 1)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs`` (doc_id, text): the drawn
    ``percent`` of the rows with ``least_words`` or more are ranked, the others have rank NULL.

    NULL texts count as empty. Ties go to the smaller id, then NULL ids, then the row that stands
    first. Repeated rows are rows of their own. An empty ``docs`` gives no rows; an empty
    ``target`` gives all buckets the same prior. Further columns of either table are not read.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    keyed = with_key(saved(with_weights(docs, gain, seed), "weighted"))
    fit = keyed.where(F.col("n_words") >= least_words)
    k = percent * fit.count() // 100
    last = kth_key(fit, k)
    columns = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return keyed.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= least_words) & (before(last) | same(last))
    return ranked(keyed.where(drawn)).select(*columns, "rank").unionByName(
        keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))

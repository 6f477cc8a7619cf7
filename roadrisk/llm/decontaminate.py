"""Benchmark passages in documents, by q-gram lemma filtering and banded alignment.

Texts are compared in lower case with white space as single spaces, as UTF-8 bytes. An item of m
bytes may differ by e edits (``edit_share`` of m, and so few that the lemma still says something).
A region with at most e edits shares at least m + 1 - q * (e + 1) q-grams with the item, all on
e + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals, so
that one band holds them all; bands that reach the bound are aligned inside their band.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadrisk.llm.words import slices, split

Q = 8
EDIT_SHARE = 0.10
ITEM_BYTES = 1 << 21   #: items are searched in blocks of about so many bytes
SLICE_BYTES = 1 << 21
ALIGNED = 256          #: candidates aligned side by side, fewer of long items
CELLS = 1 << 22        #: bytes of items and text that are padded at once
PAIRS = 1 << 20        #: pairs of text and item q-grams that are listed at once
LONG_RUN = 16          #: equal q-grams in a row from which a run is counted as a whole
TABLE_BITS = 20
PAD = 256


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in comparable form, and their offsets."""
    w = split(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    at = np.append(w.starts, len(w.data))
    return w.data, at[w.first]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the eight bytes from each position on; shorter by seven than ``data``."""
    if len(data) < Q:
        return np.zeros(0, np.uint32)
    p = np.uint32(0x01000193)
    with np.errstate(over="ignore"):
        b = data.astype(np.uint32)
        two = b[:-1] * p + b[1:]
        p = p * p
        four = two[:-2] * p + two[2:]
        h = four[:-4] * (p * p) + four[4:]
        h ^= h >> np.uint32(15)
        return h * np.uint32(0x85EBCA77)


@dataclass
class Index:
    ids: np.ndarray      # item ids
    length: np.ndarray
    edits: np.ndarray
    bound: np.ndarray    # least number of shared q-grams
    band: np.ndarray     # half the width of a band
    text: np.ndarray     # bytes of all items, one after the other
    start: np.ndarray    # where each item begins
    grams: np.ndarray    # distinct hashes, sorted
    first: np.ndarray    # postings of each hash
    item: np.ndarray
    offset: np.ndarray
    table: np.ndarray
    runs: np.ndarray     # where runs of neighbouring postings of one hash and item begin, and the end
    first_run: np.ndarray  # runs of each hash
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # items of fewer than q bytes by length: packed bytes, items


def index_of(items: list[tuple[int, str | None]], edit_share: float = EDIT_SHARE) -> Index:
    """Index of one block of (item_id, text). Items of fewer than q bytes match exactly, as whole words;
    those without a word match nothing."""
    data, at = normalised(pa.array([t for _, t in items], pa.string()))
    size = np.diff(at)
    size = size - (data[np.maximum(at[1:] - 1, 0)] == 32) * (size > 0) if len(data) else size  # no space at the end
    keep = np.flatnonzero(size > 0)
    length = size[keep]
    edits = np.maximum(np.minimum((edit_share * length).astype(int), length // Q - 1), 0)
    text, grams, item, offset = [], [], [], []
    for i, k in enumerate(keep):
        own = data[at[k]:at[k] + length[i]]
        text.append(own)
        g = gram_hashes(own)
        grams.append(g)
        item.append(np.full(len(g), i))
        offset.append(np.arange(len(g)))
    grams, item, offset = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((grams, np.uint32), (item, int), (offset, int)))
    text = np.concatenate(text) if text else np.zeros(0, np.uint8)
    order = np.argsort(grams, kind="stable")
    distinct, first = np.unique(grams[order], return_index=True)
    item, offset = item[order], offset[order]
    begins = np.ones(len(item), bool)
    begins[1:] = (grams[order][1:] != grams[order][:-1]) | (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)
    runs = np.flatnonzero(begins)
    first = np.append(first, len(grams))
    short = {}
    for n in np.unique(length[length < Q]):
        own = np.flatnonzero(length == n)
        packed = _packed(data, at[keep[own]], n)
        order = np.argsort(packed, kind="stable")
        short[int(n)] = packed[order], own[order]
    table = np.zeros(1 << TABLE_BITS, bool)
    table[distinct >> np.uint32(32 - TABLE_BITS)] = True
    return Index(np.array([items[k][0] for k in keep], object), length, edits, length + 1 - Q * (edits + 1),
                 1 << np.ceil(np.log2(edits + 1)).astype(int), text, np.cumsum(length) - length, distinct, first,
                 item, offset, table, np.append(runs, len(item)), np.searchsorted(runs, first), short)


def _packed(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes from each place on as one number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(int(n)):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _short_matches(x: Index, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, end) of the items of fewer than q bytes that stand between spaces or ends of the text."""
    rows, items, ends = [], [], []
    if x.short and len(data):
        begins = np.ones(len(data), bool)
        begins[1:] = data[:-1] == 32
        begins[at[:-1][at[:-1] < len(data)]] = True
        start = np.flatnonzero(begins & (data != 32))
        row = np.searchsorted(at, start, "right") - 1
        stop = at[row + 1]
        for n, (packed, own) in x.short.items():
            good = start + n <= stop
            s, r = start[good], row[good]
            closed = (s + n == at[r + 1]) | (data[np.minimum(s + n, len(data) - 1)] == 32)
            s, r = s[closed], r[closed]
            v = _packed(data, s, n)
            a, b = np.searchsorted(packed, v, "left"), np.searchsorted(packed, v, "right")
            m = b - a
            rows.append(np.repeat(r, m))
            ends.append(np.repeat(s - at[r] + n, m))
            items.append(own[np.repeat(a, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(v) if v else none for v in (rows, items, ends))


class _Counts:
    """Numbers by key, summed up whenever the list grows long."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 4 * PAIRS:
            k, c = self.total()
            self.keys, self.counts = [k], [c]
            self.size = 0  # what is left are distinct bands, which the text bounds

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        return keys, np.bincount(at, np.concatenate(self.counts), len(keys)).astype(np.int64)


def _bounded(n: np.ndarray):
    """Ranges of places whose ``n`` add up to PAIRS at most, or single ones."""
    upto, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        yield a, b
        a = b


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) of each place, one after the other."""
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _candidates(x: Index, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first diagonal of the band) of the bands that reach the lemma's bound."""
    none = np.zeros(0, np.int64)
    h = gram_hashes(data)
    pos = np.flatnonzero(x.table[h >> np.uint32(32 - TABLE_BITS)])
    if not len(pos) or not len(x.grams):
        return none, none, none
    h = h[pos]
    g = np.minimum(np.searchsorted(x.grams, h), len(x.grams) - 1)
    row = np.searchsorted(at, pos, "right") - 1
    real = (x.grams[g] == h) & (pos + Q <= at[row + 1])  # a q-gram lies inside one text
    pos, g, row = pos[real], g[real], row[real]
    pos, span = pos - at[row], int(x.length.max())
    shift = span + 2 * int(x.band.max())  # makes diagonals positive
    bands = (int(pos.max(initial=0)) + shift + span) // int(x.band.min()) + 2
    counts = _Counts()

    def put(row, item, k, n):
        key = (row * len(x.ids) + item) * bands + k
        counts.add(np.concatenate([key, key - 1]), np.concatenate([n, n]))  # bands overlap by half

    # runs of one q-gram (rules, dots) meet runs of postings: the pairs on each band follow from their lengths
    new = np.ones(len(pos), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(pos)))
    long_ = np.flatnonzero(size >= LONG_RUN)
    n = x.first_run[g[begin[long_]] + 1] - x.first_run[g[begin[long_]]]
    for a, b in _bounded(n):
        to = _spread(x.first_run[g[begin[long_[a:b]]]], n[a:b])
        at_, la = np.repeat(begin[long_[a:b]], n[a:b]), np.repeat(size[long_[a:b]], n[a:b])
        item, c, lb = x.item[x.runs[to]], x.offset[x.runs[to]], x.runs[to + 1] - x.runs[to]
        low = pos[at_] - (c + lb - 1) + shift
        w = x.band[item]
        m = (low + la + lb - 2) // w - low // w + 1
        for d, e in _bounded(m):
            k = _spread(low[d:e] // w[d:e], m[d:e])
            lo, wide, one, other, it, r = (np.repeat(v[d:e], m[d:e]) for v in (low, w, la, lb, item, row[at_]))

            def upto(t, one=one, other=other):  # pairs (i, j) of the runs with i + j < t
                f = lambda v: np.where(v > 0, v * (v + 1) // 2, 0)
                return f(t) - f(t - one) - f(t - other) + f(t - one - other)

            put(r, it, k, upto((k + 1) * wide - lo) - upto(np.maximum(k * wide - lo, 0)))
    rest = np.flatnonzero(np.repeat(size < LONG_RUN, size))
    pos, g, row = pos[rest], g[rest], row[rest]
    n = x.first[g + 1] - x.first[g]
    for a, b in _bounded(n):
        to = _spread(x.first[g[a:b]], n[a:b])
        item = x.item[to]
        diagonal = np.repeat(pos[a:b], n[a:b]) - x.offset[to] + shift
        put(np.repeat(row[a:b], n[a:b]), item, diagonal // x.band[item], np.ones(len(to), np.int64))
    key, count = counts.total()
    item = key // bands % len(x.ids)
    full = count >= x.bound[item]
    key, item = key[full], item[full]
    return key // bands // len(x.ids), item, (key % bands) * x.band[item] - shift


def _align(x: Index, data, at, row, item, low) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each item inside its band, and where in the text that match ends."""
    edits, end = np.zeros(len(row), int), np.zeros(len(row), int)
    order = np.argsort(x.length[item], kind="stable")  # like lengths side by side
    cost = (2 * x.length + 4 * x.band + 2 * x.edits)[item[order]]
    a = 0
    while a < len(row):
        most = np.maximum.accumulate(cost[a:a + ALIGNED]) * np.arange(1, len(cost[a:a + ALIGNED]) + 1)
        part = order[a:a + max(1, int((most <= CELLS).sum()))]
        a += len(part)
        r, it = row[part], item[part]
        slack = int(x.edits[it].max())
        width = int(2 * x.band[it].max()) + 2 * slack + 1
        longest = int(x.length[it].max())
        start = low[part] - slack
        cols = start[:, None] + np.arange(longest + width)
        place = at[r][:, None] + cols
        inside = (cols >= 0) & (place < at[r + 1][:, None])
        y = np.where(inside, data[np.clip(place, 0, len(data) - 1)], PAD + 1)
        at_item = np.minimum(x.start[it][:, None] + np.arange(longest), len(x.text) - 1)
        own = np.where(np.arange(longest) < x.length[it][:, None], x.text[at_item], PAD)
        step = np.arange(width, dtype=np.int32)
        d = np.zeros((len(r), width), np.int32)
        for i in range(longest):
            up = d + (y[:, i:i + width] != own[:, i, None])
            up[:, :-1] = np.minimum(up[:, :-1], d[:, 1:] + 1)
            d_new = np.minimum.accumulate(up - step, axis=1) + step
            done = np.flatnonzero(x.length[it] == i + 1)
            if len(done):
                best = d_new[done].argmin(1)
                edits[part[done]], end[part[done]] = d_new[done, best], start[done] + i + 1 + best
            d = d_new
    return edits, end


def matches(x: Index, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, index of the item, edits, end) of every verified region, bands of one region joined."""
    data, at = normalised(texts)
    row, item, low = _candidates(x, data, at)
    edits, end = _align(x, data, at, row, item, low) if len(row) else (row, row)
    good = edits <= x.edits[item]
    more = _short_matches(x, data, at)
    row, item, end = (np.concatenate([v[good], m]) for v, m in zip((row, item, end), more))
    edits = np.concatenate([edits[good], np.zeros(len(more[0]), int)])
    order = np.lexsort((end, item, row))
    row, item, edits, end = row[order], item[order], edits[order], end[order]
    if not len(row):
        return row, item, edits, end
    new = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(end) > 2 * x.band[item[1:]] + x.edits[item[1:]]))
    cut = np.flatnonzero(new)
    region = np.cumsum(new) - 1
    best = np.minimum.reduceat(edits, cut)
    first = np.flatnonzero(edits == best[region])
    first = first[np.unique(region[first], return_index=True)[1]]
    return row[first], item[first], edits[first], end[first]


def item_blocks(benchmark: DataFrame, block_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of bounded size, one after the other."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    upto = F.sum(size).over(Window.partitionBy("_slot").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, -1))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    slots = max(1, -(-total // block_bytes))
    cut = benchmark.select("item_id", "text").withColumn("_slot", F.pmod(F.xxhash64("item_id"), F.lit(slots)))
    cut = cut.withColumn("_part", F.coalesce(F.floor(upto / block_bytes), F.lit(0)))
    for b in sorted((r["_slot"], r["_part"]) for r in cut.select("_slot", "_part").distinct().collect()):
        rows = cut.where((F.col("_slot") == b[0]) & (F.col("_part") == b[1])).select("item_id", "text").collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def search(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` (doc_id, text), ``benchmark`` (item_id, text) -> (doc_id, item_id, edits, end_byte,
    item_bytes), one row per region of a document within the edit budget of an item.

    ``end_byte`` counts in the comparable form of the text. NULL and empty texts and items without a
    word match nothing; items of fewer than q bytes match exactly and as whole words. Repeated rows and
    items, also with one or a NULL id, give repeated rows; further columns are not read. The whole table
    is searched once for each block of items.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    found = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(items, edit_share))  # ITEM_BYTES and one item at most, unpadded

        def run(batches, shared=shared):
            x = shared.value
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    row, item, edits, end = matches(x, part.column("text"))
                    yield pa.record_batch([
                        part.column("doc_id").take(pa.array(row)), pa.array(list(x.ids[item]), batch_type(kinds[1])),
                        pa.array(edits, pa.int64()), pa.array(end, pa.int64()), pa.array(x.length[item], pa.int64())],
                        ["doc_id", "item_id", "edits", "end_byte", "item_bytes"])

        one = docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits bigint, end_byte bigint, item_bytes bigint")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, edits bigint, end_byte bigint, item_bytes bigint")
    return found


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _counter(shared):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            n = []
            for part in slices(pa.record_batch([pa.Array.from_pandas(texts, type=pa.string())], ["text"]), "text", SLICE_BYTES):
                n.append(np.bincount(matches(shared.value, part.column("text"))[0], minlength=part.num_rows))
            yield pd.Series(np.concatenate(n) if n else np.zeros(0, int), dtype="int64")

    return F.pandas_udf(count, "bigint")


def with_match_count(docs: DataFrame, benchmark: DataFrame, name: str, edit_share: float = EDIT_SHARE) -> DataFrame:
    """Add the number of benchmark regions in the text to each row, all other columns as they are."""
    total = F.lit(0).cast("long")
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(items, edit_share))
        total = total + _counter(shared)(F.col("text"))
    return docs.withColumn(name, total)

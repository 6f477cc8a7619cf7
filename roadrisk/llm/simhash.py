"""Near-duplicate documents by SimHash and a Gray-order hierarchical index.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles. Two fingerprints that
differ in at most ``distance`` bits agree on at least one of ``distance + 1`` disjoint bit
fields. Each field in turn is rotated to the front and the fingerprints are sorted by their
Gray rank, so that fingerprints with an equal field lie side by side under one upper node
(its mask: that field). Under it, runs of sixteen neighbours form the next nodes, each with the
bits that all its members share; a search carries the differences counted so far and prunes a
whole node when they exceed the distance.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadrisk.llm.components import components
from roadrisk.llm.tables import saved, shuffle_partitions
from roadrisk.llm.words import slices, split

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
SLICE_BYTES = 1 << 22
FAN_OUT = 16
SMALL = 48       #: upper nodes of at most this many fingerprints are compared directly
QUERY_BLOCK = 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_votes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bit set where over half of its hashes have it."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n > 0)
    votes = np.zeros((len(full), BITS), np.int64)
    # reduceat over pieces, so that the unpacked bits of long texts never stand in memory at once
    step = 1 << 17
    for a in range(0, len(hashes), step):
        b = min(a + step, len(hashes))
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo = np.searchsorted(bounds[full + 1], a, "right")
        hi = np.searchsorted(bounds[full], b, "left")
        cuts = np.maximum(bounds[full[lo:hi]] - a, 0)
        votes[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    on = (2 * votes > n[full, None]).astype(np.uint8)
    out[full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and the number of shingles before each text."""
    w = split(texts)
    n = w.counts
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(shingles, out=bounds[1:])
    first = np.repeat(w.first[:-1], shingles) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], shingles)
    last = np.minimum(first + size, np.repeat(w.first[1:], shingles)) - 1
    data = w.data.tobytes()
    view, digest = memoryview(data), xxhash.xxh64_intdigest
    at = zip(w.starts[first].tolist(), w.ends[last].tolist())
    return np.fromiter((digest(view[a:b], SEED) for a, b in at), np.uint64, int(bounds[-1])), bounds


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, fp: long). NULL and wordless texts have fp 0;
    a text of fewer words than a shingle is one shingle."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                fp = shingle_votes(*_shingle_hashes(part.column("text"), size))
                yield pa.record_batch([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


def gray_rank(fp: Column) -> Column:
    """Place of a codeword in the Gray sequence: the exclusive or of all its right shifts."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


class GrayIndex:
    """Nodes over fingerprints in Gray order: bits that all members share, level by level."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        every, some = codes, codes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pattern, own mask, mask
        nodes = []
        while len(every) > 1:
            cuts = np.arange(0, len(every), FAN_OUT)
            every, some = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(some, cuts)
            nodes.append((every, ~(every ^ some)))
        above = None
        for pattern, mask in reversed(nodes):
            # what stands in an upper node is not counted again below it
            own = mask if above is None else mask & ~np.repeat(above, FAN_OUT)[: len(mask)]
            self.levels.append((pattern, own, mask))
            above = mask
        self.leaf_own = ~np.repeat(above, FAN_OUT)[: len(codes)] if above is not None else np.full(len(codes), ALL)

    def within(self, queries: np.ndarray, distance: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """All (query, member) index pairs at most ``distance`` apart. ``skip(level, query, node)``
        may rule out nodes for which the caller needs no answer."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        if len(self.codes) == 0:
            return q[:0], node[:0]
        spent = np.zeros(len(queries), np.uint8)
        sizes = [len(x[0]) for x in self.levels] + [len(self.codes)]
        for k, (pattern, own, _) in enumerate(self.levels):
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            keep = spent <= distance
            if skip is not None:
                keep &= ~skip(k, q, node)
            q, node, spent = q[keep], node[keep], spent[keep]
            child = node[:, None] * FAN_OUT + np.arange(FAN_OUT)
            real = child < sizes[k + 1]
            q, spent, node = np.repeat(q, real.sum(1)), np.repeat(spent, real.sum(1)), child[real]
        spent = spent + np.bitwise_count((queries[q] ^ self.codes[node]) & self.leaf_own[node])
        keep = spent <= distance
        return q[keep], node[keep]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; every label is the least index of its set."""
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _large_node(codes: np.ndarray, distance: int, near=None) -> np.ndarray:
    """Set of each of many fingerprints under one upper node, as the least index in the set;
    ``near(i, j)`` may check the pairs found. A node whose members all stand in the query's own
    set already is passed over."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for a in range(0, len(codes), QUERY_BLOCK):
        flat = [label]
        for _ in index.levels:
            cuts = np.arange(0, len(flat[-1]), FAN_OUT)
            lo, hi = np.minimum.reduceat(flat[-1], cuts), np.maximum.reduceat(flat[-1], cuts)
            flat.append(np.where((lo == hi) & (lo >= 0), lo, -1))
        uniform = flat[:0:-1]  # by level, from the top
        own = label[a:a + QUERY_BLOCK]
        q, m = index.within(codes[a:a + QUERY_BLOCK], distance, lambda k, q, node: uniform[k][node] == own[q])
        if near is not None:
            good = near(q + a, m)
            q, m = q[good], m[good]
        label = _merge(label, q + a, m)
    return label


def _joined(key: np.ndarray, codes: np.ndarray, distance: int, near=None) -> np.ndarray:
    """Set of each row within its upper node, as the index of the set's first row. Rows are
    sorted by node and Gray rank; ``near(i, j)`` says which of the pairs found are links."""
    n = len(codes)
    label = np.arange(n)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cuts, n))
    group = np.repeat(np.arange(len(cuts)), size)
    small = size[group] <= SMALL
    a, b = [], []
    for lag in range(1, min(SMALL, int(size.max(initial=1)))):
        same = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        if not len(same):
            break
        same = same[np.bitwise_count(codes[same] ^ codes[same + lag]) <= distance]
        if near is not None:
            same = same[near(same, same + lag)]
        a.append(same)
        b.append(same + lag)
    if a:
        label = _merge(label, np.concatenate(a), np.concatenate(b))
    for k in np.flatnonzero(size > SMALL):
        s, e = cuts[k], cuts[k] + size[k]
        own = None if near is None else (lambda i, j, s=s: near(i + s, j + s))
        label[s:e] = s + _large_node(codes[s:e], distance, own)
    return label


def _whole_nodes(batches, node):
    """Record batches sorted by node -> lists of columns that hold whole nodes; ``node(batch)``
    gives the node of each row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        key = node(batch)
        if len(key) and key[0] != key[-1]:  # all but the last node are whole
            rows = pa.Table.from_batches(held).combine_chunks()
            key = node(rows)
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _unsigned(rows, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False).view(np.uint64) if isinstance(rows, pa.RecordBatch) else rows.column(
        name).to_numpy().view(np.uint64)


def _star(label: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    other = np.flatnonzero(label != np.arange(len(label)))
    return pa.record_batch([pa.array(ids[other].view(np.int64)), pa.array(ids[label[other]].view(np.int64))], ["u", "v"])


def _node_key(width: int):
    def key(rows):
        top = np.asarray(rows.column("field")).astype(np.uint64)
        return (_unsigned(rows, "gray") >> np.uint64(BITS - width)) | (top << np.uint64(48))

    return key


def _links(batches, distance: int):
    """Rows (field, gray, fp) sorted by field and Gray rank -> star edges inside each upper node."""
    key = _node_key(BITS // (distance + 1))
    for rows in _whole_nodes(batches, key):
        fp = _unsigned(rows, "fp")
        yield _star(_joined(key(rows), fp, distance), fp)


def _indexed(fps: DataFrame, distance: int, *more: str) -> DataFrame:
    """Fingerprints (fp: long, ...) once for each bit field, sorted by upper node and Gray rank:
    (fp, field, gray, ...)."""
    fields = distance + 1
    width = BITS // fields
    turned = fps.select("fp", *more, F.explode(F.array(*[
        F.struct(F.lit(k).alias("field"), rotated(F.col("fp"), k * width).alias("code")) for k in range(fields)
    ])).alias("x")).select("fp", "x.field", gray_rank(F.col("x.code")).alias("gray"), *more)
    node = F.shiftrightunsigned("gray", BITS - width)
    return turned.repartition(shuffle_partitions(fps.sparkSession), "field", node).sortWithinPartitions("field", node, "gray")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct fingerprints (fp: long) -> edges (u, v) that join exactly the fingerprints
    reachable by steps of at most ``distance`` differing bits (at most one edge for each
    fingerprint and bit field)."""
    return _indexed(fps, distance).mapInArrow(lambda it: _links(it, distance), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, fp, component_id, class_rows), one row per row.

    ``component_id`` is the smallest doc_id reachable over links; texts with one fingerprint are
    linked (wordless ones by fp 0). A NULL doc_id keeps its row and takes part, but is nobody's
    component_id unless the whole component has no id. An empty table gives an empty table.
    """
    prints = saved(fingerprints(docs, size), "fingerprints")
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("class_rows")), "classes")
    found = components(links(classes, distance))
    linked = classes.join(found.withColumnRenamed("node", "fp"), "fp")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(roots, "root").select("fp", "component_id")
    label = (
        classes.join(moved, "fp", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"), "class_rows")
    )
    return prints.join(label, "fp").select("doc_id", "fp", "component_id", "class_rows")


SKETCH_BITS = 22     #: counters of the shingle frequencies, log2; raise it with log2 of the corpus
SKETCH_PIECES = 64
ALL_PAIRS = 32       #: prefix groups of at most this many sets are paired completely at once
PIVOTS = 4           #: sets of a larger group that its members are compared with first
PAIR_BLOCK = 512
BITMAP_BITS = 512    #: of the bitmap that bounds the common shingles of two sets
GROUP_ROWS = 2048    #: sets of a large group in a block; pairs of blocks are compared apart


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the number before each text.
    A shingle is hashed from the hashes of its words."""
    w = split(texts)
    n = w.counts
    codes, distinct = w.distinct()
    word = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in distinct.to_pylist()), np.uint64, len(distinct))
    word = word[codes] if len(codes) else np.zeros(0, np.uint64)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), shingles)
    before = np.cumsum(shingles) - shingles
    at = w.first[:-1][doc] + np.arange(len(doc)) - before[doc]
    end = w.first[1:][doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        inside = at + k < end
        h[inside] = _mixed(h[inside] ^ word[at[inside] + k]) + np.uint64(k + 1)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Logarithm (quarter octaves) of the number of texts with a shingle, by the leading bits of
    its hash. Any order of the shingles gives exact prefixes; this one puts rare ones first."""
    piece = (1 << SKETCH_BITS) // SKETCH_PIECES

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, _ = _shingle_sets(part.column("text"), size)
                at, c = np.unique(h >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                total[at.astype(np.int64)] += c.astype(np.uint32)
        if total.any():
            for k in range(SKETCH_PIECES):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array(
                    [zstandard.ZstdCompressor(level=1).compress(total[k * piece:(k + 1) * piece].tobytes())])], ["piece", "counts"])

    def add(key, table):
        total = np.zeros(piece, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint32)
        level = np.round(4 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([level.tobytes()])})

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    counted = docs.select("text").mapInArrow(count, "piece int, counts binary")
    for r in counted.groupBy("piece").applyInArrow(add, "piece int, levels binary").collect():
        out[r["piece"] * piece:(r["piece"] + 1) * piece] = np.frombuffer(r["levels"], np.uint8)
    return out


def _least_overlap(n, similarity: float):
    """Least number of common shingles of two sets with ``n`` shingles in all."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9)


def _parities(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A bitmap of each set: a bit is the parity of the shingles that fall on it. Two bitmaps differ in
    no more bits than the sets differ in shingles, so they bound the common shingles from above."""
    bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    odd = np.bincount(doc * BITMAP_BITS + bit, minlength=docs * BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, BITMAP_BITS), axis=1, bitorder="little").view(np.uint64)


def _prefixes(batches, size: int, similarity: float, levels: np.ndarray):
    """(doc_id, text_hash, cls, n, fp, bits, prefix): the hash of the set, its size, fingerprint and
    bitmap, and the rarest shingles, of which two sets of the similarity have one in common."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            h, upto = _shingle_sets(part.column("text"), size)
            n = np.diff(upto)
            cls = [xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED) for a, b in zip(upto[:-1], upto[1:])]
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], doc))
            take = np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
            first = h[order][np.arange(len(h)) - upto[:-1][doc] < take[doc]]
            cuts = np.zeros(len(n) + 1, np.int32)
            np.cumsum(take, out=cuts[1:])
            bits = _parities(h, doc, len(n))
            yield pa.record_batch([
                part.column("doc_id"), part.column("_text"), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(n.astype(np.int32)),
                pa.array(shingle_votes(h, upto).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel().view(np.int64))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(first.view(np.int64)))], ["doc_id", "text_hash", "cls", "n", "fp", "bits", "prefix"])


def _possible(i, j, n, pos, similarity: float) -> np.ndarray:
    """Whether sizes and places of the common shingle allow the similarity."""
    least = _least_overlap(n[i] + n[j], similarity)
    most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1
    return most >= least


def _near_bitmaps(i, j, n, bits, similarity: float) -> np.ndarray:
    """Whether sizes and bitmaps of the sets allow the similarity."""
    apart = np.zeros(len(i), np.int64)
    for k in range(bits.shape[1]):
        apart += np.bitwise_count(bits[i, k] ^ bits[j, k])
    both = n[i] + n[j]
    return (both - apart) // 2 >= _least_overlap(both, similarity)


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that join the sets of ``label`` without a circle, and the labels after them."""
    kept = [np.zeros((2, 0), np.int64)]
    while True:
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return label, *np.concatenate(kept, axis=1)
        # each set is hooked once, to one of a lower label
        _, first = np.unique(np.maximum(label[a], label[b]), return_index=True)
        kept.append(np.stack([a[first], b[first]]))
        label = _merge(label.copy(), a[first], b[first])


def _index_pairs(batches, distance: int, similarity: float):
    """Sets (fp, field, gray, cls, n, bits) sorted by field and Gray rank -> pairs (a, b) of sets whose
    fingerprints are near and whose bitmaps allow the similarity; of each upper node only pairs that
    join its sets without a circle, so no more than it has members."""
    key = _node_key(BITS // (distance + 1))
    for rows in _whole_nodes(batches, key):
        fp, cls, n = (np.asarray(rows.column(c)) for c in ("fp", "cls", "n"))
        n = n.astype(np.int64)
        bits = rows.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)
        label, pairs = np.arange(len(fp)), [np.zeros((2, 0), np.int64)]

        def near(i, j):
            nonlocal label
            good = _near_bitmaps(i, j, n, bits, similarity)
            label, a, b = _forest(label, i[good], j[good])
            pairs.append(np.stack([a, b]))
            return good

        _joined(key(rows), fp.view(np.uint64), distance, near)
        i, j = np.concatenate(pairs, axis=1)
        yield pa.record_batch([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])


def _prefix_pairs(batches, similarity: float):
    """Sets (token, cls, n, pos, root) sorted by token and cls -> candidate pairs (a, b) of different
    roots; a group of over ALL_PAIRS sets gives the pairs with its pivots, and its rows (b NULL) for
    the second round."""
    for t in _whole_nodes(batches, lambda rows: _unsigned(rows, "token")):
        token, cls, n, pos, root = (np.asarray(t.column(c)) for c in ("token", "cls", "n", "pos", "root"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls, n, pos, root = token[new], cls[new], n[new].astype(np.int64), pos[new].astype(np.int64), root[new]
        cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(cuts, len(token)))
        count, first = np.repeat(count, count), np.repeat(cuts, count)
        place = np.arange(len(token)) - first
        i, j = [], []
        for lag in range(1, min(ALL_PAIRS, int(count.max(initial=1)))):
            x = np.flatnonzero((place >= lag) & (count <= ALL_PAIRS))
            i.append(x - lag)
            j.append(x)
        large = np.flatnonzero(count > ALL_PAIRS)
        for k in range(PIVOTS):
            x = large[place[large] > k]
            i.append(first[x] + k)
            j.append(x)
        i, j = np.concatenate(i), np.concatenate(j)
        good = (root[i] != root[j]) & _possible(i, j, n, pos, similarity)
        pairs = np.unique(np.stack([cls[i[good]], cls[j[good]]], 1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        if len(pairs):
            yield pa.record_batch([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], ["token", "a", "b", "n", "pos"])
        if len(large):
            yield pa.record_batch([pa.array(token[large]), pa.array(cls[large]), pa.nulls(len(large), pa.int64()), pa.array(n[large]), pa.array(pos[large])],
                                  ["token", "a", "b", "n", "pos"])


def _cross_pairs(batches, similarity: float):
    """Rows (token, at, a, n, pos, bits, prefix, root, block) sorted by token and ``at``, a pair of blocks of
    the group -> pairs (a, b) of sets that are not joined yet and whose bitmaps allow the similarity. Two
    sets of which ``prefix`` has a rarer shingle in common have met in its group and are left out."""
    def groups(rows):
        return np.stack([_unsigned(rows, "token"), np.asarray(rows.column("at")).astype(np.uint64)], 1)

    for t in _whole_groups(batches, groups):
        cls, n, pos, root, block = (np.asarray(t.column(c)) for c in ("a", "n", "pos", "root", "block"))
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cls), -1)
        prefix = t.column("prefix").combine_chunks()
        key = groups(t)
        cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        for s, e in zip(cuts, np.append(cuts[1:], len(cls))):
            rarer: dict[int, frozenset] = {}

            def met(i, j):
                for x in (i, j):
                    if x not in rarer:
                        rarer[x] = frozenset(prefix[x].values[:pos[x]].to_pylist())
                return not rarer[i].isdisjoint(rarer[j])

            order = s + np.argsort(block[s:e], kind="stable")
            one = order[block[order] == block[order[0]]]
            other = order[len(one):]
            same = not len(other)  # a block against itself
            for x in range(0, len(one), PAIR_BLOCK):
                right = one[x:] if same else other
                for y in range(0, len(right), PAIR_BLOCK):
                    i, j = np.meshgrid(one[x:x + PAIR_BLOCK], right[y:y + PAIR_BLOCK], indexing="ij")
                    keep = root[i] != root[j]
                    if same:
                        keep &= i < j
                    i, j = i[keep], j[keep]
                    good = _possible(i, j, n, pos, similarity)
                    i, j = i[good], j[good]
                    good = _near_bitmaps(i, j, n, bits, similarity)
                    i, j = i[good], j[good]
                    good = np.array([not met(x, y) for x, y in zip(i.tolist(), j.tolist())], bool)
                    i, j = i[good], j[good]
                    if len(i):
                        yield pa.record_batch([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])


def _whole_groups(batches, keys):
    """Tables that hold whole groups of equal ``keys`` (rows of a matrix), from sorted batches."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = keys(batch)
        cut = np.flatnonzero((k != k[-1]).any(1))
        if len(cut):  # all but the last group of the batch are whole
            held.append(batch.slice(0, cut[-1] + 1))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cut[-1] + 1)]
        elif held and (keys(held[-1].slice(held[-1].num_rows - 1))[0] != k[-1]).any():
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of set hashes whose sets have the similarity: exact Jaccard of the sets."""
    need = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    texts = rows.join(need, "cls").groupBy("cls").agg(F.min("text_hash").alias("_text")).select("_text").distinct()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                h, upto = _shingle_sets(part.column("text"), size)
                cls = np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), SEED) for a, b in zip(upto[:-1], upto[1:])], np.uint64)
                yield pa.record_batch([pa.array(cls.view(np.int64)), pa.ListArray.from_arrays(
                    pa.array(upto.astype(np.int32)), pa.array(h.view(np.int64)))], ["cls", "shingles"])

    sets = docs.select("text", F.xxhash64("text").alias("_text")).join(texts, "_text").select("text").mapInArrow(
        run, "cls bigint, shingles array<bigint>").dropDuplicates(["cls"])
    sets = saved(sets, "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("_common", common).where(
        F.col("_common") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("_common")) - F.lit(1e-9)).select("a", "b")


def _allowed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the similarity."""
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cls").alias(c), F.col("n").alias(f"_n{c}"), F.col("bits").alias(f"_{c}")), c)
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("_na") + F.col("_nb")
    least = F.ceil(F.lit(similarity / (1 + similarity)) * both - F.lit(1e-9))
    return pairs.where(F.floor((both - apart) / 2) >= least).select("a", "b")


def similar_links(docs: DataFrame, rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges (u, v) between hashes of shingle sets, each of at least ``similarity``, that join
    exactly the sets reachable over such pairs: those that the index finds, then those by prefixes
    between sets that it has not joined."""
    n = shuffle_partitions(docs.sparkSession)
    sets = saved(rows.dropDuplicates(["cls"]).select("cls", "n", "fp", "bits", "prefix"), "sets")
    near = _indexed(sets, DISTANCE, "cls", "n", "bits").mapInArrow(
        lambda it: _index_pairs(it, DISTANCE, similarity), "a bigint, b bigint").distinct()
    indexed = saved(_verified(saved(near, "pairs"), docs, rows, size, similarity).withColumnsRenamed({"a": "u", "b": "v"}), "links")
    joined = components(indexed).withColumnRenamed("node", "cls")
    rooted = sets.join(joined, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    entries = rooted.select("cls", "n", "root", F.posexplode("prefix").alias("pos", "token")).select("token", "cls", "n", "pos", "root")
    found = saved(
        entries.repartition(n, "token").sortWithinPartitions("token", "cls").mapInArrow(
            lambda it: _prefix_pairs(it, similarity), "token bigint, a bigint, b bigint, n bigint, pos bigint"), "pairs")
    pairs = _allowed(found.where("b IS NOT NULL").select("a", "b").distinct(), sets, similarity)
    more = _verified(saved(pairs, "pairs"), docs, rows, size, similarity).withColumnsRenamed({"a": "u", "b": "v"})
    edges = saved(indexed.unionByName(more), "links")
    large = found.where("b IS NULL").drop("b")
    if large.isEmpty():
        return edges
    # large groups: what the pivots have joined is one root; pairs between roots are still open
    large = large.join(components(edges).withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    large = saved(large, "large")
    mixed = large.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("_size"))
    mixed = mixed.where("lo <> hi").select("token", F.ceil(F.col("_size") / GROUP_ROWS).cast("int").alias("_k"))
    # a group goes out in blocks, each pair of blocks to a task of its own
    open_rows = large.join(mixed, "token").join(sets.select(F.col("cls").alias("a"), "bits", "prefix"), "a")
    open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("a"), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o")
    dealt = open_rows.select("*", other).withColumn(
        "at", F.least("block", "_o") * F.col("_k") + F.greatest("block", "_o")).select("token", "at", "a", "n", "pos", "bits", "prefix", "root", "block")
    crossed = dealt.repartition(n, "token", "at").sortWithinPartitions("token", "at").mapInArrow(
        lambda it: _cross_pairs(it, similarity), "a bigint, b bigint")
    rest = saved(crossed.distinct(), "pairs")
    more = _verified(rest, docs, rows, size, similarity).withColumnsRenamed({"a": "u", "b": "v"})
    return saved(edges.unionByName(more), "links")


def similar_rows(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, text_hash, component, keeper): one row per row;
    texts whose sets of word shingles have ``similarity`` (Jaccard) or more in common are linked.

    The Gray-order index over the fingerprints of the sets gives the first candidates; what their exact
    similarity joins is one component from then on. Sets of the similarity share one of their rarest
    shingles (prefix filter), so every pair that the fingerprints miss still meets; candidates whose bitmaps allow the similarity are verified by the exact similarity of the
    sets. In a large group the members are compared with a few pivots first, and only pairs not yet
    in one component after that, block by block in tasks of their own; of those only what the
    bitmaps allow leaves the task. ``keeper`` marks the first row of each component by (doc_id, hash of the text), NULL ids
    last. Texts without words form one component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, size))
    rows = saved(docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(
        lambda it: _prefixes(it, size, similarity, shared.value), f"doc_id {kind}, text_hash bigint, cls bigint, n int, fp bigint, bits array<bigint>, prefix array<bigint>"), "prefixes")
    found = components(similar_links(docs, rows, size, similarity))
    keyed = rows.select("doc_id", "text_hash", "cls")
    named = keyed.join(found, keyed["cls"] == found["node"], "left").select(
        "doc_id", "text_hash", F.coalesce("root", "cls").alias("component"))
    named = saved(named, "named")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    return named.join(first, "component").select(
        "doc_id", "text_hash", "component",
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))).alias("keeper"))


def without_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of similar ones; all columns as they
    are. Of rows equal in id and text one stays, too."""
    marked = saved(similar_rows(docs, size, similarity), "marked")
    gone = marked.where("NOT keeper").select("doc_id", "text_hash").distinct()
    again = marked.where("keeper").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    own = docs.withColumn("_text_hash", F.xxhash64("text"))

    def listed(frame, other, how):
        return frame.join(other.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_id"))
                          & (F.col("_text_hash") == F.col("_hash")), how)

    kept = listed(own, gone, "left_anti")
    if again.isEmpty():
        return kept.drop("_text_hash")
    once = listed(kept, again, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return listed(kept, again, "left_anti").unionByName(once).drop("_text_hash")

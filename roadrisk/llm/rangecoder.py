"""Adaptive context-mixing range coder for token ids, in blocks that are reset and checked alone.

Three predictions are mixed for every id: the id last seen after the two ids before it (order 2),
the id last seen after the one before it (order 1), and the frequencies of the block so far
(order 0). How far order 2 and order 1 are trusted is learned for each confidence level, and
the mixed distribution drives a carry-less range coder of 64 bits. Order 0 counts buckets of
ids (the low nine bits); inside a bucket the id last seen there has a learned share and the others
divide the rest evenly.

Blocks start from the same fresh state, so all blocks of a segment are coded side by side: every
array has one entry per block (a lane), and one step codes one id of each. The last block is
filled up with id 0; its true length is kept beside it.
"""
from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 2048
BUCKET_BITS, BUCKETS = 9, 512
SHARE_BITS, SHARES = 12, 4096
COUNT_BITS, COUNTS = 12, 4096
SLOTS_1, SLOTS_2 = 256, 512
LOW, HIGH, HIGH_MEMBER, RATE = 32, 3968, 3400, 5
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 48)
TOTAL_BITS = 2 * SHARE_BITS + COUNT_BITS  #: shares of one id add up to 2**36, below the least range of 2**48
WORD = np.uint64(16)
REBUILD = frozenset([1 << k for k in range(3, 10)] + list(range(512, BLOCK_IDS, 512)))
MOST_IDS = BUCKETS * 512  #: largest vocabulary


class _Model:
    """State of all lanes in flat tables. An order-1 or order-2 slot packs an id and how sure it is
    (two bits); a bucket packs the shares below it and its own (fourteen bits)."""

    def __init__(self, lanes: int, vocabulary: int):
        if not 0 < vocabulary <= MOST_IDS:
            raise ValueError(f"vocabulary of {vocabulary} ids; at most {MOST_IDS} can be coded")
        self.members = -(-vocabulary // BUCKETS)
        row = np.arange(lanes)
        self.at1, self.at2, self.at4, self.atb = row * SLOTS_1, row * SLOTS_2, row * 4, row * BUCKETS
        self.slot1, self.slot2 = np.zeros(lanes * SLOTS_1, np.int32), np.zeros(lanes * SLOTS_2, np.int32)
        self.trust1 = np.tile(np.array([256, 1024, 2048, 3072], np.int64), lanes)
        self.trust2 = np.tile(np.array([256, 1536, 2560, 3584], np.int64), lanes)
        self.same = np.full(lanes, 2048, np.int64)
        self.last = np.zeros(lanes * BUCKETS, np.int16)
        self.count = np.zeros((lanes, BUCKETS), np.int16)
        self.flat = self.count.reshape(-1)
        self.prev = np.zeros(lanes, np.int64)
        self.mixed = np.zeros(lanes, np.int64)
        self.rebuild(0, False)

    def rebuild(self, seen: int, search: bool) -> None:
        """Bucket shares from the counts so far, and for a decoder their inverse."""
        if seen == 0:
            share = np.full(self.count.shape, COUNTS // BUCKETS, np.int32)
        else:
            share = (self.count * np.float32((COUNTS - BUCKETS) / seen)).astype(np.int32) + np.int32(1)
            share[:, -1] += COUNTS - share.sum(1, dtype=np.int32)
        below = np.cumsum(share, axis=1, dtype=np.int32) - share
        self.bucket_shares = ((below << 14) | share).reshape(-1)
        if search:
            self.bucket = None  # the old inverse goes before the new one is made
            bucket = np.broadcast_to(np.arange(BUCKETS, dtype=np.uint16), share.shape).reshape(-1)
            self.bucket = np.repeat(bucket, share.reshape(-1))

    def predict(self):
        """Predicted ids, and the shares of order 2 and order 1; the rest is that of order 0."""
        h = self.prev * 40503
        self.s1 = self.at1 + (h >> 7 & (SLOTS_1 - 1))
        self.s2 = self.at2 + (h + self.mixed >> 6 & (SLOTS_2 - 1))
        self.mixed = self.prev * 60493
        p1, p2 = self.slot1[self.s1], self.slot2[self.s2]
        self.k1, self.k2 = p1 & 3, p2 & 3
        self.j1, self.j2 = self.at4 + self.k1, self.at4 + self.k2
        g1, g2 = p1 >> 2, p2 >> 2
        self.t1, f2 = self.trust1[self.j1], self.trust2[self.j2]
        f1 = ((SHARES - f2) * self.t1) >> SHARE_BITS
        f1 *= g1 != g2
        return g1, g2, f1, f2

    def learn(self, x, hit1, hit2, f2, missed, member, same, at_bucket) -> None:
        self.trust2[self.j2] = f2 + ((LOW + (HIGH - LOW) * hit2 - f2) >> RATE)
        self.trust1[self.j1] = self.t1 + ((LOW + (HIGH - LOW) * hit1 - self.t1) >> RATE)
        packed = x << 2
        self.slot2[self.s2] = packed | np.minimum(self.k2 + 1, 3) * hit2
        self.slot1[self.s1] = packed | np.minimum(self.k1 + 1, 3) * hit1
        self.same += ((LOW + (HIGH_MEMBER - LOW) * same - self.same) >> RATE) * missed
        self.last[at_bucket] = member
        self.flat[at_bucket] += 1
        self.prev = x


class _Writer:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words, self.n = np.zeros((lanes, 1024), np.uint16), np.zeros(lanes, np.int64)

    def put(self, below, share) -> None:
        unit = self.range >> np.uint64(TOTAL_BITS)
        self.low += unit * below.view(np.uint64)
        self.range = unit * share.view(np.uint64)
        settle(self)

    def shifted(self, lanes, low) -> None:
        n = self.n[lanes]
        if int(n.max()) + 8 > self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[lanes, n] = low >> np.uint64(48)
        self.n[lanes] = n + 1

    def close(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for _ in range(4):
            self.shifted(lanes, self.low)
            self.low <<= WORD
        return [self.words[i, :k].astype("<u2").tobytes() for i, k in enumerate(self.n)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        lanes = len(payloads)
        size = [len(p) // 2 for p in payloads]
        self.words = np.zeros((lanes, max(size, default=0) + 8), np.uint16)
        for i, p in enumerate(payloads):
            self.words[i, : size[i]] = np.frombuffer(p, "<u2", size[i])
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code, self.n = np.zeros(lanes, np.uint64), np.zeros(lanes, np.int64)
        self.most = self.words.shape[1] - 1
        for _ in range(4):
            self.shifted(np.arange(lanes), None)

    def look(self):
        self.unit = self.range >> np.uint64(TOTAL_BITS)
        return np.minimum((self.code - self.low) // self.unit, np.uint64((1 << TOTAL_BITS) - 1)).view(np.int64)

    def take(self, below, share) -> None:
        self.low += self.unit * below.view(np.uint64)
        self.range = self.unit * share.view(np.uint64)
        settle(self)

    def shifted(self, lanes, _) -> None:
        n = self.n[lanes]
        self.code[lanes] = (self.code[lanes] << WORD) | self.words[lanes, np.minimum(n, self.most)]
        self.n[lanes] = n + 1


def settle(c) -> None:
    """Shift out the leading words that no longer change; cut the range where it straddles one."""
    lanes = np.flatnonzero(((c.low ^ (c.low + c.range)) < TOP) | (c.range < BOTTOM))
    while len(lanes):
        low, rng = c.low[lanes], c.range[lanes]
        rng = np.where((low ^ (low + rng)) < TOP, rng, (~low + np.uint64(1)) & (BOTTOM - np.uint64(1)))
        c.shifted(lanes, low)
        low, rng = low << WORD, rng << WORD
        c.low[lanes], c.range[lanes] = low, rng
        lanes = lanes[((low ^ (low + rng)) < TOP) | (rng < BOTTOM)]


def as_stored(ids: np.ndarray) -> np.ndarray:
    """32-bit ids as little-endian unsigned integers, in place where the machine holds them so."""
    return ids.astype("<i4", copy=False).view("<u4")


def encode(ids: np.ndarray, vocabulary: int) -> tuple[list[bytes], list[int]]:
    """Payload and crc32 of each block of ``BLOCK_IDS`` ids; the crc is that of the ids of the
    block as little-endian unsigned 32-bit integers. No ids give no blocks."""
    n = len(ids)
    if n == 0:
        return [], []
    if int(ids.min()) < 0 or int(ids.max()) >= vocabulary:
        raise ValueError("an id lies outside the vocabulary")
    raw = as_stored(ids)
    crcs = [zlib.crc32(raw[a:a + BLOCK_IDS]) for a in range(0, n, BLOCK_IDS)]
    lanes = len(crcs)
    steps = BLOCK_IDS if lanes > 1 else n
    grid = np.zeros((steps, lanes), np.int32)
    whole = n // steps
    grid[:, :whole] = ids[:whole * steps].reshape(whole, steps).T
    if whole < lanes:
        grid[:n - whole * steps, whole] = ids[whole * steps:]
    m, out = _Model(lanes, vocabulary), _Writer(lanes)
    for t in range(steps):
        if t in REBUILD:
            m.rebuild(t, False)
        x = grid[t].astype(np.int64)
        g1, g2, f1, f2 = m.predict()
        hit1, hit2 = x == g1, x == g2
        known = hit1 | hit2
        f = f2 + f1
        at = m.atb + (x & (BUCKETS - 1))
        bucket = m.bucket_shares[at]
        member = x >> BUCKET_BITS
        same = m.last[at] == member
        width = (SHARES - m.same) // m.members
        share = (SHARES - f) * (bucket & 16383)
        below = (((f << COUNT_BITS) + (SHARES - f) * (bucket >> 14)) << SHARE_BITS) + share * ((m.same + member * width) * ~same)
        share *= np.where(same, m.same, width)
        first = np.where(hit2, 0, f2)
        below = np.where(known, first << (SHARE_BITS + COUNT_BITS), below)
        share = np.where(known, np.where(hit2, f2, f1) << (SHARE_BITS + COUNT_BITS), share)
        out.put(below, share)
        m.learn(x, hit1, hit2, f2, ~known, member, same, at)
    return out.close(), crcs


def decode(payloads: list[bytes], crcs: list[int], n: int, vocabulary: int) -> np.ndarray:
    """The ids of a segment of n ids; a block that does not match its crc raises ValueError."""
    if n == 0:
        return np.zeros(0, np.int32)
    lanes = len(payloads)
    if lanes != len(crcs) or lanes != -(-n // BLOCK_IDS):
        raise ValueError("the number of blocks does not fit the number of ids")
    steps = BLOCK_IDS if lanes > 1 else n
    grid = np.zeros((steps, lanes), np.int32)
    m, src = _Model(lanes, vocabulary), _Reader(payloads)
    m.rebuild(0, True)
    row = np.arange(lanes) * COUNTS
    for t in range(steps):
        if t in REBUILD:
            m.rebuild(t, True)
        g1, g2, f1, f2 = m.predict()
        f = f2 + f1
        v = src.look()
        top = v >> (SHARE_BITS + COUNT_BITS)
        use2, known = top < f2, top < f
        rest = np.maximum(v - (f << (SHARE_BITS + COUNT_BITS)), 0)
        unit = np.maximum(SHARES - f, 1)
        place = np.minimum((rest >> SHARE_BITS) // unit, COUNTS - 1)
        guess = np.where(use2, g2, g1)
        at = m.atb + np.where(known, guess & (BUCKETS - 1), m.bucket[row + place])
        bucket = m.bucket_shares[at]
        share = unit * (bucket & 16383)
        start = unit * (bucket >> 14) << SHARE_BITS
        inner = np.clip((rest - start) // share, 0, SHARES - 1)
        width = (SHARES - m.same) // m.members
        old = m.last[at]
        same = inner < m.same
        member = np.where(same, old, np.minimum((inner - m.same) // width, m.members - 1))
        below = (f << (SHARE_BITS + COUNT_BITS)) + start + share * ((m.same + member * width) * ~same)
        share *= np.where(same, m.same, width)
        below = np.where(known, np.where(use2, 0, f2) << (SHARE_BITS + COUNT_BITS), below)
        share = np.where(known, np.where(use2, f2, f1) << (SHARE_BITS + COUNT_BITS), share)
        src.take(below, share)
        x = np.where(known, guess, (member << BUCKET_BITS) | (at - m.atb)).astype(np.int64)
        member = x >> BUCKET_BITS
        grid[t] = x
        m.learn(x, x == g1, x == g2, f2, ~known, member, old == member, at)
    del m, src
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    raw = as_stored(ids)
    for k, crc in enumerate(crcs):
        if zlib.crc32(raw[k * BLOCK_IDS:(k + 1) * BLOCK_IDS]) != crc:
            raise ValueError(f"block {k} does not match its checksum")
    return ids

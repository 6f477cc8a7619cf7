"""Words of many texts at once, as arrays.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return (``[^\\x20\\x09-\\x0D]+``); none of these bytes occurs inside a UTF-8 character.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[list(SPACES)] = 0x20
_LOWER = _TO_SPACE.copy()
_LOWER[65:91] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (NULL: empty) in one array, and the offsets of the texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most_bytes`` of text each; a row is never cut."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(size) - size) // most_bytes
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """``data`` holds each word followed by one space or, at the end of a text, by nothing."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of words before each text; one more entry than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """The code of each word, and the distinct words by code."""
        size = self.ends - self.starts
        keep = np.ones(len(self.data), bool)
        keep[self.ends[self.ends < len(self.data)]] = False
        # a word at the end of a text has no space after it: its end is the next word's start
        keep[self.starts] = True
        flat = self.data[keep]
        offs = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offs[1:])
        a = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(flat)])
        d = a.dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def split(texts: pa.Array, lower: bool = True) -> Words:
    raw, offs = text_bytes(texts)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(len(offs), np.int64))
    space = _IS_SPACE[raw]
    before = np.empty(n, bool)  # a space, or the start of a text, stands before the byte
    before[0] = True
    before[1:] = space[:-1]
    opens = offs[:-1][offs[:-1] < offs[1:]]
    before[opens] = True
    word = ~space
    start = np.flatnonzero(word & before)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[opens[1:] - 1] = True
    end = np.flatnonzero(word & after)
    size = end - start + 1
    spaced = np.zeros(len(size), np.int64)  # whether a space follows in the same text
    keep = word
    nxt = end + 1
    inside = nxt < n
    inside[inside] = space[nxt[inside]]
    # the space belongs to the same text unless the text ends here
    closes = np.zeros(n + 1, bool)
    closes[offs[1:]] = True
    inside &= ~closes[nxt]
    spaced[inside] = 1
    keep[nxt[inside]] = True
    data = (_LOWER if lower else _TO_SPACE)[raw[keep]]
    starts = np.zeros(len(size), np.int64)
    np.cumsum((size + spaced)[:-1], out=starts[1:])
    return Words(data, starts, starts + size, np.searchsorted(start, offs))


# ---- parts -------------------------------------------------------------------------------------
# Words of Latin-1 letters (UTF-8: ASCII, or C3 and one byte but the two signs) and ASCII signs other
# than the apostrophe consist of runs of letters and runs of signs; other words are one part.
_LETTER, _SIGN, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = _SIGN


def parts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(codes, distinct parts, whether each distinct part is plain, parts before each text). Plain
    parts are runs of one kind, with ASCII letters in lower case; the others are whole words as
    they stand, among them all words with a digit, an apostrophe or ``<``."""
    w = split(texts, lower=False)
    data, starts, ends = w.data, w.starts, w.ends
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), np.zeros(0, bool), np.zeros(len(w.first), np.int64)
    kind = _KIND[data]
    lead = data == 0xC3
    # a byte of 80..BF is a letter only after C3, and C3 97 and C3 B7 are signs
    tail = (data & 0xC0) == 0x80
    odd = kind == _OTHER
    odd[1:] |= tail[1:] & ~lead[:-1]
    odd[1:] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    space = data == 0x20
    odd[space] = False
    bad = np.maximum.reduceat(odd, starts)
    # cut between letters and signs inside good words
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    inside = np.repeat(~bad, np.diff(np.append(starts, len(data))))
    cut[:-1] &= inside
    cut[starts] = True
    cut[:-1] &= ~space
    at = np.flatnonzero(cut[:-1])
    stop = np.append(at[1:], len(data))
    stop -= space[stop - 1]
    low = np.where(inside, _LOWER[data], data)
    keep = ~space
    size = stop - at
    offs = np.zeros(len(at) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    a = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(low[keep])])
    d = a.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    each = np.add.reduceat(cut[:-1], starts, dtype=np.int64)  # parts of each word
    plain = np.zeros(len(d.dictionary), bool)
    plain[codes] = np.repeat(~bad, each)  # a string is plain wherever it stands, or nowhere
    upto = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=upto[1:])
    return codes, d.dictionary, plain, upto[w.first]

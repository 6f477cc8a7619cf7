"""Token ids of documents, written as range-coded blocks and read back.

File format: Parquet, one row per segment. A segment holds the ids of consecutive documents in
ascending doc_id order (about ``SEGMENT_IDS`` ids; a document is never cut) with its document ids
and lengths, and the payload and crc32 of each block (see ``rangecoder``). Segments are decoded
alone; the place of a document among all ids follows from the lengths of the segments before.
"""
from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadrisk.llm.rangecoder import as_stored, decode, encode
from roadrisk.llm.tables import shuffle_partitions
from roadrisk.llm.words import parts, slices

END_ID = 2
SEGMENT_IDS = 1 << 23
SLICE_BYTES = 1 << 21
LEAST_BYTES, MOST_BYTES = 1 << 22, 3 << 23  #: text of a task
CACHED_PARTS = 300_000  #: parts whose ids a Python worker remembers; beyond it forgets those met once
JOINED = 500            #: parts that are encoded as one text

SEGMENT = "part int, seg int, n_ids bigint, vocabulary int, doc_id array<{id}>, length array<bigint>, block array<binary>, crc array<bigint>"


class WordEncoder:
    """Ids of whole texts from the ids of their parts.

    The tokenizer must drop white space, lower-case letters, never join what white space parts,
    and encode runs of letters and runs of signs apart (the caller's promise; ``tests/llm``
    compares whole texts). Each distinct part is then encoded once, many plain ones as one text: the
    last id of each ends in the word-end mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.vocabulary = max(names.values()) + 1
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain parts end to end, and how many belong to each."""
        groups = [parts[i:i + JOINED] for i in range(0, len(parts), JOINED)]
        ids, size = [], []
        for group, got in zip(groups, self._encoded([b" ".join(g).decode() for g in groups])):
            got = np.array(got, np.int32)
            last = np.flatnonzero(self.ends[got]) + 1
            if len(last) != len(group) or (len(got) and last[-1] != len(got)):  # no word-end marks: one by one
                one = self._encoded([p.decode() for p in group])
                got, last = np.array([i for x in one for i in x], np.int32), np.cumsum([len(x) for x in one])
            ids.append(got)
            size.append(np.diff(last, prepend=0))
        none = np.zeros(0, np.int64)
        return np.concatenate([*ids, none]).astype(np.int32), np.concatenate([*size, none]).astype(np.int64)

    def _learn(self, words: list[bytes], plain: np.ndarray) -> None:
        first = [w for w, p in zip(words, plain) if p]
        other = [w for w, p in zip(words, plain) if not p]
        ids, size = self._plain(first)
        rest = self._encoded([w.decode() for w in other])
        size = np.concatenate([size, np.array([len(x) for x in rest], np.int64)])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids, np.array([i for x in rest for i in x], np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int32)])
        self.place.update(zip(first + other, range(len(self.place), len(self.place) + len(words))))

    def _forget(self) -> None:
        """Keep the parts met in two slices or more, if they fill at most half of the cache."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > CACHED_PARTS // 2:
            return self.clear()
        words = list(self.place)
        self.place = {words[i]: k for k, i in enumerate(keep)}
        size, upto = self.size[keep], np.cumsum(self.size[keep])
        self.flat = self.flat[np.repeat(self.start[keep] - upto + size, size) + np.arange(size.sum())]
        self.start, self.size, self.met = upto - size, size, self.met[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of ids of each text."""
        codes, distinct, plain, first = parts(texts)
        words = distinct.to_pylist()
        at = list(map(self.place.get, words))
        new = [k for k, i in enumerate(at) if i is None]
        if new:
            if len(self.place) + len(new) > CACHED_PARTS:
                self._forget()
                new = [k for k, x in enumerate(words) if x not in self.place]
            self._learn([words[k] for k in new], plain[new])
            at = list(map(self.place.get, words))
        at = np.array(at, np.int64)
        self.met[at] += 1
        at = at[codes] if len(codes) else np.zeros(0, np.int64)
        size = self.size[at]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        n = upto[first[1:]] - upto[first[:-1]]
        doc = np.repeat(np.arange(len(n)), np.diff(first))  # text of each part
        out = np.full(int(upto[-1]) + len(n), END_ID, np.int32)
        steps = np.arange(upto[-1])
        out[steps + np.repeat(doc, size)] = self.flat[np.repeat(self.start[at] - upto[:-1], size) + steps]
        return out, n + 1


@functools.cache
def _encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path)


def _segments(batches, path: str):
    part, seg = TaskContext.get().partitionId(), 0
    encoder = _encoder(path)
    ids, lengths, docs, held = [], [], [], 0

    def close():
        flat = np.concatenate(ids)
        ids.clear()  # the ids stand once while they are coded
        blocks, crcs = encode(flat, encoder.vocabulary)
        doc_ids = pa.concat_arrays(docs)
        return pa.record_batch([
            pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([len(flat)], pa.int64()),
            pa.array([encoder.vocabulary], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
            pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary())),
            pa.array([crcs], pa.list_(pa.int64()))],
            ["part", "seg", "n_ids", "vocabulary", "doc_id", "length", "block", "crc"])

    for batch in batches:
        for piece in slices(batch, "text", SLICE_BYTES):
            flat, n = encoder.encode(piece.column("text"))
            ids.append(flat)
            lengths.append(n)
            docs.append(piece.column("doc_id"))
            held += len(flat)
            if held >= SEGMENT_IDS:
                yield close()
                seg += 1
                ids, lengths, docs, held = [], [], [], 0
    if held:
        yield close()


def write_ids(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Encode every text of ``docs`` (doc_id, text, ...; NULL: empty) with the tokenizer file
    and write the ids in ascending doc_id order (NULL first; repeated ids by text) to ``folder``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # many blocks of a task are coded side by side, so tasks of few bytes would waste their time
    n = max(1, -(-size // MOST_BYTES), min(shuffle_partitions(docs.sparkSession), -(-size // LEAST_BYTES)))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda it: _segments(it, tokenizer), SEGMENT.format(id=kind)).write.parquet(folder)


def _read(batches, digest: bool):
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1)
            row = {k: r.column(k)[0] for k in ("part", "seg", "n_ids", "vocabulary", "length", "block", "crc")}
            ids = decode(row["block"].as_py(), row["crc"].as_py(), row["n_ids"].as_py(), row["vocabulary"].as_py())
            docs = r.column("doc_id")[0].values
            length = row["length"].values.to_numpy(zero_copy_only=False)
            upto = np.zeros(len(length) + 1, np.int64)
            np.cumsum(length, out=upto[1:])
            same = [pa.array(np.full(len(docs), row[k].as_py(), np.int32)) for k in ("part", "seg")]
            if digest:
                raw = memoryview(as_stored(ids).view(np.uint8))
                last = pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.int64())
            else:
                last = pa.LargeListArray.from_arrays(pa.array(upto), pa.array(ids)).cast(pa.list_(pa.int32()))
            yield pa.record_batch([*same, docs, pa.array(upto[:-1]), pa.array(length), last],
                                  ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32" if digest else "ids"])


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Read the files of ``write_ids``: one row per document with doc_id, start (ids of all
    documents before it), n_tokens and ids, or with ``digest`` their crc32 as ids_crc32.
    A block that does not match its checksum fails the job."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_id"].dataType.elementType.simpleString()
    before = Window.orderBy("part", "seg").rowsBetween(Window.unboundedPreceding, -1)  # one row per segment
    place = files.select("part", "seg", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    rows = files.mapInArrow(lambda it: _read(it, digest), f"part int, seg int, doc_id {kind}, at bigint, n_tokens bigint, {last}")
    return rows.join(place, ["part", "seg"]).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", last.split()[0])

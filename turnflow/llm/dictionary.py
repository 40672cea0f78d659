"""Distinct words of chunks of documents, sent to buckets and answered.

A chunk of documents sends each of its distinct words once, to the bucket of the word's hash; a bucket
gives one answer per distinct word of the whole table and returns it to every chunk that asked. So what
travels are distinct words and answers, not occurrences, and a frequent word is sent once per chunk.
"""

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

#: Rows of a chunk: its documents (bucket DOCS), and the words it asks each bucket for.
CHUNK_ROWS = "chunk long, bucket int, payload binary"
DOCS = -1
CODEC = pa.Codec("zstd", compression_level=3)
LOW48 = np.uint64((1 << 48) - 1)
#: Bytes of text per chunk.
CHUNK = 8_000_000


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, each after its size, type and compressed size."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = CODEC.compress(raw, asbytes=True) if raw else b""
        out += [np.array([len(raw), len(small)], "<i8").tobytes(), a.dtype.str.encode().ljust(4), small]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, small = np.frombuffer(data, "<i8", 2, at).tolist()
        kind = data[at + 16 : at + 20].decode().strip()
        body = data[at + 20 : at + 20 + small]
        raw = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
        out.append(np.frombuffer(raw, kind))
        at += 20 + small
    return out


def sized(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def word_list(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as two arrays: lengths and bytes."""
    return sized(np.fromiter(map(len, words), np.int64, len(words))), np.frombuffer(b"".join(words), np.uint8)


def words_of(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a word, told by the low 48 bits of its hash."""
    return ((hashes & LOW48) % np.uint64(buckets)).astype(np.int64)


class Codes(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word) -> int:
        self[word] = code = len(self)
        return code


class Chunk:
    """Documents of one task, coded by the distinct words seen since the chunk began.

    Words may be added under keys, which `word_of` turns into words once per chunk.
    """

    def __init__(self, buckets: int, word_of=None):
        self.buckets, self.word_of, self.seq = buckets, word_of, 0
        self._clear()

    def _clear(self) -> None:
        self.code = Codes()
        self.ids, self.counts, self.codes, self.bytes = [], [], [], 0

    def add(self, ids: np.ndarray, words: list[list], n_bytes: int) -> None:
        code = self.code
        n = np.fromiter(map(len, words), np.int64, len(words))
        self.ids.append(ids)
        self.counts.append(n)
        self.codes.append(np.fromiter(map(code.__getitem__, chain.from_iterable(words)), np.uint32, int(n.sum())))
        self.bytes += n_bytes

    def rows(self, of_words=None) -> pa.RecordBatch:
        """The chunk's rows; see `documents_of` for the payload of its documents.

        Buckets get the words, or, with `of_words`, their hashes and one number each: it is called with the
        numbers of words of the documents, all codes in the order of the buckets, and the number of distinct
        words.
        """
        words = list(self.code) if self.word_of is None else [self.word_of(k) for k in self.code]
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        codes = np.concatenate([*self.codes, np.zeros(0, np.uint32)])
        # frequent words get small codes, of which the upper bytes are mostly zero
        by_rank = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[by_rank] = np.arange(len(words), dtype=np.uint32)
        codes, words = rank[codes], [words[i] for i in by_rank.tolist()]
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        bucket = buckets_of(hashes, self.buckets)
        order = np.argsort(bucket, kind="stable")
        chunk = TaskContext.get().partitionId() << 32 | self.seq
        hashes = hashes[order]
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        values = None if of_words is None else of_words(counts, _places(bucket)[codes], len(words))
        ids = np.concatenate([*self.ids, np.zeros(0, np.int64)])
        planes = [(codes >> shift & 255).astype(np.uint8) for shift in (0, 8, 16, 24)]
        out = [(DOCS, packed(ids, sized(counts), sized(bucket), *planes))]
        for b in range(self.buckets):
            if at[b] < at[b + 1]:
                part = slice(at[b], at[b + 1])
                out.append((b, packed(*word_list([words[i] for i in order[part]])) if values is None
                            else packed(hashes[part], sized(values[part]))))
        self.seq += 1
        self._clear()
        return chunk_rows(chunk, out)


def _places(bucket: np.ndarray) -> np.ndarray:
    """Place of every word in the order of the buckets, in which words are sent and answers come back."""
    place = np.empty(len(bucket), np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(len(bucket))
    return place


def documents_of(payload: bytes) -> tuple:
    """Ids of a chunk's documents, their numbers of words, all codes in the order of the buckets, and what was added."""
    ids, counts, bucket, *rest = unpacked(payload)
    codes = sum(plane.astype(np.int64) << shift for plane, shift in zip(rest[:4], (0, 8, 16, 24), strict=True))
    return ids, counts.astype(np.int64), _places(bucket)[codes], *rest[4:]


def chunk_rows(chunk: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(rows), chunk, np.int64)), pa.array([b for b, _ in rows], pa.int32()),
        pa.array([p for _, p in rows], pa.binary())], ["chunk", "bucket", "payload"])

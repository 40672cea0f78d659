"""BPE encoding by a table of distinct words, and decoding by an id-to-piece table.

Texts are split into words where the tokenizer always cuts. Every distinct word of the whole table is
encoded once, in the bucket of its hash, and its ids are joined back by the positions of the words.
"""

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnflow.llm.common import ids_back, ids_of, release, released, shuffle_parts, slices, text_slices, texts
from turnflow.llm.dictionary import CHUNK, CHUNK_ROWS, DOCS, Chunk, documents_of, packed, sized, unpacked, words_of
from turnflow.llm.words import ranges, tokenizer_of

# White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0  -     　"
#: White space and what follows it up to the next: byte-level tokenizers always cut before white space that
#: follows something else.
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Bytes of text split at a time, words encoded at a time, ids decoded at a time.
TEXT, ENCODED, DECODED = 1_000_000, 2048, 300_000


def split(text: str) -> list[str]:
    """The words of a text as short keys, see `word_of`.

    Most texts have single spaces and line ends between their words only; cutting these at the spaces gives
    all words at once. The others are cut by WORD.
    """
    keys, found = text.replace("\n", " \n").split(" "), text.split()
    # as many keys as stretches, and no white space but that between them
    if len(keys) == len(found) and len("".join(found)) == len(text) - len(keys) + 1:
        keys[0] = " " + keys[0]
        return keys
    return [w if w[0] == "\n" else " " + w for w in WORD.findall(text)]


def word_of(key: str) -> bytes:
    """The word of a key: what follows a space, all from a line end on, and else the key after a space."""
    return (key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key).encode()


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    def work(batches):
        chunk = Chunk(buckets, word_of)
        for batch in batches:
            ids, column = ids_of(batch.column("doc_id")), batch.column("text")
            for first, end, data, _ in text_slices(batch, TEXT):
                chunk.add(ids[first:end], [split(t) for t in column.slice(first, end - first).to_pylist()], len(data))
                if chunk.bytes >= CHUNK:
                    yield chunk.rows()
                    release()
        if chunk.ids:
            yield chunk.rows()

    return docs.mapInArrow(work, CHUNK_ROWS)


def _encoder(vocabulary: str):
    """Encodes the distinct words that reached one bucket and answers every chunk."""

    def work(asked: pa.Table) -> pa.Table:
        tokenizer = tokenizer_of(vocabulary.value)
        wanted = [words_of(*unpacked(p.as_py())) for p in asked.column("payload")]
        words = sorted(set().union(*wanted))
        code, ids, sizes = {w: i for i, w in enumerate(words)}, [], []
        for first in range(0, len(words), ENCODED):
            found = tokenizer.encode_batch_fast(
                [w.decode() for w in words[first : first + ENCODED]], add_special_tokens=False)
            lists = [e.ids for e in found]
            sizes += map(len, lists)
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        sizes = np.array(sizes, np.int64)
        flat, ends = np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum(sizes)
        answers = []
        for mine in wanted:
            at = np.fromiter(map(code.__getitem__, mine), np.int64, len(mine))
            answers.append(packed(sized(sizes[at]), sized(flat[ranges((ends - sizes)[at], sizes[at])])))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"),
                         "payload": pa.array(answers, pa.binary())})

    return work


def _only_words(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def _joined(coded: pa.Table, answered: pa.Table) -> pa.Table:
    """Ids of the documents of a chunk: the answers lie in the order of the words' codes."""
    order = np.argsort(answered.column("bucket").to_numpy())
    parts = [unpacked(answered.column("payload")[int(i)].as_py()) for i in order]
    size = np.concatenate([*(p[0].astype(np.int64) for p in parts), np.zeros(0, np.int64)])
    flat = np.concatenate([*(p[1].astype(np.uint32) for p in parts), np.zeros(0, np.uint32)])
    begin = np.cumsum(size) - size
    ids, lists = [], []
    for bucket, payload in zip(coded.column("bucket").to_pylist(), coded.column("payload"), strict=True):
        if bucket != DOCS:
            continue
        doc_ids, counts, codes = documents_of(payload.as_py())
        ends = np.r_[0, np.cumsum(counts)]
        total = np.r_[0, np.cumsum(size[codes])][ends]
        found = flat[ranges(begin[codes], size[codes])].astype(np.int32)
        ids.append(ids_back(doc_ids))
        lists.append(pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(found)))
    return pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "ids": pa.chunked_array(lists, pa.list_(pa.int32()))})


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, as the tokenizers library encodes the whole text without special tokens added.

    For byte-level vocabularies. Strings of special tokens in a text become their ids, as in the library. A
    null or empty text has no ids. Repeated rows and null ids stay; other columns are ignored; an empty table
    gives no rows. A chunk's documents and words cross the network once, its answers once.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    coded = _chunks(texts(docs, id_col, text_col), 2 * parts).repartition(parts, "chunk")
    answers = coded.mapInArrow(_only_words, CHUNK_ROWS).groupBy("bucket").applyInArrow(released(_encoder(shared)), CHUNK_ROWS)
    return coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(released(_joined), "doc_id long, ids array<int>")


def pieces(vocabulary: str) -> list[bytes | None]:
    """Bytes of every id of a byte-level vocabulary."""
    content = json.loads(vocabulary)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    found = {i: bytes(sign[c] for c in token) for token, i in content["model"]["vocab"].items()
             if all(c in sign for c in token)}
    found |= {t["id"]: t["content"].encode() for t in content["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found, default=-1) + 1)]


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add the column decoded: the pieces of the ids end to end, special tokens kept.

    Ids that the vocabulary lacks give nothing, as in the library; bytes that are no UTF-8 become U+FFFD. Null
    ids decode to an empty text. The id-to-piece table has one entry per id of the vocabulary and is broadcast.
    """
    table = pieces(vocabulary)
    # pieces end to end; the last, empty one stands for every id that the vocabulary lacks
    flat, size = np.frombuffer(b"".join(table), np.uint8), np.array([*map(len, table), 0])
    shared = encoded.sparkSession.sparkContext.broadcast((flat, np.cumsum(size) - size, size))
    others = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*[F.col(f"`{c}`") for c in others])

    def work(batches):
        flat, begin, size = shared.value
        for batch in batches:
            n = pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            for first, end in slices(n, DECODED):
                part = batch.slice(first, end - first)
                ids = part.column(ids_col).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ids[(ids < 0) | (ids >= len(size))] = len(size) - 1
                data = flat[ranges(begin[ids], size[ids])].tobytes()
                at = np.r_[0, np.cumsum(size[ids])][np.r_[0, np.cumsum(n[first:end])]].tolist()
                out = [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*others, "decoded"])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField("decoded", StringType())]))

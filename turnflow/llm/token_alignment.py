"""Alignment of the tokens of two tokenizers by the bytes that they cover, with corpus-wide counts of linked ids.

Texts and tokens are Arrow lists. Flattened ids give byte lengths, parent indices and cumulative sums within
a document give where every token ends. A hash join of the ends of both tokenizers on (document, end) gives
the stretches between neighbouring ends: each lies in one token of either side and so is one link, and where
both sides end a group closes. Links are counted per id pair in every chunk of documents, Spark adds the counts up, and
the pairs that a chunk asked for come back to it, where a second join gives every link its count.
"""

import hashlib
import json
import os
import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.llm.bpe_words import pieces, split, word_of
from turnflow.llm.common import ids_back, ids_of, release, shuffle_parts, side_path, text_slices, texts
from turnflow.llm.dictionary import packed, sized, unpacked
from turnflow.llm.words import ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Bytes of text per chunk, and aligned at a time; ends joined at a time; words of either tokenizer that a worker remembers.
CHUNK, SLICE, JOINED, REMEMBERED = 16_000_000, 500_000, 250_000, 150_000
#: Where the byte-fallback tokenizer writes a space, fixed by its file format.
MARK = "▁"
#: Spaces and what follows; those at the end stay with the last word, since no text of none can stand for one.
STRETCH = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")
BYTE = re.compile("<0x([0-9A-F]{2})>")
# Fixed value: where byte-level vocabularies cut a text before their merges.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose kind (letter, number, space, other) no version of Unicode has changed, so that every regular
#: expression library cuts texts of these alike; and how long a run of space or of other characters may be.
STABLE = re.compile("[\t\n\r -~\u00a0-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u2010-\u2027\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5]*")
RUN = 500


def _by_ranks(content: str, found: list[bytes]):
    """The same vocabulary for the tiktoken library, which encodes a text in a third of the time; None if it is not one of ranks.

    That needs ids in the order of the merges and the usual cuts.
    """
    import tiktoken

    about = json.loads(content)
    cuts = about.get("pre_tokenizer") or {}
    if about.get("normalizer") or cuts.get("type") != "ByteLevel" or not cuts.get("use_regex", True) or cuts.get("add_prefix_space"):
        return None
    vocab, merges = about["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in about["model"]["merges"]]
    if sorted(found[:256]) != [bytes([b]) for b in range(256)] or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    return tiktoken.Encoding("ranks", pat_str=CUTS, special_tokens={},
                             mergeable_ranks={piece: i for i, piece in enumerate(found[: 256 + len(merges)])})


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; strings of special tokens in a text are plain text."""

    def __init__(self, content: str):
        self.content, self.tokenizer = content, None
        self.pieces = [p or b"" for p in pieces(content)]
        self.ranks = _by_ranks(content, self.pieces)

    def whole(self, text: str) -> list[int] | None:
        """Ids of a space and a text without rare characters and long runs; None for any other."""
        if self.ranks is None or not STABLE.fullmatch(text):
            return None
        words = text.split()
        sizes = [*map(len, words)]
        if max(sizes, default=0) > RUN or len(text) - sum(sizes) - len(words) > RUN:
            return None
        return self.ranks.encode_ordinary(" " + text)

    def units(self, text: str) -> list[str]:
        """Keys of the stretches of a space and the text between which this tokenizer always cuts."""
        return split(" " + text)

    def encode(self, units: list[str]) -> list[list[int]]:
        if self.tokenizer is None:  # most tasks never meet a text that needs it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.content)
            self.tokenizer.encode_special_tokens = True
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
        found = self.tokenizer.encode_batch_fast([word_of(u).decode() for u in units], add_special_tokens=False)
        return [e.ids for e in found]


class ByteFallback:
    """A sentencepiece model with byte fallback that puts a space before every text."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        names = self.model.id_to_piece(list(range(self.model.get_piece_size())))
        # a piece that goes on behind a space forbids to cut there
        self.uncut = any(MARK in name.lstrip(MARK) for name in names)
        self.pieces = [self._bytes(name) for name in names]

    @staticmethod
    def _bytes(name: str) -> bytes:
        byte = BYTE.fullmatch(name)
        return bytes([int(byte[1], 16)]) if byte else name.replace(MARK, " ").encode()

    def whole(self, text: str) -> None:
        """No text is encoded in one: that of its stretches, most of which are remembered, is quicker."""

    def units(self, text: str) -> list[str]:
        """Stretches of spaces and what follows, each without its first space, which the model puts back."""
        if not text or self.uncut or MARK in text:
            return [text]
        plain = text.split(" ")
        return [u[1:] for u in STRETCH.findall(" " + text)] if "" in plain else plain

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


class Remembered:
    """Ids of the units seen so far, end to end; they are forgotten when there are over REMEMBERED."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.data = np.frombuffer(b"".join(tokenizer.pieces), np.uint8)
        self.size = np.fromiter(map(len, tokenizer.pieces), np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.lengths = pa.array(self.size)
        self._forget()

    def _forget(self) -> None:
        self.code, self.ids, self.at = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has; only an empty text has none."""
        whole = [self.tokenizer.whole(t) if t else [] for t in texts_]
        rest = [i for i, ids in enumerate(whole) if ids is None]
        n = np.fromiter((0 if ids is None else len(ids) for ids in whole), np.int64, len(whole))
        flat = np.fromiter(chain.from_iterable(ids for ids in whole if ids is not None), np.int32, int(n.sum()))
        begin = np.cumsum(n) - n
        found, n[rest] = self._by_units([texts_[i] for i in rest])
        begin[rest] = len(flat) + np.cumsum(n[rest]) - n[rest]
        return np.concatenate([flat, found])[ranges(begin, n)], n

    def _by_units(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > REMEMBERED:
            self._forget()
        units = [self.tokenizer.units(t) for t in texts_]
        n = np.fromiter(map(len, units), np.int64, len(units))
        code, new = self.code, []
        codes = np.empty(int(n.sum()), np.int64)
        for i, u in enumerate(chain.from_iterable(units)):
            k = code.get(u)
            if k is None:
                code[u] = k = len(code)
                new.append(u)
            codes[i] = k
        if new:
            lists = self.tokenizer.encode(new)
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        first, size = self.at[codes], self.at[codes + 1] - self.at[codes]
        total = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
        return self.ids[ranges(first, size)], np.diff(total)

    def spells(self, ids: np.ndarray, counts: np.ndarray, data: bytes, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each document spell a space and its text, which lies from `at` on in `data`."""
        spelt = self.data[ranges(self.begin[ids], self.size[ids])].tobytes()
        ends = np.r_[0, np.cumsum(self.size[ids])][np.r_[0, np.cumsum(counts)]]
        same = np.diff(ends) == np.diff(at) + 1
        for d in np.flatnonzero(same).tolist():
            a = int(ends[d])
            same[d] = spelt[a : a + 1] == b" " and spelt[a + 1 : int(ends[d + 1])] == data[at[d] : at[d + 1]]
        return same


_TOKENIZERS: dict = {}


def remembered(kind, content) -> Remembered:
    """The worker's own tokenizer of a file's content, kept from task to task."""
    key = kind, hashlib.sha256(content if isinstance(content, bytes) else content.encode()).digest()
    if key not in _TOKENIZERS:
        for old in [k for k in _TOKENIZERS if k[0] is kind]:
            del _TOKENIZERS[old]
        _TOKENIZERS[key] = Remembered(kind(content))
    return _TOKENIZERS[key]


def lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(document << 32 | where the token ends in it, id) of all tokens that cover bytes."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(lengths, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), ids.offsets.slice(0, len(ids)))
    key = pc.add(pc.shift_left(parent, 32), pc.subtract(total, pc.take(before, parent)))
    covering = pc.greater(pc.take(lengths, flat), 0)
    return key.filter(covering), flat.filter(covering)


def links(a: pa.ListArray, b: pa.ListArray, a_lengths: pa.Array, b_lengths: pa.Array):
    """Tables of links in the order of the text: end (document << 32 | byte), a, b, a_ends and b_ends (whether the token ends there).

    The lists hold the ids of the same documents; both sides of a document cover the same bytes. JOINED ends
    of a side are joined at a time, however long a document is.
    """
    (a_end, a_id), (b_end, b_id) = _ends(a, a_lengths), _ends(b, b_lengths)
    b_ends, first_a, first_b = b_end.to_numpy(), 0, 0
    while first_a < len(a_end):
        until_a = min(first_a + JOINED, len(a_end))
        last = a_end[until_a - 1].as_py()
        until_b = int(np.searchsorted(b_ends, last, side="right"))
        # the tokens behind the last end tell which token covers it
        left = pa.table({"end": a_end.slice(first_a, until_a + 1 - first_a), "a": a_id.slice(first_a, until_a + 1 - first_a)})
        right = pa.table({"end": b_end.slice(first_b, until_b + 1 - first_b), "b": b_id.slice(first_b, until_b + 1 - first_b)})
        met = left.join(right, "end", join_type="full outer", use_threads=False).sort_by("end")
        found = pa.table({
            "end": met["end"], "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]),
            "a_ends": met["a"].is_valid(), "b_ends": met["b"].is_valid()})
        yield found.filter(pc.less_equal(found["end"], last))
        first_a, first_b = until_a, until_b


def _counted(found: pa.Table) -> pa.Table:
    return found.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


def _planes(ids: np.ndarray) -> list[np.ndarray]:
    """Low and high halves of ids, apart; they pack better so."""
    return [(ids & 255).astype(np.uint8), sized(ids >> 8)]


def _stored(doc_ids: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> bytes:
    return packed(doc_ids, sized(n_a), sized(n_b), *_planes(a), *_planes(b))


def _restored(payload: bytes) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    doc_ids, n_a, n_b, *planes = unpacked(payload)
    a, b = (low.astype(np.int32) | high.astype(np.int32) << 8 for low, high in (planes[:2], planes[2:]))
    return doc_ids, lists(a, n_a.astype(np.int64)), lists(b, n_b.astype(np.int64))


#: Rows of some documents (their ids, packed), and of id pairs (how many links of the chunk hold them).
ENCODED = "is_pair boolean, chunk long, payload binary, a int, b int, n long"
NAMES = ["is_pair", "chunk", "payload", "a", "b", "n"]


def _encode(docs: DataFrame, shared) -> DataFrame:
    def work(batches):
        a, b = (remembered(*one) for one in shared.value)
        counts, size, seq = [], 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, end, data, at in text_slices(batch, SLICE):
                some = batch.column("text").slice(first, end - first).to_pylist()
                ids, n, good = [], [], np.diff(at) > 0
                for side in (a, b):
                    flat, counts_ = side.encode(some)
                    good &= side.spells(flat, counts_, data.tobytes(), at)
                    ids.append(flat)
                    n.append(counts_)
                for k in range(2):
                    ids[k] = ids[k][np.repeat(good, n[k])]
                    n[k] = np.where(good, n[k], 0)
                made = [_counted(t) for t in links(lists(ids[0], n[0]), lists(ids[1], n[1]), a.lengths, b.lengths)]
                counts = [_added(counts + made)] if counts + made else []
                payload = _stored(ids_of(batch.column("doc_id").slice(first, end - first)), ids[0], n[0], ids[1], n[1])
                yield from _rows([pa.array([False]), pa.array([part << 32 | seq]), pa.array([payload], pa.binary()),
                                  *[pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int64())]])
                size += len(data)
                release()
                if size >= CHUNK:
                    yield from _pair_rows(counts, part << 32 | seq)
                    counts, size, seq = [], 0, seq + 1
        yield from _pair_rows(counts, part << 32 | seq)

    return docs.mapInArrow(work, ENCODED)


def _rows(columns):
    yield from pa.table(dict(zip(NAMES, columns, strict=True))).combine_chunks().to_batches(max_chunksize=20_000)


def _pair_rows(counts: list[pa.Table], chunk: int):
    for table in counts:
        n = len(table)
        yield from _rows([pa.array(np.ones(n, bool)), pa.array(np.full(n, chunk)), pa.nulls(n, pa.binary()), table["a"], table["b"], table["n"]])


class Groups:
    """Texts of the groups `a1,a2|b1;a3|b2,b3`, put together from the strings of ids and the signs behind them."""

    def __init__(self, a_ids: int, b_ids: int):
        signs = [(a_ids, ","), (a_ids, "|"), (b_ids, ","), (b_ids, ";")]
        self.strings = pa.array([f"{i}{sign}" for size, sign in signs for i in range(size)], pa.large_string())
        self.base = np.cumsum([0, *(size for size, _ in signs[:-1])])

    def text(self, found: pa.Table, documents: int) -> pa.Array:
        """One text per document; `found` holds all links of all documents."""
        a_ends, b_ends = (found[c].to_numpy() for c in ("a_ends", "b_ends"))
        closes = a_ends & b_ends
        group = np.cumsum(closes) - closes
        sides, places = [], []
        of_a, of_b = group[a_ends], group[b_ends]
        groups = int(closes.sum())
        # tokens of a group: its own a tokens, then its own b tokens
        places.append(np.arange(len(of_a)) + np.searchsorted(of_b, np.arange(groups))[of_a])
        places.append(np.arange(len(of_b)) + np.searchsorted(of_a, np.arange(groups), side="right")[of_b])
        for k, ends in enumerate((a_ends, b_ends)):
            last = closes[ends]
            sides.append(found["ab"[k]].to_numpy()[ends] + self.base[2 * k + last.astype(np.int64)])
        index = np.empty(len(of_a) + len(of_b), np.int64)
        for place, side in zip(places, sides, strict=True):
            index[place] = side
        doc = found["end"].to_numpy() >> 32
        tokens = np.bincount(doc, weights=a_ends.astype(np.int64) + b_ends, minlength=documents).astype(np.int64)
        # the strings lie end to end, so a document's text is theirs from its first to its last
        strings = pc.take(self.strings, pa.array(index))
        at = np.frombuffer(strings.buffers()[1], np.int64)[np.r_[0, np.cumsum(tokens)]]
        joined = pa.Array.from_buffers(pa.large_string(), documents, [None, pa.py_buffer(at), strings.buffers()[2]])
        return pc.utf8_rtrim(joined, ";")


_GROUPS: dict = {}


def _aligned(shared):
    def work(docs: pa.Table, counts: pa.Table) -> pa.Table:
        _TOKENIZERS.clear()  # all texts are encoded
        a_lengths, b_lengths = (pa.array(x) for x in shared.value)
        sizes = len(a_lengths), len(b_lengths)
        if sizes not in _GROUPS:
            _GROUPS.clear()
            _GROUPS[sizes] = Groups(*sizes)
        counts = counts.select(["a", "b", "count", "best"])
        out = []
        for payload in docs["payload"]:
            doc_ids, *ids = _restored(payload.as_py())
            n = len(doc_ids)
            total = np.zeros((4, n), np.int64)  # groups, links, best, sum of counts
            kept = []
            for found in links(*ids, a_lengths, b_lengths):
                kept.append(found)
                joined = found.append_column("doc", pc.shift_right(found["end"], 32)).join(counts, ["a", "b"], use_threads=False)
                closes = pc.and_(joined["a_ends"], joined["b_ends"])
                sums = joined.append_column("closes", closes).group_by("doc", use_threads=False).aggregate(
                    [("closes", "sum"), ([], "count_all"), ("best", "sum"), ("count", "sum")])
                for k, c in enumerate(("closes_sum", "count_all", "best_sum", "count_sum")):
                    np.add.at(total[k], sums["doc"].to_numpy(), sums[c].to_numpy().astype(np.int64))
            text = _GROUPS[sizes].text(pa.concat_tables(kept), n) if kept else pa.array([""] * n, pa.large_string())
            del kept
            release()
            out.append(pa.table({
                "doc_id": ids_back(doc_ids), "n_a": pc.cast(pc.list_value_length(ids[0]), pa.int64()),
                "n_b": pc.cast(pc.list_value_length(ids[1]), pa.int64()), "n_groups": total[0], "n_links": total[1],
                "n_best": total[2], "count_sum": total[3], "groups": pc.cast(text, pa.string())}))
        release()
        return pa.concat_tables(out)

    return work


def align(docs: DataFrame, byte_level: str, byte_fallback: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    Side A are the ids of a space and the text by the byte-level vocabulary (content of a tokenizers file), side B
    those of the text by the sentencepiece model (content of its file), both without special tokens. Byte
    offsets where tokens of both sides end cut them into groups, `a1,a2|b1;a3|b2,b3`. A link is a pair of tokens
    of either side whose byte ranges overlap. The count of an id pair is how many links of all documents hold it;
    n_best are the document's links whose count is the highest that their B id has, ties included, and
    count_sum adds the counts of its links. A null or empty text, or one that either side does not spell out
    byte by byte (such as one with U+2581), has no tokens: zeros and an empty string. Repeated rows and null ids
    stay, and count; other columns are ignored; an empty table gives no rows.

    Ids and counts per chunk are written once to the shared folder, bucketed by chunk, and the ids stay where they are:
    what is exchanged is one row per id pair and chunk.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(((ByteLevel, byte_level), (ByteFallback, byte_fallback)))
    lengths = tuple(np.fromiter(map(len, kind(content).pieces), np.int64) for kind, content in shared.value)
    name = f"alignment_{uuid.uuid4().hex}"
    encoded = _encode(texts(docs, id_col, text_col), shared)
    (encoded.write.partitionBy("is_pair").bucketBy(shuffle_parts(spark), "chunk").option("path", side_path(spark, "alignment"))
     .saveAsTable(name))
    ids = spark.table(name).where(~F.col("is_pair")).select("chunk", "payload")
    pairs = spark.table(name).where("is_pair").select(F.col("chunk").alias("asking"), "a", "b", "n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    ranked = counts.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    asked = pairs.select("asking", "a", "b").join(ranked, ["a", "b"]).select("asking", "a", "b", "count", "best")
    return ids.groupBy("chunk").cogroup(asked.groupBy("asking")).applyInArrow(
        _aligned(spark.sparkContext.broadcast(lengths)),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")

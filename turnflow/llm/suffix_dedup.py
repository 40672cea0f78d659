"""Suffix-array dedup: bytes covered by a string that also starts in a document with a smaller id are removed.

Every window of WINDOW bytes belongs to the smallest hash among its short substrings, so equal windows
meet in the bucket of that hash, wherever they occur. A first exchange finds the hashes that more than one
document has; only the segments of text around these travel. In a bucket, Burrows-Wheeler transforms of
the segments are built per shard and merged, and the blocks of suffixes with WINDOW bytes in common tell
which windows are repeated and the smallest id that has them. Equal segments count once before that.
A hash with very many segments, such as that of a frequent phrase, would make one large merge: its windows
are dealt one by one, by a hash of all their bytes, and equal ones meet as before.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from turnflow.llm.bwt_merge import Shard, merged_blocks
from turnflow.llm.common import ids_back, ids_of, release, released, shuffle_parts, text_slices, texts
from turnflow.llm.dictionary import CHUNK_ROWS, DOCS, chunk_rows, packed, sized, unpacked

#: Bytes of a repeated string; of the substrings that are hashed; windows of a segment at most.
WINDOW, GRAM, SEGMENT = 50, 16, 36
#: Bytes of text per chunk and hashed at a time; suffixes merged at a time; shards of a merge.
CHUNK, SLICE, MERGED, SHARDS = 8_000_000, 500_000, 300_000, 8
#: Segments of a hash beyond which its windows are dealt one by one; occurrences in a chunk up to which each counts as one.
MANY, FEW = 10_000, 8
#: Low bits that a hash leaves out when it travels; its bucket is known beside it.
CUT = np.uint64(24)


def _least_hashes(data: np.ndarray) -> np.ndarray:
    """For every window of WINDOW bytes the smallest hash of its substrings of GRAM bytes."""
    n = len(data) - GRAM + 1
    padded = np.r_[data, np.zeros(8, np.uint8)]
    load = lambda at, kind: np.ndarray(n, kind, padded, at, (1,)).astype(np.uint64)
    h = load(0, "<u8") * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += load(8, "<u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    span = WINDOW - GRAM + 1
    width, least = 1, h
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (span - width)], least[span - width :])


def _segments(data: np.ndarray, at: np.ndarray):
    """(hash, document, begin in the text, windows) of the segments of texts that lie end to end."""
    out, first = [], 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, side="right")) - 1)
        part = data[at[first] : at[end]]
        if len(part) >= WINDOW:
            out.append(_cut(_least_hashes(part), at[first : end + 1] - at[first], first))
        first = end
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _cut(least: np.ndarray, at: np.ndarray, first_doc: int):
    """Runs of windows of one document with the same least hash, in pieces of at most SEGMENT."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    valid = np.arange(len(least)) + WINDOW <= at[1:][doc]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(fresh & valid)
    if not len(begin):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    edge = np.flatnonzero(np.r_[fresh | ~valid, True])
    size = edge[np.searchsorted(edge, begin, side="right")] - begin
    pieces = -(-size // SEGMENT)
    which = np.repeat(np.arange(len(begin)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[which] + nth * SEGMENT
    n = np.minimum(size[which] - nth * SEGMENT, SEGMENT)
    return least[start], doc[start] + first_doc, start - at[doc[start]], n


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of chunks: the documents, and for each bucket the hashes they have, asking who else has them.

    Columns besides doc_id and text go along with the documents.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]

    def made(ids, data, more, seq):
        ids, sizes = np.concatenate(ids), np.concatenate([np.diff(a) for _, a in data])
        whole, at = np.concatenate([d for d, _ in data]), np.r_[0, np.cumsum(sizes)]
        hashes, doc, begin, n = _segments(whole, at)
        start = at[doc] + begin

        def distinct(members):
            return len({whole[a:b].tobytes() for a, b in zip(start[members], start[members] + n[members] + WINDOW - 1)})

        out = [(DOCS, packed(ids, sized(sizes), whole, _stored(more)))]
        for b, asked, several, held in _asked(hashes, ids[doc], buckets, distinct):
            more_than_one = np.flatnonzero(held > 1)
            out.append((b, packed(sized(np.diff(asked, prepend=np.uint64(0))), np.packbits(several),
                                  sized(np.diff(more_than_one, prepend=0)), sized(held[more_than_one]))))
        return chunk_rows(TaskContext.get().partitionId() << 32 | seq, out)

    def work(batches):
        ids, data, more, size, seq = [], [], [], 0, 0
        for batch in batches:
            all_ids = ids_of(batch.column("doc_id"))
            for first, end, text, at in text_slices(batch, CHUNK // 8):
                ids.append(all_ids[first:end])
                data.append((text, at))
                more.append(batch.select(others).slice(first, end - first))
                size += len(text)
                if size >= CHUNK:
                    yield made(ids, data, more, seq)
                    release()
                    ids, data, more, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield made(ids, data, more, seq)

    return docs.mapInArrow(work, CHUNK_ROWS)


def _stored(batches: list[pa.RecordBatch]) -> np.ndarray:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as out:
        for batch in batches:
            out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _asked(hashes: np.ndarray, ids: np.ndarray, buckets: int, distinct):
    """For each bucket the distinct hashes asked for, cut and in order, whether several ids of the chunk have them,
    and how many segments; `distinct` tells how many of some segments differ."""
    bucket, short = (hashes % np.uint64(buckets)).astype(np.int64), hashes >> CUT
    order = np.lexsort((ids, short, bucket))
    bucket, short, ids = bucket[order], short[order], ids[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])
    at = np.flatnonzero(fresh)
    ends = np.r_[at[1:], len(order)] - 1
    several = ids[at] != ids[ends] if len(at) else np.zeros(0, bool)
    held = np.diff(np.r_[at, len(order)])
    for k in np.flatnonzero(held > FEW).tolist():
        held[k] = distinct(order[at[k] : at[k] + held[k]])
    edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            part = slice(edges[b], edges[b + 1])
            yield b, short[at[part]], several[part], held[part]


def _no_docs(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def _shared_hashes(many: int):
    """Tells each chunk which of its hashes of one bucket several documents, or another chunk, have.

    Then which of its hashes have more than `many` segments; equal segments of different chunks count in each.
    """

    def work(asked: pa.Table) -> pa.Table:
        mine, own, more_held = [], [], []
        for p in asked.column("payload"):
            steps, several, where, held = unpacked(p.as_py())
            mine.append(np.cumsum(steps.astype(np.uint64)))
            own.append(np.unpackbits(several)[: len(steps)].astype(bool))
            more_held.append((np.cumsum(where.astype(np.int64)), held.astype(np.int64)))
        every, counts = np.unique(np.concatenate(mine), return_counts=True)
        segments = counts.copy()
        for hashes, (where, held) in zip(mine, more_held, strict=True):
            segments[np.searchsorted(every, hashes[where])] += held - 1
        frequent, out = every[segments > many], []
        for hashes, several in zip(mine, own, strict=True):
            more = counts[np.searchsorted(every, hashes)] > 1
            out.append(packed(hashes[more | several], np.intersect1d(frequent, hashes, assume_unique=True)))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"),
                         "payload": pa.array(out, pa.binary())})

    return work


def _single_windows(many: np.ndarray, raw: bytes, at: np.ndarray, hashes, doc, begin, n):
    """The segments, those marked in `many` as windows of their own under a hash of all their bytes."""
    which = np.repeat(np.flatnonzero(many), n[many])
    nth = np.arange(len(which)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
    start = begin[which] + nth
    where = (at[doc[which]] + start).tolist()
    whole = np.fromiter((xxhash.xxh64_intdigest(raw[a : a + WINDOW]) for a in where), np.uint64, len(where))
    rest = ~many
    return (np.r_[hashes[rest], whole], np.r_[doc[rest], doc[which]], np.r_[begin[rest], start],
            np.r_[n[rest], np.ones(len(which), np.int64)])


def _sending(buckets: int):
    """Of a chunk: its distinct segments with a shared hash, for the buckets, and where they occur, for itself."""

    def work(coded: pa.Table, answers: pa.Table) -> pa.Table:
        shared, frequent = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload"), strict=True):
            for found, own in zip((shared, frequent), unpacked(p.as_py()), strict=True):
                found.append(own * np.uint64(buckets) + np.uint64(b))
        shared, frequent = np.sort(np.concatenate(shared)), np.concatenate(frequent)
        chunk, ids, sizes, whole, _ = _documents(coded)
        at = np.r_[0, np.cumsum(sizes)]
        hashes, doc, begin, n = _segments(whole, at)
        known = (hashes >> CUT) * np.uint64(buckets) + hashes % np.uint64(buckets)
        keep = np.isin(known, shared)
        hashes, doc, begin, n = hashes[keep], doc[keep], begin[keep], n[keep]
        raw = whole.tobytes()
        if len(frequent):
            hashes, doc, begin, n = _single_windows(np.isin(known[keep], frequent), raw, at, hashes, doc, begin, n)
        order = np.lexsort((hashes, hashes % np.uint64(buckets)))
        hashes, doc, begin, n = hashes[order], doc[order], begin[order], n[order]
        start = at[doc] + begin
        text = [raw[a:b] for a, b in zip(start.tolist(), (start + n + WINDOW - 1).tolist())]
        code: dict[bytes, int] = {}
        segment = np.fromiter((code.setdefault(t, len(code)) for t in text), np.int64, len(text))
        least = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(least, segment, ids[doc])
        first = np.unique(segment, return_index=True)[1]  # segments are numbered in the order of their buckets
        placed = np.argsort(start)
        out = [(DOCS, packed(sized(np.diff(start[placed], prepend=0)), sized(n[placed]), sized(segment[placed])))]
        names, their = list(code), hashes[first]
        edges = np.searchsorted((their % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
        for b in range(buckets):
            a, e = edges[b], edges[b + 1]
            if a < e:
                mine = names[a:e]
                out.append((b, packed(
                    sized(np.diff(their[a:e] >> CUT, prepend=np.uint64(0))), least[a:e], sized(np.fromiter(map(len, mine), np.int64, len(mine))),
                    np.frombuffer(b"".join(mine), np.uint8))))
        return pa.Table.from_batches([chunk_rows(chunk, out)])

    return work


def _documents(coded: pa.Table):
    """(chunk, ids, sizes, bytes end to end, other columns) of the row that holds a chunk's documents."""
    for chunk, bucket, payload in zip(coded.column("chunk"), coded.column("bucket"), coded.column("payload"), strict=True):
        if bucket.as_py() == DOCS:
            ids, sizes, whole, more = unpacked(payload.as_py())
            others = pa.ipc.open_stream(more.tobytes()).read_all()
            return chunk.as_py(), ids, sizes.astype(np.int64), whole, others
    raise ValueError("a chunk without documents")


def _least_ids(sent: pa.Table) -> pa.Table:
    """Tells each chunk, for every window of its segments, the smallest id that has the window anywhere."""
    hashes, least, size, data, owner = [], [], [], [], []
    for k, p in enumerate(sent.column("payload")):
        h, ids, n, raw = unpacked(p.as_py())
        hashes.append(np.cumsum(h.astype(np.uint64)))
        least.append(ids)
        size.append(n.astype(np.int64))
        data.append(raw.tobytes())
        owner.append(np.full(len(h), k))
    hashes, least, size, owner = (np.concatenate(x) for x in (hashes, least, size, owner))
    raw, ends = b"".join(data), np.cumsum(size)
    text = [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist())]
    code: dict[bytes, int] = {}
    same = np.fromiter((code.setdefault(t, len(code)) for t in text), np.int64, len(text))
    first = np.unique(same, return_index=True)[1]
    names, their = list(code), hashes[first]
    ids = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(ids, same, least)
    windows = size[first] - WINDOW + 1
    begin = np.cumsum(windows) - windows
    found = np.repeat(ids, windows)  # right for a segment that has its hash, as it travelled, alone
    order = np.argsort(their, kind="stable")
    group = np.r_[True, their[order][1:] != their[order][:-1]]
    starts = np.flatnonzero(group)
    sizes = np.diff(np.r_[starts, len(order)])
    pending, total = [], 0
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        members = order[a : a + n]
        pending.append(members)
        total += int(size[first[members]].sum()) + n
        if total >= MERGED:
            _merge(np.concatenate(pending), names, ids, owner[first], begin, found)
            pending, total = [], 0
    if pending:
        _merge(np.concatenate(pending), names, ids, owner[first], begin, found)
    out = []
    for k in range(len(sent)):
        mine = same[owner == k]
        n = windows[mine]
        ends = np.cumsum(n)
        values = found[np.repeat(begin[mine] - (ends - n), n) + np.arange(int(n.sum()))]
        out.append(packed(values))
    return pa.table({"chunk": sent.column("chunk"), "bucket": sent.column("bucket"), "payload": pa.array(out, pa.binary())})


def _merge(members, names, ids, owner, begin, found) -> None:
    """Set the smallest id of every window of the member segments, by merging the transforms of their shards."""
    shard = owner[members] % SHARDS
    parts = [members[shard == s] for s in np.unique(shard)]
    shards = [Shard([names[i] for i in part]) for part in parts]
    blocks = merged_blocks(shards, WINDOW)
    least = np.full(1 + max(int(b.max()) for b in blocks), np.iinfo(np.int64).max)
    starts = []
    for part, s, block in zip(parts, shards, blocks, strict=True):
        window = s.offset + WINDOW <= s.lengths[s.string]
        string, block = part[s.string[window]], block[window]
        np.minimum.at(least, block, ids[string])
        starts.append((begin[string] + s.offset[window], block))
    for at, block in starts:
        found[at] = least[block]


def _removing(coded: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk with what is removed from each."""
    _, ids, sizes, whole, more = _documents(coded)
    at = np.r_[0, np.cumsum(sizes)]
    where, parts = None, {}
    for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload"), strict=True):
        if b == DOCS:
            where = unpacked(p.as_py())
        else:
            parts[b] = unpacked(p.as_py())[0]
    edge = np.zeros(len(whole) + 1, np.int64)
    if where is not None and len(where[0]):
        steps, n, segment = (x.astype(np.int64) for x in where)
        begin = np.cumsum(steps)
        doc = np.searchsorted(at, begin, side="right") - 1
        least = np.concatenate([parts[b] for b in sorted(parts)])
        windows = np.zeros(int(segment.max()) + 1, np.int64)
        windows[segment] = n
        first = np.cumsum(windows) - windows
        ends = np.cumsum(n)
        nth = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        which = np.repeat(np.arange(len(n)), n)
        repeated = least[first[segment[which]] + nth] < ids[doc[which]]
        start = begin[which[repeated]] + nth[repeated]
        edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + WINDOW, minlength=len(edge))
    gone = np.cumsum(edge)[:-1] > 0
    kept, spans = [], []
    for d in range(len(ids)):
        a, b = int(at[d]), int(at[d + 1])
        mine = gone[a:b]
        kept.append(whole[a:b][~mine].tobytes())
        cut = np.flatnonzero(np.diff(np.r_[False, mine, False])) if mine.any() else ()
        spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(cut[::2], cut[1::2])])
    own = [ids_back(ids), pa.array(sizes), pa.array(spans, SPANS), pa.array(kept, pa.binary())]
    return pa.Table.from_arrays([*own, *more.columns], [*OWN, *more.schema.names])


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
OWN = ["doc_id", "n_bytes", "removed", "kept"]
KEPT = StructType([
    StructField("doc_id", LongType()), StructField("n_bytes", LongType()),
    StructField("removed", ArrayType(StructType([StructField("begin", LongType()), StructField("end", LongType())]))),
    StructField("kept", BinaryType())])


def remove_repeats(docs: DataFrame, carried: tuple[str, ...] = (), id_col: str = "doc_id",
                   text_col: str = "text", many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, removed (maximal runs of removed bytes, begin and end) and kept (the remaining bytes).

    A byte of a text, as UTF-8, is removed if a string of WINDOW bytes that covers it also starts in a document
    with a smaller id; strings never cross documents and are judged on the input. Documents with the same id do
    not remove from one another; a null id is the smallest. A null or empty text, or one under WINDOW bytes,
    loses nothing. Repeated rows stay. Columns named in `carried`, none of them called like the four, are added;
    others are ignored. An empty table gives no rows. Texts cross the network once; what else travels are hashes and the segments that have one in common with others.
    Of a hash with more than `many` segments every window travels by itself; `many` changes no result.
    """
    parts = shuffle_parts(docs.sparkSession)
    buckets = 2 * parts
    rows = texts(docs, id_col, text_col, *carried)
    schema = StructType([*KEPT.fields, *[rows.schema[c] for c in carried]])
    coded = _chunks(rows, buckets).repartition(parts, "chunk")
    shared = coded.mapInArrow(_no_docs, CHUNK_ROWS).groupBy("bucket").applyInArrow(released(_shared_hashes(many)), CHUNK_ROWS)
    sent = (
        coded.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(released(_sending(buckets)), CHUNK_ROWS)
        .repartition(parts, "chunk"))
    least = sent.mapInArrow(_no_docs, CHUNK_ROWS).groupBy("bucket").applyInArrow(released(_least_ids), CHUNK_ROWS)
    own = sent.mapInArrow(_only_docs, CHUNK_ROWS)
    return coded.groupBy("chunk").cogroup(own.unionByName(least).groupBy("chunk")).applyInArrow(
        released(_removing), schema)


def _only_docs(batches):
    for batch in batches:
        yield batch.filter(pc.equal(batch.column("bucket"), DOCS))


def kept_text(removed: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the remaining bytes as text; what a cut leaves of a character is dropped."""
    others = [c for c in removed.columns if c != text_col]
    rows = removed.select(*[F.col(f"`{c}`") for c in others])

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text = [b.decode("utf-8", "ignore") for b in part.column("kept").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*others, text_col])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(text_col, StringType())]))

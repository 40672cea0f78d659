"""Substring dedup by seed and extend: words covered by a run of WINDOW words that also starts earlier are removed.

Seeds are runs of SEED words, winnowed: every window of WINDOW words takes the seed of least hash that lies in
it as its anchor, so equal windows have equal anchors at the same place, and a text has an anchor every seven words or
so. A first exchange finds the anchors that occur more than once. Only these are joined: each occurrence goes to
the bucket of its anchor with the words around it that its windows reach. There all occurrences of an anchor
are extended together, word by word to the right and to the left: occurrences that agree so far form a class, a
class splits where the next words differ, and an occurrence alone in its class stops. A window is a repeat if
others share its class to the left and its class to the right; the least (document, start) among them is known for
all, without comparing pairs. Runs of repeated windows make up the maximal repeats, whose words are removed.

An anchor with very many different surroundings, such as a frequent phrase, is extended to whole windows before
it travels, so that its occurrences spread over the buckets of these.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from turnflow.llm.common import ids_back, ids_of, release, released, shuffle_parts, text_slices, texts
from turnflow.llm.dictionary import CHUNK_ROWS, DOCS, Codes, chunk_rows, packed, sized, unpacked

#: Words of a repeat at least, of a seed, and beside the seed in a window.
WINDOW, SEED = 20, 8
BESIDE = WINDOW - SEED
#: Bytes of text per chunk; words around anchors that are extended together.
CHUNK, TOGETHER = 8_000_000, 3_000_000
#: Different surroundings of an anchor beyond which it is extended to whole windows before it travels.
MANY = 10_000
#: Low bits that a hash leaves out when it travels; its bucket is known beside it.
CUT = np.uint64(24)


class Text:
    """Words of documents end to end: their hashes, bytes, and the place of each document's first word."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        raw = data.tobytes()
        ends = np.cumsum(sizes)
        split = [raw[a:b].split() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        self.words = [w for doc in split for w in doc]
        self.at = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
        code = Codes()
        codes = np.fromiter(map(code.__getitem__, self.words), np.int64, len(self.words))
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, code), np.uint64, len(code))[codes]


def _seed_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every run of SEED words, from the words' hashes."""
    n = len(words) - SEED + 1
    h = np.zeros(n, np.uint64)
    for k in range(SEED):
        h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(hashes: np.ndarray, at: np.ndarray):
    """(hash, document, place of the seed, first window, windows) of runs of windows that share one anchor.

    Places are those of words in the texts end to end; `at` is where each document begins and the last ends.
    """
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    least = _seed_hashes(hashes)
    seed = np.arange(len(least))
    width, span = 1, BESIDE + 1
    while width < span:  # the first of the least hashes among `width` seeds, then among more
        step = min(width, span - width)
        left, right = least[: len(least) - step], least[step:]
        keep = left <= right
        least, seed = np.where(keep, left, right), np.where(keep, seed[: len(left)], seed[step:])
        width += step
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = np.arange(n) + WINDOW <= at[1:][doc]
    fresh = np.ones(n, bool)
    fresh[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(fresh & valid)
    edge = np.flatnonzero(np.r_[fresh | ~valid, True])
    size = edge[np.searchsorted(edge, begin, side="right")] - begin
    return least[begin], doc[begin], seed[begin], begin, size


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of chunks: the documents, and for each bucket the anchors they have, asking which occur again."""

    def made(ids, data, seq):
        sizes = np.concatenate([np.diff(a) for _, a in data])
        whole = np.concatenate([d for d, _ in data])
        text = Text(whole, sizes)
        hashes, _, _, begin, n = anchors(text.hashes, text.at)

        def different(members):
            return len({tuple(text.words[a:b]) for a, b in zip(begin[members].tolist(), (begin + n + WINDOW - 1)[members].tolist())})

        out = [(DOCS, packed(np.concatenate(ids), sized(sizes), whole))]
        order = np.lexsort((hashes, hashes % np.uint64(buckets)))
        bucket, short = (hashes[order] % np.uint64(buckets)).astype(np.int64), hashes[order] >> CUT
        at = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])]) if len(order) else np.zeros(0, np.int64)
        held = np.diff(np.r_[at, len(order)])
        kinds = held.copy()
        for k in np.flatnonzero(held > 8).tolist():
            kinds[k] = different(order[at[k] : at[k] + held[k]])
        edges = np.searchsorted(bucket[at], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            more = np.flatnonzero(held[part] > 1)
            out.append((b, packed(sized(np.diff(short[at[part]], prepend=np.uint64(0))), sized(np.diff(more, prepend=0)),
                                  sized(kinds[part][more]))))
        return chunk_rows(TaskContext.get().partitionId() << 32 | seq, out)

    def work(batches):
        ids, data, size, seq = [], [], 0, 0
        for batch in batches:
            all_ids = ids_of(batch.column("doc_id"))
            for first, end, text, at in text_slices(batch, CHUNK // 8):
                ids.append(all_ids[first:end])
                data.append((text, at))
                size += len(text)
                if size >= CHUNK:
                    yield made(ids, data, seq)
                    release()
                    ids, data, size, seq = [], [], 0, seq + 1
        if ids:
            yield made(ids, data, seq)

    return docs.mapInArrow(work, CHUNK_ROWS)


def _asking(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def _only_docs(batches):
    for batch in batches:
        yield batch.filter(pc.equal(batch.column("bucket"), DOCS))


def _repeated(many: int):
    """Tells each chunk which of its anchors of one bucket occur more than once anywhere, and which have more than `many` surroundings."""

    def work(asked: pa.Table) -> pa.Table:
        mine, more = [], []
        for p in asked.column("payload"):
            steps, where, kinds = unpacked(p.as_py())
            mine.append(np.cumsum(steps.astype(np.uint64)))
            more.append((np.cumsum(where.astype(np.int64)), kinds.astype(np.int64)))
        every, counts = np.unique(np.concatenate(mine), return_counts=True)
        surroundings = counts.copy()
        for hashes, (where, kinds) in zip(mine, more, strict=True):
            surroundings[np.searchsorted(every, hashes[where])] += kinds - 1
        frequent, out = every[surroundings > many], []
        for hashes, (where, _) in zip(mine, more, strict=True):
            again = counts[np.searchsorted(every, hashes)] > 1
            again[where] = True
            out.append(packed(hashes[again], np.intersect1d(frequent, hashes, assume_unique=True)))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "payload": pa.array(out, pa.binary())})

    return work


def _whole_windows(many: np.ndarray, text: Text, hashes, doc, seed, begin, n):
    """The occurrences, those marked in `many` as one for each of their windows, under a hash of all its words."""
    which = np.repeat(np.flatnonzero(many), n[many])
    start = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
    whole = np.fromiter((xxhash.xxh64_intdigest(text.hashes[a : a + WINDOW].tobytes()) for a in start.tolist()), np.uint64, len(start))
    rest = ~many
    return (np.r_[hashes[rest], whole], np.r_[doc[rest], doc[which]], np.r_[seed[rest], start], np.r_[begin[rest], start],
            np.r_[n[rest], np.ones(len(which), np.int64)])


def _sending(buckets: int):
    """Of a chunk: the different surroundings of its repeated anchors, for the buckets, and where they occur, for itself.

    Of equal surroundings the least (document, start) travels.
    """

    def work(coded: pa.Table, answers: pa.Table) -> pa.Table:
        again, frequent = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload"), strict=True):
            for found, own in zip((again, frequent), unpacked(p.as_py()), strict=True):
                found.append(own * np.uint64(buckets) + np.uint64(b))
        chunk, ids, sizes, whole = _documents(coded)
        text = Text(whole, sizes)
        found = anchors(text.hashes, text.at)
        known = (found[0] >> CUT) * np.uint64(buckets) + found[0] % np.uint64(buckets)
        keep = np.isin(known, np.concatenate(again))
        found, often = [x[keep] for x in found], np.isin(known[keep], np.concatenate(frequent))
        if often.any():
            found = _whole_windows(often, text, *found)
        order = np.lexsort((found[0], found[0] % np.uint64(buckets)))
        hashes, doc, seed, begin, n = (x[order] for x in found)
        code = Codes()
        around = [(h, s, b" ".join(text.words[a:e])) for h, s, a, e in
                  zip(hashes.tolist(), (seed - begin).tolist(), begin.tolist(), (begin + n + WINDOW - 1).tolist())]
        kind = np.fromiter(map(code.__getitem__, around), np.int64, len(around))
        start = begin - text.at[doc]
        by_place = np.lexsort((start, ids[doc], kind))
        first = by_place[np.r_[True, kind[by_place][1:] != kind[by_place][:-1]]] if len(kind) else by_place
        placed = np.argsort(begin)
        rows = [(DOCS, packed(sized(np.diff(begin[placed], prepend=0)), sized(n[placed]), sized(kind[placed]),
                              ids[doc[first]], sized(start[first])))]
        their = hashes[first]
        edges = np.searchsorted((their % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))
        names = list(code)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            mine = first[part]
            rows.append((b, packed(
                sized(np.diff(their[part] >> CUT, prepend=np.uint64(0))), ids[doc[mine]], sized(start[mine]), sized(seed[mine] - begin[mine]),
                sized(n[mine]), np.frombuffer(b"\n".join(w for _, _, w in names[part]), np.uint8))))
        return pa.Table.from_batches([chunk_rows(chunk, rows)])

    return work


def _documents(coded: pa.Table):
    """(chunk, ids, sizes, bytes end to end) of the row that holds a chunk's documents."""
    for chunk, bucket, payload in zip(coded.column("chunk"), coded.column("bucket"), coded.column("payload"), strict=True):
        if bucket.as_py() == DOCS:
            ids, sizes, whole = unpacked(payload.as_py())
            return chunk.as_py(), ids, sizes.astype(np.int64), whole
    raise ValueError("a chunk without documents")


def _refined(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes split by one more word; -1 for what is alone."""
    _, inverse, counts = np.unique(classes * np.int64(1 << 31) + words, return_inverse=True, return_counts=True)
    return np.where(counts[inverse] > 1, inverse, -1)


def _extended(classes: np.ndarray, words: np.ndarray, at: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Class of every occurrence after 0, 1, ... BESIDE words from `at` on in direction `step`; -1 once alone or out of room."""
    out = np.full((BESIDE + 1, len(at)), -1, np.int64)
    out[0] = classes
    for k in range(1, BESIDE + 1):
        live = np.flatnonzero((out[k - 1] >= 0) & (room >= k))
        if not len(live):
            break
        out[k, live] = _refined(out[k - 1, live], words[at[live] + step * (k - 1)])
    return out


def first_windows(hashes, ids, start, left, n, words, base) -> np.ndarray:
    """For every window of every occurrence, one after the other, whether no equal window starts earlier.

    An occurrence is `n` windows, the first of which starts at `start` in document `ids`; its words lie in `words`
    from `base` on and its seed `left` words behind that.
    """
    seed = base + left
    right = WINDOW + n - 1 - left - SEED
    classes = np.unique(hashes, return_inverse=True)[1]
    for k in range(SEED):  # the seeds' words themselves, whatever their hashes
        live = np.flatnonzero(classes >= 0)
        classes[live] = _refined(classes[live], words[seed[live] + k])
    rightward = _extended(classes, words, seed + SEED, right, 1)
    leftward = _extended(classes, words, seed - 1, left, -1)
    ends = np.cumsum(n)
    first = np.ones(int(ends[-1]) if len(ends) else 0, bool)
    for k in range(BESIDE + 1):  # windows with k words to the left of the seed
        mine = np.flatnonzero((left >= k) & (right >= BESIDE - k) & (leftward[k] >= 0) & (rightward[BESIDE - k] >= 0))
        if not len(mine):
            continue
        window = left[mine] - k
        begin = start[mine] + window
        order = np.lexsort((begin, ids[mine], rightward[BESIDE - k, mine], leftward[k, mine]))
        l, r, i, s = leftward[k, mine][order], rightward[BESIDE - k, mine][order], ids[mine][order], begin[order]
        opens = np.r_[True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])]
        head = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        same = (i == i[head]) & (s == s[head])
        first[((ends - n)[mine] + window)[order]] = same
    return first


def _least(sent: pa.Table) -> pa.Table:
    """Tells each chunk, for every window of the surroundings it sent, whether no equal window starts earlier anywhere."""
    hashes, ids, start, left, n, names, owner = [], [], [], [], [], [], []
    for k, p in enumerate(sent.column("payload")):
        h, i, s, l, m, raw = unpacked(p.as_py())
        hashes.append(np.cumsum(h.astype(np.uint64)))
        ids.append(i)
        start.append(s.astype(np.int64))
        left.append(l.astype(np.int64))
        n.append(m.astype(np.int64))
        names += raw.tobytes().split(b"\n")
        owner.append(np.full(len(h), k))
    hashes, ids, start, left, n, owner = (np.concatenate(x) for x in (hashes, ids, start, left, n, owner))
    code, order = Codes(), np.argsort(hashes, kind="stable")
    ends = np.cumsum(n)
    found = np.ones(int(ends[-1]), bool)
    opens = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    groups = np.diff(np.r_[opens, len(order)])
    # occurrences of one anchor stay together; those of several anchors are extended together
    alone = groups == 1
    opens, groups = opens[~alone], groups[~alone]
    done = 0
    while done < len(opens):
        total = np.cumsum(groups[done:]) * (WINDOW + BESIDE)
        until = done + max(1, int(np.searchsorted(total, TOGETHER)))
        mine = np.concatenate([order[a : a + g] for a, g in zip(opens[done:until].tolist(), groups[done:until].tolist())])
        split = [names[i].split(b" ") for i in mine.tolist()]
        words = np.fromiter((code[w] for doc in split for w in doc), np.int64)
        size = WINDOW + n[mine] - 1
        first = first_windows(hashes[mine], ids[mine], start[mine], left[mine], n[mine], words, np.cumsum(size) - size)
        where = np.repeat((ends - n)[mine] - (np.cumsum(n[mine]) - n[mine]), n[mine]) + np.arange(len(first))
        found[where] = first
        code.clear()
        done = until
    out = []
    for k in range(len(sent)):
        windows = found[np.repeat(owner == k, n)]
        out.append(packed(np.packbits(windows), np.array([len(windows)])))
    return pa.table({"chunk": sent.column("chunk"), "bucket": sent.column("bucket"), "payload": pa.array(out, pa.binary())})


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _removing(coded: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a chunk with the words that are removed from each and those that are kept."""
    _, ids, sizes, whole = _documents(coded)
    raw, ends = whole.tobytes(), np.cumsum(sizes)
    split = [raw[a:b].split() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    at = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
    where, parts = None, {}
    for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload"), strict=True):
        if b == DOCS:
            where = unpacked(p.as_py())
        else:
            bits, size = unpacked(p.as_py())
            parts[b] = np.unpackbits(bits)[: size[0]].astype(bool)
    edge = np.zeros(int(at[-1]) + 1, np.int64)
    if where is not None and len(where[0]):
        begin, n, kind = np.cumsum(where[0].astype(np.int64)), where[1].astype(np.int64), where[2].astype(np.int64)
        first_id, first_start = where[3], where[4].astype(np.int64)
        first = np.concatenate([parts[b] for b in sorted(parts)])
        windows = np.zeros(len(first_id), np.int64)
        windows[kind] = n
        base = np.cumsum(windows) - windows
        which = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(at, begin, side="right") - 1
        least = (ids[doc] == first_id[kind]) & (begin - at[doc] == first_start[kind])
        repeated = ~(first[base[kind[which]] + nth] & least[which])
        start = begin[which[repeated]] + nth[repeated]
        edge += np.bincount(start, minlength=len(edge)) - np.bincount(start + WINDOW, minlength=len(edge))
    gone = np.cumsum(edge)[:-1] > 0
    kept, spans, n_removed = [], [], []
    for d, words in enumerate(split):
        mine = gone[at[d] : at[d + 1]]
        n_removed.append(int(mine.sum()))
        if not n_removed[-1]:
            kept.append(b" ".join(words))
            spans.append([])
            continue
        cut = np.flatnonzero(np.diff(np.r_[False, mine, False]))
        spans.append([{"begin": int(x), "end": int(y)} for x, y in zip(cut[::2], cut[1::2])])
        left = np.r_[0, cut, len(words)]
        kept.append(b" ".join([w for a, b in zip(left[::2].tolist(), left[1::2].tolist()) for w in words[a:b]]))
    return pa.table({"doc_id": ids_back(ids), "n_words": pa.array(np.diff(at)), "n_removed": pa.array(n_removed, pa.int64()),
                     "removed": pa.array(spans, SPANS), "kept": pa.array(kept, pa.binary())})


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """doc_id, n_words, n_removed, removed (maximal runs of removed words, begin and end) and kept (the other words, UTF-8, joined by one space).

    Words are runs of bytes other than space and the ASCII controls from tab to carriage return, unchanged. A word is
    removed if WINDOW consecutive words of its document that cover it also start earlier: in a document with a
    smaller id, or before in the same one; overlapping windows count, and all are judged on the input. Rows with the same
    id count as one document there: of two equal rows neither starts earlier. A null id is the smallest. A null
    or empty text, or one under WINDOW words, loses nothing. Repeated rows stay; other columns are ignored; an
    empty table gives no rows. Of an anchor with more than `many` different surroundings every window travels by
    itself; `many` changes no result.
    """
    parts = shuffle_parts(docs.sparkSession)
    buckets = 2 * parts
    coded = _chunks(texts(docs, id_col, text_col), buckets).repartition(parts, "chunk")
    again = coded.mapInArrow(_asking, CHUNK_ROWS).groupBy("bucket").applyInArrow(released(_repeated(many)), CHUNK_ROWS)
    sent = (
        coded.groupBy("chunk").cogroup(again.groupBy("chunk")).applyInArrow(released(_sending(buckets)), CHUNK_ROWS)
        .repartition(parts, "chunk"))
    least = sent.mapInArrow(_asking, CHUNK_ROWS).groupBy("bucket").applyInArrow(released(_least), CHUNK_ROWS)
    own = sent.mapInArrow(_only_docs, CHUNK_ROWS)
    return coded.groupBy("chunk").cogroup(own.unionByName(least).groupBy("chunk")).applyInArrow(
        released(_removing), "doc_id long, n_words long, n_removed long, removed array<struct<begin: long, end: long>>, kept binary")

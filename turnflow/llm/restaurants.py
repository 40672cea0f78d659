"""Language-model scoring: a hierarchical Pitman-Yor model of words and the word before.

Every context word is a restaurant in which the words that follow it are served; a table there is a
customer of the one parent restaurant that all contexts share, whose base is uniform. Numbers of tables
are drawn by Gibbs sampling, and predictive probabilities are averaged over the kept draws.

Counts travel as distinct words and pairs of chunks of documents. The seating of a context is drawn
in the bucket that holds it; a context with very many occurrences is dealt over several.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnflow.llm.common import ids_back, ids_of, release, released, shuffle_parts, text_slices
from turnflow.llm.dictionary import CHUNK, CHUNK_ROWS, DOCS, LOW48, Chunk, buckets_of, documents_of, packed, sized, unpacked

#: Marks that no text can hold as a word.
END, BEGIN = b"", b"\n"
#: Discount and strength of the contexts, then of the parent.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.75, 1.0, 0.65, 1.0
#: Rounds of Gibbs sampling before the first kept draw, and kept draws.
BURN_IN, DRAWS = 2, 3
#: Occurrences of a context per part; counts up to which the conditional of the tables is tabulated.
PART, TABULATED = 2_000_000, 64
TEXT = 1_000_000
#: Kinds of rows for a chunk, told by their bucket: numbers of words, then values of pairs.
WORDS, PAIRS = 0, 1 << 24
#: Chunk of the rows that hold totals. Rows for the parent have chunks below that, one per bucket.
TOTALS = -1


def _chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of chunks: documents with flags for those to learn from, and words with their counts in these."""

    def work(batches):
        chunk, learn = Chunk(buckets), []

        def trained(counts, codes, n):
            mask = np.repeat(np.concatenate(learn), counts)
            return np.bincount(codes[mask], minlength=n)

        for batch in batches:
            ids, flags = ids_of(batch.column("doc_id")), np.array(batch.column("learn").to_pylist(), bool)
            for first, end, data, at in text_slices(batch, TEXT):
                raw = data.tobytes()
                words = [[*raw[a:b].lower().split(), END] for a, b in zip(at, at[1:])]
                chunk.code.setdefault(BEGIN, len(chunk.code))
                chunk.add(ids[first:end], words, len(data))
                learn.append(flags[first:end])
                if chunk.bytes >= CHUNK:
                    yield _with_flags(chunk.rows(trained), np.concatenate(learn))
                    learn.clear()
                    release()
        if chunk.ids:
            yield _with_flags(chunk.rows(trained), np.concatenate(learn))

    return docs.mapInArrow(work, CHUNK_ROWS)


def _with_flags(rows: pa.RecordBatch, learn: np.ndarray) -> pa.RecordBatch:
    payloads = rows.column("payload").to_pylist()
    payloads[0] += packed(np.packbits(learn))
    return pa.RecordBatch.from_arrays([rows.column("chunk"), rows.column("bucket"), pa.array(payloads, pa.binary())],
                                      rows.schema.names)


class _Documents:
    """The documents of a chunk: tokens as codes, contexts, and who is learnt from.

    Answers about words come in the order in which these were sent; `by_hash` puts them in that of the codes.
    """

    def __init__(self, table: pa.Table):
        hashes, at = [], []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True):
            if bucket == DOCS:
                self.ids, self.counts, self.codes, flags = documents_of(payload.as_py())
                self.learn = np.unpackbits(flags)[: len(self.ids)].astype(bool)
            else:
                hashes.append(unpacked(payload.as_py())[0])
                at.append(bucket)
        self.chunk = table.column("chunk")[0].as_py()
        hashes = np.concatenate([hashes[i] for i in np.argsort(at)])
        # words are told by their places among the hashes, where these travel as small steps
        self.by_hash = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[self.by_hash] = np.arange(len(hashes))
        self.hashes, self.codes = hashes[self.by_hash], place[self.codes]
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        begin = int(np.flatnonzero(self.hashes == np.uint64(_hash(BEGIN)))[0])
        self.end = int(np.flatnonzero(self.hashes == np.uint64(_hash(END)))[0])
        self.begin = begin
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[np.cumsum(self.counts) - self.counts] = begin
        self.pair, self.of = np.unique(before * len(self.hashes) + self.codes, return_inverse=True)
        self.context, self.word = self.pair // len(self.hashes), self.pair % len(self.hashes)

    def buckets(self, occurrences: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket of every distinct pair: that of its context, or one of several if that is frequent."""
        parts = 1 + occurrences[self.context] // PART
        shift = self.hashes[self.word] // np.uint64(buckets) % parts.astype(np.uint64)
        return ((self.hashes[self.context] + shift) % np.uint64(buckets)).astype(np.int64)


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _word_counts(asked: pa.Table) -> pa.Table:
    """Answers every chunk with the occurrences of its words in all documents to learn from."""
    lists = [unpacked(p.as_py()) for p in asked.column("payload")]
    every, at = np.unique(np.concatenate([h for h, _ in lists]), return_inverse=True)
    total = np.bincount(at, np.concatenate([n.astype(np.float64) for _, n in lists])).astype(np.int64)
    out = np.split(total[at], np.cumsum([len(h) for h, _ in lists])[:-1])
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"),
                     "payload": pa.array([packed(sized(x)) for x in out], pa.binary())})


def _planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 as their lowest bytes, then the next ones and so on, after how many each has."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.r_[np.uint8(width), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()]


def _of_planes(data: np.ndarray) -> np.ndarray:
    planes = data[1:].reshape(int(data[0]), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    """Whole numbers in order, as steps between them."""
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _of_steps(data: np.ndarray) -> np.ndarray:
    return np.cumsum(_of_planes(data), dtype=np.uint64)


def _in_order(answers: pa.Table) -> list[list[np.ndarray]]:
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    return [unpacked(answers.column("payload")[int(i)].as_py()) for i in order]


def _pairs(buckets: int):
    """Distinct pairs of a chunk for the buckets of their contexts, with counts and how frequent the word is."""

    def work(coded: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _Documents(coded)
        count = np.concatenate([a[0] for a in _in_order(answers)]).astype(np.int64)[docs.by_hash]
        count[docs.begin] = count[docs.end]
        trained = np.bincount(docs.of[docs.learn[docs.doc]], minlength=len(docs.pair))
        bucket = docs.buckets(count, buckets)
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            mine = order[at[b] : at[b + 1]]
            if len(mine):
                context = docs.context[mine]
                first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
                names = docs.hashes[context[first]]
                words, word_first, which = np.unique(docs.hashes[docs.word[mine]] & LOW48, return_index=True, return_inverse=True)
                rows.append((b, packed(
                    _steps(names // np.uint64(buckets)), sized(names % np.uint64(buckets)), sized(np.diff(np.r_[first, len(mine)])),
                    _steps(words), _planes(which), sized(trained[mine]),
                    np.rint(8 * np.log2(count[docs.word[mine[word_first]]] + 1)).astype(np.uint8),
                    sized(1 + count[context[first]] // PART))))
        return _table([(docs.chunk, b, p) for b, p in rows])

    return work


def _stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers: weights of c customers at t tables."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        table[c + 1, t] = np.logaddexp(table[c, t - 1], table[c, t] + np.log(np.maximum(c - t * discount, 1e-300)))
    return table


def draw_tables(count, tables, restaurant, total, parts, parent, discount, strength, rng, stirling) -> np.ndarray:
    """One round of Gibbs sampling: new numbers of tables of dishes with `count` customers.

    `total` holds each restaurant's tables of the last round, `parent` each dish's probability in the parent.
    Small counts are drawn from their exact conditional given the other dishes; in larger ones customers are
    seated anew in blocks that grow by a tenth, over which the chance of a new table is held.
    """
    others = total[restaurant] * parts - tables
    out = tables.copy()
    small = np.flatnonzero((count > 1) & (count <= TABULATED))
    small = small[np.argsort(count[small], kind="stable")]
    edges = np.flatnonzero(np.r_[True, np.diff(count[small]) > 0, True]) if len(small) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        rows, c = small[a:b], int(count[small[a]])
        t = np.arange(1, c + 1)
        open_ = np.log(strength + discount * (others[rows][:, None] + t - 1)) + np.log(parent[rows])[:, None]
        weight = stirling[c, t] + np.cumsum(open_, axis=1)
        chance = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        out[rows] = 1 + (chance < rng.random(len(rows))[:, None] * chance[:, -1:]).sum(1).clip(0, c - 1)
    large = np.flatnonzero(count > TABULATED)
    seated, t = np.ones(len(large), np.int64), np.ones(len(large), np.int64)
    while len(live := np.flatnonzero(seated < count[large])):
        rows = large[live]
        n = np.minimum(np.maximum(1, seated[live] // 10), count[rows] - seated[live])
        fresh = (strength + discount * (others[rows] + t[live])) * parent[rows]
        t[live] += rng.binomial(n, fresh / (fresh + seated[live] - discount * t[live]))
        seated[live] += n
    out[large] = t
    return out


def _seating(n_tokens: int, buckets: int):
    """Draws the tables of the contexts of a bucket; answers the chunks, and tells the parent what to add."""

    def work(asked: pa.Table) -> pa.Table:
        lists = [unpacked(p.as_py()) for p in asked.column("payload")]
        context = np.concatenate([np.repeat(_of_steps(x[0]) * np.uint64(buckets) + x[1].astype(np.uint64), x[2]) for x in lists])
        which_word = [_of_planes(x[4]).astype(np.int64) for x in lists]
        word = np.concatenate([_of_steps(x[3])[w] for x, w in zip(lists, which_word, strict=True)])
        parts = np.concatenate([np.repeat(x[7].astype(np.int64), x[2]) for x in lists])
        mixed = context * np.uint64(0x9E3779B97F4A7C15) ^ word * np.uint64(0xD6E8FEB86659FD93)
        _, first, at = np.unique(mixed, return_index=True, return_inverse=True)
        trained = np.concatenate([x[5] for x in lists]).astype(np.float64)
        count = np.bincount(at, trained).astype(np.int64)
        often = np.concatenate([x[6][w] for x, w in zip(lists, which_word, strict=True)])
        parent = np.exp2(often[first] / 8.0) / (n_tokens + 1)
        parent = np.minimum(parent, 1.0)
        _, restaurant = np.unique(context[first], return_inverse=True)
        rng = np.random.default_rng([int(asked.column("bucket")[0].as_py()), 29])
        stirling, tables = _stirling(DISCOUNT, TABULATED), np.minimum(count, 1)
        kept = []
        for r in range(BURN_IN + DRAWS):
            total = np.bincount(restaurant, tables)
            tables = draw_tables(count, tables, restaurant, total, parts[first], parent, DISCOUNT, STRENGTH, rng, stirling)
            if r >= BURN_IN:
                kept.append(tables)
        served = count - DISCOUNT * np.mean(kept, axis=0)
        values, which = np.unique(served.astype(np.float32), return_inverse=True)
        out, ends = [], np.cumsum([len(w) for w in which_word])
        for k, codes in enumerate(np.split(which[at], ends[:-1])):
            used, small = np.unique(codes, return_inverse=True)
            out.append((asked.column("chunk")[k].as_py(), PAIRS + int(asked.column("bucket")[k].as_py()),
                        packed(values[used], sized(small))))
        contexts, words = _sums(context[first], count, kept), _sums(word[first], count, kept)
        # one row for each bucket that answers for words, with both sides
        out += [(TOTALS - 1 - b, b, packed(*contexts[b], *words[b])) for b in range(buckets)
                if len(contexts[b][1]) or len(words[b][1])]
        return _table(out)

    def _sums(key, count, kept) -> list[list[np.ndarray]]:
        """For each bucket that answers for words: low hash bits of its words, without what tells the bucket; tables of all draws."""
        used = count > 0
        names, at = np.unique(key[used] & LOW48, return_inverse=True)
        sums = [np.bincount(at, k[used], len(names)).astype(np.int64) for k in kept]
        bucket = buckets_of(names, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        parts = [order[edges[b] : edges[b + 1]] for b in range(buckets)]
        return [[_steps(names[m] // np.uint64(buckets)), sized(np.concatenate([s[m] for s in sums]))] for m in parts]

    return work


def _parent(buckets: int):
    """Draws the parent's tables for the words of a bucket and tells every chunk what it needs to know of its words."""

    def work(asked: pa.Table, sums: pa.Table) -> pa.Table:
        lists = [unpacked(p.as_py()) for p in asked.column("payload")]
        every, at = np.unique(np.concatenate([h for h, _ in lists]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n.astype(np.float64) for _, n in lists])).astype(np.int64)
        low = every & LOW48
        by_low = np.argsort(low, kind="stable")
        as_context, as_word = (np.zeros((DRAWS, len(every)), np.int64) for _ in range(2))
        for bucket, payload in zip(sums.column("bucket").to_pylist(), sums.column("payload"), strict=True):
            arrays = unpacked(payload.as_py())
            for side, (names, tables) in ((as_context, arrays[:2]), (as_word, arrays[2:])):
                place = by_low[np.searchsorted(low[by_low], _of_steps(names) * np.uint64(buckets) + np.uint64(bucket))]
                for s, drawn in enumerate(tables.reshape(DRAWS, -1)):
                    side[s] += np.bincount(place, drawn, len(every)).astype(np.int64)
        known = int((count > 0).sum())
        rng = np.random.default_rng([int(asked.column("bucket")[0].as_py()), 31])
        stirling, one = _stirling(PARENT_DISCOUNT, TABULATED), np.zeros(len(every), np.int64)
        tables, served, totals = np.minimum(as_word[0], 1), [], []
        # words are dealt by their hash, so a bucket's share stands for the whole vocabulary
        base = np.full(len(every), 1 / (known * buckets + 1))
        for s in range(DRAWS):
            tables = np.clip(tables, np.minimum(as_word[s], 1), as_word[s])
            for _ in range(BURN_IN):
                total = np.array([tables.sum()])
                tables = draw_tables(as_word[s], tables, one, total, np.full(len(every), buckets), base,
                                     PARENT_DISCOUNT, PARENT_STRENGTH, rng, stirling)
            served.append((as_word[s] - PARENT_DISCOUNT * tables).astype(np.float32))
            totals += [float(as_word[s].sum()), float(tables.sum())]
        alike = _alike([count, *served, *as_context])
        out, ends = [], np.cumsum([len(h) for h, _ in lists])
        for k, mine in enumerate(np.split(at, ends[:-1])):
            # many words, such as those met once, have the same answer
            _, first, which, times = np.unique(alike[mine], return_index=True, return_inverse=True, return_counts=True)
            frequent = np.argsort(-times, kind="stable")
            number = np.empty(len(first), np.int64)
            number[frequent] = np.arange(len(first))
            told = mine[first[frequent]]
            out.append((asked.column("chunk")[k].as_py(), WORDS + int(asked.column("bucket")[k].as_py()), packed(
                _planes(number[which]), sized(count[told]), *(x[told] for x in served), *(sized(x[told]) for x in as_context))))
        out.append((TOTALS, int(asked.column("bucket")[0].as_py()),
                    packed(np.array([count.sum(), known, *totals], np.float64))))
        return _table(out)

    return work


def _alike(columns: list[np.ndarray]) -> np.ndarray:
    """Numbers of rows, the same for rows that agree in all columns."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        values, at = np.unique(column, return_inverse=True)
        code = np.unique(code * len(values) + at, return_inverse=True)[1]
    return code


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table({"chunk": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([x[1] for x in rows], pa.int32()),
                     "payload": pa.array([x[2] for x in rows], pa.binary())})


#: Totals: tokens and distinct words learnt from, then customers and tables of the parent in every draw.
SUMMED = ["n", "v", *(f"{x}{s}" for s in range(DRAWS) for x in "ct")]


def _totals(batches):
    for batch in batches:
        for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
            if chunk == TOTALS:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in unpacked(payload.as_py())[0]], SUMMED)


def _scores(buckets: int):
    def work(coded: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(coded) or coded.column("chunk")[0].as_py() < 0:
            return SCORED.empty_table()
        docs, totals = _Documents(coded), np.array(answers.column("totals")[0].as_py())
        found = _in_order(answers)
        words = [[x[_of_planes(a[0]).astype(np.int64)] for x in a[1:]]
                 for b, a in zip(sorted(answers.column("bucket").to_pylist()), found, strict=True) if b < PAIRS]
        pairs = [a for b, a in zip(sorted(answers.column("bucket").to_pylist()), found, strict=True) if b >= PAIRS]
        count, *rest_of_words = (np.concatenate(x)[docs.by_hash] for x in zip(*words, strict=True))
        count = count.astype(np.int64)
        served, tables = ([x.astype(np.float64) for x in y] for y in (rest_of_words[:DRAWS], rest_of_words[DRAWS:]))
        n, v, rest = totals[0], totals[1], totals[2:].reshape(DRAWS, 2)
        occurrences = count.copy()
        occurrences[docs.begin] = count[docs.end]
        order = np.argsort(docs.buckets(occurrences, buckets), kind="stable")
        value = np.empty(len(docs.pair))
        value[order] = np.concatenate([a[0][a[1]] for a in pairs]) if pairs else 0
        room = STRENGTH + occurrences[docs.context]
        chance = value / room
        for s, (customers, at_tables) in enumerate(rest):
            open_ = (PARENT_STRENGTH + PARENT_DISCOUNT * at_tables) / (PARENT_STRENGTH + customers) / (v + 1)
            parent = served[s][docs.word] / (PARENT_STRENGTH + customers) + open_
            chance += (STRENGTH + DISCOUNT * tables[s][docs.context]) / room * parent / DRAWS
        logs = np.log10(chance)[docs.of]
        size = len(docs.ids)
        base = np.bincount(docs.doc, np.log10(count + 1.0)[docs.codes], size) - docs.counts * np.log10(n + v + 1)
        return pa.table([
            ids_back(docs.ids), pa.array(~docs.learn), pa.array(docs.counts),
            pa.array(np.bincount(docs.doc, (count > 0)[docs.codes], size).astype(np.int64)),
            pa.array(np.full(size, int(n))), pa.array(base), pa.array(np.bincount(docs.doc, logs, size))], schema=SCORED)

    return work


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _words_only(batches):
    for batch in batches:
        yield batch.filter(pc.greater_equal(batch.column("bucket"), 0))


def _sums_only(batches):
    for batch in batches:
        yield batch.filter(pc.less(batch.column("chunk"), TOTALS))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    `learn` tells which documents are learnt from; the others are held out. Tokens are the words between ASCII
    white space, A-Z in lower case, and an end. The base model is a unigram with one added to each count; score
    is the log10 probability of the whole text under the averaged draws of the hierarchical model. A null or
    empty text is its end alone. Repeated rows, null ids and documents with nothing learnt from them are scored
    like any other; other columns are ignored; an empty table gives no rows. With nothing to learn from, both
    scores come from the uniform base.

    Words are told by 64 bits of hash, the words of one context by 48. The seating of contexts takes a word's
    share of all tokens, to an eighth of a doubling, for its probability in the parent; the parent is drawn from the tables that result.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    buckets = 2 * parts
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(True)).alias("learn"))
    n_tokens = rows.where("learn").select("text").mapInArrow(_lengths, "n long").agg(F.sum("n")).first()[0] or 0
    coded = _chunks(rows, buckets).repartition(parts, "chunk")
    by_word = coded.mapInArrow(_words_only, CHUNK_ROWS).repartition(parts, "bucket").groupBy("bucket")
    counts = by_word.applyInArrow(released(_word_counts), CHUNK_ROWS)
    asked = coded.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(released(_pairs(buckets)), CHUNK_ROWS)
    seated = asked.groupBy("bucket").applyInArrow(released(_seating(n_tokens, buckets)), CHUNK_ROWS).repartition(parts, "chunk")
    sums = seated.mapInArrow(_sums_only, CHUNK_ROWS)
    parent = by_word.cogroup(sums.groupBy("bucket")).applyInArrow(released(_parent(buckets)), CHUNK_ROWS).repartition(parts, "chunk")
    totals = parent.mapInArrow(_totals, ", ".join(f"{x} double" for x in SUMMED)).agg(
        F.array(*[F.sum(x) for x in SUMMED]).alias("totals"))
    answers = parent.unionByName(seated).withColumn("totals", totals.scalar())
    return coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        released(_scores(buckets)), ", ".join(f"{f.name} {KINDS[f.type]}" for f in SCORED))


KINDS = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def _lengths(batches):
    for batch in batches:
        n = sum(len(t.as_py().encode().split()) + 1 for t in batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

"""SimHash near duplicates: links by Hamming distance, found with pivot distance tables.

Distinct fingerprints meet in groups that agree on two of five blocks of bits, as any two within three
bits must. In a group, a table of distances to reference fingerprints discards every pair that some
reference tells apart, and the survivors are verified. Groups give the links of a spanning forest, not
all pairs.
"""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnflow.llm.common import fresh, shuffle_parts, texts, written
from turnflow.llm.components import smallest_reachable

SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text hashed at a time, and rows compared at a time.
PIECE, LARGE = 4_000_000, 512
#: Reference fingerprints of the distance tables.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)


def _pieces(data: bytes, size: int):
    """Words of a text in order, a bounded piece at a time, each with the last `size` - 1 before it."""
    at, kept = 0, []
    while at < len(data):
        found = SPACE.search(data, at + PIECE)
        end = found.start() if found else len(data)
        words = kept + data[at:end].split()
        yield words
        kept, at = words[-(size - 1) :] if size > 1 else [], max(end, at + 1)


def fingerprint(text: str, size: int) -> int:
    """64-bit SimHash over the `size`-word shingles of a whole text, repeats included; no words: 0."""
    ones, total, short = np.zeros(64, np.int64), 0, []
    for words in _pieces(text.encode().lower(), size):
        if len(words) < size:
            short = words
            continue
        joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        begins = (ends - lengths)[: len(words) - size + 1].tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins, ends[size - 1 :].tolist())]
        total += len(hashes)
        raw = np.array(hashes, "<u8")
        for first in range(0, len(raw), 16384):
            bits = np.unpackbits(raw[first : first + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(short), 42) if short else 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id and fingerprint (as a signed 64-bit number) of every row, and the columns named in `more`; a null text is empty."""
    rows = texts(docs, id_col, text_col, *more)

    def work(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64)), *[batch.column(c) for c in more]],
                                             ["doc_id", "fingerprint", *more])

    schema = StructType([StructField("doc_id", LongType()), StructField("fingerprint", LongType()), *[rows.schema[c] for c in more]])
    return rows.mapInArrow(work, schema)


def _blocks(n: int, bits: np.ndarray) -> list[int]:
    """Masks of `n` blocks that share out the given bit numbers."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; label[x] is the smallest index of x's class."""
    while True:
        one, two = label[a], label[b]
        if not (differ := one != two).any():
            return
        np.minimum.at(label, np.maximum(one, two)[differ], np.minimum(one, two)[differ])
        while not np.array_equal(label, further := label[label]):
            label[:] = further


def _compare(codes: np.ndarray, group: np.ndarray, label: np.ndarray, rows: np.ndarray, most: int) -> None:
    """Join the classes of all pairs within `most` bits whose group is the same; `group` is sorted."""
    tables = np.bitwise_count(codes[:, None] ^ PIVOTS)
    live = np.arange(len(codes))
    shift = 1
    while True:
        live = live[live + shift < len(codes)]
        live = live[group[live] == group[live + shift]]
        if not len(live):
            return
        a, b = live, live + shift
        apart = np.abs(tables[a].astype(np.int8) - tables[b].astype(np.int8)).max(1)
        close = apart <= most
        a, b = a[close], b[close]
        near = np.bitwise_count(codes[a] ^ codes[b]) <= most
        if near.any():
            _merge(label, rows[a[near]], rows[b[near]])
        shift += 1


def _forest(codes: np.ndarray, band: np.ndarray, key: np.ndarray, masks: list[int], most: int):
    """Links of a spanning forest of the fingerprints of whole (band, key) groups."""
    label = np.arange(len(codes))
    starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
    sizes = np.diff(np.r_[starts, len(codes)])
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero((sizes > 1) & (sizes <= LARGE))
    rows = np.flatnonzero(np.isin(group, small))
    _compare(codes[rows], group[rows], label, rows, most)
    for g in np.flatnonzero(sizes > LARGE):
        # of the bits on which a large group may differ, one of most + 1 blocks has to agree again
        rows = np.arange(starts[g], starts[g] + sizes[g])
        free = np.flatnonzero([not masks[band[rows[0]]] >> b & 1 for b in range(64)])
        for mask in _blocks(most + 1, free):
            order = rows[np.argsort(codes[rows] & np.uint64(mask), kind="stable")]
            _compare(codes[order], codes[order] & np.uint64(mask), label, order, most)
    linked = np.flatnonzero(label != np.arange(len(codes)))
    return codes[linked], codes[label[linked]]


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) whose classes are those of all pairs of distinct fingerprints within `max_bits` bits."""
    blocks = _blocks(max_bits + 2, np.arange(64))
    masks = [x | y for x, y in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    bands = F.explode(F.array(*[F.struct(
        F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    grouped = (
        prints.select("fingerprint", bands.alias("at")).select("at.band", "at.key", "fingerprint")
        .repartition(shuffle_parts(prints.sparkSession), "band", "key").sortWithinPartitions("band", "key")
    )

    def work(batches):
        kept = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            band, key, _ = now
            if not len(band):
                continue
            last = np.flatnonzero((band == band[-1]) & (key == key[-1]))[0]
            kept = [x[last:] for x in now]  # the last group may go on
            yield _found([x[:last] for x in now])
        if kept is not None:
            yield _found(kept)

    def _found(now):
        band, key, codes = now
        one, two = _forest(codes.astype(np.int64).view(np.uint64), band, key, masks, max_bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["a", "b"])

    return grouped.mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row, repeated rows too.

    Fingerprints of `max_bits` or fewer differing bits are linked; component_id is the smallest id that
    can be reached over links. An empty or null text has no words and the fingerprint zero, which links
    like any other; with fewer words than a shingle all words are the one shingle. Rows with a null id
    link too, but their id is never a component's unless all of its ids are null, which gives null.
    Other columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    placed = _placed(distinct, max_bits)
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(names, "root").select(F.col("fingerprint").alias("f"), "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _placed(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints with the root of their component."""
    roots = written(smallest_reachable(links(distinct, max_bits)), "roots")
    return distinct.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint")).drop("node")


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component of near duplicates, with all its columns: that of the smallest id.

    Rows of one id, or without one, are told apart by fingerprint and by a hash of all their columns, so the choice is
    the same on every run; null ids come last, so such a row stays only where no row of its component has an id. Of
    rows equal in all columns (but maps, which have no hash) one stays. Empty and null texts are near duplicates of one another.
    An empty table gives no rows.
    """
    mark, key = fresh(docs, "_mark"), fresh(docs, "_key")
    cells = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumns({mark: F.xxhash64(*cells, *[c.isNull() for c in cells]),
                               key: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long"))})
    prints = fingerprints(marked, shingle, id_col, text_col, mark)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint", F.col(mark).alias("mark"))).alias("best")
    distinct = written(prints.groupBy("fingerprint").agg(best), "distinct")
    chosen = _placed(distinct, max_bits).groupBy("root").agg(F.min("best").alias("best")).select(
        F.coalesce("best.doc_id", F.lit(0).cast("long")).alias(key), F.col("best.mark").alias(mark))
    one = marked.join(chosen, [key, mark], "left_semi").dropDuplicates([key, mark])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])

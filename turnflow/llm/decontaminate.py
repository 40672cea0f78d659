"""Benchmark decontamination: passages of benchmark items in documents, by the q-gram lemma.

An item of m bytes that matches with at most k edits shares at least m + 1 - q(k + 1) q-grams with the
text, all on k + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals,
bands that meet the bound are kept, and each is verified by a banded alignment.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.llm.common import NO_ID, ids_back, ids_of, only_text, slices, text_slices, texts

#: Length of a q-gram in bytes, eight at most.
Q = 8
#: Bytes of text worked on together; a document counts as DOC_COST at least. Bytes of items per broadcast.
BLOCK, DOC_COST, ITEMS = 1_000_000, 256, 8_000_000

#: More edits than any item has; cases aligned together.
FAR, ALIGNED = 1 << 40, 256


def _letters() -> np.ndarray:
    of = np.arange(256, dtype=np.uint8)
    of[ord("A") : ord("Z") + 1] += 32
    signs = [b for b in range(128) if not chr(b).isalnum()]
    of[signs] = 32
    return of


LETTER = _letters()


def normalized(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with letters in lower case and each run of signs and white space as one space."""
    out = LETTER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1  # second byte of the accented letters of Latin-1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 32
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep], np.r_[0, np.cumsum(keep)][at]


def _grams(data: np.ndarray) -> np.ndarray:
    """Codes of the q-grams that begin at each byte."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    whole = np.r_[data, np.zeros(8 - Q, np.uint8)]
    return np.ndarray(len(data) - Q + 1, "<u8", whole, strides=(1,)) & np.uint64((1 << 8 * Q) - 1)


def _mixed(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Items:
    """Q-grams of a block of items, with the edits that each may have and the q-grams it then must share."""

    def __init__(self, ids: list[int], texts_: list[str], rate: float, least: int):
        kept = []
        for i, text in zip(ids, texts_, strict=True):
            raw = np.frombuffer(text.encode(), np.uint8)
            data, _ = normalized(raw, np.array([0, len(raw)]))
            data = np.frombuffer(data.tobytes().strip(), np.uint8)
            if len(data) >= max(least, Q):
                kept.append((i, data))
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.data = [d for _, d in kept]
        self.size = np.array([len(d) for d in self.data], np.int64)
        # no more edits than leave a q-gram to share
        self.edits = np.minimum((self.size * rate).astype(np.int64), (self.size - Q) // Q)
        self.must = self.size + 1 - Q * (self.edits + 1)
        self.step = self.edits + 1
        if not kept:
            return
        codes = np.concatenate([_grams(d) for d in self.data])
        item = np.repeat(np.arange(len(kept)), self.size - Q + 1)
        place = np.concatenate([np.arange(n - Q + 1) for n in self.size])
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.from_, self.item, self.place = np.r_[first, len(codes)], item[order], place[order]
        self.bits = int(min(26, max(20, len(codes).bit_length() + 4)))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[_mixed(self.codes, self.bits)] = True
        self.longest = int((self.size + self.edits).max())
        # of the stretches of `window` bytes that cover a match, one holds its share of the q-grams
        self.window = int(self.size.min())
        self.dense = int((self.must / -(-(self.size + 2 * self.edits) // self.window + 1)).min().__floor__())

    def candidates(self, data: np.ndarray, at: np.ndarray):
        """(document, item, band, shared q-grams) of the bands that meet the bound of their item."""
        grams = _grams(data)
        hits = np.flatnonzero(self.seen[_mixed(grams, self.bits)])
        none = [np.zeros(0, np.int64)] * 4
        if not len(hits):
            return none
        found = np.minimum(np.searchsorted(self.codes, grams[hits]), len(self.codes) - 1)
        true = self.codes[found] == grams[hits]
        hits, found = hits[true], found[true]
        hits, found = self._dense(hits, found)
        if not len(hits):
            return none
        n = self.from_[found + 1] - self.from_[found]
        entry = np.repeat(self.from_[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        where = np.repeat(hits, n)
        item = self.item[entry]
        doc = np.searchsorted(at, where, side="right") - 1
        band = (where - self.place[entry] + self.longest) // self.step[item]
        wide = (len(data) + self.longest) // int(self.step.min()) + 2
        key = (doc * len(self.ids) + item) * wide + band
        # bands overlap: band b holds the diagonals of steps b and b + 1
        keys, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        doc, item, band = keys // wide // len(self.ids), keys // wide % len(self.ids), keys % wide
        good = shared >= self.must[item]
        return doc[good], item[good], band[good], shared[good]

    def _dense(self, hits: np.ndarray, found: np.ndarray):
        """Hits near a stretch with as many hits as any match must have in one of its stretches."""
        ahead = np.searchsorted(hits, hits + self.window) - np.arange(len(hits))
        rich = hits[ahead >= self.dense]
        if not len(rich):
            return hits[:0], found[:0]
        near = np.searchsorted(rich, hits - 2 * self.longest)
        near = np.minimum(near, len(rich) - 1)
        keep = np.abs(rich[near] - hits) <= 2 * self.longest
        return hits[keep], found[keep]

    def edits_of(self, data: np.ndarray, at: np.ndarray, doc, item, band) -> np.ndarray:
        """Fewest edits that turn each item into a stretch of its document along its band, or far too many."""
        best = np.full(len(doc), FAR)
        for first in range(0, len(doc), ALIGNED):
            part = slice(first, first + ALIGNED)
            k, step = self.edits[item[part]], self.step[item[part]]
            low = band[part] * step - self.longest - k  # first diagonal of the band, with room for edits
            best[part] = _aligned([self.data[i] for i in item[part]], data, at[doc[part]], at[doc[part] + 1],
                                  low, 2 * step + 2 * k + 1)
        return best


def _aligned(items: list[np.ndarray], data: np.ndarray, begin, end, low, width) -> np.ndarray:
    """Edit distances of items to their best stretches of data[begin:end], each on its own diagonals.

    Case i has the diagonals low[i] to low[i] + width[i] - 1 of the whole of `data`. One pass over the bytes
    of the items updates all cases together.
    """
    sizes = np.array([len(x) for x in items])
    own = np.zeros((len(items), int(sizes.max())), np.uint8)
    for i, x in enumerate(items):
        own[i, : len(x)] = x
    j = np.arange(int(width.max()))
    column = low[:, None] + j  # bytes of `data` before the cell
    begin, end, beyond = begin[:, None], end[:, None], j >= width[:, None]
    row = np.where(beyond | (column < begin) | (column > end), FAR, 0)  # a match may begin anywhere
    best = np.full(len(items), FAR)
    for r in range(own.shape[1]):
        here = data[np.clip(column, 0, len(data) - 1)]
        new = np.where((column >= begin) & (column < end), row + (here != own[:, r, None]), FAR)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # a byte of the item that the text lacks
        column = column + 1
        new = np.where(column == begin, np.minimum(new, r + 1), new)  # all of the item so far is lacking
        new[beyond | (column < begin) | (column > end)] = FAR
        row = np.minimum.accumulate(new - j, axis=1) + j  # bytes of the text that the item lacks
        done = sizes == r + 1
        best[done] = np.where(beyond, FAR, row)[done].min(1)
    return best


def contaminations(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 40,
                   id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, edits, item_bytes): documents that hold an item with few enough edits.

    Case, signs and white space do not count. An item of m normalized bytes may differ by `rate` * m edits,
    though never by more than leave a q-gram to share. Items of under `least` bytes say too little and are
    left out, as are null ones; an item with a null id is reported with null. Whole texts are searched; a
    null or empty text holds nothing. A repeated document row is reported again, an item once per row. The
    items go out in blocks of at most ITEMS bytes, each held against all documents, however many there are.
    """
    out = None
    for items in _blocks(benchmark, rate, least, item_col, item_text_col):
        found = _search(docs, items, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 40, text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item as `contaminations` finds it."""
    for items in _blocks(benchmark, rate, least, item_col, item_text_col):
        docs = _without(docs, items, text_col)
    return docs


def _blocks(benchmark: DataFrame, rate: float, least: int, item_col: str, item_text_col: str):
    """Blocks of at most about ITEMS bytes of items, and at least one."""
    items = texts(benchmark, item_col, item_text_col).withColumn("bytes", F.octet_length("text"))
    blocks = 1 + int(items.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // ITEMS
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block)
        rows = sorted((NO_ID if r.doc_id is None else r.doc_id, r.text) for r in mine.select("doc_id", "text").collect())
        yield Items([i for i, _ in rows], [t for _, t in rows], rate, least)


def _parts(batch: pa.RecordBatch):
    """(first, end, normalized bytes, offsets) of runs of the texts of a batch."""
    for first, _, data, at in text_slices(batch, BLOCK):
        for a, b in slices(np.diff(at) + DOC_COST, BLOCK):
            yield first + a, first + b, *normalized(data[at[a] : at[b]], at[a : b + 1] - at[a])


def _without(docs: DataFrame, items: Items, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches):
        for batch in batches:
            found = np.zeros(batch.num_rows, bool)
            if len(shared.value.ids):
                for first, end, data, at in _parts(only_text(batch, text_col)):
                    hits = _matches(shared.value, np.arange(first, end), data, at)
                    found[hits.column("doc_id").to_numpy()] = True
            yield batch.filter(pa.array(~found))

    return docs.mapInArrow(work, docs.schema)


def _search(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches):
        for batch in batches:
            if len(shared.value.ids):
                ids = ids_of(batch.column("doc_id"))
                for first, end, data, at in _parts(batch):
                    yield _matches(shared.value, ids[first:end], data, at)

    return texts(docs, id_col, text_col).mapInArrow(
        work, "doc_id long, item_id long, edits long, item_bytes long")


def _matches(items: Items, ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    doc, item, band, _ = items.candidates(data, at)
    edits = items.edits_of(data, at, doc, item, band)
    good = edits <= items.edits[item]
    doc, item, edits = doc[good], item[good], edits[good]
    order = np.lexsort((edits, item, doc))
    doc, item, edits = doc[order], item[order], edits[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    ids, names = ids[doc[first]], items.ids[item[first]]
    return pa.RecordBatch.from_arrays([
        ids_back(ids), ids_back(names),
        pa.array(edits[first]), pa.array(items.size[item[first]])], ["doc_id", "item_id", "edits", "item_bytes"])

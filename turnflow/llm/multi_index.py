"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

The two halves of a vector are quantized separately, so a pair of centroids is a cell. A query walks the
pairs from the nearest on, by the sum of both halves' distances, with a heap, until its cells hold enough
entries; the entries of these cells are ranked by their exact inner product.
"""

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnflow.llm.common import shuffle_parts, written

#: Entries and queries of a block; a pair of blocks is one matrix product.
ENTRIES, QUERIES = 16_384, 256


class Codebook:
    """Centroids of both halves, and the share of all entries that a query has to visit for `recall`."""

    def __init__(self, sample: np.ndarray, centroids: int, recall: float, k: int, seed: int = 3):
        self.dims = sample.shape[1] if len(sample) else 0
        self.cut = self.dims // 2
        rng = np.random.default_rng(seed)
        self.halves = [_centroids(sample[:, part], centroids, rng) for part in (slice(0, self.cut), slice(self.cut, None))]
        self.share = self._calibrated(sample, recall, k) if len(sample) else 1.0

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        one, two = (_nearest(vectors[:, part], c) for part, c in
                    zip((slice(0, self.cut), slice(self.cut, None)), self.halves, strict=True))
        return one * len(self.halves[1]) + two

    def walk(self, query: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
        """Cells from the nearest on until they hold `wanted` entries; distance is minus the inner product."""
        one, two = -(self.halves[0] @ query[: self.cut]), -(self.halves[1] @ query[self.cut :])
        first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
        a, b = one[first].tolist(), two[second].tolist()
        first, second, wide = first.tolist(), second.tolist(), len(two)
        heap, taken, found, have = [(a[0] + b[0], 0, 0)], [-1] * len(a), [], 0
        while heap and have < wanted:
            _, i, j = heappop(heap)
            cell = first[i] * wide + second[j]
            taken[i] = j
            if counts[cell]:
                found.append(cell)
                have += counts[cell]
            # a pair enters once both its left and its upper neighbour have been taken
            if i + 1 < len(a) and taken[i + 1] == j - 1:
                heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or taken[i - 1] > j):
                heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return found

    def _calibrated(self, sample: np.ndarray, recall: float, k: int) -> float:
        """Smallest share, in steps of a twentieth, with the wanted recall against brute force on the sample."""
        cells = self.cells(sample)
        counts = np.bincount(cells, minlength=len(self.halves[0]) * len(self.halves[1])).tolist()
        asked = sample[:: max(1, len(sample) // 200)]
        k = min(k, len(sample))
        best = np.argpartition(-(asked @ sample.T), k - 1, axis=1)[:, :k]
        walks = [self.walk(q, counts, len(sample)) for q in asked]
        for share in np.arange(0.05, 1.0, 0.05):
            hit = 0.0
            for q in range(len(asked)):
                ends = np.cumsum([counts[c] for c in walks[q]])
                seen = walks[q][: int(np.searchsorted(ends, max(k + 1, share * len(sample)))) + 1]
                hit += np.isin(cells[best[q]], seen).mean()
            if hit / len(asked) >= recall:
                return float(share)
        return 1.0


def _centroids(rows: np.ndarray, n: int, rng) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random."""
    if not len(rows):
        return np.zeros((1, rows.shape[1]))
    found = rows[rng.permutation(len(rows))[:n]].copy()
    for _ in range(12):
        at = _nearest(rows, found)
        sums, counts = np.zeros_like(found), np.bincount(at, minlength=len(found))
        np.add.at(sums, at, rows)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * rows @ centroids.T, axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and finite components that are not all zero."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound
                      & F.exists("vector", lambda x: x != 0))


def fit(rows: DataFrame, centroids: int = 32, recall: float = 0.95, k: int = 20, max_sample: int = 20_000) -> Codebook:
    """Codebook from at most `max_sample` of the usable rows, those of smallest id hash."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("vector").toPandas()
    data = np.array(sample.vector.tolist(), np.float64).reshape(len(sample), -1)
    return Codebook(data, centroids, recall, k)


def nearest(vectors: DataFrame, is_query, k: int = 20, centroids: int = 32, recall: float = 0.95,
            max_sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The `k` nearest found of every query: query_id, rank (from 1), vec_id, score (the inner product in doubles).

    Queries are the rows for which the column expression `is_query` over vec_id holds; candidates are all rows
    with another id. Ties go to the smaller vec_id. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part, nor do rows with a null id; of rows that repeat an id one,
    the least, counts. Every row is indexed; only the codebook comes from a sample. Of equal vectors only the
    k + 1 smallest ids can be among the nearest, so a query visits no more of them. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = written(rows, "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == length.n)
    book = spark.sparkContext.broadcast(fit(rows, centroids, recall, k, max_sample))
    equal = Window.partitionBy("vector").orderBy("vec_id")
    entries = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).select("vec_id", "vector")
    groups = max(1, -(-length["count"] // ENTRIES))
    placed = written(entries.mapInArrow(_placing(book), "vec_id long, cell long, vector binary"), "entries")
    counts = [0] * (len(book.value.halves[0]) * len(book.value.halves[1]))
    for r in placed.groupBy("cell").count().collect():  # a row per cell, whose number is fixed
        counts[r.cell] = r["count"]
    parts = shuffle_parts(spark)
    blocks = (
        placed.withColumn("grp", F.col("cell") % groups)
        .repartitionByRange(min(parts, groups), "grp", "cell", "vec_id").sortWithinPartitions("grp")
        .mapInArrow(_packing, "grp long, ids binary, cells binary, vectors binary"))
    asked = (
        rows.where(is_query).mapInArrow(
            _walking(book, spark.sparkContext.broadcast(counts), groups, k), "g long, queries binary, wanted binary, asked binary"))
    found = blocks.join(asked, F.col("grp") == F.col("g")).select(
        "ids", "cells", "vectors", "queries", "wanted", "asked"
    ).mapInArrow(_ranking(book.value.dims, groups, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _placing(book):
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                data = np.array(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(book.value.cells(data).astype(np.int64)),
                     pa.array([v.tobytes() for v in data], pa.binary())], ["vec_id", "cell", "vector"])

    return work


def _packing(batches):
    """Blocks of at most ENTRIES entries of one group."""

    def packed(rows):
        table = pa.concat_tables(rows).combine_chunks()
        return pa.RecordBatch.from_pydict({
            "grp": [table.column("grp")[0].as_py()],
            "ids": [table.column("vec_id").to_numpy().tobytes()], "cells": [table.column("cell").to_numpy().tobytes()],
            "vectors": [b"".join(table.column("vector").to_pylist())]})

    rows, group, size = [], None, 0
    for batch in batches:
        groups = batch.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            while a < b:
                if rows and (groups[a] != group or size == ENTRIES):
                    yield packed(rows)
                    rows, size = [], 0
                group, end = groups[a], min(b, a + ENTRIES - size)
                rows.append(pa.table(batch.slice(a, end - a)))
                size, a = size + end - a, end
    if rows:
        yield packed(rows)


def _walking(book, counts, groups, k):
    """Blocks of queries, for each group of cells that one of them visits, with who visits which cell.

    A query visits k entries besides its own at least, if there are as many.
    """

    def work(batches):
        wide = len(counts.value)
        least = max(k + 1, book.value.share * sum(counts.value))
        for batch in batches:
            for first in range(0, batch.num_rows, QUERIES):
                part = batch.slice(first, QUERIES)
                data = np.array(part.column("vector").flatten()).reshape(part.num_rows, -1)
                visits = np.zeros((part.num_rows, wide), bool)
                for q in range(len(data)):
                    visits[q, book.value.walk(data[q], counts.value, least)] = True
                for g in range(groups):
                    mine = visits[:, g::groups]
                    some = mine.any(1)
                    if some.any():
                        yield pa.RecordBatch.from_arrays([
                            pa.array([g]), pa.array([part.column("vec_id").to_numpy()[some].tobytes()], pa.binary()),
                            pa.array([np.packbits(mine[some], axis=1).tobytes()], pa.binary()),
                            pa.array([data[some].tobytes()], pa.binary())], ["g", "queries", "wanted", "asked"])

    return work


def _ranking(dims: int, groups: int, k: int):
    def work(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                ids, cells, vectors, queries, wanted, asked = (x.as_py() for x in row)
                ids, cells = np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int64)
                queries = np.frombuffer(queries, np.int64)
                visits = np.unpackbits(np.frombuffer(wanted, np.uint8).reshape(len(queries), -1), axis=1)
                # a group holds every `groups`-th cell
                allowed = visits[:, cells // groups].astype(bool) & (queries[:, None] != ids)
                yield _top(ids, np.frombuffer(vectors, np.float64).reshape(-1, dims), queries,
                           np.frombuffer(asked, np.float64).reshape(-1, dims), allowed, k)

    return work


def _top(ids, entries, queries, asked, allowed, k: int) -> pa.RecordBatch:
    """The k best entries of a block for each query, ties by smaller id."""
    scores = np.where(allowed, asked @ entries.T, -np.inf)
    out = []
    for q, row in enumerate(scores):
        border = np.partition(row, -k)[-k] if len(row) > k else -np.inf
        # matrix products may differ in the last digit for equal vectors; the sums below do not
        at = np.flatnonzero((row >= border - 1e-9 * abs(border)) if border > -np.inf else (row > -np.inf))
        exact = (entries[at] * asked[q]).sum(1)
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((np.full(len(best), queries[q]), ids[at][best], exact[best]))
    one, two, three = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(three)], ["query_id", "vec_id", "score"])

"""Vector code compression: one codebook per part of the vectors, learnt by Ball k-means in whole numbers.

An entry with the parts assigned to it is a ball: its centre is the entry, its radius the distance of its
farthest part. An entry can only lose parts to entries whose centre lies within twice the radius, its
neighbours. A part nearer to its centre than half the way to the nearest neighbour cannot change (the stable
core); around it lie rings, one per neighbour in order of distance, and a part in a ring is compared with
the neighbours up to that ring only. Distances are whole numbers, so all of this is exact.

Every round reads the parts and their codes once: tasks assign, add up the parts of every entry and write
both; what meets are one row per task and entry.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, FloatType, IntegerType, LongType, StructField, StructType

from turnflow.llm.common import release, side_path, written
from turnflow.plans.shared import join_to_groups

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task assigns together; parts compared with all entries together.
BLOCK, COMPARED = 32_768, 4096
#: Rings up to which parts of one entry are compared together, so that few comparisons serve many rings.
BANDS = (1, 4, 16, 64)
#: Squares of whole numbers are exact in double precision up to here.
EXACT = 2**53


@dataclass
class Codes:
    """Rows (vec_id, label, code: one byte per part, error) and the codebooks that the codes refer to."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(c) for book in self.codebooks for c in book.ravel().tolist()).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def largest(width: int) -> int:
    """The largest component for which the error of a vector still fits a long."""
    return int((2**62 / max(width, 1)) ** 0.5) // 2


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Matrix of floor(scale * x), vectors as rows; missing components at the end are 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(largest(width))
    flat = np.clip(np.floor(np.clip(flat, -bound, bound) * scale), -bound, bound).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x from every entry, exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * top * top < EXACT else np.int64
    x, book = x.astype(kind), book.astype(kind)
    found = (x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)
    return found.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row of x the nearest entry, the first of equally near ones, and the squared distance."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), COMPARED):
        found = _squares(x[at : at + COMPARED], book)
        code[at : at + COMPARED] = found.argmin(1)
        error[at : at + COMPARED] = found.min(1)
    return code, error


class Balls:
    """The entries of one codebook, and from each the others in order of distance."""

    def __init__(self, book: np.ndarray):
        self.book = book
        between = _squares(book, book)
        self.order = between.argsort(axis=1, kind="stable")
        self.between = np.take_along_axis(between, self.order, 1)
        self.compared = 0  # distances computed besides those from the own entry

    def reassign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `nearest`, given an entry of every row that is likely to be near."""
        moved, error = code.copy(), ((x - self.book[code]) ** 2).sum(1)
        by_entry = code.argsort(kind="stable")
        edges = np.searchsorted(code[by_entry], np.arange(len(self.book) + 1))
        for entry in np.flatnonzero(np.diff(edges)).tolist():
            members = by_entry[edges[entry] : edges[entry + 1]]
            radius = int(error[members].max())
            # centres within twice the radius, the own one (and equal ones) first
            neighbours = int(np.searchsorted(self.between[entry], 4 * radius, side="right"))
            rings = np.searchsorted(self.between[entry, :neighbours], 4 * error[members], side="right")
            for low, high in zip(BANDS, (*BANDS[1:], neighbours), strict=True):
                ring = members[(rings > low) & (rings <= high)]
                if len(ring):
                    self._within(x, ring, np.sort(self.order[entry, : min(high, neighbours)]), moved, error)
        return moved, error

    def _within(self, x, ring, candidates, moved, error) -> None:
        """Move the parts of a ring to the nearest of its candidates, which hold their own entry."""
        code, found = nearest(x[ring], self.book[candidates])
        moved[ring], error[ring] = candidates[code], found
        self.compared += len(ring) * len(candidates)


def _blocks(batches):
    """Batches put together to about BLOCK rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(block: pa.Table, books, balls, width: int, scale: int):
    """Whole numbers, codes (one column per part) and errors of a block of vectors."""
    x = whole_numbers(block.column("vector").combine_chunks() if block.num_rows else block.column("vector"), width, scale)
    step = width // len(books)
    codes, error = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
    known = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1) if "code" in block.column_names else None
    for p, book in enumerate(books):
        part = x[:, p * step : (p + 1) * step]
        found, far = nearest(part, book) if known is None else balls[p].reassign(part, known[:, p].astype(np.int64))
        codes[:, p] = found
        error += far
    return x, codes, error


def _as_bytes(codes: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(codes).tobytes()
    step = codes.shape[1]
    return pa.array([flat[i : i + step] for i in range(0, len(flat), step)], pa.binary())


def _assigned(rows: DataFrame, books: list[np.ndarray], width: int, scale: int, sums: bool) -> DataFrame:
    """Rows with new codes and errors; with `sums`, also one row per task and entry: what its parts add up to."""
    shared, step = rows.sparkSession.sparkContext.broadcast(books), width // len(books)
    names = ["is_sum", "vec_id", "label", "vector", "code", "slot", "n", "total"] if sums else ["vec_id", "label", "code", "error"]
    kinds = {"is_sum": BooleanType(), "vec_id": LongType(), "code": BinaryType(), "error": LongType(), "slot": IntegerType(),
             "n": LongType(), "total": ArrayType(LongType())} | {c: rows.schema[c].dataType for c in ("label", "vector")}

    def work(batches):
        books = shared.value
        balls = [Balls(book) for book in books]
        n = np.zeros((len(books), ENTRIES), np.int64)
        total = np.zeros((len(books), ENTRIES, step), np.int64)
        kept = None
        for block in _blocks(batches):
            kept = block.schema
            x, codes, error = _coded(block, books, balls, width, scale)
            if not sums:
                yield from _batches([block.column("vec_id"), block.column("label"), _as_bytes(codes), pa.array(error)], names)
                continue
            for p in range(len(books)):
                order = codes[:, p].argsort(kind="stable")
                used, at = np.unique(codes[order, p], return_index=True)
                n[p, used] += np.diff(np.r_[at, len(order)])
                total[p, used] += np.add.reduceat(x[order, p * step : (p + 1) * step], at, axis=0) if step else 0
            size = len(x)
            yield from _batches([pa.array(np.zeros(size, bool)), block.column("vec_id"), block.column("label"), block.column("vector"),
                                 _as_bytes(codes), pa.nulls(size, pa.int32()), pa.nulls(size, pa.int64()),
                                 pa.nulls(size, pa.list_(pa.int64()))], names)
            release()
        if sums and kept is not None:
            slots = np.flatnonzero(n.ravel())
            size, flat = len(slots), total.reshape(-1, step)[slots]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * step), pa.array(flat.ravel()))
            nothing = [pa.nulls(size, kept.field(c).type) for c in ("vec_id", "label", "vector")]
            yield from _batches([pa.array(np.ones(size, bool)), *nothing, pa.nulls(size, pa.binary()),
                                 pa.array(slots.astype(np.int32)), pa.array(n.ravel()[slots]), lists], names)

    return rows.mapInArrow(work, StructType([StructField(c, kinds[c]) for c in names]))


def _batches(columns: list, names: list[str]):
    yield from pa.table(dict(zip(names, columns, strict=True))).combine_chunks().to_batches(max_chunksize=8192)


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Every entry at the floor of the mean of its parts; one without parts stays."""
    place = sums.select("slot", "n", F.posexplode("total").alias("at", "value"))
    out = [book.copy() for book in books]
    for row in place.groupBy("slot", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        part, entry = divmod(row["slot"], ENTRIES)
        out[part][entry, row["at"]] = row["value"] // row["n"]
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of every vector: one byte per part, the nearest entry of the part's codebook.

    Components x count as floor(scale * x). The codebooks start from the vectors of the ENTRIES smallest ids
    (null ids last, equal ids by their vectors; fewer vectors give fewer entries); each round assigns all parts
    and moves every entry to the floor of its parts' mean, and a last assignment gives codes and errors. Of equally near entries the
    first counts. Rows whose vector is null or holds null or non-finite components are left out; repeated rows,
    null ids and null labels stay; other columns are ignored; an empty table gives no rows and no entries.
    Vectors shorter than the longest, or not divisible by `parts`, are filled with zeros at their end. Components
    beyond `largest(width)` are held there, so that every error fits a long.

    Broadcast and sent to the driver: codebooks and their sums, at most ENTRIES times the width of a vector.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    vector = F.col(f"`{vector_col}`").cast("array<float>" if plain else "array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                          vector.alias("vector")).where(finite(F.col("vector")))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-width // parts) * parts
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    x = whole_numbers(pa.array([list(r["vector"]) for r in first], pa.list_(pa.float64())), width, scale)
    books = [np.ascontiguousarray(part) for part in np.split(x, parts, axis=1)] if first else [np.zeros((0, 0), np.int64)] * parts
    if not first:
        return Codes(rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books)
    before = None
    for _ in range(rounds):
        done = _assigned(rows, books, width, scale, sums=True)
        path = side_path(spark, "ball-codes")
        done.write.partitionBy("is_sum").parquet(path)
        read = lambda of, cols: spark.read.schema(done.select(*cols).schema).parquet(f"{path}/is_sum={of}")  # noqa: B023, E731
        books = _moved(books, read("true", ("slot", "n", "total")))
        rows = read("false", ("vec_id", "label", "vector", "code"))
        _forget(spark, before)
        before = path
    return Codes(written(_assigned(rows, books, width, scale, sums=False), "ball-codes"), books)


def _forget(spark, path: str | None) -> None:
    """Delete a table that the one written after it replaces."""
    if path is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add label_error: the errors of all rows with the same label added up, null labels together."""
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = rows.groupBy(F.col("label").alias("_label")).agg(
        F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error"))
    return join_to_groups(rows, sums, ["label"])

"""What several operators of this folder share."""

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.plans.shared import shared_folder, ship_code, written  # noqa: F401

#: Stands for a null id where ids travel in packed arrays; it sorts before every other id.
NO_ID = np.iinfo(np.int64).min


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the shared tables, read by Spark, after the code has been sent to the workers."""
    return ship_code(spark).read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Id and whole text under fixed names, and the columns named in `more`; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`") for c in more],
    )


def fresh(docs: DataFrame, name: str) -> str:
    """A column name like `name` that `docs` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the one place where the user sizes them to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def side_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """64-bit ids of an Arrow column, nulls as NO_ID."""
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_back(ids: np.ndarray) -> pa.Array:
    """Arrow column of `ids`, NO_ID as null."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def slices(sizes: np.ndarray, most: int):
    """Cut consecutive items into runs of about `most` in total: (first, end) pairs."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def text_bytes(column: pa.Array, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts `first` to `end` end to end, and where each begins and the last ends."""
    part = column.slice(first, end - first)
    if not isinstance(part, pa.Array):
        part = part.combine_chunks()
    if not pa.types.is_large_string(part.type):
        part = part.cast(pa.large_string())
    offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = part.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, most: int, column: str = "text"):
    """(first, end, bytes, offsets) of runs of texts of about `most` bytes; a longer text is a run alone."""
    values = batch.column(column)
    if not len(values):
        return
    _, offsets = text_bytes(values, 0, len(values))
    for first, end in slices(np.diff(offsets), most):
        data, at = text_bytes(values, first, end)
        yield first, end, data, at


def only_text(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """The texts of a batch under a fixed name, nulls as empty."""
    return pa.RecordBatch.from_arrays([pc.fill_null(batch.column(text_col).cast(pa.string()), "")], ["text"])


def release() -> None:
    """Give the memory of finished work back to the system; a Python worker lives on with what it keeps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(work):
    """A function of one table, or of two, that releases memory when it is done."""

    def one(table: pa.Table) -> pa.Table:
        out = work(table)
        release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return one if work.__code__.co_argcount == 1 else two

"""Token-id files: documents encoded and stored with a range asymmetric numeral system.

One frequency table, counted over all documents, serves all blocks. Documents lie in ascending order of
their id in range partitions; blocks of a fixed number of ids run on over documents. A block knows which
documents it holds and where in its partition it begins, so blocks decode in any order and in parallel.
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnflow.llm import rans
from turnflow.llm.common import release, shuffle_parts, side_path, text_slices, texts, written
from turnflow.llm.words import word_ids

#: Bytes of text encoded at a time, ids coded at a time, and the blocks that are decoded together.
TEXT, CODED, DECODED = 1_000_000, 48 * rans.BLOCK, 32
BLOCKS = ("part int, row long, start long, doc_ids array<long>, counts array<long>, goes_on boolean, ends boolean, "
          "frame binary")


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows (part, row, start, doc_id, ids) in ascending id order: range partition, number and ids before in it.

    `ids` are little-endian, two bytes each if the vocabulary allows, else four; their type is returned last. What
    every task has counted while it encoded, (id, n), comes second.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    size = max(Tokenizer.from_str(vocabulary).get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    # equal ids are spread and ordered by their text
    ordered = texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    ordered = (
        ordered.repartitionByRange(shuffle_parts(spark), F.asc_nulls_first("doc_id"), "mark")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "mark", "text").select("doc_id", "text")
    )

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, t)) for name, t in FIELDS.items()], list(FIELDS))

    def work(batches):
        words, part, row, start = word_ids(shared.value), TaskContext.get().partitionId(), 0, 0
        total = np.zeros(size, np.int64)
        for batch in batches:
            for first, end, data, at in text_slices(batch, TEXT):
                whole = data.tobytes()
                ids, n = words.encode([whole[a:b] for a, b in zip(at, at[1:])])
                total += np.bincount(ids, minlength=size)
                total[end_id] += len(n)
                ends = np.cumsum(n)
                packed = [np.append(ids[e - k : e], end_id).astype(kind).tobytes() for e, k in zip(ends, n)]
                starts = start + ends - n + np.arange(len(n))
                yield rows(is_count=pa.array(np.zeros(len(n), bool)), part=pa.array(np.full(len(n), part, np.int32)),
                           row=pa.array(np.arange(row, row + len(n))), start=pa.array(starts),
                           doc_id=batch.column("doc_id").slice(first, end - first), ids=pa.array(packed, pa.binary()))
                row, start = row + len(n), start + int(n.sum()) + len(n)
            release()
        used = np.flatnonzero(total)
        if len(used):
            yield rows(is_count=pa.array(np.ones(len(used), bool)), id=pa.array(used), n=pa.array(total[used]))

    path = side_path(spark, "token-ids")
    out = ordered.mapInArrow(work, "is_count boolean, part int, row long, start long, doc_id long, ids binary, id long, n long")
    out.write.partitionBy("is_count").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(out.schema).parquet(path)
    tokens = stored.where(~F.col("is_count")).select("part", "row", "start", "doc_id", "ids")
    return tokens, stored.where("is_count").select("id", "n"), kind


FIELDS = {"is_count": pa.bool_(), "part": pa.int32(), "row": pa.int64(), "start": pa.int64(), "doc_id": pa.int64(),
          "ids": pa.binary(), "id": pa.int64(), "n": pa.int64()}


class _Run:
    """Consecutive documents whose ids are waiting to be coded."""

    def __init__(self, part: int, row: int, start: int):
        self.part, self.row, self.start, self.goes_on = part, row, start, False
        self.ids, self.doc_ids, self.counts, self.size = [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.size += len(ids)

    def take(self, table: rans.Table, all_: bool) -> list[tuple]:
        """Block rows; ids of an unfinished block stay."""
        joined = np.concatenate([*self.ids, np.zeros(0, np.uint16)])
        n = len(joined) if all_ else len(joined) // rans.BLOCK * rans.BLOCK
        ends, rows, doc = np.cumsum(self.counts), [], 0
        for b, frame in enumerate(rans.encode(table, joined[:n])):
            low, high = b * rans.BLOCK, min(n, (b + 1) * rans.BLOCK)
            last = int(np.searchsorted(ends, high))  # the document with the last id
            begins = np.r_[0, ends][doc : last + 1]
            counts = np.minimum(ends[doc : last + 1], high) - np.maximum(begins, low)
            rows.append((self.part, self.row + doc, self.start + low, self.doc_ids[doc : last + 1], counts.tolist(),
                         bool(begins[0] < low) or (b == 0 and self.goes_on), bool(ends[last] == high), frame))
            doc = last + (ends[last] == high)
        cut = bool(n) and doc < len(ends) and bool(ends[doc] - self.counts[doc] < n)
        self.goes_on = cut or (self.goes_on and not n)
        self.row, self.start, self.doc_ids = self.row + doc, self.start + n, self.doc_ids[doc:]
        self.ids = [joined[n:]] if len(joined) > n else []
        self.counts = self.counts[doc:]
        if cut:
            self.counts[0] = int(ends[doc] - n)
        self.size = len(joined) - n
        return rows


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write `path`/frequencies and `path`/blocks.

    Every whole text is encoded without special tokens added, and `end_id` is appended. Null ids come first;
    equal ids lie in the order of their text's hash, each row a document of its own. A null or empty text has
    the end id alone. Other columns are ignored; an empty table gives no blocks. Spark's writers commit both
    tables, so a lost executor repeats its tasks and leaves no half-written block.
    """
    spark = docs.sparkSession
    tokens, counts, kind = token_ids(docs, vocabulary, end_id, id_col, text_col)
    counted = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()  # bounded by the vocabulary
    ids, counts = np.array([r.id for r in counted], np.int64), np.array([r.n for r in counted], np.int64)
    scaled = rans.Table.scaled(counts)
    rows = [(int(i), int(f)) for i, f in zip(ids, scaled, strict=True)]
    spark.createDataFrame(rows, "id long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shared = spark.sparkContext.broadcast(rans.Table(ids, scaled))

    def work(batches):
        run = None
        for batch in batches:
            for part, row, start, doc_id, packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run is None or run.part != part or run.row + len(run.doc_ids) != row:
                    if run is not None:
                        yield _block_rows(run.take(shared.value, True))
                    run = _Run(part, row, start)
                run.add(doc_id, np.frombuffer(packed, kind))
                if run.size >= CODED:
                    yield _block_rows(run.take(shared.value, False))
        if run is not None:
            yield _block_rows(run.take(shared.value, True))

    tokens.select("part", "row", "start", "doc_id", "ids").mapInArrow(work, BLOCKS).write.option(
        "compression", "uncompressed").parquet(f"{path}/blocks")


def _block_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_(),
             pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    names = ["part", "row", "start", "doc_ids", "counts", "goes_on", "ends", "frame"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents: part, row, doc_id, start, whole, ids (little-endian, four bytes each).

    `row` numbers the documents of a range partition, `start` counts the ids before the piece in it. A piece
    is a whole document unless a block's end cuts it. Checksums of blocks are verified; a damaged one fails.
    """
    rows = spark.read.parquet(f"{path}/frequencies").orderBy("id").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(rans.Table(
        np.array([r.id for r in rows], np.int64), np.array([r.frequency for r in rows], np.int64)))

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, DECODED):
                blocks = batch.slice(first, DECODED).to_pylist()
                found = rans.decode(shared.value, [b["frame"] for b in blocks])
                for b, ids in zip(blocks, found, strict=True):
                    yield _pieces(b, ids)

    return spark.read.parquet(f"{path}/blocks").select(
        "part", "row", "start", "doc_ids", "counts", "goes_on", "ends", "frame"
    ).mapInArrow(work, "part int, row long, doc_id long, start long, whole boolean, ids binary")


def _pieces(block: dict, ids: np.ndarray) -> pa.RecordBatch:
    n = np.array(block["counts"], np.int64)
    ends = np.cumsum(n)
    whole = np.ones(len(n), bool)
    whole[0] &= not block["goes_on"]
    whole[-1] &= block["ends"]
    raw = ids.astype("<u4").tobytes()
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(n), block["part"], np.int32)), pa.array(block["row"] + np.arange(len(n))),
        pa.array(block["doc_ids"], pa.int64()), pa.array(block["start"] + ends - n), pa.array(whole),
        pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(ends, n)], pa.binary()),
    ], ["part", "row", "doc_id", "start", "whole", "ids"])


def checksums(pieces: DataFrame) -> DataFrame:
    """One row per document of `read_token_files`: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def work(batches):
        for batch in batches:
            raw = [x.as_py() for x in batch.column("ids")]
            n = pa.array([len(x) // 4 for x in raw], pa.int64())
            crc = pa.array([crc32(x) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("part", "row", "doc_id", "start", "whole")), n, crc],
                ["part", "row", "doc_id", "start", "whole", "n_tokens", "crc"])

    def joined(batches):
        # pieces of a document in the order of their blocks; a document has few
        for batch in batches:
            for row in batch.to_pylist():
                crc = 0
                for piece in row["pieces"]:
                    zeros = bytes(4 * piece["n_tokens"])
                    crc = piece["crc"] ^ crc32(zeros, crc) ^ crc32(zeros)
                yield pa.RecordBatch.from_pylist([{
                    "part": row["part"], "doc_id": row["doc_id"], "start": row["pieces"][0]["start"],
                    "n_tokens": sum(p["n_tokens"] for p in row["pieces"]), "crc": crc}], schema)

    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("n_tokens", pa.int64()), ("crc", pa.int64())])
    kind = "part int, row long, doc_id long, start long, whole boolean, n_tokens long, crc long"
    found = written(pieces.mapInArrow(work, kind), "piece-sums")
    cut = found.where(~F.col("whole")).groupBy("part", "row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "n_tokens", "crc"))).alias("pieces"))
    rows = found.where("whole").select("part", "doc_id", "start", "n_tokens", "crc").unionByName(
        cut.select("part", "doc_id", "pieces").mapInArrow(joined, "part int, doc_id long, start long, n_tokens long, crc long"))
    per = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # one row per range partition
    return rows.join(F.broadcast(before), F.col("part") == F.col("p")).select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))

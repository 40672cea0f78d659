"""Answers of a costly call, one per row, kept in a log so that none is asked for twice.

The log is a folder that workers reach themselves: a mounted path, or a store that pyarrow knows. A task
appends every answer as soon as it has it, as one JSON line under the row's key. What is logged is asked again neither by a
retried task or a second evaluation, which read the lines of their own partition, nor by a later run, which leaves
logged keys out by a join. Columns that the call does not need pass through as Arrow arrays, untouched.
"""

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnflow.sources.paths import path_exists

#: Respond(list of inputs) gives the answers in order, some at a time, each as a dictionary of the answer's fields.
Respond = Callable[[list], Iterator[list[dict]]]

#: Answers per file; on stores that show a file only when it is closed, what a lost task may have to ask again.
EVERY = 100


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; `file:` and no scheme mean a mounted folder."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class Writer:
    """Appends the answers of one task attempt; a line is flushed as soon as it is written."""

    def __init__(self, folder: str, every: int):
        (self.store, self.folder), self.every = store_of(folder), every
        self.file, self.lines = None, 0

    def add(self, key: list, answer: dict) -> None:
        if self.file is None:
            self.store.create_dir(self.folder, recursive=True)
            self.file = self.store.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
        self.file.write((json.dumps({"key": key, "answer": answer}) + "\n").encode())
        self.file.flush()
        self.lines += 1
        if self.lines % self.every == 0:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _own(folder: str) -> dict[str, dict]:
    """Answers that earlier attempts of this partition have logged, by key; a line cut off in the middle is none."""
    store, place = store_of(folder)
    found: dict[str, dict] = {}
    for info in sorted(store.get_file_info(fs.FileSelector(place, allow_not_found=True)), key=lambda i: i.path):
        with store.open_input_stream(info.path) as file:
            for line in file.read().splitlines():
                try:
                    entry = json.loads(line)
                except json.JSONDecodeError:
                    continue
                found.setdefault(json.dumps(entry["key"]), entry["answer"])
    return found


def read_log(spark: SparkSession, path: str, key: T.StructType, answer: T.StructType) -> DataFrame:
    """One row per logged key with its answer; an answer without an error counts before one with."""
    kinds = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(key.fields)])
    line = T.StructType([T.StructField("key", T.ArrayType(T.StringType())), T.StructField("answer", answer)])
    if path_exists(spark, path):
        lines = spark.read.schema(line).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)
    else:
        lines = spark.createDataFrame([], line)
    named = [F.get("key", F.lit(i)).cast(f.dataType).alias(key.fields[i].name) for i, f in enumerate(kinds.fields)]
    good = F.struct(F.col("answer.error").isNotNull().alias("failed"), "answer") if "error" in answer.names else F.struct("answer")
    return (
        lines.where(F.col("answer").isNotNull()).select(*named, good.alias("_of"))
        .groupBy(*key.names).agg(F.min("_of").alias("_of")).select(*key.names, F.col("_of.answer.*"))
    )


def with_answers(
    rows: DataFrame, column: str, load: Callable[[], Respond], answer: T.StructType, log: str | None = None,
    key: tuple[str, ...] = (), keep: bool = True, every: int = EVERY, retry_errors: bool = True,
) -> DataFrame:
    """Add the fields of `answer`, made of `column` by the function that `load` gives once per task.

    With `log`, a row is named by its `key` columns (numbers, strings or booleans; rows with the same key in one partition
    share an answer) and is asked once, however often its task or the whole job is run again. Answers that an earlier run
    logged are joined to their rows; those with an error are asked again, unless `retry_errors` is off. Without
    `keep` the column itself is dropped. Speculative copies of a task ask on their own.
    """
    others = [c for c in rows.columns if keep or c != column]
    out = T.StructType([*[rows.schema[c] for c in others], *answer.fields])
    if log is None:
        return rows.mapInArrow(_asking(column, others, load, answer, None, (), every), out)
    if not key:
        raise ValueError("name the key columns that a logged answer belongs to")
    run = f"{log.rstrip('/')}/run-{uuid.uuid4().hex}"
    ask = _asking(column, others, load, answer, run, key, every)
    known = read_log(rows.sparkSession, log, T.StructType([rows.schema[c] for c in key]), answer)
    if retry_errors and "error" in answer.names:
        known = known.where(F.col("error").isNull())
    if known.isEmpty():
        return rows.mapInArrow(ask, out)
    # null keys match null keys
    known = known.withColumnsRenamed({c: f"_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}`"))
    done = rows.select(*[f"`{c}`" for c in others]).join(known, same).select(*[f"`{f.name}`" for f in out])
    left = rows.join(known.select(*[f"`_{c}`" for c in key]), same, "left_anti")
    return done.unionByName(left.mapInArrow(ask, out))


def _asking(column: str, others: list[str], load, answer: T.StructType, run: str | None, key: tuple[str, ...], every: int):
    fields = [(f.name, to_arrow_type(f.dataType)) for f in answer.fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = None if run is None else f"{run}/{TaskContext.get().partitionId()}"
        known, writer, respond = ({}, None, None) if run is None else (_own(folder), Writer(folder, every), None)
        try:
            for batch in batches:
                size = batch.num_rows
                keys = [[v if v is None else str(v) for v in row] for row in zip(*[batch.column(c).to_pylist() for c in key])] if key else []
                names = [json.dumps(k) for k in keys] or list(range(size))
                made = known if run is not None else {}
                todo = {n: i for i, n in reversed([*enumerate(names)]) if n not in made}
                places = sorted(todo.values())
                if places:
                    respond = respond or load()
                    asked = iter(places)
                    inputs = batch.column(column).take(pa.array(places)).to_pylist()
                    for some in respond(inputs):
                        for one, i in zip(some, asked):
                            made[names[i]] = one
                            if writer is not None:
                                writer.add(keys[i], one)
                answers = [made[n] for n in names]
                added = [pa.array([a.get(name) for a in answers], kind) for name, kind in fields]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in others], *added], [*others, *[name for name, _ in fields]])
        finally:
            if writer is not None:
                writer.close()

    return work

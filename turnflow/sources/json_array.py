"""Files that hold one JSON array, read one entry at a time: memory follows the longest entry, not the file."""

import codecs
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.sources.answer_log import store_of

#: Bytes read at a time, and entries per batch.
READ, BATCH = 1 << 20, 256
SPACE = " \t\r\n"
DECODER = json.JSONDecoder()


class Entries:
    """The entries, as text, of a list, or of the list under `name` in an object; an object without one is the only entry."""

    def __init__(self, file, name: str):
        self.file, self.name = file, name
        self.decode = codecs.getincrementaldecoder("utf-8-sig")().decode
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> None:
        """Read on, at least as much again as is held, so that long entries are not parsed over and over."""
        raw = self.file.read(max(READ, len(self.text) - self.at))
        self.ended = not raw
        self.text, self.at = self.text[self.at :] + self.decode(raw, final=self.ended), 0

    def _next(self) -> str:
        """The next character that is no white space, '' at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in SPACE:
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at : self.at + 1]
            self._more()

    def _value(self) -> tuple[object, str]:
        """The value that begins here, and its text."""
        self._next()
        while True:
            try:
                value, end = DECODER.raw_decode(self.text, self.at)
            except json.JSONDecodeError as error:
                if self.ended:
                    raise ValueError(f"no JSON: {error}") from error
            else:
                # a number may go on behind what is held, or behind a point that is the last of it
                closed = end < len(self.text) and (isinstance(value, (str, list, dict)) or self.text[end] in SPACE + ",]}:")
                if closed or self.ended:
                    text, self.at = self.text[self.at : end], end
                    return value, text
            self._more()

    def _sign(self, *signs: str) -> str:
        found = self._next()
        if found not in signs or not found:
            raise ValueError(f"expected {' or '.join(signs)}, found {found or 'the end'}")
        self.at += 1
        return found

    def _list(self) -> Iterator[str]:
        self._sign("[")
        if self._next() == "]":
            return
        while True:
            yield self._value()[1]
            if self._sign(",", "]") == "]":
                return

    def __iter__(self) -> Iterator[str]:
        if self._next() == "[":
            yield from self._list()
            return
        self._sign("{")
        own = {}
        while self._next() != "}":
            key, _ = self._value()
            self._sign(":")
            if key == self.name and self._next() == "[":
                yield from self._list()
                return
            own[key] = self._value()[0]
            if self._sign(",", "}") == "}":
                break
        yield json.dumps(own)


def read_entries(spark: SparkSession, paths: list[str], name: str = "results", most: int | None = None) -> DataFrame:
    """(`file`, `at`, `entry`): the entries of every file as text, with the number of the file and their place in it.

    A task reads one file as a stream and stops after `most` entries. Workers reach the files themselves: a mounted
    path, or a store that pyarrow knows. A file that is no JSON fails with its name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                store, place = store_of(path)
                with store.open_input_stream(place) as file:
                    yield from _batches(number, path, Entries(file, name), most)

    files = spark.createDataFrame(list(enumerate(paths)), "file long, path string").repartition(max(len(paths), 1), F.col("file"))
    return files.mapInArrow(work, "file long, at long, entry string")


def _batches(number: int, path: str, entries: Entries, most: int | None) -> Iterator[pa.RecordBatch]:
    held, at = [], 0

    def batch() -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_pydict({"file": [number] * n, "at": [*range(at - n, at)], "entry": held})

    try:
        for entry in entries:
            if at == most:
                break
            held.append(entry)
            at += 1
            if len(held) == BATCH:
                yield batch()
                held = []
    except ValueError as error:
        raise ValueError(f"{path}: {error}") from error
    if held:
        yield batch()

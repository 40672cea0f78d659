"""Wrapped result files are read entry by entry."""

import io
import json
import random

import pytest
from pyspark.sql import types as T

from turnflow.sources import json_array, reports
from turnflow.sources.json_array import Entries, read_entries

SCHEMA = T.StructType([T.StructField("original_index", T.LongType()), T.StructField("task", T.StringType())])


class Counting(io.BytesIO):
    """A file that counts what is read of it."""

    def __init__(self, data):
        super().__init__(data)
        self.got = 0

    def read(self, n=-1):
        data = super().read(n)
        self.got += len(data)
        return data


def some(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 4:
        return {f"k{i}": some(rng, depth + 1) for i in range(rng.randrange(4))}
    if kind == 5:
        return [some(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [rng.choice(['a"b\\', "é  ]}", "", "北京"]), rng.random() * 1e6, rng.choice([None, True, -12]), "x" * rng.randrange(40)][kind]


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_entries_whatever_the_layout(size, monkeypatch):
    monkeypatch.setattr(json_array, "READ", size)
    rng = random.Random(size)
    for _ in range(60):
        entries = [some(rng) for _ in range(rng.randrange(6))]
        indent, ascii_ = rng.choice([None, 2]), rng.random() < 0.5
        for whole in (entries, {"config": some(rng), "n": 12, "results": entries, "after": 1}):
            text = json.dumps(whole, indent=indent, ensure_ascii=ascii_)
            file = io.BytesIO(rng.choice([b"", b"\xef\xbb\xbf", b" \n"]) + text.encode() + b"\n")
            assert [json.loads(e) for e in Entries(file, "results")] == entries
    assert [json.loads(e) for e in Entries(io.BytesIO(b'{"original_index": 5}'), "results")] == [{"original_index": 5}]


@pytest.mark.parametrize("text", ["", "[1, 2", "[1 2]", '{"results": [1,}', '{"a" 1}', "nonsense", '[{"a": "cut'])
def test_what_is_no_json_fails(text):
    with pytest.raises(ValueError):
        [*Entries(io.BytesIO(text.encode()), "results")]


def test_memory_follows_an_entry_and_the_first_ones_come_early():
    data = json.dumps({"results": [{"i": i, "text": "word " * 200} for i in range(20_000)]}).encode()
    file = Counting(data)
    entries = Entries(file, "results")
    rows = iter(entries)
    assert [json.loads(next(rows))["i"] for _ in range(10)] == [*range(10)] and file.got <= 2 * json_array.READ
    longest = 0
    for n, _ in enumerate(rows, 11):
        longest = max(longest, len(entries.text))
    assert n == 20_000 and file.got == len(data) and longest <= 3 * json_array.READ


def test_a_large_file_and_its_first_examples(spark, tmp_path):
    file = tmp_path / "results.json"
    file.write_text(json.dumps({"config": {"model": "m"}, "results": [
        {"original_index": 99_999 - i, "task": "t" * 300} for i in range(100_000)]}))
    rows = reports.read_evaluation(spark, str(file), SCHEMA, multi_line=True)
    assert rows.agg({"original_index": "sum"}).first()[0] == sum(range(100_000))
    first = reports.read_evaluation(spark, str(file), SCHEMA, 3, multi_line=True)
    assert sorted(r["original_index"] for r in first.collect()) == [99_997, 99_998, 99_999]
    assert read_entries(spark, [str(file)], most=3).count() == 3


def test_examples_of_json_lines_come_in_file_order(spark, tmp_path):
    for name, ids in (("b.json", (1, 2)), ("a.json", (9, 8, 7))):
        (tmp_path / name).write_text("".join(json.dumps({"original_index": i}) + "\n" for i in ids))
    found = reports.read_evaluation(spark, str(tmp_path), SCHEMA, max_examples=4).collect()
    assert [r["original_index"] for r in found] == [9, 8, 7, 1]


def test_a_broken_file_is_named(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"results": [{"original_index": 1}, {]}')
    with pytest.raises(Exception, match="broken.json"):
        reports.read_evaluation(spark, str(tmp_path / "broken.json"), SCHEMA, multi_line=True).collect()

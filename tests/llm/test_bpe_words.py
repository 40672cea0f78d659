from collections import Counter

import public_tokenizers
from awkward import ROWS, documents, empty
from tokenizers import Tokenizer

from turnflow.llm.bpe_words import decode, encode
from turnflow.llm.words import vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(30, "a  b\n\nc \xa0d   e "), (31, "tab\t\tx\r\n y\x1c z\x85"), (32, " <|endoftext|> <|endoftext|>x"),
       (33, "we're I'll 123 45٣ ½ ²"), (34, "\u2003wide\u3000spaces \u2028"), (35, "  "), (36, "!\x1c!\x1c")]


def test_ids_and_texts_are_those_of_the_library(spark):
    words, library = vocabulary(PATH), Tokenizer.from_file(PATH)
    rows = decode(encode(documents(spark, ROWS + ODD), words), words).collect()
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in rows)
    want = Counter()
    for i, t in ROWS + ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_decode_takes_unknown_and_null_ids(spark):
    words = vocabulary(PATH)
    rows = spark.createDataFrame([(1, [72, 10**6, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(rows, words).collect()} == {1: "i<|endoftext|>", 2: "", 3: ""}


def test_empty_table(spark):
    assert encode(empty(spark), vocabulary(PATH)).count() == 0

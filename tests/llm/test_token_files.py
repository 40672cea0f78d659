import uuid
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from awkward import ROWS, documents, empty
from tokenizers import Tokenizer

from turnflow.llm import rans
from turnflow.llm.common import side_path
from turnflow.llm.token_files import checksums, read_token_files, write_token_files
from turnflow.llm.words import WordIds, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 31, 32, 33, rans.LANES * rans.CHECK, rans.BLOCK, 2 * rans.BLOCK + 77])
def test_frames_give_back_the_ids(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.05, n), 60_000).astype(np.uint16)
    counts = np.bincount(ids)
    live = np.flatnonzero(counts)
    table = rans.Table(live, rans.Table.scaled(counts[live]))
    frames = rans.encode(table, ids)
    assert np.array_equal(np.concatenate(rans.decode(table, frames)), ids)
    broken = bytearray(frames[-1])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        rans.decode(table, [bytes(broken)])


def test_scaled_keeps_every_id_and_the_sum():
    scaled = rans.Table.scaled(np.array([10**12] + [1] * 5000))
    assert scaled.sum() == 1 << rans.SCALE and scaled.min() == 1


def test_a_single_id():
    table = rans.Table(np.array([5]), rans.Table.scaled(np.array([9])))
    ids = np.full(1000, 5, np.uint16)
    assert np.array_equal(rans.decode(table, rans.encode(table, ids))[0], ids)


def test_words_are_encoded_as_the_library_does():
    texts = ["it's <|endoftext|>x don't", "ÀÉ. Ñ, ÿ.", "a\x0bb\x0cc\x1cd\x85e\xa0f", "Σς İ １2", "", " ", *[t or "" for _, t in ROWS]]
    words, library = WordIds(vocabulary(PATH), most=40), Tokenizer.from_file(PATH)
    for text in texts * 2:
        ids, n = words.encode([text.encode()])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids)]


def written(spark, docs):
    path = side_path(spark, "files-" + uuid.uuid4().hex)
    write_token_files(docs, vocabulary(PATH), path, end_id=1)
    return read_token_files(spark, path)


def test_awkward_documents(spark):
    many = ROWS + [(20, "ab cd ef " * 60_000), (21, "tail")]
    got = checksums(written(spark, documents(spark, many))).collect()
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, t in many:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), crc32(ids.tobytes())))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, *x) for i, v in want.items() for x in v)
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_ids_read_back_are_those_of_the_text(spark):
    rows = written(spark, documents(spark)).where("doc_id = 8").collect()
    ids = Tokenizer.from_file(PATH).encode(dict(ROWS)[8], add_special_tokens=False).ids
    assert np.frombuffer(rows[0].ids, "<u4").tolist() == [*ids, 1]


def test_empty_table(spark):
    assert checksums(written(spark, empty(spark))).count() == 0

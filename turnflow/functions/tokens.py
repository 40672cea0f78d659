"""Tokens of a text: the built-in tokenizer and the hook for a user's own."""

import uuid
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnflow.constants import PAD_ID, PIECE, VOCAB_SIZE, WORD_JOINT


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(pieces(text))


def joins_words(left: Column, right: Column) -> Column:
    """Whether one piece reaches over the place where two texts meet: a word goes on there."""
    return F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1))).rlike(WORD_JOINT)


def piece_id(piece: Column) -> Column:
    """Id of a piece: the first 32 bits of its digest modulo the vocabulary size."""
    return (F.conv(F.substring(F.md5(piece), 1, 8), 16, 10).cast("long") % VOCAB_SIZE).cast("int")


def piece_ids(found: Column) -> Column:
    return F.transform(found, piece_id)


#: encode(texts) gives per text its ids and the character at which each of them starts.
Encode = Callable[[list[str]], list[tuple[list[int], list[int]]]]

_LOADED: dict[str, Encode] = {}


class WorkerTokenizer:
    """A tokenizer that every Python worker loads once, however many tasks and columns use it.

    Called with texts it gives their ids, so it goes wherever a function of texts does. `load` is sent to the workers
    and run there; what it loads, such as a vocabulary, is not.
    """

    def __init__(self, load: Callable[[], Encode]):
        self.load, self.key = load, uuid.uuid4().hex

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        if self.key not in _LOADED:
            _LOADED[self.key] = self.load()
        return _LOADED[self.key](texts)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [ids for ids, _ in self.encode(texts)]


def tokenize(text: Column, tokenizer: Callable[[list[str]], list[list[int]]] | None = None) -> Column:
    """Token ids of a text, by the built-in tokenizer or by a user's batch function."""
    if tokenizer is None:
        return piece_ids(pieces(text))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(tokenizer(texts.tolist()))

    return encode(text)


def tokenize_at(text: Column, cut: Column, tokenizer: WorkerTokenizer) -> Column:
    """Struct of the `ids` of a text and `before`, how many of them start before character `cut`, in one pass."""

    @F.pandas_udf("struct<ids: array<int>, before: int>")
    def encode(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        found = tokenizer.encode(texts.tolist())
        return pd.DataFrame({"ids": [ids for ids, _ in found],
                             "before": [bisect_left(starts, cut) for (_, starts), cut in zip(found, cuts, strict=True)]})

    return encode(text, cut)


def pad_id(configured: int | None, end_of_text: int = PAD_ID) -> int:
    return end_of_text if configured is None else configured


def pad(ids: Column, length, value: int) -> Column:
    """Fill an id list up to `length` on the right."""
    missing = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(value), missing))


def attention_mask(kept: Column, length) -> Column:
    """Ones for the kept tokens, zeros up to `length`."""
    missing = F.greatest(F.lit(length) - kept, F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), missing))

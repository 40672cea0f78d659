"""Toxicity: a factorization machine over hashed terms.

Each distinct term of a text has a weight and a short vector; the inner products of the vectors of all
pairs of terms that occur together add to the score. So a pair, such as an insult and the mention of
a group, can count for more than the sum of its parts.
"""

from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.llm.common import texts

#: Characters that do not belong to a term at its ends.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…"
#: Lengths of the beginnings of words that are terms too.
STEMS = (4, 5, 6)


class Terms(dict):
    """Buckets of the terms of a word, kept per word: the word without signs at its ends, and the
    beginnings of longer words, which inflected forms share. `place` maps buckets to what is kept of them.

    The kept words are forgotten when they are MOST, which bounds memory and changes no result.
    """

    MOST = 300_000

    def __init__(self, bits: int, place: np.ndarray | None = None):
        super().__init__()
        self.mask, self.place = (1 << bits) - 1, None if place is None else place.tolist()

    def __missing__(self, word: str) -> tuple[int, ...]:
        bare = word.strip(EDGES)
        terms = [bare, *(bare[:size] + "-" for size in STEMS if len(bare) > size)]
        found = {crc32(t.encode()) & self.mask for t in terms if t}
        if self.place is not None:
            found = {self.place[b] for b in found} - {-1}
        if len(self) >= self.MOST:
            self.clear()
        self[word] = out = tuple(found)
        return out

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct terms of a whole text."""
        found = set(chain.from_iterable(map(self.__getitem__, set(text.lower().split()))))
        return np.sort(np.fromiter(found, np.int32, len(found)))


class Machine:
    """Bias, weights and vectors of all terms that `least` or more of the rows hold; others count nothing.

    `rows` are arrays of buckets, `labels` 0 or 1. Learning is by AdaGrad on the logistic loss in mini-batches
    of a fixed order, so the same rows give the same machine. No term is judged before it is learnt: weights
    and vectors shrink by `shrink_w` and `shrink_v` standard errors of their slopes in a round, so those
    that explain nothing beside the other terms come to rest at zero.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, bits: int, factors: int = 4, least: int = 3,
                 shrink_w: float = 1.5, shrink_v: float = 3.0, rounds: int = 15, batch: int = 128, step: float = 0.1,
                 seed: int = 11):
        size = 1 << bits
        rate = float(labels.mean()) if len(labels) else 0.5
        flat = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
        seen = np.bincount(flat, minlength=size)
        kept = np.flatnonzero(seen >= least)
        self.place = np.full(size, -1, np.int32)
        self.place[kept] = np.arange(len(kept))
        rng = np.random.default_rng(seed)
        self.bias = float(np.log(max(rate, 1e-4) / max(1 - rate, 1e-4)))
        self.weights = np.zeros(len(kept))
        self.vectors = rng.normal(0, 0.01, (len(kept), factors))
        slope_w, slope_v, slope_b = np.full(len(kept), 1e-8), np.full((len(kept), factors), 1e-8), 1e-8
        spread = np.sqrt(rate * (1 - rate) / seen[kept])  # standard error of a term's slope, per row that holds it
        mine = [self._known(r) for r in rows]
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for first in range(0, len(order), batch):
                chosen = order[first : first + batch]
                terms, doc = self._packed([mine[i] for i in chosen])
                margin, sums = self._margins(terms, doc, len(chosen))
                error = 1 / (1 + np.exp(-margin)) - labels[chosen]
                if not len(terms):
                    continue
                touched, at = np.unique(terms, return_inverse=True)
                each, n = error[doc], len(touched)
                less = spread[touched] * np.bincount(at, minlength=n)
                grad_w = np.bincount(at, each, n)
                # slope of the pair term: the sum of the vectors of the other terms
                inner = (sums[doc] - self.vectors[terms]) * each[:, None]
                grad_v = np.stack([np.bincount(at, inner[:, k], n) for k in range(factors)], 1)
                slope_w[touched] += grad_w**2
                slope_v[touched] += grad_v**2
                slope_b += error.sum() ** 2
                pace = step / np.sqrt(slope_w[touched])
                moved = self.weights[touched] - pace * grad_w
                self.weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - pace * shrink_w * less, 0)
                moved = self.vectors[touched] - step * grad_v / np.sqrt(slope_v[touched])
                pace = step / np.sqrt(slope_v[touched].mean(1)) * np.sqrt((sums**2).sum(1).mean())
                length = np.sqrt((moved**2).sum(1)) + 1e-12
                self.vectors[touched] = moved * np.maximum(1 - pace * shrink_v * less / length, 0)[:, None]
                self.bias -= step * error.sum() / np.sqrt(slope_b)

    def _known(self, row: np.ndarray) -> np.ndarray:
        found = self.place[row]
        return found[found >= 0]

    @staticmethod
    def _packed(rows: list[np.ndarray]):
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), doc

    def _margins(self, terms, doc, n):
        vectors = self.vectors[terms]
        sums = np.stack([np.bincount(doc, vectors[:, k], n) for k in range(vectors.shape[1])], 1)
        squares = np.bincount(doc, (vectors**2).sum(1), n)
        margin = self.bias + np.bincount(doc, self.weights[terms], n) + ((sums**2).sum(1) - squares) / 2
        return np.clip(margin, -40, 40), sums

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities of label 1; `rows` as found by Terms with `place`."""
        terms, doc = self._packed(rows)
        return 1 / (1 + np.exp(-self._margins(terms, doc, len(rows))[0]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, bits: int = 18,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn from at most `max_labelled` labelled documents, those of smallest id hash.

    Labels other than 0 and 1, null ids and ids without a document are left out; a repeated id counts once.
    Without any label every score is 0.5.
    """
    kept = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )

    def work(batches):
        terms = Terms(bits)
        for batch in batches:
            for label, text in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label], pa.int32()), pa.array([terms.of(text.as_py()).tobytes()], pa.binary())],
                    ["y", "terms"])

    one = texts(docs, id_col, text_col).join(F.broadcast(kept), "doc_id")  # max_labelled rows at most
    rows = one.select("y", "text").mapInArrow(work, "y int, terms binary").toPandas()
    pairs = sorted(zip(rows.terms, rows.y, strict=True))
    return Machine([np.frombuffer(t, np.int32) for t, _ in pairs], np.array([y for _, y in pairs], float), bits)


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, repeated rows too: doc_id and score, the machine's probability of label 1.

    Whole texts are read. An empty or null text has no terms and scores by the bias alone. A null id stays
    null. Other columns are ignored. Nothing is shuffled.
    """
    bits = len(machine.place).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches):
        terms = Terms(bits, shared.value.place)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = [terms.of(t.as_py()) for t in part.column("text")]
                found = shared.value.scores(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")

"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Whole texts become hashed terms (runs of character classes, and how much they repeat). A truncated
singular value decomposition of labelled texts gives the latent space. The labelled vectors are
broadcast; exact cosine products of every document with all of them are computed in blocks, and the
labels of the nearest vote by similarity.
"""

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from turnflow.llm.common import only_text, text_slices, texts

#: Buckets of the hashed terms, and of the marks for repetition behind them.
TERMS = 2048
STEPS = np.array([0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
WIDTH = TERMS + 4 * len(STEPS)
#: Bytes of text worked on together; a document counts as DOC_COST of them at least.
BLOCK, DOC_COST = 2_000_000, 4096


def _classes() -> np.ndarray:
    """Class of each byte: letters, capitals, digits and white space as such, each sign its own."""
    of = np.ones(256, np.int64)
    of[ord("A") : ord("Z") + 1] = 2
    of[ord("0") : ord("9") + 1] = 3
    of[[9, 11, 12, 13, 32]] = 4
    of[10] = 5
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    of[signs] = np.arange(6, 6 + len(signs))
    return of


CLASS = _classes()


def _repetition(text: str) -> list[float]:
    """Shares of repeated words, words equal to the one before, repeated lines and mean word length."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    if not words:
        return [0.0, 0.0, 0.0, 0.0]
    same = sum(map(eq, words, words[1:]))
    return [1 - len(set(words)) / len(words), same / len(words), 1 - len(set(lines)) / len(lines),
            min(1.0, len(text) / len(words) / 20)]


def term_weights(batch: pa.RecordBatch):
    """For runs of documents: first, end and their (documents, WIDTH) weights, from whole texts."""
    for first, end, data, at in _runs(batch):
        kinds = CLASS[data]
        n = end - first
        weights = np.zeros((n, WIDTH), np.float32)
        if len(data) > 3:
            code = ((kinds[:-3] * 40 + kinds[1:-2]) * 40 + kinds[2:-1]) * 40 + kinds[3:]
            doc = np.repeat(np.arange(n), np.diff(at))[: len(code)]
            own = np.arange(len(code)) + 4 <= at[1:][doc]  # no run reaches into the next text
            bucket = (code[own] * 2654435761 >> 7) % TERMS
            counts = np.bincount(doc[own] * TERMS + bucket, minlength=n * TERMS).reshape(n, TERMS)
            weights[:, :TERMS] = np.log1p(counts)
            weights[:, :TERMS] /= np.maximum(np.linalg.norm(weights[:, :TERMS], axis=1, keepdims=True), 1e-9)
        shares = np.array([_repetition(t) for t in batch.column("text").slice(first, n).to_pylist()])
        marks = (shares[:, :, None] > STEPS).reshape(n, -1)
        weights[:, TERMS:] = marks / np.sqrt(len(STEPS))
        weights[np.diff(at) == 0] = 0
        yield first, end, weights


def _runs(batch: pa.RecordBatch):
    for first, end, data, at in text_slices(batch, BLOCK):
        step = max(1, BLOCK // DOC_COST)
        for a in range(first, end, step):
            b = min(end, a + step)
            yield a, b, data[at[a - first] : at[b - first]], at[a - first : b - first + 1] - at[a - first]


def _as_vectors(batches):
    for batch in batches:
        for first, end, weights in term_weights(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column("y").slice(first, end - first),
                 pa.array([w.astype(np.float32).tobytes() for w in weights], pa.binary())], ["y", "terms"])


class Model:
    """Latent space and labelled vectors; `rate` is the mean label."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dims: int, seed: int = 7):
        self.labels = labels.astype(np.float32)
        self.rate = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(terms)) / (1 + (terms > 0).sum(0))).astype(np.float32) + 1
        weighted = terms * self.idf
        dims = min(dims, *weighted.shape) if len(terms) else 0
        rng = np.random.default_rng(seed)
        # randomized range finder with two power steps
        basis = rng.standard_normal((weighted.shape[1], min(dims + 10, weighted.shape[1]))).astype(np.float32)
        for _ in range(3):
            basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis)) if len(terms) else (basis, None)
        _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
        self.axes = (basis @ right[:dims].T).astype(np.float32)
        self.vectors = self.latent(terms)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a text without terms is the zero vector."""
        found = (terms * self.idf) @ self.axes
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, terms: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        """Vote of the nearest labelled vectors, each weighted by a power of its cosine."""
        if not len(self.labels):
            return np.full(len(terms), self.rate)
        cosines = self.latent(terms) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        at = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(cosines, at, 1), 0).astype(np.float64) ** sharpness
        total = near.sum(1)
        voted = (near * self.labels[at]).sum(1) / np.maximum(total, 1e-300)
        return np.where(total > 0, voted, self.rate)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, dims: int = 32,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from at most `max_labelled` labelled documents, those of smallest id hash.

    Labels other than 0 and 1, null ids and ids without a document are left out; a repeated id counts once.
    Without any label every score is 0.5. The bound also bounds what is broadcast.
    """
    kept = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    one = texts(docs, id_col, text_col).join(F.broadcast(kept), "doc_id")  # max_labelled rows at most
    rows = one.select("doc_id", "y", "text").mapInArrow(
        lambda batches: _as_vectors(batches), "y int, terms binary").toPandas()
    order = sorted(range(len(rows)), key=lambda i: (rows.terms[i], rows.y[i]))  # the same sum order each run
    terms = np.frombuffer(b"".join(rows.terms[i] for i in order), np.float32).reshape(-1, WIDTH)
    return Model(terms, rows.y.to_numpy()[order] if len(rows) else np.zeros(0), dims)


def with_score(docs: DataFrame, model: Model, neighbours: int = 25, sharpness: float = 8.0,
               text_col: str = "text", name: str = "score") -> DataFrame:
    """Every row and column of `docs` with the weighted vote for label 1 added; a column of that name gives way.

    Whole texts are read. An empty or null text has no terms and scores the mean label of the labelled
    documents. Repeated rows stay. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != name]

    def work(batches):
        for batch in batches:
            for first, end, weights in term_weights(only_text(batch, text_col)):
                found = shared.value.scores(weights, neighbours, sharpness)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.float64())], [*part.schema.names, name])

    schema = StructType([*kept, StructField(name, DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(work, schema)


def score(docs: DataFrame, model: Model, neighbours: int = 25, sharpness: float = 8.0,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, as `with_score`; a null id stays null and other columns are ignored."""
    return with_score(texts(docs, id_col, text_col), model, neighbours, sharpness).select("doc_id", "score")

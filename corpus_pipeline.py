"""Pipeline over documents: quality, near duplicates, repeated passages, benchmark passages, token ids.

Every stage takes the documents that the one before kept and returns documents with the same columns, but
the last, which returns token ids and a digest of what they decode to. Stages are written in the shared folder between each other, so a lost
executor never repeats more than one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import bpe_words, decontaminate, quality_knn, simhash_pivots, suffix_dedup
from turnflow.llm.common import table, written
from turnflow.llm.words import vocabulary

#: Documents of a lower quality score go.
LEAST_QUALITY = 0.7


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that none of them meets a column of an operator."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(True).alias("_last")).alias("_others"))


def _unpacked(made: DataFrame, columns: list[str]) -> DataFrame:
    return made.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_others")[c].alias(c) for c in columns])


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the nearest-neighbour vote finds good; one with a null or empty text scores the mean label.

    All columns stay as they are, whatever their names; an empty table stays empty.
    """
    model = quality_knn.fit(docs, table(spark, folder, "labels"))
    scored = quality_knn.with_score(_packed(docs), model)
    return _unpacked(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id; 3-word shingles, 3 bits.

    Null ids come last, and rows of one id are told apart by their columns, so one row of a group stays, the same on
    every run; empty and null texts are one group. All columns stay as they are; an empty table stays empty.
    """
    return simhash_pivots.one_of_each(docs, shingle=3, max_bits=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids have; n_chars is that of the new text.

    A null id is the smallest; a null text becomes empty. All other columns stay as they are, whatever their names; an
    empty table stays empty.
    """
    made = suffix_dedup.kept_text(suffix_dedup.remove_repeats(_packed(docs), carried=("_others",)))
    cut = _unpacked(made, docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item; a null or empty text holds none.

    All columns stay as they are, whatever their names; an empty table stays empty.
    """
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, and decoded_sha256, the digest of the text that the ids decode to.

    A null or empty text has no ids and decodes to the empty text; null ids and repeated rows stay, other columns do
    not; an empty table stays empty.
    """
    words = vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    decoded = bpe_words.decode(bpe_words.encode(docs, words), words)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", to_tokens),
]

#: No stage can be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs

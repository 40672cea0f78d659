"""The query of every operator of this folder, and its SQL where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import ball_codes, bpe_words, chat_windows, decontaminate, multi_index, quality_knn, restaurants, seed_extend, simhash_pivots, suffix_dedup, token_alignment, token_files, toxicity_fm
from turnflow.llm import sql as oracles
from turnflow.llm.common import side_path, table
from turnflow.llm.words import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tokens of a window, and of the earlier turns that it repeats.
BUDGET, HISTORY = 1024, 256


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    words, path = vocabulary(public_tokenizers.path("word_bpe_49k.json")), side_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), words, path, end_id=1)
    return token_files.checksums(token_files.read_token_files(spark, path))


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    runs = F.transform("removed", lambda r: r["end"] - r["begin"])
    return removed.select(
        "doc_id", "n_bytes", F.aggregate(runs, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _remainder(mod: int):
    """crc32 of the id as text, modulo `mod`; a null id has none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def _judged(scored: DataFrame, held_out, least: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


@query
def op3_quality_knn(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), _remainder(4) == 2
    model = quality_knn.fit(docs, table(spark, folder, "labels").where(~held_out))
    return _judged(quality_knn.score(docs, model), held_out, 0.7)


@query
def op4_bpe_words(spark: SparkSession, folder: str) -> DataFrame:
    words = vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    decoded = bpe_words.decode(bpe_words.encode(table(spark, folder, "documents"), words), words)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op5_restaurants(spark: SparkSession, folder: str) -> DataFrame:
    return restaurants.score(table(spark, folder, "documents"), _remainder(7) != 2)


@query
def op6_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    read = chat_windows.read_back(chat_windows.budgeted_windows(turns.unionByName(added), BUDGET, HISTORY))
    return read.select(
        "conv_id", F.col("n_turns").cast("long"),
        F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"))


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op8_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op9_toxicity_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents"), _remainder(5) == 0
    machine = toxicity_fm.fit(docs, table(spark, folder, "labels").where(~held_out))
    return _judged(toxicity_fm.score(docs, machine), held_out, 0.5)


@query
def op10_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, folder, "documents"))


@query
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        pieces = file.read()
    aligned = token_alignment.align(table(spark, folder, "documents"), vocabulary(public_tokenizers.path("byte_bpe_50k.json")), pieces)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return aligned.withColumn("groups_sha256", digest).drop("groups")


@query
def op12_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    removed = seed_extend.remove_repeated_words(table(spark, folder, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_ball_codes(spark: SparkSession, folder: str) -> DataFrame:
    codes = ball_codes.compress(table(spark, folder, "embeddings"))
    return ball_codes.with_label_error(codes.rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


SQL |= {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op6_chat_windows": oracles.chat_windows(BUDGET, HISTORY),
    "op12_seed_extend": oracles.SEED_EXTEND,
}

"""The tables that queries start from."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.functions.profile import company_profile, system_prompt
from turnflow.operators.shaping import keep_correct, shape_examples, training_examples
from turnflow.operators.turns import extract_turns, merge_assistant_runs
from turnflow.plans.shared import shared_folder
from turnflow.sources.bridge import bridge_turns, correct_labels, profiles, raw_examples, table
from turnflow.sources.traces import read_traces

raw = raw_examples
long = bridge_turns


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def stored_raw(spark: SparkSession, folder: str, order: Column) -> DataFrame:
    """Raw examples as a stored corpus, in the given order, read back."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    raw(spark, folder).orderBy(order).write.parquet(path)
    return read_traces(spark, path)


def examples(spark: SparkSession, folder: str) -> DataFrame:
    """Training examples of the correct documents, indexed by document."""
    return training_examples(shape_examples(keep_correct(raw(spark, folder))))


def correct_long(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of the correct conversations."""
    correct = correct_labels(spark, folder).filter("correct").select(F.col("doc_id").alias("conv_id"))
    return long(spark, folder).join(correct, "conv_id", "left_semi")


def merged_long(spark: SparkSession, folder: str) -> DataFrame:
    return merge_assistant_runs(extract_turns(correct_long(spark, folder)))


def prompts_long(spark: SparkSession, folder: str) -> DataFrame:
    """System message per conversation id."""
    company = profiles(spark, folder)
    return company.select(F.col("c_custkey").alias("conv_id"), system_prompt(company_profile(company)).alias("system_prompt"))

import os
import uuid

import pytest
from pyspark.sql import functions as F

from turnflow.constants import IGNORED_LABEL, PAD_ID
from turnflow.functions import chat, tokens
from turnflow.functions.tokens import WorkerTokenizer
from turnflow.operators import batches, token_tables

SCHEMA = "original_index long, num_turns int, messages array<struct<role:string,content:string>>, target_response string"


def table(spark, *texts, target="It is fine."):
    return spark.createDataFrame([(i, 1, [("user", t)], target) for i, t in enumerate(texts)], SCHEMA)


def test_template(spark):
    row = table(spark, "Hi").select(chat.render_chat(F.col("messages")).alias("t"), chat.render_prompt(F.col("messages")).alias("p")).first()
    assert row["t"] == "<|im_start|>user\nHi<|im_end|>\n"
    assert row["p"] == row["t"] + "<|im_start|>assistant\n"


def test_empty_messages_are_an_error(spark):
    with pytest.raises(Exception, match="empty list"):
        table(spark, "x").select(chat.render_chat(F.slice("messages", 1, 0)).alias("t")).collect()


@pytest.mark.parametrize("messages, target, said", [([], "x", "messages"), ([("user", "a")], "", "target_response")])
def test_sft_needs_messages_and_target(spark, messages, target, said):
    df = spark.createDataFrame([(0, 1, messages, target)], SCHEMA)
    with pytest.raises(Exception, match=said):
        token_tables.prepare_sft(df, max_length=8).collect()


def test_own_tokenizer_gives_the_same_tables(spark):
    """A user's tokenizer goes through pandas; with whole characters as tokens, counts are lengths."""
    df = table(spark, "abc", "de")
    by_letter = lambda texts: [[ord(c) for c in t] for t in texts]
    counts = token_tables.with_token_count(df, by_letter).orderBy("original_index").collect()
    assert [r["token_count"] for r in counts] == [len("<|im_start|>user\nabc<|im_end|>\n"), len("<|im_start|>user\nde<|im_end|>\n")]
    row = token_tables.prepare_sft(df, by_letter, max_length=80).orderBy("original_index").first()
    trained = "".join(chr(x) for x in row["labels"] if x != IGNORED_LABEL)
    assert trained == "It is fine.<|im_end|>\n"
    assert len(token_tables.tokenize_dataset(df, by_letter, max_length=10).first()["input_ids"]) == 10


def test_tokenize_dataset(spark):
    row = token_tables.tokenize_dataset(table(spark, "Hi there"), max_length=20).first()
    assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["labels"]) == 20
    kept = sum(row["attention_mask"])
    assert row["input_ids"][kept:] == [PAD_ID] * (20 - kept) and row["labels"] == row["input_ids"]
    cut = token_tables.tokenize_dataset(table(spark, "Hi there"), max_length=4).first()
    assert cut["input_ids"] == row["input_ids"][:4]
    free = token_tables.tokenize_dataset(table(spark, "Hi there"), max_length=4, truncation=False, padding=False).first()
    assert free["input_ids"] == row["input_ids"][:kept]


def test_metadata_defaults(spark):
    row = token_tables.tokenize_dataset(table(spark, "a").drop("original_index", "num_turns"), max_length=4).first()
    assert (row["original_index"], row["num_turns"]) == (-1, 0)


def test_pad_id_falls_back():
    assert tokens.pad_id(None) == PAD_ID and tokens.pad_id(0) == 0


def test_labels_cover_the_answer_only(spark):
    row = token_tables.prepare_sft(table(spark, "Hi"), max_length=40).first()
    prompt = len(spark.range(1).select(tokens.tokenize(F.lit("<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n")).alias("t")).first()["t"])
    kept = sum(row["attention_mask"])
    assert row["labels"][:prompt] == [IGNORED_LABEL] * prompt
    assert row["labels"][prompt:kept] == row["input_ids"][prompt:kept]
    assert row["labels"][kept:] == [IGNORED_LABEL] * (40 - kept)


def test_cut_off_answers_are_found_and_kept(spark):
    prepared = token_tables.prepare_sft(table(spark, "Hi", "many words in here that fill the line"), max_length=22)
    assert prepared.count() == 2
    assert [r["original_index"] for r in token_tables.untrainable_examples(prepared).collect()] == [1]


def test_truncation(spark):
    marked, stats = token_tables.truncation_report(table(spark, "short", "long " * 80, "short"), 50)
    assert [r["original_index"] for r in token_tables.truncated_rows(marked).collect()] == [1]
    row = stats.first()
    assert (row["total_examples"], row["truncated_count"]) == (3, 1) and row["avg_tokens_over"] == row["max_tokens_over"] > 0
    with pytest.raises(ValueError, match="empty"):
        token_tables.truncation_report(table(spark, "x").limit(0))


def test_statistics_and_recommendation(spark):
    counts = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "token_count int")
    row = token_tables.token_statistics(counts).first()
    assert (row["mean"], row["median"], row["p25"], row["p95"], row["std"]) == pytest.approx((2.5, 2.5, 1.75, 3.85, 1.118033988749895))
    assert token_tables.recommended_max_length(counts, 95.5).first()[0] == 3
    assert token_tables.recommended_max_length(counts, 60).first()[0] == int(2.5 + 2 * 1.118033988749895)
    with pytest.raises(ValueError, match="between 0 and 100"):
        token_tables.recommended_max_length(counts, 101)


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "row")
    ordered = batches.assign_batches(df, "row", 4, shuffle=False).orderBy("row").collect()
    assert [r["batch"] for r in ordered] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    mixed = batches.assign_batches(df, "row", 4, seed=1).collect()
    assert sorted((r["batch"], r["slot"]) for r in mixed) == [(i // 4, i % 4) for i in range(10)]


def test_masking_share(spark):
    ids = spark.range(200).select(
        F.col("id").alias("original_index"), F.lit(0).alias("batch"), F.array_repeat(F.lit(5), 100).alias("input_ids"),
        F.array_repeat(F.lit(1), 100).alias("attention_mask"),
    )
    rows = batches.collate(ids, mlm=True, share=0.15)
    masked = rows.select(F.sum(F.size(F.filter("labels", lambda x: x == 5))).alias("n")).first()["n"]
    assert 0.13 < masked / 20000 < 0.17
    both = rows.select(F.sum(F.size(F.filter("input_ids", lambda x: x != 5))).alias("n")).first()["n"]
    assert 0.86 < both / masked < 0.94  # a tenth of the chosen ids stays


def test_rows_with_the_same_id_are_batched_one_by_one(spark):
    df = spark.createDataFrame([(-1,)] * 7 + [(None,)] * 3, "row int")
    for shuffle in (False, True):
        rows = batches.assign_batches(df, "row", 4, shuffle=shuffle).collect()
        assert sorted((r["batch"], r["slot"]) for r in rows) == [(i // 4, i % 4) for i in range(10)]


def test_a_worker_loads_its_tokenizer_once_and_encodes_a_row_once(spark, tmp_path):
    """Characters as tokens; files count loads by worker process, and texts."""
    loads, texts = tmp_path / "loads", tmp_path / "texts"
    loads.mkdir()
    texts.mkdir()

    def load():
        (loads / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

        def encode(batch):
            for text in batch:
                (texts / uuid.uuid4().hex).write_text(text)
            return [([ord(c) for c in text], list(range(len(text)))) for text in batch]

        return encode

    rows = [([("system", "s"), ("user", f"question {i}")], f"answer {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, target_response string").repartition(6)
    prepared = token_tables.prepare_sft(df, WorkerTokenizer(load), 200)
    own = token_tables.prepare_sft(df, lambda batch: [[ord(c) for c in text] for text in batch], 200)
    assert sorted(map(str, prepared.collect())) == sorted(map(str, own.collect()))
    workers = [f.name.split("-")[0] for f in loads.iterdir()]
    assert len(workers) == len({*workers}) >= 1
    assert len([*texts.iterdir()]) == 40 and all(t.read_text().startswith("<|im_start|>system") for t in texts.iterdir())
    counted = token_tables.with_token_count(df, WorkerTokenizer(load)).agg({"token_count": "min"}).first()[0]
    assert counted == len("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nquestion 1<|im_end|>\n")

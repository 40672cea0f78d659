import datetime

import pytest
from pyspark.sql import types as T

from turnflow.operators import generation
from turnflow.sources import reports

SCHEMA = "original_index long, task string, messages array<struct<role:string,content:string>>, target_response string"


def load_echo():
    def answer(batch):
        if len(batch) > 1 and any(m[-1]["content"] == "no batches" for m in batch):
            raise RuntimeError("batch too large")
        if any(m[-1]["content"] == "fail" for m in batch):
            raise RuntimeError("cannot answer")
        return [" you said " + m[-1]["content"] + " END of it" for m in batch]

    return answer


def table(spark, *texts):
    rows = [(i, None, [("user", t)], None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def answers(df):
    return [r.asDict() for r in df.orderBy("original_index").collect()]


@pytest.mark.parametrize("size", [1, 2, 4, 100])
def test_a_failed_row_keeps_its_place(spark, size):
    rows = answers(generation.generate_batched(table(spark, "a", "fail", "c", "no batches", "e"), load_echo, size, stops=("END",)))
    assert [r["generated_response"] for r in rows] == ["you said a", None, "you said c", "you said no batches", "you said e"]
    assert [r["error"] for r in rows] == [None, "cannot answer", None, None, None]
    assert rows[0]["task"] == "unknown" and rows[0]["target_response"] == ""
    assert rows[1]["input_tokens"] is None and rows[0]["output_tokens"] == 3
    assert rows[0]["generation_time_ms"] >= 0 and rows[1]["generation_time_ms"] is None


def test_one_row_at_a_time(spark):
    rows = answers(generation.generate(table(spark, "a", "no batches"), load_echo))
    assert [r["error"] for r in rows] == [None, None]


def test_the_prompt_is_counted_after_its_cut(spark):
    row, = answers(generation.generate(table(spark, "word " * 50), load_echo, max_length=20))
    assert row["input_tokens"] == 20


def test_rows_without_an_index_are_counted(spark):
    rows = answers(generation.generate(table(spark, *"abcdef").drop("original_index").repartition(3), load_echo))
    assert [r["original_index"] for r in rows] == list(range(6))


def test_settings_are_saved(spark, tmp_path):
    done = generation.generate(table(spark, "a"), load_echo)
    target = reports.write_evaluation(done, str(tmp_path / "e"), config={"model": "m", "batch_size": 4})
    row = spark.read.json(f"{target}/config").first()
    assert (row["model"], row["batch_size"]) == ("m", 4)


def test_wrong_input(spark):
    with pytest.raises(ValueError, match="messages"):
        generation.generate(spark.range(1), load_echo)
    with pytest.raises(ValueError, match="empty"):
        generation.generate(table(spark, "a").limit(0), load_echo)


def test_summary_divides_by_all_rows(spark):
    rows = [(None, 10.0, 100, 8), (None, 20.0, 50, 4), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "error string, generation_time_ms double, input_tokens int, output_tokens int")
    row = generation.generation_summary(df).first()
    assert (row["successful_count"], row["failed_count"], row["total_time_ms"], row["mean_time_ms"]) == (2, 1, 30.0, 10.0)
    assert (row["total_input_tokens"], row["mean_input_tokens"], row["mean_output_tokens"]) == (150, 50.0, 4.0)


def test_saved_and_loaded(spark, tmp_path):
    made = generation.generate(table(spark, "a", "fail"), load_echo)
    target = reports.write_evaluation(made, str(tmp_path / "eval"), include_messages=False, day=datetime.date(2026, 1, 2))
    assert target.endswith("eval_20260102")
    schema = T.StructType([f for f in made.schema if f.name != "messages"])
    rows = answers(reports.read_evaluation(spark, f"{target}/results", schema))
    assert rows[1]["error"] == "cannot answer" and rows[1]["generated_response"] is None
    assert reports.read_evaluation(spark, f"{target}/results", schema, max_examples=1).count() == 1
    assert spark.read.json(f"{target}/summary").first()["failed_count"] == 1


@pytest.mark.parametrize("text", ['{"results": [{"original_index": 1, "task": "a"}, {"original_index": 2, "task": "b"}]}',
                                  '[{"original_index": 1, "task": "a"}, {"original_index": 2, "task": "b"}]'])
def test_both_file_forms(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    schema = T.StructType([T.StructField("original_index", T.LongType()), T.StructField("task", T.StringType())])
    rows = reports.read_evaluation(spark, str(tmp_path / "e.json"), schema, multi_line=True)
    assert [(r["original_index"], r["task"]) for r in rows.orderBy("original_index").collect()] == [(1, "a"), (2, "b")]

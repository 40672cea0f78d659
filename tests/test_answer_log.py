"""Answers that cost something are asked for once, whatever is lost in between."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnflow.operators import generation, judging
from turnflow.sources import answer_log

CONVERSATIONS = "original_index long, messages array<struct<role:string,content:string>>, task string"


def no_wait(seconds):
    return None


def counting_judge(folder, dies_at=None):
    """A judge that notes every call in a file and, once, takes its process along at a certain one."""

    def load():
        def judge(prompt):
            calls = Path(folder) / "calls"
            if dies_at is not None and prompt == dies_at and not (Path(folder) / "died").exists():
                (Path(folder) / "died").write_text("once")
                os._exit(1)
            with calls.open("a") as file:
                file.write(prompt + "\n")
            if prompt == "broken":
                raise ValueError("no answer")
            return {"content": f"SCORE: {len(prompt) % 6}", "cost_usd": 0.5}

        return judge

    return load


def calls(folder):
    return sorted((Path(folder) / "calls").read_text().split())


def requests(spark, n=40, parts=2):
    rows = spark.range(n).select(
        F.col("id").alias("example"), F.lit("tone").alias("criterion"), F.lit(1).alias("sample"), F.format_string("p%03d", "id").alias("prompt"))
    return rows.repartitionByRange(parts, "example")


KEY = ("example", "criterion", "sample")


def asked(spark, folder, log, dies_at=None, n=40):
    return judging.call_judge(requests(spark, n), counting_judge(str(folder), dies_at), no_wait, log=str(log), key=KEY)


def test_a_task_killed_after_half_its_calls_pays_for_none_again(spark, tmp_path):
    judged = asked(spark, tmp_path, tmp_path / "log", dies_at="p010")
    with pytest.raises(Exception, match="exited|crashed|lost"):
        judged.collect()
    assert "p009" in calls(tmp_path) and "p010" not in calls(tmp_path)
    rows = judged.select("*").collect()  # the same partitions again, as when Spark retries a task
    assert len(rows) == 40 and all(r["content"] for r in rows)
    assert calls(tmp_path) == [f"p{i:03d}" for i in range(40)]


def test_a_restart_asks_only_for_what_lacks(spark, tmp_path):
    with pytest.raises(Exception, match="exited|crashed|lost"):
        asked(spark, tmp_path, tmp_path / "log", dies_at="p031").collect()
    judged = asked(spark, tmp_path, tmp_path / "log")  # another run, which knows the log only
    rows = {r["example"]: r for r in judged.collect()}
    assert len(rows) == 40 and rows[39]["content"] == "SCORE: 4" and rows[0]["cost_usd"] == 0.5
    more = asked(spark, tmp_path, tmp_path / "log", n=45).collect()
    assert len(more) == 45 and calls(tmp_path) == [f"p{i:03d}" for i in range(45)]


def test_second_evaluations_pay_nothing_and_columns_stay(spark, tmp_path):
    wide = requests(spark, 6).withColumn("extra", F.struct(F.array("example"), F.lit(None).cast("string")))
    judged = judging.call_judge(wide, counting_judge(str(tmp_path)), no_wait, log=str(tmp_path / "log"), key=KEY)
    first, second = sorted(judged.collect()), sorted(judged.select("*").collect())
    assert first == second and len(calls(tmp_path)) == 6
    assert [r["extra"][0] for r in first] == [[i] for i in range(6)] and "prompt" not in judged.columns


def test_failed_calls_are_tried_again_by_a_later_run_only(spark, tmp_path):
    rows = spark.createDataFrame([(1, "tone", 1, "broken"), (None, "tone", 1, "fine"), (3, None, 1, None)], "example long, criterion string, sample int, prompt string")
    ask = lambda: judging.call_judge(rows.coalesce(1), counting_judge(str(tmp_path)), no_wait, log=str(tmp_path / "log"), key=KEY)
    one = ask()
    one.count()
    assert {r["example"]: r["error"] for r in one.collect()} == {1: "no answer", None: None, 3: "no prompt"}
    assert calls(tmp_path) == ["broken", "fine"]
    assert {r["example"]: r["content"] for r in ask().collect()} == {1: None, None: "SCORE: 4", 3: None}
    assert calls(tmp_path) == ["broken", "broken", "fine"]


def test_lines_cut_off_are_no_answers(spark, tmp_path):
    log = tmp_path / "log"
    asked(spark, tmp_path, log, n=10).collect()
    file = next(log.rglob("*.jsonl"))
    file.write_text(file.read_text()[:-9])
    rows = asked(spark, tmp_path, log, n=10).collect()
    assert len(rows) == 10 and all(r["content"] for r in rows) and len(calls(tmp_path)) == 11


def test_files_of_few_answers(spark, tmp_path):
    rows = requests(spark, 9, 1)
    respond = lambda: lambda prompts: ([{"content": p}] for p in prompts)
    made = answer_log.with_answers(rows, "prompt", respond, judging.JUDGED, str(tmp_path / "log"), KEY, every=4)
    assert sorted(r["content"] for r in made.collect()) == [f"p{i:03d}" for i in range(9)]
    assert len([*(tmp_path / "log").rglob("*.jsonl")]) == 3


def test_a_log_needs_a_key(spark, tmp_path):
    with pytest.raises(ValueError, match="key"):
        judging.call_judge(requests(spark), counting_judge(str(tmp_path)), no_wait, log=str(tmp_path / "log"))


def test_an_empty_table_asks_nothing(spark, tmp_path):
    assert asked(spark, tmp_path, tmp_path / "log", n=0).collect() == []
    assert not (tmp_path / "calls").exists()


def counting_echo(folder):
    def load():
        def answer(batch):
            with (Path(folder) / "calls").open("a") as file:
                file.writelines(m[-1]["content"] + "\n" for m in batch)
            if any(m[-1]["content"] == "fail" for m in batch):
                raise RuntimeError("cannot answer")
            return ["said " + m[-1]["content"] for m in batch]

        return answer

    return load


def test_generation_resumes_with_what_lacks_or_failed(spark, tmp_path):
    rows = lambda *texts: spark.createDataFrame(
        [(i, [("user", t)], "t") for i, t in enumerate(texts)], CONVERSATIONS).coalesce(1)
    make = lambda df: {r["original_index"]: r["generated_response"] for r in generation.generate_batched(
        df, counting_echo(str(tmp_path)), 2, log=str(tmp_path / "log")).collect()}
    assert make(rows("a", "b", "fail")) == {0: "said a", 1: "said b", 2: None}
    assert make(rows("a", "b", "better", "d")) == {0: "said a", 1: "said b", 2: "said better", 3: "said d"}
    assert calls(tmp_path) == ["a", "b", "better", "d", "fail"]


def test_generation_passes_messages_through_in_arrow(spark):
    df = spark.createDataFrame([(0, [("user", "hi")], "t")], CONVERSATIONS)
    made = generation.generate(df, lambda: lambda batch: ["x" for _ in batch])
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert made.first()["messages"] == df.first()["messages"]

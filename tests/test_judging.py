import pytest
from pyspark.sql import functions as F

from turnflow.operators import judging
from turnflow.schemas import CRITERION
from turnflow.sources import reports

SYSTEM = "You help.\n\n## Company Profile\n\n- Name: Acme\n- State: CA\n\n## More\n- x: y"
EXAMPLE = "original_index long, task string, messages array<struct<role:string,content:string>>, generated_response string, target_response string"
SAMPLE = "example_id long, criterion_key string, sample int, content string, cost_usd double"


def criteria(spark, **weights):
    return spark.createDataFrame([(k, k, "", [], w, False) for k, w in weights.items()], CRITERION)


def samples(spark, *rows):
    return judging.with_score(spark.createDataFrame([(*r[:3], r[3], 0.001) for r in rows], SAMPLE))


def test_prompt(spark):
    df = spark.createDataFrame([(7, "t", [("system", SYSTEM), ("user", "Q?"), ("assistant", "A")], "mine", "theirs")], EXAMPLE)
    requests = judging.judge_requests(judging.with_judge_context(df), 2)
    assert requests.count() == 12 == judging.estimate_calls(df, 2).first()["calls"]
    prompt = judging.with_judge_prompt(requests).filter("criterion.key = 'multi_turn_coherence'").first()["prompt"]
    assert "## Criterion: Multi-Turn Coherence\nDoes the response" in prompt
    assert "\n1. Review the conversation" in prompt and "\n4. Assess whether" in prompt
    assert "## Company Profile\n- Name: Acme\n- State: CA\n\n## Conversation History\nUSER: Q?\nASSISTANT: A\n" in prompt
    assert "## Generated Response (to evaluate)\nmine\n\n## Reference Answer\ntheirs\n\n## Scoring Guide" in prompt
    assert prompt.endswith("SCORE: <0-5>\n\nSCORE: ")


def test_probabilities_and_weighted_score(spark):
    rows = [(1, "a", i, f"SCORE: {s}") for i, s in enumerate([3, 4, 4, 5], 1)]
    row = judging.criterion_scores(samples(spark, *rows), samples=4).first()
    assert row["score_probabilities"] == {3: 0.25, 4: 0.5, 5: 0.25}
    assert row["weighted_score"] == pytest.approx(4.0) and row["raw_scores"] == [3, 4, 4, 5]
    entries = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(p).alias("p")) for s, p in ((3, 0.1), (4, 0.5), (5, 0.4))])
    assert spark.range(1).select(judging.weighted_score(entries).alias("w")).first()["w"] == pytest.approx(4.3)


def test_invalid_samples(spark):
    rows = [(1, "a", 1, "SCORE: 9"), (1, "a", 2, "first SCORE: 4"), (1, "a", 3, "SCORE: 2"), (1, "b", 1, "none")]
    got = {r["criterion_key"]: r for r in judging.criterion_scores(samples(spark, *rows), samples=3).collect()}
    assert got["a"]["raw_scores"] == [4, 2] and got["a"]["justification"] == "first SCORE: 4"
    assert got["a"]["total_cost_usd"] == pytest.approx(0.003)
    assert (got["b"]["raw_scores"], got["b"]["score_probabilities"], got["b"]["weighted_score"]) == ([], {}, 0.0)
    assert got["b"]["justification"] == "No valid scores collected"


def test_roll_up(spark):
    rows = [(1, "a", 1, "SCORE: 4"), (1, "b", 1, "SCORE: 1"), (1, "c", 1, "none"), (2, "a", 1, "none"), (4, "a", 1, "SCORE: 5")]
    scores = judging.criterion_scores(samples(spark, *rows))
    found = judging.example_results(scores, criteria(spark, a=2.0, b=1.0, c=5.0))
    one = found.filter("example_id = 1").first()
    assert (one["overall_score"], one["total_api_calls"]) == (pytest.approx(3.0), 2)
    examples = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y")], "example_id long, task string")
    failed = spark.createDataFrame([(4,)], "example_id long")
    every = judging.all_results(examples, found, failed)
    overall = judging.aggregate_overall(every).first()
    assert (overall["total_examples"], overall["valid_examples"], overall["overall_mean"]) == (4, 2, 1.5)
    assert {r["task"]: (r["mean"], r["n"]) for r in judging.aggregate_by_task(every).collect()} == {"x": (1.5, 2)}
    per = {r["criterion_key"]: (r["mean"], r["n"]) for r in judging.aggregate_by_criterion(scores).collect()}
    assert per == {"a": (4.5, 2), "b": (1.0, 1)}
    # scores of the failed example leave the roll-up
    kept = {r["criterion_key"]: (r["mean"], r["n"]) for r in judging.aggregate_by_criterion(scores, every).collect()}
    assert kept == {"a": (4.0, 1), "b": (1.0, 1)}
    unknown = judging.example_results(scores, criteria(spark, a=2.0)).filter("example_id = 1").first()
    assert (unknown["overall_score"], unknown["criteria"], unknown["total_api_calls"]) == (4.0, 3, 2)


def test_zero_weight_and_no_results(spark):
    scores = judging.criterion_scores(samples(spark, (1, "a", 1, "SCORE: 4")))
    assert judging.example_results(scores, criteria(spark, a=0.0)).first()["overall_score"] == 0.0
    empty = spark.createDataFrame([], "example_id long, task string, criteria long, overall_score double, total_cost_usd double, total_api_calls long")
    assert judging.aggregate_overall(empty).first()["error"] == "No results to aggregate"


def test_examples_that_cannot_be_judged(spark):
    rows = [(1, "t", [("system", SYSTEM)], "a", "b"), (2, "t", [], "a", "b"), (3, "t", [("system", "no")], "a", "b"), (4, "t", [("system", SYSTEM)], None, "b")]
    failures = {r["original_index"]: r["failure"] for r in judging.with_example_failure(spark.createDataFrame(rows, EXAMPLE)).collect()}
    assert failures[1] is None and all(failures[i] for i in (2, 3, 4))


def test_requests_need_a_sample(spark):
    with pytest.raises(ValueError, match="samples"):
        judging.judge_requests(spark.createDataFrame([], EXAMPLE), 0)


def test_failed_ids_of_calls_and_examples(spark):
    rows = [(1, "t", [("system", SYSTEM)], "a", "b"), (2, "t", [], "a", "b"), (3, "t", [("system", SYSTEM)], "a", "b")]
    examples = spark.createDataFrame(rows, EXAMPLE).withColumnRenamed("original_index", "example_id")
    assert {r["example_id"] for r in judging.judgeable(examples).collect()} == {1, 3}
    judged = spark.createDataFrame([(1, None), (3, "busy")], "example_id long, error string")
    assert {r["example_id"] for r in judging.failed_ids(judged, examples).collect()} == {2, 3}


def load_broken():
    def judge(prompt):
        if prompt == "wrong":
            raise ValueError("bad request")
        return {"content": "SCORE: 1", "cost_usd": 0.5, "latency_ms": 2.0}

    return judge


def test_any_error_is_a_row_and_null_prompts_are_not_sent(spark):
    asked = spark.createDataFrame([(1, "ok"), (2, "wrong"), (3, None)], "example_id long, prompt string")
    got = {r["example_id"]: r for r in judging.call_judge(asked, load_broken, no_wait).collect()}
    assert got[1]["error"] is None and (got[2]["error"], got[2]["attempts"]) == ("bad request", 1)
    assert (got[3]["error"], got[3]["attempts"], got[3]["content"]) == ("no prompt", 0, None)


def test_raw_scores_have_no_cap_and_time_is_summed(spark):
    rows = samples(spark, *[(1, "a", i, f"SCORE: {i}") for i in (1, 2, 3, 4)]).withColumn("latency_ms", F.lit(2.5))
    scores = judging.criterion_scores(rows, samples=2)
    assert scores.first()["raw_scores"] == [1, 2, 3, 4] and scores.first()["evaluation_time_ms"] == 10.0
    found = judging.example_results(scores, criteria(spark, a=1.0))
    every = judging.all_results(spark.createDataFrame([(1, "x"), (2, "x")], "example_id long, task string"), found)
    assert {r["example_id"]: r["evaluation_time_ms"] for r in every.collect()} == {1: 10.0, 2: 0.0}


def load_flaky():
    seen = {}

    def judge(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if prompt == "never" or (prompt == "third time" and seen[prompt] < 3):
            raise judging.JudgeError("busy")
        return {"content": None if prompt == "empty" else "SCORE: 3", "cost_usd": 0.5, "input_tokens": 1}

    return judge


def no_wait(seconds):
    assert seconds in (2, 4, 8)


def test_retries(spark):
    asked = spark.createDataFrame([("ok",), ("third time",), ("never",), ("empty",)], "prompt string").withColumn("name", F.col("prompt"))
    got = {r["name"]: r for r in judging.call_judge(asked.coalesce(1), load_flaky, no_wait).collect()}
    assert [(got[n]["attempts"], got[n]["content"]) for n in ("ok", "third time")] == [(1, "SCORE: 3"), (3, "SCORE: 3")]
    assert got["never"]["error"] == "busy" and got["never"]["attempts"] == 3 and got["empty"]["error"]
    assert got["ok"]["cost_usd"] == 0.5 and got["never"]["cost_usd"] is None


def load_counting(calls):
    def judge(prompt):
        calls.add(1)
        return {"content": "SCORE: 4", "cost_usd": 0.5, "latency_ms": 1.0}

    return judge


def test_a_report_makes_each_call_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    asked = spark.createDataFrame([(i, "use_of_company_profile", s, f"p{i}") for i in range(5) for s in (1, 2)],
                                  "example_id long, criterion_key string, sample int, prompt string")
    judged = judging.call_judge(asked, lambda: load_counting(calls), no_wait)
    rows = [(i, "x", [("system", SYSTEM)], "a", "b") for i in range(5)] + [(9, "x", [], "a", "b")]
    examples = spark.createDataFrame(rows, EXAMPLE).withColumnRenamed("original_index", "example_id")
    reports.report_judged(examples, judged, criteria(spark, use_of_company_profile=1.0), {"model": "m"}, str(tmp_path / "r"), 2)
    assert calls.value == 10
    assert spark.read.json(str(tmp_path / "r" / "aggregate_metrics" / "by_criterion")).first()["n"] == 5
    overall = spark.read.json(str(tmp_path / "r" / "aggregate_metrics" / "overall")).first()
    assert (overall["total_examples"], overall["valid_examples"], overall["overall_mean"]) == (6, 5, 4.0)


def test_report(spark, tmp_path):
    scores = judging.criterion_scores(samples(spark, (1, "use_of_company_profile", 1, "SCORE: 4")), samples=1)
    found = judging.example_results(scores, criteria(spark, use_of_company_profile=1.0))
    every = judging.all_results(spark.createDataFrame([(1, "x"), (2, None)], "example_id long, task string"), found)
    reports.write_judge_report(every, scores, {"model": "m", "num_samples": 1}, str(tmp_path / "r"))
    rows = {r["example_id"]: r.asDict(True) for r in spark.read.json(str(tmp_path / "r" / "results")).collect()}
    entry, = rows[1]["criterion_scores"]
    assert entry["criterion_name"] == "Use of Company Profile" and entry["raw_scores"] == [4]
    assert entry["score_probabilities"] == {"4": 1.0} and rows[2]["criterion_scores"] == [] and rows[2]["task_type"] == "unknown"
    settings = spark.read.json(str(tmp_path / "r" / "evaluation_metadata")).first()
    assert (settings["model"], settings["total_examples"], settings["total_api_calls"]) == ("m", 2, 1)

import json
import math
import os
import random

import pytest

from turnflow.operators import training_metrics as metrics
from turnflow.schemas import METRIC_LOG
from turnflow.sources.logits import read_logits, write_logits
from turnflow.sources.metric_log import read_metric_log, sorted_points


def log(spark, **series):
    rows = [("r", tag.replace("_", "/"), step * 10, float(v)) for tag, values in series.items() for step, v in enumerate(values)]
    return spark.createDataFrame(rows, METRIC_LOG)


def test_a_window_beyond_a_stretch_is_refused(spark):
    with pytest.raises(ValueError, match="window"):
        metrics.smooth(log(spark, train_loss=range(30)), 8, stretch=4)


def smoothed(values, window=5):
    if len(values) <= window:
        return values
    return [v if i < window - 1 else sum(values[i - window + 1 : i + 1]) / window for i, v in enumerate(values)]


@pytest.mark.parametrize("length, stretch", [(3, 4), (5, 4), (6, 4), (40, 4), (40, 5), (40, 7), (40, 1000)])
def test_smooth(spark, length, stretch):
    rng = random.Random(length)
    values = [rng.random() for _ in range(length)]
    rows = metrics.smooth(log(spark, a=values, b=values[:2]), stretch=stretch).orderBy("tag", "step").collect()
    assert [r["smoothed"] for r in rows] == pytest.approx(smoothed(values) + values[:2])


def test_reports(spark):
    df = log(spark, train_loss=[2.0, 1.5, 1.0], eval_loss=[2.2, 1.6, 1.9, 1.6])
    train, evaluation = metrics.train_loss_report(df), metrics.eval_loss_report(df)
    assert train.first().asDict() == {"run_id": "r", "initial": 2.0, "final": 1.0, "min": 1.0, "improvement": 1.0}
    row = evaluation.first()
    assert (row["initial"], row["final"], row["best"], row["best_step"], row["best_epoch_approx"]) == (2.2, 1.6, 1.6, 10, 2)
    gap = metrics.overfitting_check(train, evaluation).first()
    assert gap["train_eval_gap"] == pytest.approx(0.6) and gap["is_overfitting"] is True
    report = json.loads(metrics.convergence_report(df).first()["report"])
    assert set(report) == {"train_loss", "eval_loss", "overfitting"}
    assert metrics.best_checkpoint(df).first()["best_step"] == 10


def test_absent_parts_are_left_out(spark):
    assert set(json.loads(metrics.convergence_report(log(spark, train_loss=[1.0])).first()["report"])) == {"train_loss"}


def stop(values, patience):
    best, waited = math.inf, 0
    for i, v in enumerate(values):
        waited = 0 if v < best else waited + 1
        best = min(best, v)
        if waited >= patience:
            return i * 10
    return None


@pytest.mark.parametrize("seed", range(6))
def test_early_stop(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1, 2, 3, 4]) - i * 0.05 for i in range(30)]
    found = metrics.early_stop_point(log(spark, eval_loss=values), patience=3, stretch=4).first()
    assert (found["stop_step"] if found else None) == stop(values, 3)


def test_perplexity(spark):
    rows = [(0, 0, [2.0, 0.0], -100), (0, 1, [0.0, 1.0], 1), (0, 2, [5.0, 5.0], -100), (1, 0, [0.0, 3.0], 0), (1, 1, [9.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "seq long, pos long, logits array<double>, label int")
    losses = [math.log(math.exp(2) + 1) - 0.0, math.log(1 + math.exp(3)) - 3.0]
    row = metrics.masked_perplexity(df).first()
    assert row["tokens"] == 2 and row["perplexity"] == pytest.approx(math.exp(sum(losses) / 2))
    huge = spark.createDataFrame([(0, 0, [1000.0, 0.0], 0), (0, 1, [0.0, 0.0], 1)], df.schema)
    assert metrics.masked_perplexity(huge).first()["perplexity"] == math.inf


def test_curves(spark):
    df = log(spark, train_loss=range(8), eval_loss=range(3), train_learning=[1.0], other=[1.0])
    rows = metrics.training_curves(df, rate_tag="train/learning").collect()
    assert {r["panel"] for r in rows} == {"training_loss", "train_vs_eval", "learning_rate"}
    assert all(r["smoothed"] is None for r in rows if r["tag"] != "train/loss")
    assert len(rows) == 8 + 8 + 3 + 1


def test_points_once_and_in_order(spark, tmp_path):
    df = log(spark, a=[3, 2, 1])
    rows = sorted_points(df.unionByName(df)).collect()
    assert [r["step"] for r in rows] == [0, 10, 20]
    df.write.csv(str(tmp_path / "log.csv"), header=True)
    assert [r["value"] for r in read_metric_log(spark, str(tmp_path / "log.csv")).collect()] == [3.0, 2.0, 1.0]


def test_of_repeated_points_the_last_written_counts(spark, tmp_path):
    """Whatever the partitioning, and though the file written last comes first by name."""
    point = "run_id string, tag string, step long, value double"
    for name, time, rows in (("part-b", 1_000_000_000, [("r", "t", 1, 1.0), ("r", "t", 2, 5.0), ("r", "t", 2, 6.0)]),
                             ("part-a", 1_000_000_100, [("r", "t", 1, -2.0), ("r", "t", 3, None), ("r", "t", 3, 7.0), ("r", "t", 3, None)])):
        spark.createDataFrame(rows, point).coalesce(1).write.parquet(str(tmp_path / name))
        file = next((tmp_path / name).glob("*.parquet"))
        target = tmp_path / "log" / f"{name}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(file.read_bytes())
        os.utime(target, (time, time))
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found = [(r["step"], r["value"]) for r in read_metric_log(spark, str(tmp_path / "log")).collect()]
        assert found == [(1, -2.0), (2, 6.0), (3, None)]
    for name, text in (("late.csv", "r,t,1,9\nr,t,1,8\n"), ("early.csv", "r,t,1,4\n")):
        (tmp_path / "csv.csv").mkdir(exist_ok=True)
        (tmp_path / "csv.csv" / name).write_text("run_id,tag,step,value\n" + text)
        os.utime(tmp_path / "csv.csv" / name, (2_000_000_000 if name == "late.csv" else 1_000_000_000,) * 2)
    assert [r["value"] for r in read_metric_log(spark, str(tmp_path / "csv.csv")).collect()] == [8.0]
    unordered = spark.createDataFrame([("r", "t", 1, v) for v in (2.0, None, 3.0)], point)
    assert [r["value"] for r in sorted_points(unordered).collect()] == [3.0]


def test_stored_logits_are_not_exchanged(spark, tmp_path):
    """Below the mean over all tokens the plan has no exchange, and gaps and ignored labels count as before."""
    rng = random.Random(4)
    rows = [(s, p, [rng.gauss(0, 1) for _ in range(5)], rng.choice([-100, 0, 1, 2, 3, 4])) for s in range(30) for p in range(12) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "seq long, pos long, logits array<double>, label int").repartition(5)
    stored = read_logits(spark, write_logits(df, buckets=4, path=str(tmp_path / "logits")))
    losses = lambda t: sorted((r["seq"], r["pos"], round(r["loss"], 9)) for r in metrics.token_losses(t).collect())
    of = {(s, p): (x, label) for s, p, x, label in rows}
    want = sorted((s, p, round(math.log(sum(map(math.exp, of[s, p - 1][0]))) - of[s, p - 1][0][label], 9))
                  for (s, p), (_, label) in of.items() if label != -100 and (s, p - 1) in of)
    assert losses(stored) == losses(df) == want
    plan = metrics.masked_perplexity(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
    assert metrics.token_losses(stored)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0

"""Exact quantiles of any number of distinct values."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from turnflow.operators import explore
from turnflow.plans.ranks import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def counted(df, *by):
    return df.groupBy(*by, "v").agg(F.count("*").alias("n"))


def sql(rows, kind):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (g VARCHAR, v {kind})")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    quantile = ", ".join(f"quantile_cont(v, {s})" for s in SHARES)
    return {r[0]: r[1:] for r in con.execute(f"SELECT g, count(v), {quantile} FROM t WHERE v IS NOT NULL GROUP BY g").fetchall()}


@pytest.mark.parametrize("kind", ["double", "bigint"])
def test_as_in_sql(spark, kind):
    rng = random.Random(2)
    draw = (lambda: rng.gauss(0, 100)) if kind == "double" else (lambda: rng.randrange(30))
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([draw(), None, draw(), draw()])) for _ in range(3000)]
    rows += [("one", draw()), ("two", draw()), ("two", draw()), ("none", None)]
    got = quantiles(counted(spark.createDataFrame(rows, f"g string, v {kind}"), "g"), "v", "n", SHARES, ("g",))
    want = sql(rows, kind)
    found = {r["g"]: tuple(r)[1:] for r in got.collect()}
    assert {g: pytest.approx(w) for g, w in want.items()} == found


def test_a_million_distinct_values_in_one_group(spark):
    """No task holds the values: every partition of the order has its share of them."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) / 4 - 1000).alias("v"))
    stats = explore.box_stats(df, "v", "g").first()
    value = lambda rank: rank / 4 - 1000
    assert (stats["q1"], stats["median"], stats["q3"]) == (value(0.25 * (n - 1)), value(0.5 * (n - 1)), value(0.75 * (n - 1)))
    assert (stats["whisker_low"], stats["whisker_high"], stats["outliers"]) == (value(0), value(n - 1), 0)
    plan = quantiles(counted(df, "g"), "v", "n", [0.5], ("g",))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan


def test_without_groups_and_without_values(spark):
    df = spark.createDataFrame([(v,) for v in (5.0, 1.0, 4.0, None)], "v double")
    assert tuple(quantiles(counted(df), "v", "n", [0.5, 0.25]).first()) == (3, 4.0, 2.5)
    assert quantiles(counted(df.limit(0)), "v", "n", [0.5]).where("n IS NOT NULL").count() == 0


def test_outliers_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 100 > 0, "hot").alias("g"), F.when(F.col("id") == 77, 1e6).otherwise(F.col("id") % 10).alias("v"))
    assert [tuple(r) for r in explore.box_outliers(df, "v", "g").collect()] == [("hot", 1e6)]
    found = {r["g"]: r["outliers"] for r in explore.box_stats(df, "v", "g").collect()}
    assert found == {"hot": 1, None: 0}

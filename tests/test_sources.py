import pytest
from pyspark.sql import functions as F

from turnflow.operators import explore
from turnflow.plans.ordering import with_position, with_shuffled_position
from turnflow.plans.row_identity import with_scan_position
from turnflow.schemas import TRACE
from turnflow.sources.traces import read_traces, table_profile


def traces(spark):
    return spark.range(3).select(*[
        (F.col("id") if f.name == "primary id" else F.lit(None).cast(f.dataType)).alias(f.name) for f in TRACE
    ])


def test_second_read_uses_the_cache(spark, tmp_path):
    source, cache = str(tmp_path / "raw"), str(tmp_path / "cache")
    traces(spark).write.parquet(source)
    assert read_traces(spark, source, cache).count() == 3
    assert read_traces(spark, str(tmp_path / "gone"), cache).schema == TRACE
    traces(spark).write.json(str(tmp_path / "raw.json"))
    assert read_traces(spark, str(tmp_path / "raw.json")).count() == 3


def test_failure_is_a_value_error(spark, tmp_path):
    with pytest.raises(ValueError, match="failed to load"):
        read_traces(spark, str(tmp_path / "none"))


def test_table_profile(spark):
    row = table_profile(traces(spark)).first()
    assert row["num_examples"] == 3 and row["features"].startswith("primary id,company task id")
    assert table_profile(traces(spark).limit(0)).first()["first_keys"] is None


@pytest.mark.parametrize("hot", [0, 900])
def test_positions(spark, hot):
    """Positions equal a plain numbering, with one group holding almost all rows and a null group."""
    df = spark.range(1000).select("id", F.when(F.col("id") < hot, "hot").when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"))
    groups = {}
    for r in df.orderBy("id").collect():
        groups.setdefault(r["g"], []).append(r["id"])
    want = {(g, i): n for g, ids in groups.items() for n, i in enumerate(ids)}
    got = {(r["g"], r["id"]): r["position"] for r in with_position(df, ["id"], ("g",)).collect()}
    assert got == want
    alone = with_position(df, ["id"]).collect()
    assert {r["id"]: r["position"] for r in alone} == {i: i for i in range(1000)}
    mixed = with_shuffled_position(df, "id", 3, ("g",)).collect()
    assert sorted((str(r["g"]), r["position"]) for r in mixed) == sorted((str(g), n) for (g, _), n in want.items())


def test_positions_of_equal_and_null_keys(spark):
    """Rows that the order does not tell apart have places of their own."""
    df = spark.createDataFrame([(k,) for k in [None] * 40 + [1] * 40 + [2]], "k int").repartition(4)
    rows = with_position(df, ["k"], total="n").collect()
    assert sorted(r["position"] for r in rows) == list(range(81)) and {r["n"] for r in rows} == {81}
    assert {r["position"] for r in rows if r["k"] is None} == set(range(40))
    scanned = with_scan_position(spark.range(0, 100, 1, 7)).collect()
    assert all(r["id"] == r["position"] for r in scanned)


def test_a_cache_that_was_cut_off_is_not_read(spark, tmp_path):
    source, cache = str(tmp_path / "s"), tmp_path / "c"
    traces(spark).write.parquet(source)
    cache.mkdir()
    assert read_traces(spark, source, str(cache)).count() == 3
    (cache / "_SUCCESS").unlink()
    assert read_traces(spark, source, str(cache)).count() == 3


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0, 1, 5, 9, 10)], "v int")
    rows = explore.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 2]
    assert [(r["low"], r["high"]) for r in rows] == [(i, i + 1) for i in range(10)]
    same = spark.createDataFrame([(4,), (4,)], "v int")
    assert {r["bin"]: r["n"] for r in explore.histogram(same, "v", 10).collect()} == {i: 2 * (i == 5) for i in range(10)}
    groups = spark.createDataFrame([("a", 0), ("a", 4), (None, 7), ("b", None)], "k string, v int")
    rows = {(r["k"], r["bin"]): (r["low"], r["n"]) for r in explore.histogram(groups, "v", 2, "k").collect()}
    assert rows == {("a", 0): (0, 1), ("a", 1): (2, 1), (None, 0): (6.5, 0), (None, 1): (7, 1)}


def test_box(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4, 100)], "k string, v int")
    row = explore.box_stats(df, "v", "k").first()
    assert (row["q1"], row["median"], row["q3"], row["whisker_low"], row["whisker_high"], row["outliers"]) == (2, 3, 4, 1, 4, 1)
    assert [r["v"] for r in explore.box_outliers(df, "v", "k").collect()] == [100]


def test_ties_get_different_shares(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("a", 2, 2), ("b", 5, 3)], "k string, v int, id int")
    rows = explore.cumulative_share(df, "v", "k", "id").orderBy("id").collect()
    assert [r["share"] for r in rows] == pytest.approx([100 / 3, 200 / 3, 100, 100])

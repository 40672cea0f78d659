import math

import pytest
from pyspark.sql import functions as F

from turnflow.operators import splitting
from turnflow.sources import splits

SIZES = (0.7, 0.15, 0.15)


def table(spark, tasks=5, rows=10):
    return spark.range(tasks * rows).select(
        "id", F.concat(F.lit("task"), (F.col("id") % tasks).cast("string")).alias("task"),
        (F.col("id") % 7).alias("num_turns"), F.lit("text").alias("formatted_text"),
    )


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


def test_exact_sizes(spark):
    df = spark.range(296).select("id", F.when(F.col("id") < 200, "a").otherwise("b").alias("task"))
    split = splitting.stratified_split(df, "id")
    assert sizes(split) == {"train": 222, "validation": 37, "test": 37}
    assert split.count() == split.select("id").distinct().count() == 296
    per_task = {(r["split"], r["task"]): r["count"] for r in split.groupBy("split", "task").count().collect()}
    assert per_task[("train", "a")] == 150 and per_task[("train", "b")] == 72


def test_same_seed_same_split(spark):
    first = {tuple(r) for r in splitting.stratified_split(table(spark), "id", *SIZES).select("id", "split").collect()}
    again = {tuple(r) for r in splitting.stratified_split(table(spark).repartition(3), "id", *SIZES).select("id", "split").collect()}
    other = {tuple(r) for r in splitting.stratified_split(table(spark), "id", *SIZES, seed=1).select("id", "split").collect()}
    assert first == again != other


def test_a_hot_stratum_and_nulls(spark):
    """Bucket boundaries inside one large stratum give the row numbers of a full sort."""
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("task"))
    split = splitting.stratified_split(df, "id").cache()
    rows = split.filter("task = 'hot'").select("id", "split", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("k")).collect()
    ranked = [r["split"] for r in sorted(rows, key=lambda r: (r["k"], r["id"]))]
    assert ranked == sorted(ranked, key=splitting.SPLITS.index)
    assert sizes(split) == {"train": 22500, "validation": 3750, "test": 3750}


def test_sizes_hold_for_repeated_and_missing_ids(spark):
    df = spark.range(40).select(F.when(F.col("id") < 20, -1).alias("id"), F.lit("a").alias("task"))
    assert sizes(splitting.stratified_split(df, "id")) == {"train": 30, "validation": 5, "test": 5}
    assert sizes(splitting.random_split(df, "id")) == {"train": 30, "validation": 5, "test": 5}


def test_wrong_input(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        splitting.stratified_split(table(spark), "id", 0.5, 0.1, 0.1)
    with pytest.raises(ValueError, match="nothing"):
        splitting.stratified_split(table(spark), "id", by="nothing")


def test_leakage(spark):
    df = spark.createDataFrame([(1, "train", "x"), (2, "test", "x"), (1, "test", "y"), (3, "train", "z"), (4, "train", "z")], "id long, split string, text string")
    found = {r["kind"]: (r["shared_keys"], r["rows_affected"]) for r in splitting.split_leakage(df, "id", "text").collect()}
    assert found == {"id": (1, 2), "text": (1, 2)}


def test_statistics(spark):
    df = spark.createDataFrame([("train", "a", 2, "ab"), ("train", "b", 4, "abcd"), ("train", "a", 6, "x")], "split string, task string, num_turns int, formatted_text string")
    row = splitting.split_statistics(df).first()
    assert (row["turns_mean"], row["turns_median"], row["turns_min"], row["turns_max"]) == (4.0, 4.0, 2, 6)
    assert row["turns_std"] == pytest.approx(1.632993161855452) and row["text_max"] == 4
    assert {(r["task"], r["n"]) for r in splitting.split_tasks(df).collect()} == {("a", 2), ("b", 1)}


def test_round_trip_on_disk(spark, tmp_path):
    path = f"{tmp_path}/splits"
    split = splitting.stratified_split(table(spark), "id", *SIZES)
    splits.write_splits(split, path)
    assert sizes(splits.read_splits(spark, path)) == sizes(split)
    assert (tmp_path / "splits" / splits.STATISTICS).exists()
    with pytest.raises(FileNotFoundError):
        splits.read_splits(spark, f"{tmp_path}/none")
    (tmp_path / "empty").mkdir()
    with pytest.raises(OSError, match="no splits"):
        splits.read_splits(spark, f"{tmp_path}/empty")


def test_one_split_on_disk(spark, tmp_path):
    splits.write_split(table(spark), str(tmp_path), "train")
    assert splits.read_split(spark, str(tmp_path), "train").count() == 50
    with pytest.raises(FileNotFoundError):
        splits.read_split(spark, str(tmp_path), "test")


def test_quotas_of_a_million_strata(spark):
    """Shares of largest remainder, ranked over many partitions and by no window over all strata."""
    strata = spark.range(1_000_000).select(F.format_string("s%07d", "id").alias("stratum"), (F.col("id") % 7 + 1).alias("n"))
    quotas = splitting.split_quotas(strata, 0.75, 0.5)
    plan = quotas._jdf.queryExecution().executedPlan().toString()
    # the one task there is sees a row per range partition of the strata that tie
    assert "row_number" not in plan and plan.count("SinglePartition") <= 2
    total = sum(k % 7 + 1 for k in range(1_000_000))
    train = math.floor(round(total * 0.75, 6))
    sums = quotas.agg(F.sum("n"), F.sum("train_places"), F.sum("validation_places"), F.count("*"),
                      F.max(F.abs(F.col("train_places") - F.col("n") * train / total))).first()
    assert tuple(sums[:4]) == (total, train, math.floor(round((total - train) * 0.5, 6)), 1_000_000) and sums[4] < 1


def test_quotas_by_largest_remainder_in_order_of_names(spark):
    for sizes, share in (([5, 5, 5, 5, None, 1], 0.75), ([1] * 9, 0.5), ([100, 3, 2], 0.9), ([4, 4], 0.75)):
        names = [None if n is None else f"s{k}" for k, n in enumerate(sizes)]
        rows = [(name, n or 3) for name, n in zip(names, sizes)]
        total = sum(n for _, n in rows)
        wanted = math.floor(round(total * share, 6))
        whole = {name: n * wanted // total for name, n in rows}
        order = sorted(rows, key=lambda r: (-(r[1] * wanted % total), r[0] is not None, r[0] or ""))
        for name, _ in order[: wanted - sum(whole.values())]:
            whole[name] += 1
        found = splitting.split_quotas(spark.createDataFrame(rows, "stratum string, n long"), share, 0.5).collect()
        assert {r["stratum"]: r["train_places"] for r in found} == whole

import random

import pytest
from pyspark.sql import functions as F

from turnflow.operators import shaping, turns
from turnflow.operators.checks import require_columns
from turnflow.schemas import TRACE

COMPANY = dict(
    zip(TRACE.names[:15], [0, 1097, "o3", "Product Recommendations", "Acme Corp", 1000000, 50, 2500000, 5,
                           "Non-combustible", "California", "A technology company", "general liability",
                           "Recommended products: GL, Property", True], strict=True)
)


def user(text):
    return ("user", text, "underwriter", "")


def thought(text, calls=""):
    return ("assistant", text, "internal assistant", calls)


def said(text):
    return ("assistant", text, "user-facing assistant", "")


def tool(text):
    return ("assistant", text, "tool", "")


def table(spark, *traces, **columns):
    rows = []
    for number, trace in enumerate(traces):
        row = {**COMPANY, "primary id": number, **columns, "trace": trace}
        rows.append(tuple(row[name] for name in TRACE.names))
    return spark.createDataFrame(rows, TRACE)


def made(spark, *traces):
    return [r.asDict(recursive=True) for r in shaping.preprocess(table(spark, *traces)).orderBy("original_index").collect()]


def test_thinking_and_answer_become_one_message(spark):
    row, = made(spark, [user("Question?"), thought("Let me think"), said("The answer")])
    assert row["target_response"] == "<think>Let me think</think>The answer"
    assert [m["role"] for m in row["messages"]] == ["system", "user"]
    assert (row["num_turns"], row["num_user_turns"], row["num_assistant_turns"], row["num_tool_turns"]) == (1, 1, 0, 0)


def test_tool_turns_and_blank_calls(spark):
    trace = [user("What products?"), thought("", "[{'name': 'read_query'}]"), tool("rows"), said("These.")]
    row, = made(spark, trace)
    assert [m["role"] for m in row["messages"]] == ["system", "user", "tool"]
    assert row["num_tool_turns"] == 1 and row["target_response"] == "These."
    flag = table(spark, trace).select(shaping.has_tool_calls(F.col("trace")).alias("x")).first()["x"]
    assert flag is True


def test_system_message(spark):
    row, = made(spark, [user("a"), said("b")])
    content = row["messages"][0]["content"]
    assert "- Name: Acme Corp\n- Annual Revenue: $1,000,000\n- Employees: 50\n- Total Payroll: $2,500,000\n" in content
    assert content.endswith("- Line of Business: general liability\n- Description: A technology company")


def test_missing_fields(spark):
    bare = spark.createDataFrame([("X", [user("a"), said("b")])], "`company name` string, trace array<struct<role:string,content:string,type:string,tool_calls:string>>")
    row = shaping.training_examples(shaping.shape_examples(bare)).first()
    assert row["original_index"] == -1 and row["task"] == "" and row["correct"] is None
    assert "- Employees: N/A" in row["messages"][0]["content"]
    assert "Description" not in row["messages"][0]["content"]


def test_index_counts_the_unfiltered_rows(spark):
    df = table(spark, [user("a"), said("b")], [user("c"), said("d")], [user("e"), said("f")]).withColumn(
        "correct", F.when(F.col("primary id") == 0, False).when(F.col("primary id") == 1, None).otherwise(True)
    )
    assert [r["original_index"] for r in shaping.preprocess(df).collect()] == [2]
    report = shaping.preprocess_report(df).first()
    assert (report["processed"], report["filtered"], report["failed"]) == (1, 2, 0)


def test_null_equal_and_absent_keys_lose_no_row(spark):
    df = table(spark, *[[user("a"), said(str(i))] for i in range(4)])
    keyed = df.withColumn("primary id", F.when(F.col("primary id") == 0, 1).when(F.col("primary id") > 1, 2))
    rows = shaping.preprocess(keyed, "primary id").collect()
    assert sorted(r["target_response"] for r in rows) == ["0", "1", "2", "3"]
    assert sorted(r["original_index"] for r in rows) == [0, 1, 2, 3]
    assert next(r["original_index"] for r in rows if r["target_response"] == "1") == 0  # the null key comes first
    bare = shaping.preprocess(df.drop("primary id").coalesce(1)).collect()
    assert sorted((r["original_index"], r["target_response"]) for r in bare) == [(i, str(i)) for i in range(4)]


def test_index_is_the_place_in_the_input_whatever_the_ids(spark, tmp_path):
    """Ids 30, 10, 20 and a null, in several files: the positions are 0, 1, 2, 3 as they lie."""
    stored = str(tmp_path / "corpus")
    for part, ids in enumerate([(30, 10), (20,), (), (None, 10)]):
        rows = table(spark, *[[user("a"), said(f"{part}-{k}")] for k in range(len(ids))])
        keys = F.array(*[F.lit(i).cast("long") for i in ids]) if ids else F.array().cast("array<long>")
        rows.withColumn("primary id", F.get(keys, F.col("primary id").cast("int"))).coalesce(1).write.mode("append").parquet(f"{stored}/part={part}")
    made = shaping.preprocess(spark.read.parquet(stored))
    assert [r["target_response"] for r in made.orderBy("original_index").collect()] == ["0-0", "0-1", "1-0", "3-0", "3-1"]
    assert sorted(r["original_index"] for r in made.collect()) == [0, 1, 2, 3, 4]


def test_preprocess_of_a_stored_corpus_exchanges_no_conversation(spark, tmp_path):
    stored = str(tmp_path / "corpus")
    df = table(spark, *[[user("a"), said(str(i))] for i in range(40)]).withColumn("correct", F.col("primary id") % 2 == 1)
    df.repartition(4).write.parquet(stored)
    made = shaping.preprocess(spark.read.parquet(stored))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ShuffleExchange" not in plan and "Exchange hashpartitioning" not in plan and "Sort " not in plan
    assert "EqualTo(correct,true)" in plan or "correct" in plan.split("PushedFilters")[1]
    as_read = spark.read.parquet(stored).collect()
    of = {r["target_response"]: r["original_index"] for r in made.collect()}
    assert len(of) == 20 and len({*of.values()}) == 20 and max(of.values()) < len(as_read)


def test_rejected_rows(spark):
    df = table(spark, None, [], [said(" \n")], [said("a"), user("b")], [user("a"), None, said("b")])
    reasons = {r["id"]: r["reject_reason"] for r in shaping.rejected_examples(df).collect()}
    assert reasons == {0: shaping.NO_TRACE, 1: shaping.NO_TURN, 2: shaping.NO_TURN, 3: shaping.NO_ANSWER}
    assert shaping.preprocess(df).count() == 1


def test_nothing_usable_is_an_error(spark):
    with pytest.raises(ValueError, match="filtered"):
        shaping.preprocess(table(spark, [user("a")]))


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="trace"):
        require_columns(spark.range(1), ["id", "trace"])


def test_statistics(spark):
    rows = [(2, [("user", "Hello"), ("assistant", "Hi")]), (3, [("user", "abc")])]
    df = spark.createDataFrame(rows, "num_turns int, messages array<struct<role:string,content:string>>")
    stats = shaping.preprocessing_stats(df).first()
    assert (stats["num_examples"], stats["turns_mean"], stats["turns_min"], stats["turns_max"]) == (2, 2.5, 2, 3)
    assert (stats["chars_mean"], stats["chars_min"], stats["chars_max"]) == (5.0, 3, 7)


def random_trace(rng):
    return [rng.choice([user, thought, said, tool])(rng.choice(["x y", " ", "z!!", "w"])) for _ in range(rng.randint(1, 30))]


@pytest.mark.parametrize("stretch", [1, 3, 1024])
def test_long_and_nested_form_agree(spark, stretch):
    """Long conversations cut into short stretches give the messages of the nested form."""
    rng = random.Random(stretch)
    traces = [random_trace(rng) for _ in range(40)]
    nested = shaping.with_merged_turns(shaping.with_turns(table(spark, *traces)))
    want = {r["primary id"]: [(m["role"], m["content"]) for m in r["merged"]] for r in nested.select("primary id", "merged").collect()}
    rows = [(c, t, 0, *message) for c, trace in enumerate(traces) for t, message in enumerate(trace)]
    long = spark.createDataFrame(rows, "conv_id long, turn long, part int, role string, content string, type string, tool_calls string")
    for chunk in (1, 4, 65_536):
        chunks = turns.merge_assistant_runs(turns.extract_turns(long), stretch, chunk)
        got, sizes = {}, {}
        for r in chunks.orderBy("conv_id", "turn", "part", "offset").collect():
            message = r["conv_id"], r["turn"], r["part"]
            assert r["chars"] == len(r["content"]) <= chunk
            role, before = got.setdefault(message, (r["role"], ""))
            assert r["offset"] == len(before) and role == r["role"]
            assert r["preceding"] == (before[-1] if before else None)
            got[message] = role, before + r["content"]
            sizes.setdefault(message, []).append((r["closes"], r["is_last"], r["answered"]))
        by_conversation = {}
        for message in sorted(got):
            by_conversation.setdefault(message[0], []).append(message)
        assert {c: [got[m] for m in ms] for c, ms in by_conversation.items()} == {c: m for c, m in want.items() if m}
        for ms in by_conversation.values():
            answered = got[ms[-1]][0] == "assistant"
            for m in ms:
                assert [c for c, _, _ in sizes[m]] == [False] * (len(sizes[m]) - 1) + [True]
                assert {x[1:] for x in sizes[m]} == {(m == ms[-1], answered)}


def test_a_run_of_200000_turns_stays_in_bounded_rows(spark):
    """One conversation of one assistant run: no row grows with it, and its counters are right."""
    n = 200_000
    long = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), (F.col("id") + 1).alias("turn"), F.lit(0).alias("part"), F.lit("assistant").alias("role"),
        F.format_string("turn %06d with some words; ", "id").alias("content"), F.lit("internal assistant").alias("type"), F.lit("").alias("tool_calls"))
    asked = long.limit(1).withColumns({"turn": F.lit(0).cast("long"), "role": F.lit("user"), "type": F.lit("underwriter")})
    chunks = turns.merge_assistant_runs(turns.extract_turns(asked.unionByName(long)))
    rows = chunks.select("turn", "offset", "chars", "merged_turns", F.length("content").alias("n"), "closes", "is_last").orderBy("turn", "offset").collect()
    size = len("<think>turn 000000 with some words;</think>")
    run = [r for r in rows if r["turn"] == 1]
    assert max(r["n"] for r in rows) <= turns.CHUNK and len(run) >= n * size // turns.CHUNK
    assert sum(r["chars"] for r in run) == n * size and sum(r["merged_turns"] for r in run) == n
    assert [r["offset"] for r in run] == [sum(x["chars"] for x in run[:k]) for k in range(len(run))]
    assert [r["closes"] for r in run] == [False] * (len(run) - 1) + [True] and all(r["is_last"] for r in run)
    ends = turns.conversation_ends(chunks).first()
    assert (ends["num_messages"], ends["last_role"], ends["last_chars"]) == (2, "assistant", n * size)


def test_tokens_of_chunks_are_those_of_messages(spark):
    """Words that chunks or stretches cut count once."""
    rng = random.Random(12)
    words = lambda: " ".join(rng.choice(["abc", "d", "12", "x_y", "é", "!!", "<", "-"]) for _ in range(rng.randint(1, 9)))
    rows = [(c, t, 0, *rng.choice([user, thought, said, tool])(words())) for c in range(30) for t in range(rng.randint(1, 12))]
    long = spark.createDataFrame(rows, "conv_id long, turn long, part int, role string, content string, type string, tool_calls string")
    prompts = spark.createDataFrame([(c, "You are one.") for c in range(29)], "conv_id long, system_prompt string")
    counts = [
        {r["conv_id"]: r["token_count"] for r in turns.token_counts(
            turns.split_target(turns.merge_assistant_runs(turns.extract_turns(long), stretch, chunk)), prompts).collect()}
        for stretch, chunk in ((1024, 65_536), (1024, 3), (2, 5), (1, 1))]
    assert counts[0] and all(c == counts[0] for c in counts[1:])

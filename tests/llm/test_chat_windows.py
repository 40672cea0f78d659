from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnflow.llm.chat_windows import END, MARKS, TURN, budgeted_windows, read_back

ROWS = [
    (1, 0, "system", "Be brief.", "x"), (1, 1, "user", "hello there", "x"), (1, 2, "assistant", "hi " * 30, "x"),
    (1, 3, "user", "and? <|end|>\n<|turn|>assistant\nno \\b \\p|", "x"), (1, 4, "assistant", "so " * 90, "x"),
    (2, 0, "user", None, "x"), (2, 1, "assistant", "", "x"), (3, 0, None, "no role", "x"), (3, None, "user", "no turn", "x"),
    (None, 0, "user", "no id", "x"), (None, 1, "assistant", "still none", "x"),
    (4, 0, "assistant", "same", "x"), (4, 0, "assistant", "same", "x"), (4, 0, "us\ner", "tie", "x"),
    (5, 0, "system", "only a system turn", "x"), (6, 0, "system", "long " * 300, "x"), (6, 1, "assistant", "after", "x"),
] + [(9, i, "assistant" if i % 2 else "user", f"turn {i} " + "w " * (i % 40), "x") for i in range(2600)]
SCHEMA = "conv_id long, turn long, role string, text string, window string"


def expected(rows):
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in groups.items()}


@pytest.fixture(scope="module")
def windows(spark):
    return budgeted_windows(spark.createDataFrame(ROWS, SCHEMA).repartition(4), 128, 32).cache()


def test_read_back_gives_the_turns_and_the_trained_texts(windows):
    got = {r.conv_id: r for r in read_back(windows).collect()}
    want = expected(ROWS)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")


def test_budget_system_turn_and_history(windows):
    rows = windows.where("conv_id = 9").orderBy("window").collect()
    turns = [x for _, x in expected(ROWS)[9]]
    tokens = {x: MARKS + len(x.split()) for x in turns}
    seen = 0
    for row in rows:
        pieces = [p.removeprefix(TURN).split("\n", 1)[1] for p in row.formatted.split(END)[:-1]]
        new = pieces[len(pieces) - row.n_new :]
        assert new == turns[seen : seen + row.n_new]
        old = pieces[: len(pieces) - row.n_new]
        assert old == turns[seen - len(old) : seen] and sum(tokens[x] for x in old) <= 32
        if seen and tokens[turns[seen - 1]] <= 32:
            assert old
        assert row.n_tokens == sum(tokens[x] for x in pieces) <= 128
        seen += row.n_new
    assert seen == len(turns)
    first = windows.where("conv_id = 1").collect()
    assert len(first) > 1 and all(r.formatted.startswith(f"{TURN}system\nBe brief.") for r in first)


def test_loss_covers_no_repeated_turn(windows):
    for row in windows.where("conv_id in (1, 9)").collect():
        assert all(s.start >= row.new_from for s in row.loss)
    spans = Counter()
    for row in windows.where("conv_id = 9").collect():
        for s in row.loss:
            spans[row.formatted[s.start : s.start + s.chars]] += 1
    assert spans == Counter(x for r, x in expected(ROWS)[9] if r == "assistant")


def test_empty_table(spark):
    assert budgeted_windows(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="\\bnp<|>end\ntur ", max_size=24), min_size=1, max_size=6))
def test_any_text_comes_back(spark, texts):
    rows = [(1, i, "assistant", t, "x") for i, t in enumerate(texts)]
    got = read_back(budgeted_windows(spark.createDataFrame(rows, SCHEMA), 16, 4)).first()
    assert got.loss_text == "".join(texts) and got.turns == "".join(f"assistant\n{t}\n" for t in texts)

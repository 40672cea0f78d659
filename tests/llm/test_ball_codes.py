import random

import numpy as np
from pyspark.sql import functions as F

from turnflow.llm import ball_codes
from turnflow.llm.ball_codes import Balls, compress, nearest, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, vector int, slot int, `odd name` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, c, "c", "e", 1, 2, "o") for i, v, c in rows], SCHEMA).repartition(3)


def some(n, width=8, seed=3, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice((-1, 0, 1)) * 0.4 + rng.gauss(0, 0.05) * spread for _ in range(width)], rng.choice((None, 1, 2, 3)))
            for i in range(n)]


def brute(rows, rounds=4, parts=4):
    """Every part against every entry in Python integers."""
    kept = [(i, v, c) for i, v, c in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v] for _, v, _ in kept]
    step = len(whole[0]) // parts
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:256]
    books = [[whole[k][p * step : (p + 1) * step] for k in order] for p in range(parts)]

    def assign():
        out = []
        for v in whole:
            mine = []
            for p in range(parts):
                part = v[p * step : (p + 1) * step]
                far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
                mine.append((far.index(min(far)), min(far)))
            out.append(mine)
        return out

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * step : (p + 1) * step] for v, c in zip(whole, codes) if c[p][0] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    rows_out = [(i, bytes(c for c, _ in code), sum(e for _, e in code), label) for (i, _, label), code in zip(kept, assign())]
    total = {}
    for *_, error, label in rows_out:
        total[label] = total.get(label, 0) + error
    return sorted([(i, c, e, total[label]) for i, c, e, label in rows_out], key=repr), books


def run(df):
    codes = compress(df)
    rows = sorted([(r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in with_label_error(codes.rows).collect()], key=repr)
    return rows, [b.tolist() for b in codes.codebooks]


def test_as_brute_force(spark):
    rows = some(320)
    assert run(vectors(spark, rows)) == brute(rows)


def test_nulls_ties_repeated_rows_and_fewer_vectors_than_entries(spark):
    rows = some(40) + [(None, [0.1] * 8, 1), (5, [0.1] * 8, None), (5, [0.1] * 8, None), (90, None, 1), (91, [0.1] * 7 + [None], 1),
                       (92, [float("nan")] + [0.0] * 7, 1), (93, [float("inf")] * 8, 2), (94, [0.0] * 8, 2), (95, [0.0] * 8, 2)]
    assert run(vectors(spark, rows)) == brute(rows)


def test_one_vector_many_times(spark):
    rows = [(i, [0.25] * 8, 1) for i in range(300)] + some(60, seed=9)
    rows = [(k, v, c) for k, (_, v, c) in enumerate(rows)]
    assert run(vectors(spark, rows)) == brute(rows)


def test_empty_table_and_no_vector_left(spark):
    assert run(vectors(spark, [])) == ([], [[]] * 4)
    assert run(vectors(spark, [(1, None, 2), (2, [None], 1)])) == ([], [[]] * 4)


def test_short_and_huge_vectors_have_a_result(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5, 0.25], 1), (3, [], 1), (4, [3e38] * 8, 2), (5, [-3e38] * 8, 2)]
    found, books = run(vectors(spark, rows))
    assert [r[0] for r in found] == [1, 2, 3, 4, 5] and all(r[2] >= 0 for r in found)
    assert books[0][1] == [512, 256] and books[1][1] == [0, 0]


def test_rings_leave_out_candidates_but_lose_none():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (64, 6))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-80, 80, (3200, 6))
    balls = Balls(centres)
    for code in (np.repeat(np.arange(64), 50), rng.integers(0, 64, 3200)):
        assert [a.tolist() for a in balls.reassign(x, code)] == [a.tolist() for a in nearest(x, centres)]
    settled = Balls(centres)
    settled.reassign(x, np.repeat(np.arange(64), 50))
    assert settled.compared < 0.1 * len(x) * len(centres)


def test_ties_go_to_the_lower_entry_whatever_the_code_before():
    book = np.array([[0, 0], [4, 0], [4, 0], [2, 2]])
    x = np.array([[2, 0], [4, 0], [2, 1], [3, 1]])
    for code in range(4):
        assert [a.tolist() for a in Balls(book).reassign(x, np.full(4, code))] == [a.tolist() for a in nearest(x, book)]


def test_code_column_reads_as_hex(spark):
    rows = compress(vectors(spark, some(30))).rows.select(F.lower(F.hex("code")).alias("h")).collect()
    assert all(len(r["h"]) == 2 * ball_codes.PARTS for r in rows)

import numpy as np
from pyspark.sql import functions as F

from turnflow.llm.multi_index import Codebook, nearest

SCHEMA = "vec_id long, embedding array<float>, score string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", "v") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, is_query, k):
    sound = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            sound[i] = min(sound.get(i, v), v)
    ids, data = np.array(sorted(sound)), None
    data = np.array([np.array(sound[i], np.float32).astype(float) for i in ids])
    out = {}
    for q in filter(is_query, ids.tolist()):
        s = (data * data[ids == q][0]).sum(1)
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[q] = [(r + 1, int(ids[b]), float(s[b])) for r, b in enumerate(best)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_awkward_vectors_are_exact_where_few(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(30)]
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows += [(100 + i, same) for i in range(40)]
    rows += [(60, None), (80, [0.0] * 6), (None, same), (40, [float("nan")] * 6), (200, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (220, [float("inf")] + [0.0] * 5), (20, rows[20][1])]
    got = found(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=5, recall=1.1))
    assert got == brute(rows, lambda i: i % 20 == 0, 5)


def test_fewer_candidates_than_wanted_and_empty_table(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert found(nearest(frame(spark, rows), F.col("vec_id") == 0, k=20)) == brute(rows, lambda i: i == 0, 20)
    assert found(nearest(frame(spark, rows[:1]), F.col("vec_id") == 0, k=20)) == {}
    assert nearest(frame(spark, []), F.col("vec_id") == 0).count() == 0


def test_small_tables_give_as_many_neighbours_as_wanted(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    got = found(nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=20, recall=0.0))
    assert {q: len(near) for q, near in got.items()} == {0: 20, 20: 20, 40: 20}


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = found(nearest(table, F.col("vec_id") % 20 == 0)), brute(rows, lambda i: i % 20 == 0, 20)
    hits = sum(len({x[1] for x in got[q]} & {x[1] for x in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(got[q]) == 20 for q in want)


def test_walk_takes_cells_in_order_of_distance():
    rng = np.random.default_rng(0)
    book = Codebook(rng.normal(size=(300, 8)), 6, 0.9, 5)
    query = rng.normal(size=8)
    walked = book.walk(query, [1] * 36, 36)
    far = -(book.halves[0] @ query[:4])[:, None] - (book.halves[1] @ query[4:])[None]
    assert sorted(walked) == list(range(36))
    assert np.all(np.diff(far.ravel()[walked]) >= 0)

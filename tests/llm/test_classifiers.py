import numpy as np
import pyarrow as pa
import pytest
from awkward import ROWS, documents, empty
from pyspark.sql import functions as F

from turnflow.llm import quality_knn, toxicity_fm
from turnflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def labels(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int, text string")


@pytest.mark.parametrize("operator,name", [(quality_knn, "quality"), (toxicity_fm, "toxic")])
def test_awkward_documents(spark, operator, name):
    docs = documents(spark)
    marked = labels(spark, [(7, 1, "x"), (3, 0, "x"), (3, 0, "x"), (None, 1, "x"), (2, 1, None), (99, 1, ""), (5, None, ""), (8, 7, "")], name)
    rows = operator.score(docs, operator.fit(docs, marked)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty
    assert operator.score(empty(spark), operator.fit(docs, marked)).count() == 0
    unlabelled = operator.fit(docs, marked.limit(0))
    assert {r.score for r in operator.score(docs, unlabelled).collect()} == {0.5}


def test_quality_scores_leave_columns_alone(spark):
    docs = documents(spark)
    model = quality_knn.fit(docs, labels(spark, [(7, 1, "x"), (3, 0, "x")], "quality"))
    scored = quality_knn.with_score(docs, model, name="vote")
    assert scored.columns == [*docs.columns, "vote"]
    assert sorted(map(repr, scored.drop("vote").collect())) == sorted(map(repr, docs.collect()))


def test_nearest_neighbours_vote_by_similarity():
    rng = np.random.default_rng(1)
    terms = np.zeros((40, quality_knn.WIDTH), np.float32)
    terms[:20, :5], terms[20:, 5:10] = rng.random((20, 5)), rng.random((20, 5))
    model = quality_knn.Model(terms, np.r_[np.ones(20), np.zeros(20)], 4)
    got = model.scores(terms, neighbours=7, sharpness=2.0)
    cosines = model.vectors @ model.vectors.T
    for i in range(40):
        near = np.argsort(-cosines[i], kind="stable")[:7]
        weight = np.maximum(cosines[i][near], 0) ** 2
        assert got[i] == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), abs=1e-4)


def test_terms_of_a_text_do_not_depend_on_its_neighbours():
    texts = [t or "" for _, t in ROWS] + ["a", "ab", "abcd"]
    together = np.concatenate([w for *_, w in quality_knn.term_weights(pa.record_batch([pa.array(texts)], ["text"]))])
    for text, weights in zip(texts, together, strict=True):
        (_, _, alone), = quality_knn.term_weights(pa.record_batch([pa.array([text])], ["text"]))
        assert np.array_equal(alone[0], weights)


def test_pairs_of_terms_count_beyond_their_sum():
    terms = {w: toxicity_fm.Terms(12)[w][0] for w in ("insult", "group")}
    rows, marks = [], []
    for i in range(400):
        insult, group = i % 2, i // 2 % 2
        rows.append(np.sort(np.array([terms[w] for w, on in (("insult", insult), ("group", group)) if on], np.int32)))
        marks.append(float(insult and group))
    machine = toxicity_fm.Machine(rows, np.array(marks), 12, rounds=60)
    place = lambda *words: np.array([machine.place[terms[w]] for w in words])
    scores = machine.scores([place("insult", "group"), place("insult"), place("group"), place()[:0].astype(int)])
    assert scores[0] > 0.5 and max(scores[1:]) < 0.5
    assert (machine.vectors[place("insult")] @ machine.vectors[place("group")].T).item() > 0


def test_a_term_of_mean_share_counts_beside_another():
    rng = np.random.default_rng(1)
    insult, group, other = 1, 2, 3
    rows, marks = [], []
    for _ in range(4000):
        with_group, with_insult = rng.random() < 0.3, rng.random() < 0.1
        with_other = not with_group and rng.random() < 0.1
        more = np.unique(1000 + (2000 * rng.random(10)).astype(int))
        named = [t for t, on in ((insult, with_insult), (group, with_group), (other, with_other)) if on]
        rows.append(np.r_[np.array(named, int), more].astype(np.int32))
        marks.append(float((with_group and with_insult) or with_other))
    marks = np.array(marks)
    held = np.array([group in r for r in rows])
    assert abs(marks[held].mean() - marks.mean()) < 4 * marks.std() / np.sqrt(held.sum())
    machine = toxicity_fm.Machine(rows, marks, 12)
    place = lambda *words: machine.place[list(words)]
    scores = machine.scores([place(insult, group), place(insult), place(group)])
    assert machine.place[group] >= 0 and scores[0] > 0.5 and max(scores[1:]) < 0.5


@pytest.mark.parametrize("name,least", [("op3_quality_knn", 0.97), ("op9_toxicity_fm", 0.97)])
def test_held_out_accuracy(spark, name, least):
    kind = "quality" if "quality" in name else "toxic"
    found = QUERIES[name](spark, FOLDER)
    marked = spark.read.parquet(f"{FOLDER}/labels.parquet")
    right = found.where("held_out").join(marked, "doc_id").agg(F.avg((F.col("predicted") == F.col(kind)).cast("int"))).first()[0]
    assert right >= least
    assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()

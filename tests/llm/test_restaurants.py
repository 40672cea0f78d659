import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from awkward import LONG, ROWS, documents, empty
from pyspark.sql import functions as F

from turnflow.llm import restaurants
from turnflow.llm.dictionary import DOCS
from turnflow.llm.restaurants import DISCOUNT, _stirling, draw_tables, score


def tokens(text):
    return [*("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()), b""]


def run(docs, learn):
    return score(docs, learn).collect()


def test_base_model_and_counts(spark):
    learn = F.col("doc_id") % 3 != 0
    rows = run(documents(spark), learn)
    trained = Counter(w for i, t in ROWS if i is None or i % 3 for w in tokens(t))
    n, v = sum(trained.values()), len(trained)
    want = Counter()
    for i, t in ROWS:
        w = tokens(t)
        base = sum(math.log10((trained[x] + 1) / (n + v + 1)) for x in w)
        want[(i, i is not None and i % 3 == 0, len(w), sum(trained[x] > 0 for x in w), n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id in (5, 10)}
    assert LONG and by_id[10].score / by_id[10].n_tokens > by_id[10].base_score / by_id[10].n_tokens


def test_nothing_to_learn_from_and_empty_table(spark):
    rows = run(documents(spark), F.lit(False))
    assert {r.train_tokens for r in rows} == {0} and all(math.isfinite(r.score) for r in rows)
    assert run(empty(spark), F.lit(True)) == []


def test_probabilities_of_a_context_sum_to_one(spark):
    """Held-out texts of one word each: P(word | begin) P(end | word), summed over words and the unknown one."""
    learnt = [(i, t) for i, t in enumerate(["a b a", "b a", "a a b c", "c", "b"] * 4)]
    words = ["a", "b", "c"]
    first = {r.doc_id: r.score for r in run(documents(spark, learnt + [(100 + k, w) for k, w in enumerate(words)]), F.col("doc_id") < 100)}
    ends = {}
    for k, w in enumerate(words):
        two = run(documents(spark, learnt + [(100, f"{w} {w}"), (101, w)]), F.col("doc_id") < 100)
        by = {r.doc_id: r.score for r in two}
        assert by[101] == pytest.approx(first[100 + k], abs=1e-6)
        ends[w] = by[100] - by[101]  # log of P(w | w)
        assert ends[w] < 0
    assert sum(10 ** first[100 + k] for k in range(3)) < 1


def test_draws_follow_the_exact_conditional():
    c, others, parent, strength = 4, 3, 0.2, 1.0
    table = _stirling(DISCOUNT, 8)
    t = np.arange(1, c + 1)
    weight = np.exp(table[c, t] + np.cumsum(np.log(strength + DISCOUNT * (others + t - 1)) + np.log(parent)))
    n = 20_000
    drawn = draw_tables(np.full(n, c), np.ones(n, int), np.zeros(n, int), np.array([others + 1]), np.ones(n, int),
                        np.full(n, parent), DISCOUNT, strength, np.random.default_rng(0), _stirling(DISCOUNT, 64))
    assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / n - weight / weight.sum()).max() < 0.015
    large = draw_tables(np.full(500, 1000), np.ones(500, int), np.zeros(500, int), np.array([1]), np.ones(500, int),
                        np.full(500, parent), DISCOUNT, strength, np.random.default_rng(0), _stirling(DISCOUNT, 64))
    assert large.min() >= 1 and large.max() <= 1000


def test_stirling_numbers_by_seating():
    """Weights of seating customers one by one, summed over seatings with the same number of tables."""
    d, want = 0.3, Counter({(1,): 1.0})
    for _ in range(4):
        now = Counter()
        for sizes, w in want.items():
            now[(*sizes, 1)] += w
            for k, s in enumerate(sizes):
                now[(*sizes[:k], s + 1, *sizes[k + 1 :])] += w * (s - d)
        want = now
    sums = Counter()
    for sizes, w in want.items():
        sums[len(sizes)] += w
    table = _stirling(d, 5)
    assert [math.exp(table[5, t]) for t in range(1, 6)] == pytest.approx([sums[t] for t in range(1, 6)])


def test_copies_of_a_held_out_text_score_better_than_the_base(spark):
    text = "some words that follow each other in the same order every time they are met here"
    rows = [(i, text if i % 4 else f"{text} once {i}") for i in range(40)]
    for r in run(documents(spark, rows), F.col("doc_id") % 5 != 0):
        assert r.score > r.base_score


def test_messages_are_small(spark):
    """Bytes of what one chunk sends and is told, over one bucket, for every distinct pair or word."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, 100), 10**6))) for i in range(300)]
    pairs = {p for _, t in rows for p in zip([b"\n", *tokens(t)], tokens(t))}
    words = {w for pair in pairs for w in pair}
    docs = documents(spark, rows).select("doc_id", "text", F.lit(True).alias("learn")).coalesce(1)
    coded = restaurants._chunks(docs, 1).toArrow()
    asked = coded.filter(pa.array([b != DOCS for b in coded.column("bucket").to_pylist()]))
    sent = restaurants._pairs(1)(coded, restaurants._word_counts(asked))
    seated = restaurants._seating(sum(len(tokens(t)) for _, t in rows), 1)(sent)
    sums = seated.filter(pa.array([c < restaurants.TOTALS for c in seated.column("chunk").to_pylist()]))
    told = restaurants._parent(1)(asked, sums)
    size = lambda t: sum(len(p.as_py()) for p in t.column("payload"))
    assert size(sent) < 5.6 * len(pairs) and size(sums) < 13 * len(words) and size(told) < 2 * len(words)


def test_planes_and_steps_hold_any_numbers():
    for values in ([], [0], [0, 0, 1], [255, 256, 1 << 47], [1, (1 << 64) - 1]):
        numbers = np.array(values, np.uint64)
        assert restaurants._of_planes(restaurants._planes(numbers)).tolist() == values
        assert restaurants._of_steps(restaurants._steps(numbers)).tolist() == values

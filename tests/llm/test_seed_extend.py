import hashlib
import random
import re

import numpy as np
from awkward import ROWS, documents, empty

from turnflow.llm import seed_extend
from turnflow.llm.seed_extend import WINDOW, anchors, remove_repeated_words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows):
    """(id, words, removed, kept) per row, by comparing every window."""
    key = lambda i: (i is not None, i or 0)
    split = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - WINDOW + 1):
            w = tuple(words[k : k + WINDOW])
            first[w] = min(first.get(w, (key(i), k)), (key(i), k))
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - WINDOW + 1):
            if first[tuple(words[k : k + WINDOW])] < (key(i), k):
                gone[k : k + WINDOW] = [True] * WINDOW
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g)))
    return sorted(out, key=repr)


def run(docs, **options):
    found = remove_repeated_words(docs, **options).collect()
    assert all(sum(s.end - s.begin for s in r.removed) == r.n_removed for r in found)
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found), key=repr)


def shared(seed, n=160):
    """Texts put together from passages of 5 to 60 words of a small vocabulary."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice("the of a and to in is it on as cat dog élan x1 y2 z3".split()) for _ in range(k))
    passages = [some(rng.randrange(5, 60)) for _ in range(25)]
    space = lambda: rng.choice((" ", "  ", "\n", "\t \x0b"))
    return [(rng.randrange(-5, n), space().join(rng.choice(passages) if rng.random() < 0.7 else some(rng.randrange(30))
                                               for _ in range(rng.randrange(0, 7)))) for _ in range(n)]


def repeating():
    """Texts that repeat within themselves, with overlaps, and one long one of the same words."""
    cycle = " ".join(f"w{k % 7}" for k in range(90))
    return [(1, "again " * 50), (2, "again " * 19), (3, "again " * 20), (4, cycle), (5, "start " + cycle), (0, cycle + " " + cycle[3:]),
            (6, "no break space \x1c splits no words " * 8), (7, "again " * 30_000), (8, cycle + " end"), (9, cycle)]


def test_awkward_documents(spark):
    assert run(documents(spark)) == brute(ROWS)


def test_shared_passages(spark):
    rows = shared(4)
    assert run(documents(spark, rows)) == brute(rows)


def test_repeats_within_one_text(spark):
    rows = repeating()
    assert run(documents(spark, rows)) == brute(rows)


def test_frequent_anchors_travel_by_whole_windows(spark):
    rng = random.Random(6)
    some = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    around = [(some(14), some(14)) for _ in range(60)]
    rows = [(i, f"{a} one phrase of eight words in all places {b}") for i, (a, b) in enumerate(rng.choice(around) for _ in range(200))]
    for many in (0, 5):
        assert run(documents(spark, rows), many=many) == brute(rows)
        assert run(documents(spark, shared(4)), many=many) == brute(shared(4))


def test_anchors_in_small_runs(spark, monkeypatch):
    monkeypatch.setattr(seed_extend, "TOGETHER", 100)
    rows = shared(11, 60)
    assert run(documents(spark, rows)) == brute(rows)


def test_equal_hashes_of_different_seeds_are_told_apart():
    words = np.array([*range(20), *range(20), *range(19), 77, 5, *range(1, 20)])
    first = seed_extend.first_windows(
        np.full(4, 9, np.uint64), np.array([3, 1, 0, 0]), np.zeros(4, np.int64), np.full(4, 4), np.ones(4, np.int64), words,
        np.arange(4) * 20)
    assert first.tolist() == [False, True, True, True]


def test_every_window_has_an_anchor_at_the_same_place_wherever_it_occurs():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    one = np.r_[rng.integers(0, 2**63, 31).astype(np.uint64), passage]
    two = np.r_[passage, rng.integers(0, 2**63, 17).astype(np.uint64)]
    places = []
    for text, offset in ((one, 31), (two, 0)):
        _, _, seed, begin, n = anchors(text, np.array([0, len(text)]))
        assert n.sum() == len(text) - WINDOW + 1
        of = dict(zip((np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()) - offset).tolist(), np.repeat(seed - offset, n).tolist()))
        places.append([of[k] for k in range(60 - WINDOW + 1)])
    assert places[0] == places[1]


def test_empty_table(spark):
    assert run(empty(spark)) == []


def test_kept_text_is_that_of_the_words(spark):
    found = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in remove_repeated_words(documents(spark, [(1, " a  b\n")])).collect()}
    assert found == {1: hashlib.sha256(b"a b").hexdigest()}

import random
import re

import numpy as np
import xxhash
from awkward import LONG, ROWS, documents, empty

from turnflow.llm import simhash_pivots
from turnflow.llm.components import smallest_reachable
from turnflow.llm.simhash_pivots import fingerprint, links, near_duplicates, one_of_each


def slow_fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def classes(codes, bits):
    """Smallest index of the class of every code, by comparing all."""
    parent = list(range(len(codes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(codes)):
        for b in range(a):
            if bin(codes[a] ^ codes[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(i) for i in range(len(codes))]


def brute(rows):
    codes = [slow_fingerprint(t) for _, t in rows]
    of = classes(codes, 3)
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    return sorted(((i, f"{code:016x}", least[c]) for (i, _), code, c in zip(rows, codes, of, strict=True)), key=repr)


def test_awkward_documents(spark):
    rng = random.Random(1)
    rows = list(ROWS)
    for k in range(15):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        for n in range(4):
            rows.append((100 + 10 * k + n, " ".join(words[: 120 - n])))
    got = sorted((tuple(r) for r in near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_fingerprints_of_long_texts_in_pieces(monkeypatch):
    want = slow_fingerprint(LONG)
    assert fingerprint(LONG, 3) == want
    monkeypatch.setattr(simhash_pivots, "PIECE", 50)
    assert fingerprint(LONG, 3) == want
    assert fingerprint("  a b  ", 3) == xxhash.xxh64_intdigest(b"a b", 42) and fingerprint(" \n", 3) == 0


def test_links_join_all_pairs_within_the_distance(spark, monkeypatch):
    rng = random.Random(9)
    codes = {rng.getrandbits(64) for _ in range(150)}
    for code in list(codes)[:60]:
        for _ in range(4):
            near = code
            for _ in range(rng.randrange(1, 5)):
                near ^= 1 << rng.randrange(64)
            codes.add(near)
    centre = rng.getrandbits(64)
    codes |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # a large group
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    for most in (simhash_pivots.LARGE, 20):
        monkeypatch.setattr(simhash_pivots, "LARGE", most)
        found = links(table).collect()
        assert len(found) < 10 * len(codes)
        at = {c: k for k, c in enumerate(signed)}
        label = np.arange(len(codes))
        simhash_pivots._merge(label, np.array([at[r.a] for r in found]), np.array([at[r.b] for r in found]))
        assert label.tolist() == classes(codes, 3)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5), (160, 100)]
    got = {r.node: r.root for r in smallest_reachable(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 7 for k in [7, *range(300, 340)]}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    docs = documents(spark)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    of = classes([slow_fingerprint(t) for _, t in ROWS], 3)
    want = [min((i is None, i or 0) for k, (i, _) in enumerate(ROWS) if of[k] == root) for root in sorted({*of})]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(want)
    assert all(r["_rest"]["a b"] == 6 and r["_mark"] == "m" and r["_key"] == 8 for r in rows)


def test_one_of_rows_without_ids_and_of_repeated_ids(spark):
    text = "the same words in every one of these rows " * 3
    other = "something else that no other row has in it at all, not even in part " * 2
    rows = [(None, text)] * 6 + [(5, other), (5, text), (4, other), (None, "alone and without an id, but with words")] * 2
    kept = one_of_each(documents(spark, rows))
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(5, text), (4, other), (None, rows[-1][1])], key=repr)
    assert sorted(((r.doc_id, r.text) for r in one_of_each(documents(spark, rows[::-1]).repartition(7)).collect()), key=repr) == found


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0 and one_of_each(empty(spark)).count() == 0

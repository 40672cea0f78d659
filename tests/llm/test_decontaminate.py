import random

import numpy as np
from awkward import ROWS, documents, empty

from turnflow.llm.decontaminate import Items, _aligned, clean, contaminations, normalized

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(t, n):
    out = list(t)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + 1] = ["q"] if kind == 0 else [] if kind == 1 else [out[at], "q"]
    return "".join(out)


def plain(t):
    raw = np.frombuffer((t or "").encode(), np.uint8)
    return normalized(raw, np.array([0, len(raw)]))[0].tobytes()


def distance(item, doc):
    """Edits that turn the item into its best stretch of the document, by the full table."""
    row = np.zeros(len(doc) + 1, np.int64)
    data, j = np.frombuffer(doc, np.uint8), np.arange(len(doc) + 1)
    for r, c in enumerate(item, 1):
        new = np.r_[r, np.minimum(row[:-1] + (data != c), row[1:] + 1)]
        row = np.minimum.accumulate(new - j) + j
    return int(row.min())


ITEMS = [(i, text(rng.randrange(8, 50))) for i in range(25)] + [(90, "short"), (91, None), (None, text(20)), (92, text(20)), (92, text(22))]
DOCS = list(ROWS)
for k, (i, t) in enumerate(ITEMS):
    if t and i != 90:
        DOCS.append((1000 + k, f"{text(30)} {edited(t, k % 5)} {text(40)}"))
        DOCS.append((2000 + k, f"{text(9)}\n{t.upper().replace(' ', ', ')}"))
        DOCS.append((3000 + k, t[: len(t) // 2] + text(20)))
        DOCS.append((4000 + k, edited(t, 30)))
DOCS += [(5000 + i, text(200)) for i in range(40)]


def wanted():
    found = set()
    for i, item in ITEMS:
        own = plain(item).strip()
        if len(own) < 40:
            continue
        allowed = min(int(len(own) * 0.06), (len(own) - 8) // 8)
        for d, t in DOCS:
            edits = distance(own, plain(t)) if len(plain(t)) < 20_000 else allowed + 1
            if edits <= allowed:
                found.add((d, i, edits, len(own)))
    return found


def benchmark(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, edits int")


def test_all_matches_within_the_budget(spark):
    got = {tuple(r) for r in contaminations(documents(spark, DOCS), benchmark(spark)).collect()}
    want = wanted()
    assert got == want and len({d for d, *_ in want}) > 50


def test_clean_keeps_the_other_rows_whole(spark):
    docs = documents(spark, DOCS)
    kept = clean(docs, benchmark(spark))
    hit = {d for d, *_ in wanted()}
    want = sorted(repr(r) for r in docs.collect() if r.doc_id not in hit)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == want


def test_items_in_blocks_find_the_same(spark, monkeypatch):
    docs, items = documents(spark, DOCS[:80]), benchmark(spark)
    whole = sorted(map(repr, contaminations(docs, items).collect()))
    monkeypatch.setattr("turnflow.llm.decontaminate.ITEMS", 700)
    assert sorted(map(repr, contaminations(docs, items).collect())) == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminations(empty(spark), benchmark(spark)).count() == 0
    assert contaminations(documents(spark), none).count() == 0
    assert clean(documents(spark), none).count() == len(ROWS)


def test_alignment_along_a_band_is_the_full_one():
    for _ in range(60):
        item, doc = plain(text(8)), plain(text(12))
        if rng.random() < 0.7:
            doc = plain(text(5) + " ") + plain(edited(item.decode(), rng.randrange(4))) + plain(" " + text(4))
        data = np.frombuffer(doc, np.uint8)
        got = _aligned([np.frombuffer(item, np.uint8)], data, np.array([0]), np.array([len(doc)]),
                       np.array([-len(item)]), np.array([len(doc) + 2 * len(item) + 2]))
        assert got[0] == distance(item, doc)


def test_budget_never_leaves_an_item_without_a_shared_gram():
    items = Items([1, 2], ["abcdefgh" * 6, "x" * 45], rate=0.9, least=40)
    assert (items.must >= 1).all()

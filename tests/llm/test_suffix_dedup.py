import random

import numpy as np
import pyarrow as pa
from awkward import ROWS, documents, empty

from turnflow.llm import suffix_dedup
from turnflow.llm.bwt_merge import Shard, merged_blocks
from turnflow.llm.dictionary import DOCS
from turnflow.llm.suffix_dedup import WINDOW, kept_text, remove_repeats


def brute(rows):
    """(id, kept, spans) per row, by comparing every window."""
    smallest = {}
    key = lambda i: (i is not None, i or 0)
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - WINDOW + 1):
            w = data[k : k + WINDOW]
            smallest[w] = min(smallest.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - WINDOW + 1):
            if smallest[data[k : k + WINDOW]] < key(i):
                gone[k : k + WINDOW] = True
        cuts = np.flatnonzero(np.diff(np.r_[False, gone[:-1], False]))
        out.append((i, bytes(np.frombuffer(data, np.uint8)[~gone[:-1]]), tuple(zip(cuts[::2].tolist(), cuts[1::2].tolist()))))
    return sorted(out, key=repr)


def run(docs):
    return sorted(((r.doc_id, bytes(r.kept), tuple((s.begin, s.end) for s in r.removed))
                   for r in remove_repeats(docs).collect()), key=repr)


def test_awkward_documents(spark):
    assert run(documents(spark)) == brute(ROWS)


def test_texts_of_shared_pieces(spark):
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abé ") for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    rows = [(i // 2, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 9)))) for i in range(90)]
    rows += [(200, "xy" * 300), (201, "xy" * 200), (202, "yx" * 40)]
    assert run(documents(spark, rows)) == brute(rows)


def around_a_phrase():
    """Texts of different surroundings of one phrase, some of them repeated."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    around = [some(40) + "a phrase of many" + some(40) for _ in range(300)]
    return [(i, rng.choice(around) + some(9) + around[i]) for i in range(300)]


def test_windows_of_frequent_phrases_dealt_one_by_one(spark):
    rows = around_a_phrase()
    docs, want = documents(spark, rows), brute(rows)
    assert any(kept != t.encode() for (_, kept, _), (_, t) in zip(want, sorted(rows, key=repr)))
    for many in (0, 3, 20):
        assert sorted(((r.doc_id, bytes(r.kept), tuple((s.begin, s.end) for s in r.removed))
                       for r in remove_repeats(docs, many=many).collect()), key=repr) == want


def test_a_frequent_phrase_makes_no_large_merge(spark, monkeypatch):
    """The steps over one bucket of all hashes, with the sizes of the groups that are merged."""
    docs = documents(spark, around_a_phrase()).select("doc_id", "text").coalesce(1)
    coded = suffix_dedup._chunks(docs, 1).toArrow()
    mine = lambda t, own: t.filter(pa.array([(b == DOCS) == own for b in t.column("bucket").to_pylist()]))
    merged, least = [], []
    monkeypatch.setattr(suffix_dedup, "MERGED", 0)
    monkeypatch.setattr(suffix_dedup, "_merge", lambda members, *_: merged.append(len(members)))
    for many in (10_000, 20):
        answers = suffix_dedup._shared_hashes(many)(mine(coded, False))
        sent = mine(suffix_dedup._sending(1)(coded, answers), False)
        suffix_dedup._least_ids(sent)
        least.append(max(merged, default=0))
        merged.clear()
    assert least[0] > 40 and least[1] <= 20


def test_carried_columns_and_text(spark):
    docs = documents(spark)
    got = kept_text(remove_repeats(docs, carried=("odd name", "n", "score"))).select("doc_id", "text", "`odd name`", "n", "score")
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[7].text == "One plain text." and rows[7]["odd name"] == "o" and rows[7].n == 3 and rows[7].score == "s"


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0


def test_merged_blocks_are_those_of_the_sorted_suffixes():
    rng = random.Random(2)
    for depth in (1, 3, 6):
        shards = [Shard([bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 6))])
                  for _ in range(4)]
        blocks = merged_blocks(shards, depth)
        seen = {}
        for shard, block in zip(shards, blocks, strict=True):
            for string, offset, b in zip(shard.string, shard.offset, block, strict=True):
                # suffixes of at least `depth` characters only; shorter ones end in marks of their own
                if shard.lengths[string] - offset >= depth:
                    seen.setdefault(int(b), set()).add(bytes(_suffix(shard, string, offset)[:depth]))
        assert all(len(x) == 1 for x in seen.values())
        assert len({next(iter(x)) for x in seen.values()}) == len(seen)


def test_merged_blocks_beyond_the_characters_compared_first():
    """Depths around and beyond the key of a shard, empty and short strings, and bytes 0."""
    rng = random.Random(4)
    for depth in (7, 8, 9, 12, 21):
        pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 12))) for _ in range(5)]
        shards = [Shard([b"".join(rng.choice(pieces) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 9))])
                  for _ in range(4)]
        number, suffixes = {}, 0
        for shard, block in zip(shards, merged_blocks(shards, depth), strict=True):
            for string, offset, b in zip(shard.string, shard.offset, block, strict=True):
                # equal to `depth` characters, or whole suffixes that are equal
                number.setdefault(bytes(_suffix(shard, string, offset)[:depth]), set()).add(int(b))
                suffixes += 1
        assert all(len(x) == 1 for x in number.values())
        assert len({min(x) for x in number.values()}) == len(number) < suffixes
        assert [min(number[x]) for x in sorted(number)] == sorted(min(x) for x in number.values())


def test_settled_blocks_are_not_sorted_again(monkeypatch):
    """One string that all shards have among many that differ early: rounds are for the common string."""
    rng = random.Random(6)
    common = bytes(rng.choice(b"abcdefgh ") for _ in range(80))
    shards = [Shard([common, *(bytes(rng.choice(b"abcdefgh ") for _ in range(80)) for _ in range(30))]) for _ in range(4)]
    amount, sorts = [], {name: getattr(np, name) for name in ("sort", "argsort")}
    for name, call in sorts.items():
        monkeypatch.setattr(np, name, lambda a, *x, call=call, **k: amount.append(len(a)) or call(a, *x, **k))
    merged_blocks(shards, WINDOW)
    assert sum(amount) < 4 * sum(len(s.symbols) for s in shards)


def _suffix(shard, string, offset):
    """Characters of a suffix, read off the transform: the suffix one further back begins with its symbol."""
    place = {(int(s), int(o)): k for k, (s, o) in enumerate(zip(shard.string, shard.offset, strict=True))}
    n = int(shard.lengths[string])
    return [int(shard.symbols[place[(int(string), k + 1)]]) for k in range(int(offset), n)]

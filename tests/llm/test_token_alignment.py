import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from awkward import ROWS, documents, empty
from tokenizers import Tokenizer

from turnflow.llm import token_alignment
from turnflow.llm.bpe_words import pieces
from turnflow.llm.token_alignment import ByteFallback, ByteLevel, Remembered, align
from turnflow.llm.words import vocabulary

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def contents():
    with open(B_PATH, "rb") as file:
        return vocabulary(A_PATH), file.read()


def libraries():
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    return (lambda t: a.encode(" " + t, add_special_tokens=False).ids), b.encode


def brute(rows):
    """(id, numbers, groups) per row, from every pair of tokens that overlap."""
    encode_a, encode_b = libraries()
    of_a = pieces(vocabulary(A_PATH))
    of_b = ByteFallback(contents()[1]).pieces
    docs, count = [], Counter()
    for i, t in rows:
        a, b = (encode_a(t), encode_b(t)) if t else ([], [])
        want = b" " + (t or "").encode()
        if b"".join(of_a[x] for x in a) != want or b"".join(of_b[x] for x in b) != want:
            docs.append((i, [], [], [], ""))
            continue
        spans = []
        for ids, table in ((a, of_a), (b, of_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(out)
        links, k = [], 0
        for s, e, x in spans[0]:
            while spans[1][k][1] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][0] < e:
                links.append((x, spans[1][m][2]))
                m += 1
        both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at_ = [], [0, 0]
        for high in both:
            mine = []
            for k, side in enumerate(spans):
                here = at_[k]
                while at_[k] < len(side) and side[at_[k]][1] <= high:
                    at_[k] += 1
                mine.append(",".join(str(x) for _, _, x in side[here : at_[k]]))
            groups.append("|".join(mine))
        count.update(links)
        docs.append((i, a, b, links, ";".join(groups), len(both)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, a, b, links, groups, *both in docs:
        out.append((i, len(a), len(b), both[0] if both else 0, len(links), sum(count[x] == best[x[1]] for x in links),
                    sum(count[x] for x in links), groups))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in align(df, *contents()).collect()), key=repr)


def odd(n=120):
    rng = random.Random(8)
    parts = ["a", " ", "  ", "   ", "\n", "\t", "é", "é", "北京", "　", "\xa0", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "don't", "12345", "😀", ".",
             "\r\n", "\x00", "The", "straße", "ﬁ", "①", "👩‍👩‍👧", "_", "==", "tokenizer"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(n)]


def test_awkward_documents(spark):
    assert run(documents(spark)) == brute(ROWS)


def test_odd_texts(spark):
    rows = odd() + [(500, "a ▁b"), (501, "▁"), (502, " "), (503, "  a")]
    found = run(documents(spark, rows))
    assert found == brute(rows)
    by_id = {r[0]: r for r in found}
    assert by_id[500][1:] == by_id[501][1:] == (0, 0, 0, 0, 0, 0, "")
    assert by_id[502][1] > 0


def test_stretches_encode_as_the_whole_text():
    encode_a, encode_b = libraries()
    texts = [t for _, t in odd(3000) if t]
    for kind, content, encode in ((ByteLevel, contents()[0], encode_a), (ByteFallback, contents()[1], encode_b)):
        side = Remembered(kind(content))
        ids, n = side.encode(texts)
        at = 0
        for t, size in zip(texts, n.tolist()):
            assert ids[at : at + size].tolist() == encode(t), repr(t)
            at += size


def test_texts_encoded_in_one_have_the_ids_of_the_library():
    rng, side, encode = random.Random(3), ByteLevel(contents()[0]), libraries()[0]
    stable = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250), *range(0x391, 0x3CA), *range(0x410, 0x450), *range(0x2010, 0x2028),
                               *range(0x3041, 0x3094), *range(0x30A1, 0x30F7), *range(0x4E00, 0x4E40)]]
    common = [" ", " ", "\n", "'s", "'ll", "e", "t", "1", "é", "\xa0", "...", "ß", "<|endoftext|>"]
    taken = 0
    for k in range(4000):
        text = "".join(rng.choice(stable if k % 2 else common + stable[:100]) for _ in range(rng.randrange(1, 30)))
        ids = side.whole(text)
        taken += ids is not None
        assert ids is None or ids == encode(text), repr(text)
    assert taken > 3000 and side.whole("a" * 501) is None and side.whole(" " * 600) is None and side.whole("😀") is None


def test_ends_joined_in_small_runs(spark, monkeypatch):
    side = [Remembered(kind(c)) for kind, c in zip((ByteLevel, ByteFallback), contents())]
    texts = [t for _, t in odd(200) if t and "▁" not in t] + [ROWS[7][1][:3000]]
    encoded = [token_alignment.lists(*s.encode(texts)) for s in side]
    whole = pa.concat_tables(token_alignment.links(*encoded, side[0].lengths, side[1].lengths))
    for size in (1, 7, 64):
        monkeypatch.setattr(token_alignment, "JOINED", size)
        assert pa.concat_tables(token_alignment.links(*encoded, side[0].lengths, side[1].lengths)).to_pydict() == whole.to_pydict()


def test_remembered_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 5)
    side, encode = Remembered(ByteFallback(contents()[1])), libraries()[1]
    for _, t in odd(40):
        assert side.encode([t])[0].tolist() == encode(t)


def test_empty_table(spark):
    assert run(empty(spark)) == []


def test_only_empty_texts(spark):
    assert run(documents(spark, [(1, None), (2, "")])) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]

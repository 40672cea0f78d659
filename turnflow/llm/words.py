"""Tokenizers run once per distinct word, with results kept per worker process."""

import gc
import os
import re
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def vocabulary(path: str) -> str:
    """Text of a tokenizer file, read once on the driver; workers get it by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


#: Letters of the Latin blocks, in which lower case and composition change no letter into another kind of
#: character, and one full stop or comma behind them at most.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+[.,]?")


def tokenizer_of(vocabulary_: str):
    """The worker's own tokenizer of a vocabulary, without truncation and padding, kept from group to group."""
    if vocabulary_ not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS.clear()
        _TOKENIZERS[vocabulary_] = made = Tokenizer.from_str(vocabulary_)
        made.no_truncation()
        made.no_padding()
    return _TOKENIZERS[vocabulary_]


_TOKENIZERS: dict = {}


# The sign that stands for each byte in byte-level vocabularies; printable bytes stand for themselves.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_HIDDEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words that tell whether a tokenizer does with plain words what `WordIds` does by itself.
PROBES = ["a", "Straße", "Élan.", "ÀÉÎõü,", "ĐĠį", "internationalization", "Xq."]


class _Codes(dict):
    """Numbers of words in the order in which they are first asked for; `new` gathers those."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class WordIds:
    """Ids of the words seen so far, end to end, and where each word's ids begin.

    A word is a stretch between ASCII white space, at which the tokenizers used here always cut and of
    which they keep nothing. When there are over `most`, those seen once only are forgotten, and half of `most` at
    least, which bounds memory.
    """

    def __init__(self, vocabulary_: str, most: int = 500_000):
        self.tokenizer, self.most = tokenizer_of(vocabulary_), most
        vocab = self.tokenizer.get_vocab()
        # tokens that end a piece of a word, if the vocabulary marks these
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.signs = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in ".,"}
        self.direct = self.ends.any() and all(
            self._of_plain(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        self.code, self.seen = _Codes(), np.zeros(0, np.int64)
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the words seen most often, of those seen more than once."""
        often = np.flatnonzero(self.seen > 1)
        kept = np.sort(often[np.argsort(-self.seen[often], kind="stable")[: self.most // 2]])
        words, size = list(self.code), np.diff(self.begin)[kept]
        self.ids, self.begin = self.ids[ranges(self.begin[kept], size)], np.r_[0, np.cumsum(size)]
        self.code, self.seen = _Codes(), self.seen[kept]
        self.code.update(zip([words[i] for i in kept.tolist()], range(len(kept))))

    def _learn(self) -> None:
        """Ids of the new words, in their order."""
        words = [w.decode() for w in self.code.new]
        self.code.new.clear()
        plain = np.fromiter((PLAIN.fullmatch(w) is not None for w in words), bool, len(words)) & self.ends.any()
        ids, sizes = self._learn_together([words[i] for i in np.flatnonzero(plain).tolist()])
        rest = self.tokenizer.encode_batch_fast([words[i] for i in np.flatnonzero(~plain).tolist()], add_special_tokens=False)
        lists = [e.ids for e in rest]
        flat = np.r_[ids, np.fromiter(chain.from_iterable(lists), np.uint32)].astype(np.uint32)
        every = np.empty(len(words), np.int64)
        every[plain], every[~plain] = sizes, np.fromiter(map(len, lists), np.int64, len(lists))
        found = np.empty(len(words), np.int64)  # where each word's ids begin in `flat`
        in_turn = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        found[in_turn] = np.cumsum(every[in_turn]) - every[in_turn]
        self.ids = np.concatenate([self.ids, flat[ranges(found, every)]])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(every)])

    def _learn_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has.

        Such a word is one piece, or two with a sign behind, and every piece closes with an end token. Its merges alone
        cost half as much as the library's whole way, in one call for all words, which costs half as much as one call each.
        """
        if self.direct:
            lists = [*map(self._of_plain, words)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        closes = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum(np.fromiter((2 - w[-1].isalpha() for w in words), np.int64, len(words))) - 1
        return ids, np.diff(closes[last], prepend=0)

    def _of_plain(self, word: str) -> list[int]:
        """Ids of a plain word: lower case, its bytes as signs, merged; then those of the sign behind it."""
        body, sign = (word, []) if word[-1].isalpha() else (word[:-1], self.signs[word[-1]])
        body = body.lower()
        if not body.isascii():
            body = body.encode().decode("latin-1").translate(_HIDDEN)
        return [t.id for t in self.tokenizer.model.tokenize(body)] + sign

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has."""
        collects = gc.isenabled()
        gc.disable()  # the many small lists hold no cycles, and looking for some takes a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.code) > self.most:
            self._forget()
        words = [t.split() for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        if self.code.new:
            self._learn()
        seen = np.bincount(codes, minlength=len(self.code))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        first, size = self.begin[codes], self.begin[codes + 1] - self.begin[codes]
        total = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(n)]]
        return self.ids[ranges(first, size)], np.diff(total)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin[i] to begin[i] + size[i] - 1 for every i, end to end."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))


_KEPT: dict[str, WordIds] = {}


def word_ids(vocabulary_: str) -> WordIds:
    """The worker's own WordIds of a vocabulary, kept from task to task."""
    if vocabulary_ not in _KEPT:
        _KEPT.clear()
        _KEPT[vocabulary_] = WordIds(vocabulary_)
    return _KEPT[vocabulary_]

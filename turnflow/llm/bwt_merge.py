"""Burrows-Wheeler transforms of string collections, merged by iterative interleave refinement.

The transforms of several shards are merged without sorting their suffixes again: an interleave, which
says which suffix of which shard comes next, is refined two characters at a time, by stepping back in the
transforms. Once it orders all suffixes by their first h characters, the blocks of suffixes that agree on
these are known. It begins with the characters that the shards compared first, and a block is looked at
again only if suffixes two characters on have been told apart.
"""

import numpy as np

#: Characters that a shard compares at once, from which an interleave begins.
KEY = 8


class Shard:
    """Strings, each with its end mark 0, and their transform. Bytes 0 in a string are taken as 255."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        flat = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).copy()
        ends = np.cumsum(self.lengths + 1) - 1
        self.string = np.repeat(np.arange(len(strings)), self.lengths + 1)
        begin = ends - self.lengths
        inside = np.ones(len(flat), bool)
        inside[ends] = False
        flat[inside & (flat == 0)] = 255  # no byte of UTF-8
        keys = _keys(flat, ends[self.string])
        order = _suffix_order(keys, ends[self.string])
        before = np.r_[np.uint8(0), flat[:-1]]
        before[begin] = 0
        self.string, self.offset = self.string[order], (order - begin[self.string[order]])
        self.symbols, self.keys = before[order], keys[order]
        # place of the suffix one further back, by the symbols alone; end marks lie first
        self.back = np.zeros(len(order), np.int64)
        self.back[np.argsort(self.symbols, kind="stable")[len(strings) :]] = np.arange(len(strings), len(order))


def _keys(flat: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first KEY characters of every suffix as one number. `end` is the place of each suffix's end mark."""
    n = len(flat)
    padded = np.r_[flat, np.zeros(KEY, np.uint8)]
    first = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    left = np.minimum(end - np.arange(n), KEY).astype(np.uint64)  # what lies behind the end mark does not count
    return first & ~np.where(left >= KEY, np.uint64(0), (~np.uint64(0)) >> (np.minimum(left, np.uint64(7)) * np.uint64(8)))


def _suffix_order(keys: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes in order; equal ones in the order of their strings. `end` is the place of each suffix's end mark."""
    n = len(keys)
    order, first = _sorted_runs(keys, np.arange(n))
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)  # place of the first suffix with the same characters so far
    rank[order] = np.repeat(first, size)
    # places of suffixes that have company; a key that ends in 0 holds an end mark, behind which nothing differs
    live = np.flatnonzero(np.repeat(size > 1, size) & (keys[order] & np.uint64(255) > 0))
    width, longest = KEY, int((end - np.arange(n)).max(initial=0))
    while width < longest + 1 and len(live):
        suffix = order[live]
        ahead = suffix + width
        follow = np.where(ahead <= end[suffix], rank[np.minimum(ahead, n - 1)] + 1, 0)
        suffix, first = _sorted_runs(rank[suffix] * (n + 1) + follow, suffix)
        size = np.diff(np.r_[first, len(live)])
        order[live], rank[suffix] = suffix, np.repeat(live[first], size)
        live = live[np.repeat(size > 1, size)]
        width *= 2
    return order


def _sorted_runs(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names by key, those of one key in order, and where the runs of one key begin."""
    by_key = np.argsort(keys)
    keys = keys[by_key]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.sort(np.cumsum(fresh) << 32 | names[by_key]) & 0xFFFFFFFF, np.flatnonzero(fresh)


def merged_blocks(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard, the number of the block of every suffix, in the shard's order of suffixes.

    Suffixes have the same number if and only if they agree on their first `depth` characters (or are equal).
    A block's number is the place of its first suffix in the interleave.
    """
    sizes = [len(s.symbols) for s in shards]
    n, at = sum(sizes), np.cumsum([0, *sizes])
    back = np.concatenate([s.back + a for s, a in zip(shards, at)])
    back = back[back]
    offset = np.concatenate([s.offset for s in shards])
    inner = np.flatnonzero(offset >= 2)
    ahead = np.zeros(n, np.int64)
    ahead[back[inner]] = inner

    start = depth if depth < KEY else KEY - (depth - KEY) % 2
    keys = np.concatenate([s.keys for s in shards]) >> np.uint64(8 * (KEY - start))
    interleave = np.argsort(keys, kind="stable")
    keys = keys[interleave]
    place = np.empty(n, np.int64)
    place[interleave] = np.arange(n)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    held = np.zeros(n, np.int64)  # suffixes of the block that begins at a place
    held[first] = np.diff(np.r_[first, n])
    block = np.repeat(first, held[first])
    # a key that ends in 0 holds an end mark, behind which nothing differs
    live = np.flatnonzero((held[block] > 1) & (keys & np.uint64(255) > 0))
    for _ in range((depth - start) // 2):
        if not len(live):
            break
        was = block[live]
        then = np.sort(was << 32 | place[ahead[interleave[live]]]) & 0xFFFFFFFF
        follows = block[then]
        first = np.flatnonzero(np.r_[True, (was[1:] != was[:-1]) | (follows[1:] != follows[:-1])])
        size = np.diff(np.r_[first, len(live)])
        now, suffix = np.repeat(live[first], size), back[interleave[then]]
        interleave[live], place[suffix], block[live], held[live[first]] = suffix, live, now, size
        split = suffix[now != was]
        again = np.unique(block[place[back[split[offset[split] >= 2]]]])
        again = again[held[again] > 1]
        size = held[again]
        live = np.repeat(again - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return np.split(block[place], at[1:-1])

"""Range asymmetric numeral system with one static table for all blocks.

A block is coded in interleaved lanes that share one stream of words. At every checkpoint the lanes'
states and the place in the stream are kept, so the parts of a block decode independently and in step.
"""

import struct
from zlib import crc32

import numpy as np

LANES, SCALE, BLOCK, CHECK = 32, 20, 65_536, 512
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
HEAD = struct.Struct("<4sIIIIIII")  # mark, ids, lanes, scale, steps per part, words, crc of ids, crc of the rest


class Table:
    """Frequencies scaled to a sum of 2**SCALE; every id that occurs keeps one at least."""

    def __init__(self, ids: np.ndarray, scaled: np.ndarray):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[ids] = scaled
        self.cum = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def scaled(cls, counts: np.ndarray) -> np.ndarray:
        """Scaled frequencies of positive counts; what rounding leaves over goes to, or comes from, the largest."""
        total = 1 << SCALE
        if len(counts) > total:
            raise ValueError(f"more than {total} distinct ids")
        share = [max(1, int(c) * total // int(counts.sum())) for c in counts]
        out = np.array(share, np.int64)
        rest = total - int(out.sum())
        for i in np.argsort(-out, kind="stable") if len(out) else []:
            if rest == 0:
                break
            change = rest if rest > 0 else -min(-rest, int(out[i]) - 1)
            out[i] += change
            rest -= change
        return out


def encode(table: Table, ids: np.ndarray) -> list[bytes]:
    """Frames of consecutive blocks of BLOCK ids; the last may be shorter."""
    frames, full = [], len(ids) // BLOCK
    if full:
        frames += _encode(table, ids[: full * BLOCK].reshape(full, BLOCK), BLOCK)
    if len(ids) > full * BLOCK:
        rest = ids[full * BLOCK :]
        padded = np.full((1, -(-len(rest) // LANES) * LANES), rest[0], ids.dtype)
        padded[0, : len(rest)] = rest
        frames += _encode(table, padded, len(rest))
    return frames


def _encode(table: Table, blocks: np.ndarray, n: int) -> list[bytes]:
    """`n` ids count in each row; what a row has beyond is not coded."""
    many, steps = len(blocks), blocks.shape[1] // LANES
    cells = blocks.reshape(many, steps, LANES)
    state = np.full((many, LANES), LOW, np.uint64)
    words, sent = np.empty((many, steps, LANES), np.uint32), np.empty((many, steps, LANES), bool)
    parts = -(-steps // CHECK)
    checks = np.empty((many, parts, LANES), np.uint64)
    lane, bits = np.arange(LANES), np.uint64(SCALE)
    for s in range(steps - 1, -1, -1):
        now = cells[:, s]
        freq, cum = table.freq[now], table.cum[now]
        full = state >= freq << np.uint64(63 - SCALE)
        active = lane < n - s * LANES
        full &= active
        words[:, s], sent[:, s] = state, full
        low = np.where(full, state >> np.uint64(32), state)
        high = low // freq
        coded = (high << bits) + (low - high * freq) + cum
        state = np.where(active, coded, state)
        if s % CHECK == 0:
            checks[:, s // CHECK] = state
    frames = []
    for b in range(many):
        per_step = np.r_[0, np.cumsum(sent[b].sum(1))]
        offsets = per_step[np.arange(parts) * CHECK].astype("<u4")
        body = offsets.tobytes() + checks[b].astype("<u8").tobytes() + words[b][sent[b]].astype("<u4").tobytes()
        plain = blocks[b, :n].astype("<u4").tobytes()
        frames.append(HEAD.pack(MAGIC, n, LANES, SCALE, CHECK, int(per_step[-1]), crc32(plain), crc32(body)) + body)
    return frames


def decode(table: Table, frames: list[bytes]) -> list[np.ndarray]:
    """Ids of each frame; all parts of all frames are decoded in step. A damaged frame raises ValueError."""
    heads, states, places, bounds, streams, base = [], [], [], [], [], 0
    for frame in frames:
        mark, n, lanes, scale, check, n_words, plain, rest = HEAD.unpack_from(frame)
        body = memoryview(frame)[HEAD.size :]
        if mark != MAGIC or (lanes, scale, check) != (LANES, SCALE, CHECK) or crc32(body) != rest:
            raise ValueError("damaged block")
        parts = -(-n // (LANES * CHECK))
        offsets = np.frombuffer(body, "<u4", parts).astype(np.int64)
        states.append(np.frombuffer(body, "<u8", parts * LANES, parts * 4).reshape(parts, LANES))
        streams.append(np.frombuffer(body, "<u4", n_words, parts * 4 + parts * LANES * 8))
        places.append(offsets + base)
        bounds.append(np.minimum(n - np.arange(parts) * LANES * CHECK, LANES * CHECK))
        heads.append((n, plain, parts))
        base += n_words
    if not frames:
        return []
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    state, place, left = np.concatenate(states), np.concatenate(places), np.concatenate(bounds)
    out = np.zeros((len(state), CHECK, LANES), np.uint32)
    lane, mask, bits = np.arange(LANES), np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for s in range(CHECK):
        active = lane < (left - s * LANES)[:, None]
        if not active.any():
            break
        slot = state & mask
        symbol = table.symbol[slot.astype(np.int64)]
        next_ = table.freq[symbol] * (state >> bits) + slot - table.cum[symbol]
        fetch = (next_ < LOW) & active
        order = np.cumsum(fetch, axis=1)
        at = np.minimum(place[:, None] + order - 1, len(stream) - 1)
        next_ = np.where(fetch, next_ << np.uint64(32) | stream[np.maximum(at, 0)], next_)
        place = place + order[:, -1]
        out[:, s] = symbol
        state = np.where(active, next_, state)
    found, first = [], 0
    for n, plain, parts in heads:
        ids = out[first : first + parts].reshape(-1)[:n]
        if crc32(ids.astype("<u4").tobytes()) != plain:
            raise ValueError("damaged block")
        found.append(ids)
        first += parts
    return found

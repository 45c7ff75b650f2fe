"""64-bit hashes of byte spans (words, pre-tokens) of a whole batch at once, in numpy.

A span's hash starts from its length and takes in eight bytes a round, each round a
bijection of the state that no linear relation of the bytes survives. So spans of up
to eight bytes of one length never collide, and longer ones do as random values would.
"""

from __future__ import annotations

import numpy as np
import xxhash

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Masks of a span's last bytes, by how many there are.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def padded(raw: bytes) -> np.ndarray:
    """The bytes as an array, with room behind for the last span's whole round."""
    return np.frombuffer(raw + bytes(8), np.uint8)


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each span ``data[start : start + size]`` (``data`` as ``padded`` gives it; no span is empty)."""
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), np.ascontiguousarray(data), 0, (1,))
    state = mix(sizes.astype(np.uint64) * _C2 + np.uint64(seed))
    state = mix(state ^ (eight[starts] & _MASK[np.minimum(sizes, 8)]))
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at, rest = starts[left] + 8, sizes[left] - 8
    while len(left):
        state[left] = mix(state[left] ^ (eight[at] & _MASK[np.minimum(rest, 8)]))
        on = rest > 8
        left, at, rest = left[on], at[on] + 8, rest[on] - 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed)
    return state


class PairIndex:
    """Finds distinct 64-bit keys (not negative) in a sparse table with linear probing; mostly one look for each."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(10, (8 * len(keys)).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.slot[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot[at[put]] = left[put]
            on = np.ones(len(left), bool)
            on[put] = False
            left, at = left[on], (at[on] + 1) & (1 << self.bits) - 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at = self._home(keys)
        got = self.slot[at]
        wrong = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (1 << self.bits) - 1
            got[wrong] = self.slot[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[got[wrong]] != keys[wrong])]
        return got

"""A minimal perfect hash over digests, as levelled bit arrays (numpy).

Level ``i`` hashes the digests that are still unplaced into ``gamma * n`` bits;
a digest alone on its bit is placed there, the others go to the next level. A
digest's slot is the number of set bits before its bit over all levels, so n
digests get the slots 0 .. n-1 exactly. After ``LEVELS`` levels what is left
(next to nothing) is kept as a sorted list. A digest outside the set may hit a
slot as well, so slots hold whole digests, and a lookup compares all bytes.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.5
LEVELS = 40
_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _C1
    x = (x ^ (x >> np.uint64(33))) * _C2
    return x ^ (x >> np.uint64(33))


def _bit(lo: np.ndarray, hi: np.ndarray, level: int, width: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
    return (_mix(lo + seed) ^ _mix(hi ^ seed)) % np.uint64(width)


class PerfectHash:
    """Built from an (n, 32) uint8 array of distinct digests."""

    def __init__(self, widths: list[int], words: np.ndarray, rest: np.ndarray):
        self.widths, self.words, self.rest = widths, words, rest
        self.starts = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.placed = int(self.before[-1])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        lo, hi = halves(digests)
        left, widths, levels = np.arange(len(digests)), [], []
        while len(left) and len(widths) < LEVELS:
            width = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _bit(lo[left], hi[left], len(widths), width).astype(np.int64)
            hits = np.bincount(at, minlength=width)
            levels.append(np.packbits(hits == 1, bitorder="little").view(np.uint64))
            widths.append(width)
            left = left[hits[at] != 1]
        rest = np.stack([lo[left], hi[left]], axis=1)
        rest = rest[np.lexsort((rest[:, 1], rest[:, 0]))]
        return cls(widths, np.concatenate(levels) if levels else np.zeros(0, np.uint64), rest)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Candidate slot of each digest, -1 where there is none."""
        lo, hi = halves(digests)
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, width in enumerate(self.widths):
            if not len(left):
                break
            at = self.starts[level] + _bit(lo[left], hi[left], level, width).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        for i in left if len(self.rest) else ():
            found = np.flatnonzero((self.rest[:, 0] == lo[i]) & (self.rest[:, 1] == hi[i]))
            if len(found):
                out[i] = self.placed + found[0]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.widths), len(self.rest), *self.widths], np.int64)
        return head.tobytes() + self.words.tobytes() + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n, r = np.frombuffer(blob, np.int64, 2)
        widths = np.frombuffer(blob, np.int64, n, 16).tolist()
        at, size = 16 + 8 * int(n), sum(widths) // 64
        return cls(widths, np.frombuffer(blob, np.uint64, size, at), np.frombuffer(blob, np.uint64, 2 * r, at + 8 * size).reshape(-1, 2))


def halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each digest (its bytes 8-24; the first ones choose the shard)."""
    words = np.ascontiguousarray(digests).view("<u8")
    return words[:, 1].copy(), words[:, 2].copy()


def matrix(column) -> np.ndarray:
    """(n, 32) uint8 from an iterable of 32-byte values."""
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32)

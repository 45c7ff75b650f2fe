"""Word shingles as 64-bit hashes, and MinHash signatures of them (numpy).

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. A
shingle's hash mixes its words' hashes with their places. A text with fewer than k
words is one shingle of all its words, which equals no shingle of another length.
"""

from __future__ import annotations

import numpy as np

from lexiloom.llm.hashing import mix, padded, span_hashes

_rng = np.random.Generator(np.random.PCG64(20_111_213))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Translation that lower-cases A-Z.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEED = 0x9E3779B97F4A7C15
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Multiples of a constant, one for each number of words in a shingle.
_TIMES = np.arange(65, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD)


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and how many words each text has."""
    data = padded(b" ".join([b"", *raws, b""]).translate(_LOWER))
    space = _SPACE[data[:-8]]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raws), np.int64)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    text_ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws))) + 1
    upto = np.searchsorted(starts, text_ends, "left")
    return span_hashes(data, starts, ends - starts, _SEED), np.diff(np.concatenate([[0], upto]))


def shingle_sets(raws: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words."""
    words, counts = word_hashes(raws)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled[: max(0, n - j)] += words[j:] * _PLACES[j]
    rolled = mix(rolled + _TIMES[k : k + 1])
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(rolled[at : at + c - k + 1]))
        elif c:
            whole = np.add.reduce(words[at : at + c] * _PLACES[:c], keepdims=True)
            out.append(mix(whole + _TIMES[c : c + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


class MinHasher:
    """``n`` minima of a shingle set under multiply-add permutations of 32 bits."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)

    def __call__(self, shingles: np.ndarray, at_once: int = 4096) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), at_once):
            part = self.a[:, None] * x[None, i : i + at_once]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

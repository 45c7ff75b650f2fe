"""Pre-tokens of the byte-level BPE file, and what its vocabulary says.

A byte-level BPE never merges across pre-tokens, so a text's ids are those of
its pre-tokens one after another, and each distinct pre-token is worked out once.
The splitting pattern is read by the ``regex`` package; where the two libraries'
Unicode tables could disagree the tokenizer's own splitter is asked instead.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex

from lexiloom.llm.hashing import padded, span_hashes

#: Code points of scripts to which Unicode still adds letters; texts with one
#: of them are split by the tokenizer itself.
UNSURE = re.compile("[՘-῿⁰-₟꟎-꯿\U00010000-\U0001efff\U00020000-\U0010ffff]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def specials(path: str) -> dict[str, int]:
    """Special strings and their ids; in texts the library takes them as such by default."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


@lru_cache(maxsize=4)
def _special_pattern(path: str):
    found = sorted(specials(path), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


@lru_cache(maxsize=1)
def _splitter():
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


# The same pattern for texts of Latin letters and common punctuation, with its
# classes written out for Python's faster matcher.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
NARROW = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WIDE = re.compile("[^\x00-\u024f\u2010-\u2027\u20a0-\u20bf]")


def split(text: str, path: str) -> list[str]:
    """Pre-tokens of the text in order; special strings stand whole."""
    pattern = _special_pattern(path)
    parts = pattern.split(text) if pattern and any(s in text for s in specials(path)) else [text]
    out: list[str] = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(part)
        elif not WIDE.search(part):
            out.extend(NARROW.findall(part))
        elif UNSURE.search(part):
            spans = tokenizer(path).pre_tokenizer.pre_tokenize_str(part)
            out.extend(part[a:b] for _, (a, b) in spans)
        else:
            out.extend(_splitter().findall(part))
    return out


#: Characters of the pre-tokens or words that a table holds at most between batches.
MOST_CHARS = 16_000_000


class PretokenTable:
    """Numbers distinct pre-tokens; emptied once it holds ``most`` of them or ``MOST_CHARS`` characters, so memory is bounded."""

    def __init__(self, most: int = 600_000):
        self.most, self.held, self.index = most, 0, defaultdict()
        self.index.default_factory = self.index.__len__

    def number(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str], bool]:
        """All pre-tokens' numbers, how many each text has, the new ones in order, and whether numbering began anew."""
        if len(self.index) > self.most or self.held > MOST_CHARS:
            self.index.clear()
            self.held = 0
        before = len(self.index)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        new = list(islice(self.index, before, None))
        self.held += sum(map(len, new))
        return flat, lengths, new, before == 0


# ---- the same over whole batches, without a Python object for each pre-token

_KINDS = np.zeros(0x250, np.uint8)  # of code points below U+0250: 0 other, 1 letter, 2 number, 3 space
for _kind, _class in ((1, _L), (2, _N), (3, _S)):
    for _c in range(0x250):
        if re.match(f"[{_class}]", chr(_c)):
            _KINDS[_c] = _kind
_WIDE_AT_ALL = re.compile("[^\x00-\u024f]")
_ENDS_1, _ENDS_2 = "stmd", ("re", "ve", "ll")


def starts_of(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts of code points below U+0250, one after another.

    A run of one kind (letters, numbers, other) is a pre-token, with one blank before
    it if there is one; of a run of spaces before something else, the last one stands
    apart; an apostrophe that begins a pre-token takes its contraction's letters.
    """
    n = len(codes)
    kind = _KINDS[codes]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    begins, last_in_text = first[:n], first[1:]
    before = np.concatenate([[0], kind[:-1]])
    start = begins | (kind != before)
    space = kind == 3
    follows = np.concatenate([kind[1:] != 3, [False]]) & ~last_in_text
    start |= space & follows
    blank = np.concatenate([[False], codes[:-1] == 32]) & ~begins
    start &= ~(blank & ~space)
    # contractions
    at = np.flatnonzero((codes == 39) & start & ~last_in_text)
    if len(at):
        one = np.isin(codes[at + 1], [ord(c) for c in _ENDS_1])
        size = one.astype(np.int64)
        room = at[(~one) & (at + 2 < n)]
        room = room[~first[room + 2]]
        two = np.zeros(len(at), bool)
        for pair in _ENDS_2:
            two |= np.isin(at, room[(codes[room + 1] == ord(pair[0])) & (codes[room + 2] == ord(pair[1]))])
        size[two] = 2
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        behind = at + 1 + size
        ok = (behind < n) & ~first[np.minimum(behind, n)]
        start[behind[ok][kind[behind[ok]] == 1]] = True
    return start


class Slots:
    """Open-addressing table of 64-bit keys with a 64-bit check each, in numpy; values are entry numbers."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key, self.check, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry number of each key, -1 if it is new."""
        mask = np.uint64((1 << self.bits) - 1)
        out = np.full(len(key), -1, np.int64)
        left, at = np.arange(len(key)), (key & mask).astype(np.int64)
        while len(left):
            k = self.key[at]
            hit = (k == key[left]) & (self.check[at] == check[left])
            out[left[hit]] = self.value[at[hit]]
            on = ~hit & (k != 0)
            left, at = left[on], (at[on] + 1) & int(mask)
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Put in new, distinct keys; they get the next entry numbers in order."""
        number = np.arange(self.n, self.n + len(key), dtype=np.int32)
        if 2 * (self.n + len(key)) > 1 << self.bits:
            held = np.flatnonzero(self.key)
            key, check, number = (np.concatenate([a[held], b]) for a, b in ((self.key, key), (self.check, check), (self.value, number)))
            while 2 * len(key) > 1 << self.bits:
                self.bits += 1
            self.key, self.check, self.value = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n = int(number.max(initial=self.n - 1)) + 1
        mask = (1 << self.bits) - 1
        left, at = np.arange(len(key)), (key & np.uint64(mask)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.key[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.check[at[put]], self.value[at[put]] = key[left[put]], check[left[put]], number[left[put]]
            on = np.ones(len(left), bool)
            on[put] = False
            left, at = left[on], (at[on] + 1) & mask


#: Seeds of a piece's key and of its check.
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class BatchTable:
    """Numbers the distinct pieces that texts are cut into, by a 128-bit hash; emptied once it holds ``most`` or ``MOST_CHARS`` characters.

    ``cut`` says where pieces begin: (texts, code points, text sizes, text ends) -> booleans.
    """

    def __init__(self, cut, most: int):
        self.cut, self.most, self.held, self.slots = cut, most, 0, Slots()

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], bool]:
        """As ``PretokenTable.number``, from the texts themselves."""
        anew = self.slots.n == 0
        if self.slots.n > self.most or self.held > MOST_CHARS:
            self.slots, self.held, anew = Slots(), 0, True
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(whole):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), [], anew
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        at = np.flatnonzero(self.cut(texts, codes, sizes, ends))
        length = np.diff(np.append(at, len(codes)))
        key, check = self._hashes(whole, codes, at, length)
        number = self.slots.find(key, check)
        miss = np.flatnonzero(number < 0)
        new: list[str] = []
        if len(miss):
            _, one, back = np.unique(key[miss], return_index=True, return_inverse=True)
            one = miss[one]
            begin = self.slots.n
            self.slots.add(key[one], check[one])
            number[miss] = begin + back
            new = [whole[a : a + n] for a, n in zip(at[one].tolist(), length[one].tolist())]
            self.held += int(length[one].sum())
        return number, np.diff(np.concatenate([[0], np.searchsorted(at, ends)])), new, anew

    @staticmethod
    def _hashes(whole: str, codes: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = whole.encode("utf-8", "surrogatepass")
        if len(raw) > len(codes):  # from code points to bytes
            ends = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
            first = np.concatenate([[0], ends])[at]
            length, at = ends[at + length - 1] - first, first
        data = padded(raw)
        return span_hashes(data, at, length, _SEEDS[0]) | np.uint64(1), span_hashes(data, at, length, _SEEDS[1])


def pretoken_cut(path: str):
    """The cut of a tokenizer file's pre-tokens."""

    def cut(texts: list[str], codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        held = specials(path)
        odd = [i for i, t in enumerate(texts) if t and (_WIDE_AT_ALL.search(t) or any(s in t for s in held))]
        start = starts_of(codes if not odd else np.where(codes < 0x250, codes, 0), (ends - sizes)[sizes > 0])
        for i in odd:  # texts that need the library's own rules
            a = ends[i] - sizes[i]
            start[a : ends[i]] = False
            start[a + np.cumsum([0, *map(len, split(texts[i], path))][:-1])] = True
        return start

    return cut

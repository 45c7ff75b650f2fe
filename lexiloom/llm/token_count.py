"""Operator 6: token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of
symbol ids (initially bytes). In each round every sequence finds the lowest rank
among its adjacent pairs and applies that pair at all its places from left to
right, all sequences at once; sequences without a mergeable pair are done. A very
long pre-token is merged rank by rank in the same way, with its places queued by
rank, so that time does not grow with the square of its length. What is counted
are the symbols that survive. The ranks come from the merges of the
vocabulary file; the tokenizer library itself is not asked.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings
inside a text are one token; repeated rows give repeated results; an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.common import map_batches, spread, table
from lexiloom.llm.hashing import PairIndex
from lexiloom.llm.pretokens import PretokenTable, specials, split

LIMIT = 512
#: Symbols that one round of merging holds.
SYMBOLS_AT_ONCE = 1_000_000
#: Pre-tokens of more bytes are merged one by one, through a queue of ranks.
LONG = 2048


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Pairs of symbols by 64-bit key, with rank and result (symbols: 0-255 bytes, then merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        ids = dict(_byte_letters())
        pairs = np.empty(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            pairs[rank] = ids[a] << 32 | ids[b]
            ids.setdefault(a + b, 256 + rank)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.index = PairIndex(pairs)
        self.none = len(merges)
        # bytes meet bytes most often: a direct table for them
        self.bytes_rank = np.full(65536, self.none, np.int64)
        both = (pairs >> 32 < 256) & ((pairs & 0xFFFFFFFF) < 256)
        self.bytes_rank[(pairs[both] >> 32) * 256 + (pairs[both] & 0xFF)] = np.flatnonzero(both)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self.index.find(left << 32 | right)
        return np.where(at >= 0, at, self.none)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def _leftmost(hit: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Of overlapping hits (runs of adjacent ones, as in aaa) take every second from the left."""
    if not (hit[1:] & hit[:-1] & same[1:]).any():
        return hit
    at = np.arange(len(hit))
    begins = hit & ~np.concatenate([[False], hit[:-1] & same[1:]])
    start = np.maximum.accumulate(np.where(begins, at, 0))
    return hit & ((at - start) % 2 == 0)


def merge_batch(data: np.ndarray, lengths: np.ndarray, table: Merges) -> np.ndarray:
    """Surviving symbols of each sequence; ``data`` holds the sequences' bytes one after another.

    Ranks are looked up once at first and then only beside the pairs just merged.
    """
    counts = lengths.astype(np.int64)
    keep = np.repeat(lengths > 1, lengths)
    seq, sym = np.repeat(np.arange(len(lengths)), lengths)[keep], data[keep].astype(np.int64)
    rank = np.full(len(sym), table.none, np.int64)
    at = np.flatnonzero(seq[1:] == seq[:-1])
    rank[at] = table.bytes_rank[sym[at] * 256 + sym[at + 1]]
    while len(sym):
        same = np.concatenate([[False], seq[1:] == seq[:-1]])
        starts = np.flatnonzero(~same)
        best = np.minimum.reduceat(rank, starts)
        going = np.repeat(best < table.none, np.diff(np.append(starts, len(sym))))
        hit = _leftmost((rank == np.repeat(best, np.diff(np.append(starts, len(sym))))) & going, same)
        at = np.flatnonzero(hit)
        owner, n = np.unique(seq[at], return_counts=True)
        counts[owner] -= n
        sym[at] = table.made[rank[at]]
        going[at + 1] = False
        at = (np.cumsum(going) - 1)[at]
        sym, seq, rank = sym[going], seq[going], rank[going]
        for pair in (at, at[at > 0] - 1):
            inner = (pair + 1 < len(sym)) & (seq[np.minimum(pair + 1, len(sym) - 1)] == seq[pair])
            rank[pair[~inner]] = table.none
            pair = pair[inner]
            rank[pair] = table.ranks(sym[pair], sym[pair + 1])
    return counts


def merge_long(data: np.ndarray, table: Merges) -> int:
    """Surviving symbols of one long sequence: the places of each rank wait in a queue, the lowest rank's are merged together.

    Symbols are linked to their neighbours, so a round costs what it merges and not the sequence's length.
    """
    n = len(data)
    sym, after, before = data.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n + 1, table.none, np.int64)  # the last entry stands for no place
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def queue(places: np.ndarray) -> None:
        order = np.argsort(rank[places], kind="stable")
        places = places[order]
        values = rank[places]
        cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            r = int(values[a])
            if r < table.none:
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places[a:b])

    at = np.arange(n - 1)
    rank[at] = table.bytes_rank[sym[at] * 256 + sym[at + 1]]
    queue(at)
    left = n
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        at = at[_leftmost(np.ones(len(at), bool), np.concatenate([[False], after[at[:-1]] == at[1:]]))]
        gone = after[at]
        sym[at] = table.made[r]
        rank[gone] = table.none
        after[at] = after[gone]
        inner = after[at] < n
        before[after[at][inner]] = at[inner]
        left -= len(at)
        rank[at] = table.none
        rank[at[inner]] = table.ranks(sym[at[inner]], sym[after[at[inner]]])
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        rank[ahead] = table.ranks(sym[ahead], sym[after[ahead]])
        queue(np.concatenate([at, ahead]))
    return left


def count_pretokens(words: list[str], path: str) -> np.ndarray:
    """Tokens of each pre-token; special strings are one."""
    raw = [w.encode("utf-8") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.ones(len(raw), np.int64)
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = merge_long(np.frombuffer(raw[i], np.uint8), merges(path))
    short = np.flatnonzero(lengths <= LONG)
    ends = np.cumsum(lengths[short])
    begin = 0
    while begin < len(short):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + SYMBOLS_AT_ONCE, "right")))
        part = short[begin:end]
        out[part] = merge_batch(np.frombuffer(b"".join(map(raw.__getitem__, part.tolist())), np.uint8), lengths[part], merges(path))
        begin = end
    held = specials(path)
    for i, w in enumerate(words):
        if w in held:
            out[i] = 1
    return out


class Counter:
    """Counts per text, with the counts of distinct pre-tokens kept between batches."""

    def __init__(self, path: str):
        self.path, self.table, self.counts = path, PretokenTable(400_000), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        flat, lengths, new, anew = self.table.number([split(t, self.path) for t in texts])
        if anew:
            self.counts = np.zeros(0, np.int64)
        if new:
            self.counts = np.concatenate([self.counts, count_pretokens(new, self.path)])
        total = np.concatenate([[0], np.cumsum(self.counts[flat])])
        ends = np.cumsum(lengths)
        return total[ends] - total[ends - lengths]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""

    def body(cols):
        texts = [t or "" for t in cols["text"].to_pylist()]
        n = counter(path)(texts)
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return map_batches(rows, body, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")), default_path())

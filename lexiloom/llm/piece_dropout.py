"""Operator 8: SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Texts are cut into words where no piece of the model can cross (spaces stand before
a word, and Latin letters end at other characters where the vocabulary says so), and each word is segmented by an
agenda of candidate merges: the best-scored pair, the leftmost on ties, is taken
out; a keyed hash of (seed, document, word's place in it, word, place, merged piece)
decides whether it is skipped for good or applied, which puts the new neighbours'
pairs on the agenda. So each occurrence of a word is drawn on its own, and reruns
agree. What is kept of a word is its run without dropout: the pieces and the merges
made. An occurrence none of whose merges is skipped gets these pieces, the others
run through the agenda anew: short words together in numpy, long ones on a heap.

Characters without a piece become byte pieces, and so does a literal U+2581
(which the library would turn into a space); so decoding gives back every text
exactly. With ``dropout=0`` the ids are the library's own.

Defined results: null or empty text has no pieces and decodes to an empty string;
a null doc_id counts as 0 in the hash; repeated rows give equal results; an empty
table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lexiloom.llm.common import map_batches, spread, table
from lexiloom.llm.hashing import PairIndex
from lexiloom.llm.pretokens import BatchTable

DROPOUT = 0.1
SEED = 20_240_601
#: Distinct words whose segmentations are kept between batches.
MOST_WORDS = 300_000
#: Texts segmented at once; their arrays are what a worker's memory goes to.
AT_ONCE = 200
#: Words of more characters than this use the heap.
LONG = 48
#: Kinds of code points below U+0250: 0 other, 1 Latin letter, 2 space.
_L = "A-Za-zÀ-ÖØ-öø-\u024f"
_KIND = np.array([2 if c == 32 else 1 if re.match(f"[{_L}]", chr(c)) else 0 for c in range(0x250)], np.uint8)
MIXED = re.compile(f"[{_L}][^{_L}]|[^ {_L}][{_L}]")


def word_cut(fine: bool):
    """Words: a run of anything but spaces with the spaces before it, or spaces at a text's end.

    ``fine``: Latin letters and other characters are words of their own, for models
    none of whose pieces joins a letter to anything but letters and spaces before them.
    """

    def cut(texts: list[str], codes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        kind = _KIND[np.minimum(codes, 0x24F)]
        kind[codes >= 0x250] = 0
        if not fine:
            kind[kind == 1] = 0
        start = np.ones(len(codes), bool)
        start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
        start[(ends - sizes)[sizes > 0]] = True
        return start

    return cut


_M = 0xFFFFFFFFFFFFFFFF
_C1, _C2, _C3 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15
NEVER = np.int32((1 << 31) - 1)
#: No candidate, in an agenda of ranks and places.
NEVER_AGAIN = np.int64((1 << 63) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_C1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(_C2)
    return x ^ (x >> np.uint64(33))


class Pieces:
    """A BPE model's pieces: merges by pair of ids, characters and bytes. Spaces stand for U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = {i: sp.id_to_piece(i).replace("▁", " ") for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        ids = {p: i for i, p in plain.items()}
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.char = np.full(0x110000, -1, np.int64)
        pairs = []
        for i, p in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
            pairs += [(ids[p[:k]] << 32 | ids[p[k:]], i, rank[i]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.fine = not any(map(MIXED.search, ids))
        pairs.sort()
        self.keys, self.made, self.rank = (np.array(c, kind) for c, kind in zip(zip(*pairs), (np.int64, np.int32, np.int32)))
        self.index = PairIndex(self.keys)
        self.byte = np.zeros(256, np.int64)
        self.bytes_of = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte[b], self.bytes_of[i] = i, bytes([b])
            elif i in plain:
                self.bytes_of[i] = plain[i].encode("utf-8")
        self.merge = {int(k): (int(r), int(m)) for k, m, r in zip(self.keys, self.made, self.rank)}

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair of symbols; rank NEVER where they do not merge."""
        at = self.index.find(np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 32 | right))
        return np.where(at >= 0, self.rank[at], NEVER), self.made[at]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _salt(place: np.ndarray, made: np.ndarray) -> np.ndarray:
    """What of a candidate merge goes into its hash."""
    with np.errstate(over="ignore"):
        return place.astype(np.uint64) * np.uint64(_C3) + made.astype(np.uint64) * np.uint64(_C2)


def _below(key: np.ndarray, salt: np.ndarray, bound: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(key ^ salt) >> np.uint64(11)) < np.uint64(bound)


def _skipped(key, place, made, bound) -> np.ndarray:
    """The keyed hash of a candidate merge, against the dropout probability."""
    return _below(key, _salt(place, made), bound)


def _skips(key: int, place: int, made: int, bound: int) -> bool:
    """``_skipped`` of one candidate."""
    x = key ^ (place * _C3 + made * _C2 & _M)
    x = (x ^ x >> 33) * _C1 & _M
    x = (x ^ x >> 33) * _C2 & _M
    return (x ^ x >> 33) >> 11 < bound


def segment_heap(symbols: list[int], key: int, bound: int, model: Pieces, merges: list | None = None) -> list[int]:
    """One word, on a heap of (rank, place); ``symbols`` are its characters' piece ids.

    ``merges`` takes the (place, piece) of each merge that is made.
    """
    n = len(symbols)
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def add(a: int, b: int) -> None:
        if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0 and (got := model.merge.get(sym[a] << 32 | sym[b])):
            heapq.heappush(agenda, (got[0], a, b, got[1], sym[a] << 32 | sym[b]))

    for i in range(n - 1):
        add(i, i + 1)
    dead = [False] * n
    while agenda:
        _, a, b, made, was = heapq.heappop(agenda)
        if dead[a] or dead[b] or after[a] != b or sym[a] << 32 | sym[b] != was:
            continue
        if bound and _skips(key, a, made, bound):
            continue
        if merges is not None:
            merges.append((a, made))
        sym[a], dead[b], after[a] = made, True, after[b]
        if after[a] < n:
            before[after[a]] = a
        add(before[a], a)
        add(a, after[a])
    return [s for s, d in zip(sym, dead) if not d]


def segment_batch(sym: np.ndarray, length: np.ndarray, key: np.ndarray, bound: int, model: Pieces, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Many short words at once: each round takes the first candidate off every word's agenda.

    Returns the surviving symbols, word after word, and how many each word has (none is empty).
    ``merges`` takes arrays of the (word, place, piece) of the merges made, one a round.

    Symbols stay in their places and are linked to their neighbours; an agenda is its word's part of
    ``agenda``, where rank and place are one number. Place n, behind the last word, is nobody's.
    """
    n = len(sym)
    if not n:
        return sym, np.zeros(len(length), np.int64)
    starts = np.cumsum(length) - length
    sym = np.append(sym, -1).astype(np.int32)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[starts + length - 1], before[starts] = n, n
    agenda, made, dead = np.full(n + 1, NEVER_AGAIN), np.zeros(n + 1, np.int32), np.zeros(n, bool)

    def put(left: np.ndarray, right: np.ndarray) -> None:
        rank, made[left] = model.look(sym[left], sym[right])
        agenda[left] = np.where(rank == NEVER, NEVER_AGAIN, rank.astype(np.int64) << 32 | left)

    put(np.arange(n), after[:n])
    begin, word = starts, np.arange(len(length))
    while len(word):
        first = np.minimum.reduceat(agenda[:n], begin)
        live = first != NEVER_AGAIN
        if not live.all():  # what is left of a finished word's agenda holds nothing, so it may fall to the word before
            first, begin, word = first[live], begin[live], word[live]
        at = first & 0xFFFFFFFF
        if bound:
            out = _skipped(key[word], at - begin, made[at], bound)
            agenda[at[out]] = NEVER_AGAIN
            at = at[~out]
            if merges is not None:
                merges.append((word[~out], at - begin[~out], made[at]))
        elif merges is not None:
            merges.append((word, at - begin, made[at]))
        gone = after[at]
        sym[at] = made[at]
        agenda[gone], dead[gone] = NEVER_AGAIN, True
        after[at] = after[gone]
        before[after[at]] = at
        put(at, after[at])
        put(before[at], at)
    return sym[:n][~dead], np.add.reduceat(~dead, starts, dtype=np.int64)


class Rows:
    """Rows of numbers one after another in an array that doubles as it fills."""

    def __init__(self, kind):
        self.flat, self.begin, self.size, self.n = np.zeros(1024, kind), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        if self.n + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n], np.zeros(max(self.n, len(flat)) + len(flat), self.flat.dtype)])
        self.flat[self.n : self.n + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.n + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.n += len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' numbers one after another, and each row's size."""
        size = self.size[rows]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[rows] - (ends - size), size) + np.arange(int(size.sum()))], size


class Segmenter:
    """Ids of texts; of each word met so far its symbols, its pieces without dropout and their merges are kept.

    ``variants`` holds the segmentations of a word to so many; without it each occurrence is drawn on its own.
    """

    def __init__(self, path: str, dropout: float, seed: int, variants: int | None = None):
        if not 0 <= dropout < 1 or variants is not None and variants < 1:
            raise ValueError("dropout is in [0, 1), variants at least 1")
        self.model, self.seed = pieces(path), seed
        self.bound, self.variants = int(dropout * (1 << 53)), variants
        self.table = BatchTable(word_cut(self.model.fine), MOST_WORDS)
        self._empty()

    def _empty(self):
        self.hashes = np.zeros(0, np.uint64)
        self.symbols, self.plain, self.salts = Rows(np.int32), Rows(np.int32), Rows(np.uint64)

    def _hashes(self, words: list[str]) -> np.ndarray:
        seed = self.seed & _M
        return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in words), np.uint64, len(words))

    def _learn(self, words: list[str]) -> None:
        """Keep new words and their runs without dropout."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.model.char[points]
        sym = np.where(sym < 0, -1 - points, sym)
        merges: list[tuple] = []
        self.plain.add(*self._segment(sym, lengths, np.zeros(len(words), np.uint64), 0, merges))
        self.hashes = np.concatenate([self.hashes, self._hashes(words)])
        self.symbols.add(sym, lengths)
        owner, place, made = (np.concatenate(x) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 3
        order = np.argsort(owner, kind="stable")
        self.salts.add(_salt(place, made)[order], np.bincount(owner, minlength=len(words)))

    def _segment(self, sym: np.ndarray, lengths: np.ndarray, keys: np.ndarray, bound: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``lengths`` symbols, one after another, and each word's number of ids."""
        starts = np.cumsum(lengths) - lengths
        long = lengths > LONG
        number = np.flatnonzero(~long)
        got, sizes = segment_batch(sym[np.repeat(~long, lengths)], lengths[~long], keys[~long], bound, self.model, merges)
        if merges:
            merges[:] = [(number[owner], place, made) for owner, place, made in merges]
        if not long.any():
            return self._bytes(got, sizes)
        all_sizes = np.zeros(len(lengths), np.int64)
        all_sizes[~long] = sizes
        heaps = {}
        for i in np.flatnonzero(long).tolist():
            made: list | None = None if merges is None else []
            heaps[i] = segment_heap(sym[starts[i] : starts[i] + lengths[i]].tolist(), int(keys[i]), bound, self.model, made)
            all_sizes[i] = len(heaps[i])
            if made:
                merges.append((np.full(len(made), i), *np.array(made, np.int64).T))
        flat = np.empty(int(all_sizes.sum()), np.int64)
        flat[np.repeat(~long, all_sizes)] = got
        ends = np.cumsum(all_sizes)
        for i, s in heaps.items():
            flat[ends[i] - len(s) : ends[i]] = s
        return self._bytes(flat, all_sizes)

    def _bytes(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece (negative symbols) by their byte pieces."""
        odd = np.flatnonzero(flat < 0)
        if not len(odd):
            return flat, sizes
        raw = [chr(-1 - s).encode("utf-8", "surrogatepass") for s in flat[odd].tolist()]
        times = np.ones(len(flat), np.int64)
        times[odd] = list(map(len, raw))
        out = np.repeat(flat, times)
        out[np.repeat(flat < 0, times)] = self.model.byte[np.frombuffer(b"".join(raw), np.uint8)]
        total = np.concatenate([[0], np.cumsum(times)])
        ends = np.cumsum(sizes)
        return out, total[ends] - total[ends - sizes]

    def _keys(self, flat: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A key of each occurrence: of its document, its place there and its word."""
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        with np.errstate(over="ignore"):
            turn = _mix(np.repeat(_mix(keys.astype(np.uint64) + np.uint64(self.seed & _M)), lengths) + nth.astype(np.uint64) * np.uint64(_C3))
            if self.variants:
                turn %= np.uint64(self.variants)
            return _mix(self.hashes[flat] + turn * np.uint64(_C3))

    def __call__(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids."""
        flat, lengths, new, anew = self.table.number([" " + t if t else "" for t in texts])
        if anew:
            self._empty()
        if new:
            self._learn(new)
        if self.bound:
            key = self._keys(flat, lengths, keys)
            salts, merges = self.salts.take(flat)
            skipped = np.concatenate([[0], np.cumsum(_below(np.repeat(key, merges), salts, self.bound))])
            last = np.cumsum(merges)
            varied = skipped[last] > skipped[last - merges]
        else:
            varied = np.zeros(len(flat), bool)
        size = self.plain.size[flat]
        if varied.any():
            sym, lens = self.symbols.take(flat[varied])
            drawn, size[varied] = self._segment(sym.astype(np.int64), lens, key[varied], self.bound)
            ids = np.empty(int(size.sum()), np.int32)
            where = np.repeat(varied, size)
            ids[where] = drawn
            ids[~where] = self.plain.take(flat[~varied])[0]
        else:
            ids = self.plain.take(flat)[0]
        total = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(lengths)
        return ids, total[last] - total[last - lengths]


@lru_cache(maxsize=2)
def segmenter(path: str, dropout: float, seed: int, variants: int | None) -> Segmenter:
    return Segmenter(path, dropout, seed, variants)


def decode_ids(ids: list[int], path: str) -> str:
    """The text of some ids; the space that encoding puts in front goes."""
    raw = b"".join(map(pieces(path).bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, path: str, *, dropout: float = DROPOUT, seed: int = SEED, variants: int | None = None) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), ids."""

    def body(cols):
        keys = np.array([(d or 0) & _M for d in cols["doc_id"].to_pylist()], np.uint64)
        texts, work = [t or "" for t in cols["text"].to_pylist()], segmenter(path, dropout, seed, variants)
        parts = [work(texts[i : i + AT_ONCE], keys[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        ids = ids.astype("<i4")
        ends = np.cumsum(sizes)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return {"doc_id": cols["doc_id"], "n_pieces": pa.array(sizes), "ids_crc32": crc, "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))}

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return map_batches(rows, body, "doc_id long, n_pieces long, ids_crc32 long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32, text (a null list of ids: null text)."""

    def body(cols):
        texts = [None if ids is None else decode_ids(ids, path) for ids in cols["ids"].to_pylist()]
        return {n: cols[n] for n in ("doc_id", "n_pieces", "ids_crc32")} | {"text": texts}

    return map_batches(encoded.select("doc_id", "n_pieces", "ids_crc32", "ids"), body, "doc_id long, n_pieces long, ids_crc32 long, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32, n_chars, text_sha256 of the decoded text."""
    return decoded.selectExpr("doc_id", "n_pieces", "ids_crc32", "CAST(length(text) AS BIGINT) AS n_chars", "sha2(text, 256) AS text_sha256")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    path = default_path()
    return digests(decode(encode(spread(table(spark, sf_dir, "documents")), path), path))

"""Operator 2: MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of word shingles; equal sets are one *node* from
   here on, so copies never multiply. A node has ``bands`` band keys (MinHash
   minima of ``rows`` permutations each) and a signature of ``SIGNATURE`` further
   minima, one byte of each.
2. Nodes that share a band key are candidates. Signatures are compared in batches
   of ``STEP``; with a uniform prior the matches give a Beta posterior of the
   similarity, and a pair is dropped as soon as the probability that it reaches the
   threshold is under ``miss``. Buckets see the first ``HEAD`` minima only; the
   others, and the full sets, are fetched for what survives them.
3. Survivors are verified on their full sets.

Buckets are never expanded into all pairs of rows. First, a bucket is dealt into
blocks of ``BLOCK`` nodes (each with the bucket's first node), in which every node
offers its best surviving partner; the best one over all bands is verified, and the
links found give components. What is left are buckets that hold several
components: there, nodes outside the bucket's largest component meet all its nodes,
block by block. A block says which of its nodes have survivors in other components;
these get their signatures and sets once for the block, in which all surviving pairs
across components are verified and only links between components come out. So no
candidate is lost, no pair within a component is looked at again, and no pair that
does not link becomes a row. A hot band's nodes are dealt over several tasks.

The number of bands and rows follows from the threshold and ``MISS_BANDS``, the
probability that a pair at the threshold shares no band. Sets hold 64-bit hashes of
shingles, equal for different ones with a probability of 2**-64.

Defined results: null text counts as empty; texts without words have an empty set,
link with nothing and are kept; a component's id is its smallest non-null doc_id
(null when it has none); rows that repeat the winning doc_id are all ``kept``
(``one_of_each`` keeps one of them); an empty table gives no rows; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, keep_rows, map_batches, materialize, python_batches, release, row_id, shuffle_width, spread, spread_join, table
from lexiloom.llm.components import components
from lexiloom.llm.hashing import mix
from lexiloom.llm.shingles import MinHasher, shingle_sets

MISS_BANDS = 1e-6
MISS = 1e-5
SIGNATURE = 512
STEP = 64
#: Minima that travel to a node's buckets.
HEAD = 128
BANDED = 128
BLOCK = 256
ALL_BLOCK = 512
#: Shingles of the surviving pairs that one block verifies at once, about.
SHINGLES_AT_ONCE = 4_000_000
#: Surviving pairs verified before the links found are heeded.
PAIRS_AT_ONCE = 4096
#: Odd multipliers of a band's minima and of its number.
_ROWS = np.random.Generator(np.random.PCG64(31)).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.uint64(0xC4CEB9FE1A85EC53)


def banding(percent: int, most: int = BANDED, miss: float = MISS_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest rows with which a pair at the threshold is missed no oftener than ``miss``."""
    s = percent / 100
    for rows in range(12, 1, -1):
        bands = most // rows
        if (1 - s**rows) ** bands <= miss:
            return bands, rows
    return most, 1


@lru_cache(maxsize=4)
def hashers(bands: int, rows: int) -> tuple[MinHasher, MinHasher]:
    return MinHasher(bands * rows, 11), MinHasher(SIGNATURE, 23)


@lru_cache(maxsize=8)
def fewest_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """Matches needed after each batch: with fewer, P(similarity >= threshold) < miss."""
    s = percent / 100
    c = (np.arange(20_000) + 0.5) / 20_000  # probability of a match; by chance one byte in 256 agrees
    above = c >= s + (1 - s) / 256
    out = []
    for n in range(STEP, SIGNATURE + 1, STEP):
        low, high = 0, n
        while low < high:
            m = (low + high) // 2
            log = m * np.log(c) + (n - m) * np.log1p(-c)
            p = np.exp(log - log.max())
            low, high = (m + 1, high) if p[above].sum() / p.sum() < miss else (low, m)
        out.append(low)
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], allowed: np.ndarray, percent: int):
    """(i, j, matches) of allowed pairs whose posterior never fell under the bound.

    ``left`` and ``right`` are signatures or their first batches; sizes bound the similarity
    by smaller / larger set before any signature is looked at.
    """
    a, b = sizes[0][:, None], sizes[1][None]
    i, j = np.nonzero(allowed & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)))
    matches = np.zeros(len(i), np.int64)
    for step, need in enumerate(fewest_matches(percent)[: left.shape[1] // STEP]):
        at = slice(step * STEP, (step + 1) * STEP)
        for k in range(0, len(i), 65536):
            part = slice(k, k + 65536)
            matches[part] += np.count_nonzero(left[i[part], at] == right[j[part], at], axis=1)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j, matches


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, key (digest of the shingle set, null if empty), n_shingles, bands, signature."""
    bands, rows = banding(percent)

    def body(cols):
        sets = shingle_sets([(t or "").encode("utf-8") for t in cols["text"].to_pylist()], k)
        band_hash, signer = hashers(bands, rows)
        keys, band_keys, signs = [], [], []
        for s in sets:
            if not len(s):
                keys.append(None), band_keys.append(None), signs.append(None)
                continue
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            minima = band_hash(s).reshape(bands, rows).astype(np.uint64) * _ROWS[:rows]
            band_keys.append(mix(np.add.reduce(minima, axis=1) + np.arange(1, bands + 1, dtype=np.uint64) * _BAND).view(np.int64))
            signs.append(signer(s).astype(np.uint8).tobytes())
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "key": keys, "n_shingles": list(map(len, sets)), "bands": band_keys, "signature": signs}

    rows_ = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "xxhash64(CAST(text AS STRING)) AS text_hash", "CAST(text AS STRING) AS text")
    return map_batches(rows_, body, "doc_id long, text_hash long, key binary, n_shingles long, bands array<long>, signature binary")


def by_group(batches, keys: int):
    """Whole groups of a stream sorted by its first ``keys`` columns, as lists of numpy arrays and lists."""
    held: list[pa.Table] = []

    def array(c: pa.ChunkedArray):
        if pa.types.is_list(c.type):  # lists of one length
            return np.concatenate([x.flatten().to_numpy() for x in c.chunks]).reshape(len(c), -1)
        return c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy()

    def out(t: pa.Table):
        return [array(c) for c in t.columns]

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if held:
            t = pa.concat_tables([*held, t])
            held = []
        n = t.num_rows
        if not n:
            continue
        change = np.zeros(n - 1, bool)
        for c in range(keys):
            x = t.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield out(t.slice(a, b - a))
        held = [t.slice(cuts[-1]).combine_chunks()]
    if held:
        yield out(pa.concat_tables(held))


def _bytes(values: list[bytes]) -> np.ndarray:
    """Values of one size as rows of bytes."""
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _emitted(groups, work, names: list[str]):
    """Collect the rows that ``work`` makes of many groups into batches."""
    got: list = []
    size = 0
    for columns in map(work, groups):
        if len(columns[0]):
            got.append(columns)
            size += len(columns[0])
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names)
            got, size = [], 0
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names)
    release()


def _first_of_each(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first entry of ``order`` for each value of ``key`` (equal ones stand together in ``order``)."""
    if not len(order):
        return order
    k = key[order]
    return order[np.concatenate([[True], k[1:] != k[:-1]])]


def best_partners(members: DataFrame, percent: int) -> DataFrame:
    """One candidate (a < b) per node b: its best earlier partner, by first minima, over all bands.

    ``members``: (band, node, first, n_members, size, head).
    """
    python_batches(members.sparkSession)

    def work(group):
        _, _, node, size, head = group
        if len(node) < 2:
            return node[:0], node[:0], node[:0]
        x = _bytes(head)
        i, j, m = surviving(x, x, (size, size), node[:, None] < node[None], percent)
        first = _first_of_each(np.lexsort((node[i], -m, j)), j)  # of each j the most matches, then the smallest node
        return node[i[first]], node[j[first]], m[first]

    blocks = F.ceil(F.col("n_members") / BLOCK).cast("int")
    dealt = members.withColumn("block", F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))))
    dealt = dealt.select("band", "block", "node", "size", "head").repartition(shuffle_width(members), "band", "block").sortWithinPartitions("band", "block", "node")
    found = dealt.mapInArrow(lambda it: _emitted(by_group(it, 2), work, ["a", "b", "matches"]), "a long, b long, matches long")
    best = found.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("a"))).alias("best"))
    return best.select((-F.col("best.a")).alias("a"), "b")


def verified(pairs: DataFrame, held: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs that survive the later batches too and whose full sets reach the threshold: 100 * common >= percent * union."""

    def body(cols):
        left, right = _bytes(cols["left"].to_pylist()), _bytes(cols["right"].to_pylist())
        matches = np.cumsum((left == right).reshape(len(left), -1, STEP).sum(axis=2), axis=1)
        alive = (matches >= np.array(fewest_matches(percent))).all(axis=1)
        keep = []
        for ok, x, y in zip(alive.tolist(), cols["x"], cols["y"]):
            if ok:
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok = 100 * common >= percent * (len(p) + len(q) - common)
            keep.append(ok)
        mask = pa.array(keep)
        return {"a": cols["a"].filter(mask), "b": cols["b"].filter(mask)}

    right = held.select(F.col("node").alias("b"), F.col("signature").alias("right"), F.col("shingles").alias("y"))
    left = held.select(F.col("node").alias("a"), F.col("signature").alias("left"), F.col("shingles").alias("x"))
    # b first: it stands in one pair only; a hot a comes once for each task of its pairs
    met = spread_join(pairs, left, "a", total).join(right, "b")
    return map_batches(met.select("a", "b", "left", "right", "x", "y"), body, "a long, b long")


class Sets:
    """Shingle sets of one block, as numbers of the block's distinct shingles."""

    def __init__(self, sets: list[bytes]):
        flat = np.frombuffer(b"".join(sets), np.uint64)
        self.size = np.fromiter((len(s) // 8 for s in sets), np.int64, len(sets))
        self.ends = np.cumsum(self.size)
        distinct, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shingles in common of each pair; ``i`` is sorted."""
        out = np.empty(len(i), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            mine = self.flat[self.ends[i[a]] - self.size[i[a]] : self.ends[i[a]]]
            self.mark[mine] = True
            size = self.size[j[a:b]]
            upto = np.cumsum(size)
            at = np.repeat(self.ends[j[a:b]] - upto, size) + np.arange(int(upto[-1]))
            out[a:b] = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), upto - size)
            self.mark[mine] = False
        return out


def linked_roots(i: np.ndarray, j: np.ndarray, matches: np.ndarray, root: np.ndarray, sets: Sets, percent: int) -> list[tuple[int, int]]:
    """Links between components that the pairs' full sets give; pairs within what is linked already are left out.

    The best pair of every two components is looked at first.
    """
    names, number = np.unique(root, return_inverse=True)
    label = np.arange(len(names))  # of each component: what it is linked with so far
    low, high = np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
    order = np.lexsort((-matches, high, low))
    best = np.zeros(len(i), bool)
    best[_first_of_each(order, low * len(names) + high)] = True
    rest = np.flatnonzero(~best)
    queue = np.concatenate([np.flatnonzero(best), rest[np.argsort(-matches[rest], kind="stable")]])
    links = []
    while len(queue):
        queue = queue[label[low[queue]] != label[high[queue]]]
        take, queue = queue[:PAIRS_AT_ONCE], queue[PAIRS_AT_ONCE:]
        take = take[np.argsort(i[take], kind="stable")]
        if not len(take):
            break
        common = sets.common(i[take], j[take])
        good = take[100 * common >= percent * (sets.size[i[take]] + sets.size[j[take]] - common)]
        for a, b in zip(low[good].tolist(), high[good].tolist()):
            if label[a] != label[b]:
                label[label == label[b]] = label[a]
                links.append((int(names[a]), int(names[b])))
    return links


def across_components(rooted: DataFrame, shared: DataFrame, held: DataFrame, percent: int, total: int) -> DataFrame:
    """Links (a, b) between components, from all candidates across them in every bucket that holds several.

    ``rooted``: (band, node, root); ``shared``: (band, n); ``held``: (node, size, signature, bands, shingles).
    A pair that shares several bands is looked at in the first of them only.
    """
    python_batches(rooted.sparkSession)
    counts = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    buckets = counts.groupBy("band").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n"))
    buckets = buckets.where("top.c < n").select("band", F.col("top.root").alias("major"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("minors"), F.ceil(F.col("n") / ALL_BLOCK).cast("int").alias("alls"))
    rows = spread_join(rooted, buckets, "band", total, counts=shared).join(held.select("node", "size", "bands", F.substring("signature", 1, HEAD).alias("head")), "node")
    columns = ["band", "x", "y", "minor", "node", "root", "size", "head", "bands"]
    mine = rows.where("root <> major").withColumn("minor", F.lit(1)).withColumn("x", F.pmod(F.xxhash64("node"), "minors").cast("int")).withColumn("y", F.explode(F.expr("sequence(0, alls - 1)"))).select(columns)
    every = rows.withColumn("minor", F.lit(0)).withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), "alls").cast("int")).withColumn("x", F.explode(F.expr("sequence(0, minors - 1)"))).select(columns)

    def candidates(band, minor, root, size, sign, bands):
        """(i, j, matches) over the block's rows: survivors across components whose first shared band this is."""
        u, v = np.flatnonzero(minor == 1), np.flatnonzero(minor == 0)
        if not len(u) or not len(v):
            return u[:0], u[:0], u[:0]
        i, j, m = surviving(sign[u], sign[v], (size[u], size[v]), root[u][:, None] != root[v][None], percent)
        i, j = u[i], v[j]
        first = np.ones(len(i), bool)
        for k in range(0, len(i), 65536):
            part = slice(k, k + 65536)
            shared_ = bands[i[part]] == bands[j[part]]
            first[part] = bands[i[part], shared_.argmax(axis=1)] == band[0]
        return i[first], j[first], m[first]

    def concerned(group):
        """The nodes with survivors, in parts whose sets fit into memory."""
        band, x, y, minor, node, root, size, head, bands = group
        i, j, _ = candidates(band, minor, root, size, _bytes(head), bands)
        part = np.cumsum(size[j]) // SHINGLES_AT_ONCE  # pairs come by i
        row, at = np.divmod(np.unique(np.concatenate([part * len(node) + i, part * len(node) + j])), max(1, len(node)))
        return band[at], x[at], y[at], row.astype(np.int32), minor[at], node[at], root[at]

    def confirmed(group):
        band, _, _, _, minor, _, root, size, sign, bands, shingles = group
        i, j, m = candidates(band, minor, root, size, _bytes(sign), bands)
        links = np.array(linked_roots(i, j, m, root, Sets(shingles), percent) if len(i) else [], np.int64).reshape(-1, 2)
        return links[:, 0], links[:, 1]

    width = shuffle_width(rooted)
    dealt = mine.union(every).repartition(width, "band", "x", "y").sortWithinPartitions("band", "x", "y", "minor", "node")
    names = ["band", "x", "y", "part", "minor", "node", "root"]
    asked = dealt.mapInArrow(lambda it: _emitted(by_group(it, 3), concerned, names), "band long, x int, y int, part int, minor int, node long, root long")
    met = asked.join(held.select("node", "size", "signature", "bands", "shingles"), "node").select(*names, "size", "signature", "bands", "shingles")
    met = met.repartition(width, "band", "x", "y", "part").sortWithinPartitions("band", "x", "y", "part", "minor", "node")
    return met.mapInArrow(lambda it: _emitted(by_group(it, 4), confirmed, ["a", "b"]), "a long, b long").distinct()


def held_nodes(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The wanted nodes (node, key, id, text_hash, size, signature, bands) with their shingles, worked out again from their texts."""

    def body(cols):
        sets = [s.tobytes() for s in shingle_sets([(t or "").encode("utf-8") for t in cols["text"].to_pylist()], k)]
        same = pa.array([hashlib.blake2b(s, digest_size=16).digest() == key for s, key in zip(sets, cols["key"].to_pylist())], pa.bool_())
        return {n: cols[n].filter(same) for n in ("node", "size", "signature", "bands")} | {"shingles": pa.array(sets, pa.binary()).filter(same)}

    texts = docs.select(row_id().alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    same = Window.partitionBy("id", "text_hash", "node", F.crc32(F.col("text").cast("binary"))).orderBy(F.lit(0))  # repeated rows
    rows = texts.join(wanted, ["id", "text_hash"]).withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return map_batches(rows.select("node", "key", "size", "signature", "bands", "text"), body, "node long, size long, signature binary, bands array<long>, shingles binary")


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, component_id, and group (null for rows without words, which stand alone)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.keep(sketches(docs, k, percent), "sketches")
    handle = F.min(F.struct(row_id().alias("id"), "text_hash")).alias("handle")
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc"), handle, F.count(F.lit(1)).alias("n_rows"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = scratch.keep(nodes.select("key", "doc", "handle.*", "n_rows", "size", "bands", "signature").withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so ids are fixed
    n_nodes, n_banded = nodes.count(), nodes.count() * banding(percent)[0]

    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = scratch.keep(banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    bands = shared.select("band", "n")
    members = scratch.keep(spread_join(banded, shared.select("band", "first", F.col("n").alias("n_members")), "band", n_banded, counts=bands).select("band", "node", "first", "n_members"), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "key", "id", "text_hash", "size", "signature", "bands")
    held = scratch.keep(held_nodes(docs, wanted, k), "held")

    heads = held.select("node", "size", F.substring("signature", 1, HEAD).alias("head"))
    tested = scratch.keep(best_partners(members.join(heads, "node"), percent), "tested")
    links = scratch.keep(verified(tested, held, percent, n_nodes), "verified")
    scratch.drop(tested)
    roots = scratch.keep(components(links, scratch), "roots")
    rooted = members.select("band", "node").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    rooted = scratch.keep(rooted, "rooted")
    scratch.drop(links, members)
    more = scratch.keep(across_components(rooted, bands, held, percent, n_banded), "across")
    scratch.drop(rooted, held)
    tops = components(more, scratch).select(F.col("node").alias("root"), F.col("root").alias("top"))

    named = nodes.select("node", "key", "doc", "n_rows").join(roots, "node", "left").select("key", "doc", "n_rows", F.coalesce("root", "node").alias("root"))
    named = scratch.keep(spread_join(named, tops, "root", n_nodes, "left").select("key", "doc", "n_rows", F.coalesce("top", "root").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("doc").alias("set_id"), F.count(F.lit(1)).alias("n"))
    per_key = spread_join(named, least.select("root", "set_id"), "root", n_nodes, counts=least.select("root", "n"))
    out = spread_join(rows.select("doc_id", "text_hash", "key", "n_shingles"), per_key.select("key", "set_id", "root"), "key", rows.count(), "left", counts=named.select("key", F.col("n_rows").alias("n")))
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("set_id"))
    result = materialize(out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.col("root").alias("group")), "groups")
    scratch.clear()
    return result


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    return groups(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns) without near duplicates: of each group the smallest (doc_id, text hash) stays.

    Null doc_ids come last; of rows that are equal in both one stays.
    """
    found = groups(docs, k, percent).select("group", row_id().alias("id"), F.col("doc_id"), "text_hash")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash", "id")
    winners = found.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("w")).select(F.col("w.id").alias("id"), F.col("w.text_hash").alias("text_hash"))
    kept = winners.union(found.where("group IS NULL").select("id", "text_hash").distinct())
    return keep_rows(docs, kept.select("id", F.col("text_hash").alias("mark")), F.xxhash64(F.col("text").cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), k=3, percent=85)


#: DuckDB: all pairs of sets that share a shingle, counted in full, and the reach of each smallest id.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
), k AS (
  SELECT doc_id, len(g) AS n, CASE WHEN len(g) > 0 THEN min(doc_id) OVER (PARTITION BY md5(array_to_string(g, chr(10)))) ELSE doc_id END AS node, g FROM s
), x AS (SELECT node, n, unnest(g) AS h FROM k WHERE doc_id = node
), p AS (
  SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r(node, root) AS (SELECT DISTINCT node, node FROM k UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b
), c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM k JOIN c USING (node)
"""

"""Operator 5: exact dedup against a minimal perfect hash of historical digests.

The table is seen as a history (the part ingested first, up to ``cut`` in
doc_id) and a newer part. Distinct digests of the history are dealt by their
first bytes into shards; each shard is a minimal perfect hash whose slots hold
the full digest, the winner's doc_id and the group's size so far, written to the
shared folder. The newer part is pre-aggregated by digest and probes its shard:
slots whose 32 bytes agree remove repeats, nonmembers form groups of their own.

Only digests are shuffled, never texts, and hot digests are aggregated before
any shuffle. A shard is bounded by choosing the shard count from the number of
distinct digests (SHA-256 deals evenly).

Defined results: null text counts as empty; null doc_ids come last, so they win
only groups without any doc_id (keep_id is then null); of rows that are tied on
the winning doc_id exactly one is kept; an empty table gives no rows; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import SPACE, keep_rows, materialize, python_batches, row_id, spread_join, table, text_or_empty
from lexiloom.llm.perfect_hash import PerfectHash, matrix

#: Distinct digests that one shard is meant to hold.
DIGESTS_PER_SHARD = 20_000
#: Copies of one row that are put out from one array.
RUN = 100_000
SLOTS = pa.schema([("shard", pa.int32()), ("mph", pa.binary()), ("digests", pa.binary()), ("winners", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def digest_of(column: str = "text"):
    """SHA-256 (binary) of the text with runs of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(column), SPACE, " "), 256))


def text_mark():
    """What tells texts of one doc_id apart when the winner's row is looked up: far cheaper than hashing all texts again."""
    return F.xxhash64(F.col("text").cast("string"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.sum("copies").alias("size"))


def _shard(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(n)).cast("int")


def build_history(groups: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, mph, digests, winners, sizes): one perfect hash per shard.

    ``groups`` has distinct (digest, winner, size); a null winner is kept as null.
    """

    def build(t: pa.Table) -> pa.Table:
        digests = matrix(t["digest"].to_pylist())
        mph = PerfectHash.build(digests)
        order = np.empty(len(digests), np.int64)
        order[mph.slots(digests)] = np.arange(len(digests))
        row = {"shard": t["shard"][0].as_py(), "mph": mph.to_bytes(), "digests": digests[order].tobytes(), "winners": t["winner"].take(order).to_pylist(), "sizes": t["size"].take(order).to_pylist()}
        return pa.Table.from_pylist([row], SLOTS)

    rows = groups.select(_shard(shards).alias("shard"), "digest", "winner", "size")
    built = rows.groupBy("shard").applyInArrow(build, "shard int, mph binary, digests binary, winners array<long>, sizes array<long>")
    return materialize(built, "history")


def probe(history: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Rows (digest, keep_id, group_size, member): history updated by ``groups``, and its nonmembers."""

    def look(slots: pa.Table, new: pa.Table) -> pa.Table:
        held, sizes, winners, mph = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), [], None
        if slots.num_rows:
            row = slots.to_pylist()[0]
            held, mph = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32), PerfectHash.from_bytes(row["mph"])
            sizes, winners = np.array(row["sizes"], np.int64), row["winners"]
        fresh = np.ones(new.num_rows, bool)
        if new.num_rows and len(held):
            asked, ids = matrix(new["digest"].to_pylist()), new["winner"]
            slot = mph.slots(asked)
            hit = np.flatnonzero(slot >= 0)
            hit = hit[(held[slot[hit]] == asked[hit]).all(axis=1)]
            fresh[hit] = False
            sizes[slot[hit]] += new["size"].to_numpy()[hit]
            for i in hit.tolist():  # a history group without any doc_id takes the first real one
                if winners[slot[i]] is None:
                    winners[slot[i]] = ids[i].as_py()
        alone = new.filter(pa.array(fresh))
        member = pa.array(np.arange(len(held) + alone.num_rows) < len(held))
        columns = [[x.tobytes() for x in held] + alone["digest"].to_pylist(), winners + alone["winner"].to_pylist(), sizes.tolist() + alone["size"].to_pylist()]
        return pa.Table.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), member], ["digest", "keep_id", "group_size", "member"])

    asked = groups.select(_shard(shards).alias("shard"), "digest", "winner", "size")
    return history.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(look, "digest binary, keep_id long, group_size long, member boolean")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copies, text_hash) of all rows, repeated rows counted; written once. ``text_hash`` is the least of theirs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest"), text_mark().alias("text_hash"))
    return materialize(rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min("text_hash").alias("text_hash")), "digests")


def exact_groups(docs: DataFrame, cut: int | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, digest, member, text_hash.

    ``cut``: the history's largest doc_id; by default the middle of the id range.
    ``member``: the row's digest was found in the history.
    """
    rows = digests(docs)
    span = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    cut = cut if cut is not None else (span["a"] + span["b"]) // 2 if span["a"] is not None else 0
    old = F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(False))
    past = _groups(rows.where(old))
    python_batches(docs.sparkSession)
    n_rows = rows.count()
    shards = max(1, -(-n_rows // DIGESTS_PER_SHARD))
    slots = build_history(past, shards)
    groups = probe(slots, _groups(rows.where(~old)), shards)
    # a row repeated very often comes back in runs, so that no array holds all its copies
    runs = F.expr(f"sequence(0L, (copies - 1) DIV {RUN})")
    copies = F.expr(f"sequence(__run * {RUN} + 1, least(copies, (__run + 1) * {RUN}))")
    return (
        spread_join(rows, groups, "digest", n_rows)
        .withColumn("__run", F.explode(runs))
        .withColumn("__copy", F.explode(copies))
        .select("doc_id", "keep_id", "group_size", (F.expr("doc_id <=> keep_id") & (F.col("__copy") == 1)).alias("kept"), "digest", "member", "text_hash")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) without exact duplicates: the winner of each group stays.

    Of rows tied on the winning doc_id the one with the least hash of its text stays, then the first by the other columns.
    """
    kept = exact_groups(docs).where("kept").select(row_id().alias("id"), F.col("text_hash").alias("mark"))
    return keep_rows(docs, kept, text_mark())


def query(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

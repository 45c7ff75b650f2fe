"""Operator 4: token ids in ORC files, written in doc_id order and read back.

Documents are range-partitioned and sorted by doc_id and written as ORC: lists
of ids in integer run-length encoding (the file format's version 2), row indexes
every ``ROW_INDEX`` rows and Bloom filters on doc_id. Files hold several stripes,
and Spark's ORC reader takes stripes in parallel; ``lookup`` shows the pruning of
files, stripes and row groups by min/max and Bloom filter.

Ids come from the tokenizers library, asked once for each distinct pre-token of a
batch (byte-level BPE does not merge across pre-tokens). The start of a document
is the sum of all lengths before it: totals of key ranges first, then running
sums inside a range, so that no task needs all rows.

Defined results: null text counts as empty (the end id only); a null doc_id sorts
first; rows with the same doc_id follow one another in the order of their texts' hashes;
an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches, materialize, python_batches, release, shared_dir, shuffle_width, table
from lexiloom.llm.pretokens import BatchTable, pretoken_cut, tokenizer
from lexiloom.llm.token_count import default_path

END_ID = 2
#: Distinct pre-tokens whose ids are kept between batches.
MOST_PRETOKENS = 1_000_000
ROW_INDEX = 1000
STRIPE_BYTES = 8 << 20
#: A file is meant to hold no fewer documents and no more of the input than this.
ROWS_PER_FILE, BYTES_PER_FILE = 2_000, 256 << 20
#: Rows of a file whose starts are summed in one window.
ROWS_PER_CELL = 1_000


class Encoder:
    """Ids of texts; ids of distinct pre-tokens are kept between batches as one ragged array."""

    def __init__(self, path: str):
        self.path, self.table = path, BatchTable(pretoken_cut(path), MOST_PRETOKENS)
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's number of ids."""
        flat, lengths, new, anew = self.table.number(texts)
        if anew:
            self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if new:
            found = [e.ids for e in tokenizer(self.path).encode_batch_fast(new, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            fresh = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
            self.ids = np.concatenate([self.ids, fresh])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        size = self.starts[flat + 1] - self.starts[flat]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.starts[flat] - (ends - size), size) + np.arange(int(size.sum()))]
        total = np.concatenate([[0], ends])
        last = np.cumsum(lengths)
        per_text = total[last] - total[last - lengths]
        if end_id is None:
            return ids, per_text
        return np.insert(ids, np.cumsum(per_text), end_id), per_text + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def file_count(rows: int, input_bytes: int, width: int) -> int:
    """As many files as shuffle partitions, more over ``BYTES_PER_FILE`` of input; fewer where they would hold under ``ROWS_PER_FILE`` rows."""
    return max(1, min(-(-rows // ROWS_PER_FILE), max(width, -(-input_bytes // BYTES_PER_FILE))))


def range_of(column: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the column (null: 0), by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    held = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # a constant to the optimizer
    found = lambda at, step: F.when(F.coalesce(F.get(held, at + step - 1) <= F.col(column), F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), found)


def part_of(bounds: list[int], null_parts: int) -> tuple[Column, int]:
    """The part of a row (doc_id, __hash), ascending in (doc_id, __hash) with nulls first, and the number of parts.

    ``bounds`` are quantiles of doc_id: one that stands k times belongs to an id with so many rows that they are cut
    into k parts by their hash; the last of these goes on with the ids up to the next bound.
    """
    times = Counter(bounds)
    distinct = sorted(times)
    first, parts = [], null_parts + 1  # ids under all bounds have one part
    for b in distinct:
        first.append(parts)
        parts += times[b]
    share = F.col("__hash").cast("double") / float(1 << 64) + 0.5  # in [0, 1]
    cut = lambda k: F.least(F.floor(share * k), k - 1).cast("int")
    if not distinct:
        return F.when(F.col("doc_id").isNull(), cut(F.lit(null_parts))).otherwise(F.lit(null_parts)).cast("int"), parts
    held = lambda values: F.from_json(F.lit(json.dumps([0, *values])), "array<bigint>")
    at = F.col("__at")
    k = F.get(held([times[b] for b in distinct]), at)
    inner = F.when(F.col("doc_id") == F.get(held(distinct), at), cut(k)).otherwise(k - 1)
    found = F.when(at == 0, F.lit(null_parts)).otherwise(F.get(held(first), at) + inner)
    return F.when(F.col("doc_id").isNull(), cut(F.lit(null_parts))).otherwise(found).cast("int"), parts


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text), range-partitioned by quantiles of doc_id and sorted by doc_id, then by the text's hash.

    The quantiles come from a scan of doc_id alone; a range partitioner's own sampling would read all texts a second
    time. Rows of one doc_id, or of none, that would fill more than a file are cut by their texts' hashes.
    """
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    n, named = rows.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    files = file_count(n, int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), shuffle_width(docs))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / files for i in range(1, files)], min(100 * files, 1_000_000))).first()[0] if files > 1 else None
    bounds = sorted(bounds or [])
    part, parts = part_of(bounds, max(1, -(-(n - named) * files // max(1, n))))
    placed = rows.withColumn("__hash", F.xxhash64("text")).withColumn("__at", range_of("doc_id", sorted(set(bounds)))).withColumn("__part", part)
    return placed.repartitionById(parts, F.col("__part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__hash", "text").select("doc_id", "text")


def encode(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """Rows (doc_id, row, ids): each text's ids with ``end_id`` behind them; ``row`` counts within a partition."""
    python_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches):
        row = 0
        for batch in batches:
            ids, sizes = encoder(path)([t or "" for t in batch.column(1).to_pylist()], end_id)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(types[0]), rows, lists], ["doc_id", "row", "ids"])
        release()

    return docs.mapInArrow(run, "doc_id long, row long, ids array<int>")


def write_orc(encoded: DataFrame, path: str, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write (doc_id, row, ids), one file per partition, in stripes of about ``stripe_bytes``."""
    (
        encoded.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.write.format", "0.12")
        .option("orc.compress", "SNAPPY")
        .orc(path)
    )


def lookup(spark, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the reader, which skips by statistics and Bloom filter."""
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids))


def read_index(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""

    def body(cols):
        ids = cols["ids"]
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        return {"doc_id": cols["doc_id"], "row": cols["row"], "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_crc32": crc, "file": cols["file"]}

    rows = spark.read.schema("doc_id long, row long, ids array<int>").orc(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))
    docs = map_batches(rows, body, "doc_id long, row long, n_tokens long, ids_crc32 long, file int")
    docs = materialize(docs.withColumn("cell", F.floor(F.col("row") / ROWS_PER_CELL)), "token-index")
    cells = docs.groupBy("file", "cell").agg(F.sum("n_tokens").alias("cell_tokens"))
    files = cells.groupBy("file").agg(F.sum("cell_tokens").alias("file_tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("file_start", F.coalesce(F.sum("file_tokens").over(before), F.lit(0))).drop("file_tokens")
    within = Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("in_file", F.coalesce(F.sum("cell_tokens").over(within), F.lit(0))).join(files, "file")
    cells = cells.select("file", "cell", (F.col("file_start") + F.col("in_file")).alias("cell_start"))
    inside = Window.partitionBy("file", "cell").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(cells, ["file", "cell"])
        .select("doc_id", (F.col("cell_start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(docs: DataFrame, path: str, out: str, end_id: int | None = END_ID) -> None:
    """Encode all documents and write them below ``out``."""
    write_orc(encode(in_order(docs), path, end_id), out)


def query(spark, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-orc")
    token_files(table(spark, sf_dir, "documents"), default_path(), out)
    return read_index(spark, out)

"""Shared plumbing of the corpus operators: inputs, shared folders, row helpers."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.operators.runtime import prepare as python_batches
from lexiloom.operators.runtime import shared_dir, spread, table, written

__all__ = ["python_batches", "shared_dir", "spread", "table"]

#: The white space of the contracts: ``[\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Types whose columns order tied rows.
SORTABLE = ("string", "bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "binary")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    return written(df, shared_dir(df.sparkSession, what))


class Scratch:
    """Written tables of one computation; each goes when it has had its use, the rest together at the end."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.top, self.n = spark, shared_dir(spark, what), 0
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n:03d}-{what}"
        out = written(df, path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` gave and nothing reads any more."""
        for t in tables:
            at = next(i for i, (held, _) in enumerate(self.held) if held is t)
            self._delete(self.held.pop(at)[1])

    def clear(self) -> None:
        self._delete(self.top)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that a task of ``spread_join`` takes at least.
ROWS_PER_KEY = 1000


def spread_join(rows: DataFrame, one: DataFrame, key: str, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``one`` (one row a key at most) on ``key``; a hot key's rows go to several tasks.

    Keys with more than ``total`` / 1000 rows, ``total`` being the rows' number, are dealt over as many copies of their
    row in ``one`` as they need. There are fewer than 1000 such keys, so the list of them is broadcast. ``counts``: (key, n)
    of ``rows`` where that is known.
    """
    most = max(ROWS_PER_KEY, total // 1000)
    if total <= most:  # no key can have more
        return rows.join(one, key, how)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("__salts")))
    others = [F.col(f"`{c}`") for c in rows.columns if c != key] or [F.lit(0)]
    salts = F.coalesce("__salts", F.when(F.col(key).isNull(), F.lit(ROWS_PER_KEY)).otherwise(F.lit(1)))  # null keys meet nothing: anywhere
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("__salts")
    right = one.join(hot, key, "left").withColumn("__salt", F.explode(F.expr("sequence(0, coalesce(__salts, 1) - 1)"))).drop("__salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def shuffle_width(df: DataFrame) -> int:
    """Tasks after a shuffle, as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def tie_order(df: DataFrame, skip: tuple[str, ...] = ()) -> list[Column]:
    """Columns that order tied rows: all sortable ones, so that reruns agree."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if c not in skip and kind in SORTABLE]


def release() -> None:
    """Give memory that a finished Python task no longer uses back to the system; idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, body, schema: str) -> DataFrame:
    """``mapInArrow`` of ``body(dict of Python lists) -> dict of lists/arrays`` per batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    python_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = body({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for x, f in zip((out[n] for n in arrow.names), arrow)],
                    schema=arrow,
                )
        release()

    return df.mapInArrow(run, schema)


def row_id() -> Column:
    """doc_id as text, null as an empty string: an equi-join key that is never null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where the table has such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame, mark: Column) -> DataFrame:
    """Rows of ``docs``, columns unchanged, whose (doc_id, mark) is in ``kept`` (id, mark); one row of each.

    The semi-join and the choice among tied rows share one shuffle.
    """
    a, b, n = unused(docs, "__lx_id", "__lx_mark", "__lx_n")
    marked = docs.withColumn(a, row_id()).withColumn(b, mark)
    held = kept.select(F.col("id").alias(a), F.col("mark").alias(b))
    first = Window.partitionBy(a, b).orderBy(*(tie_order(docs, ("text",)) or [F.lit(0)]))
    found = marked.join(held, [a, b], "left_semi").withColumn(n, F.row_number().over(first))
    return found.where(F.col(n) == 1).select([F.col(f"`{c}`") for c in docs.columns])

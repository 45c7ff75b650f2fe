"""Operator 9: mix sources to target weights on a time-varying curriculum.

DataFrame functions only. Every source has a weight schedule over training
time ``t`` in [0, 1]::

    w(t) = w * (1 + ramp * (2 t - 1))        integral over [0, 1]:  w

so a source with a positive ramp is used more towards the end. Integrating
gives its cumulative token demand ``target * (t + ramp * (t^2 - t))``; the
inverse of that at a document's place in its source's token stream is the
document's training position, and the mix is range-sorted by position.

The stream of a source is its documents in keyed hash order, read round and
round until the target is met: whole passes first, then a last pass that ends
inside one document. The hash is keyed by doc_id and text, so rows that share a
doc_id, or have none, spread like others. Prefix sums are taken in two levels (hash
buckets, then inside a bucket, both about the square root of the rows) so that a
source with a third of all rows spreads over many tasks. Texts are read once: what
the sums need of them is written to the shared folder.

Defined results: null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; a null doc_id is hashed as an empty string;
repeated rows are separate rows, which share doc_id, text and size, and are
interchangeable but for other columns, by which ``mixed`` orders them; an empty
table gives no rows; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import SORTABLE, WORD, materialize, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Ramps of the weight schedules, repeating like the weights.
RAMPS = (0.5, -0.5, 0.0)
BUDGET = 1.5
CAP = 2
SEED = "mix-1"
#: Rows that one (source, bucket) window is meant to hold at least.
ROWS_PER_BUCKET = 500
DIGITS = 9


def words_of(text: Column) -> Column:
    """Number of runs of non-space characters; JVM regex replace, no arrays built."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\x01")
    return (F.length(squeezed) - F.length(F.translate(squeezed, "\x01", ""))).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as sources do: by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """One row per source: (__source, source_size, target, ramp).

    The share is water filling: with sources ordered by cap / weight, the level
    is the first ``(budget - caps before) / (weights from here)`` that the
    source's own cap does not undercut, which is also the largest such one;
    ``target = least(cap, level * weight)``.
    ``sizes`` has one row per source (by ``source_key``), a dimension table.
    """
    order = Window.orderBy("__source")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("__k") % len(values) + 1).cast("int"))
    caps = (
        sizes.withColumn("__k", F.row_number().over(order) - 1)
        .withColumn("__w", pick(weights))
        .withColumn("ramp", pick(ramps))
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    )
    filled = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(after)
    return (
        caps.withColumn("__level", level)
        .withColumn("__open", F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")))
        .withColumn("__fill", F.max("__open").over(every))
        .select(
            "__source", "source_size", "ramp",
            F.least(F.col("__cap"), F.coalesce(F.col("__fill") * F.col("__w"), F.col("__cap"))).alias("target"),
        )
    )


def position(offset: Column, target: Column, ramp: Column) -> Column:
    """Invert the cumulative demand at ``offset`` words: the training time in [0, 1]."""
    q = F.least(F.greatest(offset / target, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * q)
    return F.when(target > 0, F.round(F.when(ramp == 0, q).otherwise((root - (1 - ramp)) / (2 * ramp)), DIGITS))


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hash buckets per source: of ``per_bucket`` rows, or of the square root of a larger table's rows."""
    return max(1, -(-rows // max(per_bucket, math.isqrt(rows))))


def placed(docs: DataFrame, *, weights=WEIGHTS, ramps=RAMPS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED, carry: bool = False) -> DataFrame:
    """Per row: doc_id, size, source_size, target, ramp, taken, __at (words before it), __turns; with ``carry`` __row, all its columns.

    Without ``carry`` what is needed of the rows is written first; with it, whole rows would be, so they are read again instead.
    """
    n_buckets = buckets_for(docs.count())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id"), source_key(F.col("source").cast("string")).alias("__source"), words_of(text).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("__key"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
    )
    # never null to the optimizer, which else would work out the key once more to filter by it
    sized = sized.withColumn("__bucket", F.coalesce(F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long") * n_buckets / (1 << 32)), F.lit(0)))
    if not carry:
        sized = materialize(sized, "sizes")
    ties = [F.col(f"__row.`{c.name}`") for c in docs.schema.fields if c.dataType.simpleString() in SORTABLE and c.name != "text"] if carry else []
    cells = sized.groupBy("__source", "__bucket").agg(F.sum("size").alias("__cell"))
    targets = source_targets(cells.groupBy("__source").agg(F.sum("__cell").alias("source_size")), weights, ramps, budget, cap)
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__start", F.coalesce(F.sum("__cell").over(ahead), F.lit(0))).drop("__cell")
    same = starts.join(targets, "__source")
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    found = (  # window and join go by the same keys, so rows are shuffled once for both
        sized.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(same, ["__source", "__bucket"])
        .select("doc_id", "size", "source_size", "target", "ramp", (F.col("__start") + F.col("__in")).alias("__at"), *(["__row"] if carry else []))
    )
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) DIV source_size")).otherwise(F.lit(0))
    return (
        found.withColumn("__passes", passes)
        .withColumn("__rest", goal - F.col("__passes") * F.col("source_size"))
        .withColumn("__last", F.least(F.col("size"), F.greatest(F.col("__rest") - F.col("__at"), F.lit(0))))
        .withColumn("taken", (F.col("__passes") * F.col("size") + F.col("__last")).cast("long"))
        .withColumn("__turns", F.col("__passes") + (F.col("__last") > 0).cast("long"))
        .drop("__passes", "__rest", "__last")
    )


def turn_position(turn: Column) -> Column:
    """Training position of a row's pass ``turn`` (from 0)."""
    return position(F.col("__at") + turn * F.col("source_size"), F.col("target"), F.col("ramp"))


def mix(docs: DataFrame, *, sort: bool = True, **how) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, first_position, last_position.

    The positions are those of the first and the last pass that takes words of the
    row (null when nothing is taken).
    """
    used = F.col("taken") > 0
    out = placed(docs, **how).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.when(used, turn_position(F.lit(0))).alias("first_position"),
        F.when(used, turn_position(F.col("__turns") - 1)).alias("last_position"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id") if sort else out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` (all columns), once for each pass that takes any of their words, sorted by position.

    Rows are whole: the one row a source at most that a last pass ends in is not cut.
    """
    turns = placed(docs, carry=True, **how).where("taken > 0").withColumn("__turn", F.explode(F.expr("sequence(0L, __turns - 1)")))
    rows = turns.select(turn_position(F.col("__turn")).alias("__position"), "doc_id", "__at", "__row").orderBy("__position", "doc_id", "__at")
    return rows.select([F.col("__row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: DuckDB: the same mix, with each source's prefix sum in one window.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s
), w AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         CASE i % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS ramp,
         source_size * 2.0::DOUBLE AS cap FROM n
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
          / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w
), t AS (
  SELECT source, source_size, ramp,
         least(cap, coalesce(max(CASE WHEN lv * w <= cap THEN lv END) OVER () * w, cap)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
         CASE WHEN t.source_size > 0 THEN CAST(round(t.target) AS BIGINT) // t.source_size ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), r AS (SELECT *, least(size, greatest(CAST(round(target) AS BIGINT) - passes * source_size - a, 0)) AS rest FROM p
), q AS (SELECT *, passes * size + rest AS taken, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END AS turns FROM r
), z AS (SELECT *, CASE WHEN target > 0 THEN least(greatest(a / target, 0), 1) END AS q1,
                CASE WHEN target > 0 THEN least(greatest((a + (turns - 1) * source_size) / target, 0), 1) END AS q2 FROM q)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 THEN 0.0::DOUBLE + round(CASE WHEN ramp = 0 THEN q1 ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * q1) - (1 - ramp)) / (2 * ramp) END, 9) END AS first_position,
  CASE WHEN taken > 0 THEN 0.0::DOUBLE + round(CASE WHEN ramp = 0 THEN q2 ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * q2) - (1 - ramp)) / (2 * ramp) END, 9) END AS last_position
FROM z
"""

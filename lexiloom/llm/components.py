"""Connected components of a link table, by alternating large-star and small-star.

Every step is a pre-aggregated ``min`` and an equi-join, in which a star's hot centre is
dealt over several tasks; the link table of each round is written to the shared folder, so
lineage stays short. It ends when the links are stars. Nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch, spread_join


def _large(links: DataFrame, total: int) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    met = spread_join(both.where("b > a"), least.select("a", F.least("a", "m").alias("m")), "a", 2 * total, counts=least.select("a", "n"))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame, total: int) -> DataFrame:
    """Links have a > b here."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    met = spread_join(links, least.select("a", "m"), "a", total, counts=least.select("a", "n"))
    near = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(links: DataFrame) -> tuple[int, int]:
    """How many nodes keep the links from being stars, and how many links there are.

    In stars a node has one link to a smaller one, or is what others link to, but not both; then every centre is its
    component's smallest node. Nodes are pre-aggregated, so a hot centre is one row a task.
    """
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum(F.expr("CAST(up > 1 OR up * down > 0 AS BIGINT)")), F.lit(0)), F.coalesce(F.sum("up"), F.lit(0))).first())


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` has columns a and b (self-links are left out).

    The root is the smallest node of the component. An empty table gives no rows.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(now, "links")
    while True:
        odd, n = _unfinished(now)
        if not odd:
            break
        before, now = now, scratch.keep(_small(_large(now, n), n), "links")
        scratch.drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

"""Scores of an extraction: presence, judge ratings, and their mean. Aggregates only."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import runtime

JUDGE_BEST = 5


def presence(targets: DataFrame, found: Column, wanted: Column, by: list[str]) -> DataFrame:
    """Per group: percent of must-have targets that were found, and of must-not-have ones that were not."""
    hit = lambda c: F.sum(c.cast("long"))
    return targets.groupBy(*by).agg(
        T.percent(hit(found & wanted), hit(wanted)).alias("must_have"),
        T.percent(hit(~found & ~wanted), hit(~wanted)).alias("must_not_have"),
    )


def ratings_percent(rated: DataFrame, rating: str, by: list[str]) -> DataFrame:
    """Per group: sum of ratings in percent of the best possible."""
    return rated.groupBy(*by).agg(T.percent(F.sum(rating), F.lit(JUDGE_BEST) * F.count(rating)).alias("rating_percent"))


def overall(scores: DataFrame, parts: list[list[str]]) -> DataFrame:
    """Mean of the means of each list of columns, two decimals at each step."""

    def mean(values):
        total = values[0]
        for v in values[1:]:
            total = total + v
        return F.bround(total / len(values), 2)

    return scores.withColumn("overall", mean([mean([F.col(c) for c in p]) for p in parts]))


def judgement(reply: str | None) -> tuple[int, str]:
    """(rating, justification) of a judge's reply; (0, "") for anything unusable."""
    try:
        got = json.loads(reply or "")
        rating = got["rating"]
        if isinstance(rating, bool) or not isinstance(rating, int) or not 0 <= rating <= JUDGE_BEST:
            return 0, ""
        return rating, str(got.get("justification", ""))
    except (ValueError, TypeError, KeyError):
        return 0, ""


def judged(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The same over a table of replies, as expressions."""
    v = F.try_parse_json(F.col(reply))
    rating = F.try_variant_get(v, "$.rating", "int")
    exact = F.schema_of_variant(F.try_variant_get(v, "$.rating", "variant")) == "BIGINT"
    good = exact & rating.between(0, JUDGE_BEST)
    return replies.withColumn("rating", F.coalesce(F.when(good, rating), F.lit(0))).withColumn("why", F.coalesce(F.when(good, F.try_variant_get(v, "$.justification", "string")), F.lit("")))


def items_block(items: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group, its values as numbered lines; 'No items extracted' where there are none."""
    rows = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("item_idx", value)))).alias("__v"))
    lines = F.transform("__v", lambda x: F.concat((x["item_idx"] + 1).cast("string"), F.lit(". "), x[value].cast("string")))
    return rows.select(*by, F.when(F.size("__v") > 0, F.array_join(lines, "\n")).otherwise("No items extracted").alias("block"))


#: Characters of passages that one automaton, and so one scan of the documents, takes.
PASSAGE_CHARS = 64_000_000


def passages_in(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, doc_id) of documents that hold a passage whole; ``passages``: (item_id, passage).

    All passages are looked for in one pass over each text (an Aho-Corasick automaton, made once a worker). Passages
    are a test set, kept on the driver by ``PASSAGE_CHARS`` at a time; a larger set takes several scans. Empty ones are
    in every text.
    """
    runtime.prepare(docs.sparkSession)
    ddl = "item_id long, doc_id long"
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])
    found, held, size = [], [], 0

    def scan(part: list) -> DataFrame:
        def work(batches):
            import ahocorasick

            machine, ids, always = ahocorasick.Automaton(), {}, []
            for item, passage in part:
                (ids.setdefault(passage, []) if passage else always).append(item)
            for passage in ids:
                machine.add_word(passage, passage)
            if ids:
                machine.make_automaton()
            for batch in batches:
                rows = []
                for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if body is not None:
                        hits = {p for _, p in machine.iter(body)} if ids else ()
                        rows += [(item, doc) for item in (*always, *(i for p in hits for i in ids[p]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, ddl)

    for row in passages.where("passage IS NOT NULL").select(F.col("item_id").cast("long"), "passage").toLocalIterator():
        held.append(tuple(row))
        size += len(row["passage"])
        if size > PASSAGE_CHARS:
            found, held, size = [*found, scan(held)], [], 0
    found.append(scan(held))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def benchmark(items: DataFrame, targets: DataFrame, replies: DataFrame | None = None, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """From extracted items to scores: per group must_have, must_not_have, rating_percent and overall.

    ``targets``: (doc_id, owner, wanted, *by) says which owners should have items in which documents; ``replies``: (doc_id, owner,
    reply) of a judge, for wanted targets that were found (none: presence only).
    """
    found = items.select("doc_id", "owner").distinct().withColumn("__found", F.lit(True))
    met = targets.join(found, ["doc_id", "owner"], "left").withColumn("__found", F.coalesce("__found", F.lit(False)))
    scores = presence(met, F.col("__found"), F.col("wanted"), list(by))
    if replies is None:
        return overall(scores, [["must_have", "must_not_have"]])
    rated = judged(met.where("wanted AND __found").join(replies, ["doc_id", "owner"], "left"))
    both = scores.join(ratings_percent(rated, "rating", list(by)), list(by), "left").na.fill(0.0, ["rating_percent"])
    return overall(both, [["must_have", "must_not_have"], ["rating_percent"]])


def read_targets(spark, path: str) -> DataFrame:
    """(doc_id, text, owner, category, wanted) from JSON files of a benchmark: {"doc_id", "text", "targets": [{"owner", "category", "wanted"}]}."""
    rows = spark.read.schema("doc_id long, text string, targets array<struct<owner:string,category:string,wanted:boolean>>").option("multiLine", True).json(path)
    return rows.select("doc_id", "text", F.explode("targets").alias("t")).select("doc_id", "text", "t.*")

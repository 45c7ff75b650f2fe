"""Structured Streaming over the same operators: new documents, call windows, chat state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import segment


def document_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def paragraph_stream(docs: DataFrame) -> DataFrame:
    """Paragraphs of a stream of documents; stateless."""
    return segment.paragraphs(docs)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Process what is there once, exactly once into Parquet, and stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Rows with a watermark; times without a zone are taken in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(calls: DataFrame, ts: str, key: str, value: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and window; rows later than ``late`` behind the newest are dropped."""
    w = F.window(ts, width)
    return timed(calls, ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sliding(calls: DataFrame, ts: str, key: str, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, step)
    return timed(calls, ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(calls: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of rows less than ``gap`` apart."""
    return timed(calls, ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def first_seen(rows: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Without repeats that come within the watermark: what has been processed is not processed again."""
    return timed(rows, ts, late).dropDuplicatesWithinWatermark(keys)


def chat_state(messages: DataFrame) -> DataFrame:
    """Running turn and user-message counts per conversation, kept as keyed state (append-only sessions)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        turns, users = state.get if state.exists else (0, 0)
        for pdf in batches:
            turns, users = turns + len(pdf), users + int((pdf["role"] == "user").sum())
        state.update((turns, users))
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [turns], "n_users": [users]})

    return messages.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, n_turns long, n_users long", "n_turns long, n_users long", "update", GroupStateTimeout.NoTimeout)

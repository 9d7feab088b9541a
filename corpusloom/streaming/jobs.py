"""Structured Streaming: postings that grow with arriving texts, and event counts by window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..session import shared_dir


def grow_postings(spark: SparkSession, source: str, schema: str, sink: str, state: str, n: int = 1):
    """Appends (doc_id, token, tf) of texts as their files arrive; each file's rows are written once, whatever fails in between.

    Texts are whole within a file, so counting is within the batch and needs no state.
    """
    texts = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        each = batch.where("text is not null").select("doc_id", F.explode(ngrams(tokens(F.col("text")), n)).alias("token"))
        each.groupBy("doc_id", "token").agg(F.count("*").alias("tf")).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): events by tumbling window, in a stream with a watermark."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counted = events.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): events by session, which ends after a gap."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    counted = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and gives its result as a table in the shared folder."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")

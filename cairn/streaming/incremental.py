"""Term statistics kept up to date as documents arrive (Structured Streaming).

Batch and stream share one definition: each micro-batch is counted by the batch operators and its partial counts are
appended to a Parquet log; reading the log sums them. Counts are sums, so late or repeated batches never recount
what is stored, and a batch that is retried overwrites its own partition only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.text import document_frequency, term_frequency


def count_stream(docs: DataFrame, key: str, text: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start counting a stream of (key, text) documents into ``store``; each document is expected once."""

    def add(batch: DataFrame, number: int) -> None:
        tf = term_frequency(batch, key, text)
        words = document_frequency(tf).join(tf.groupBy("word").agg(F.sum("tf").alias("total")), "word")
        words.write.mode("overwrite").parquet(f"{store}/words/batch={number}")
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{store}/size/batch={number}")

    writer = docs.select(key, text).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_words(spark: SparkSession, store: str) -> DataFrame:
    """(word, df, total) over all batches so far."""
    return spark.read.parquet(f"{store}/words").groupBy("word").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def current_size(spark: SparkSession, store: str) -> DataFrame:
    """One row ``n``: documents so far."""
    return spark.read.parquet(f"{store}/size").agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, time: str, key: str, store: str, checkpoint: str, width: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Start counting a stream into ``store`` by tumbling windows on event time; rows count however late they arrive."""

    def add(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        counted.select(F.col("w.start").alias("start"), "key", "n").write.mode("overwrite").parquet(f"{store}/windows/batch={number}")

    writer = events.select(time, key).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_windows(spark: SparkSession, store: str) -> DataFrame:
    """(start, key, n) over all batches so far."""
    return spark.read.parquet(f"{store}/windows").groupBy("start", "key").agg(F.sum("n").alias("n"))

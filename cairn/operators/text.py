"""Term statistics over (document, text) tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import words


def term_frequency(docs: DataFrame, key: str, text: str, tokenizer: Callable[[Column], Column] = words, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, word, tf). ``tokenizer`` turns a text column into an array of words, ``keep`` filters words (say, nouns)."""
    tokens = docs.select(key, F.explode(tokenizer(F.col(text))).alias("word"))
    if keep is not None:
        tokens = tokens.where(keep(F.col("word")))
    return tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(word, df) of a (key, word, tf) table: one count per document that has the word."""
    return tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(tf: DataFrame, key: str) -> DataFrame:
    """One row ``n``: documents with at least one word."""
    return tf.groupBy(key).agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, key: str, top: int | None) -> DataFrame:
    if top is None:
        return df
    window = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col("word"))
    # Spark keeps the first rows of each group before the shuffle (window group limit)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def tfidf(tf: DataFrame, key: str, top: int | None = 50) -> DataFrame:
    """(key, word, score): trunc(100 tf ln(n / (df + 1))), the ``top`` words per document by weight, then word."""
    joined = tf.join(document_frequency(tf), "word", "left").crossJoin(F.broadcast(corpus_size(tf, key)))
    weight = F.col("tf") * F.log(F.col("n") / (F.coalesce("df", F.lit(0)) + 1))
    ranked = _ranked(joined.withColumn("weight", weight), key, top)
    return ranked.select(key, "word", (F.col("weight") * 100).cast("bigint").alias("score"))


def idf_reweight(counts: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """(key, word, weight): tf ln(n / df) of a count table, rounded to 4 places; optionally the ``top`` per key."""
    joined = counts.join(document_frequency(counts), "word").crossJoin(F.broadcast(corpus_size(counts, key)))
    ranked = _ranked(joined.withColumn("weight", F.col("tf") * F.log(F.col("n") / F.col("df"))), key, top)
    return ranked.select(key, "word", F.round("weight", 4).alias("weight"))

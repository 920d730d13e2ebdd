"""Writers of the result tables: Parquet stores, TAB-separated rows, packed adjacency, folds, sparse bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.factorize import fold_of
from cairn.sources.readers import pack_edges


def store(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """A Parquet table keyed by its first column."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One TAB-separated line per row; nulls are empty."""
    line = F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]), "\t")
    df.select(line.alias("value")).write.mode(mode).text(path)


def pairs_line(df: DataFrame, key: str, name: str, value: str, order: Column | None = None, limit: int | None = None, delimiter: str = "\t", joint: str = "\t") -> DataFrame:
    """(value): per key one line ``key TAB name value ...`` in ``order`` (default: name), at most ``limit`` pairs.

    ``joint`` stands between name and value, ``delimiter`` between pairs: ``word TAB tf`` or ``word:tf`` records.
    """
    sort = F.col(name) if order is None else order
    listed = F.array_sort(F.collect_list(F.struct(sort.alias("o"), F.col(name).cast("string").alias("n"), F.col(value).cast("string").alias("v"))))
    if limit is not None:
        listed = F.slice(listed, 1, limit)
    body = F.array_join(F.transform("e", lambda e: F.concat(e["n"], F.lit(joint), e["v"])), delimiter)
    return df.groupBy(key).agg(listed.alias("e")).select(F.concat(F.col(key).cast("string"), F.lit("\t"), body).alias("value"))


def term_table(tf: DataFrame, path: str, key: str, colon: bool = False) -> None:
    """Words by tf descending of each document, ``word TAB tf`` or ``word:tf`` pairs."""
    pairs_line(tf, key, "word", "tf", -F.col("tf"), joint=":" if colon else "\t").write.mode("overwrite").text(path)


def adjacency(edges: DataFrame, path: str) -> None:
    """(src, data): packed target lists."""
    store(pack_edges(edges), path)


def dictionaries(dictionary: DataFrame, directory: str) -> None:
    """The keyword dictionary keyed either way."""
    store(dictionary.select("keyword", "id"), f"{directory}/keyword2id")
    store(dictionary.select("id", "keyword"), f"{directory}/id2keyword")


def factor_matrix(factors: DataFrame, path: str, key: str, digits: int = 2) -> None:
    """``key TAB f1 TAB f2 ...`` with ``digits`` decimals."""
    text = F.array_join(F.transform("f", lambda x: F.format_string(f"%.{digits}f", x)), "\t")
    factors.select(F.concat(F.col(key).cast("string"), F.lit("\t"), text).alias("value")).write.mode("overwrite").text(path)


def recommendations(ranked: DataFrame, path: str) -> None:
    """``user TAB item TAB item ...`` by rank."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("item").cast("string").alias("i"))))
    lines = ranked.groupBy("user").agg(listed.alias("e")).select(F.concat(F.col("user").cast("string"), F.lit("\t"), F.array_join(F.transform("e", lambda e: e["i"]), "\t")).alias("value"))
    lines.write.mode("overwrite").text(path)


def folds(ratings: DataFrame, path: str, count: int, seed: int = 1) -> None:
    """The ratings partitioned by test fold; fold i's training set is all other partitions."""
    marked = ratings.withColumn("fold", fold_of(F.concat_ws("|", "user", "item"), count, seed))
    store(marked, path, partition_by=["fold"])


def classified_bags(bags: DataFrame, split: DataFrame, path: str, key: str, label: str, word: str, n: str) -> None:
    """``label TAB word TAB n ...`` lines of the train and test rows, in one directory each."""
    named = bags.join(split.select(key, F.col(label).alias("__label"), "split"), key).withColumn("__key", F.col(key))
    for side in ("train", "test"):
        lines = pairs_line(named.where(F.col("split") == side).select("__key", F.struct("__label", word).alias("w"), word, n, "__label").withColumnRenamed(word, "__word"), "__key", "__word", n)
        labelled = lines.select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].alias("k"), F.col("p")[1].alias("rest"))
        keys = split.select(F.col(key).cast("string").alias("k"), F.col(label).cast("string").alias("l"))
        labelled.join(keys, "k").select(F.concat_ws("\t", F.coalesce("l", F.lit("")), "rest").alias("value")).write.mode("overwrite").text(f"{path}/{side}")

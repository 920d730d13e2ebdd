"""Global ranks and positional neighbours without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.runtime import cut


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with its 0-based position in ``order`` (a unique key).

    Rows are range-partitioned and sorted inside their partitions; a position is the row's place in its partition
    plus the sizes of the partitions before it. Only one row per partition is ever brought together.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("__p", (before - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shift), "__p").withColumn(name, F.col("__m") + F.col("shift")).drop("__p", "__m", "shift")


def neighbours(ranked: DataFrame, group: str, key: str, reach: int, rank: str = "rank", bucket: int = 10_000) -> DataFrame:
    """(group, a, b): rows of one ``group`` at most ``reach`` positions apart, each pair once.

    Positions are cut into buckets; the first ``reach`` rows of a bucket are also shown to the bucket before, so
    every window sees its neighbours and no window holds more than ``bucket + reach`` rows.
    """
    home = F.floor(F.col(rank) / bucket)
    early = F.when(F.col(rank) % bucket < reach, F.array(home, home - 1)).otherwise(F.array(home))
    shown = ranked.select(F.col(group).alias("g"), F.col(key).alias("a"), F.col(rank).alias("r"), home.alias("home"), F.explode(early).alias("bucket"))
    window = Window.partitionBy("bucket").orderBy("r").rowsBetween(1, reach)
    near = shown.withColumn("near", F.collect_list(F.struct("g", "a")).over(window)).where("home = bucket")
    return near.select("g", "a", F.explode("near").alias("n")).where("g = n.g").select(F.col("g").alias(group), "a", F.col("n.a").alias("b"))


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str = "upto") -> DataFrame:
    """``df`` with the running sum of ``value`` up to and including each row in ``order`` (a unique key).

    Each range partition sums its own rows; the totals of the partitions before are added.
    """
    placed = cut(df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("__p")))
    sums = placed.groupBy("__p").agg(F.sum(value).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__in", inside).join(F.broadcast(sums.select("__p", before.alias("__before"))), "__p").withColumn(name, F.col("__in") + F.col("__before")).drop("__p", "__in", "__before")


def run_groups(df: DataFrame, order: Sequence[str], key: str, name: str = "run") -> DataFrame:
    """``df`` with the number (from 1) of its run: consecutive rows in ``order`` (a unique key) with one ``key``; nulls are equal.

    A row begins a run unless its key is that of the row one position before, found by a join on positions.
    """
    ranked = cut(global_rank(df, order, "__at"))
    before = ranked.select((F.col("__at") + 1).alias("__at"), F.col(key).alias("__before"), F.lit(1).alias("__held"))
    begun = F.when(F.col("__held").isNull() | ~F.col(key).eqNullSafe(F.col("__before")), 1).otherwise(0)
    marked = ranked.join(before, "__at", "left").withColumn("__new", begun).drop("__before", "__held")
    return running_total(marked, ["__at"], "__new", name).drop("__at", "__new")

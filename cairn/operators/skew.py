"""Per-key results without imbalance when a handful of keys holds most rows.

Rows are range-partitioned on the composite key (keys..., secondary order...). Spark samples the quantiles of
that composite key, so partition boundaries fall *inside* a heavy key as often as its share of the rows asks
for: a key with a third of all rows is spread over a third of the partitions. Each partition then folds its
rows into partial states; a key inside one partition has one state, a key cut by boundaries one per partition
it spans, and the states of the same key are stitched by merging them. Only states (one per key and partition)
cross the network a second time.

The secondary order also carries exact distinct counts: equal (key, order) tuples always share a partition, so
distinct order values are counted per partition and simply summed at the stitch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.runtime import shuffle_width


def range_stitched_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    count: str = "n_rows",
    distinct: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Aggregate ``df`` per ``keys`` by range partitioning on (keys, order) and stitching boundary states.

    ``sums`` / ``maxima`` map result names to row expressions. ``count`` names the row count, ``distinct`` (if
    given) the number of distinct non-null ``order`` values of the key.

    Defined cases: null keys form a key of their own (as in GROUP BY); null measures are skipped, a sum or
    maximum over nulls only is null; a null ``order`` counts as a row but not as a distinct value; exact
    duplicates count as rows; an empty input gives no rows; extra columns of any name are dropped before the
    shuffle. A key can be split down to its distinct ``order`` values; rows of one key and one order value stay
    together and are folded as they stream by, never gathered.
    """
    sums, maxima = sums or {}, maxima or {}
    named = {**{f"s{i}": e for i, e in enumerate(sums.values())}, **{f"m{i}": e for i, e in enumerate(maxima.values())}}
    k = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.col(order).alias("o"), *[e.alias(a) for a, e in named.items()])
    ranged = slim.repartitionByRange(partitions or shuffle_width(df.sparkSession), *k, "o")
    folds = [F.count(F.lit(1)).alias("n")]
    folds += [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))] + [F.max(f"m{i}").alias(f"m{i}") for i in range(len(maxima))]
    # satisfied by the range partitioning itself: no exchange between the scan side and these states
    per_value = ranged.groupBy(*k, "o").agg(*folds)
    stitch = [F.sum("n").alias(count)]
    if distinct:
        stitch.append(F.count("o").alias(distinct))
    stitch += [F.sum(f"s{i}").alias(a) for i, a in enumerate(sums)] + [F.max(f"m{i}").alias(a) for i, a in enumerate(maxima)]
    return per_value.groupBy(*k).agg(*stitch).withColumnsRenamed(dict(zip(k, keys, strict=True)))

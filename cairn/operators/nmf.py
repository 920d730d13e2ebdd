"""Non-negative matrix factorization by multiplicative updates on long-form cells (row, col, x).

V ~ W H. Each update needs W'V and V H' (one join and one partial sum each) and the k x k Gram matrices W'W and H H',
which are single-row aggregates: no product of the size of V is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.seeded import uniform
from cairn.runtime import cut


def _random(cells: DataFrame, key: str, k: int, seed: int, side: str) -> DataFrame:
    return cells.select(key).distinct().select(key, F.array(*[uniform(key, f"{seed}-{side}{i}") for i in range(k)]).alias("f"))


def frobenius(factors: DataFrame, key: str, k: int) -> DataFrame:
    """Factors scaled so that the whole matrix has Frobenius norm 1."""
    size = factors.agg(F.sqrt(F.sum(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))).alias("size"))
    return factors.crossJoin(F.broadcast(size)).select(key, F.transform("f", lambda x: F.coalesce(F.try_divide(x, F.col("size")), x)).alias("f"))


def _gram(factors: DataFrame, k: int) -> DataFrame:
    """One row: g[i][j] = sum f_i f_j."""
    return factors.agg(F.array(*[F.array(*[F.sum(F.col("f")[i] * F.col("f")[j]) for j in range(k)]) for i in range(k)]).alias("g"))


def _updated(factors: DataFrame, key: str, products: DataFrame, gram: DataFrame, k: int) -> DataFrame:
    def one(i: int) -> Column:
        below = sum((F.col("f")[j] * F.col("g")[j][i] for j in range(1, k)), F.col("f")[0] * F.col("g")[0][i])
        return F.when(below > 0, F.col("f")[i] * F.col("v")[i] / below).otherwise(F.col("f")[i])

    return factors.join(products, key).crossJoin(F.broadcast(gram)).select(key, F.array(*[one(i) for i in range(k)]).alias("f"))


def factorize(cells: DataFrame, k: int, iterations: int = 50, seed: int = 1, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """((row, f), (col, f)) with f ARRAY<DOUBLE>(k) after ``iterations`` simultaneous updates.

    Factors start uniform in [0, 1) (seeded by their keys), W is scaled to Frobenius norm 1 at start and end, H after
    every update; a zero denominator leaves a factor as it is. Lineage is cut every ``every`` updates.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    cells = cut(cells.select("row", "col", F.col("x").cast("double").alias("x")))
    w = frobenius(_random(cells, "row", k, seed, "w"), "row", k)
    h = _random(cells, "col", k, seed, "h")

    def products(side: DataFrame, on: str, by: str) -> DataFrame:
        return cells.join(side, on).groupBy(by).agg(F.array(*[F.sum(F.col("x") * F.col("f")[i]) for i in range(k)]).alias("v"))

    for step in range(iterations):
        new_h = frobenius(_updated(h, "col", products(w, "row", "col"), _gram(w, k), k), "col", k)
        w = _updated(w, "row", products(h, "col", "row"), _gram(h, k), k)
        h = new_h
        if step % every == every - 1 or step == iterations - 1:
            w, h = cut(w), cut(h)
    return frobenius(w, "row", k), h


def stored_error(cells: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """One row ``error``: the squared error over the stored cells."""
    both = cells.join(w.withColumnRenamed("f", "wf"), "row").join(h.withColumnRenamed("f", "hf"), "col")
    guess = F.aggregate(F.zip_with("wf", "hf", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return both.agg(F.sum(F.pow(F.col("x") - guess, 2)).alias("error"))

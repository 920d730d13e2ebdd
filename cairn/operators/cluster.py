"""k-means family: seeding, dense, sparse (cosine or Euclid), constrained. k and the dimension are model parameters;
dense centroids (k x dimension numbers) live on the driver, sparse ones stay a distributed long table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.seeded import digest, uniform
from cairn.functions.vectors import argmin, literal, nearest, squared_euclid
from cairn.runtime import cut, is_empty

Distance = Callable[[Column, Column], Column]


def check_k(k: int, count: int | None = None) -> None:
    if k < 1 or count is not None and k > count:
        raise ValueError("k must be at least 1 and at most the number of rows")


def seed_centroids(points: DataFrame, k: int, seed: int = 1, distance: Distance = squared_euclid) -> list[list[float]]:
    """k-means++ seeding of (key, v): the first by seeded choice, then each with probability proportional to the
    distance to the nearest centroid so far.

    A row is drawn by an exponential race: the smallest -ln(u) / weight wins, which picks rows in proportion to
    their weights with one mergeable minimum instead of a running sum.
    """
    check_k(k)
    first = points.agg(F.min_by("v", F.struct(digest("key", seed), F.col("key"))).alias("v")).first()["v"]
    centroids = [] if first is None else [list(first)]
    while centroids and len(centroids) < k:
        weight = F.array_min(F.array(*[distance(F.col("v"), literal(c)) for c in centroids]))
        race = -F.log(F.greatest(uniform("key", f"{seed}-{len(centroids)}"), F.lit(1e-300))) / weight
        row = points.where(weight > 0).agg(F.min_by("v", F.struct(race, F.col("key"))).alias("v")).first()["v"]
        if row is None:
            break  # fewer distinct points than k
        centroids.append(list(row))
    return centroids


def random_centroids(points: DataFrame, k: int, seed: int = 1) -> list[list[float]]:
    """k distinct rows by seeded choice."""
    check_k(k)
    return [list(r["v"]) for r in points.orderBy(digest("key", seed), "key").limit(k).collect()]


def roulette(points: DataFrame, weight: Column, share: float, key: str = "key") -> DataFrame:
    """The row at which the running sum of ``weight``, in seeded order, first reaches ``share`` of the total.

    Running sums go over 256 buckets of the order's first two digits, then inside one bucket only.
    """
    order = digest(key, "roulette")
    rows = points.select(key, weight.alias("w"), order.alias("o"), F.substring(order, 1, 2).alias("b"))
    sums = rows.groupBy("b").agg(F.sum("w").alias("s"))
    before = sums.select("b", (F.sum("s").over(Window.orderBy("b")) - F.col("s")).alias("before"), F.sum("s").over(Window.orderBy("b")).alias("upto"), F.sum("s").over(Window.partitionBy()).alias("total"))
    hit = before.where(F.col("upto") >= F.col("total") * share).orderBy("b").limit(1)
    inside = rows.join(F.broadcast(hit), "b").withColumn("run", F.col("before") + F.sum("w").over(Window.partitionBy("b").orderBy("o", key)))
    return inside.where(F.col("run") >= F.col("total") * share).orderBy("o", key).limit(1).select(key)


def assign(points: DataFrame, centroids: Sequence[Sequence[float]], distance: Distance = squared_euclid) -> DataFrame:
    """(key, v, cluster): the nearest centroid, ties to the lowest index. One projection, no join."""
    return points.select("key", "v", nearest("v", centroids, distance).alias("cluster"))


def update(assigned: DataFrame, centroids: Sequence[Sequence[float]], empty: str = "keep") -> list[list[float]]:
    """Cluster means; an empty cluster keeps its centroid or becomes the zero vector."""
    size = len(centroids[0])
    rows = assigned.groupBy("cluster").agg(*[F.avg(F.col("v")[i]).alias(f"x{i}") for i in range(size)]).collect()  # k rows
    means = {r["cluster"]: [r[f"x{i}"] for i in range(size)] for r in rows}
    return [means.get(c, list(old) if empty == "keep" else [0.0] * size) for c, old in enumerate(centroids)]


def kmeans(points: DataFrame, k: int, iterations: int = 100, init: str = "smart", distance: Distance = squared_euclid, empty: str = "keep", seed: int = 1) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd iterations until no assignment changes: ((key, v, cluster), centroids). More clusters than rows raise ValueError, no rows give none."""
    points = cut(points.select("key", "v"))  # read once, walked many times
    check_k(k, points.count() or None)
    centroids = seed_centroids(points, k, seed, distance) if init == "smart" else random_centroids(points, k, seed)
    if not centroids:
        return points.select("key", "v", F.lit(0).alias("cluster")).limit(0), []
    for _ in range(iterations):
        moved = update(assign(points, centroids, distance), centroids, empty)
        changed = moved != centroids and not is_empty(points.where(nearest("v", moved, distance) != nearest("v", centroids, distance)))
        centroids = moved
        if not changed:
            break
    return assign(points, centroids, distance), centroids


# ---------------------------------------------------------------- sparse


def _sparse_distances(entries: DataFrame, sizes: DataFrame, centroids: DataFrame, k: int, cosine: bool) -> DataFrame:
    """(key, cluster, d) of every point and cluster: one join on the dimension and two sums."""
    lengths = centroids.groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("c2"))
    shared = entries.join(centroids, "dim").groupBy("key", "cluster").agg(F.sum(F.col("y") * F.col("x")).alias("dot"))
    every = sizes.select("key", "a2", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    joined = every.join(shared, ["key", "cluster"], "left").join(F.broadcast(lengths), "cluster", "left")
    dot, c2 = F.coalesce("dot", F.lit(0.0)), F.coalesce("c2", F.lit(0.0))
    d = 1 - F.coalesce(F.try_divide(dot, F.sqrt(F.col("a2") * c2)), F.lit(0.0)) if cosine else F.col("a2") + c2 - 2 * dot
    return joined.select("key", "cluster", d.alias("d"))


def kmeans_sparse(entries: DataFrame, k: int, iterations: int = 10, cosine: bool = True, init: str = "smart", empty: str = "keep", seed: int = 1, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """k-means of (key, dim, y) vectors: ((key, cluster), centroids (cluster, dim, x)).

    Centroids are arithmetic means over the cluster's members, absent dimensions 0. ``init="smart"`` seeds with
    probability proportional to the distance (cosine) or squared distance. Distances are rounded to ``digits``
    before the nearest is taken, ties to the lowest index, so sums in another order can't change an assignment.
    """
    check_k(k)
    entries = cut(entries.where("y <> 0").select("key", "dim", "y"))
    sizes = cut(entries.groupBy("key").agg(F.sum(F.col("y") * F.col("y")).alias("a2")))
    check_k(k, sizes.count() or None)
    order = F.struct(digest("key", seed), F.col("key"))

    def rows_of(keys: list[str]) -> DataFrame:
        names = entries.sparkSession.createDataFrame([(i, key) for i, key in enumerate(keys)], "cluster int, key string")  # k rows
        return entries.join(F.broadcast(names), "key").select("cluster", "dim", F.col("y").alias("x"))

    if init == "smart":
        first = sizes.agg(F.min_by("key", order).alias("k")).first()["k"]
        keys = [] if first is None else [first]
        while keys and len(keys) < k:
            near = _sparse_distances(entries, sizes, rows_of(keys), len(keys), cosine).groupBy("key").agg(F.min(F.round("d", digits)).alias("w"))
            race = -F.log(F.greatest(uniform("key", f"{seed}-{len(keys)}"), F.lit(1e-300))) / F.col("w")
            row = near.where("w > 0").agg(F.min_by("key", F.struct(race, F.col("key"))).alias("k")).first()["k"]
            if row is None:
                break
            keys.append(row)
    else:
        keys = [r["key"] for r in sizes.orderBy(digest("key", seed), "key").limit(k).collect()]
    centroids, found, labels = rows_of(keys), len(keys), None
    for _ in range(iterations):
        nearest_one = _sparse_distances(entries, sizes, centroids, found, cosine).groupBy("key").agg(F.min(F.struct(F.round("d", digits).alias("d"), F.col("cluster"))).alias("m"))
        new = cut(nearest_one.select("key", F.col("m.cluster").alias("cluster")))
        if labels is not None and is_empty(new.join(labels.withColumnRenamed("cluster", "old"), "key").where("cluster <> old")):
            labels = new
            break
        labels = new
        counts = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        means = entries.join(labels, "key").groupBy("cluster", "dim").agg(F.sum("y").alias("s")).join(F.broadcast(counts), "cluster").select("cluster", "dim", (F.col("s") / F.col("n")).alias("x"))
        kept = centroids.join(F.broadcast(counts), "cluster", "left_anti") if empty == "keep" else centroids.limit(0)
        centroids = cut(means.unionByName(kept))
    if labels is None:
        labels = sizes.select("key", F.lit(0).alias("cluster")).limit(0)
    return labels, centroids


# ---------------------------------------------------------------- constrained


class Infeasible(ValueError):
    """The constraints contradict each other, or no cluster was left for a point."""


def must_closure(constraints: DataFrame) -> DataFrame:
    """(key, block): points joined by must pairs share the smallest key among them as their block.

    Each round takes the smallest block among the neighbours, then follows blocks to their own block, so chains of n
    pairs need about log n rounds.
    """
    pairs = cut(constraints.where("kind = 'm'").select("a", "b"))
    labels = cut(pairs.select(F.col("a").alias("key"), F.col("a").alias("block")).union(pairs.select("b", "b")).distinct())
    while True:
        spread = pairs.join(labels, pairs["a"] == labels["key"]).select(F.col("b").alias("key"), "block").unionByName(labels)
        least = spread.groupBy("key").agg(F.min("block").alias("block"))
        ahead = least.select(F.col("key").alias("block"), F.col("block").alias("next"))
        new = cut(least.join(ahead, "block").select("key", F.col("next").alias("block")))
        if is_empty(new.join(labels.withColumnRenamed("block", "old"), "key").where("block <> old")):
            return new
        labels = new


def cop_kmeans(points: DataFrame, constraints: DataFrame, k: int, iterations: int = 10, seed: int = 1) -> DataFrame:
    """(key, cluster) of (key, v) under (a, b, kind m|c) constraints given in both directions.

    Must pairs are closed transitively and assigned as one block; blocks tied by cannot pairs are assigned greedily in
    order of their names, the nearest cluster not held by a cannot partner. Only tied blocks need an order, and only
    within their connected component, so components are worked in parallel and all other points by one projection.
    Contradictions and dead ends raise Infeasible.
    """
    blocks = must_closure(constraints)
    ties = constraints.where("kind = 'c'").select("a", "b")
    for side in ("a", "b"):
        named = blocks.withColumnsRenamed({"key": side, "block": f"{side}_block"})
        ties = ties.join(named, side, "left").withColumn(side, F.coalesce(f"{side}_block", side)).drop(f"{side}_block")
    ties = cut(ties.distinct())
    if not is_empty(ties.where("a = b")):
        raise Infeasible("a cannot pair is joined by must pairs")
    component = must_closure(ties.select("a", "b", F.lit("m").alias("kind"))).select(F.col("key").alias("block"), F.col("block").alias("component"))
    partners = ties.groupBy(F.col("a").alias("block")).agg(F.sort_array(F.collect_set("b")).alias("cannot"))
    placed = points.select("key", "v").join(blocks, "key", "left").withColumn("block", F.coalesce("block", "key"))
    placed = cut(placed.join(component, "block", "left").join(partners, "block", "left"))
    centroids = seed_centroids(points, k, seed)
    labels = None
    for _ in range(iterations):
        distances = F.array(*[squared_euclid(F.col("v"), literal(c)) for c in centroids])
        rows = placed.select("key", "v", "block", "component", "cannot", distances.alias("d"))
        total = F.array(*[F.sum(F.col("d")[i]) for i in range(len(centroids))])
        summed = rows.groupBy("block", "component", "cannot").agg(total.alias("d"))
        free = summed.where("component IS NULL").select("block", argmin([F.col("d")[i] for i in range(len(centroids))]).alias("cluster"))
        tied = summed.where("component IS NOT NULL").groupBy("component").applyInPandas(_assign_component, "block string, cluster int")
        new = cut(free.unionByName(tied))
        if not is_empty(new.where("cluster < 0")):
            raise Infeasible("no cluster is left for a point under its cannot pairs")
        same = labels is not None and is_empty(new.join(labels.withColumnRenamed("cluster", "old"), "block").where("cluster <> old"))
        labels = new
        if same:
            break
        centroids = update(placed.join(labels, "block").select("key", "v", "cluster"), centroids)
    return placed.join(labels, "block").select("key", "cluster")


def _assign_component(pdf: pd.DataFrame) -> pd.DataFrame:
    held: dict[str, int] = {}
    for block, cannot, d in sorted(zip(pdf["block"], pdf["cannot"], pdf["d"], strict=True), key=lambda r: r[0]):
        taken = {held[p] for p in cannot if p in held}
        free = [(x, c) for c, x in enumerate(np.asarray(d)) if c not in taken]
        held[block] = min(free)[1] if free else -1
    return pd.DataFrame({"block": list(held), "cluster": list(held.values())})

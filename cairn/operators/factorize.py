"""Matrix factorization of (user, item, rate) cells: biases, batch and stochastic gradient, prediction, evaluation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.seeded import digest, uniform
from cairn.functions.vectors import dot
from cairn.runtime import cut

MODELS = ("plain", "fixed", "bias", "svdpp")


def global_mean(ratings: DataFrame) -> DataFrame:
    """One row ``mean``."""
    return ratings.agg(F.avg("rate").alias("mean"))


def fixed_biases(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((user, user_bias), (item, item_bias)): mean residual of each user, then of each item after the user's bias."""
    rest = ratings.crossJoin(F.broadcast(global_mean(ratings))).withColumn("rest", F.col("rate") - F.col("mean"))
    users = rest.groupBy("user").agg(F.avg("rest").alias("user_bias"))
    items = rest.join(users, "user").groupBy("item").agg(F.avg(F.col("rest") - F.col("user_bias")).alias("item_bias"))
    return users, items


def with_bias(ratings: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """``ratings`` with ``guess``: mean plus biases learned on ``train`` (default: the ratings); null for unknown ids."""
    train = ratings if train is None else train
    users, items = fixed_biases(train)
    joined = ratings.join(users, "user", "left").join(items, "item", "left").crossJoin(F.broadcast(global_mean(train)))
    return joined.withColumn("guess", F.col("mean") + F.col("user_bias") + F.col("item_bias")).drop("mean", "user_bias", "item_bias")


def random_factors(ratings: DataFrame, key: str, k: int, seed: int = 1) -> DataFrame:
    """(key, f ARRAY<DOUBLE>(k)): uniform in [0, 1), seeded by the key."""
    return ratings.select(key).distinct().select(key, F.array(*[uniform(key, f"{seed}-{key}{i}") for i in range(k)]).alias("f"))


def batch_gradient(ratings: DataFrame, k: int, iterations: int, eta: float = 0.001, lam: float = 0.02, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((user, f), (item, f)) by batch gradient descent: U += eta (sum e V - lam U), V likewise, both from the old values."""
    ratings = cut(ratings.select("user", "item", "rate"))
    u, v = random_factors(ratings, "user", k, seed), random_factors(ratings, "item", k, seed)
    for step in range(iterations):
        both = ratings.join(u.withColumnRenamed("f", "uf"), "user").join(v.withColumnRenamed("f", "vf"), "item")
        both = both.withColumn("e", F.col("rate") - dot("uf", "vf"))

        def moved(side: str, own: str, other: str) -> DataFrame:
            pull = [F.sum(F.col("e") * F.col(other)[i]) for i in range(k)]
            old = [F.first(F.col(own)[i]) for i in range(k)]  # the same in every row of the group
            return both.groupBy(side).agg(F.array(*[o + eta * (p - lam * o) for o, p in zip(old, pull, strict=True)]).alias("f"))

        u, v = moved("user", "uf", "vf"), moved("item", "vf", "uf")
        if step % 4 == 3 or step == iterations - 1:
            u, v = cut(u), cut(v)
    return u, v


# ---------------------------------------------------------------- stochastic gradient


def _kernel(k: int, model: str, eta: float, lam: float, total: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One block: visit its cells by (user, item) and update factors in place.

    Rows are tagged: r = a rating, u / i = a user's / item's state (factors, bias, implicit factors), m = the mean with the
    number of updates done so far. Step t uses eta / (1 + t / total).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].iloc[0]
        state = {tag: {key: [np.array(x[:k]), x[k], np.array(x[k + 1 :])] for key, x in zip(part["a"], part["x"], strict=True)} for tag, part in pdf[pdf["tag"].isin(["u", "i"])].groupby("tag")}
        users, items = state.get("u", {}), state.get("i", {})
        mean, t = map(float, pdf[pdf["tag"] == "m"]["x"].iloc[0][:2])
        cells = pdf[pdf["tag"] == "r"].sort_values(["order", "b"], kind="stable")
        own: dict[str, list[str]] = {}
        if model == "svdpp":
            for a, b in zip(cells["a"], cells["b"], strict=True):
                own.setdefault(a, []).append(b)
        for a, b, r in zip(cells["a"], cells["b"], cells["rate"], strict=True):
            step = eta / (1 + t / total)
            t += 1
            u, v = users[a], items[b]
            if model == "svdpp":
                share = 1 / math.sqrt(len(own[a]))
                implicit = share * sum(items[j][2] for j in own[a])
                e = r - (mean + u[1] + v[1] + float((u[0] + implicit) @ v[0]))
                u[0] = u[0] + step * (e * v[0] - lam * u[0])
                v[0] = v[0] + step * (e * (u[0] + implicit) - lam * v[0])
                for j in own[a]:
                    items[j][2] = items[j][2] + step * (e * share * v[0] - lam / 2 * items[j][2])
            else:
                base = 0.0 if model == "plain" else mean + u[1] + v[1]
                e = r - (base + float(u[0] @ v[0]))
                u[0] = u[0] + step * (e * v[0] - lam * u[0])
                v[0] = v[0] + step * (e * u[0] - lam * v[0])
            if model in ("bias", "svdpp"):
                mean += step * e
                u[1] += step * (e - lam * u[1])
                v[1] += step * (e - lam * v[1])
        out = [(block, tag, key, [*map(float, s[0]), float(s[1]), *map(float, s[2])]) for tag, side in (("u", users), ("i", items)) for key, s in side.items()]
        return pd.DataFrame([*out, (block, "m", "", [mean, t])], columns=["block", "tag", "a", "x"])

    return run


def stochastic_gradient(ratings: DataFrame, k: int, epochs: int, model: str = "bias", eta: float = 0.01, lam: float = 0.02, seed: int = 1, blocks: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, items, mean): (user, f, bias), (item, f, bias, y) and one row ``mean``.

    ``model``: plain; fixed (biases of ``fixed_biases``, not learned); bias (mean and biases learned); svdpp (implicit
    feedback besides). ``blocks=1`` visits all cells in one task in order of user, then item, as a sequential program
    does: a reference order for small tables. ``blocks=n``, which every query uses, is distributed stratified descent:
    users and items fall into n groups each, and the n blocks of a stratum share no user or item, so they run in parallel; n strata make an epoch. The implicit set of svdpp is then the
    user's items inside the block.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    kind = ratings.schema["item"].dataType.simpleString()
    user_kind = ratings.schema["user"].dataType.simpleString()
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells = cut(ratings.select(F.col("user").cast("string").alias("a"), F.col("item").cast("string").alias("b"), F.col("rate").cast("double").alias("rate"), F.col("user").cast("double").alias("order")))
    total = max(1, cells.count())
    ratings = cells.select(F.col("a").cast(user_kind).alias("user"), F.col("b").cast(kind).alias("item"), "rate")  # read from the table written above
    users, items = fixed_biases(ratings) if model != "plain" else (None, None)
    zero = F.lit(0.0)
    state = []
    for tag, key, biases, name in (("u", "user", users, "user_bias"), ("i", "item", items, "item_bias")):
        f = random_factors(ratings, key, k, seed)
        f = f.join(biases, key) if model == "fixed" else f.withColumn(name, zero)
        extra = [uniform(key, f"{seed}-y{i}") for i in range(k)] if model == "svdpp" and tag == "i" else []
        state.append(f.select(F.lit(tag).alias("tag"), F.col(key).cast("string").alias("a"), F.concat("f", F.array(F.col(name), *extra)).alias("x")))
    state = cut(state[0].unionByName(state[1]))
    first = global_mean(ratings).first()["mean"]
    mean, done = (0.0 if first is None else float(first)), 0.0
    spark = ratings.sparkSession
    run = _kernel(k, model, eta, lam, total)
    for _ in range(epochs):
        for stratum in range(blocks):
            rows = cells.withColumn("block", group("a")).where(group("b") == F.pmod(F.col("block") + stratum, F.lit(blocks)))
            rows = rows.select("block", F.lit("r").alias("tag"), "a", "b", "rate", "order", F.array().cast("array<double>").alias("x"))
            place = F.when(F.col("tag") == "u", group("a")).otherwise(F.pmod(group("a") - stratum, F.lit(blocks)))
            held = state.select(place.alias("block"), "tag", "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("order"), "x")
            head = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit("m").alias("tag"), F.lit("").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("order"), F.array(F.lit(mean), F.lit(done)).alias("x"))
            new = cut(rows.unionByName(held).unionByName(head).groupBy("block").applyInPandas(run, "block int, tag string, a string, x array<double>"))
            state = new.where("tag <> 'm'").select("tag", "a", "x")
            m = new.where("tag = 'm'").agg(F.avg(F.col("x")[0]), F.max(F.col("x")[1])).first()
            mean, done = float(m[0]), float(m[1])
    f = lambda start, size: F.slice("x", start, size)
    out_u = state.where("tag = 'u'").select(F.col("a").cast(user_kind).alias("user"), f(1, k).alias("f"), F.col("x")[k].alias("bias"))
    out_i = state.where("tag = 'i'").select(F.col("a").cast(kind).alias("item"), f(1, k).alias("f"), F.col("x")[k].alias("bias"), f(k + 2, k).alias("y"))
    return out_u, out_i, spark.createDataFrame([(mean,)], "mean double")


def predict(pairs: DataFrame, users: DataFrame, items: DataFrame, mean: DataFrame | None = None, implicit: DataFrame | None = None) -> DataFrame:
    """``pairs`` with ``guess``; unknown users or items get null.

    Dot product of (user, f) and (item, f); with ``mean`` also mean and biases; with ``implicit`` (user, item) cells also
    the user's implicit vector, the scaled sum of y over the items of the user.
    """
    u, v = users.withColumnRenamed("f", "uf"), items.withColumnRenamed("f", "vf")
    if mean is not None:
        u, v = u.withColumnRenamed("bias", "ub"), v.withColumnRenamed("bias", "vb")
    if implicit is not None:
        k = len(items.select("f").first()["f"])
        sums = implicit.select("user", "item").distinct().join(items.select("item", "y"), "item").groupBy("user").agg(F.array(*[F.sum(F.col("y")[i]) / F.sqrt(F.count(F.lit(1))) for i in range(k)]).alias("s"))
        u = u.join(sums, "user", "left").withColumn("uf", F.coalesce(F.zip_with("uf", "s", lambda a, b: a + b), F.col("uf"))).drop("s")
    joined = pairs.join(u, "user", "left").join(v.drop("y"), "item", "left")
    guess = dot("uf", "vf")
    if mean is not None:
        joined = joined.crossJoin(F.broadcast(mean))
        guess = guess + F.col("mean") + F.col("ub") + F.col("vb")
    known = F.col("uf").isNotNull() & F.col("vf").isNotNull()
    return joined.withColumn("guess", F.when(known, guess)).drop("uf", "vf", "ub", "vb", "mean")


def rmse(guessed: DataFrame, rounded: bool = True) -> DataFrame:
    """One row ``rmse`` of (rate, guess): guesses rounded half away from zero; unknown ones add no error but count.

    An empty input gives -1.
    """
    guess = F.round("guess") if rounded else F.col("guess")
    return guessed.agg(F.coalesce(F.sqrt(F.coalesce(F.sum(F.pow(guess - F.col("rate"), 2)), F.when(F.count(F.lit(1)) > 0, F.lit(0.0))) / F.count(F.lit(1))), F.lit(-1.0)).alias("rmse"))


def fold_of(key: Column, folds: int, seed: int = 1) -> Column:
    """The test fold (1 .. folds) of a row."""
    return (F.pmod(F.conv(F.substring(digest(key, f"fold{seed}"), 1, 8), 16, 10).cast("bigint"), F.lit(folds)) + 1).cast("int")


def cross_validate(ratings: DataFrame, folds: int, fit: Callable[[DataFrame, DataFrame], DataFrame], key: Column | None = None) -> DataFrame:
    """(fold, rmse) of every fold and of their mean (fold 0). ``fit(train, test)`` returns test with ``guess``."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    key = F.concat_ws("|", "user", "item") if key is None else key
    marked = cut(ratings.withColumn("fold", fold_of(key, folds)))
    out = None
    for k in range(1, folds + 1):
        one = rmse(fit(marked.where(F.col("fold") != k).drop("fold"), marked.where(F.col("fold") == k).drop("fold"))).select(F.lit(k).alias("fold"), "rmse")
        out = one if out is None else out.unionByName(one)
    out = cut(out)
    return out.unionByName(out.agg(F.lit(0).alias("fold"), F.avg("rmse").alias("rmse")))


# ---------------------------------------------------------------- recommendation


def top_items(users: DataFrame, items: DataFrame, n: int, block: int = 5_000) -> DataFrame:
    """(user, item, rate, rank): the ``n`` items with the highest predicted rate of every user, ties to the smaller item.

    Users and items meet block by block as matrices; per user and item block n candidates go on to a merge.
    """
    n_users, n_items = users.count(), items.count()
    ub, ib = max(1, -(-n_users // block)), max(1, -(-n_items // block))
    kind, user_kind = items.schema["item"].dataType.simpleString(), users.schema["user"].dataType.simpleString()
    left = users.select(F.pmod(F.xxhash64("user"), F.lit(ub)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ib - 1).cast("long"))).alias("q"), "user", "f")
    right = items.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ub - 1).cast("long"))).alias("p"), F.pmod(F.xxhash64("item"), F.lit(ib)).alias("q"), "item", "f")

    def best(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(u) or not len(v):
            return pd.DataFrame({"user": u["user"][:0], "item": v["item"][:0], "rate": np.zeros(0)})
        v = v.sort_values("item").reset_index(drop=True)
        rates = np.stack(u["f"].to_numpy()) @ np.stack(v["f"].to_numpy()).T
        take = np.argsort(-rates, axis=1, kind="stable")[:, :n]
        return pd.DataFrame({"user": np.repeat(u["user"].to_numpy(), take.shape[1]), "item": v["item"].to_numpy()[take.ravel()], "rate": np.take_along_axis(rates, take, 1).ravel()})

    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(best, f"user {user_kind}, item {kind}, rate double")
    order = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rate")).alias("k"), F.col("item")))), 1, n)  # n per item block
    ranked = found.groupBy("user").agg(order.alias("e")).select("user", F.posexplode("e").alias("rank", "e"))
    return ranked.select("user", "e.item", (-F.col("e.k")).alias("rate"), (F.col("rank") + 1).alias("rank"))


def user_clusters(users: DataFrame) -> DataFrame:
    """(user, cluster): the index of the largest factor, the first of equals; 0 where none exceeds -1."""
    top = F.array_max("f")
    return users.select("user", F.when(top > -1, F.array_position("f", top) - 1).otherwise(F.lit(0)).cast("int").alias("cluster"))


def cluster_popularity(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """(cluster, item, n): how many ratings an item has from each cluster of users."""
    return ratings.join(user_clusters(users), "user").groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("n"))


def recommend(ratings: DataFrame, users: DataFrame, items: DataFrame, limit: int = 30, exclude_seen: bool = False, mean: DataFrame | None = None, block: int = 5_000) -> DataFrame:
    """(user, item, rank): for each user the items known in the own cluster by predicted rate, then item descending.

    Inside a cluster users and items meet block by block as matrices; per user and item block ``limit`` candidates go on
    to a merge, so no row is made for a user and an item that isn't a candidate. With ``exclude_seen`` the items a user
    has rated come along with the user.
    """
    ratings = cut(ratings.select("user", "item"))
    popular = cluster_popularity(ratings, users).select("cluster", "item")
    if mean is not None:  # biases as two more factors
        users = users.crossJoin(F.broadcast(mean)).withColumn("f", F.concat("f", F.array(F.col("bias") + F.col("mean"), F.lit(1.0))))
        items = items.withColumn("f", F.concat("f", F.array(F.lit(1.0), F.col("bias"))))
    known = cut(popular.join(items.select("item", "f"), "item"))
    placed = user_clusters(users).join(users.select("user", "f"), "user")
    if exclude_seen:
        placed = placed.join(ratings.groupBy("user").agg(F.collect_set("item").alias("seen")), "user", "left")
    else:
        placed = placed.withColumn("seen", F.lit(None).cast(f"array<{items.schema['item'].dataType.simpleString()}>"))
    placed = cut(placed)
    pages = known.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("pages")).join(placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("sheets")), "cluster")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = placed.join(F.broadcast(pages), "cluster").select("cluster", share("user", "sheets").alias("p"), spread("pages").alias("q"), "user", "f", "seen")
    right = known.join(F.broadcast(pages), "cluster").select("cluster", spread("sheets").alias("p"), share("item", "pages").alias("q"), "item", "f")
    kind, user_kind = items.schema["item"].dataType.simpleString(), users.schema["user"].dataType.simpleString()

    def best(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(u) or not len(v):
            return pd.DataFrame({"user": u["user"][:0], "item": v["item"][:0], "guess": np.zeros(0)})
        v = v.sort_values("item", ascending=False).reset_index(drop=True)
        guess = np.round(np.stack(u["f"].to_numpy()) @ np.stack(v["f"].to_numpy()).T, 9)
        at = {item: j for j, item in enumerate(v["item"])}
        for row, seen in zip(guess, u["seen"], strict=True):
            if seen is not None:
                row[[at[x] for x in seen if x in at]] = -np.inf
        take = np.argsort(-guess, axis=1, kind="stable")[:, :limit]
        out = pd.DataFrame({"user": np.repeat(u["user"].to_numpy(), take.shape[1]), "item": v["item"].to_numpy()[take.ravel()], "guess": np.take_along_axis(guess, take, 1).ravel()})
        return out[out["guess"] > -np.inf]

    found = left.groupBy("cluster", "p", "q").cogroup(right.groupBy("cluster", "p", "q")).applyInPandas(best, f"user {user_kind}, item {kind}, guess double")
    order = Window.partitionBy("user").orderBy(F.col("guess").desc(), F.col("item").desc())  # limit rows per item block
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("user", "item", "rank")

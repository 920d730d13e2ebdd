"""Similar pairs and nearest rows: pivot-based sorted-neighbourhood LSH, one-to-many ranking, ratio matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.seeded import digest
from cairn.functions.vectors import squared_euclid
from cairn.operators.ranking import global_rank, neighbours
from cairn.runtime import cut


def pivots(vectors: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(pivot, dim, x): ``count`` data vectors by seeded choice, numbered 0, 1, ... in that order, in long form.

    ``vectors`` is (key, v MAP<STRING, DOUBLE>). At most ``count`` vectors: the result may be broadcast.
    """
    from pyspark.sql import Window

    chosen = vectors.orderBy(digest("key", seed), "key").limit(count)
    order = Window.orderBy(digest("key", seed), "key")  # over ``count`` rows
    numbered = chosen.select("v", (F.row_number().over(order) - 1).alias("pivot"))
    return numbered.select("pivot", F.explode("v").alias("dim", "x"))


def signatures(vectors: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(key, bits ARRAY<STRING>): for each pivot whether the inner product with it is positive."""
    entries = vectors.select("key", F.explode("v").alias("dim", "y"))
    products = entries.join(F.broadcast(pivots(vectors, count, seed)), "dim").groupBy("key", "pivot").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    positive = products.where("p > 0").groupBy("key").agg(F.collect_list("pivot").alias("on"))
    bit = lambda i: F.when(F.array_contains("on", i), "1").otherwise("0")
    bits = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), bit)
    joined = vectors.select("key").join(positive, "key", "left").withColumn("on", F.coalesce("on", F.array().cast("array<int>")))
    return joined.select("key", bits.alias("bits"))


def permutation(count: int, shuffle: int, seed: int = 1) -> list[int]:
    """A seeded permutation of 0 .. count - 1."""
    import hashlib

    return sorted(range(count), key=lambda i: (hashlib.md5(f"{i}:{seed}-{shuffle}".encode()).hexdigest(), i))


def lsh_candidates(vectors: DataFrame, count: int = 10, shuffles: int = 5, reach: int = 5, seed: int = 1) -> DataFrame:
    """(a, b), a < b: pairs near each other in at least one sorting of the signatures.

    For each shuffle the bits are permuted, rows sorted by (bits, key), and every row meets those within ``reach``
    positions. With fewer vectors than ``count`` all of them are pivots.
    """
    signed = signatures(cut(vectors), count, seed)
    orders = F.array(*[F.struct(F.lit(s).alias("shuffle"), F.array(*[F.lit(i + 1) for i in permutation(count, s, seed)]).alias("order")) for s in range(shuffles)])
    each = signed.select("key", "bits", F.explode(orders).alias("o"))
    sorted_bits = F.array_join(F.transform("o.order", lambda i: F.element_at("bits", i)), "")
    ranked = global_rank(each.select("o.shuffle", sorted_bits.alias("code"), "key"), ["shuffle", "code", "key"])
    near = neighbours(ranked, "shuffle", "key", reach)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sparse_cosines(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cos) of given pairs of (key, v MAP) vectors; 0 where a norm is 0.

    Norms are computed once per vector; a pair's inner product looks each entry of one map up in the other.
    """
    from cairn.functions.vectors import sparse_dot, sparse_norm

    sized = cut(vectors.select("key", "v", sparse_norm("v").alias("n")))
    left, right = sized.toDF("a", "va", "na"), sized.toDF("b", "vb", "nb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.coalesce(F.try_divide(sparse_dot("va", "vb"), F.col("na") * F.col("nb")), F.lit(0.0)).alias("cos"))


def lsh_pairs(vectors: DataFrame, threshold: float = 0.7, count: int = 10, shuffles: int = 5, reach: int = 5, seed: int = 1) -> DataFrame:
    """(a, b, cos) of candidate pairs with cosine above ``threshold``; pairs, copies too, that no order brings within
    ``reach`` are not found, and the more rows the more of them. ``cosine_pairs`` finds every pair."""
    vectors = cut(vectors)  # decoded once, used for signatures and twice for the exact cosines
    return sparse_cosines(vectors, lsh_candidates(vectors, count, shuffles, reach, seed)).where(F.col("cos") > threshold)


def cosine_pairs(vectors: DataFrame, threshold: float = 0.7, chunk: int = 1000) -> DataFrame:
    """(a, b, cos), a < b: every pair of (key, v MAP) vectors with cosine above ``threshold`` > 0, exact copies included.

    Dimensions are ordered by how many vectors have them; a vector's prefix is its rarest dimensions up to where the
    rest of its unit length falls below the threshold. Two vectors without a common prefix dimension share only what is
    in the rest of one of them, which is too short: no pair is lost. All pairs of a block (the vectors with a dimension
    in their prefix) are measured; a crowded block is cut into chunk pairs of at most about ``chunk`` rows a side.
    """
    from cairn.functions.vectors import sparse_norm

    if threshold <= 0:
        raise ValueError("threshold must be above 0: below it, vectors without a common dimension are pairs, too")
    vectors = cut(vectors.select("key", "v", sparse_norm("v").alias("n"), F.monotonically_increasing_id().alias("no")).where("n > 0"))
    entries = vectors.select("no", "n", F.explode("v").alias("dim", "x"))
    rarity = cut(entries.groupBy("dim").agg(F.count(F.lit(1)).alias("df")).withColumn("d", F.monotonically_increasing_id()))
    ranked = entries.join(rarity, "dim").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("df", "d", (F.col("x") / F.col("n")).alias("x")))).alias("e"))
    # a pair is lost only if the rest is truly below the threshold: a margin for rounding
    least = threshold * threshold * (1 - 1e-9)
    start = F.struct(F.lit(1.0).alias("rest"), F.array().cast("array<bigint>").alias("dims"))
    step = lambda s, e: F.when(s["rest"] >= least, F.struct((s["rest"] - e["x"] * e["x"]).alias("rest"), F.concat(s["dims"], F.array(e["d"])).alias("dims"))).otherwise(s)
    wide = ranked.select("no", F.transform("e", lambda e: e["d"]).alias("dims"), F.transform("e", lambda e: e["x"]).alias("xs"), F.aggregate("e", start, step)["dims"].alias("prefix"))
    blocks = cut(wide.select(F.explode("prefix").alias("block"), "no", "dims", "xs"))
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = blocks.join(sizes, "block").withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int")).withColumn("mine", F.pmod(F.xxhash64("no"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("c1", F.least("mine", "other")).withColumn("c2", F.greatest("mine", "other"))
    # several small blocks go to Python at once
    groups = max(1, rows.count() // (4 * chunk))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("block", "c1", "c2"), F.lit(groups))).select("group", "block", "c1", "c2", "mine", "no", "dims", "xs")
    near = rows.groupBy("group").applyInPandas(lambda pdf: _near_inside(pdf, threshold - 1e-9), "a long, b long").distinct()
    names = vectors.select("no", "key")
    named = near.join(names.toDF("a", "ka"), "a").join(names.toDF("b", "kb"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return sparse_cosines(vectors, named).where(F.col("cos") > threshold)


def _near_inside(pdf, least: float):
    """Numbers of the row pairs of each block and chunk pair whose unit vectors have an inner product of ``least`` or more."""
    import numpy as np
    import pandas as pd

    some = 2_000  # columns multiplied at once
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (_, c1, c2), part in pdf.groupby(["block", "c1", "c2"], sort=False):
        no, mine = part["no"].to_numpy(), part["mine"].to_numpy()
        left, right = np.flatnonzero(mine == c1), np.flatnonzero(mine == c2)
        if not len(left) or not len(right) or len(no) < 2:
            continue
        lengths = np.array([len(d) for d in part["dims"]])
        dims, column, uses = np.unique(np.concatenate(part["dims"].to_list()), return_inverse=True, return_counts=True)
        values, row = np.concatenate(part["xs"].to_list()), np.repeat(np.arange(len(no)), lengths)
        shared = uses > 1
        keep, place = shared[column], np.cumsum(shared) - 1
        column, values, row = place[column[keep]], values[keep], row[keep]
        product = np.zeros((len(left), len(right)))
        for first in range(0, int(shared.sum()), some):
            now = (column >= first) & (column < first + some)
            x = np.zeros((len(no), min(some, int(shared.sum()) - first)))
            x[row[now], column[now] - first] = values[now]
            product += x[left] @ x[right].T
        i, j = np.nonzero(product >= least)
        i, j = no[left[i]], no[right[j]]
        keep = i < j if c1 == c2 else i != j
        out_a.append(np.minimum(i, j)[keep])
        out_b.append(np.maximum(i, j)[keep])
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def rank_against(rows: DataFrame, target: DataFrame, key: str, vec: str, score: Column, n: int = 10, ascending: bool = True) -> DataFrame:
    """The ``n`` rows nearest to the single ``target`` row by ``score`` over (vec, target), then key: a top-k, no sort."""
    one = target.select(F.col(key).alias("target_key"), F.col(vec).alias("target")).limit(1)
    scored = rows.crossJoin(F.broadcast(one)).where(F.col(key) != F.col("target_key")).select(key, score.alias("score"))
    return scored.orderBy(F.col("score") if ascending else F.col("score").desc(), key).limit(n)


def ratio_match(left: DataFrame, right: DataFrame, key: str, sign: str, vec: str, ratio: float = 0.6, none: float = 1e6) -> DataFrame:
    """(key, match): for each descriptor of ``left`` its nearest of ``right`` with the same sign, or -1 where ambiguous.

    A match holds if the nearest is closer than ``ratio`` times the second nearest (``none`` with one candidate).
    ``right`` is one image's descriptors and is sent to every task of ``left``; top-2 is a mergeable aggregate.
    """
    other = F.broadcast(right.select(F.col(key).alias("other"), F.col(sign).alias("__s"), F.col(vec).alias("__w")))
    near = left.select(key, F.col(sign).alias("__t"), F.col(vec).alias("__v")).join(other, F.col("__t") == F.col("__s"), "left").select(key, "other", F.sqrt(squared_euclid("__v", "__w")).alias("d"))
    candidate = F.when(F.col("other").isNotNull(), F.struct("d", "other"))
    best = near.groupBy(key).agg(F.min(candidate).alias("first"), F.array_sort(bounded_two(F.coalesce(candidate, F.struct(F.lit(none).alias("d"), F.lit(None).cast("bigint").alias("other"))))).alias("two"))
    second = F.coalesce(F.try_element_at("two", F.lit(2))["d"], F.lit(none))
    return best.select(key, F.when(F.col("first.d") < ratio * second, F.col("first.other")).otherwise(F.lit(-1)).cast("bigint").alias("match"))


def bounded_two(value: Column) -> Column:
    """Aggregate: the two smallest values of a group in a bounded heap."""
    from pyspark.sql.internal import InternalFunction

    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", value, F.lit(2), F.lit(True))

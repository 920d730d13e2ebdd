"""Bags of visual words, hash histograms, matching, class statistics and splits over descriptor tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import images as kernels
from cairn.functions.seeded import digest, uniform
from cairn.functions.vectors import cosine, literal, nearest, norm, scale, squared_euclid
from cairn.operators.ranking import global_rank, running_total
from cairn.runtime import small_side


def quantise(descriptors: DataFrame, vec: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """``descriptors`` with ``vword``: the nearest centroid by squared Euclidean distance, ties to the lowest index."""
    return descriptors.withColumn("vword", nearest(vec, centroids, squared_euclid))


def hard_histogram(labels: DataFrame, image: str) -> DataFrame:
    """(image, vword, n)."""
    return labels.groupBy(image, "vword").agg(F.count(F.lit(1)).alias("n"))


def soft_histogram(descriptors: DataFrame, image: str, vec: str, centroids: Sequence[Sequence[float]], top: int = 5) -> DataFrame:
    """(image, vword, w): each descriptor gives its ``top`` nearest words the weight 1 / (1 + distance)."""
    d = F.array(*[F.struct(F.sqrt(squared_euclid(vec, literal(c))).alias("d"), F.lit(i).alias("vword")) for i, c in enumerate(centroids)])
    each = descriptors.select(image, F.explode(F.slice(F.array_sort(d), 1, top)).alias("s"))
    return each.groupBy(image, F.col("s.vword").alias("vword")).agg(F.sum(1 / (1 + F.col("s.d"))).alias("w"))


def join_labels(files: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(file rows with labels, file rows without): word id 0 is a word like any other."""
    return files.join(labels, key), files.join(labels, key, "left_anti")


def positional_join(counts: DataFrame, labels: DataFrame, order: Sequence[str], file: str, n: str, position: str) -> DataFrame:
    """(file, *labels): rows of ``labels`` by running position, the first ``n`` of the first file, the next of the second, ...

    Starts are running totals of the counts in ``order``; each file's positions are unfolded and joined by equality.
    """
    starts = running_total(counts.where(F.col(n) > 0), order, n).select(F.col(file), F.explode(F.sequence(F.col("upto") - F.col(n), F.col("upto") - 1)).alias("__at"))
    return starts.join(labels, F.col("__at") == F.col(position)).drop("__at")


def bag_of_features(descriptors: DataFrame, image: str, vec: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(image, vword, n): each unit descriptor goes to the centroid of greatest cosine, ties to the lowest index."""
    unit = scale(F.col(vec), F.coalesce(F.try_divide(F.lit(1.0), norm(vec)), F.lit(0.0)))
    away = lambda a, b: F.round(-cosine(a, b), 12)
    return hard_histogram(descriptors.select(image, unit.alias("u")).select(image, nearest("u", centroids, away).alias("vword")), image)


def truncated_similarity(descriptors: DataFrame, key: str, vec: str, centroids: DataFrame, postings: int = 100, query_keys: int = 20) -> DataFrame:
    """(key, cluster): the most similar centroid (cluster, dim, x) through an inverted index cut to ``postings`` a dimension
    and the ``query_keys`` largest dimensions of each descriptor; ties to the lowest cluster."""
    big = Window.partitionBy("dim").orderBy(F.abs("x").desc(), "cluster")
    index = centroids.withColumn("r", F.row_number().over(big)).where(F.col("r") <= postings).drop("r")
    dims = F.transform(F.col(vec), lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("dim"), x.alias("y")))
    query = descriptors.select(key, F.explode(F.slice(F.array_sort(dims), 1, query_keys)).alias("q")).select(key, "q.dim", "q.y")
    scored = query.join(index, "dim").groupBy(key, "cluster").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("s"))
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("cluster"))).alias("m")).select(key, F.col("m.cluster").alias("cluster"))


def threshold_hashes(size: int, repeat: int = 10, bits: int = 10, low: float = -1.0, high: float = 1.0, seed: int = 1) -> list[list[tuple[int, float]]]:
    """``repeat`` tables of ``bits`` (dimension, threshold) pairs, seeded."""
    rng = np.random.default_rng(seed)
    return [[(int(rng.integers(size)), float(round(rng.uniform(low, high), 6))) for _ in range(bits)] for _ in range(repeat)]


def hash_histogram(descriptors: DataFrame, image: str, vec: str, tables: list[list[tuple[int, float]]]) -> DataFrame:
    """(image, bin, n): per table a descriptor falls into the bin its threshold bits spell."""
    def bin_of(t: int, pairs: list[tuple[int, float]]) -> Column:
        value: Column = F.lit(t << len(pairs))
        for b, (dim, threshold) in enumerate(pairs):
            value = value + F.when(F.col(vec)[dim] > threshold, 1 << b).otherwise(0)
        return value

    bins = F.array(*[bin_of(t, pairs) for t, pairs in enumerate(tables)])
    return descriptors.select(image, F.explode(bins).alias("bin")).groupBy(image, "bin").agg(F.count(F.lit(1)).alias("n"))


def match_counts(descriptors: DataFrame, target: DataFrame, image: str, key: str, sign: str, vec: str, ratio: float = 0.6, none: float = 1e6) -> DataFrame:
    """(image, matches, total): how many of the target image's descriptors have an unambiguous nearest one in each image.

    ``target`` holds one image's descriptors and is sent to every task if they are few. The two nearest of each (image, target
    descriptor) are mergeable minima: the nearest, then the nearest but that one.
    """
    wanted = small_side(target.select(F.col(key).alias("tk"), F.col(sign).alias("ts"), F.col(vec).alias("tv")))
    own = descriptors.select(image, F.col(key).alias("__k"), F.col(sign).alias("__s"), F.col(vec).alias("__v"))
    pairs = own.join(wanted, F.col("__s") == F.col("ts")).select(image, "tk", F.struct(F.sqrt(squared_euclid("tv", "__v")).alias("d"), F.col("__k").alias("k")).alias("c"))
    first = F.min("c").alias("a")
    from cairn.operators.similarity import bounded_two

    best = pairs.groupBy(image, "tk").agg(first, bounded_two(F.col("c")).alias("two"))
    second = F.coalesce(F.try_element_at(F.array_sort("two"), F.lit(2))["d"], F.lit(none))
    hit = F.when(F.col("a.d") < ratio * second, 1).otherwise(0)
    return best.groupBy(image).agg(F.sum(hit).alias("matches"), F.count(F.lit(1)).alias("total"))


def singleton_ratio(bags: DataFrame, category: str, key: str) -> DataFrame:
    """(category, ones, keys, ratio) of every category and of 'all': keys that occur once among all keys."""
    counted = bags.rollup(key, category).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).alias("gk"), F.grouping(category).alias("gc")).where("gk = 0")
    named = counted.withColumn("c", F.when(F.col("gc") == 1, "all").otherwise(F.col(category)))
    per = named.groupBy("c").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("ones"), F.count(F.lit(1)).alias("keys"))
    return per.select(F.col("c").alias(category), "ones", "keys", (F.col("ones") / F.col("keys")).alias("ratio"))


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.9, seed: int = 1) -> DataFrame:
    """(key, label, split): the first ``share`` of each class in seeded order (at least one row) is train, the rest test.

    Places come from a range partitioning over (class, order), so a class of any size needs no single task.
    """
    ranked = global_rank(rows.select(key, label, digest(key, f"split{seed}").alias("__o")), [label, "__o", key])
    classes = ranked.groupBy(F.col(label).alias("__label")).agg(F.min("rank").alias("__first"), F.count(F.lit(1)).alias("__n"))
    train = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    joined = ranked.join(classes, F.col(label).eqNullSafe(F.col("__label")))
    return joined.select(key, label, F.when(F.col("rank") - F.col("__first") < train, "train").otherwise("test").alias("split"))


def bernoulli(rows: DataFrame, key: str, rate: float, seed: int = 1) -> DataFrame:
    """Rows kept with probability ``rate``, decided by their key."""
    return rows.where(uniform(key, f"sample{seed}") < rate)


def naive_bayes_accuracy(bags: DataFrame, label: str, key: str, word: str, n: str, split: DataFrame, features: int = 1 << 16) -> DataFrame:
    """One row (n_test, accuracy): multinomial naive Bayes on hashed bags of words, trained on the train rows."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF, StringIndexer

    repeated = F.array_repeat(F.col(word).cast("string"), F.greatest(F.col(n).cast("int"), F.lit(0)))
    rows = bags.groupBy(key).agg(F.flatten(F.collect_list(repeated)).alias("__words"))
    data = rows.join(split.where(F.col(label).isNotNull()), key).select("__words", label, "split")
    data = HashingTF(inputCol="__words", outputCol="features", numFeatures=features).transform(data).drop("__words")
    indexed = StringIndexer(inputCol=label, outputCol="label_index").fit(data).transform(data)
    model = NaiveBayes(featuresCol="features", labelCol="label_index").fit(indexed.where("split = 'train'"))
    tested = model.transform(indexed.where("split = 'test'"))
    return tested.agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.when(F.col("prediction") == F.col("label_index"), 1.0).otherwise(0.0)).alias("accuracy"))


def train_words(descriptors: DataFrame, key: str, vec: str, k: int, rate: float = 0.1, seed: int = 1) -> list[list[float]]:
    """k word centroids of a seeded sample by bisecting k-means on cosine distance."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    sample = bernoulli(descriptors, key, rate, seed).where(norm(vec) > 0).select(array_to_vector(F.col(vec)).alias("features"))
    model = BisectingKMeans(k=k, distanceMeasure="cosine", seed=seed).fit(sample)
    return [list(map(float, c)) for c in model.clusterCenters()]


# ---------------------------------------------------------------- image tables


def image_feature(images: DataFrame, feature: Callable[[np.ndarray], np.ndarray], name: str = "feature") -> DataFrame:
    """(path, feature ARRAY<DOUBLE>) of an image table (path, height, width, channels, pixels); a failing image gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, h, w, c, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"], strict=True):
                try:
                    out.append((path, np.asarray(feature(kernels.decode(data, h, w, c)), dtype=np.float64).ravel().tolist()))
                except (ValueError, IndexError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["path", name])

    return images.select("path", "height", "width", "channels", "pixels").mapInPandas(run, f"path string, {name} array<double>")


def image_distance(images: DataFrame, target: tuple[bytes, int, int, int], distance: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """(path, distance) of every image to one target image; a failing image or an undefined distance gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = kernels.decode(*target)
        for pdf in batches:
            out = []
            for path, h, w, c, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"], strict=True):
                try:
                    d = float(distance(one, kernels.decode(data, h, w, c)))
                except (ValueError, IndexError, TypeError):
                    continue
                if d == d:
                    out.append((path, d))
            yield pd.DataFrame(out, columns=["path", "distance"])

    return images.select("path", "height", "width", "channels", "pixels").mapInPandas(run, "path string, distance double")


def colour_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Earth Mover's Distance of two images' colour signatures."""
    return kernels.earth_mover(*kernels.signature(a), *kernels.signature(b))

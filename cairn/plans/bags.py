"""Queries over descriptors and images: embeddings serve as descriptors, ten in a row as an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import images as kernels
from cairn.functions.seeded import uniform_sql
from cairn.functions.vectors import bhattacharyya, cosine, literal
from cairn.operators import features as ops
from cairn.operators.cluster import random_centroids
from cairn.operators.ranking import global_rank
from cairn.operators.text import term_frequency
from cairn.sources.tables import table

WORDS = 8
TABLES = ops.threshold_hashes(64)


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return t.select("vec_id", F.expr("vec_id div 10").alias("image"), (F.col("vec_id") % 2).alias("sign"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _words(descriptors: DataFrame) -> list[list[float]]:
    return random_centroids(descriptors.withColumnRenamed("vec_id", "key"), WORDS)


def visual_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptors(spark, sf_dir)
    return ops.quantise(d, "v", _words(d)).select("vec_id", "vword")


def visual_word_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptors(spark, sf_dir)
    return ops.hard_histogram(ops.quantise(d, "v", _words(d)), "image")


def visual_word_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptors(spark, sf_dir)
    return ops.soft_histogram(d, "image", "v", _words(d)).withColumn("w", F.round("w", 6))


def _label_counts(d: DataFrame, labels: DataFrame) -> DataFrame:
    hit, missed = ops.join_labels(d.select("image", "vec_id"), labels, "vec_id")
    return hit.groupBy("vword").agg(F.count(F.lit(1)).alias("n")).unionByName(missed.agg(F.lit(-1).alias("vword"), F.count(F.lit(1)).alias("n")))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the descriptors whose images exist, and how many descriptors have none; word 3 has no labels here, to have misses."""
    d = _descriptors(spark, sf_dir)
    return _label_counts(d, ops.quantise(d, "v", _words(d)).where("vword <> 3").select("vec_id", "vword"))


def label_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against all labels."""
    d = _descriptors(spark, sf_dir)
    return _label_counts(d, ops.quantise(d, "v", _words(d)).select("vec_id", "vword"))


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by running position against per-image counts."""
    d = _descriptors(spark, sf_dir)
    labels = global_rank(ops.quantise(d, "v", _words(d)).select("vec_id", "vword"), ["vec_id"], "pos").select("pos", "vword")
    counts = d.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return ops.hard_histogram(ops.positional_join(counts, labels, ["image"], "image", "n", "pos"), "image")


def bof(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptors(spark, sf_dir)
    return ops.bag_of_features(d, "image", "v", _words(d))


def bof_truncated(spark: SparkSession, sf_dir: str, postings: int = 5) -> DataFrame:
    """Most similar centroid through the truncated inverted index, cut to 5 of the 8 centroids a dimension."""
    d = _descriptors(spark, sf_dir)
    rows = [(c, i, float(x)) for c, v in enumerate(_words(d)) for i, x in enumerate(v)]
    centroids = spark.createDataFrame(rows, "cluster int, dim int, x double")
    return ops.truncated_similarity(d, "vec_id", "v", centroids, postings)


def bof_truncated_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the reference's 100 postings a dimension: no centroid is cut."""
    return bof_truncated(spark, sf_dir, 100)


def lsh_bof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hash_histogram(_descriptors(spark, sf_dir), "image", "v", TABLES)


def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unambiguous matches of the first image's descriptors in every image, ratio 0.9."""
    d = _descriptors(spark, sf_dir)
    return ops.match_counts(d, d.where("image = 0"), "image", "vec_id", "sign", "v", 0.9)


def ratio_match_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match of each descriptor in the first image, or -1, ratio 0.9."""
    from cairn.operators.similarity import ratio_match as pair

    d = _descriptors(spark, sf_dir)
    return pair(d, d.where("image = 0"), "vec_id", "sign", "v", 0.9)


def descriptor_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates above 1e-4 in size, one row each."""
    d = _descriptors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("dim", "x"))
    return d.where(F.abs("x") > 1e-4).select("vec_id", "dim", F.round("x", 6).alias("x"))


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One descriptor in ten, by hash."""
    return ops.bernoulli(_descriptors(spark, sf_dir).select("vec_id", "label"), "vec_id", 0.1)


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return term_frequency(docs, "doc_id", "text").join(docs.select("doc_id", "source"), "doc_id")


def singleton_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.singleton_ratio(_bags(spark, sf_dir), "source", "word").withColumn("ratio", F.round("ratio", 6))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stratified_split(table(spark, sf_dir, "documents", "doc_id", "source"), "source", "doc_id")


def naive_bayes_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which language a document is in, by naive Bayes on its words."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    split = ops.stratified_split(docs, "lang", "doc_id")
    return ops.naive_bayes_accuracy(term_frequency(docs, "doc_id", "text"), "lang", "doc_id", "word", "tf", split).withColumn("accuracy", F.round("accuracy", 4))


def vw_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the word clusters trained on a sample."""
    d = _descriptors(spark, sf_dir)
    words = ops.train_words(d, "vec_id", "v", WORDS, 0.5)
    return ops.bag_of_features(d.withColumn("image", F.lit(0)), "image", "v", words).select("vword", "n")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray pictures: each coordinate of an embedding as a byte."""
    byte = F.transform("v", lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 0.5) * 256))).cast("int")), 2, "0"))
    d = _descriptors(spark, sf_dir)
    return d.select(F.col("vec_id").cast("string").alias("path"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.array_join(byte, "")).alias("pixels"), "vec_id", "v")


def color_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the 16 brightness bins of every picture."""
    d = _descriptors(spark, sf_dir).select("vec_id", F.explode("v").alias("x"))
    value = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("x") + 0.5) * 256)))
    return d.groupBy("vec_id", F.floor(value * 16 / 256).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _one(pictures: DataFrame) -> tuple[bytes, int, int, int]:
    r = pictures.orderBy("vec_id").first()
    return bytes(r["pixels"]), r["height"], r["width"], r["channels"]


def _top(distances: DataFrame) -> DataFrame:
    return distances.withColumn("distance", F.round("distance", 6)).orderBy("distance", "path").limit(10)


def hog_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 pictures nearest to the first by HOG cosine distance."""
    pictures = _pictures(spark, sf_dir)
    target = kernels.hog(kernels.decode(*_one(pictures))).tolist()
    described = ops.image_feature(pictures, kernels.hog)
    return _top(described.select("path", (1 - cosine("feature", literal(target))).alias("distance")))


def rank_hist_hog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 pictures most similar to the first by 0.3 (1 - histogram distance) + 1.5 HOG cosine."""
    pictures = _pictures(spark, sf_dir)
    one = kernels.decode(*_one(pictures))
    spread = lambda image: kernels.histogram(image, (16,), ((0, 256),))
    both = ops.image_feature(pictures, kernels.hog, "g").join(ops.image_feature(pictures, spread, "h"), "path")
    score = 0.3 * (1 - bhattacharyya("h", literal(spread(one).tolist()))) + 1.5 * cosine("g", literal(kernels.hog(one).tolist()))
    return both.select("path", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "path").limit(10)


def emd_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = _pictures(spark, sf_dir)
    return _top(ops.image_distance(pictures, _one(pictures), ops.colour_distance))


def hu_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = _pictures(spark, sf_dir)
    return _top(ops.image_distance(pictures, _one(pictures), kernels.shape_distance))


QUERIES = {
    f.__name__: f
    for f in (visual_word, visual_word_hist, visual_word_soft, label_join, label_join_all, positional_join, bof, bof_truncated, bof_truncated_100, lsh_bof, ratio_match, ratio_match_pair, descriptor_dump, row_sample, singleton_ratio, stratified_split, naive_bayes_accuracy, vw_training, color_histogram, hog_top10, rank_hist_hog, emd_top10, hu_match)
}

_D = f"""d AS (SELECT vec_id, vec_id // 10 AS image, vec_id % 2 AS sign, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
w AS (SELECT row_number() OVER (ORDER BY md5(vec_id || ':1'), vec_id) - 1 AS vword, v AS c FROM d QUALIFY vword < {WORDS})"""
_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) ** 2))"
_Q = f"q AS (SELECT vec_id, any_value(image) AS image, CAST(arg_min(vword, ({_SQ.format(a='v', b='c')}, vword)) AS INT) AS vword FROM d CROSS JOIN w GROUP BY vec_id)"
_COS = "list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c)))"
_BIN = " UNION ALL ".join(f"SELECT image, {t << len(pairs)} + " + " + ".join(f"CASE WHEN v[{dim + 1}] > {threshold} THEN {1 << b} ELSE 0 END" for b, (dim, threshold) in enumerate(pairs)) + " AS bin FROM d" for t, pairs in enumerate(TABLES))
_MATCH = f"""p AS (SELECT d.image, t.vec_id AS tk, d.vec_id AS k, sqrt({_SQ.format(a='t.v', b='d.v')}) AS dist FROM d JOIN d t ON t.image = 0 AND t.sign = d.sign),
r AS (SELECT *, row_number() OVER (PARTITION BY image, tk ORDER BY dist, k) AS rn FROM p)"""
_PAIR = f"""p AS (SELECT t.vec_id AS k, d.vec_id AS o, sqrt({_SQ.format(a='t.v', b='d.v')}) AS dist FROM d t JOIN d ON d.image = 0 AND t.sign = d.sign),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, o) AS rn FROM p)"""

ORACLES = {
    "visual_word": f"WITH {_D}, {_Q} SELECT vec_id, vword FROM q",
    "visual_word_hist": f"WITH {_D}, {_Q} SELECT image, vword, count(*) AS n FROM q GROUP BY ALL",
    "visual_word_soft": f"WITH {_D}, s AS (SELECT vec_id, image, vword, sqrt({_SQ.format(a='v', b='c')}) AS dist FROM d CROSS JOIN w QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, vword) <= 5) SELECT image, CAST(vword AS INT) AS vword, round(sum(1 / (1 + dist)), 6) AS w FROM s GROUP BY ALL",
    "label_join": f"WITH {_D}, {_Q} SELECT CASE WHEN vword = 3 THEN -1 ELSE vword END AS vword, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT -1, 0 WHERE NOT EXISTS (SELECT 1 FROM q WHERE vword = 3)",
    "label_join_all": f"WITH {_D}, {_Q} SELECT vword, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT -1, 0",
    "positional_join": f"WITH {_D}, {_Q}, l AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vword FROM q), n AS (SELECT image, count(*) AS n FROM d GROUP BY image), s AS (SELECT image, sum(n) OVER (ORDER BY image) AS upto, n FROM n) SELECT image, vword, count(*) AS n FROM s JOIN l ON pos >= upto - n AND pos < upto GROUP BY ALL",
    "bof": f"WITH {_D}, s AS (SELECT vec_id, any_value(image) AS image, CAST(arg_min(vword, (round(-({_COS}), 12), vword)) AS INT) AS vword FROM d CROSS JOIN w GROUP BY vec_id) SELECT image, vword, count(*) AS n FROM s GROUP BY ALL",
    "bof_truncated": f"""WITH {_D}, ix AS (SELECT vword, i - 1 AS dim, c[i] AS x FROM (SELECT vword, c, unnest(range(1, 65)) AS i FROM w) QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs(c[i]) DESC, vword) <= 5),
qk AS (SELECT vec_id, i - 1 AS dim, v[i] AS y FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM d) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v[i]) DESC, i) <= 20),
s AS (SELECT vec_id, vword, round(sum(x * y), 9) AS s FROM qk JOIN ix USING (dim) GROUP BY ALL) SELECT vec_id, CAST(arg_min(vword, (-s, vword)) AS INT) AS cluster FROM s GROUP BY vec_id""",
    "bof_truncated_100": f"""WITH {_D}, ix AS (SELECT vword, i - 1 AS dim, c[i] AS x FROM (SELECT vword, c, unnest(range(1, 65)) AS i FROM w) QUALIFY row_number() OVER (PARTITION BY i ORDER BY abs(c[i]) DESC, vword) <= 100),
qk AS (SELECT vec_id, i - 1 AS dim, v[i] AS y FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM d) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(v[i]) DESC, i) <= 20),
s AS (SELECT vec_id, vword, round(sum(x * y), 9) AS s FROM qk JOIN ix USING (dim) GROUP BY ALL) SELECT vec_id, CAST(arg_min(vword, (-s, vword)) AS INT) AS cluster FROM s GROUP BY vec_id""",
    "lsh_bof": f"WITH {_D} SELECT image, bin, count(*) AS n FROM ({_BIN}) GROUP BY ALL",
    "ratio_match": f"WITH {_D}, {_MATCH} SELECT image, CAST(sum(CASE WHEN a.dist < 0.9::DOUBLE * coalesce(b.dist, 1e6) THEN 1 ELSE 0 END) AS BIGINT) AS matches, count(*) AS total FROM (SELECT * FROM r WHERE rn = 1) a LEFT JOIN (SELECT image, tk, dist FROM r WHERE rn = 2) b USING (image, tk) GROUP BY image",
    "ratio_match_pair": f"WITH {_D}, {_PAIR} SELECT d.vec_id, CASE WHEN a.dist < 0.9::DOUBLE * coalesce(b.dist, 1e6) THEN a.o ELSE -1 END AS match FROM d LEFT JOIN (SELECT * FROM r WHERE rn = 1) a ON a.k = vec_id LEFT JOIN (SELECT k, dist FROM r WHERE rn = 2) b ON b.k = vec_id",
    "descriptor_dump": f"WITH {_D} SELECT vec_id, CAST(i - 1 AS INT) AS dim, round(v[i], 6) AS x FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM d) WHERE abs(v[i]) > 1e-4",
    "row_sample": f"WITH {_D} SELECT vec_id, label FROM d WHERE {uniform_sql('vec_id', 'sample1')} < 0.1",
    "singleton_ratio": r"""WITH b AS (SELECT DISTINCT doc_id, source, word FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)),
n AS (SELECT source, word, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'all', word, count(*) FROM b GROUP BY word)
SELECT source, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ones, count(*) AS keys, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM n GROUP BY source""",
    "stratified_split": "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':split1'), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.9::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM documents",
    "color_histogram": f"WITH {_D} SELECT vec_id, CAST(floor(least(255, greatest(0, floor((x + 0.5) * 256))) * 16 / 256) AS BIGINT) AS bin, count(*) AS n FROM (SELECT vec_id, unnest(v) AS x FROM d) GROUP BY ALL",
}

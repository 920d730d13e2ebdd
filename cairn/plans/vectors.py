"""Queries over vectors: measures, nearest rows, LSH pairs, k-means family, NMF."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import vectors as v
from cairn.functions.seeded import digest, uniform_sql
from cairn.functions.text import NUMBER, strict_number
from cairn.operators import cluster, nmf, similarity
from cairn.operators.similarity import permutation
from cairn.runtime import cut
from cairn.sources.readers import mirrored, sparse_vector
from cairn.sources.tables import table


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, v ARRAY<DOUBLE>(16)): usable kmeanspp rows, each id once."""
    fields = F.transform(F.split("vecstr", ","), strict_number)
    t = table(spark, sf_dir, "kmeanspp", "id", "vecstr").where("id IS NOT NULL")
    t = t.groupBy(F.col("id").alias("key"), fields.alias("v")).agg(F.lit(1).alias("one")).where(F.forall("v", lambda x: x.isNotNull()) & (F.size("v") == 16))
    return t.groupBy("key").agg(F.min("v").alias("v"))


def _sparse(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """(key, v MAP<STRING, DOUBLE>): usable lsh rows, each word once; whole vectors, or their first ``limit`` non-zero pairs."""
    f = F.split("vec", "\t")
    t = table(spark, sf_dir, "lsh", "word", "vec").where(F.col("word").isNotNull() & (F.size(f) % 2 == 0) & F.forall(F.filter(f, lambda x, i: i % 2 == 1), lambda x: strict_number(x).isNotNull()))
    return t.groupBy(F.col("word").alias("key")).agg(F.min("vec").alias("vec")).select("key", sparse_vector(F.col("vec"), limit=limit).alias("v")).where(F.size("v") > 0)


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, e, h): embeddings as descriptors and, shifted to be positive, as histograms."""
    t = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return t.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.transform("embedding", lambda x: x.cast("double") + 1).alias("h"))


def _target(images: DataFrame) -> DataFrame:
    return images.orderBy("vec_id").limit(1)


def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("key", F.round(v.norm("v"), 6).alias("norm"))


def _against(spark: SparkSession, sf_dir: str, column: str, score) -> DataFrame:
    images = _images(spark, sf_dir)
    one = _target(images).select(F.col(column).alias("target"))
    return images.crossJoin(F.broadcast(one)).select("vec_id", *[e.alias(n) for n, e in score(F.col(column), F.col("target")).items()])


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, Euclidean and squared Euclidean distance and inner product of every embedding to the first."""
    return _against(spark, sf_dir, "e", lambda a, b: {"cos": F.round(v.cosine(a, b), 6), "cos_distance": F.round(v.cosine_distance(a, b), 6), "euclid": F.round(v.euclid(a, b), 6), "sq_euclid": F.round(v.squared_euclid(a, b), 6), "dot": F.round(v.dot(a, b), 6)})


def histogram_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bhattacharyya distance, intersection and the combined similarity to the first embedding as histograms."""
    both = lambda a, b: {"bhattacharyya": F.round(v.bhattacharyya(a, b), 5), "shared": F.round(v.intersection(a, b), 6), "combined": F.round(v.combined_similarity(v.bhattacharyya(a, b), v.cosine(a, b)), 5)}
    return _against(spark, sf_dir, "h", both)


def vec_add_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm of half the sum of every embedding and the first."""
    return _against(spark, sf_dir, "e", lambda a, b: {"norm": F.round(v.norm(v.scale(v.add(a, b), 0.5)), 6)})


def euclid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return similarity.rank_against(images, _target(images), "vec_id", "e", v.euclid("e", "target")).withColumn("score", F.round("score", 6))


def cosine_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return similarity.rank_against(images, _target(images), "vec_id", "e", v.cosine("e", "target"), ascending=False).withColumn("score", F.round("score", 6))


def sparse_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner product, squared Euclidean distance and cosine of every sparse vector to the first by name."""
    t = _sparse(spark, sf_dir)
    one = t.orderBy("key").limit(1).select(F.col("v").alias("target"))
    dot = v.sparse_dot("v", "target")
    return t.crossJoin(F.broadcast(one)).select("key", F.round(dot, 6).alias("dot"), F.round(v.sparse_squared_euclid("v", "target"), 5).alias("sq_euclid"), F.round(v.sparse_cosine("v", "target"), 6).alias("cos"))


PIVOTS, SHUFFLES, REACH = 10, 5, 5


def lsh_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.signatures(_sparse(spark, sf_dir), PIVOTS).select("key", F.array_join("bits", "").alias("bits"))


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.lsh_candidates(_sparse(spark, sf_dir), PIVOTS, SHUFFLES, REACH)


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of the small setting: 10 pivots, 5 shuffles, 5 neighbours either side."""
    return similarity.lsh_pairs(_sparse(spark, sf_dir), 0.7, PIVOTS, SHUFFLES, REACH).withColumn("cos", F.round("cos", 6))


def lsh_pairs_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of the large setting: 100 pivots, 15 shuffles, 10 neighbours either side, 50 non-zero pairs a vector."""
    return similarity.lsh_pairs(_sparse(spark, sf_dir, 50), 0.7, 100, 15, 10).withColumn("cos", F.round("cos", 6))


def lsh_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of whole vectors with cosine above 0.7, no window."""
    return similarity.cosine_pairs(_sparse(spark, sf_dir), 0.7).withColumn("cos", F.round("cos", 6))


K = 4


def kmeanspp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeds of k-means++ with their numbers and first coordinate."""
    seeds = cluster.seed_centroids(cut(_points(spark, sf_dir)), K)
    return spark.createDataFrame([(i, c[0], c[-1]) for i, c in enumerate(seeds)], "cluster int, first double, last double")


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment to the seeds."""
    points = cut(_points(spark, sf_dir))
    return cluster.assign(points, cluster.seed_centroids(points, K)).select("key", "cluster")


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster means after one assignment."""
    points = cut(_points(spark, sf_dir))
    seeds = cluster.seed_centroids(points, K)
    means = cluster.update(cluster.assign(points, seeds), seeds)
    return spark.createDataFrame([(i, round(c[0], 6), round(c[-1], 6)) for i, c in enumerate(means)], "cluster int, first double, last double")


def kmeans_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense k-means, three updates."""
    return cluster.kmeans(_points(spark, sf_dir), K, iterations=3)[0].select("key", "cluster")


def kmeans_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense k-means until nothing changes."""
    return cluster.kmeans(_points(spark, sf_dir), K)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse k-means by cosine distance, at most 10 iterations."""
    entries = _sparse(spark, sf_dir).select("key", F.explode("v").alias("dim", "y"))
    return cluster.kmeans_sparse(entries, K)[0]


def kmeans_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse k-means by squared Euclidean distance from random rows; an empty cluster becomes the zero vector."""
    entries = _sparse(spark, sf_dir).select("key", F.explode("v").alias("dim", "y"))
    return cluster.kmeans_sparse(entries, K, cosine=False, init="random", empty="zero")[0]


def _cop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, constraints): neighbours by id with equal labels must, with adjoining labels cannot share a cluster."""
    images = _images(spark, sf_dir)
    after = images.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("next"))
    pairs = images.join(after, "vec_id").where(F.abs(F.col("label") - F.col("next")) <= 1)
    kind = F.when(F.col("label") == F.col("next"), "m").otherwise("c").alias("kind")
    name = lambda c: F.lpad(c.cast("string"), 12, "0")
    constraints = mirrored(pairs.select(name(F.col("vec_id")).alias("a"), name(F.col("vec_id") + 1).alias("b"), kind))
    return images.select(name(F.col("vec_id")).alias("key"), F.col("e").alias("v")), constraints


def cop_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constrained k-means of the embeddings."""
    return cluster.cop_kmeans(*_cop(spark, sf_dir), 10).select(F.col("key").cast("bigint").alias("vec_id"), "cluster")


def cop_kmeans_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What constrained k-means must satisfy: points with a cluster, constraints of each kind and how many are violated."""
    points, constraints = _cop(spark, sf_dir)
    labels = cut(cluster.cop_kmeans(points, constraints, 10).select("key", "cluster"))
    ends = constraints.join(labels.withColumnsRenamed({"key": "a", "cluster": "ca"}), "a").join(labels.withColumnsRenamed({"key": "b", "cluster": "cb"}), "b")
    broken = F.when((F.col("kind") == "m") != (F.col("ca") == F.col("cb")), 1).otherwise(0)
    found = ends.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(broken).alias("violated"))
    return found.unionByName(labels.where("cluster BETWEEN 0 AND 9").agg(F.lit("points").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("violated")))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir).select(F.col("key").alias("row"), F.explode("v").alias("col", "x"))


def nmf_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row factors after two multiplicative updates."""
    w, _ = nmf.factorize(_counts(spark, sf_dir), 3, iterations=2)
    return w.select("row", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)])


def nmf_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column factors after two multiplicative updates."""
    _, h = nmf.factorize(_counts(spark, sf_dir), 3, iterations=2)
    return h.select("col", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)])


def nmf_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error over the stored cells after two updates."""
    cells = _counts(spark, sf_dir)
    return nmf.stored_error(cells, *nmf.factorize(cells, 3, iterations=2)).select(F.round("error", 4).alias("error"))


def roulette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point at which the running sum of norms reaches 37 % of the total."""
    return cluster.roulette(_points(spark, sf_dir), v.norm("v"), 0.37)


QUERIES = {
    f.__name__: f
    for f in (vec_norm, measures, histogram_measures, vec_add_scale, euclid_top10, cosine_top10, sparse_measures, lsh_bits, lsh_candidates, lsh_pairs, lsh_pairs_100, lsh_pairs_all, kmeanspp_seed, kmeans_assign, kmeans_update, kmeans_dense, kmeans_converged, kmeans_cosine, kmeans_sparse, cop_kmeans, cop_kmeans_check, nmf_w, nmf_h, nmf_error, roulette)
}

_NUM = NUMBER.replace("'", "''").removeprefix("^").removesuffix("$")
_POINTS = rf"""pts AS (SELECT key, min(v) AS v FROM (
  SELECT id AS key, list_transform(string_split(vecstr, ','), lambda x: CASE WHEN regexp_full_match(x, '{_NUM}') THEN try_cast(trim(x) AS DOUBLE) END) AS v FROM kmeanspp WHERE id IS NOT NULL AND vecstr IS NOT NULL)
  WHERE len(v) = 16 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY key)"""
_SPARSE = rf"""lw AS (SELECT word AS key, min(vec) AS vec FROM lsh WHERE word IS NOT NULL AND vec IS NOT NULL AND len(string_split(vec, chr(9))) % 2 = 0
  AND len(list_filter(string_split(vec, chr(9)), lambda x, i: i % 2 = 0 AND NOT (regexp_full_match(x, '{_NUM}') AND isfinite(coalesce(try_cast(trim(x) AS DOUBLE), 'inf'::DOUBLE))))) = 0 GROUP BY word),
lf AS (SELECT key, string_split(vec, chr(9)) AS f FROM lw), le AS (SELECT key, f, unnest(range(1, len(f), 2)) AS i FROM lf),
sp AS (SELECT key, f[i] AS dim, trim(f[i + 1])::DOUBLE AS x, i FROM le),
sv AS (SELECT key, dim, x FROM sp WHERE x <> 0)"""
#: The 100-pivot setting reads 50 entries of a vector.
_FIRST_50 = "sv AS (SELECT key, dim, x FROM sp WHERE x <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY i) <= 50)"
_IMG = "img AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_transform(embedding, lambda x: x::DOUBLE + 1) AS h FROM embeddings), one AS (SELECT vec_id AS t_id, e AS te, h AS th FROM img ORDER BY vec_id LIMIT 1)"
_DOT = "list_inner_product({a}, {b})"
_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
_BHATT = "sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(h, th), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(h) * list_sum(th))))"


def _lsh_sql(count: int, shuffles: int, reach: int) -> str:
    permuted = " UNION ALL ".join(f"SELECT {s} AS shuffle, key, {' || '.join(f'bits[{i + 1}]' for i in permutation(count, s))} AS code FROM bits" for s in range(shuffles))
    pairs = " UNION ALL ".join(f"SELECT key AS a, lead(key, {d}) OVER w AS b FROM sh WINDOW w AS (PARTITION BY shuffle ORDER BY code, key)" for d in range(1, reach + 1))
    return f"""WITH {_SPARSE}, keys AS (SELECT DISTINCT key FROM sv),
pk AS (SELECT key, row_number() OVER (ORDER BY md5(key || ':1'), key) - 1 AS p_no FROM keys QUALIFY p_no < {count}),
pv AS (SELECT p_no, dim, x FROM pk JOIN sv USING (key)),
pos AS (SELECT sv.key, p_no FROM sv JOIN pv USING (dim) GROUP BY sv.key, p_no HAVING sum(sv.x * pv.x) > 0),
grid AS (SELECT keys.key, g.i, CASE WHEN pos.p_no IS NULL THEN '0' ELSE '1' END AS bit FROM keys CROSS JOIN range({count}) g(i) LEFT JOIN pos ON pos.key = keys.key AND pos.p_no = g.i),
bits AS (SELECT key, string_agg(bit, '' ORDER BY i) AS bits FROM grid GROUP BY key), sh AS ({permuted}),
cand AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({pairs}) WHERE b IS NOT NULL),
nrm AS (SELECT key, sqrt(sum(x * x)) AS n FROM sv GROUP BY key),
cs AS (SELECT a, b, coalesce(sum(u.x * w.x), 0) / any_value(na.n * nb.n) AS cos FROM cand JOIN sv u ON u.key = a JOIN nrm na ON na.key = a JOIN nrm nb ON nb.key = b LEFT JOIN sv w ON w.key = b AND w.dim = u.dim GROUP BY a, b)"""


def _kmeans_sql(steps: int) -> str:
    parts = [_POINTS, "c0_0 AS (SELECT v FROM pts ORDER BY md5(key || ':1'), key LIMIT 1)"]
    square = "list_sum(list_transform(list_zip(p.v, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    seeds = "seeds0 AS (SELECT 0 AS cluster, v FROM c0_0)"
    parts.append(seeds)
    for j in range(1, K):
        near = f"(SELECT p.key, p.v, min({square.format(c='s.v')}) AS w FROM pts p CROSS JOIN seeds{j - 1} s GROUP BY ALL)"
        parts.append(f"pick{j} AS (SELECT v FROM {near} WHERE w > 0 ORDER BY -ln(greatest({uniform_sql('key', f'1-{j}')}, 1e-300)) / w, key LIMIT 1)")
        parts.append(f"seeds{j} AS (SELECT * FROM seeds{j - 1} UNION ALL SELECT {j}, v FROM pick{j})")
    parts.append(f"m0 AS (SELECT * FROM seeds{K - 1})")
    for s in range(1, steps + 2):
        parts.append(f"as{s} AS (SELECT p.key, any_value(p.v) AS v, arg_min(s.cluster, ({square.format(c='s.v')}, s.cluster)) AS cluster FROM pts p CROSS JOIN m{s - 1} s GROUP BY p.key)")
        means = "[" + ", ".join(f"avg(v[{i}])" for i in range(1, 17)) + "]"
        parts.append(f"n{s} AS (SELECT cluster, {means} AS v FROM as{s} GROUP BY cluster)")
        parts.append(f"m{s} AS (SELECT cluster, coalesce(n.v, o.v) AS v FROM m{s - 1} o LEFT JOIN n{s} n USING (cluster))")
    return "WITH " + ",\n".join(parts)


def _kmeans_sparse_sql(cosine: bool, smart: bool, keep: bool, steps: int = 10) -> str:
    """Sparse k-means: seeds, then ``steps`` rounds; a round that changes nothing is followed by the same again."""
    parts = [_SPARSE, "sz AS MATERIALIZED (SELECT key, sum(x * x) AS a2 FROM sv GROUP BY key)"]

    def nearest(name: str, centroids: str, k: int) -> None:
        d = "1 - coalesce(dot / nullif(sqrt(a2 * coalesce(c2, 0)), 0), 0)" if cosine else "a2 + coalesce(c2, 0) - 2 * coalesce(dot, 0)"
        parts.append(f"""{name} AS MATERIALIZED (SELECT z.key, min(round({d}, 9)) AS w, arg_min(k.cluster, (round({d}, 9), k.cluster)) AS cluster FROM sz z CROSS JOIN (SELECT unnest(range({k})) AS cluster) k
LEFT JOIN (SELECT sv.key, c.cluster, sum(sv.x * c.x) AS dot FROM sv JOIN {centroids} c USING (dim) GROUP BY ALL) s ON s.key = z.key AND s.cluster = k.cluster
LEFT JOIN (SELECT cluster, sum(x * x) AS c2 FROM {centroids} GROUP BY cluster) l ON l.cluster = k.cluster GROUP BY z.key)""")

    if smart:
        parts.append("k0 AS MATERIALIZED (SELECT 0 AS cluster, key FROM sz ORDER BY md5(key || ':1'), key LIMIT 1)")
        for j in range(1, K):
            parts.append(f"e{j} AS MATERIALIZED (SELECT cluster, dim, x FROM sv JOIN k{j - 1} USING (key))")
            nearest(f"near{j}", f"e{j}", j)
            parts.append(f"k{j} AS MATERIALIZED (SELECT * FROM k{j - 1} UNION ALL (SELECT {j}, key FROM near{j} WHERE w > 0 ORDER BY -ln(greatest({uniform_sql('key', f'1-{j}')}, 1e-300)) / w, key LIMIT 1))")
    else:
        parts.append(f"k{K - 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(key || ':1'), key) - 1 AS cluster, key FROM sz QUALIFY cluster < {K})")
    parts.append(f"m0 AS MATERIALIZED (SELECT cluster, dim, x FROM sv JOIN k{K - 1} USING (key))")
    for s in range(1, steps + 1):
        nearest(f"as{s}", f"m{s - 1}", K)
        kept = f" UNION ALL SELECT * FROM m{s - 1} WHERE cluster NOT IN (SELECT cluster FROM as{s})" if keep else ""
        parts.append(f"m{s} AS MATERIALIZED (SELECT cluster, dim, sum(x) / any_value(n) AS x FROM sv JOIN as{s} USING (key) JOIN (SELECT cluster, count(*) AS n FROM as{s} GROUP BY cluster) USING (cluster) GROUP BY cluster, dim{kept})")
    return "WITH " + ",\n".join(parts) + f" SELECT key, cluster FROM as{steps}"


def _nmf_sql(steps: int) -> str:
    k = range(3)
    u = lambda key, i, side: uniform_sql(key, f"1-{side}{i}")
    parts = [_SPARSE, "cell AS (SELECT key AS row, dim AS col, x FROM sv)"]
    parts.append(f"w0 AS (SELECT row, {', '.join(f'{u("row", i, "w")} AS f{i}' for i in k)} FROM (SELECT DISTINCT row FROM cell))")
    parts.append(f"h0 AS (SELECT col, {', '.join(f'{u("col", i, "h")} AS f{i}' for i in k)} FROM (SELECT DISTINCT col FROM cell))")

    def scaled(name: str, of: str, key: str) -> str:
        size = "sqrt((SELECT sum(" + " + ".join(f"f{i} * f{i}" for i in k) + f") FROM {of}))"
        return f"{name} AS (SELECT {key}, {', '.join(f'f{i} / {size} AS f{i}' for i in k)} FROM {of})"

    parts.append(scaled("w0n", "w0", "row"))
    w, h = "w0n", "h0"
    for s in range(1, steps + 1):
        gram = lambda of: ", ".join(f"sum(f{i} * f{j}) AS g{i}{j}" for i in k for j in k) + f" FROM {of}"
        parts.append(f"gw{s} AS (SELECT {gram(w)}), gh{s} AS (SELECT {gram(h)})")
        parts.append(f"wv{s} AS (SELECT col, {', '.join(f'sum(x * f{i}) AS v{i}' for i in k)} FROM cell JOIN {w} USING (row) GROUP BY col)")
        parts.append(f"vh{s} AS (SELECT row, {', '.join(f'sum(x * f{i}) AS v{i}' for i in k)} FROM cell JOIN {h} USING (col) GROUP BY row)")
        den = lambda i: " + ".join(f"f{j} * g{j}{i}" for j in k)
        new = lambda i: f"CASE WHEN ({den(i)}) > 0 THEN f{i} * v{i} / ({den(i)}) ELSE f{i} END AS f{i}"
        parts.append(f"hu{s} AS (SELECT col, {', '.join(new(i) for i in k)} FROM {h} JOIN wv{s} USING (col) CROSS JOIN gw{s})")
        parts.append(f"w{s} AS (SELECT row, {', '.join(new(i) for i in k)} FROM {w} JOIN vh{s} USING (row) CROSS JOIN gh{s})")
        parts.append(scaled(f"h{s}", f"hu{s}", "col"))
        w, h = f"w{s}", f"h{s}"
    parts.append(scaled("wn", w, "row"))
    return "WITH " + ",\n".join(parts) + f", hn AS (SELECT * FROM {h})"


_LSH = _lsh_sql(PIVOTS, SHUFFLES, REACH)
_F3 = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(3))

ORACLES = {
    "vec_norm": f"WITH {_POINTS} SELECT key, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM pts",
    "measures": f"WITH {_IMG} SELECT vec_id, round({_COS.format(a='e', b='te')}, 6) AS cos, round(1 - {_COS.format(a='e', b='te')}, 6) AS cos_distance, round(sqrt(list_sum(list_transform(list_zip(e, te), lambda p: (p[1] - p[2]) ** 2))), 6) AS euclid, round(list_sum(list_transform(list_zip(e, te), lambda p: (p[1] - p[2]) ** 2)), 6) AS sq_euclid, round({_DOT.format(a='e', b='te')}, 6) AS dot FROM img CROSS JOIN one",
    "histogram_measures": f"WITH {_IMG} SELECT vec_id, round({_BHATT}, 5) AS bhattacharyya, round(list_sum(list_transform(list_zip(h, th), lambda p: least(p[1], p[2]))), 6) AS shared, round(0.3 * (1 - {_BHATT}) + 1.5 * {_COS.format(a='h', b='th')}, 5) AS combined FROM img CROSS JOIN one",
    "vec_add_scale": f"WITH {_IMG} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(e, te), lambda p: ((p[1] + p[2]) * 0.5) ** 2))), 6) AS norm FROM img CROSS JOIN one",
    "kmeans_converged": _kmeans_sql(99).replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + " SELECT cluster, count(*) AS n FROM as100 GROUP BY cluster",
    "cop_kmeans_check": """WITH p AS (SELECT CASE WHEN a.label = b.label THEN 'm' ELSE 'c' END AS kind FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND abs(a.label - b.label) <= 1)
SELECT kind, 2 * count(*) AS n, 0::BIGINT AS violated FROM p GROUP BY kind UNION ALL SELECT 'points', count(*), 0 FROM embeddings""",
    "kmeans_cosine": _kmeans_sparse_sql(True, True, True),
    "kmeans_sparse": _kmeans_sparse_sql(False, False, False),
    "euclid_top10": f"WITH {_IMG} SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(e, te), lambda p: (p[1] - p[2]) ** 2))), 6) AS score FROM img CROSS JOIN one WHERE vec_id <> t_id ORDER BY score, vec_id LIMIT 10",
    "cosine_top10": f"WITH {_IMG} SELECT vec_id, round({_COS.format(a='e', b='te')}, 6) AS score FROM img CROSS JOIN one WHERE vec_id <> t_id ORDER BY score DESC, vec_id LIMIT 10",
    "sparse_measures": f"WITH {_SPARSE}, o AS (SELECT dim, x AS t FROM sv WHERE key = (SELECT min(key) FROM sv)), b AS (SELECT sum(t * t) AS b2 FROM o) SELECT key, round(coalesce(sum(x * t), 0), 6) AS dot, round(greatest(0, sum(x * x) + any_value(b2) - 2 * coalesce(sum(x * t), 0)), 5) AS sq_euclid, round(coalesce(sum(x * t), 0) / (sqrt(sum(x * x)) * sqrt(any_value(b2))), 6) AS cos FROM sv LEFT JOIN o USING (dim) CROSS JOIN b GROUP BY key",
    "lsh_bits": f"{_LSH} SELECT key, bits FROM bits",
    "lsh_candidates": f"{_LSH} SELECT a, b FROM cand",
    "lsh_pairs": f"{_LSH} SELECT a, b, round(cos, 6) AS cos FROM cs WHERE cos > 0.7",
    "lsh_pairs_100": f"{_lsh_sql(100, 15, 10).replace('sv AS (SELECT key, dim, x FROM sp WHERE x <> 0)', _FIRST_50)} SELECT a, b, round(cos, 6) AS cos FROM cs WHERE cos > 0.7",
    "lsh_pairs_all": f"""WITH {_SPARSE}, al AS (SELECT key, dim, x FROM sp WHERE x <> 0 QUALIFY row_number() OVER (PARTITION BY key, dim ORDER BY i DESC) = 1), nrm AS (SELECT key, sqrt(sum(x * x)) AS n FROM al GROUP BY key),
cs AS (SELECT u.key AS a, w.key AS b, sum(u.x * w.x) / any_value(na.n * nb.n) AS cos FROM al u JOIN al w ON u.dim = w.dim AND u.key < w.key JOIN nrm na ON na.key = u.key JOIN nrm nb ON nb.key = w.key GROUP BY u.key, w.key) SELECT a, b, round(cos, 6) AS cos FROM cs WHERE cos > 0.7""",
    "kmeanspp_seed": f"{_kmeans_sql(0)} SELECT CAST(cluster AS INT) AS cluster, v[1] AS first, v[16] AS last FROM m0",
    "kmeans_assign": f"{_kmeans_sql(0)} SELECT key, CAST(cluster AS INT) AS cluster FROM as1",
    "kmeans_update": f"{_kmeans_sql(1)} SELECT CAST(cluster AS INT) AS cluster, round(v[1], 6) AS first, round(v[16], 6) AS last FROM m1",
    "kmeans_dense": f"{_kmeans_sql(3)} SELECT key, CAST(cluster AS INT) AS cluster FROM as4",
    "nmf_w": f"{_nmf_sql(2)} SELECT row, {_F3} FROM wn",
    "nmf_h": f"{_nmf_sql(2)} SELECT col, {_F3} FROM hn",
    "nmf_error": f"{_nmf_sql(2)} SELECT round(sum((x - ({' + '.join(f'wn.f{i} * hn.f{i}' for i in range(3))})) ** 2), 4) AS error FROM cell JOIN wn USING (row) JOIN hn USING (col)",
    "roulette": f"WITH {_POINTS}, r AS (SELECT key, md5(key || ':roulette') AS o, sum(sqrt(list_inner_product(v, v))) OVER (ORDER BY md5(key || ':roulette'), key) AS run, sum(sqrt(list_inner_product(v, v))) OVER () AS total FROM pts) SELECT key FROM r WHERE run >= 0.37 * total ORDER BY o, key LIMIT 1",
}

"""Round trips through the text and binary formats: a stored table is written by a sink and read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import images as kernels
from cairn.operators import factorize
from cairn.operators import features as ops
from cairn.operators.ranking import run_groups as grouped_runs
from cairn.plans.bags import _descriptors
from cairn.plans.ratings import _GD, _gd
from cairn.runtime import run_folder
from cairn.sources import readers, sinks
from cairn.sources.tables import table


def _place(spark: SparkSession) -> str:
    """A fresh path in this run's folder of the shared checkpoint folder."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def _written(lines: DataFrame) -> str:
    """The path of ``lines`` (value) written as text."""
    path = _place(lines.sparkSession)
    lines.write.text(path)
    return path


def articles_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as ``[[key]]`` articles of two lines."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    path = _written(p.select(F.concat(F.lit("[["), F.col("p_partkey").cast("string"), F.lit("]]\n"), "p_brand", F.lit("\n"), "p_type").alias("value")))
    return readers.articles(spark, path)


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pages of an XML dump."""
    path = _place(spark)
    p = table(spark, sf_dir, "part", F.col("p_name").alias("title"), F.col("p_partkey").alias("id"), F.struct(F.col("p_type").alias("text")).alias("revision"))
    p.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.pages_xml(spark, path)


def _line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("key"), "l_quantity")
    return lines.groupBy("label", "key").agg(F.sum("l_quantity").alias("value"))


def sparse_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sparse vectors of their lines' quantities."""
    return readers.sparse_tsv(spark, _written(sinks.pairs_line(_line_pairs(spark, sf_dir), "label", "key", "value"))).withColumn("value", F.round("value", 6))


def feature_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of tfidf numbered in order."""
    words = table(spark, sf_dir, "tfidf", F.col("word").alias("key")).where("key IS NOT NULL")
    return readers.feature_index(words).withColumn("index", F.col("index").cast("bigint"))


def dense_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as lines of numbers, one row a coordinate."""
    d = _descriptors(spark, sf_dir).select("vec_id", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))
    path = _place(spark)
    sinks.tsv(d, path)
    each = readers.dense_tsv(spark, path).select("id", F.posexplode("vec").alias("dim", "x"))
    return each.select("id", "dim", F.round("x", 6).alias("x"))


def constraints_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations of a region as must-link lines, those of the next region as cannot-link lines; nation 3 is unknown."""
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    m = n.select(F.col("n_nationkey").alias("o_key"), F.col("n_regionkey").alias("o_region"))
    pairs = n.join(m, (F.col("o_region") - F.col("n_regionkey")).isin(0, 1)).where("n_nationkey < o_key")
    path = _place(spark)
    sinks.tsv(pairs.select("n_nationkey", "o_key", F.when(F.col("n_regionkey") == F.col("o_region"), "m").otherwise("c").alias("kind")), path)
    return readers.constraints(spark, path, n.where("n_nationkey <> 3").select(F.col("n_nationkey").alias("label")))


def ratings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values as ratings of orders by customers, with a fourth column that is ignored."""
    path = _place(spark)
    sinks.tsv(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), path)
    return readers.ratings_tsv(spark, path).withColumn("rate", F.round("rate", 4))


def movielens_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``user::item::rate::time`` lines."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    path = _written(o.select(F.concat_ws("::", "o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string")).alias("value")))
    return readers.movielens_1m(spark, path)


def movielens_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one line ``item:rate:time``, by item."""
    r = movielens_read(spark, sf_dir).select("user", F.struct("item", "rate", "ts").alias("e"))
    listed = F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat_ws(":", e["item"].cast("string"), e["rate"], e["ts"]))
    return r.groupBy("user").agg(F.array_join(listed, "\t").alias("line"))


def folds_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order values written by fold: orders and highest value of each fold."""
    path = _place(spark)
    o = table(spark, sf_dir, "orders", F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("rate"))
    sinks.folds(o, path, 5)
    return spark.read.parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("top"))


def edges_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts packed to six bytes an edge, stored and unpacked."""
    e = table(spark, sf_dir, "pagerank", F.col("id").alias("src"), F.col("linkid").alias("dst"), "cnt").where("linkid > 0 AND linkid < 4294967296 AND cnt > 0")
    path = _place(spark)
    sinks.adjacency(e.groupBy("src", "dst").agg(F.sum("cnt").alias("n")), path)
    return readers.packed_edges(spark.read.parquet(path), "src", "data")


def dictionaries_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary stored keyed either way and joined to itself."""
    path = _place(spark)
    sinks.dictionaries(table(spark, sf_dir, "part", F.col("p_name").alias("keyword"), F.col("p_partkey").alias("id")), path)
    there, back = spark.read.parquet(f"{path}/keyword2id"), spark.read.parquet(f"{path}/id2keyword")
    return there.join(back.withColumnRenamed("keyword", "again"), "id").select("keyword", "id", (F.col("keyword") == F.col("again")).alias("same"))


def centroids_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse centroid lines as dense vectors of 8 dimensions, one row a coordinate."""
    rows = _line_pairs(spark, sf_dir).where("key < 8")
    dense = readers.centroid_tsv(spark, _written(sinks.pairs_line(rows, "label", "key", "value")), 8)
    return dense.select("cluster", F.posexplode("vec").alias("dim", "x")).where("x <> 0").withColumn("x", F.round("x", 6))


def _image_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptors(spark, sf_dir)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: x.cast("string")), "\t")
    return d.groupBy("image").agg(listed.alias("ids"), F.count(F.lit(1)).alias("n"))


def descriptor_map_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side map of a descriptor dump: which descriptors an image has."""
    lines = _image_lines(spark, sf_dir).select(F.concat(F.lit("set/"), F.col("image").cast("string"), F.lit(".jpg\t"), "ids").alias("value"))
    return readers.descriptor_map(spark, _written(lines))


def file_counts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts file beside a descriptor dump."""
    path = _place(spark)
    sinks.tsv(_image_lines(spark, sf_dir).select("image", "n"), path)
    return readers.file_counts(spark, path).select("file", "n")


def word_labels_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines with more than the 5 weights that count."""
    lines = sinks.pairs_line(_line_pairs(spark, sf_dir), "label", "key", "value")
    return readers.word_labels(spark, _written(lines)).select("desc_id", "vword", F.round("w", 6).alias("w"))


def bags_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bags of features whose files lie in a directory named after the order's last digit."""
    rows = _line_pairs(spark, sf_dir).withColumn("label", F.concat_ws("/", F.lit("img"), (F.col("label") % 10).cast("string"), F.concat(F.col("label").cast("string"), F.lit(".jpg"))))
    return readers.bag_tsv(spark, _written(sinks.pairs_line(rows, "label", "key", "value"))).withColumn("value", F.round("value", 6))


def factor_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors printed with four decimals."""
    path = _place(spark)
    sinks.factor_matrix(_descriptors(spark, sf_dir).select("vec_id", F.slice("v", 1, 3).alias("f")), path, "vec_id", 4)
    return spark.read.text(path).select(F.col("value").alias("line"))


def rate_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted rate of every user and item, block by block."""
    _, u, v = _gd(spark, sf_dir)
    return factorize.top_items(u, v, max(1, v.count())).select("user", "item", F.round("rate", 5).alias("rate"))


def run_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of one type, in order of their ids: number, type and length of each."""
    runs = grouped_runs(table(spark, sf_dir, "events", "event_id", "event_type"), ["event_id"], "event_type")
    return runs.groupBy("run", "event_type").agg(F.count(F.lit(1)).alias("n"))


def cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 files of one cluster (label 3)."""
    files = _descriptors(spark, sf_dir).where("label = 3").select(F.concat(F.lit("set/"), F.lpad(F.col("vec_id").cast("string"), 9, "0"), F.lit(".jpg")).alias("path"))
    return files.orderBy("path").limit(15)


def colour_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 7 colour pictures: the first 63 coordinates of an embedding as bytes, blue, green and red in turn."""
    byte = F.transform(F.slice("v", 1, 63), lambda x: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x + 0.5) * 256))).cast("int")), 2, "0"))
    d = _descriptors(spark, sf_dir)
    return d.select(F.col("vec_id").cast("string").alias("path"), F.lit(3).alias("height"), F.lit(7).alias("width"), F.lit(3).alias("channels"), F.unhex(F.array_join(byte, "")).alias("pixels"))


def _bins(spark: SparkSession, sf_dir: str, kernel) -> DataFrame:
    each = ops.image_feature(colour_pictures(spark, sf_dir), kernel).select("path", F.posexplode("feature").alias("bin", "x"))
    return each.where("x <> 0").select("path", "bin", F.round("x", 6).alias("x"))


def bgr_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied bins of every picture's 16 x 16 x 16 colour histogram, of Euclidean length 1."""
    return _bins(spark, sf_dir, kernels.bgr_histogram)


def rgb_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied bins of every picture's 768 red, green and blue counts."""
    return _bins(spark, sf_dir, kernels.rgb_counts)


def hsv_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied bins of every picture's 30 x 32 hue and saturation histogram, of sum 1."""
    return _bins(spark, sf_dir, kernels.hsv_histogram)


def tensor_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occupied bin of the colour histograms, printed with three decimals."""
    return bgr_bins(spark, sf_dir).select("path", F.format_string("%d %.3f", "bin", "x").alias("line"))


_ALL = (articles_read, pages_read, sparse_read, feature_numbers, dense_read, constraints_read, ratings_read, movielens_read, movielens_sorted, folds_read, edges_read, dictionaries_read, centroids_read)
_ALL += (descriptor_map_read, file_counts_read, word_labels_read, bags_read, factor_dump, rate_dump, run_groups, cluster_files, bgr_bins, rgb_bins, hsv_bins, tensor_print)
QUERIES = {f.__name__: f for f in _ALL}

_IMAGE = "img AS (SELECT vec_id, vec_id // 10 AS image, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_PIXELS = """px AS (SELECT CAST(vec_id AS VARCHAR) AS path, unnest(range(21)) AS i, list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((x::DOUBLE + 0.5) * 256))) AS INT)) AS p FROM embeddings),
bgr AS (SELECT path, p[3 * i + 1] AS b, p[3 * i + 2] AS g, p[3 * i + 3] AS r FROM px)"""
_BGR = f"""WITH {_PIXELS}, n AS (SELECT path, CAST((b // 16) * 256 + (g // 16) * 16 + r // 16 AS INT) AS bin, count(*)::DOUBLE AS n FROM bgr GROUP BY ALL)
SELECT path, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY path)), 6) AS x FROM n"""
_LINES = "FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) WHERE l_quantity <> 0"
ORACLES = {
    "articles_read": "SELECT CAST(p_partkey AS VARCHAR) AS title, p_brand || chr(10) || p_type AS body FROM part",
    "pages_read": "SELECT p_name AS title, p_partkey AS id, p_type AS text FROM part",
    "sparse_read": f"SELECT CAST(l_orderkey AS VARCHAR) AS label, CAST(l_linenumber AS VARCHAR) AS key, round(l_quantity, 6) AS value {_LINES}",
    "feature_numbers": "SELECT word AS key, row_number() OVER (ORDER BY word) - 1 AS index FROM (SELECT DISTINCT word FROM tfidf WHERE word IS NOT NULL)",
    "dense_read": f"WITH {_IMAGE} SELECT CAST(vec_id AS VARCHAR) AS id, CAST(unnest(range(len(v))) AS INT) AS dim, round(unnest(v), 6) AS x FROM img",
    "constraints_read": """WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'm' ELSE 'c' END AS kind FROM nation a JOIN nation b ON b.n_regionkey - a.n_regionkey IN (0, 1) AND a.n_nationkey < b.n_nationkey
  WHERE a.n_nationkey <> 3 AND b.n_nationkey <> 3)
SELECT DISTINCT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, kind FROM (SELECT a, b, kind FROM p UNION ALL SELECT b, a, kind FROM p)""",
    "ratings_read": 'SELECT o_custkey AS "user", o_orderkey AS item, round(o_totalprice, 4) AS rate FROM orders',
    "movielens_read": "SELECT o_custkey AS \"user\", o_orderkey AS item, substr(o_orderpriority, 1, 1) AS rate, CAST(o_orderkey AS VARCHAR) AS ts FROM orders",
    "movielens_sorted": "SELECT o_custkey AS \"user\", string_agg(o_orderkey || ':' || substr(o_orderpriority, 1, 1) || ':' || o_orderkey, chr(9) ORDER BY o_orderkey) AS line FROM orders GROUP BY o_custkey",
    "folds_read": "SELECT CAST(('0x' || substr(md5(o_custkey || '|' || o_orderkey || ':fold1'), 1, 8))::BIGINT % 5 + 1 AS INT) AS fold, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL",
    "edges_read": "SELECT id AS src, linkid AS dst, CAST(least(sum(cnt), 65535) AS BIGINT) AS n FROM pagerank WHERE linkid > 0 AND linkid < 4294967296 AND cnt > 0 AND id IS NOT NULL GROUP BY ALL",
    "dictionaries_read": "SELECT p_name AS keyword, p_partkey AS id, true AS same FROM part",
    "centroids_read": f"SELECT CAST(l_orderkey AS VARCHAR) AS cluster, CAST(l_linenumber AS INT) AS dim, round(l_quantity, 6) AS x {_LINES} AND l_linenumber < 8",
    "descriptor_map_read": f"WITH {_IMAGE} SELECT 'set/' || image || '.jpg' AS file, vec_id AS desc_id FROM img",
    "file_counts_read": f"WITH {_IMAGE} SELECT CAST(image AS VARCHAR) AS file, count(*) AS n FROM img GROUP BY image",
    "word_labels_read": f"SELECT l_orderkey AS desc_id, CAST(l_linenumber AS BIGINT) AS vword, round(l_quantity, 6) AS w {_LINES} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 5",
    "bags_read": f"SELECT CAST(l_orderkey % 10 AS VARCHAR) AS category, 'img/' || l_orderkey % 10 || '/' || l_orderkey || '.jpg' AS file, CAST(l_linenumber AS VARCHAR) AS key, round(l_quantity, 6) AS value {_LINES}",
    "factor_dump": f"WITH {_IMAGE} SELECT vec_id || chr(9) || printf('%.4f', v[1]) || chr(9) || printf('%.4f', v[2]) || chr(9) || printf('%.4f', v[3]) AS line FROM img",
    "rate_dump": f'{_GD} SELECT "user", item, round(guess, 5) AS rate FROM pr',
    "run_groups": """WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) OR row_number() OVER (ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS new FROM events),
r AS (SELECT event_type, CAST(sum(new) OVER (ORDER BY event_id) AS BIGINT) AS run FROM f) SELECT run, event_type, count(*) AS n FROM r GROUP BY ALL""",
    "cluster_files": "SELECT 'set/' || lpad(CAST(vec_id AS VARCHAR), 9, '0') || '.jpg' AS path FROM embeddings WHERE label = 3 ORDER BY path LIMIT 15",
    "bgr_bins": _BGR,
    "rgb_bins": f"""WITH {_PIXELS}, c AS (SELECT path, r AS bin FROM bgr UNION ALL SELECT path, 256 + g FROM bgr UNION ALL SELECT path, 512 + b FROM bgr)
SELECT path, CAST(bin AS INT) AS bin, count(*)::DOUBLE AS x FROM c GROUP BY ALL""",
    "hsv_bins": f"""WITH {_PIXELS}, t AS (SELECT path, b::DOUBLE AS b, g::DOUBLE AS g, r::DOUBLE AS r, greatest(b, g, r)::DOUBLE AS hi, least(b, g, r)::DOUBLE AS lo FROM bgr),
h AS (SELECT path, hi, hi - lo AS span, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END * 60 AS raw FROM t),
v AS (SELECT path, (raw - 360 * floor(raw / 360)) / 2 AS hue, CASE WHEN hi > 0 THEN span / hi ELSE 0 END * 255 AS sat FROM h),
n AS (SELECT path, CAST(least(29, floor(hue * 30 / 180)) * 32 + least(31, floor(sat * 32 / 256)) AS INT) AS bin, count(*)::DOUBLE AS n FROM v GROUP BY ALL)
SELECT path, bin, round(n / sum(n) OVER (PARTITION BY path), 6) AS x FROM n""",
    "tensor_print": f"SELECT path, printf('%d %.3f', bin, x) AS line FROM ({_BGR})",
}

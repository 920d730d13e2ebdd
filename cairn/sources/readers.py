"""Readers of the text formats: articles, page dumps, vectors, constraints, ratings, descriptors, edge lists, images.

Every reader returns a DataFrame with an explicit schema; malformed lines are dropped one by one and never touch
their neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.seeded import digest
from cairn.functions.text import extension, parent_directory, split_keep, to_double, to_int

Paths = str | list[str]


def articles(spark: SparkSession, path: Paths, name_pattern: str | None = None) -> DataFrame:
    """(title, body) of files made of ``[[title]]`` lines and the lines below each; the last article of a file counts.

    ``name_pattern`` is a glob on file names. Articles with an empty title or body are dropped.
    """
    reader = spark.read
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    parts = F.split(F.concat(F.lit("\n"), F.col("value")), r"\n(?=\[\[[^\n]+\]\][ \t]*\r?(?:\n|$))")
    one = reader.text(path, wholetext=True).select(F.explode(parts).alias("a"))
    head = r"(?s)^\n?\[\[([^\n]+)\]\][ \t]*\r?(?:\n(.*))?$"
    return one.select(F.regexp_extract("a", head, 1).alias("title"), F.btrim(F.regexp_extract("a", head, 2), F.lit(" \t\r\n")).alias("body")).where("title <> '' AND body <> ''")


def pages_xml(spark: SparkSession, path: Paths) -> DataFrame:
    """(title, id, text) of a page dump, one row per <page>; split and parsed in parallel by the XML source."""
    schema = "title STRING, id BIGINT, revision STRUCT<text: STRING>, text STRING"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return raw.select("title", "id", F.coalesce("revision.text", "text").alias("text"))


def _pairs(fields: Column, first: int) -> Column:
    """Struct array (key, value) of alternating fields from position ``first`` (1-based) on; zero values are dropped."""
    rest = F.slice(fields, first, F.greatest(F.size(fields) - (first - 1), F.lit(0)))
    keys, values = F.filter(rest, lambda x, i: i % 2 == 0), F.filter(rest, lambda x, i: i % 2 == 1)
    return F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), to_double(v).alias("value"))), lambda p: p["value"] != 0)


def sparse_vector(value: Column, delimiter: str = r"\t", limit: int | None = None) -> Column:
    """Decode ``key value key value ...`` into a map; at most the first ``limit`` non-zero pairs. Of a repeated key the last counts."""
    pairs = _pairs(F.split(value, delimiter), 1)
    if limit is not None:
        pairs = F.slice(pairs, 1, limit)
    # bound to a lambda's variable, the pairs are decoded once and not for every element
    last = lambda e: F.filter(e, lambda p, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda q: q["key"] == p["key"]))
    return F.transform(F.array(pairs), lambda e: F.map_from_entries(last(e)))[0]


def sparse_tsv(spark: SparkSession, path: Paths, label: str = "label") -> DataFrame:
    """(label, key, value) of lines ``label TAB key TAB value ...``; lines with an even number of fields are dropped."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") % 2 == 1)
    return lines.select(F.col("f")[0].alias(label), F.explode(_pairs(F.col("f"), 2)).alias("p")).select(label, "p.key", "p.value")


def feature_index(vectors: DataFrame, key: str = "key") -> DataFrame:
    """(key, index): a dictionary of the keys in order of their names, numbered from 0 without a single-task sort."""
    from cairn.operators.ranking import global_rank

    return global_rank(vectors.select(key).distinct(), [key], "index")


def dense_tsv(spark: SparkSession, path: Paths) -> DataFrame:
    """(id, vec ARRAY<DOUBLE>) of lines ``id TAB v1,v2,...``."""
    return spark.read.schema("id STRING, v STRING").csv(path, sep="\t", quote="").where("v IS NOT NULL").select("id", F.transform(F.split("v", ","), to_double).alias("vec"))


def constraints(spark: SparkSession, path: Paths, labels: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, kind) of lines ``a TAB b TAB m|c``, mirrored; lines with unknown labels or kinds are dropped."""
    raw = spark.read.schema("a STRING, b STRING, kind STRING").csv(path, sep="\t", quote="").where("kind IN ('m', 'c') AND a <> b")
    known = labels.select(F.col(label).cast("string").alias("k")).distinct()
    raw = raw.join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi")
    return mirrored(raw)


def mirrored(pairs: DataFrame) -> DataFrame:
    """(a, b, kind) with both directions of every pair, each once."""
    return pairs.select("a", "b", "kind").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "kind")).distinct()


def ratings_tsv(spark: SparkSession, path: Paths) -> DataFrame:
    """(user, item, rate) of lines ``user TAB item TAB rate``; further columns are ignored, of repeated cells the last line counts."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3).select(to_int(f[0]).alias("user"), to_int(f[1]).alias("item"), to_double(f[2]).alias("rate"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("user", "item").agg(F.max_by("rate", "at").alias("rate"))


def matrix_extent(ratings: DataFrame) -> DataFrame:
    """One row (max_user, max_item): the size of the rating matrix."""
    return ratings.agg(F.max("user").alias("max_user"), F.max("item").alias("max_item"))


def movielens_1m(spark: SparkSession, path: Paths) -> DataFrame:
    """(user, item, rate, ts) of lines ``user::item::rate::ts``; of repeated cells the last line counts."""
    f = F.split("value", "::")
    rows = spark.read.text(path).where(F.size(f) == 4).select(to_int(f[0]).alias("user"), to_int(f[1]).alias("item"), f[2].alias("rate"), f[3].alias("ts"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("user", "item").agg(F.max_by(F.struct("rate", "ts"), "at").alias("r")).select("user", "item", "r.rate", "r.ts")


def fold_files(spark: SparkSession, directory: str) -> DataFrame:
    """(user, item, rate, fold, split) of ``u{i}.base`` and ``u{i}.test`` files of a directory, however many there are."""
    rows = spark.read.option("pathGlobFilter", "u*.{base,test}").text(directory).select("value", F.input_file_name().alias("file"))
    f = F.split("value", "\t")
    name = lambda g: F.regexp_extract("file", r"u(\d+)\.(base|test)$", g)
    return rows.where((F.size(f) >= 3) & (name(1) != "")).select(to_int(f[0]).alias("user"), to_int(f[1]).alias("item"), to_double(f[2]).alias("rate"), name(1).cast("int").alias("fold"), name(2).alias("split"))


def packed_edges(df: DataFrame, key: str, data: str) -> DataFrame:
    """(src, dst, n) of a binary adjacency column: six bytes an edge, a 32-bit target and a 16-bit count, big-endian."""
    at = F.sequence(F.lit(0), (F.length(data) / 6).cast("int") - 1)
    number = lambda i, skip, size: F.conv(F.hex(F.substring(F.col(data), i * 6 + 1 + skip, F.lit(size))), 16, 10).cast("bigint")
    each = df.where(F.length(data) >= 6).select(F.col(key).alias("src"), data, F.explode(at).alias("i"))
    return each.select("src", number(F.col("i"), 0, 4).alias("dst"), number(F.col("i"), 4, 2).alias("n"))


def pack_edges(edges: DataFrame) -> DataFrame:
    """(src, data): the inverse of ``packed_edges``, targets by count descending, then target; counts stop at 65535."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("dst").alias("d"))))
    text = F.array_join(F.transform("e", lambda e: F.concat(F.lpad(F.hex(e["d"]), 8, "0"), F.lpad(F.hex(F.least(-e["k"], F.lit(65535))), 4, "0"))), "")
    return edges.groupBy("src").agg(order.alias("e")).select("src", F.unhex(text).alias("data"))


def key_files(spark: SparkSession, path: Paths, size: int = 128, suffix: str | None = "*.sift") -> DataFrame:
    """(image, idx, vec) of descriptor files: a header line, then for each descriptor its numbers on lines that begin with a space.

    The last descriptor counts; a descriptor of another size is dropped by itself.
    """
    reader = spark.read
    if suffix:
        reader = reader.option("pathGlobFilter", suffix)
    body = reader.text(path, wholetext=True).select(F.input_file_name().alias("image"), F.regexp_extract_all("value", F.lit(r"(?:\n +[^\n]*)+"), F.lit(0)).alias("blocks"))
    each = body.select("image", F.posexplode("blocks").alias("idx", "block"))
    numbers = F.transform(F.regexp_extract_all("block", F.lit(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), to_double)
    return each.select("image", "idx", numbers.alias("vec")).where(F.size("vec") == size)


def centroid_tsv(spark: SparkSession, path: Paths, size: int = 128) -> DataFrame:
    """(cluster, vec): dense centroids of ``id TAB dim TAB value ...`` lines, absent dimensions 0."""
    long = sparse_tsv(spark, path, "cluster").groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct(to_int(F.col("key")).cast("int"), "value"))).alias("m"))
    return long.select("cluster", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def descriptor_map(spark: SparkSession, path: Paths) -> DataFrame:
    """(file, desc_id) of lines ``file TAB id TAB id ...``."""
    f = split_keep("value", "\t")
    return spark.read.text(path).select(f[0].alias("file"), F.explode(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0)))).alias("d")).where("d <> ''").select("file", to_int("d").alias("desc_id"))


def word_labels(spark: SparkSession, path: Paths, top: int = 5) -> DataFrame:
    """(desc_id, vword, w) of lines ``desc_id TAB word [TAB weight ...]``: the first ``top`` pairs; a lone word weighs 1."""
    f = split_keep("value", "\t")
    rest = F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0)))
    pairs = F.slice(F.filter(F.transform(rest, lambda x, i: F.struct(x.alias("k"), F.coalesce(F.try_element_at(rest, i + 2), F.lit("1")).alias("w"), (i % 2 == 0).alias("even"))), lambda p: p["even"]), 1, top)
    return spark.read.text(path).select(to_int(f[0]).alias("desc_id"), F.explode(pairs).alias("p")).where("p.k <> ''").select("desc_id", to_int("p.k").alias("vword"), to_double("p.w").alias("w"))


def file_counts(spark: SparkSession, path: Paths) -> DataFrame:
    """(at, file, n) of lines ``file TAB count`` in file order."""
    f = split_keep("value", "\t")
    return spark.read.text(path).where(F.size(f) == 2).select(F.monotonically_increasing_id().alias("at"), f[0].alias("file"), to_int(f[1]).alias("n"))


def bag_tsv(spark: SparkSession, path: Paths) -> DataFrame:
    """(category, file, key, value): bags of features; the category is the name of the file's directory."""
    return sparse_tsv(spark, path, "file").select(parent_directory("file").alias("category"), "file", "key", "value")


def image_paths(spark: SparkSession, path: Paths) -> DataFrame:
    """(path, ext) of an image list: a ``.txt`` file has one path per line, anything else is a path itself."""
    given = [path] if isinstance(path, str) else list(path)
    lists = [p for p in given if p.endswith(".txt")]
    single = spark.createDataFrame([(p,) for p in given if not p.endswith(".txt")], "path STRING")
    out = single if not lists else single.unionByName(spark.read.text(lists).select(F.trim("value").alias("path")).where("path <> ''"))
    return out.select("path", F.lower(extension("path")).alias("ext"))


def images(spark: SparkSession, path: Paths) -> DataFrame:
    """(path, height, width, channels, pixels) of decodable images, bytes in BGR row order; unreadable files are dropped."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels")
    )


def random_integers(spark: SparkSession, size: int, below: int, seed: int) -> DataFrame:
    """``size`` distinct integers under ``below`` in order; seeded."""
    if not 0 <= size <= below:
        raise ValueError("size must be between 0 and below")
    return spark.range(below).orderBy(digest("id", seed), "id").limit(size).select(F.col("id").alias("n")).orderBy("n")

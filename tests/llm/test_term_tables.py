import math

from pyspark.sql import functions as F

from cairn.llm import term_tables as tt


def test_log_entropy(spark):
    rows = [("a", "x", 2), ("b", "x", 2), ("a", "y", 5), ("c", "z", 1), ("c", "x", 4)]
    df = spark.createDataFrame(rows, "title string, word string, tf bigint").withColumn("df", F.lit(9)).withColumn("part", F.lit(1))
    got = {(r.title, r.word): (r.df, r.weight) for r in tt.log_entropy(df).collect()}
    h = -sum(p * math.log(p) for p in (0.25, 0.25, 0.5))
    assert got["a", "x"][0] == 3 and abs(got["a", "x"][1] - math.log(3) * (1 - h / math.log(3))) < 1e-12
    assert got["a", "y"][0] == 1 and abs(got["a", "y"][1] - math.log(6)) < 1e-12
    assert tt.log_entropy(df.limit(0)).count() == 0
    one = tt.log_entropy(df.where("title = 'a'")).collect()
    assert {round(r.weight, 9) for r in one} == {round(math.log(3), 9), round(math.log(6), 9)}


def test_heavy_terms_are_split_and_whole(spark, monkeypatch):
    monkeypatch.setattr(tt, "PART_ROWS", 700)
    df = spark.range(5000).select(F.col("id").cast("string").alias("title"), F.lit("common").alias("word"), F.lit(1).alias("tf"))
    df = df.unionByName(df.withColumn("word", F.concat(F.lit("own"), "title")))
    out = tt.log_entropy(df)
    assert out.count() == 10_000 and out.where("word = 'common'").agg(F.max("df"), F.round(F.max(F.abs("weight")), 9)).first()[:] == (5000, 0.0)


def test_top_n(spark):
    rows = [("g", "b", 5, 1), ("g", "a", 5, 1), ("g", "c", 5, 2), ("g", "d", None, 1), ("g", "é", 9, 0), ("h", "x", -(2**63), 1), (None, "n", 1, 1)]
    df = spark.createDataFrame(rows, "title string, word string, score bigint, tf bigint").withColumn("rank", F.lit(0))
    got = {(r.title, r["rank"]): (r.word, r.score, r.tf) for r in tt.top_n(df, "title", ["score", "tf"], "word", 4).collect()}
    assert got == {("g", 1): ("é", 9, 0), ("g", 2): ("c", 5, 2), ("g", 3): ("a", 5, 1), ("g", 4): ("b", 5, 1), ("h", 1): ("x", -(2**63), 1), (None, 1): ("n", 1, 1)}
    assert tt.top_n(df.limit(0), "title", ["score", "tf"], "word", 4).count() == 0
    wide = spark.range(30_000).selectExpr("'one' AS title", "cast(id AS string) AS word", "id % 7 AS score", "0 AS tf")
    assert [r.word for r in tt.top_n(wide, "title", ["score", "tf"], "word", 3).orderBy("rank").collect()] == sorted(str(i) for i in range(30_000) if i % 7 == 6)[:3]


def test_term_frequencies(spark):
    rows = [("a", "x:2\ty:1\tx:1\tbad\t:3\tz:0\tw:1.5\tu:-1\tc:d:4"), ("b", "x:1"), ("c", "x:1"), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "title string, words string").withColumn("term", F.lit(1))
    got = {r.term: (r.n_total, r.n_records, r.mark) for r in tt.term_frequencies(df, "title", "words", 2, 0.5).collect()}
    assert got == {"x": (5, 3, "common"), "y": (1, 1, "rare"), "c:d": (4, 1, "rare")}
    assert tt.term_frequencies(df.limit(0), "title", "words").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", None, 9), ("b", None, 1)], "k string, t int, v int")
    assert {(r.k, r.v) for r in tt.latest(df, ["k"], "t", ["v"]).collect()} == {("a", None), ("b", 1)}


def test_the_heap_aggregate_of_this_spark(spark):
    """``bounded_heap`` rests on an internal function; on a Spark without it, or with other results, this fails first."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.struct((-F.col("id")).alias("x"), F.lit("u").alias("u")).alias("e"))
    got = {r.g: [e.x for e in r.h] for r in df.groupBy("g").agg(F.array_sort(tt.bounded_heap(F.col("e"), 2)).alias("h")).collect()}
    assert got == {0: [-999, -996], 1: [-997, -994], 2: [-998, -995]}

import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster
from cairn.runtime import cut, small_side


def test_cut_keeps_rows_and_any_names(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, [1.5])], "a int, b string, c array<double>")
    odd = df.select("a", F.col("b").alias("A"), F.col("c").alias("x y,;{}()="), F.lit(None).alias("void"))
    back = cut(odd)
    assert back.columns == ["a", "A", "x y,;{}()=", "void"] and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, odd.collect()), key=str)
    assert cut(df.limit(0)).count() == 0 and cut(df.limit(0)).schema == df.schema


def test_cut_knows_its_size(spark):
    df = cut(spark.range(100))
    for _ in range(12):  # sizes don't multiply from join to join
        df = cut(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert df.count() == 100


def test_small_side(spark):
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small_side(spark.range(5), 5)) and "broadcast" not in plan(small_side(spark.range(6), 5))


def test_more_clusters_than_rows(spark):
    points = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, v array<double>")
    with pytest.raises(ValueError):
        cluster.kmeans(points, 3)
    assert cluster.kmeans(points.limit(0), 3)[0].count() == 0
    entries = spark.createDataFrame([("a", "x", 1.0)], "key string, dim string, y double")
    with pytest.raises(ValueError):
        cluster.kmeans_sparse(entries, 2)

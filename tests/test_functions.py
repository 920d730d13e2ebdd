import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import codec, text, vectors
from cairn.functions.seeded import digest, uniform


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_split_and_join(spark):
    lit = F.lit
    r = one(spark, text.split_drop(lit("This is a pen"), " ").alias("a"), text.split_drop(lit("あい\tうえ\t\tおか"), "\t").alias("b"), text.split_keep(lit("a||b|"), "|").alias("c"), text.join(F.array(*map(lit, ["a", "bc", "def", "gh"])), "\t").alias("d"))
    assert r.a == ["This", "is", "a", "pen"] and r.b == ["あい", "うえ", "おか"] and r.c == ["a", "", "b", ""] and r.d == "a\tbc\tdef\tgh"


@pytest.mark.parametrize(("title", "keyword"), [("a (b) (c)", "a"), ("A|B", None), ("x:y", None), ("#x", None), (" x", None), ("2010年", None), ("都市一覧", None), ("", None), ("0", None), (None, None), ("(x)", None), ("plain", "plain")])
def test_keyword_rule(spark, title, keyword):
    assert one(spark, text.page_keyword(F.lit(title).cast("string")).alias("k")).k == keyword


def test_lenient_and_strict_numbers(spark):
    r = one(spark, text.to_int(F.lit("3x")).alias("a"), text.to_int(F.lit("x")).alias("b"), text.to_double(F.lit("-1.5e2z")).alias("c"), text.strict_number(F.lit(" +2.50e0 ")).alias("d"), text.strict_number(F.lit("nan")).alias("e"), text.strict_number(F.lit("1e999")).alias("f"))
    assert tuple(r) == (3, 0, -150.0, 2.5, None, None)


def test_paths(spark):
    r = one(spark, text.extension(F.lit("a/b.c/d.JPG")).alias("a"), text.extension(F.lit("a/b.c/d")).alias("b"), text.parent_directory(F.lit("dir/cat/a.jpg")).alias("c"), text.parent_directory(F.lit("a")).alias("d"))
    assert tuple(r) == ("JPG", "", "cat", None)


@pytest.mark.parametrize(("numbers", "code"), [([1, 130], "82810181"), ([824, 829, 215406], "8306B8850D0CB1")])
def test_golden_codes(spark, numbers, code):
    xs = F.array(*[F.lit(n).cast("bigint") for n in numbers])
    r = one(spark, F.hex(codec.compress(xs)).alias("h"), codec.decompress(codec.compress(xs)).alias("n"))
    assert r.h == code and r.n == numbers


def test_codec_edges(spark):
    r = one(spark, codec.encode(F.array().cast("array<bigint>")).alias("a"), codec.encode(F.lit(None).cast("array<bigint>")).alias("b"), codec.decode(F.lit(None).cast("binary")).alias("c"))
    assert tuple(r) == (None, None, None)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**62), min_size=1, max_size=12, unique=True).map(sorted), min_size=30, max_size=30))
def test_codec_round_trip(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<bigint>")
    assert {r.i: r.y for r in df.select("i", codec.decompress(codec.compress("x")).alias("y")).collect()} == dict(enumerate(lists))


def test_measures(spark):
    a, b, z = (F.array(*map(F.lit, x)) for x in ([3.0, 4.0], [4.0, 3.0], [0.0, 0.0]))
    r = one(spark, vectors.dot(a, b), vectors.norm(a), vectors.cosine(a, b), vectors.cosine(a, z), vectors.euclid(a, b), vectors.squared_euclid(a, b), vectors.intersection(a, b), vectors.bhattacharyya(a, a), vectors.argmin([F.lit(2.0), F.lit(1.0), F.lit(1.0)]))
    assert [round(x, 9) for x in r] == [24.0, 5.0, 0.96, 0.0, round(math.sqrt(2), 9), 2.0, 6.0, 0.0, 1]
    m, n = F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(2.0)), F.create_map(F.lit("y"), F.lit(3.0))
    r = one(spark, vectors.sparse_dot(m, n), vectors.sparse_squared_euclid(m, n), vectors.add(a, b), vectors.scale(a, 2.0))
    assert r[0] == 6.0 and round(r[1], 9) == 2.0 and r[2] == [7.0, 7.0] and r[3] == [6.0, 8.0]


def test_seeded_choices_do_not_depend_on_partitions(spark):
    a = [tuple(r) for r in spark.range(50).repartition(7).select("id", digest("id", 3), uniform("id", 3)).orderBy("id").collect()]
    b = [tuple(r) for r in spark.range(50).coalesce(1).select("id", digest("id", 3), uniform("id", 3)).orderBy("id").collect()]
    assert a == b and all(0 <= x[2] < 1 for x in a)


def test_long_lists_decode_in_linear_time(spark):
    import time

    from cairn.functions import codec

    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(65_536)).cast("array<bigint>").alias("xs")).select("xs", codec.compress("xs").alias("data")).cache()
    df.count()
    df.select(codec.decompress("data")).write.format("noop").mode("overwrite").save()
    began = time.time()
    back = df.select((codec.decompress("data") == F.col("xs")).alias("same")).first()
    assert back["same"] and time.time() - began < 5


def test_large_codebook_as_matrix(spark):
    import numpy as np

    from cairn.functions import vectors as fv

    rng = np.random.default_rng(3)
    c, x = rng.normal(size=(300, 16)), rng.normal(size=(40, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "i int, v array<double>")
    for distance, want in ((fv.squared_euclid, ((x[:, None] - c[None]) ** 2).sum(2)), (fv.cosine_distance, 1 - x @ c.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(c, axis=1))):
        got = {r["i"]: r["n"] for r in df.select("i", fv.nearest("v", c.tolist(), distance).alias("n")).collect()}
        assert got.pop(99) is None and got == dict(enumerate(want.argmin(1)))

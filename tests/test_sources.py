import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import images as k
from cairn.operators import features
from cairn.operators.text import document_frequency, term_frequency
from cairn.sources import readers, sinks
from cairn.streaming import incremental


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_articles_keep_the_last(spark, tmp_path):
    p = _write(tmp_path, "x-1.txt", "junk\n[[A]]\nbody a\nmore [[link]] here\n[[B]]\n[[C]]\r\nlast body")
    assert {(r.title, r.body) for r in readers.articles(spark, p).collect()} == {("A", "body a\nmore [[link]] here"), ("C", "last body")}
    assert readers.articles(spark, str(tmp_path), "y*.txt").count() == 0


def test_pages_xml(spark, tmp_path):
    p = _write(tmp_path, "d.xml", "<mediawiki><page><title>A</title><id>1</id><revision><id>9</id><text>[[B]]</text></revision></page><page><title>B</title><id>2</id><revision><text>x</text></revision></page></mediawiki>")
    assert {tuple(r) for r in readers.pages_xml(spark, p).collect()} == {("A", 1, "[[B]]"), ("B", 2, "x")}


def test_vectors(spark, tmp_path):
    p = _write(tmp_path, "s.tsv", "d1\tk1\t1.5\tk2\t2\nbad\tk1\nd2\tk3\t0\nd3\tk2\t-1\n")
    rows = {tuple(r) for r in readers.sparse_tsv(spark, p).collect()}
    assert rows == {("d1", "k1", 1.5), ("d1", "k2", 2.0), ("d3", "k2", -1.0)}
    assert {(r.key, r["index"]) for r in readers.feature_index(readers.sparse_tsv(spark, p)).collect()} == {("k1", 0), ("k2", 1)}
    v = spark.range(1).select(readers.sparse_vector(F.lit("a\t1\tb\t0\tc\t3\ta\t5")).alias("m"), readers.sparse_vector(F.lit("a\t1\tb\t2\tc\t3"), limit=2).alias("n"), readers.sparse_vector(F.lit("a 1  b 2"), r"\s+").alias("o")).first()
    assert v.m == {"c": 3.0, "a": 5.0} and v.n == {"a": 1.0, "b": 2.0} and v.o == {"a": 1.0, "b": 2.0}
    p = _write(tmp_path, "d.tsv", "x\t1,2,3\ny\t4\n")
    assert {(r.id, tuple(r.vec)) for r in readers.dense_tsv(spark, p).collect()} == {("x", (1.0, 2.0, 3.0)), ("y", (4.0,))}


def test_constraints_and_ratings(spark, tmp_path):
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    p = _write(tmp_path, "c.tsv", "a\tb\tm\na\tz\tc\nb\ta\tq\nb\ta\n")
    assert {tuple(r) for r in readers.constraints(spark, p, labels).collect()} == {("a", "b", "m"), ("b", "a", "m")}
    p = _write(tmp_path, "r.tsv", "1\t10\t4\textra\n1\t10\t5\n2\t11\t3\nshort\n")
    df = readers.ratings_tsv(spark, p)
    assert {tuple(r) for r in df.collect()} == {(1, 10, 5.0), (2, 11, 3.0)}
    assert tuple(readers.matrix_extent(df).first()) == (2, 11)
    p = _write(tmp_path, "m.dat", "1::10::4::978\n1::10::3::979\n2::5::1::1\n")
    assert {tuple(r) for r in readers.movielens_1m(spark, p).collect()} == {(1, 10, "3", "979"), (2, 5, "1", "1")}
    for i in (1, 2):
        _write(tmp_path, f"folds/u{i}.base", "1\t1\t3\n")
        _write(tmp_path, f"folds/u{i}.test", "2\t2\t4\n")
    assert readers.fold_files(spark, str(tmp_path / "folds")).groupBy("fold", "split").count().count() == 4


def test_packed_edges(spark):
    edges = spark.createDataFrame([(1, 7, 3), (1, 9, 70000), (2, 4_000_000_000, 1)], "src bigint, dst bigint, n bigint")
    back = {tuple(r) for r in readers.packed_edges(readers.pack_edges(edges), "src", "data").collect()}
    assert back == {(1, 7, 3), (1, 9, 65535), (2, 4_000_000_000, 1)}


def test_descriptors(spark, tmp_path):
    p = _write(tmp_path, "a.sift", "2 3\n 1 2\n 3\n1.0 2.0\n 4 5 6\n 7\n0 0\n 9 8 7\n")
    assert [(r.idx, r.vec) for r in readers.key_files(spark, p, 3).orderBy("idx").collect()] == [(0, [1.0, 2.0, 3.0]), (2, [9.0, 8.0, 7.0])]
    p = _write(tmp_path, "cent.tsv", "0\t1\t0.5\t2\t1\n")
    assert readers.centroid_tsv(spark, p, 4).first()["vec"] == [0.0, 0.5, 1.0, 0.0]
    p = _write(tmp_path, "map.tsv", "d/c/a.jpg\t0\t1\n")
    assert {tuple(r) for r in readers.descriptor_map(spark, p).collect()} == {("d/c/a.jpg", 0), ("d/c/a.jpg", 1)}
    p = _write(tmp_path, "lab.tsv", "17\t3\t0.9\t0\t0.4\n5\t2\n")
    assert {tuple(r) for r in readers.word_labels(spark, p).collect()} == {(17, 3, 0.9), (17, 0, 0.4), (5, 2, 1.0)}
    p = _write(tmp_path, "cnt.tsv", "a.jpg\t42\n")
    assert [(r.file, r.n) for r in readers.file_counts(spark, p).collect()] == [("a.jpg", 42)]
    p = _write(tmp_path, "bag.tsv", "d/cat/a.jpg\t3\t2\n")
    assert [tuple(r) for r in readers.bag_tsv(spark, p).collect()] == [("cat", "d/cat/a.jpg", "3", 2.0)]
    p = _write(tmp_path, "list.txt", "a.JPG\nb.png\n")
    assert {tuple(r) for r in readers.image_paths(spark, [p, "c.gif"]).collect()} == {("a.JPG", "jpg"), ("b.png", "png"), ("c.gif", "gif")}


def test_random_integers(spark):
    xs = [r.n for r in readers.random_integers(spark, 10, 50, 3).collect()]
    assert len(set(xs)) == 10 and xs == sorted(xs)
    with pytest.raises(ValueError):
        readers.random_integers(spark, 10, 5, 1)


def test_sinks(spark, tmp_path):
    tf = spark.createDataFrame([("d", "a", 1), ("d", "b", 3)], "doc string, word string, tf bigint")
    sinks.term_table(tf, str(tmp_path / "tf"), "doc")
    assert [r.value for r in spark.read.text(str(tmp_path / "tf")).collect()] == ["d\tb\t3\ta\t1"]
    sinks.tsv(spark.createDataFrame([("a", None, 0.5)], "a string, b string, c double"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "a\t\t0.5"
    sinks.factor_matrix(spark.createDataFrame([(1, [0.123, 2.0])], "user int, f array<double>"), str(tmp_path / "u"), "user")
    assert spark.read.text(str(tmp_path / "u")).first().value == "1\t0.12\t2.00"
    r = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "user int, item string, rank int")
    sinks.recommendations(r, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == "1\ty\tx"
    ratings = spark.createDataFrame([(i, f"i{i}", 1.0) for i in range(30)], "user int, item string, rate double")
    sinks.folds(ratings, str(tmp_path / "f"), 3)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 30
    split = spark.createDataFrame([("d", "L", "train")], "doc string, lab string, split string")
    sinks.classified_bags(tf, split, str(tmp_path / "b"), "doc", "lab", "word", "tf")
    assert spark.read.text(str(tmp_path / "b/train")).first().value == "L\ta\t1\tb\t3"
    dictionary = spark.createDataFrame([("k", 1)], "keyword string, id bigint")
    sinks.dictionaries(dictionary, str(tmp_path / "dict"))
    assert spark.read.parquet(str(tmp_path / "dict/id2keyword")).first().keyword == "k"


def test_incremental_counts_equal_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word w{chr(97 + i % 3)} word") for i in range(12)], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.count_stream(stream, "doc_id", "text", str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    tf = term_frequency(docs, "doc_id", "text")
    assert {(r.word, r.df) for r in incremental.current_words(spark, str(tmp_path / "store")).collect()} == {tuple(r) for r in document_frequency(tf).collect()}
    assert incremental.current_size(spark, str(tmp_path / "store")).first().n == 12


def test_windowed_counts_keep_late_rows(spark, tmp_path):
    for day in ("2024-03-09", "2024-03-10", "2024-03-01"):  # the last file is a week late
        spark.createDataFrame([(f"{day} 10:{m:02d}:00", "a") for m in (5, 20)], "at string, k string").selectExpr("cast(at AS timestamp) AS at", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.windowed_counts(stream, "at", "k", str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    rows = incremental.current_windows(spark, str(tmp_path / "store")).selectExpr("cast(start AS string) AS start", "key", "n").collect()
    assert sorted(tuple(r) for r in rows) == [(f"2024-03-{d} 10:00:00", "a", 2) for d in ("01", "09", "10")]


def test_image_kernels():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    assert np.sqrt((k.bgr_histogram(image) ** 2).sum()) == pytest.approx(1) and k.hsv_histogram(image).sum() == pytest.approx(1)
    assert len(k.rgb_counts(image)) == 768 and k.rgb_counts(image).sum() == 3 * 1200
    assert k.hog(image).shape == (15 * 7 * 36,)
    hsv = k.to_hsv(np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [9, 9, 9]]], np.uint8))[0]
    assert hsv[:, 0].tolist() == [0, 60, 120, 0]
    assert k.to_luv(np.full((1, 1, 3), 255, np.uint8))[0, 0, 0] == pytest.approx(100, abs=0.1)
    box = np.zeros((30, 30))
    box[5:12, 6:20] = 1
    assert k.shape_distance(box, np.roll(box, (7, 5), (0, 1))) == pytest.approx(0, abs=1e-9)
    assert k.shape_distance(box, np.eye(30)) > 0.05
    assert len(k.boundary(box)) == 2 * 7 + 2 * 14 - 4
    assert np.allclose(k.resize(np.full((4, 4), 7.0), 9, 5), 7.0)


def test_earth_mover():
    w = np.array([1.0])
    assert k.earth_mover(w, np.array([[0.0, 0]]), w, np.array([[3.0, 4]])) == pytest.approx(5)
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, m = rng.integers(1, 7, 2)
        a, ca, b, cb = rng.random(n), rng.random((n, 1)) * 9, rng.random(m), rng.random((m, 1)) * 9
        # in one dimension the distance is the area between the cumulative distributions
        xs = np.sort(np.concatenate([ca[:, 0], cb[:, 0]]))
        fa = np.array([a[ca[:, 0] <= x].sum() for x in xs]) / a.sum()
        fb = np.array([b[cb[:, 0] <= x].sum() for x in xs]) / b.sum()
        want = (np.abs(fa - fb)[:-1] * np.diff(xs)).sum()
        assert k.earth_mover(a, ca, b, cb) == pytest.approx(want, abs=1e-9)
        assert k.earth_mover(b, cb, a, ca) == pytest.approx(want, abs=1e-9)


def test_image_tables(spark):
    pixels = bytes(range(48))
    df = spark.createDataFrame([("a", 4, 4, 3, bytearray(pixels)), ("bad", 9, 9, 3, bytearray(pixels))], "path string, height int, width int, channels int, pixels binary")
    assert [r.path for r in features.image_feature(df, k.rgb_counts).collect()] == ["a"]
    got = features.image_distance(df, (pixels, 4, 4, 3), features.colour_distance).collect()
    assert [(r.path, r.distance) for r in got] == [("a", 0.0)]

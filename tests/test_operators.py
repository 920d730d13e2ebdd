import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cluster, factorize, features, graph, nmf, similarity
from cairn.operators import text as terms
from cairn.operators.ranking import global_rank, neighbours, running_total
from cairn.operators.skew import range_stitched_aggregate


def test_tfidf_golden(spark):
    tf = spark.createDataFrame([("a", "x", 2), ("b", "y", 1), ("c", "z", 3), ("a", "z", 3), ("b", "z", 3)], "doc string, word string, tf bigint")
    got = {(r.doc, r.word): r.score for r in terms.tfidf(tf, "doc").collect()}
    assert got["a", "x"] == 81 and got["c", "z"] == -86
    two = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 1)], "doc string, word string, tf bigint")
    assert {r.score for r in terms.tfidf(two, "doc").where("word = 'x'").collect()} == {0}
    assert terms.tfidf(tf.limit(0), "doc").count() == 0


def _edges(spark):
    return spark.createDataFrame([("A", "B", 1), ("A", "C", 1), ("B", "C", 1), ("C", "A", 1)], "src string, dst string, n int")


def test_pagerank_golden(spark):
    got = {r.id: round(r.score, 6) for r in graph.pagerank(_edges(spark)).collect()}
    assert got == {"A": 0.625703, "B": 0.208568, "C": 0.417136}
    full = {r.id: r.score for r in graph.pagerank(_edges(spark), 30, teleport=True, init="uniform").collect()}
    assert sum(full.values()) == pytest.approx(1.0)
    assert graph.pagerank(_edges(spark).limit(0)).count() == 0


def test_hits_golden(spark):
    a, h = graph.hits(_edges(spark))
    assert {r.id: round(r.score, 6) for r in a.collect()} == {"A": 0.169031, "B": 0.507093, "C": 0.845154}
    assert {r.id: round(r.score, 6) for r in h.collect()} == {"A": 0.843274, "B": 0.527046, "C": 0.105409}


def test_link_graph(spark):
    pages = spark.createDataFrame([(1, "A", "see [[B]] and [[B]] and [[A]] [[X:y]] [[None]]"), (2, "B", "[[A (list)]]"), (3, "B", None), (4, None, "[[B]]")], "id bigint, title string, body string")
    got = {tuple(r) for r in graph.link_graph(pages, "id", "title", "body").collect()}
    assert got == {(1, 3, 2), (2, 1, 1), (4, 3, 1)}


def test_skewed_aggregate_equals_group_by(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 50 = 1 THEN NULL ELSE id % 700 END AS k", "id % 977 AS s", "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 5 END AS x", "'e' AS o", "1 AS n")
    got = range_stitched_aggregate(df, ["k"], "s", {"total": F.col("x")}, {"top": F.col("x")}, distinct="n_s", partitions=9)
    want = df.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("s").alias("n_s"), F.sum("x").alias("total"), F.max("x").alias("top"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert range_stitched_aggregate(df.limit(0), ["k"], "s").count() == 0
    spread = df.where("k = 1").repartitionByRange(9, "k", "s").groupBy(F.spark_partition_id()).count().count()
    assert spread > 4  # one key lies in several partitions


def test_ranks_neighbours_and_running_totals(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "cast(id AS string) AS key", "id AS v").repartition(7)
    ranked = global_rank(df, ["g", "key"])
    rows = sorted((r.g, r.key, r["rank"]) for r in ranked.collect())
    assert [r[2] for r in rows] == list(range(1000))
    for bucket in (10_000, 16):
        got = {(r.g, *sorted((r.a, r.b))) for r in neighbours(ranked, "g", "key", 2, bucket=bucket).collect()}
        want = {(rows[i][0], *sorted((rows[i][1], rows[j][1]))) for i in range(1000) for j in (i + 1, i + 2) if j < 1000 and rows[i][0] == rows[j][0]}
        assert got == want
    upto = {r.key: r.upto for r in running_total(df, ["key"], "v").collect()}
    total, want = 0, {}
    for k in sorted(upto):
        total += int(k)
        want[k] = total
    assert upto == want


def test_lsh_pairs(spark):
    rows = [(f"k{i:03d}", {f"d{j}": float(1 + (i * j) % 5) for j in range(i % 17, i % 17 + 6)}) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, v map<string,double>")
    got = similarity.lsh_pairs(df, 0.7, 6, 4, 3).collect()
    assert got and all(r.a < r.b and r.cos > 0.7 for r in got) and len({(r.a, r.b) for r in got}) == len(got)
    assert similarity.lsh_pairs(df.limit(2), 0.7, 100, 2, 3).count() <= 1
    assert similarity.lsh_pairs(df.limit(0), 0.7, 6, 2, 3).count() == 0


@pytest.mark.parametrize("chunk", [1000, 7])
def test_cosine_pairs_finds_what_the_window_loses(spark, chunk):
    rng = np.random.default_rng(11)
    dense = np.where(rng.random((150, 60)) < 0.15, rng.normal(0, 1, (150, 60)), 0)
    dense[50:100] = dense[:50] * rng.uniform(0.1, 9) + np.where(dense[:50] != 0, rng.normal(0, 0.3, (50, 60)), 0)
    dense[110:140] = dense[110]  # a copy group larger than the window
    dense[149] = 0
    rows = [(f"k{i:03d}", {f"d{j}": float(x) for j, x in enumerate(v) if x}) for i, v in enumerate(dense)]
    df = spark.createDataFrame(rows, "key string, v map<string,double>")
    unit = dense / np.maximum(np.linalg.norm(dense, axis=1), 1e-300)[:, None]
    want = {(f"k{i:03d}", f"k{j:03d}") for i, j in zip(*np.nonzero(unit @ unit.T > 0.7)) if i < j}
    got = similarity.cosine_pairs(df, 0.7, chunk).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 435
    assert all(r.cos == pytest.approx(unit[int(r.a[1:])] @ unit[int(r.b[1:])]) for r in got)
    window = {(r.a, r.b) for r in similarity.lsh_pairs(df, 0.7, 10, 5, 5).collect()}
    assert window < want
    assert similarity.cosine_pairs(df.limit(0), 0.7, chunk).count() == 0


def test_sparse_queries_read_whole_vectors(spark, tmp_path):
    from cairn.plans import vectors as plans

    long = "\t".join(f"d{j:02d}\t1" for j in range(60))
    rows = [("a", long), ("b", "\t".join(f"d{j:02d}\t1" for j in range(50, 60)))]
    spark.createDataFrame(rows, "word string, vec string").write.parquet(f"{tmp_path}/lsh.parquet")
    got = {r.key: r for r in plans.sparse_measures(spark, str(tmp_path)).collect()}
    assert got["a"].dot == 60 and got["b"].dot == 10  # the first 50 entries alone: 50 and 0
    assert {r.key: r.bits for r in plans.lsh_bits(spark, str(tmp_path)).collect()} == {"a": "1100000000", "b": "1100000000"}


def _embeddings(spark, folder, n=40):
    x = np.random.default_rng(8).normal(0, 0.5, (n, 64))
    rows = [(i, list(map(float, v)), i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x


def test_bof_truncated_100_keeps_every_centroid(spark, tmp_path):
    from cairn.plans import bags

    x = _embeddings(spark, tmp_path)
    words = np.array(bags._words(bags._descriptors(spark, str(tmp_path))))
    query = np.where(np.argsort(np.argsort(-np.abs(x), axis=1, kind="stable"), axis=1) < 20, x, 0)
    got = {r.vec_id: r.cluster for r in bags.bof_truncated_100(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate((query @ words.T).argmax(1).tolist()))
    assert got != {r.vec_id: r.cluster for r in bags.bof_truncated(spark, str(tmp_path)).collect()}


def test_label_join_all_uses_every_label(spark, tmp_path):
    from cairn.plans import bags

    _embeddings(spark, tmp_path)
    got = {r.vword: r.n for r in bags.label_join_all(spark, str(tmp_path)).collect()}
    assert got.pop(-1) == 0 and sum(got.values()) == 40 and got[3] > 0
    d = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "image bigint, vec_id bigint")
    labels = spark.createDataFrame([(1, 3), (2, 3), (9, 4)], "vec_id bigint, vword int")
    assert {r.vword: r.n for r in bags._label_counts(d, labels).collect()} == {3: 2, -1: 1}


def test_ratio_match(spark):
    left = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [5.0, 0.0]), (3, 1, [1.0, 1.0]), (4, 2, [0.0, 0.0])], "k bigint, s int, v array<double>")
    right = spark.createDataFrame([(10, 0, [0.1, 0.0]), (11, 0, [9.0, 0.0]), (12, 1, [3.0, 3.0])], "k bigint, s int, v array<double>")
    got = {r.k: r.match for r in similarity.ratio_match(left, right, "k", "s", "v").collect()}
    assert got == {1: 10, 2: -1, 3: 12, 4: -1}


def _points(spark, seed=0, n=120):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10]], float)
    x = centres[np.arange(n) % 3] + rng.normal(0, 0.3, (n, 2))
    return x, spark.createDataFrame([(f"p{i:03d}", list(map(float, v))) for i, v in enumerate(x)], "key string, v array<double>")


def test_kmeans(spark):
    x, df = _points(spark)
    labels, centroids = cluster.kmeans(df, 3)
    got = {r.key: r.cluster for r in labels.collect()}
    assert len({tuple(sorted(k for k in got if got[k] == c)) for c in range(3)}) == 3
    assert all(len({got[f"p{i:03d}"] for i in range(s, 120, 3)}) == 1 for s in range(3))
    cost = lambda cs: sum(min(((v - c) ** 2).sum() for c in np.array(cs)) for v in x)
    seeds = cluster.seed_centroids(df, 3)
    assert cost(centroids) <= cost(seeds)
    assert cluster.kmeans(df.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError):
        cluster.kmeans(df, 0)


def test_kmeans_sparse(spark):
    rows = [(f"p{i}", f"d{(i % 2) * 5 + j}", float(j + 1)) for i in range(20) for j in range(4)]
    entries = spark.createDataFrame(rows, "key string, dim string, y double")
    for cosine in (True, False):
        labels, _ = cluster.kmeans_sparse(entries, 2, cosine=cosine)
        got = {r.key: r.cluster for r in labels.collect()}
        assert len({got[f"p{i}"] for i in range(0, 20, 2)}) == 1 and got["p0"] != got["p1"]
    assert cluster.kmeans_sparse(entries.limit(0), 2)[0].count() == 0


def _constraints(spark, pairs):
    return spark.createDataFrame([(a, b, k) for x, y, k in pairs for a, b in ((x, y), (y, x))], "a string, b string, kind string")


def test_cop_kmeans(spark):
    _, df = _points(spark)
    pairs = [("p000", "p001", "m"), ("p001", "p004", "m"), ("p003", "p006", "c"), ("p000", "p009", "c")]
    got = {r.key: r.cluster for r in cluster.cop_kmeans(df, _constraints(spark, pairs), 3).collect()}
    assert len(got) == 120
    assert all((got[a] == got[b]) == (k == "m") for a, b, k in pairs)
    with pytest.raises(cluster.Infeasible):
        cluster.cop_kmeans(df, _constraints(spark, [("p000", "p001", "m"), ("p001", "p002", "m"), ("p000", "p002", "c")]), 3)
    with pytest.raises(cluster.Infeasible):
        cluster.cop_kmeans(df, _constraints(spark, [("p000", "p001", "c"), ("p001", "p002", "c"), ("p000", "p002", "c")]), 2)


def test_roulette(spark):
    df = spark.range(300).selectExpr("cast(id AS string) AS key", "cast(id % 7 AS double) AS w")
    picks = [cluster.roulette(df, F.col("w"), s).first()["key"] for s in (0.01, 0.5, 1.0)]
    assert len(set(picks)) == 3


def test_nmf_error_falls(spark):
    rng = np.random.default_rng(3)
    v = rng.random((12, 2)) @ rng.random((2, 9))
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(v[i, j])) for i in range(12) for j in range(9)], "row string, col string, x double")
    err = lambda it: nmf.stored_error(cells, *nmf.factorize(cells, 2, it)).first()["error"]
    w, h = nmf.factorize(cells, 2, 1)
    size = lambda df: math.sqrt(sum(x * x for r in df.collect() for x in r.f))
    assert size(w) == pytest.approx(1) and size(h) == pytest.approx(1) and err(1) >= 0


def _ratings(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(u, f"i{i}", float(3 + (u % 3) - (i % 2) + rng.normal(0, 0.2))) for u in range(12) for i in range(8) if (u + i) % 4], "user bigint, item string, rate double")


def test_sgd_equals_a_plain_loop(spark):
    df = _ratings(spark)
    rows = sorted(((r.user, r.item, r.rate) for r in df.collect()), key=lambda r: (r[0], r[1]))
    k, eta, lam = 2, 0.01, 0.02
    start = lambda key: {r[key]: np.array(r.f) for r in factorize.random_factors(df, key, k).collect()}
    u, v = start("user"), start("item")
    bu, bi = dict.fromkeys(u, 0.0), dict.fromkeys(v, 0.0)
    mean, t = sum(r[2] for r in rows) / len(rows), 0
    for _ in range(2):
        for a, b, rate in rows:
            step = eta / (1 + t / len(rows))
            t += 1
            e = rate - (mean + bu[a] + bi[b] + u[a] @ v[b])
            u[a] = u[a] + step * (e * v[b] - lam * u[a])
            v[b] = v[b] + step * (e * u[a] - lam * v[b])
            mean += step * e
            bu[a] += step * (e - lam * bu[a])
            bi[b] += step * (e - lam * bi[b])
    gu, gi, gm = factorize.stochastic_gradient(df, k, 2, "bias", eta, lam)
    assert gm.first()["mean"] == pytest.approx(mean)
    for r in gu.collect():
        assert r.f == pytest.approx(list(u[r.user])) and r.bias == pytest.approx(bu[r.user])
    for r in gi.collect():
        assert r.f == pytest.approx(list(v[r.item]))


@pytest.mark.parametrize(("model", "blocks"), [("plain", 1), ("fixed", 1), ("svdpp", 1), ("bias", 3), ("svdpp", 2)])
def test_sgd_learns(spark, model, blocks):
    df = _ratings(spark)

    def error(epochs):
        u, v, m = factorize.stochastic_gradient(df, 2, epochs, model, 0.02, 0.01, blocks=blocks)
        assert u.count() == 12 and v.count() == 8
        return factorize.rmse(factorize.predict(df, u, v, None if model == "plain" else m, df if model == "svdpp" else None), False).first()["rmse"]

    assert error(6) < error(1)


def test_rmse_and_folds(spark):
    df = spark.createDataFrame([(3.0, 2.5), (-3.0, -2.5), (1.0, None)], "rate double, guess double")
    assert factorize.rmse(df).first()["rmse"] == 0.0
    assert factorize.rmse(df.limit(0)).first()["rmse"] == -1.0
    r = _ratings(spark)
    folds = r.select(factorize.fold_of(F.concat_ws("|", "user", "item"), 5).alias("f")).groupBy("f").count().collect()
    assert sum(x["count"] for x in folds) == r.count() and {x.f for x in folds} <= {1, 2, 3, 4, 5}
    cv = {x.fold: x.rmse for x in factorize.cross_validate(r, 3, lambda a, b: factorize.with_bias(b, a)).collect()}
    assert cv[0] == pytest.approx(sum(cv[i] for i in (1, 2, 3)) / 3)


def test_top_items_in_blocks(spark):
    rng = np.random.default_rng(8)
    u, v = rng.random((9, 3)), rng.random((25, 3))
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user bigint, f array<double>")
    items = spark.createDataFrame([(f"i{i:02d}", x.tolist()) for i, x in enumerate(v)], "item string, f array<double>")
    got = {}
    for r in factorize.top_items(users, items, 4, block=4).collect():
        got.setdefault(r.user, {})[r["rank"]] = r.item
    for i in range(9):
        assert [got[i][k] for k in (1, 2, 3, 4)] == [f"i{j:02d}" for j in np.argsort(-(v @ u[i]), kind="stable")[:4]]


def test_recommend(spark):
    r = _ratings(spark)
    u, v = factorize.batch_gradient(r, 2, 3, 0.01)
    all_, new = factorize.recommend(r, u, v, 5), factorize.recommend(r, u, v, 5, exclude_seen=True)
    assert all_.groupBy("user").count().agg(F.max("count")).first()[0] <= 5
    assert new.join(r, ["user", "item"]).count() == 0


def test_features(spark):
    d = spark.createDataFrame([(i, i // 4, i % 2, [float(i % 3), float(i % 5)]) for i in range(20)], "k bigint, image bigint, s int, v array<double>")
    soft = features.soft_histogram(d, "image", "v", [[0.0, 0.0], [2.0, 4.0]], 1)
    assert soft.count() > 0
    labels = d.select(F.col("k").alias("pos"), (F.col("k") % 3).alias("w"))
    counts = d.groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.image, r.pos) for r in features.positional_join(counts, labels, ["image"], "image", "n", "pos").collect()}
    assert got == {(i // 4, i) for i in range(20)}
    bags = spark.createDataFrame([("c", "x"), ("c", "x"), ("c", "y"), ("d", "x"), (None, "z")], "cat string, key string")
    got = {r.cat: (r.ones, r["keys"]) for r in features.singleton_ratio(bags, "cat", "key").collect()}
    assert got == {"c": (1, 2), "d": (1, 1), None: (1, 1), "all": (2, 3)}
    split = features.stratified_split(spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 31 else None) for i in range(40)], "k int, l string"), "l", "k")
    n = {(r.l, r.split): r["count"] for r in split.groupBy("l", "split").count().collect()}
    assert n == {("a", "train"): 27, ("a", "test"): 3, ("b", "train"): 1, (None, "train"): 8, (None, "test"): 1}

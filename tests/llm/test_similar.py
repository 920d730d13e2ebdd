import numpy as np
import pytest

from cairn.llm import similar, spectral, vectors


def _frame(spark, x, prefix="k"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", list(map(float, v)), "extra") for i, v in enumerate(x)], "key string, v array<double>, block string")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(5)
    centres = rng.uniform(-8, 8, (40, 16))
    x = centres[rng.integers(0, 40, 400)] + rng.normal(0, 0.1, (400, 16))
    hot = rng.uniform(-8, 8, 16) + rng.normal(0, 0.1, (200, 16))
    twins = x[:60] + rng.normal(0, 0.004, (60, 16))
    return np.concatenate([x, hot, twins, x[:5]])


@pytest.mark.parametrize(("chunk", "epsilon"), [(2000, 4.0), (40, 4.0), (3, None)])
def test_within_distance_is_exact(spark, cloud, chunk, epsilon):
    cloud = np.concatenate([cloud, np.repeat(cloud[:1], 6, 0)])  # copies beyond the chunk
    got = {(r.key_a, r.key_b) for r in similar.within_distance(_frame(spark, cloud), 0.02, 16, chunk, epsilon).collect()}
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    i, j = np.nonzero(d <= 0.02)
    assert got == {(f"k{a:05d}", f"k{b:05d}") for a, b in zip(i, j) if a < b} and len(got) > 5


@pytest.mark.parametrize(("chunk", "epsilon"), [(2000, 4.0), (8, 4.0), (8, None)])
def test_above_cosine_is_exact(spark, chunk, epsilon):
    rng = np.random.default_rng(6)
    rows, dense = [], np.zeros((300, 90))
    for i in range(300):
        if i % 40 == 39:
            dense[i] = dense[i - 39]
        elif i % 3 == 2:
            dense[i] = dense[i - 1] * rng.uniform(0.1, 9) * np.where(dense[i - 1] != 0, rng.uniform(0.6, 1.5, 90), 1)
        else:
            at = rng.choice(90, 12, replace=False)
            dense[i, at] = rng.uniform(0.1, 3, 12)
        at = np.flatnonzero(dense[i])
        rows.append((f"w{i:04d}", [f"d{k}" for k in at], [float(dense[i, k]) for k in at]))
    df = spark.createDataFrame(rows, "key string, dims array<string>, v array<double>")
    got = {(r.key_a, r.key_b) for r in similar.above_cosine(df, 0.8, chunk, epsilon).collect()}
    unit = dense / np.linalg.norm(dense, axis=1)[:, None]
    i, j = np.nonzero(unit @ unit.T >= 0.8)
    assert got == {(f"w{a:04d}", f"w{b:04d}") for a, b in zip(i, j) if a < b} and len(got) > 50


def test_k_nearest_recall(spark, cloud):
    rows = [(f"k{i:05d}", [str(c) for c in range(16)], list(map(float, v))) for i, v in enumerate(cloud)]
    df = spark.createDataFrame(rows, "key string, dims array<string>, v array<double>")
    out = similar.k_nearest(df, df.where("key like '%0'"), 5, cosine=False, block=100, query_block=30).collect()
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2)) + np.eye(len(cloud)) * 1e9
    hits = sum(-r.similarity <= np.sort(d[int(r.key[1:])])[4] + 1e-6 for r in out)
    assert len(out) == 67 * 5 and hits >= 0.9 * len(out)


@pytest.mark.parametrize(("cells", "part"), [(24, 20_000), (7, 30), (1000, 20_000)])
def test_k_nearest_in_cells_is_whole(spark, cloud, cells, part):
    df = _frame(spark, cloud)
    out = similar.k_nearest_in_cells(df, df.where("key like '%0'"), 5, 16, cells=cells, sample=200, part=part).collect()
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.key, []).append((r.neighbour, round(-r.similarity, 9)))
    assert len(got) == 67
    for key, found in got.items():
        i = int(key[1:])
        order = [j for j in np.lexsort((np.arange(len(cloud)), np.round(d[i], 12))) if j != i][:5]
        assert [x for _, x in found] == [round(float(d[i, j]), 9) for j in order]
        assert {n for n, _ in found} == {f"k{j:05d}" for j in order}
    few = similar.k_nearest_in_cells(df.limit(3), df.limit(1), 5, 16).collect()
    assert len(few) == 2 and similar.k_nearest_in_cells(df.limit(0), df, 5, 16).count() == 0


def test_empty(spark):
    none = _frame(spark, np.zeros((0, 16)))
    assert similar.within_distance(none, 0.02, 16).count() == 0
    assert spectral.spectral_clusters(none, 16).count() == 0
    empty = spark.createDataFrame([], "key string, dims array<string>, v array<double>")
    assert similar.above_cosine(empty, 0.8).count() == 0


def test_reading(spark):
    rows = [("a", "1, +2.5e0 ,3"), ("a", "1, +2.5e0 ,3"), ("b", "1,nan,3"), ("c", None), (None, "1,2,3"), ("d", "1,2"), ("e", "1,2,1e999"), ("f", "1,2f,3"), ("g", "")]
    df = spark.createDataFrame(rows, "key string, vec string")
    assert [(r.key, r.v) for r in vectors.dense(df, "key", "vec", 3).collect()] == [("a", [1.0, 2.5, 3.0])]
    rows = [("a", "x\t1\ty\t0\tx\t2"), ("b", "x\t1\ty"), ("c", ""), ("d", "x\t0"), (None, "x\t1"), ("e", "x\tn/a"), ("f", None)]
    out = vectors.sparse(spark.createDataFrame(rows, "key string, vec string"), "key", "vec").collect()
    assert [(r.key, r.dims, r.v) for r in out] == [("a", ["x"], [3.0])]


def _components(x):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 1.0
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None], len(x)).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("chunk", [20_000, 37])
def test_spectral_groups(spark, cloud, chunk):
    chain = np.zeros((30, 16))
    chain[:, 0] = np.arange(30) * 0.9 + 40  # linked one after the other, far apart end to end
    x = np.concatenate([cloud, chain])
    out = spectral.spectral_clusters(_frame(spark, x), 16, chunk).persist()
    got = {r.key: (r.cluster_id, r["size"]) for r in out.collect()}
    label = _components(x)
    assert {k: v[0] for k, v in got.items()} == {f"k{i:05d}": f"k{c:05d}" for i, c in enumerate(label)}
    assert got["k00660"][1] >= 1 and got[f"k{len(x) - 1:05d}"][1] == 30
    typical = {r.cluster_id: list(r.typical) for r in spectral.typical_members(out, 16).collect()}
    for c in np.unique(label):
        members = np.flatnonzero(label == c)
        inner = np.round((1 - ((x[members][:, None] - x[members][None]) ** 2).sum(2)).mean(1), 6)
        assert typical[f"k{c:05d}"] == [f"k{members[i]:05d}" for i in np.lexsort((members, -inner))[:3]]


def test_anchors_do_not_depend_on_the_chunk(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones((900, 16)), np.ones((300, 16)) + rng.normal(0, 0.2, (300, 16)), rng.uniform(-2, 2, (100, 16))])
    points = _frame(spark, x)
    nets = [{r.key: r.leader for r in spectral.anchor_net(points, 16, 1, chunk).collect()} for chunk in (2000, 200, 45)]
    assert nets[0] == nets[1] == nets[2] and len({nets[0][f"k{i:05d}"] for i in range(900)}) == 1

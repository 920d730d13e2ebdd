import random
from collections import Counter, defaultdict

import pytest

from cairn.llm import packing


def test_best_fit_never_overfills():
    rng = random.Random(1)
    sizes = [rng.randint(0, 100) for _ in range(2000)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(2000))
    assert all(sum(sizes[k] for k in b) <= 100 for b in bins)
    assert len(bins) <= 1.02 * sum(sizes) / 100 + 1


@pytest.mark.parametrize("group", [16, 50, 20_000])
def test_pack(spark, group):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 30, 60, 99, 100, 101, 250])) for i in range(600)] + [(None, 7), (3, 7), (3, None)]
    df = spark.createDataFrame(rows, "doc_id int, n int").selectExpr("doc_id", "n", "'x' AS container", "1 AS part")
    out = packing.pack(df, "doc_id", "n", [(1, 100), (2, 512)], group).collect()
    for cap_id, cap in ((1, 100), (2, 512)):
        mine = [r for r in out if r["capacity_id"] == cap_id]
        fill = Counter()
        for r in mine:
            fill[r["container"]] += r["n_tokens"]
        assert max(fill.values()) <= cap
        sizes = Counter()
        parts = defaultdict(list)
        for r in mine:
            sizes[r["doc_id"]] += r["n_tokens"]
            parts[r["doc_id"]].append(r["part"])
        want = Counter()
        for i, n in rows:
            want[i] += n or 0
        assert sizes == want and set(parts) == {i for i, _ in rows}
        whole = {i for i, n in rows if (n or 0) <= cap and i not in (3, None)}
        assert all(parts[i] == [0] for i in whole)
        assert sum(fill.values()) / cap / len(fill) > 0.9


def test_pack_nothing(spark):
    df = spark.createDataFrame([], "doc_id int, n int")
    assert packing.pack(df, "doc_id", "n", [(1, 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "n", [(1, 0)])


def test_containers_do_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i % 90, rng.randint(0, 70)) for i in range(500)], "doc_id int, n int")
    first = packing.pack(df.repartition(3), "doc_id", "n", [(1, 100)], 40)
    again = packing.pack(df.orderBy("n").coalesce(1), "doc_id", "n", [(1, 100)], 40)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))

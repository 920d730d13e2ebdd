"""Problem 6: similarity clusters by power-iteration spectral clustering on sparse affinities.

1. Anchors: the greedy net of each cell of rotated coordinates, taken in the order of the keys' hashes: a point is an
   anchor unless an earlier anchor lies within COVER of it. A crowded cell takes its next uncovered points in
   rounds, which gives the same net however large the rounds are: anchors stay COVER apart, so near copies share one.
2. Affinities: a point ties its own anchor to every anchor within REACH of it, with Gaussian weights, so the entries
   of a point are as many as its ties and pairs of points are never listed. With COVER = reach of a link / 2 the ties
   are exact: if x and y are linked (distance <= 1), y's anchor is within 1.5 of x, and as groups are more than 1.5
   apart, no tie joins two groups. Ties are summed per task and then globally.
3. Power iteration of VECTORS random vectors at once on the normalised affinities, one array per anchor, until they
   stand still: inside a group they converge to one value per vector, which sets the groups apart.
4. k-means on the embedding, seeded at its occupied grid cells, seeds within NEAR of each other merged.
5. Groups that mix slowly (long chains) aren't still by then: where clusters are left with an affinity between them,
   the clusters become the nodes of a smaller graph, on which step 3 goes on, and each cluster of a random half joins
   the tied cluster nearest to it in the embedding, until no affinity is cut. Usually there is no such level.
6. Members are ranked by internal affinity, which follows from the cluster's mean (see ``typical_members``).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.similar import rotation
from cairn.llm.term_tables import bounded_heap
from cairn.llm.vectors import POINTS_SQL, kmeanspp_points
from cairn.runtime import cut, is_empty

#: Two records this close are linked; anchors cover half of it; ties reach from one link past a cover.
LINK = 1.0
COVER, REACH = LINK / 2, LINK * 1.5
#: Width of the Gaussian affinity.
SIGMA = 1.0
VECTORS = 6
#: Iterations between tests of convergence, rounds of them on the first level (a further level has one), and the
#: movement that ends a level.
STEP, ROUNDS, STILL = 5, 6, 1e-7
#: Share of a node's own value that it keeps in a step.
STAY = 0.25
#: Grid of the embedding for seeds, and the distance up to which seeds are one.
FINE, NEAR = 1e-5, 1e-4
#: Rows, and anchors, that one task holds; changes the work's layout only, never the result.
CHUNK = 20_000
CELL = 4.0


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)


def _axes(count: int) -> int:
    """Rotated coordinates that make a cell: more of them as the table grows, so that cells keep their size."""
    return min(8, max(1, math.ceil(math.log(max(1, count / 3000), 4))))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every row's anchor in the greedy net of these rows, in the order of (h, key)."""
    pdf = pdf.sort_values(["h", "key"]).reset_index(drop=True)
    x = _matrix(pdf)
    leader, far = np.full(len(pdf), -1), np.zeros(len(pdf))
    rest = np.arange(len(pdf))
    while len(rest):
        d = ((x[rest] - x[rest[0]]) ** 2).sum(1)
        near = d <= COVER * COVER
        leader[rest[near]], far[rest[near]] = rest[0], d[near]
        rest = rest[~near]
    return pdf.assign(leader=pdf["key"].to_numpy()[leader], far=far)


_NET = "cell string, part int, key string, v array<double>, leader string, far double"


def anchor_net(points: DataFrame, size: int, axes: int, chunk: int = CHUNK) -> DataFrame:
    """(cell, part, key, v, leader, far) of every point: its anchor is ``sqrt(far)`` <= COVER away; an anchor is its own leader.

    A cell of at most ``chunk`` points is netted in one task. Of a crowded cell each round nets the first ``chunk``
    uncovered points, then compares the anchors found with the cell's other points, part by part.
    """
    turn = rotation(size, size)[:axes]

    def cells(batches):
        for pdf in batches:
            home = np.floor(_matrix(pdf) @ turn.T / CELL).astype(np.int64)
            yield pdf.assign(cell=[",".join(map(str, c)) for c in home.tolist()])[["cell", "h", "key", "v"]]

    placed = points.select("key", "v", F.xxhash64("key").alias("h")).mapInPandas(cells, "cell string, h long, key string, v array<double>")
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    placed = placed.join(crowded, "cell", "left").select("cell", F.coalesce(F.pmod("h", F.col("parts")).cast("int"), F.lit(0)).alias("part"), "h", "key", "v", F.col("parts").isNotNull().alias("crowded"))
    placed = cut(placed)
    net = placed.where("NOT crowded").drop("crowded").groupBy("cell").applyInPandas(lambda pdf: _greedy(pdf).drop(columns="h"), _NET)
    rest = placed.where("crowded").drop("crowded")

    def first_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        done = _greedy(pdf)
        return done[done["key"] == done["leader"]][["cell", "h", "key", "v"]]

    def cover(pdf: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        leader, far = np.full(len(pdf), None, dtype=object), np.full(len(pdf), np.nan)
        if len(pdf) and len(anchors):
            anchors = anchors.sort_values(["h", "key"])
            a, names, x = _matrix(anchors), anchors["key"].to_numpy(), _matrix(pdf)
            for start in range(0, len(x), 1024):
                d = ((x[start : start + 1024, None, :] - a[None]) ** 2).sum(2) if len(a) <= 64 else _squared(x[start : start + 1024], a)
                near = d <= COVER * COVER
                at, hit = near.argmax(1), near.any(1)  # the first anchor in order, as in the greedy net
                rows = start + np.flatnonzero(hit)
                leader[rows], far[rows] = names[at[hit]], d[np.flatnonzero(hit), at[hit]]
        return pdf.assign(leader=leader, far=far)

    while not is_empty(rest):
        heads = rest.groupBy("cell").agg(bounded_heap(F.struct("h", "key", "v"), chunk).alias("first")).select("cell", F.explode("first").alias("f"))
        anchors = cut(heads.select("cell", "f.h", "f.key", "f.v").groupBy("cell").applyInPandas(first_anchors, "cell string, h long, key string, v array<double>"))
        parts = rest.groupBy("cell").agg(F.max("part").alias("last"))
        copies = anchors.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "h", "key", "v")
        seen = cut(rest.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInPandas(cover, "cell string, part int, h long, key string, v array<double>, leader string, far double"))
        net = net.unionByName(seen.where("leader IS NOT NULL").drop("h"))
        rest = seen.where("leader IS NULL").drop("leader", "far")
    return net


def affinities(net: DataFrame, size: int, axes: int, chunk: int = CHUNK) -> DataFrame:
    """(a, b, m): summed affinities of anchors, symmetric, over the ties of all points; an anchor's own entry included."""
    turn = rotation(size, size)[:axes]

    def spread(batches):
        """Anchors in their own cell and those a point within REACH of them may be in."""
        for pdf in batches:
            y = _matrix(pdf) @ turn.T
            low, high = np.floor((y - REACH) / CELL).astype(np.int64), np.floor((y + REACH) / CELL).astype(np.int64)
            out: list[tuple] = []
            for key, v, a, b in zip(pdf["key"], pdf["v"], low.tolist(), high.tolist(), strict=True):
                cells = [[]]
                for p, q in zip(a, b, strict=True):
                    cells = [[*c, i] for c in cells for i in range(p, q + 1)]
                out += [(",".join(map(str, c)), key, v) for c in cells]
            yield pd.DataFrame(out, columns=["cell", "key", "v"])

    anchors = cut(net.where("key = leader").select("key", "v").mapInPandas(spread, "cell string, key string, v array<double>"))
    held = anchors.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("pages"))
    parts = net.groupBy("cell").agg((F.max("part") + 1).alias("parts")).join(held, "cell")
    copies = anchors.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("key"), F.col("pages")).cast("int").alias("page"), "key", "v")
    rows = net.join(parts, "cell").select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"), "v", "leader", "far")

    def tie(pdf: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, float] = {}
        own = np.zeros(0, dtype=object)
        if len(pdf) and len(anchors):
            own, mine = np.unique(pdf["leader"].to_numpy().astype(object), return_inverse=True)
            names, a, x, far = anchors["key"].to_numpy(), _matrix(anchors), _matrix(pdf), pdf["far"].to_numpy()
            for start in range(0, len(x), 1024):
                d = _squared(x[start : start + 1024], a)
                i, j = np.nonzero(d <= REACH * REACH * (1 + 1e-9))
                w = np.exp(-(d[i, j] + far[start + i]) / (2 * SIGMA * SIGMA))
                pair, at = np.unique(mine[start + i] * len(names) + j, return_inverse=True)
                for p, s in zip(pair.tolist(), np.bincount(at, w, len(pair)).tolist(), strict=True):
                    sums[p] = sums.get(p, 0.0) + s
        return pd.DataFrame([(own[p // len(names)], names[p % len(names)], s) for p, s in sums.items()], columns=["a", "b", "m"])

    by = ["cell", "part", "page"]
    half = rows.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(tie, "a string, b string, m double")
    both = F.array(F.struct("a", "b", "m"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "m"))
    return half.groupBy("a", "b").agg(F.sum("m").alias("m")).select(F.inline(both)).groupBy("a", "b").agg(F.sum("m").alias("m"))


def transition(edges: DataFrame) -> DataFrame:
    """(a, b, p): affinities to other nodes normalised by degree, with a share STAY of staying: rows sum to 1.

    A node's affinity to itself counts its own points only; walking it would slow the iteration without moving its limit.
    """
    others = edges.where("a <> b")
    degree = others.groupBy("a").agg(F.sum("m").alias("d"))
    stay = degree.select("a", F.col("a").alias("b"), F.lit(STAY).alias("p"))
    return others.join(degree, "a").select("a", "b", ((1 - STAY) * F.col("m") / F.col("d")).alias("p")).unionByName(stay)


def _hashed(i: int) -> Column:
    return F.pmod(F.xxhash64("a", F.lit(i)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def power_embedding(walk: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(a, x ARRAY<DOUBLE>): VECTORS random vectors after power iteration, iterated together until still or ``rounds`` are over."""
    x = walk.select("a").distinct().select("a", F.array(*[_hashed(i) for i in range(VECTORS)]).alias("x"))
    for k in range(rounds):
        for step in range(STEP):
            walked = walk.join(x.select(F.col("a").alias("b"), "x"), "b")
            found = [F.array(*[F.sum(F.col("p") * F.col("x")[i]) for i in range(VECTORS)]).alias("x")]
            if step == STEP - 1:  # every node has an entry of its own, which holds what it was a step before
                found.append(F.max(F.when(F.col("a") == F.col("b"), F.col("x"))).alias("y"))
            x = walked.groupBy("a").agg(*found)
        x = cut(x.withColumn("moved", F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))).drop("y"))
        if k + 1 == rounds or not x.where(F.col("moved") > STILL).take(1):
            break
        x = x.drop("moved")
    return x.select("a", "x")


def _distance(p: str, q: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def embedding_kmeans(x: DataFrame, lloyd: int = 2) -> DataFrame:
    """(a, cluster): k-means on the embedding, one seed per occupied fine cell unless a smaller seed lies within NEAR.

    The rows of a fine cell move as one weighted point. Points and centroids meet only in adjoining grid cells of
    width NEAR (first two coordinates), so the work grows with the seeds alone; a point without a centroid within
    NEAR keeps its own. ``cluster`` is the name of a row of the cluster.
    """
    cell = F.array(*[F.floor(F.col("x")[i] / FINE) for i in range(VECTORS)])
    named = x.select("a", "x", cell.alias("cell"))
    mean = F.array(*[F.avg(F.col("x")[i]) for i in range(VECTORS)])
    points = cut(named.groupBy("cell").agg(F.min("a").alias("id"), mean.alias("c"), F.count(F.lit(1)).alias("n")))

    def meet(centroids: DataFrame) -> DataFrame:
        """(id, other, d): points and the centroids within NEAR of them."""
        around = centroids
        for at, name in enumerate(("u", "v")):
            home = F.floor(F.col("e")[at] / NEAR)
            around = around.withColumn(name, F.explode(F.sequence(home - 1, home + 1)))
        here = points.select("id", "c", F.floor(F.col("c")[0] / NEAR).alias("u"), F.floor(F.col("c")[1] / NEAR).alias("v"))
        return here.join(around, ["u", "v"]).select("id", "other", _distance("c", "e").alias("d")).where(F.col("d") <= NEAR)

    near = meet(points.select(F.col("id").alias("other"), F.col("c").alias("e")))
    centroids = points.join(near.groupBy("id").agg(F.min("other").alias("least")).where("least = id").select("id"), "id").select(F.col("id").alias("other"), F.col("c").alias("e"))
    assigned = points
    for k in range(lloyd):
        nearest = meet(centroids).groupBy("id").agg(F.min_by("other", F.struct("d", "other")).alias("seed"))
        assigned = points.join(nearest, "id", "left").select("id", "cell", "c", "n", F.coalesce("seed", "id").alias("cluster"))
        if k + 1 < lloyd:
            moved = F.array(*[F.sum(F.col("n") * F.col("c")[i]) / F.sum("n") for i in range(VECTORS)])
            centroids = assigned.groupBy("cluster").agg(moved.alias("e")).withColumnRenamed("cluster", "other")
    return named.join(assigned.select("cell", "cluster"), "cell").select("a", "cluster")


def hooked(x: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """(a, cluster): each node of a random half joins the tied node of the other half nearest in the embedding."""
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 0
    ends = edges.where(side("a") & ~side("b")).join(x.withColumnRenamed("x", "xa"), "a").join(x.select(F.col("a").alias("b"), F.col("x").alias("xb")), "b")
    to = ends.groupBy("a").agg(F.min_by("b", F.struct(_distance("xa", "xb"), F.col("b"))).alias("to"))
    return x.select("a").join(to, "a", "left").select("a", F.coalesce("to", "a").alias("cluster"))


def spectral_labels(edges: DataFrame) -> DataFrame:
    """(a, cluster) of every anchor that is tied to another one; on further levels clusters are the nodes (step 5)."""
    edges = cut(edges.join(edges.where("a <> b").select("a").distinct(), "a"))
    labels, level = None, 0
    while not is_empty(edges):
        x = power_embedding(cut(transition(edges)), 1 if level else ROUNDS)
        found = cut(hooked(x, edges, level) if level else embedding_kmeans(x))
        if labels is None:
            labels = found
        else:
            into = found.select(F.col("cluster").alias("into"), F.col("a").alias("cluster"))
            labels = cut(labels.join(into, "cluster", "left").select("a", F.coalesce("into", "cluster").alias("cluster")))
        merged = edges.join(found, "a").withColumnsRenamed({"cluster": "ca"}).join(found.withColumnsRenamed({"a": "b", "cluster": "cb"}), "b")
        merged = cut(merged.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("m").alias("m")))
        edges = merged.join(merged.where("a <> b").select("a").distinct(), "a")
        level += 1
    return edges.select("a", F.col("b").alias("cluster")) if labels is None else labels


def spectral_clusters(points: DataFrame, size: int, chunk: int = CHUNK) -> DataFrame:
    """(key, v, cluster_id, size) of all ``points`` (key unique, v of ``size`` finite numbers).

    cluster_id is the smallest key of the cluster; a point without partners is a cluster of its own. Equal vectors
    always share a cluster. An empty input gives no rows. Extra columns are dropped. Two groups are taken for one only
    if all VECTORS of their random values agree within NEAR.
    """
    points = cut(points.select("key", "v"))
    axes = _axes(points.count())
    net = cut(anchor_net(points, size, axes, chunk))
    labels = spectral_labels(affinities(net, size, axes, chunk))
    members = cut(net.join(labels.withColumnRenamed("a", "leader"), "leader", "left").select("key", "v", F.coalesce("cluster", "leader").alias("cluster")))
    names = members.groupBy("cluster").agg(F.min("key").alias("cluster_id"), F.count(F.lit(1)).alias("size"))
    return members.join(names, "cluster").select("key", "v", "cluster_id", "size")


def typical_members(members: DataFrame, size: int, n: int = 3) -> DataFrame:
    """cluster_id, size and ``n`` most typical keys of every cluster: most internal affinity first, then the smaller key.

    The internal affinity of x is the mean over members y of 1 - |x - y|^2 (Epanechnikov's, LINK wide), which is
    1 - |x|^2 + 2 x.mean - mean |y|^2: exact and linear in the members, whatever the cluster's size.
    """
    total = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    means = members.groupBy("cluster_id").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(size)]).alias("mean"), F.avg(total).alias("square"))
    dot = F.aggregate(F.zip_with("v", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    inner = F.round(1 - (total - 2 * dot + F.col("square")) / (LINK * LINK), 6)
    heap = bounded_heap(F.struct((-inner).alias("far"), F.col("key")), n)
    ranked = members.join(means, "cluster_id").groupBy("cluster_id", "size").agg(heap.alias("heap"))
    return ranked.select("cluster_id", "size", F.transform(F.array_sort("heap"), lambda h: h["key"]).alias("typical"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in groups of at least 3 with the smallest id of their group."""
    return spectral_clusters(kmeanspp_points(spark, sf_dir), 16).where("size >= 3").select(F.col("key").alias("id"), "cluster_id")


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster_id, size and the 3 most typical ids of every cluster, joined by commas."""
    out = typical_members(spectral_clusters(kmeanspp_points(spark, sf_dir), 16), 16)
    return out.withColumn("typical", F.array_join("typical", ","))


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}
#: Brute force over all pairs: for the small table only.
_GROUPS = f"""WITH RECURSIVE {POINTS_SQL}, near AS (SELECT a.key AS a, b.key AS b FROM pts a JOIN pts b ON list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)) <= 1),
reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
g AS (SELECT a AS id, min(b) AS cluster_id, count(*) AS n FROM reach GROUP BY a)"""
ORACLES = {
    "p6_found": f"{_GROUPS} SELECT id, cluster_id FROM g WHERE n >= 3",
    "p6_clusters": f"""{_GROUPS}, e AS (SELECT id, cluster_id, n, unnest(v) AS x, unnest(range(16)) AS i FROM g JOIN pts ON pts.key = g.id),
mu AS (SELECT cluster_id, i, avg(x) AS mu, avg(x * x) AS q FROM e GROUP BY ALL),
r AS (SELECT cluster_id, n, id, round(1 - (sum(x * x) - 2 * sum(x * mu) + sum(q)), 6) AS inn FROM e JOIN mu USING (cluster_id, i) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY inn DESC, id) AS rank FROM r)
SELECT cluster_id, n AS size, string_agg(id, ',' ORDER BY rank) AS typical FROM k WHERE rank <= 3 GROUP BY cluster_id, n""",
}

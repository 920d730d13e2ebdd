"""Problem 7: most similar vectors by randomly rotated one-bit codes (RaBitQ, Gao and Long 2024).

A vector o is centred, scaled to unit length, randomly rotated and coded by the signs of its D coordinates: o_bar =
sign / sqrt(D). With the correction scalar c = <o_bar, o>, the ratio <o_bar, q> / c estimates <o, q> without bias for
any rotated query q, and its error exceeds EPSILON * sqrt((1 - c^2) / c^2 / (D - 1)) with a probability that falls as
exp(-EPSILON^2 / 2). Only pairs whose estimate is within that bound of the threshold (or of the k-th best) are
reranked on the vectors themselves.

Sparse vectors over an open vocabulary are rotated by random signs per dimension (each dimension's D signs come from
its hash), so no vocabulary is ever collected; the spread of that projection is added to the bound.

Candidates never come from all pairs. Equal vectors are searched once and their keys expanded at the end. For a
threshold, vectors meet in blocks that provably hold every result: dense vectors in cells of rotated coordinates with
a margin, sparse ones under the prefix of their rarest dimensions. A crowded cell is cut again by further rotated
coordinates; what is crowded even then is worked chunk pair by chunk pair. For the k nearest, a stated query set runs
against all rows in blocks: keys whose number is divisible by 20, for the words of lsh, which have none, their digest.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.term_tables import bounded_heap
from cairn.llm.vectors import POINTS_SQL, SPARSE_SQL, kmeanspp_points, lsh_vectors
from cairn.runtime import cut, is_empty

BITS = 128
DENSE_BITS = 64
EPSILON = 4.0
SEED = 20
#: Rows of a block that are compared at once; larger blocks are cut.
CHUNK = 2_000
#: Rows of many blocks that one group holds.
BUCKET = 20_000
#: Pairs of rows compared in one step, and rows from which on a task is worked as a matrix.
PAIRS, MATRIX = 100_000, 48
#: Cell width as a multiple of the threshold, and rotated coordinates that make a cell.
WIDTH, AXES = 6.0, 4


# ---------------------------------------------------------------- codes


@lru_cache(maxsize=8)
def rotation(rows: int, columns: int) -> np.ndarray:
    """A random rows x columns matrix with orthonormal columns (rows >= columns)."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((rows, rows)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :columns])


@lru_cache(maxsize=200_000)
def signs(dim: str, bits: int) -> np.ndarray:
    """The random signs of a sparse dimension, the same in every task."""
    seed = (zlib.crc32(dim.encode()), zlib.adler32(dim.encode()), SEED)
    return np.random.default_rng(seed).integers(0, 2, bits, dtype=np.int8).astype(np.float32) * 2 - 1


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of rotated unit vectors (rows)."""
    bits = rotated > 0
    return np.packbits(bits, axis=1), np.abs(rotated).sum(1) / np.sqrt(rotated.shape[1])


def estimate(codes: np.ndarray, correction: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (code x query) and the error bound of each code."""
    bits = queries.shape[1]
    plus = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    # <o_bar, q> from the set bits alone: sum over set bits, twice, less the query's total
    inner = (2 * (plus @ queries.T.astype(np.float32)) - queries.sum(1, dtype=np.float32)) / np.sqrt(bits)
    c = np.maximum(correction, 1e-6)[:, None]
    return inner / c, (EPSILON * np.sqrt(np.maximum(0, 1 - c * c)) / c / np.sqrt(bits - 1)).astype(np.float32)


def sketch(dims: list, values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The rotated unit vector of a sparse vector."""
    y = np.asarray(values, dtype=np.float32) @ np.stack([signs(d, bits) for d in dims])
    n = float(np.linalg.norm(y))
    return y / n if n > 0 else y


# ---------------------------------------------------------------- blocks


def _chunked(blocks: DataFrame, chunk: int) -> DataFrame:
    """Rows of blocks of two or more, with ``task``: their block and one of its chunk pairs (c1 <= c2), and ``bucket``.

    A block of at most ``chunk`` rows is one pair (0, 0). A crowded block's rows are copied once per chunk, so that no
    task holds more than two chunks and every pair of rows meets in exactly one chunk pair. Buckets gather tasks by
    their own names, about BUCKET rows each, so the pairs of a crowded block spread over the cluster.
    """
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = blocks.join(sizes, "block").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("c1", F.least("mine", "other")).withColumn("task", F.concat_ws("/", "block", "c1", F.greatest("mine", "other")))
    rows = rows.withColumn("cross", F.col("mine") != F.col("other")).withColumn("second", F.col("mine") != F.col("c1"))
    work = sizes.agg(F.sum(F.col("n") * F.ceil(F.col("n") / chunk)).alias("rows")).first()["rows"] or 0
    return rows.withColumn("bucket", F.pmod(F.xxhash64("task"), F.lit(max(1, -(-work // BUCKET))))).drop("block", "n", "chunks", "other", "mine", "c1")


def _sorted_tasks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows by task and side, and where each task starts (and the last ends)."""
    pdf = pdf.sort_values(["task", "second"], kind="stable").reset_index(drop=True)
    task = pdf["task"].to_numpy()
    return pdf, np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))


def _row_pairs(pdf: pd.DataFrame, starts: np.ndarray):
    """Positions (i, j) of all pairs of rows to compare in tasks of less than MATRIX rows, about PAIRS of them at a time.

    Inside a task of one chunk each row meets all that follow it; in a task of two chunks, those of the second chunk.
    """
    n, sizes = len(pdf), np.diff(starts)
    last = np.repeat(starts[1:], sizes)
    here = np.arange(n)
    follow = here + 1
    if pdf["cross"].any():
        second, cross = pdf["second"].to_numpy(), pdf["cross"].to_numpy()
        border = np.repeat(starts[1:] - np.add.reduceat(second.astype(np.int64), starts[:-1]), sizes)
        follow = np.where(cross, np.where(second, last, border), follow)
    counts = np.where(np.repeat(sizes, sizes) < MATRIX, last - follow, 0)
    ends = np.cumsum(counts)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        c = counts[at:stop]
        total = int(c.sum())
        if total:
            i = np.repeat(here[at:stop], c)
            yield i, np.repeat(follow[at:stop] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(total)
        at = stop


def _candidates(pdf: pd.DataFrame, starts: np.ndarray, bits: np.ndarray, correction: np.ndarray, queries: np.ndarray, epsilon: float | None, maybe):
    """Positions (i, j) of the pairs to measure: those ``maybe(i, j, guess, bound)`` keeps, all with ``epsilon`` None.

    ``guess`` is the estimate of code i against query j and ``bound`` its error bound, as in ``estimate``.
    """
    width = bits.shape[1]
    c = np.maximum(correction, 1e-6)
    bound = (epsilon or 0.0) * np.sqrt(np.maximum(0, 1 - c * c)) / c / np.sqrt(width - 1)
    total, root = queries.sum(1), np.sqrt(width)
    for i, j in _row_pairs(pdf, starts):
        if epsilon is not None:
            keep = maybe(i, j, (2 * np.einsum("pd,pd->p", bits[i], queries[j]) - total[j]) / root / c[i], bound[i])
            i, j = i[keep], j[keep]
        yield i, j
    cross, second = pdf["cross"].to_numpy(), pdf["second"].to_numpy()
    for first, last in zip(starts[:-1], starts[1:], strict=True):
        if last - first < MATRIX:
            continue
        rows = np.arange(first, last)
        a, b = (rows[~second[rows]], rows[second[rows]]) if cross[first] else (rows, rows)
        for at in range(0, len(b), 512):
            q = b[at : at + 512]
            if epsilon is None:
                keep = np.ones((len(a), len(q)), dtype=bool)
            else:
                keep = maybe(a[:, None], q[None, :], (2 * (bits[a] @ queries[q].T) - total[q]) / root / c[a][:, None], bound[a][:, None])
            i, j = np.nonzero(keep)
            i, j = a[i], q[j]
            yield (i, j) if cross[first] else (i[i < j], j[i < j])


def _representatives(rows: DataFrame, value: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows with one key per distinct value, members (rep, key) of the values that several keys have, None without any).

    Only rows whose value's hash occurs again are compared by the value itself.
    """
    rows = cut(rows.select("key", *value, F.xxhash64(*value).alias("h")))
    again = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"))
    if is_empty(again):
        return rows.drop("h"), None
    shared = cut(rows.join(again, "h", "left_semi").drop("h"))
    reps = cut(shared.groupBy(*value).agg(F.min("key").alias("key")))
    members = cut(shared.join(reps.withColumnRenamed("key", "rep"), value).select("rep", "key"))
    single = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("rep")  # equal hashes of unequal values
    return rows.join(again, "h", "left_anti").drop("h").unionByName(reps), members.join(single, "rep", "left_anti")


def _expand(pairs: DataFrame, members: DataFrame | None) -> DataFrame:
    """Pairs of representatives (a, b) as pairs of all their keys, those of one representative included."""
    if members is None:
        return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
    for side in ("a", "b"):
        own = members.select(F.col("rep").alias(side), F.col("key").alias("k"))
        pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("k", side)).drop("k")
    inside = members.join(members.withColumnRenamed("key", "other"), "rep").where("key < other").select(F.col("key").alias("key_a"), F.col("other").alias("key_b"))
    return pairs.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).unionByName(inside)


def within_distance(points: DataFrame, radius: float, size: int, chunk: int = CHUNK, epsilon: float | None = EPSILON) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all pairs of ``points`` (key, v) at Euclidean distance <= ``radius``.

    Two points within the radius differ by at most it in every rotated coordinate, so with one-sided margins both
    are in the cell of the greater home coordinates: no pair is lost. Cells take AXES coordinates; a cell of more than
    ``chunk`` rows is cut by the next AXES, and so on. Inside a cell, one-bit codes about the cell's mean give distance
    estimates; pairs that may lie within the radius by the error bound are measured exactly. With ``epsilon`` None
    every pair of a cell is measured, so the result rests on no estimate. Empty input gives no rows.
    """
    turn, width = rotation(size, size), WIDTH * radius
    reps, members = _representatives(points.select("key", "v"), ["v"])

    def cells(axes: np.ndarray):
        def run(batches):
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
                y = x @ axes.T
                home, upper = np.floor(y / width).astype(np.int64), np.floor((y + radius * (1 + 1e-9) + 1e-12) / width).astype(np.int64)
                at, cell = [], []
                for mask in range(1 << len(axes)):
                    pick = np.array([mask >> i & 1 for i in range(len(axes))], dtype=bool)
                    keep = ((upper != home) | ~pick).all(1)
                    if keep.any():
                        at.append(np.flatnonzero(keep))
                        cell.append(np.where(pick, upper, home)[keep])
                if at:
                    at, cell = np.concatenate(at), np.concatenate(cell)
                    names = [f"{b}{','.join(map(str, c))};" for b, c in zip(pdf["block"].to_numpy()[at], cell.tolist(), strict=True)]
                    yield pd.DataFrame({"block": names, "key": pdf["key"].to_numpy()[at], "v": pdf["v"].to_numpy()[at]})

        return run

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = _sorted_tasks(pdf)
        keys, x = pdf["key"].to_numpy(), np.array(pdf["v"].tolist(), dtype=np.float64)
        sizes = np.diff(starts)
        mean = np.add.reduceat(x, starts[:-1]) / sizes[:, None]
        centred = (x - np.repeat(mean, sizes, 0)) @ rotation(DENSE_BITS, size).T
        norm = np.linalg.norm(centred, axis=1)
        unit = (centred / np.maximum(norm, 1e-300)[:, None]).astype(np.float32)
        bits, correction = (unit > 0).astype(np.float32), np.abs(unit).sum(1) / np.sqrt(DENSE_BITS)
        found: list[tuple[str, str]] = []

        def maybe(i, j, guess, bound):
            scale = norm[i] * norm[j]
            return norm[i] ** 2 + norm[j] ** 2 - 2 * scale * (guess + bound) <= radius * radius + 1e-9 + 1e-5 * scale

        for i, j in _candidates(pdf, starts, bits, correction, unit, epsilon, maybe):
            close = np.sqrt(((x[i] - x[j]) ** 2).sum(1)) <= radius
            found += zip(keys[i[close]], keys[j[close]], strict=True)
        return pd.DataFrame([p if p[0] < p[1] else p[::-1] for p in found], columns=["a", "b"])

    blocks = cut(reps.select(F.lit("").alias("block"), "key", "v").mapInPandas(cells(turn[:AXES]), "block string, key string, v array<double>"))
    for first in range(AXES, size, AXES):
        crowded = cut(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("block"))
        if is_empty(crowded):
            break
        again = blocks.join(crowded, "block").select("block", "key", "v").mapInPandas(cells(turn[first : first + AXES]), "block string, key string, v array<double>")
        blocks = cut(blocks.join(crowded, "block", "left_anti").unionByName(again))
    return _expand(_chunked(blocks, chunk).groupBy("bucket").applyInPandas(search, "a string, b string").distinct(), members)


def _exact_cosine(a_dims, a_v, b_dims, b_v) -> float:
    b = dict(zip(b_dims, b_v, strict=True))
    dot = sum(x * b[d] for d, x in zip(a_dims, a_v, strict=True) if d in b)
    return dot / float(np.linalg.norm(a_v) * np.linalg.norm(b_v))


def above_cosine(vectors: DataFrame, threshold: float, chunk: int = CHUNK, epsilon: float | None = EPSILON) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all pairs of ``vectors`` (key, dims, v) with cosine >= ``threshold`` > 0.

    Blocks: dimensions are ordered by how many vectors have them; a vector's prefix is its rarest dimensions up to
    where the rest of its unit length falls below the threshold. Two vectors without a common prefix dimension have
    all they share in the rest of one of them, which is too short to reach the threshold: no pair is lost. Inside
    a block one-bit codes choose the pairs, whose cosine is then computed on the sparse vectors. Empty input gives
    no rows. What the code estimate may lose is bounded by ``epsilon`` (four standard deviations); with None every
    pair of a block is reranked, so the result rests on no estimate.
    """
    reps, members = _representatives(vectors.select("key", "dims", "v"), ["dims", "v"])
    vectors = cut(reps.withColumn("no", F.monotonically_increasing_id()))
    rarity = vectors.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("df"))
    entries = vectors.select("no", F.arrays_zip(F.col("dims").alias("dim"), F.col("v").alias("x")).alias("z")).select("no", F.inline("z")).toDF("no", "dim", "x")
    ranked = entries.join(rarity, "dim").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("df", "dim", "x"))).alias("e"))
    square = F.aggregate("e", F.lit(0.0), lambda s, e: s + e["x"] * e["x"])
    steps = F.aggregate(
        "e",
        F.struct(F.col("n2").alias("rest"), F.array().cast("array<string>").alias("dims")),
        lambda s, e: F.when(s["rest"] >= (threshold * threshold) * (1 - 1e-9) * F.col("n2"), F.struct((s["rest"] - e["x"] * e["x"]).alias("rest"), F.concat(s["dims"], F.array(e["dim"])).alias("dims"))).otherwise(s),
    )
    prefix = ranked.withColumn("n2", square).select("no", steps["dims"].alias("prefix"))

    def codes(batches):
        for pdf in batches:
            y = np.stack([sketch(d, x) for d, x in zip(pdf["dims"], pdf["v"], strict=True)]) if len(pdf) else np.zeros((0, BITS), np.float32)
            packed, correction = encode(y)
            scale = np.abs(y).max(1, initial=1e-9) / 127  # the query side needs no more than a byte a coordinate
            whole = np.rint(y / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"key": pdf["no"], "code": [c.tobytes() for c in packed], "c": correction.astype(np.float32), "q": [w.tobytes() for w in whole], "s": scale.astype(np.float32)})

    coded = vectors.select("no", "dims", "v").mapInPandas(codes, "key long, code binary, c float, q binary, s float")
    blocks = cut(coded.join(prefix, coded["key"] == prefix["no"]).select(F.explode("prefix").alias("block"), "key", "code", "c", "q", "s"))
    # spread of the random projection of a pair at the threshold
    slack = (epsilon or 0.0) * (1 - threshold * threshold) / np.sqrt(BITS)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts = _sorted_tasks(pdf)
        keys = pdf["key"].to_numpy()
        bits = np.unpackbits(np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1), axis=1).astype(np.float32)
        q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), -1).astype(np.float32) * pdf["s"].to_numpy()[:, None]
        correction = pdf["c"].to_numpy()
        found = [np.zeros((0, 2), np.int64)]
        for i, j in _candidates(pdf, starts, bits, correction, q, epsilon, lambda i, j, guess, bound: guess + bound >= threshold - slack):
            found.append(np.sort(np.stack([keys[i], keys[j]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    chosen = _chunked(blocks, chunk).groupBy("bucket").applyInPandas(search, "a long, b long").distinct()

    def rerank(batches):
        for pdf in batches:
            cos = [_exact_cosine(*r) for r in zip(pdf["a_dims"], pdf["a_v"], pdf["b_dims"], pdf["b_v"], strict=True)]
            keep = pdf[np.array(cos, dtype=float) >= threshold]
            yield pd.DataFrame({"a": keep["a_key"], "b": keep["b_key"]})

    left = vectors.select(F.col("no").alias("a"), F.col("key").alias("a_key"), F.col("dims").alias("a_dims"), F.col("v").alias("a_v"))
    right = vectors.select(F.col("no").alias("b"), F.col("key").alias("b_key"), F.col("dims").alias("b_dims"), F.col("v").alias("b_v"))
    return _expand(chosen.join(left, "a").join(right, "b").drop("a", "b").mapInPandas(rerank, "a string, b string"), members)


# ---------------------------------------------------------------- k nearest


def k_nearest(rows: DataFrame, queries: DataFrame, k: int, cosine: bool, block: int = 20_000, query_block: int = 20_000) -> DataFrame:
    """(key, neighbour, similarity, rank) of the ``k`` rows most similar to each of ``queries``, itself left out.

    ``rows`` and ``queries`` are (key, dims, v); dense vectors take their positions as dims. Similarity is the cosine
    or the negative Euclidean distance. Rows and queries meet block by block (``block`` rows, ``query_block`` queries
    at most); in each block one-bit codes bound every similarity and those that can be among the k best are measured
    exactly. Per query and block k rows go on to a merge. Ties go to the smaller key; fewer rows give fewer ranks.
    """
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // block)), max(1, -(-n_queries // query_block))
    left = rows.select(F.pmod(F.xxhash64("key"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "key", "dims", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_blocks - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("key"), F.lit(query_blocks)).cast("int").alias("qb"), "key", "dims", "v")

    def search(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(r) and len(q):
            order = np.argsort(r["key"].to_numpy().astype(str), kind="stable")
            r = r.iloc[order]
            keys = r["key"].to_numpy()
            vocabulary: dict[str, int] = {}
            lengths = np.array([len(d) for d in r["dims"]])
            ids = np.array([vocabulary.setdefault(d, len(vocabulary)) for dims in r["dims"] for d in dims])
            values = np.concatenate(r["v"].to_numpy()).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            norms = np.sqrt(np.add.reduceat(values * values, starts))
            y = np.stack([sketch(d, x) for d, x in zip(r["dims"], r["v"], strict=True)])
            codes, correction = encode(y)
            for first in range(0, len(q), 128):
                part = q.iloc[first : first + 128]
                yq = np.stack([sketch(d, x) for d, x in zip(part["dims"], part["v"], strict=True)])
                qn = np.array([np.linalg.norm(x) for x in part["v"]])
                guess, bound = estimate(codes, correction, yq)
                spread = bound + EPSILON / np.sqrt(BITS)
                if cosine:
                    best, sure = guess + spread, guess - spread
                else:
                    top = norms[:, None] ** 2 + qn[None, :] ** 2
                    best, sure = -(top - 2 * norms[:, None] * qn * (guess + spread)), -(top - 2 * norms[:, None] * qn * (guess - spread))
                for j, (key, dims, v) in enumerate(zip(part["key"], part["dims"], part["v"], strict=True)):
                    m = min(k + 1, len(keys))  # the query itself may be among the rows
                    kth = np.partition(sure[:, j], len(keys) - m)[len(keys) - m]
                    maybe = np.flatnonzero(best[:, j] >= kth)
                    weight = np.zeros(len(vocabulary) + 1)
                    for d, x in zip(dims, v, strict=True):
                        weight[vocabulary.get(d, len(vocabulary))] = x if d in vocabulary else 0.0
                    sizes = lengths[maybe]
                    flat = np.repeat(starts[maybe] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                    dot = np.add.reduceat(values[flat] * weight[ids[flat]], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    exact = dot / (norms[maybe] * qn[j]) if cosine else -np.sqrt(np.maximum(0, norms[maybe] ** 2 + qn[j] ** 2 - 2 * dot))
                    exact[keys[maybe] == key] = -np.inf
                    pick = np.argsort(-exact, kind="stable")[:k]
                    out += [(key, keys[maybe[p]], float(exact[p])) for p in pick if exact[p] > -np.inf]
        return pd.DataFrame(out, columns=["key", "neighbour", "similarity"])

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(search, "key string, neighbour string, similarity double")
    order = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), F.col("neighbour").alias("n"))))  # k per row block
    ranked = found.groupBy("key").agg(F.slice(order, 1, k).alias("best")).select("key", F.posexplode("best").alias("rank", "b"))
    return ranked.select("key", F.col("b.n").alias("neighbour"), (-F.col("b.far")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


#: Rows of the sample on which the cells of the dense index are fitted, cells, cells looked into first, rows of a part.
SAMPLE, CELLS, PROBE, PART = 8_192, 256, 4, 20_000


def fit_cells(points: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Centroids of the index: k-means on the ``sample`` rows of the smallest key hashes, at most ``cells`` of them."""
    rows = points.select(F.xxhash64("key").alias("h"), "v").orderBy("h").limit(sample).select("v").collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1), axis=0)
    centroids = x[np.random.default_rng(SEED).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        home = (((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)) - 2 * x @ centroids.T).argmin(1)
        for c in np.unique(home):
            centroids[c] = x[home == c].mean(0)
    return centroids


def k_nearest_in_cells(points: DataFrame, queries: DataFrame, k: int, size: int, cells: int = CELLS, sample: int = SAMPLE, probe: int = PROBE, part: int = PART) -> DataFrame:
    """(key, neighbour, similarity, rank): the ``k`` of ``points`` (key, v) nearest to each of ``queries``, itself left out.

    Similarity is the negative Euclidean distance. Every row belongs to the cell of its nearest centroid. A query first
    looks into its ``probe`` nearest cells, which bounds its k-th distance, then into every further cell that may hold
    a nearer row: whose centroid is no farther than that bound plus the cell's radius. No cell that matters is left
    out; inside a cell, residuals about the centroid are coded in one bit a coordinate and the error bound chooses what
    is measured. Cells of more than ``part`` rows are worked part by part. Ties go to the smaller key; fewer rows give
    fewer ranks; equal keys count once; an empty table gives no rows; extra columns are dropped.
    """
    centroids = fit_cells(points, cells, sample)
    turn = rotation(DENSE_BITS, size)
    none = points.sparkSession.createDataFrame([], "key string, neighbour string, similarity double, rank int")
    if not len(centroids):
        return none

    def homes(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T))
            yield pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": d.min(1), "key": pdf["key"], "v": pdf["v"]})

    placed = cut(points.select("key", "v").mapInPandas(homes, "cell int, far double, key string, v array<double>"))
    known = {r["cell"]: (r["radius"], r["parts"]) for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")).collect()}  # one row a cell
    radius = np.array([known.get(c, (-np.inf, 0))[0] for c in range(len(centroids))])
    parts = {c: n for c, (_, n) in known.items()}
    held = np.array(sorted(known))
    pages = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    rows = placed.select("cell", F.pmod(F.xxhash64("key"), pages[F.col("cell")]).cast("int").alias("part"), "key", "v")

    def look(further: bool):
        """Queries in the cells to look into: the ``probe`` nearest, or all others that may hold a nearer row."""

        def run(batches):
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (centroids[held] ** 2).sum(1) - 2 * x @ centroids[held].T))
                first = np.argsort(d, axis=1, kind="stable")[:, :probe]
                want = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(want, first, True, axis=1)
                if further:
                    want = ~want & (d - radius[held] <= pdf["best"].to_numpy()[:, None] + 1e-6)
                i, j = np.nonzero(want)
                at = [(a, int(held[b]), p) for a, b in zip(i.tolist(), j.tolist(), strict=True) for p in range(parts[int(held[b])])]
                a = np.array([t[0] for t in at], dtype=np.int64)
                yield pd.DataFrame({"cell": np.array([t[1] for t in at], np.int32), "part": np.array([t[2] for t in at], np.int32), "key": pdf["key"].to_numpy()[a], "v": pdf["v"].to_numpy()[a], "best": pdf["best"].to_numpy()[a]})

        return run

    def search(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(r) and len(q):
            r = r.iloc[np.argsort(r["key"].to_numpy().astype(str), kind="stable")]
            keys, x, c = r["key"].to_numpy(), np.array(r["v"].tolist(), dtype=np.float64), centroids[int(r["cell"].iloc[0])]
            rest = (x - c) @ turn.T
            norm = np.linalg.norm(rest, axis=1)
            codes, correction = encode(rest / np.maximum(norm, 1e-300)[:, None])
            for start in range(0, len(q), 256):
                some = q.iloc[start : start + 256]
                y = np.array(some["v"].tolist(), dtype=np.float64)
                away = (y - c) @ turn.T
                long = np.linalg.norm(away, axis=1)
                guess, bound = estimate(codes, correction, away / np.maximum(long, 1e-300)[:, None])
                whole, twice = norm[:, None] ** 2 + long**2, 2 * norm[:, None] * long
                low, high = whole - twice * (guess + bound) - 1e-9 - 1e-5 * twice, whole - twice * (guess - bound)
                m = min(k + 1, len(keys))  # the query itself may be among the rows
                limit = np.minimum(np.partition(high, m - 1, axis=0)[m - 1], some["best"].to_numpy() ** 2 * (1 + 1e-9) + 1e-12)
                for j, key in enumerate(some["key"]):
                    maybe = np.flatnonzero((low[:, j] <= limit[j]) & (keys != key))
                    d = np.sqrt(((x[maybe] - y[j]) ** 2).sum(1))
                    out += [(key, keys[maybe[p]], float(d[p])) for p in np.argsort(d, kind="stable")[:k]]
        return pd.DataFrame(out, columns=["key", "neighbour", "d"])

    def found(looking: DataFrame) -> DataFrame:
        return rows.groupBy("cell", "part").cogroup(looking.groupBy("cell", "part")).applyInPandas(search, "key string, neighbour string, d double")

    places = "cell int, part int, key string, v array<double>, best double"
    asked = cut(queries.select("key", "v").withColumn("best", F.lit(float("inf"))))
    near = cut(found(asked.mapInPandas(look(False), places)))
    kth = near.groupBy("key").agg(bounded_heap(F.struct("d", "neighbour"), k).alias("h")).select("key", F.when(F.size("h") >= k, F.array_max("h")["d"]).otherwise(float("inf")).alias("best"))
    again = asked.drop("best").join(kth, "key", "left").withColumn("best", F.coalesce("best", F.lit(float("inf"))))
    far = found(again.mapInPandas(look(True), places))
    best = near.unionByName(far).groupBy("key").agg(bounded_heap(F.struct("d", "neighbour"), k).alias("h"))
    ranked = best.select("key", F.posexplode(F.array_sort("h")).alias("rank", "b"))
    return ranked.select("key", F.col("b.neighbour").alias("neighbour"), (-F.col("b.d")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


# ---------------------------------------------------------------- queries


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lsh words with cosine >= 0.8 and of kmeanspp ids at distance <= 0.02."""
    words = above_cosine(lsh_vectors(spark, sf_dir), 0.8).select(F.lit("lsh").alias("src"), "key_a", "key_b")
    points = within_distance(kmeanspp_points(spark, sf_dir), 0.02, 16).select(F.lit("kmeanspp").alias("src"), "key_a", "key_b")
    return words.unionByName(points)


def p7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar others of every query key: kmeanspp ids whose number, lsh words whose digest is divisible by 20."""
    points = cut(kmeanspp_points(spark, sf_dir))
    words = lsh_vectors(spark, sf_dir)
    chosen = points.where(F.expr("try_cast(regexp_extract(key, '[0-9]+$', 0) AS bigint) % 20 = 0"))
    a = k_nearest_in_cells(points, chosen, 10, 16).withColumn("src", F.lit("kmeanspp"))
    b = k_nearest(words, words.where(F.expr("conv(substr(md5(key), 1, 8), 16, 10) % 20 = 0")), 10, cosine=True).withColumn("src", F.lit("lsh"))
    return a.unionByName(b).select("src", "key", "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


QUERIES = {"p7_found": p7_found, "p7_topk": p7_topk}
#: Brute force over all pairs: for the small table only.
_PAIRS = f"""WITH {POINTS_SQL}, {SPARSE_SQL}, n AS (SELECT key, sqrt(sum(x * x)) AS n FROM sv GROUP BY key),
cs AS (SELECT a.key AS a, b.key AS b, sum(a.x * b.x) / any_value(na.n * nb.n) AS cos FROM sv a JOIN sv b ON a.dim = b.dim AND a.key <> b.key JOIN n na ON na.key = a.key JOIN n nb ON nb.key = b.key GROUP BY ALL),
ds AS (SELECT a.key AS a, b.key AS b, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) AS d FROM pts a JOIN pts b ON a.key <> b.key)"""
ORACLES = {
    "p7_found": f"{_PAIRS} SELECT 'lsh' AS src, a AS key_a, b AS key_b FROM cs WHERE cos >= 0.8 AND a < b UNION ALL SELECT 'kmeanspp', a, b FROM ds WHERE d <= 0.02 AND a < b",
    "p7_topk": f"""{_PAIRS}, q AS (SELECT key FROM n WHERE ('0x' || substr(md5(key), 1, 8))::BIGINT % 20 = 0), full_cs AS (SELECT q.key AS a, n.key AS b, coalesce(cos, 0) AS s FROM q JOIN n ON n.key <> q.key LEFT JOIN cs ON cs.a = q.key AND cs.b = n.key),
every AS (SELECT 'lsh' AS src, a, b, s FROM full_cs UNION ALL SELECT 'kmeanspp', a, b, -d FROM ds WHERE try_cast(regexp_extract(a, '[0-9]+$') AS BIGINT) % 20 = 0)
SELECT src, a AS key, CAST(row_number() OVER (PARTITION BY src, a ORDER BY s DESC, b) AS INT) AS rank, b AS neighbour, round(s, 6) AS similarity FROM every QUALIFY rank <= 10""",
}

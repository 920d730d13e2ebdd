"""Column expressions over dense (ARRAY<DOUBLE>) and sparse (MAP<STRING, DOUBLE>) vectors; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two dense vectors, in double; positions missing in one count 0."""
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the quotient is NaN."""
    c = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(c)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - cosine(a, b)


def squared_euclid(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (F.coalesce(x, F.lit(0)).cast("double") - F.coalesce(y, F.lit(0)).cast("double")) * (F.coalesce(x, F.lit(0)).cast("double") - F.coalesce(y, F.lit(0)).cast("double"))))


def euclid(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_euclid(a, b))


def add(a: Column | str, b: Column | str) -> Column:
    """Sum of two vectors; the longer one's tail is kept."""
    return F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x, F.lit(0)).cast("double") + F.coalesce(y, F.lit(0)).cast("double"))


def scale(a: Column | str, factor: Column | float) -> Column:
    return F.transform(_col(a), lambda x: x.cast("double") * factor)


def bhattacharyya(a: Column | str, b: Column | str) -> Column:
    """Histogram distance sqrt(1 - sum sqrt(a b) / sqrt(sum a * sum b)); null where a histogram is empty."""
    shared = total(F.zip_with(_col(a), _col(b), lambda x, y: F.sqrt(F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))))
    mass = F.sqrt(total(F.transform(_col(a), lambda x: x.cast("double"))) * total(F.transform(_col(b), lambda x: x.cast("double"))))
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - F.try_divide(shared, mass)))


def intersection(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(F.least(x.cast("double"), y.cast("double")), F.lit(0.0))))


def combined_similarity(histogram_distance: Column, hog_cosine: Column) -> Column:
    """0.3 (1 - histogram distance) + 1.5 cosine of the gradient descriptors."""
    return F.lit(0.3) * (F.lit(1.0) - histogram_distance) + F.lit(1.5) * hog_cosine


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def argmin(distances: Sequence[Column]) -> Column:
    """Index of the smallest of a short list of distances; ties go to the lowest index."""
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances)]))["i"]


#: Centroid numbers up to which the nearest one is found by an expression of literals.
LITERALS = 2_048


def _nearest_by_matrix(centroids: Sequence[Sequence[float]], cosine: bool) -> Callable[[Column], Column]:
    c = np.asarray(centroids, dtype=np.float64)
    size = np.linalg.norm(c, axis=1)

    @F.pandas_udf("int")
    def run(vectors: pd.Series) -> pd.Series:
        known = vectors.notna().to_numpy()
        out = np.full(len(vectors), None, dtype=object)
        for at in np.array_split(np.flatnonzero(known), max(1, known.sum() // 1024)):
            x = np.zeros((len(at), c.shape[1]))
            for row, v in zip(x, vectors.iloc[at], strict=True):
                row[: len(v)] = [y or 0.0 for y in v[: c.shape[1]]]
            dots = x @ c.T
            if cosine:
                long = np.linalg.norm(x, axis=1)[:, None] * size
                d = 1 - np.divide(dots, long, out=np.zeros_like(dots), where=long > 0)
            else:
                d = (x * x).sum(1)[:, None] - 2 * dots + size * size
            out[at] = d.argmin(1)
        return pd.Series(out, dtype="Int32")

    return run


def nearest(vector: Column | str, centroids: Sequence[Sequence[float]], distance: Callable[[Column, Column], Column]) -> Column:
    """Index of the nearest of k centroids, ties to the lowest: no join; k is a parameter of the model.

    Up to LITERALS numbers the centroids are literals of one expression, which stays in the JVM; a larger codebook
    (by Euclid or cosine) goes to the tasks as one matrix.
    """
    v = _col(vector)
    if sum(map(len, centroids)) > LITERALS and distance in (squared_euclid, euclid, cosine_distance):
        return _nearest_by_matrix(centroids, distance is cosine_distance)(v)
    return argmin([distance(v, literal(c)) for c in centroids])


def sparse_dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + F.coalesce(e["value"] * F.element_at(b, e["key"]), F.lit(0.0)))


def sparse_norm(a: Column | str) -> Column:
    return norm(F.map_values(_col(a)))


def sparse_cosine(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(sparse_dot(a, b), sparse_norm(a) * sparse_norm(b)), F.lit(0.0))


def sparse_squared_euclid(a: Column | str, b: Column | str) -> Column:
    """Over the union of the keys, by |a|^2 + |b|^2 - 2 a.b."""
    return F.greatest(F.lit(0.0), F.pow(sparse_norm(a), 2) + F.pow(sparse_norm(b), 2) - 2 * sparse_dot(a, b))

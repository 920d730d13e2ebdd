"""Reading the vector tables of problems 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import NUMBER
from cairn.functions.text import strict_number as number
from cairn.sources.tables import table


def dense(df: DataFrame, key: str, vec: str, size: int | None = None) -> DataFrame:
    """(key, v ARRAY<DOUBLE>) of usable rows: non-null key, comma list of finite numbers, ``size`` of them if given.

    A key stated repeatedly counts once, with the smallest of its usable vectors.
    """
    fields = F.transform(F.split(F.col(vec), ","), number)
    rows = df.select(F.col(key).alias("key"), fields.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    if size is not None:
        rows = rows.where(F.size("v") == size)
    return rows.groupBy("key").agg(F.min("v").alias("v"))


def sparse(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, dims ARRAY<STRING>, v ARRAY<DOUBLE>) of usable rows: non-null key, TAB pairs ``dim value``, finite values.

    Zero values are left out, a repeated dimension adds up. A vector without a value other than 0 has no direction
    and is left out, too. A key stated repeatedly counts once, with the smallest of its usable lists.
    """
    f = F.split(F.col(vec), "\t")
    rows = df.select(F.col(key).alias("key"), f.alias("f")).where(F.col("key").isNotNull() & F.col("f").isNotNull() & (F.size("f") % 2 == 0))
    values = F.transform(F.filter("f", lambda x, i: i % 2 == 1), number)
    rows = rows.select("key", F.filter("f", lambda x, i: i % 2 == 0).alias("dims"), values.alias("v")).where(F.forall("v", lambda x: x.isNotNull()))
    rows = rows.groupBy("key").agg(F.min(F.struct("dims", "v")).alias("s")).select("key", "s.dims", "s.v")
    names = F.array_sort(F.array_distinct("dims"))
    total = lambda d: F.aggregate(F.zip_with("dims", "v", lambda a, b: F.when(a == d, b).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    pairs = F.filter(F.transform(names, lambda d: F.struct(d.alias("d"), total(d).alias("x"))), lambda p: p["x"] != 0)
    out = rows.select("key", pairs.alias("p")).where(F.size("p") > 0)
    return out.select("key", F.transform("p", lambda p: p["d"]).alias("dims"), F.transform("p", lambda p: p["x"]).alias("v"))


def kmeanspp_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(table(spark, sf_dir, "kmeanspp", "id", "vecstr"), "id", "vecstr", 16)


def lsh_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse(table(spark, sf_dir, "lsh", "word", "vec"), "word", "vec")


_N = NUMBER.removeprefix("^").removesuffix("$")
#: ``pts`` (key, v) and ``sv`` (key, dim, x): the same usable rows in DuckDB SQL.
POINTS_SQL = rf"""pts AS (SELECT key, min(v) AS v FROM (
  SELECT id AS key, list_transform(string_split(vecstr, ','), lambda x: CASE WHEN regexp_full_match(x, '{_N}') THEN try_cast(trim(x) AS DOUBLE) END) AS v FROM kmeanspp WHERE id IS NOT NULL AND vecstr IS NOT NULL)
  WHERE len(v) = 16 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY key)"""
SPARSE_SQL = rf"""lw AS (SELECT word AS key, min(vec) AS vec FROM lsh WHERE word IS NOT NULL AND vec IS NOT NULL AND len(string_split(vec, chr(9))) % 2 = 0
  AND len(list_filter(string_split(vec, chr(9)), lambda x, i: i % 2 = 0 AND NOT (regexp_full_match(x, '{_N}') AND isfinite(coalesce(try_cast(trim(x) AS DOUBLE), 'inf'::DOUBLE))))) = 0 GROUP BY word),
lf AS (SELECT key, string_split(vec, chr(9)) AS f FROM lw), le AS (SELECT key, f, unnest(range(1, len(f), 2)) AS i FROM lf),
sv AS (SELECT key, f[i] AS dim, sum(trim(f[i + 1])::DOUBLE) AS x FROM le GROUP BY ALL HAVING sum(trim(f[i + 1])::DOUBLE) <> 0)"""

"""Queries over ratings: customers rate brands by the average quantity they order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.seeded import uniform_sql
from cairn.operators import factorize as ops
from cairn.sources.readers import matrix_extent
from cairn.sources.tables import table

K, ETA, LAM = 3, 0.0002, 0.02


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.groupBy(F.col("o_custkey").alias("user"), F.col("p_brand").alias("item")).agg(F.round(F.avg("l_quantity"), 6).alias("rate"))


def _gd(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = _cells(spark, sf_dir)
    return cells, *ops.batch_gradient(cells, K, 2, ETA, LAM)


def rating_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


def matrix_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_extent(_cells(spark, sf_dir))


def global_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.global_mean(_cells(spark, sf_dir)).select(F.round("mean", 6).alias("mean"))


def fixed_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean plus user and item bias for every cell."""
    return ops.with_bias(_cells(spark, sf_dir)).select("user", "item", F.round("guess", 6).alias("guess"))


def item_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fixed_biases(_cells(spark, sf_dir))[1].select("item", F.round("item_bias", 6).alias("item_bias"))


def mf_gd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User factors after two batch gradient steps."""
    return _gd(spark, sf_dir)[1].select("user", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(K)])


def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, u, v = _gd(spark, sf_dir)
    return ops.predict(cells.select("user", "item"), u, v).select("user", "item", F.round("guess", 5).alias("guess"))


def rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rmse(ops.with_bias(_cells(spark, sf_dir))).select(F.round("rmse", 6).alias("rmse"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test fold of every cell."""
    return _cells(spark, sf_dir).select("user", "item", ops.fold_of(F.concat_ws("|", "user", "item"), 5).alias("fold"))


def cv_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE of each of five folds under fixed biases, and their mean as fold 0."""
    return ops.cross_validate(_cells(spark, sf_dir), 5, lambda train, test: ops.with_bias(test, train)).select("fold", F.round("rmse", 6).alias("rmse"))


def top_n_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best items of every user by predicted rate."""
    _, u, v = _gd(spark, sf_dir)
    return ops.top_items(u, v, 5).select("user", "item", F.col("rank").cast("bigint").alias("rank"), F.round("rate", 5).alias("rate"))


def user_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.user_clusters(_gd(spark, sf_dir)[1])


def cluster_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, u, _ = _gd(spark, sf_dir)
    return ops.cluster_popularity(cells, u)


def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 items of the own cluster for every user."""
    cells, u, v = _gd(spark, sf_dir)
    return ops.recommend(cells, u, v).withColumn("rank", F.col("rank").cast("bigint"))


def recommend_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the items a user has rated."""
    cells, u, v = _gd(spark, sf_dir)
    return ops.recommend(cells, u, v, exclude_seen=True).withColumn("rank", F.col("rank").cast("bigint"))


def movielens_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in ``user::item::rate::time`` form read back: of a repeated cell the last line counts."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(table(spark, sf_dir, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    text = lines.select(F.concat_ws("::", F.col("o_custkey"), F.col("l_partkey"), F.col("l_quantity").cast("int"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber").alias("line"))
    f = F.split("line", "::")
    rows = text.select(f[0].cast("bigint").alias("user"), f[1].cast("bigint").alias("item"), f[2].cast("int").alias("rate"), F.struct(f[3].alias("o"), f[4].cast("int").alias("l")).alias("at"))
    return rows.groupBy("user", "item").agg(F.max(F.struct("at", "rate")).alias("m")).select("user", "item", "m.rate")


def _sgd(model: str, blocks: int = 8):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = _cells(spark, sf_dir)
        u, v, mean = ops.stochastic_gradient(cells, K, 2, model, eta=0.0005, blocks=blocks)
        guessed = ops.predict(cells, u, v, None if model == "plain" else mean, cells if model == "svdpp" else None)
        return guessed.select("user", "item", F.round("guess", 6).alias("guess"))

    run.__doc__ = f"Predictions after two epochs of stochastic gradient descent ({model}, {blocks} block(s))."
    return run


#: Steps of the sequential descent on the nation table.
NATION_ETA, NATION_LAM, NATION_K, NATION_EPOCHS = 0.02, 0.05, 2, 3


def _nation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table small enough for one task: regions as users, nations modulo 7 as items, the mean length of names as rate."""
    n = table(spark, sf_dir, "nation", F.col("n_regionkey").cast("bigint").alias("user"), (F.col("n_nationkey") % 7).cast("bigint").alias("item"), F.length("n_name").alias("letters"))
    return n.groupBy("user", "item").agg(F.avg("letters").alias("rate"))


def _sgd_nations(model: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = _nation_cells(spark, sf_dir)
        u, v, mean = ops.stochastic_gradient(cells, NATION_K, NATION_EPOCHS, model, NATION_ETA, NATION_LAM, blocks=1)
        guessed = ops.predict(cells, u, v, None if model == "plain" else mean, cells if model == "svdpp" else None)
        return guessed.select("user", "item", F.round("guess", 6).alias("guess"))

    run.__doc__ = f"Predictions after {NATION_EPOCHS} epochs in sequential order on the nation table ({model})."
    return run


def _sgd_nations_sql(model: str) -> str:
    """The same steps as a recursion with one row of state: lists of factors by user and item, biases, implicit factors, mean."""
    k = range(NATION_K)

    def start(key: str, extra: str = "") -> str:
        return "[" + ", ".join(uniform_sql(f'"{key}"', f"1-{extra or key}{i}") for i in k) + "]"

    biased = model in ("bias", "svdpp")
    base = "0" if model == "plain" else "mean + bu[a] + bi[b]"
    imp = "list_transform(range(%d), lambda i: list_sum(list_transform(own, lambda j: y[j][i + 1])) / sqrt(len(own)))" % NATION_K if model == "svdpp" else f"[{', '.join('0.0' for _ in k)}]"
    put = lambda items, at, new: f"list_transform({items}, lambda x, i: CASE WHEN i = {at} THEN {new} ELSE x END)"
    plus = lambda p, q: f"list_transform(list_zip({p}, {q}), lambda z: z[1] + z[2])"
    ybar = "list_transform(y, lambda w, j: CASE WHEN list_contains(own, j) THEN list_transform(w, lambda z, i: z + step * (e / sqrt(len(own)) * v1[i] - %s / 2 * z)) ELSE w END)" % NATION_LAM if model == "svdpp" else "y"
    return f"""WITH RECURSIVE c AS (SELECT CAST(n_regionkey AS BIGINT) AS "user", CAST(n_nationkey % 7 AS BIGINT) AS item, avg(length(n_name)) AS rate FROM nation GROUP BY ALL),
{_biases("c", "f")},
o AS (SELECT CAST(row_number() OVER (ORDER BY "user", item) - 1 AS BIGINT) AS n, CAST("user" + 1 AS BIGINT) AS a, CAST(item + 1 AS BIGINT) AS b, rate, list(CAST(item + 1 AS BIGINT)) OVER (PARTITION BY "user") AS own FROM c),
total AS (SELECT count(*) AS total FROM c),
st AS (SELECT CAST(0 AS BIGINT) AS t, (SELECT list({start("user")} ORDER BY "user") FROM (SELECT unnest(range(5)) AS "user")) AS u, (SELECT list({start("item")} ORDER BY item) FROM (SELECT unnest(range(7)) AS item)) AS v,
  (SELECT list({start("item", "y")} ORDER BY item) FROM (SELECT unnest(range(7)) AS item)) AS y,
  {'(SELECT list(ub ORDER BY "user") FROM ubf)' if model == "fixed" else "list_transform(range(5), lambda i: 0.0::DOUBLE)"} AS bu, {'(SELECT list(ib ORDER BY item) FROM ibf)' if model == "fixed" else "list_transform(range(7), lambda i: 0.0::DOUBLE)"} AS bi,
  (SELECT mean FROM mf) AS mean
 UNION ALL
 SELECT t + 1, {put("u", "a", "u1")}, {put("v", "b", "v1")}, {ybar}, {put("bu", "a", f"x + step * (e - {NATION_LAM} * x)") if biased else "bu"}, {put("bi", "b", f"x + step * (e - {NATION_LAM} * x)") if biased else "bi"}, {"mean + step * e" if biased else "mean"}
 FROM (SELECT *, list_transform(v0, lambda x, i: x + step * (e * {plus("u1", "imp")}[i] - {NATION_LAM} * x)) AS v1
  FROM (SELECT *, list_transform(u0, lambda x, i: x + step * (e * v0[i] - {NATION_LAM} * x)) AS u1
   FROM (SELECT *, rate - ({base} + list_inner_product({plus("u0", "imp")}, v0)) AS e
    FROM (SELECT st.*, o.a, o.b, o.rate, o.own, {NATION_ETA}::DOUBLE / (1 + t / total::DOUBLE) AS step, u[a] AS u0, v[b] AS v0, {imp} AS imp
     FROM st CROSS JOIN total JOIN o ON o.n = t % total WHERE t < {NATION_EPOCHS} * total)))))
SELECT c."user", c.item, round({base} + list_inner_product({plus("u[a]", imp)}, v[b]), 6) AS guess
FROM (SELECT * FROM st ORDER BY t DESC LIMIT 1) CROSS JOIN o JOIN c ON c."user" + 1 = o.a AND c.item + 1 = o.b"""


QUERIES = {f.__name__: f for f in (rating_matrix, matrix_size, global_mean, fixed_bias, item_bias, mf_gd, predict, rmse, folds, cv_rmse, top_n_rate, user_cluster, cluster_popularity, recommend, recommend_new, movielens_normalise)}
QUERIES |= {"mf_sgd": _sgd("plain"), "mf_sgd_fixed_bias": _sgd("fixed"), "mf_sgd_bias": _sgd("bias"), "mf_sgd_bias_blocks": _sgd("bias", 4), "svdpp": _sgd("svdpp")}
QUERIES |= {f"sgd_nations_{model}": _sgd_nations(model) for model in ops.MODELS}

_CELLS = "c AS (SELECT o_custkey AS \"user\", p_brand AS item, round(avg(l_quantity), 6) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _biases(of: str, tag: str = "", extra: str = "", keep: str = "TRUE") -> str:
    sel, grp, on = (f"{extra}, ", f"{extra}, ", f" AND a.{extra} = b.{extra}") if extra else ("", "", "")
    return f"""m{tag} AS (SELECT {sel}avg(rate) AS mean FROM {of} {"GROUP BY " + extra if extra else ""}),
ub{tag} AS (SELECT {"b." + extra + ", " if extra else ""}"user", avg(rate - mean) AS ub FROM {of} a JOIN m{tag} b ON TRUE{on} GROUP BY ALL),
ib{tag} AS (SELECT {"a." + extra + ", " if extra else ""}item, avg(rate - mean - ub) AS ib FROM {of} a JOIN m{tag} b ON TRUE{on} JOIN ub{tag} u ON a."user" = u."user"{f" AND u.{extra} = a.{extra}" if extra else ""} GROUP BY ALL)"""


def _gd_sql() -> str:
    k = range(K)
    parts = [_CELLS]
    for side, key in (("u", '"user"'), ("v", "item")):
        name = key.strip('"')
        parts.append(f"{side}0 AS (SELECT {key}, {', '.join(f'{uniform_sql(key, f"1-{name}{i}")} AS f{i}' for i in k)} FROM (SELECT DISTINCT {key} FROM c))")
    for s in (1, 2):
        guess = " + ".join(f"u.f{i} * v.f{i}" for i in k)
        parts.append(f"e{s} AS (SELECT c.\"user\", c.item, rate - ({guess}) AS e, {', '.join(f'u.f{i} AS uf{i}, v.f{i} AS vf{i}' for i in k)} FROM c JOIN u{s - 1} u ON c.\"user\" = u.\"user\" JOIN v{s - 1} v ON c.item = v.item)")
        for side, key, own, other in (("u", '"user"', "uf", "vf"), ("v", "item", "vf", "uf")):
            parts.append(f"{side}{s} AS (SELECT {key}, {', '.join(f'any_value({own}{i}) + {ETA}::DOUBLE * (sum(e * {other}{i}) - {LAM}::DOUBLE * any_value({own}{i})) AS f{i}' for i in k)} FROM e{s} GROUP BY {key})")
    parts.append(f"uc AS (SELECT \"user\", CASE WHEN greatest(f0, f1, f2) <= -1 OR f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS cluster FROM u2)")
    parts.append("pop AS (SELECT cluster, item, count(*) AS n FROM c JOIN uc USING (\"user\") GROUP BY ALL)")
    parts.append(f"pr AS (SELECT u.\"user\", v.item, {' + '.join(f'u.f{i} * v.f{i}' for i in k)} AS guess FROM u2 u CROSS JOIN v2 v)")
    return "WITH " + ",\n".join(parts)


_GD = _gd_sql()
_FOLD = "CAST(('0x' || substr(md5(\"user\" || '|' || item || ':fold1'), 1, 8))::BIGINT % 5 + 1 AS INT)"
_AWAY = "CASE WHEN g >= 0 THEN floor(g + 0.5) ELSE ceil(g - 0.5) END"
_RECOMMEND = 'SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY round(guess, 9) DESC, item DESC) AS rank FROM uc JOIN pop USING (cluster) JOIN pr USING ("user", item) {skip} QUALIFY rank <= 30'

ORACLES = {
    "rating_matrix": f"WITH {_CELLS} SELECT * FROM c",
    "matrix_size": f'WITH {_CELLS} SELECT max("user") AS max_user, max(item) AS max_item FROM c',
    "global_mean": f"WITH {_CELLS} SELECT round(avg(rate), 6) AS mean FROM c",
    "fixed_bias": f'WITH {_CELLS}, {_biases("c")} SELECT c."user", c.item, round(mean + ub + ib, 6) AS guess FROM c JOIN ub ON c."user" = ub."user" JOIN ib ON c.item = ib.item CROSS JOIN m',
    "item_bias": f"WITH {_CELLS}, {_biases('c')} SELECT item, round(ib, 6) AS item_bias FROM ib",
    "mf_gd": f"{_GD} SELECT \"user\", {', '.join(f'round(f{i}, 6) AS f{i}' for i in range(K))} FROM u2",
    "predict": f'{_GD} SELECT "user", item, round(guess, 5) AS guess FROM pr JOIN c USING ("user", item)',
    "rmse": f'WITH {_CELLS}, {_biases("c")}, p AS (SELECT rate, mean + ub + ib AS g FROM c JOIN ub ON c."user" = ub."user" JOIN ib ON c.item = ib.item CROSS JOIN m) SELECT round(sqrt(avg(({_AWAY} - rate) ** 2)), 6) AS rmse FROM p',
    "folds": f'WITH {_CELLS} SELECT "user", item, {_FOLD} AS fold FROM c',
    "cv_rmse": f"""WITH {_CELLS}, f AS (SELECT *, {_FOLD} AS fold FROM c), k AS (SELECT unnest(range(1, 6))::INT AS k), t AS (SELECT k, "user", item, rate FROM f JOIN k ON fold <> k), {_biases("t", "", "k")},
p AS (SELECT f.fold, rate, mean + ub + ib AS g FROM f JOIN m ON m.k = fold LEFT JOIN ub ON ub.k = fold AND ub."user" = f."user" LEFT JOIN ib ON ib.k = fold AND ib.item = f.item),
r AS (SELECT fold, sqrt(coalesce(sum(({_AWAY} - rate) ** 2), 0) / count(*)) AS rmse FROM p GROUP BY fold)
SELECT fold, round(rmse, 6) AS rmse FROM r UNION ALL SELECT 0, round(avg(rmse), 6) FROM r""",
    "top_n_rate": f'{_GD} SELECT "user", item, row_number() OVER (PARTITION BY "user" ORDER BY guess DESC, item) AS rank, round(guess, 5) AS rate FROM pr QUALIFY rank <= 5',
    "user_cluster": f'{_GD} SELECT "user", cluster FROM uc',
    "cluster_popularity": f"{_GD} SELECT cluster, item, n FROM pop",
    "recommend": f"{_GD} {_RECOMMEND.format(skip='')}",
    "recommend_new": f"{_GD} {_RECOMMEND.format(skip='ANTI JOIN c USING ("user", item)')}",
    "movielens_normalise": 'SELECT o_custkey AS "user", l_partkey AS item, CAST(arg_max(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS INT) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL',
}
ORACLES |= {f"sgd_nations_{model}": _sgd_nations_sql(model) for model in ops.MODELS}

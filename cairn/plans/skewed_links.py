"""Problem 5: sums, counts and scores per link target when few targets receive much of all links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.skew import range_stitched_aggregate
from cairn.sources.tables import table

#: A target is heavy from this share of all stored rows of its table on.
HEAVY_SHARE = 0.01


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both link tables as (src, linkid, id, cnt, score)."""
    sides = [
        table(spark, sf_dir, name, "linkid", "id", "cnt", score).select(F.lit(name).alias("src"), "linkid", "id", F.col("cnt").cast("long").alias("cnt"), F.col(score).alias("score"))
        for name, score in (("pagerank", "prevval"), ("hits", "hubval"))
    ]
    return sides[0].unionByName(sides[1])


def per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, linkid, n_rows, n_sources, n_links, score, top_score) of every target, unrounded; null linkid is a target of its own."""
    return range_stitched_aggregate(
        links(spark, sf_dir), ["src", "linkid"], "id", sums={"n_links": F.col("cnt"), "score": F.col("score")}, maxima={"top_score": F.col("score")}, distinct="n_sources"
    )


def p5_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count, source count, link sum and scores of every resolved target."""
    return per_target(spark, sf_dir).where("linkid > 0").withColumn("score", F.round("score", 7))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with at least 1 % of all stored rows of their table (null and 0 targets count in the total)."""
    rows = links(spark, sf_dir)
    totals = rows.groupBy("src").agg(F.count(F.lit(1)).alias("total"))  # reads no column, so the links are shuffled once
    states = range_stitched_aggregate(rows.select("src", "linkid", "id"), ["src", "linkid"], "id")
    return states.join(F.broadcast(totals), "src").where((F.col("linkid") > 0) & (F.col("n_rows") >= HEAVY_SHARE * F.col("total"))).select("src", "linkid")


QUERIES = {"p5_found": p5_found, "p5_targets": p5_targets}

_LINKS = """SELECT 'pagerank' AS src, linkid, id, cnt, prevval AS score FROM pagerank
UNION ALL SELECT 'hits' AS src, linkid, id, cnt, hubval AS score FROM hits"""

ORACLES = {
    "p5_found": f"""WITH l AS ({_LINKS}), t AS (SELECT src, count(*) AS total FROM l GROUP BY src)
SELECT src, linkid FROM l JOIN t USING (src) WHERE linkid > 0 GROUP BY src, linkid, total HAVING count(*) >= 0.01 * total""",
    "p5_targets": f"""WITH l AS ({_LINKS})
SELECT src, linkid, count(*) AS n_rows, count(DISTINCT id) AS n_sources, CAST(sum(cnt) AS BIGINT) AS n_links,
round(sum(score), 7) AS score, max(score) AS top_score FROM l WHERE linkid > 0 GROUP BY src, linkid""",
}

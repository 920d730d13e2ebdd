"""Link extraction and link analysis on edge tables (src, dst, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import page_keyword
from cairn.runtime import cut


def page_links(pages: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, keyword, n): admissible link targets ``[[...]]`` of each page and how often it links to them, self-links left out."""
    links = pages.select(key, F.col(title).alias("own"), F.explode(F.regexp_extract_all(text, F.lit(r"\[\[(.+?)\]\]"), F.lit(1))).alias("target"))
    links = links.select(key, "own", page_keyword("target").alias("keyword")).where("keyword IS NOT NULL AND (own IS NULL OR keyword <> own)")
    return links.groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("n"))


def keyword_dictionary(pages: DataFrame, key: str, title: str) -> DataFrame:
    """(keyword, id): admissible titles; of several pages with one keyword the greatest id wins."""
    return pages.select(page_keyword(title).alias("keyword"), F.col(key).alias("id")).where("keyword IS NOT NULL").groupBy("keyword").agg(F.max("id").alias("id"))


def link_graph(pages: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(src, dst, n): page links whose keyword is in the dictionary of the same pages."""
    found = page_links(pages, key, title, text).withColumnRenamed(key, "src").join(keyword_dictionary(pages, key, title).withColumnRenamed("id", "dst"), "keyword")
    return found.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def out_degree(edges: DataFrame) -> DataFrame:
    """(src, degree) of an edge table without repeated edges."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def pagerank(edges: DataFrame, iterations: int = 2, damping: float = 0.85, teleport: bool = False, init: str = "sqrt", weighted: bool = False) -> DataFrame:
    """(id, score) of a (src, dst, n) table without repeated edges.

    Sources start at 1 / sqrt(N) (``init="sqrt"``) or 1 / N; each step a node gets damping * score / out-degree from
    every page linking to it. By default there is no teleport: dangling mass leaves, and nodes without in-links drop
    out. With ``teleport`` every source gets (1 - damping) / N besides and none drops out. ``weighted`` divides by
    link counts instead of distinct targets. Lineage is cut every step, so the plan doesn't grow.
    """
    given_out = edges.groupBy("src").agg((F.sum("n") if weighted else F.count(F.lit(1))).alias("out"))
    steps = edges.join(given_out, "src").select("src", "dst", (F.lit(damping) * ((F.col("n") if weighted else F.lit(1.0)) / F.col("out"))).alias("share"))
    if iterations > 1:
        steps = cut(steps)
    sources = edges.select(F.col("src").alias("id")).distinct()
    count = sources.agg(F.count(F.lit(1)).alias("n_nodes"))
    first = F.lit(1.0) / (F.sqrt("n_nodes") if init == "sqrt" else F.col("n_nodes"))
    score = sources.crossJoin(F.broadcast(count)).select("id", first.alias("score"))
    base = sources.crossJoin(F.broadcast(count)).select("id", ((1 - damping) / F.col("n_nodes")).alias("score")) if teleport else None
    for k in range(iterations):
        given = steps.join(score.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("score"))
        if base is not None:
            given = given.unionByName(base)
        score = given.groupBy("id").agg(F.sum("score").alias("score"))
        if 0 < k < iterations - 1:
            score = cut(score)
    return score


def unit(scores: DataFrame) -> DataFrame:
    """(id, score) scaled to Euclidean length 1; a zero vector stays zero."""
    length = scores.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("length"))
    return scores.crossJoin(F.broadcast(length)).select("id", F.coalesce(F.try_divide(F.col("score"), F.col("length")), F.lit(0.0)).alias("score"))


def hits(edges: DataFrame, iterations: int = 2) -> tuple[DataFrame, DataFrame]:
    """(authorities, hubs), each (id, score), of a (src, dst) table without repeated edges.

    Sources start with hub score 1 / sqrt(N); each step sums hubs into authorities, scales them to length 1, sums
    the new authorities into hubs and scales them.
    """
    edges = cut(edges.select("src", "dst")) if iterations > 1 else edges.select("src", "dst")
    sources = edges.select(F.col("src").alias("id")).distinct()
    hubs = sources.crossJoin(F.broadcast(sources.agg((F.lit(1.0) / F.sqrt(F.count(F.lit(1)))).alias("score"))))
    authorities = hubs
    for k in range(iterations):
        authorities = unit(edges.join(hubs.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("score").alias("score")))
        if k < iterations - 1:
            authorities = cut(authorities)
        hubs = unit(edges.join(authorities.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("score").alias("score")))
    return authorities, hubs

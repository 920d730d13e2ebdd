"""Queries over pages and links: extraction, dictionary, graph, PageRank, HITS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import page_keyword
from cairn.operators import graph as ops
from cairn.sources.tables import table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its latest content."""
    t = table(spark, sf_dir, "wikipedia_link", "id", "title", "content", "edited_at")
    return t.groupBy("id").agg(F.max(F.struct("edited_at", "title", "content")).alias("p")).select("id", "p.title", "p.content")


def _edges(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(src, dst, n): resolved links of a link table, exact duplicates and repeated edges taken together."""
    t = table(spark, sf_dir, name, "id", "linkid", "cnt").where("id IS NOT NULL AND linkid > 0")
    return t.groupBy(F.col("id").alias("src"), F.col("linkid").alias("dst")).agg(F.max(F.coalesce("cnt", F.lit(1))).cast("bigint").alias("n"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible link targets of every page with their counts."""
    return ops.page_links(_pages(spark, sf_dir), "id", "title", "content")


def keyword_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword of every distinct title, null where it isn't admissible."""
    return table(spark, sf_dir, "wikipedia_link", "title").distinct().select("title", page_keyword("title").alias("keyword"))


def keyword_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_dictionary(_pages(spark, sf_dir), "id", "title")


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.link_graph(_pages(spark, sf_dir), "id", "title", "content")


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.out_degree(_edges(spark, sf_dir, "pagerank"))


def _scored(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select("id", F.round("score", digits).alias("score"))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two damped steps without teleport."""
    return _scored(ops.pagerank(_edges(spark, sf_dir, "pagerank")))


def pagerank_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from 1/N with teleport, divided by link counts."""
    return _scored(ops.pagerank(_edges(spark, sf_dir, "pagerank"), 3, teleport=True, init="uniform", weighted=True), 10)


def hits_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(ops.hits(_edges(spark, sf_dir, "hits"))[0])


def hits_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(ops.hits(_edges(spark, sf_dir, "hits"))[1])


QUERIES = {f.__name__: f for f in (link_extract, keyword_ok, keyword_dict, link_graph, out_degree, pagerank, pagerank_teleport, hits_auth, hits_hub)}


def _keyword(t: str) -> str:
    cut = rf"regexp_replace({t}, '\s*\(.+?\)$', '')"
    bad = rf"{t} IS NULL OR {t} IN ('', '0') OR regexp_matches({t}, '[:|\n\t\[\]]') OR regexp_matches({t}, '^[#\s]') OR {cut} = '' OR {cut} LIKE '%一覧' OR regexp_full_match({cut}, '\d\d\d\d年')"
    return f"CASE WHEN NOT ({bad}) THEN {cut} END"


_PAGES = "pages AS (SELECT id, title, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edited_at DESC NULLS LAST, title DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM wikipedia_link) WHERE rn = 1)"
_LINKS = rf"""raw AS (SELECT id, title, unnest(regexp_extract_all(content, '\[\[(.+?)\]\]', 1)) AS target FROM pages),
kw AS (SELECT id, title, {_keyword("target")} AS keyword FROM raw),
links AS (SELECT id, keyword, count(*) AS n FROM kw WHERE keyword IS NOT NULL AND (title IS NULL OR keyword <> title) GROUP BY ALL)"""
_DICT = f"dict AS (SELECT keyword, max(id) AS id FROM (SELECT {_keyword('title')} AS keyword, id FROM pages) WHERE keyword IS NOT NULL GROUP BY keyword)"


def _edges_sql(name: str) -> str:
    return f"e AS (SELECT id AS src, linkid AS dst, CAST(max(coalesce(cnt, 1)) AS BIGINT) AS n FROM {name} WHERE id IS NOT NULL AND linkid > 0 GROUP BY ALL), nn AS (SELECT count(DISTINCT src)::DOUBLE AS c FROM e)"


_SHARE = "s AS (SELECT src, dst, 0.85 / count(*) OVER (PARTITION BY src) AS share FROM e)"
_PR = f"""WITH {_edges_sql("pagerank")}, {_SHARE},
r0 AS (SELECT DISTINCT src AS id, 1 / sqrt(c) AS score FROM e CROSS JOIN nn),
r1 AS (SELECT dst AS id, sum(score * share) AS score FROM s JOIN r0 ON src = id GROUP BY dst),
r2 AS (SELECT dst AS id, sum(score * share) AS score FROM s JOIN r1 ON src = id GROUP BY dst)
SELECT id, round(score, 8) AS score FROM r2"""


def _tele(k: int) -> str:
    return f"r{k} AS (SELECT id, sum(score) AS score FROM (SELECT dst AS id, score * share AS score FROM s JOIN r{k - 1} ON src = id UNION ALL SELECT id, score FROM b) GROUP BY id)"


_PRT = f"""WITH {_edges_sql("pagerank")}, s AS (SELECT src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY src) AS share FROM e),
r0 AS (SELECT DISTINCT src AS id, 1 / c AS score FROM e CROSS JOIN nn), b AS (SELECT id, 0.15::DOUBLE * score AS score FROM r0), {_tele(1)}, {_tele(2)}, {_tele(3)}
SELECT id, round(score, 10) AS score FROM r3"""


def _unit(name: str, of: str) -> str:
    return f"{name} AS (SELECT id, score / (SELECT sqrt(sum(score * score)) FROM {of}) AS score FROM {of})"


_HITS = f"""WITH {_edges_sql("hits")}, h0 AS (SELECT DISTINCT src AS id, 1 / sqrt(c) AS score FROM e CROSS JOIN nn),
x1 AS (SELECT dst AS id, sum(score) AS score FROM e JOIN h0 ON src = id GROUP BY dst), {_unit("a1", "x1")},
y1 AS (SELECT src AS id, sum(score) AS score FROM e JOIN a1 ON dst = id GROUP BY src), {_unit("h1", "y1")},
x2 AS (SELECT dst AS id, sum(score) AS score FROM e JOIN h1 ON src = id GROUP BY dst), {_unit("a2", "x2")},
y2 AS (SELECT src AS id, sum(score) AS score FROM e JOIN a2 ON dst = id GROUP BY src), {_unit("h2", "y2")}"""

ORACLES = {
    "link_extract": f"WITH {_PAGES}, {_LINKS} SELECT id, keyword, n FROM links",
    "keyword_ok": f"SELECT title, {_keyword('title')} AS keyword FROM (SELECT DISTINCT title FROM wikipedia_link)",
    "keyword_dict": f"WITH {_PAGES}, {_DICT} SELECT keyword, id FROM dict",
    "link_graph": f"WITH {_PAGES}, {_LINKS}, {_DICT} SELECT links.id AS src, dict.id AS dst, CAST(sum(n) AS BIGINT) AS n FROM links JOIN dict USING (keyword) GROUP BY ALL",
    "out_degree": f"WITH {_edges_sql('pagerank')} SELECT src, count(*) AS degree FROM e GROUP BY src",
    "pagerank": _PR,
    "pagerank_teleport": _PRT,
    "hits_auth": f"{_HITS} SELECT id, round(score, 8) AS score FROM a2",
    "hits_hub": f"{_HITS} SELECT id, round(score, 8) AS score FROM h2",
}

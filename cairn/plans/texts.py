"""Queries over texts: term statistics, sentences, integer coding of posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import codec
from cairn.functions.text import sentences
from cairn.operators import text as ops
from cairn.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequency of every document and word."""
    return ops.term_frequency(_docs(spark, sf_dir), "doc_id", "text")


def df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every word."""
    return ops.document_frequency(tf(spark, sf_dir))


def corpus_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.corpus_size(tf(spark, sf_dir), "doc_id")


def tfidf_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 words of each document with the highest TF-IDF."""
    return ops.tfidf(tf(spark, sf_dir), "doc_id")


def idf_reweight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain IDF weights of every document and word."""
    return ops.idf_reweight(tf(spark, sf_dir), "doc_id")


def idf_reweight_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.idf_reweight(tf(spark, sf_dir), "doc_id", 20)


def noun_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequency of the words a predicate keeps; here capitalised words, as German spells its nouns."""
    capital = lambda text: F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return ops.term_frequency(_docs(spark, sf_dir), "doc_id", "text", capital, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$"))


def tf_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document in one list, by tf descending, then word."""
    entry = F.struct((-F.col("tf")).alias("k"), F.col("word").alias("w"))
    listed = tf(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return listed.select("doc_id", F.array_join(F.transform("e", lambda e: e["w"]), " ").alias("words"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty sentences ended by the ideographic full stop, with their position."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(sentences("text")).alias("pos", "sentence")).where("sentence <> ''").withColumn("pos", F.col("pos").cast("bigint"))


def article_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a non-empty title and body."""
    t = table(spark, sf_dir, "count_word", "rec_no", "title", "body")
    return t.where("length(title) > 0 AND length(body) > 0").select("rec_no", F.length("body").cast("bigint").alias("n"))


#: Document ids that one block of a posting list spans, so that no list outgrows a row however common its word.
POSTING_BLOCK = 65_536


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, block, ids): sorted posting lists, cut into blocks of the id range."""
    block = F.expr(f"doc_id div {POSTING_BLOCK}").alias("block")
    return tf(spark, sf_dir).groupBy("word", block).agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


def gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each word's sorted posting list."""
    return _postings(spark, sf_dir).select("word", "block", F.array_join(codec.gaps("ids"), ",").alias("gaps"))


def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists rebuilt from their gaps."""
    return _postings(spark, sf_dir).select("word", "block", F.array_join(codec.prefix_sums(codec.gaps("ids")), ",").alias("ids"))


def vbyte_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex of each gap-coded posting list."""
    return _postings(spark, sf_dir).select("word", "block", F.hex(codec.compress("ids")).alias("code"))


def vbyte_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists decoded from their compressed form."""
    packed = _postings(spark, sf_dir).select("word", "block", codec.compress("ids").alias("data"))
    return packed.select("word", "block", F.array_join(codec.decompress("data"), ",").alias("ids"))


def postings_compressed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings, plain bytes and compressed bytes of the whole index."""
    sized = _postings(spark, sf_dir).select(F.size("ids").cast("bigint").alias("n"), F.length(codec.compress("ids")).cast("bigint").alias("bytes"))
    return sized.agg(F.sum("n").alias("n_postings"), F.sum(F.col("n") * 8).alias("plain_bytes"), F.sum("bytes").alias("packed_bytes"))


def random_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 distinct random integers below 1000 in order, seeded."""
    from cairn.sources.readers import random_integers

    return random_integers(spark, 100, 1000, 7)


QUERIES = {f.__name__: f for f in (tf, df, corpus_size, tfidf_top50, idf_reweight, idf_reweight_top20, noun_filter, tf_ordered, sentence_split, article_guard, gap, prefix_sum, vbyte_encode, vbyte_decode, postings_compressed_size, random_sorted)}

_TF = r"tf AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL)"
_DF = "df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf)"
_POST = f"p AS (SELECT word, doc_id // {POSTING_BLOCK} AS block, list(doc_id ORDER BY doc_id) AS ids FROM tf GROUP BY ALL), g AS (SELECT word, block, ids, list_transform(ids, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - ids[i - 1] END) AS gaps FROM p)"
_NUM = "CASE WHEN {n} >= 2097152 THEN printf('%02X', (({n} >> 21) & 127)) ELSE '' END || CASE WHEN {n} >= 16384 THEN printf('%02X', (({n} >> 14) & 127)) ELSE '' END || CASE WHEN {n} >= 128 THEN printf('%02X', (({n} >> 7) & 127)) ELSE '' END || printf('%02X', (({n} & 127) | 128))"
_HEX = f"h AS (SELECT word, block, ids, {_NUM.format(n='len(gaps)')} || list_aggregate(list_transform(gaps, lambda n: {_NUM.format(n='n')}), 'string_agg', '') AS code FROM g)"


def _weighted(weight: str, value: str, top: str) -> str:
    return f"""WITH {_TF}, {_DF}, w AS (SELECT doc_id, word, {weight} AS weight FROM tf JOIN df USING (word) CROSS JOIN n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS rank FROM w)
SELECT doc_id, word, {value} FROM r {top}"""


ORACLES = {
    "tf": f"WITH {_TF} SELECT doc_id, word, tf FROM tf",
    "df": f"WITH {_TF}, {_DF} SELECT word, df FROM df",
    "corpus_size": f"WITH {_TF}, {_DF} SELECT n FROM n",
    "tfidf_top50": _weighted("tf * ln(n::DOUBLE / (df + 1))", "CAST(trunc(weight * 100) AS BIGINT) AS score", "WHERE rank <= 50"),
    "idf_reweight": _weighted("tf * ln(n::DOUBLE / df)", "round(weight, 4) AS weight", ""),
    "idf_reweight_top20": _weighted("tf * ln(n::DOUBLE / df)", "round(weight, 4) AS weight", "WHERE rank <= 20"),
    "noun_filter": r"SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents) WHERE regexp_full_match(word, '\p{Lu}\p{Ll}+') GROUP BY ALL",
    "tf_ordered": f"WITH {_TF} SELECT doc_id, string_agg(word, ' ' ORDER BY tf DESC, word) AS words FROM tf GROUP BY doc_id",
    "sentence_split": "SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest(string_split(text, '。')) AS sentence, unnest(range(len(string_split(text, '。')))) AS pos FROM documents) WHERE sentence <> ''",
    "article_guard": "SELECT rec_no, length(body) AS n FROM count_word WHERE length(title) > 0 AND length(body) > 0",
    "gap": f"WITH {_TF}, {_POST} SELECT word, block, array_to_string(gaps, ',') AS gaps FROM g",
    "prefix_sum": f"WITH {_TF}, {_POST} SELECT word, block, array_to_string(ids, ',') AS ids FROM g",
    "vbyte_encode": f"WITH {_TF}, {_POST}, {_HEX} SELECT word, block, code FROM h",
    "vbyte_decode": f"WITH {_TF}, {_POST} SELECT word, block, array_to_string(ids, ',') AS ids FROM g",
    "postings_compressed_size": f"WITH {_TF}, {_POST}, {_HEX} SELECT CAST(sum(len(ids)) AS BIGINT) AS n_postings, CAST(sum(len(ids) * 8) AS BIGINT) AS plain_bytes, CAST(sum(length(code) // 2) AS BIGINT) AS packed_bytes FROM h",
    "random_sorted": "SELECT id AS n FROM range(1000) t(id) ORDER BY md5(id || ':7'), id LIMIT 100",
}

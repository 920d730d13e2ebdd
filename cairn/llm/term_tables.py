"""Problems 2, 3 and 4: term weights, top terms per title, and term frequencies with bounds.

All three are pure DataFrame plans: partial aggregation before every shuffle, no Python in the row path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from cairn.runtime import cut
from cairn.sources.tables import table

#: A word counts as heavy in the weight join from this share of all rows on; at most 1 / HEAVY_SHARE words can be.
HEAVY_SHARE = 0.001
#: Rows of a heavy word that one part holds in that join.
PART_ROWS = 200_000


def latest(df: DataFrame, keys: Sequence[str], when: str, values: Sequence[str]) -> DataFrame:
    """One row per ``keys``: that with the greatest ``when``; of equal times the greatest ``values`` in turn.

    A mergeable ``max_by``: one candidate per key and task is shuffled, never a whole group. A null ``when``
    is earlier than any time; null values are smaller than any value.
    """
    best = F.max(F.struct(F.col(when), *[F.col(v) for v in values])).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{v}").alias(v) for v in values])


# ---------------------------------------------------------------- problem 2


def log_entropy(tf: DataFrame, record: str = "title", term: str = "word", freq: str = "tf") -> DataFrame:
    """Log-entropy weight of every (record, term): ``ln(1 + tf) * (1 - H(term) / ln N)``.

    H is the entropy of the term's spread over records, N the number of records. With g = sum tf over records,
    H = ln g - (sum tf ln tf) / g, so one mergeable aggregation per term gives df, g and H; the second is N.
    A term in a single record has entropy 0 and global weight 1; a term spread evenly over all records weighs 0.

    Input: one row per (record, term), ``freq`` >= 1. Returns record, term, freq, df, entropy, weight.
    Defined cases: with N <= 1 the global weight is 1; an empty input gives no rows; extra columns are dropped.
    The join of the weights back to the rows splits every heavy term (more than HEAVY_SHARE of all rows; there
    are at most 1 / HEAVY_SHARE such terms, which bounds the broadcast) into one part per PART_ROWS rows.
    The rows are written once and read for the statistics and for the join, so the input is read and shuffled once.
    """
    rows = cut(tf.select(F.col(record).alias("record"), F.col(term).alias("term"), F.col(freq).alias("freq"))).withColumn("f", F.col("freq").cast("double"))
    per_term = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("f").alias("g"), F.sum(F.col("f") * F.log("f")).alias("s"))
    # titles and rows of the whole table in one row
    size = rows.groupBy("record").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"))
    stats = cut(per_term).crossJoin(F.broadcast(size)).select(
        "term",
        "df",
        F.greatest(F.lit(0.0), F.log("g") - F.col("s") / F.col("g")).alias("entropy"),
        F.when(F.col("n") > 1, F.log(F.col("n").cast("double"))).alias("top"),
        (F.col("df") > F.greatest(F.lit(100.0), HEAVY_SHARE * F.col("n_rows"))).alias("heavy"),
    )
    parts = F.ceil(F.col("df") / PART_ROWS).cast("int")
    heavy = stats.where("heavy").select("term", parts.alias("parts"))
    spread = F.when(F.col("heavy"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    stats = stats.withColumn("part", F.explode(spread))
    rows = rows.join(F.broadcast(heavy), "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("record"), F.col("parts")).cast("int"), F.lit(0)))
    weighted = rows.join(stats.drop("heavy"), ["term", "part"])
    weight = F.log1p("f") * F.coalesce(1 - F.col("entropy") / F.col("top"), F.lit(1.0))
    return weighted.select(F.col("record").alias(record), F.col("term").alias(term), F.col("freq").alias(freq), "df", "entropy", weight.alias("weight"))


def usable_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tfidf rows that count, the latest of each (title, word): title, word, tf, score."""
    t = table(spark, sf_dir, "tfidf", "title", "word", "tf", "score", "counted_at")
    blank = ~F.col("word").rlike(r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]")
    t = t.where(F.col("title").isNotNull() & F.col("word").isNotNull() & ~blank & (F.col("tf") >= 1) & F.col("score").isNotNull())
    return latest(t, ["title", "word"], "counted_at", ["tf", "score"])


def p2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-entropy weight of every title and word of tfidf."""
    return log_entropy(usable_terms(spark, sf_dir)).select("title", "word", "tf", "df", F.round("weight", 6).alias("weight"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with tf >= 4 for the title that 2 to 5 titles of the whole table have."""
    return log_entropy(usable_terms(spark, sf_dir)).where("tf >= 4 AND df BETWEEN 2 AND 5").select("title", "word")


# ---------------------------------------------------------------- problem 3


def bounded_heap(value: Column, n: int) -> Column:
    """Aggregate: the ``n`` smallest values of a group in a bounded heap, built before the shuffle and merged after it.

    Spark's own JVM heap aggregate (the one its recommender's top-k uses), reached as a built-in internal function.
    """
    return InternalFunction._invoke_internal_function_over_columns("collect_top_k", value, F.lit(n), F.lit(True))


def top_n(df: DataFrame, group: str, descending: Sequence[str], unique: str, n: int) -> DataFrame:
    """The first ``n`` rows of each ``group`` by ``descending`` (integers, larger first), then ``unique`` ascending.

    A bounded heap of n entries per group and task is built before the shuffle; only heaps are shuffled and
    merged, so a group of any size costs n entries per task. Strings compare by code point. Returns group,
    the compared columns and ``rank`` (1-based).

    Defined cases: null scores rank last; a null group is a group of its own; repeated (score, unique) rows
    take a place each; fewer than n rows are all kept; an empty input gives no rows; extra columns are dropped.
    """
    # bitwise complement reverses the order of integers without overflow; null sorts first in Spark, so flag it
    parts = []
    for i, c in enumerate(descending):
        parts += [F.col(c).isNull().alias(f"z{i}"), F.bitwise_not(F.col(c).cast("long")).alias(f"v{i}")]
    entry = F.struct(*parts, F.col(unique).alias("u"))
    heaps = df.groupBy(group).agg(bounded_heap(entry, n).alias("heap"))
    flat = heaps.select(group, F.posexplode(F.array_sort("heap")).alias("pos", "e"))
    return flat.select(group, F.col("e.u").alias(unique), *[F.bitwise_not(F.col(f"e.v{i}")).alias(c) for i, c in enumerate(descending)], (F.col("pos") + 1).alias("rank"))


def p3_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 words of each title with score, tf and rank."""
    return top_n(usable_terms(spark, sf_dir), "title", ["score", "tf"], "word", 10).select("title", "word", "score", "tf", "rank")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10 words of each title by score, tf and word."""
    return p3_top_words(spark, sf_dir).select("title", "word")


# ---------------------------------------------------------------- problem 4


def term_frequencies(records: DataFrame, record: str, pairs: str, at_least: int = 3, at_most_share: float = 0.1) -> DataFrame:
    """Occurrences and record count of every term over records, with ``mark`` rare / common / null.

    ``records`` has one row per record; ``pairs`` holds TAB-separated ``term:count`` pairs (the count follows the
    last colon). Per-record counts are combined without a shuffle where the input is already distributed by
    record, then partially summed by term before the only shuffle on terms.

    Returns term, n_total, n_records, mark: ``rare`` if fewer than ``at_least`` records have the term, ``common``
    if more than ``at_most_share`` of all records do. Defined cases: a pair with an empty term, without colon or
    without a positive whole count doesn't count; null or empty lists still count as records; a term repeated
    in a record adds up and counts as one record; an empty input gives no rows; extra columns are dropped.
    """
    slim = records.select(F.col(record).alias("record"), F.col(pairs).alias("pairs"))
    pair = slim.select("record", F.explode(F.split("pairs", "\t")).alias("pair"))
    cut = F.length("pair") - F.length(F.substring_index("pair", ":", -1))
    counted = pair.where(F.col("pair").rlike(r"(?s)^.+:\+?0*[1-9][0-9]*$")).select(
        "record", F.col("pair").substr(F.lit(1), cut - 1).alias("term"), F.expr("try_cast(substring_index(pair, ':', -1) AS bigint)").alias("n")
    )
    per_record = counted.where("n > 0").groupBy("record", "term").agg(F.sum("n").alias("n"))
    terms = per_record.groupBy("term").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_records"))
    size = slim.agg(F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("n_records") < at_least, "rare").when(F.col("n_records") > at_most_share * F.col("records"), "common")
    return terms.crossJoin(F.broadcast(size)).select("term", "n_total", "n_records", mark.alias("mark"))


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_word: the word list of the latest row of each non-null title."""
    t = table(spark, sf_dir, "count_word", "title", "words", "dumped_at", "rec_no").where("title IS NOT NULL")
    return latest(t, ["title"], "dumped_at", ["rec_no", "words"]).select("title", "words")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total count, record count and mark of every distinct word of count_word.words."""
    return term_frequencies(latest_records(spark, sf_dir), "title", "words").select(F.col("term").alias("word"), "n_total", "n_records", "mark")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that too few or too many records use."""
    return p4_terms(spark, sf_dir).where("mark IS NOT NULL").select("word", "mark")


QUERIES = {"p2_found": p2_found, "p2_weights": p2_weights, "p3_found": p3_found, "p3_top_words": p3_top_words, "p4_found": p4_found, "p4_terms": p4_terms}

_USABLE = r"""u AS (
  SELECT title, word, tf, score FROM (
    SELECT *, row_number() OVER (PARTITION BY title, word ORDER BY counted_at DESC NULLS LAST, tf DESC, score DESC) AS rn FROM tfidf
    WHERE title IS NOT NULL AND word IS NOT NULL AND trim(word, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) <> '' AND tf >= 1 AND score IS NOT NULL)
  WHERE rn = 1)"""
_WEIGHTS = f"""WITH {_USABLE}, s AS (
  SELECT word, count(*) AS df, greatest(0, ln(sum(tf::DOUBLE)) - sum(tf * ln(tf)) / sum(tf::DOUBLE)) AS entropy FROM u GROUP BY word),
n AS (SELECT count(DISTINCT title)::DOUBLE AS n FROM u)
SELECT title, word, tf, df, round(ln(1 + tf) * CASE WHEN n > 1 THEN 1 - entropy / ln(n) ELSE 1 END, 6) AS weight FROM u JOIN s USING (word) CROSS JOIN n"""
_TOP = f"""WITH {_USABLE}, r AS (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, tf DESC, word) AS rank FROM u)
SELECT title, word, score, tf, rank FROM r WHERE rank <= 10"""
_TERMS = r"""WITH r AS (
  SELECT title, words FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY dumped_at DESC NULLS LAST, rec_no DESC) AS rn FROM count_word WHERE title IS NOT NULL)
  WHERE rn = 1),
p AS (SELECT title, unnest(string_split(words, chr(9))) AS pair FROM r),
c AS (SELECT title, regexp_replace(pair, '(?s):[^:]*$', '') AS word, sum(CAST(regexp_extract(pair, '[^:]*$') AS BIGINT)) AS n FROM p
  WHERE regexp_full_match(pair, '(?s).+:\+?0*[1-9][0-9]*') GROUP BY ALL),
t AS (SELECT word, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_records FROM c GROUP BY word)
SELECT word, n_total, n_records,
  CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.1 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM t"""

ORACLES = {
    "p2_weights": _WEIGHTS,
    "p2_found": f"SELECT title, word FROM ({_WEIGHTS}) WHERE tf >= 4 AND df BETWEEN 2 AND 5",
    "p3_top_words": _TOP,
    "p3_found": f"SELECT title, word FROM ({_TOP})",
    "p4_terms": _TERMS,
    "p4_found": f"SELECT word, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
}

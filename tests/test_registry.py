import __spark_entry__ as entry


def test_registry(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and "tfidf_top50" in queries
    assert entry.entry(spark).columns == ["doc_id", "word", "score"]

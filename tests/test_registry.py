"""Driver contract: every query has an oracle statement and the flagship runs."""

import __spark_entry__ as E
from storyloom.plans import oracle, queries


def test_every_query_has_oracle_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["topic_id", "rank", "id", "similarity_score"]

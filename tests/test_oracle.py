"""The registered queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import digest

SF = "/root/testdata/sf0.001"
# One or two queries per family; scripts/check_oracle.py runs all of them.
SAMPLE = ["vector_topk", "ivf_topk", "clean_articles", "source_from_url", "text_cosine_topk", "relation_edges",
          "keyword_clusters", "key_events", "section_pack", "grounding_report", "eval_metrics", "endpoint_chunks",
          "incremental_embed", "vector_self_topk", "ivf_recall", "label_similarity", "article_raw", "feed_accounting",
          "generate_loop", "evaluation_run", "context_blocks"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    c = duckdb.connect()
    for t in ["events", "documents", "embeddings", "pages", "benchmark", "labels"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    want = res.fetchall()
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(want)
    assert digest(rows, df.columns)[0] == digest(want, cols)[0]

"""Dense search, pairs and the stored inverted file against NumPy."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.operators import dense, ivf, search


def rows_of(n, d, seed, common=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    if common:
        x[n - common:] = x[0]  # one vector many times: ties
    return [(i, [float(v) for v in x[i]]) for i in range(n)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(parts)


def usable(v, d):
    return v is not None and len(v) == d and all(x is not None and not math.isnan(x) for x in v)


def brute(queries, rows, k, own=False):
    out = {}
    for t, q in queries:
        scored = []
        for i, v in rows:
            if usable(v, len(q)) and not (own and i == t):
                s = 0.0
                for a, b in zip(q, v):
                    s += float(a) * float(b)
                scored.append((-s, i))
        out[t] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def by_query(df, q_id="topic_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r[q_id], r["rank"])):
        out.setdefault(r[q_id], []).append((r["id"], r["similarity_score"]))
    return out


ODD = [(9001, None), (9002, []), (9003, [1.0, 2.0]), (9004, [float("nan")] * 12), (9005, [None] + [1.0] * 11), (9006, [0.0] * 12)]


@pytest.mark.parametrize("options", [{}, {"max_query_bytes": 600, "block_rows": 70}])
def test_topk_is_bit_exact_with_ties_and_odd_vectors(spark, options):
    rows = rows_of(400, 12, 1, common=120) + ODD
    queries = [(t, v) for t, v in rows[:9]]
    q = spark.createDataFrame([(t, v) for t, v in queries], "topic_id long, embedding array<double>")
    got = by_query(dense.dense_topk(q, frame(spark, rows), 15, normalize_queries=False, **options))
    assert got == brute(queries, rows, 15)  # scores bit by bit
    alone = by_query(dense.dense_topk(q, frame(spark, rows), 4, normalize_queries=False, exclude_self=True, **options))
    assert alone == brute(queries, rows, 4, own=True)


def test_topk_with_strings_null_ids_and_few_rows(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("é", [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "topic_id long, embedding array<double>")
    got = [(r.topic_id, r["rank"], r.id, r.similarity_score) for r in dense.dense_topk(q, corpus, 9).orderBy("rank").collect()]
    assert got == [(1, 1, None, 1.0), (1, 2, "a", 1.0), (1, 3, "b", 1.0), (1, 4, "é", 0.0)]  # unit query
    assert dense.dense_topk(q.limit(0), corpus, 9).count() == 0
    assert dense.dense_topk(q, corpus.limit(0), 9).count() == 0


def test_ten_thousand_queries_without_a_nested_loop(spark):
    rows = rows_of(600, 16, 3)
    q = spark.createDataFrame(rows_of(10_000, 16, 4), "topic_id long, embedding array<float>").repartition(4)
    hits = dense.dense_topk(q, frame(spark, rows), 3)
    plan = hits._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "lambda" not in plan.split("== Physical Plan ==")[1]
    assert hits.count() == 30_000
    x = np.array([v for _, v in rows])
    for t in (0, 5000, 9999):
        v = np.array(rows_of(10_000, 16, 4)[t][1])
        assert [r.id for r in hits.where(F.col("topic_id") == t).orderBy("rank").collect()] == list(np.argsort(-(x @ v), kind="stable")[:3])


def test_pairs_of_a_set_are_spread_over_blocks(spark):
    rows = rows_of(90, 6, 5)
    members = [(1, i) for i in range(80)] + [(2, i) for i in range(85, 90)] + [(3, 4)] + [(1, 999)]
    m = spark.createDataFrame(members, "topic_id long, id long")
    want = {}
    for g, own in ((1, range(80)), (2, range(85, 90))):
        for i in own:
            for j in own:
                if i < j:
                    want[g, i, j] = brute([(0, rows[i][1])], [rows[j]], 1)[0][0][1]
    for block in (7, 512):
        out = dense.similarity_pairs(m, frame(spark, rows), block=block).collect()
        assert {(r.topic_id, r.id1, r.id2): r.similarity for r in out} == want and len(out) == len(want)


def test_index_is_exact_with_all_lists_and_prunes_files(spark):
    folder = tempfile.mkdtemp(prefix="run-") + "/index"
    rows = rows_of(500, 12, 8, common=60) + ODD
    ivf.build_index(frame(spark, rows), folder)
    lists = spark.read.parquet(f"{folder}/lists")
    n_lists = lists.count()
    assert 8 < n_lists < 60 and ivf.read_vectors(spark, folder).count() == len(rows)
    queries = [(t, v) for t, v in rows[:20]]
    q = spark.createDataFrame(queries, "topic_id long, embedding array<double>")
    got = by_query(ivf.search_index(q, folder, 10, nprobe=10 ** 6, normalize_queries=False))
    assert got == brute(queries, rows, 10)
    # A probe of few lists reads only their partitions.
    probes = ivf.probe(q.limit(1), lists, 2).checkpoint()
    found = ivf.probed_vectors(spark, folder, probes)
    assert {r.list_id for r in found.select("list_id").distinct().collect()} == {r.list_id for r in probes.collect()}
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_recall_of_the_trained_index(spark):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [c + r.gauss(0, 0.4) for c in centres[i % 20]]) for i in range(3000)]
    queries = spark.createDataFrame([(t, v) for t, v in rows[::50]], "topic_id long, embedding array<double>")
    exact = by_query(dense.dense_topk(queries, frame(spark, rows), 10))
    found = by_query(search.search(queries, frame(spark, rows), 10, mode="ivf"))
    hit = sum(len({i for i, _ in exact[t]} & {i for i, _ in found.get(t, [])}) for t in exact)
    assert hit >= 0.9 * sum(map(len, exact.values()))


def test_assigned_lists_are_the_nearest(spark):
    rows = rows_of(200, 5, 9) + [(900, None)]
    cents = spark.createDataFrame([(c, [float(x) for x in v]) for c, v in rows_of(12, 5, 10)], "list_id long, centroid array<double>")
    matrix = np.array([v for _, v in rows_of(12, 5, 10)])
    want = {i: (-1 if v is None else int(np.argmax(matrix @ np.array(v)))) for i, v in rows}
    for limit in (1 << 20, 100):
        out = dense.assign_lists(frame(spark, rows), cents, max_query_bytes=limit).collect()
        assert {r.id: r.list_id for r in out} == want

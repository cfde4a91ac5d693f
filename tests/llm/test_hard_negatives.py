"""Hard negatives against all pairs in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def vector(r, centre, spread=0.25):
    return [c + r.gauss(0, spread) for c in centre]


def rows():
    r = random.Random(11)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = [(i * 5, vector(r, centres[i % 6]), i % 4) for i in range(400)]
    out += [(5000 + i, list(centres[1]), i % 3) for i in range(60)]  # one very common vector: ties
    out += [(7000, vector(r, centres[2]), 1)] * 2  # a repeated anchor
    out += [(7100, None, 1), (7200, vector(r, centres[0]), None), (7300, [1.0, None, 2.0], 1), (7400, [float("nan")] * 8, 1), (7500, [float("inf")] * 8, 2),
            (7600, [], 1), (7700, [2.0, 1.0], 2), (7800, [0.0] * 8, 3), (None, vector(r, centres[1]), 2), (None, vector(r, centres[3]), None), (7900, [1e30] + [0.5] * 7, 0), (8000, vector(r, centres[0]), 77)]
    return out


def brute(rows):
    kept = []
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        q = [max(-2 ** 26, min(2 ** 26, math.floor(256 * float(np.float32(x))))) for x in v] + [0] * (8 - len(v))
        kept.append((i, label, q))
    out = Counter()
    place = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, label, q in kept:
        if i is None or i % 100:
            continue
        scored = [(j, sum(a * b for a, b in zip(q, p)), other == label) for j, other, p in kept if j != i]
        for pid, ps, _ in sorted((x for x in scored if x[2]), key=place)[:5]:
            negatives = sorted((x for x in scored if not x[2] and 30 * ps <= 100 * x[1] <= 90 * ps), key=place)[:10]
            for k, (nid, ns, _) in enumerate(negatives):
                out[i, pid, k + 1, nid, ps, ns] += 1
    return out


def got(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "label AS leaf", "vec_id AS anchor", "1 AS q")


def test_query(spark, tmp_path):
    table(spark, rows()).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = got(queries.queries()["op13_hard_negatives"](spark, str(tmp_path)))
    want = brute(rows())
    assert found == want and len(want) > 150


def integers(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.integer_rows(table(spark, rows), F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double")), F.col("vec_id"), label)


@pytest.mark.parametrize("options", [{"leaf_rows": 4, "fanout": 3, "block_rows": 16, "block_anchors": 2}, {"leaf_rows": 8, "sample_rows": 60}])
def test_small_leaves_and_blocks(spark, options):
    assert got(hard_negatives.mine(integers(spark, rows()), F.col("vec_id") % 100 == 0, **options)) == brute(rows())


def test_siblings_are_eliminated(spark):
    r = random.Random(2)
    centres = [[r.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    some = [(i, vector(r, centres[i % 12], 0.05), i % 2) for i in range(1200)]
    index = hard_negatives.build_index(integers(spark, some), leaf_rows=40)
    tree = index.tree
    x = hard_negatives.matrix(index.rows.select("q").toArrow()["q"].combine_chunks(), tree.dim)
    reach = float(np.sqrt((x[0] @ x[0]) + tree.length2 - 2 * np.sort(x @ x[0])[-20]))
    _, leaves = tree.visits(x[:1], np.array([0.0]), np.array([reach]), False)
    assert 0 < len(leaves) < tree.leaves / 2
    assert sum(r.n for r in index.sizes.collect()) == 1200


def test_empty_and_single(spark):
    for some in ([], [(0, [1.0, 2.0], 1)], [(0, None, 1)]):
        assert hard_negatives.mine(integers(spark, some), F.col("vec_id") % 100 == 0).count() == 0

"""Search operators against brute force: dense top-k, text cosine, partitioned search."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from storyloom.operators import embed, search
from storyloom.sources.store import Store


def _vectors(spark, n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in x[i]], int(i % 5)) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, embedding array<float>, label int")


def test_dense_topk_matches_numpy(spark):
    x, corpus = _vectors(spark)
    q = x[:7].astype(np.float64)
    queries = spark.createDataFrame([(i, [float(v) for v in q[i]]) for i in range(7)], "topic_id long, embedding array<double>")
    got = {}
    for r in search.dense_topk(queries, corpus, 5).collect():
        got.setdefault(r.topic_id, []).append((r.rank, r.id, r.similarity_score))
    s = q / np.linalg.norm(q, axis=1, keepdims=True) @ x.astype(np.float64).T
    for t in range(7):
        want = sorted(range(len(x)), key=lambda j: (-s[t, j], j))[:5]
        assert [i for _, i, _ in sorted(got[t])] == want
        assert all(abs(sc - s[t, i]) < 1e-9 for _, i, sc in got[t])


def test_neighbours_exclude_self_and_unknown(spark):
    _, corpus = _vectors(spark, n=50)
    anchors = spark.createDataFrame([(3,), (999,)], "id long")
    nb = search.neighbours(corpus, anchors, 4).collect()
    assert {r.anchor_id for r in nb} == {3}
    assert all(r.id != 3 for r in nb) and len(nb) == 4


def _tok(s):
    import regex
    return regex.findall(r"[\p{L}\p{N}]+", s.lower())


def test_text_topk_matches_bruteforce(spark):
    rnd = random.Random(2)
    vocab = ["alpha", "beta", "gamma", "delta", "épée", "zeta", "eta", "theta", "42", "iota"]
    docs = [(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30)))) for i in range(120)]
    docs += [("dup1", docs[0][1]), ("dup2", docs[0][1])]
    topics = [(t, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6)))) for t in range(9)]
    ddf = spark.createDataFrame(docs, "id string, full_text string")
    tdf = spark.createDataFrame(topics, "topic_id long, topic string")
    dtv = embed.term_vectors(ddf, "id", "full_text")
    ttv = embed.term_vectors(tdf, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    got = {}
    for r in search.text_topk(ttv, dtv, 8).collect():
        got.setdefault(r.topic_id, []).append((r.rank, r.id, r.similarity_score))
    dc = {i: Counter(_tok(t)) for i, t in docs}
    for t, text in topics:
        tc = Counter(_tok(text))
        scores = []
        for i, c in dc.items():
            dot = sum(c[w] * tc[w] for w in tc)
            scores.append((-(dot / math.sqrt(sum(v * v for v in c.values()) * sum(v * v for v in tc.values()))), i))
        want = [i for _, i in sorted(scores)[:8]]
        assert [i for _, i, _ in sorted(got[t])] == want
    # term vectors are exact counts
    tv = {r.id: dict(zip(r.terms, r.tf)) for r in dtv.collect()}
    assert tv["5"] == dict(dc["5"])


def test_answer_reuse_computes_only_new_keys(spark, tmp_path):
    q = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, "a b"), (4, "none")], "topic_id long, topic string")
    calls = []

    def run(todo):
        calls.append(sorted(r.topic for r in todo.collect()))
        found = todo.where("topic <> 'none'")
        return found.select("key", F.lit(1).alias("rank"), F.lit("x").alias("id"), F.lit(1.0).alias("similarity_score"))

    folder = str(tmp_path / "answers")
    search.cached_search(q.filter("topic_id in (1, 4)"), folder, run, 5, "m", "v1")
    out = {r.topic_id: r.fresh for r in search.cached_search(q, folder, run, 5, "m", "v1").collect()}
    assert out == {1: False, 2: True, 3: False}
    again = search.cached_search(q, folder, run, 5, "m", "v1").collect()
    # The empty answer is remembered, and nothing is searched a second time.
    assert calls == [["a b", "none"], ["c d"]] and not any(r.fresh for r in again)
    assert search.cached_search(q, folder, run, 5, "m", "v1", rebuild=True).where("fresh").count() == 3
    assert len(calls) == 3


def test_alignment_and_store(spark, tmp_path):
    v = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.3]), (5, [0.0, 1.0])], "id long, embedding array<double>")
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    a = embed.check_alignment(v, items, 2).collect()[0]
    assert (a.items_without_vector, a.vectors_without_item, a.bad_dimension) == (1, 1, 1)
    arts = spark.createDataFrame([("1", "same text"), ("2", "same text"), ("3", "other")], "id string, full_text string")
    enc = lambda d: embed.term_vectors(d, "key", "full_text").withColumnRenamed("id", "key")
    folder = str(tmp_path / "vectors")
    out = embed.embed_with_store(arts.where("id = '1'"), folder, "m", enc)
    assert [r.fresh for r in out.collect()] == [True]
    out = {r.id: r.fresh for r in embed.embed_with_store(arts, folder, "m", enc).collect()}
    assert out == {"1": False, "2": False, "3": True}
    assert not any(r.fresh for r in embed.embed_with_store(arts, folder, "m", enc).collect())
    assert Store(spark, folder).read().count() == 2
    assert all(r.fresh for r in embed.embed_with_store(arts, folder, "m", enc, rebuild=True).collect())


def test_text_topk_in_blocks_is_identical(spark):
    rnd = random.Random(9)
    vocab = ["red", "green", "blue", "cyan", "teal", "gold", "grey"]
    docs = spark.createDataFrame([(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12)))) for i in range(60)],
                                 "id string, full_text string")
    tps = spark.createDataFrame([(t, " ".join(rnd.choice(vocab) for _ in range(3))) for t in range(15)], "topic_id long, topic string")
    dtv = embed.term_vectors(docs, "id", "full_text")
    ttv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    one = {tuple(r) for r in search.text_topk(ttv, dtv, 5).collect()}
    many = {tuple(r) for r in search.text_topk(ttv, dtv, 5, max_bytes=200, max_topics=4).collect()}
    assert one == many and len(one) == 15 * 5


def test_threshold_gives_equal_hits_from_fewer_scored_documents(spark):
    rnd = random.Random(5)
    near, far = ["red", "green", "blue"], [f"word{i}" for i in range(200)]
    docs = spark.createDataFrame([(f"{i:03}", " ".join([rnd.choice(near)] * (i % 4) + [rnd.choice(far) for _ in range(rnd.randint(0, 9))])) for i in range(300)], "id string, full_text string")
    tps = spark.createDataFrame([(1, "red green"), (2, "blue blue red"), (3, "gold")], "topic_id long, topic string")
    dtv = embed.term_vectors(docs, "id", "full_text")
    ttv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    for threshold in (0.2, 0.6, 1.0):
        want = search.min_score(search.text_topk(ttv, dtv, 40), threshold)
        got = search.text_topk(ttv, dtv, 40, threshold=threshold)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = dtv.collect()
    known = [(n, tf) for n, r in enumerate(rows) for t, tf in zip(r.terms, r.tf) if t in near]
    row, tf = (np.array(x) for x in zip(*known))
    sumsq = np.array([float(r.sumsq) for r in rows])
    kept = search.reachable(row, tf, sumsq, 0.6)
    best = {r.id for r in search.text_topk(ttv, dtv, 300, threshold=0.6).collect()}
    assert best <= {rows[n].id for n in kept} and len(kept) < 0.6 * len(rows)


def test_text_topk_fills_up_and_keeps_equal_ids_apart(spark):
    docs = spark.createDataFrame([("a", 1, "red"), ("a", 2, "red green"), ("b", 1, ""), ("c", 1, "red"), ("c", 1, "red")], "id string, n long, full_text string")
    tps = spark.createDataFrame([(1, "red"), (2, "blue"), (3, "")], "topic_id long, topic string")
    dtv = embed.term_vectors(docs, "id", "full_text", carry=["n"])
    ttv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    got = {}
    for r in search.text_topk(ttv, dtv, 9, carry=["n"]).orderBy("topic_id", "rank").collect():
        got.setdefault(r.topic_id, []).append((r.id, r.n, round(r.similarity_score, 4)))
    assert got[1] == [("a", 1, 1.0), ("c", 1, 1.0), ("c", 1, 1.0), ("a", 2, 0.7071), ("b", 1, 0.0)]
    zeros = [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 0.0), ("c", 1, 0.0), ("c", 1, 0.0)]
    assert got[2] == zeros and got[3] == zeros
    assert search.text_topk(ttv, dtv.limit(0), 9).count() == 0
    assert search.text_topk(ttv.limit(0), dtv, 9).count() == 0


def test_equal_ids_keep_their_own_articles(spark):
    from storyloom.operators import clean, storyline
    raw = spark.createDataFrame([("7", "Red metro line opens", "one"), ("7", "Red metro line closes", "two"), (None, "Red metro line opens", "three"),
                                 (None, "Red metro line opens", "four"), ("7", "Red metro line opens", "one")], "id string, title string, content string")
    arts = clean.clean_articles(raw)
    dtv = embed.term_vectors(arts.withColumn("row_key", clean.row_key()), "id", "full_text", carry=["row_key"])
    tps = spark.createDataFrame([(1, "red metro one")], "topic_id long, topic string")
    ttv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    ta = storyline.topic_articles(search.text_topk(ttv, dtv, 10, carry=["row_key"]), arts).collect()
    assert sorted(r.rank for r in ta) == [1, 2, 3, 4, 5] and sorted(r.pos for r in ta) == [1, 2, 3, 4, 5]
    assert sorted(r.full_text.split()[-1] for r in ta) == ["four", "one", "one", "three", "two"]
    assert all(r.similarity_score <= 1 for r in ta) and len({r.id for r in ta}) == 3

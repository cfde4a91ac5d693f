"""Odd ids, and batches that are larger than what a task may hold at once."""

import datetime
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from storyloom.functions.vectors import list_slices
from storyloom.operators import dense, embed, ivf, search
from storyloom.plans import queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small set of tables, with an article whose id is 0 (which counts as no id)."""
    folder = str(tmp_path_factory.mktemp("tables"))
    n = 12
    told = ["the bridge opened", "a dam was filled", "trains run again"]
    docs = [(i, f"{told[i % 3]} number {i}\nthe council of town {i} told more of it today", "en", f"src{i % 4}", 60) for i in range(n)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    write(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(i, 1) for i in range(n)], "doc_id long, quality int", "labels")
    write([(i, datetime.datetime(2024, 1, 1 + i)) for i in range(n)], "event_id long, ts timestamp", "events")
    write([(0, "bridge opened"), (1, "the dam of a town"), (2, "trains run")], "item_id long, text string", "benchmark")
    return folder


def test_loop_takes_articles_without_an_id(spark, tables):
    ids = {r.id for r in queries.articles(spark, tables).select("id").collect()}
    assert any(not i.isdigit() for i in ids)
    rows = queries.queries()["generate_loop"](spark, tables).collect()
    assert {r.topic_id: r.n_sources for r in rows} == {0: 5, 1: 5, 2: 5}
    assert all(r.n_timeline == 1 for r in rows)


def _large_batch(rows=4000, words=500):
    rng = np.random.default_rng(3)
    said = pa.array([f"w{i}" for i in range(3000)]).take(pa.array(rng.integers(0, 3000, rows * words)))
    terms = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * words + 1, words, dtype=np.int32)), said)
    return pa.RecordBatch.from_arrays([pa.array([f"{i:05}" for i in range(rows)]), terms], ["id", "terms"])


def _peak(batches):
    """What the batches are, and the most MB that numpy held beside one of them."""
    tracemalloc.start()
    out, most = [], 0
    for batch in batches:
        out.append(batch)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, most


def test_slices_keep_all_rows_in_order():
    lists = [[1, 2, 3], None, [], [4] * 9, [5], [6, 7]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.int64()))], ["id", "terms"])
    cut = list(list_slices(iter([batch, batch.slice(0, 0), batch.slice(4)]), "terms", 4))
    assert [b.column("id").to_pylist() for b in cut] == [[0, 1, 2], [3], [4, 5], [4, 5]]
    assert [x for b in cut for x in b.column("terms").to_pylist()] == lists + lists[4:]


def test_large_batches_are_counted_and_scored_in_slices():
    batch = _large_batch()
    counted, most = _peak(embed._counted_terms(iter([batch])))
    assert most < 40 and sum(b.num_rows for b in counted) == batch.num_rows
    whole = pa.Table.from_batches(counted)
    for i in (0, 1999, 3999):
        words, n = np.unique(batch.column("terms")[i].as_py(), return_counts=True)
        assert whole["terms"][i].as_py() == words.tolist() and whole["tf"][i].as_py() == n.tolist()
        assert whole["sumsq"][i].as_py() == int((n ** 2).sum())
    topics = pa.table({"topic_id": [7], "terms": [["w1", "w2", "w9"]], "tf": [[1, 2, 1]], "sumsq": [6]})
    docs = whole.combine_chunks().to_batches()[0]
    found, most = _peak(search._block_scorer(topics, 5, ["id"])(iter([docs])))
    tf = [dict(zip(t, n)) for t, n in zip(whole["terms"].to_pylist(), whole["tf"].to_pylist())]
    score = [(d.get("w1", 0) + 2 * d.get("w2", 0) + d.get("w9", 0)) / np.sqrt(6.0 * s) for d, s in zip(tf, whole["sumsq"].to_pylist())]
    want = sorted(range(len(score)), key=lambda i: (-score[i], i))[:5]
    assert [int(x) for b in found for x in b.column("id").to_pylist()] == want
    assert most < 40


def _queries_and_lists(spark):
    rng = np.random.default_rng(5)
    q = rng.integers(-3, 4, (60, 6)).astype(float)   # whole numbers: many equal products
    c = rng.integers(-2, 3, (40, 6)).astype(float)
    rows = [(i // 2 if i < 10 else i, [float(x) for x in q[i]]) for i in range(60)]  # ids 0-4 twice
    rows += [(0, rows[0][1]), (70, None), (71, [1.0, 2.0]), (72, [float("nan")] * 6)]
    queries_ = spark.createDataFrame(rows, "topic_id long, embedding array<double>")
    lists = spark.createDataFrame([(3 * i + 1, [float(x) for x in c[i]]) for i in range(40)], "list_id long, centroid array<double>")
    return queries_, lists


def test_places_of_lists_are_the_ranks_among_all_lists(spark):
    q, lists = _queries_and_lists(spark)
    plain = dense.dense_topk(q, lists, 40, c_id="list_id", c_vec="centroid", normalize_queries=False)
    rank = {}
    for r in plain.select("topic_id", "list_id", "rank").collect():
        rank[r.topic_id, r.list_id] = min(r["rank"], rank.get((r.topic_id, r.list_id), 99))
    wanted = spark.createDataFrame([(t, i) for t in [*range(60), 70, 71, 72, 99] for i in (1, 7, 40, 118, 5, -1)], "topic_id long, list_id long")
    found = {(r.topic_id, r.list_id): r["rank"] for r in ivf.list_places(q, wanted, lists).collect()}
    assert found == {key: v for key, v in rank.items() if key[1] in (1, 7, 40, 118)}
    large = {(r.topic_id, r.list_id): r["rank"] for r in ivf.list_places(q, wanted, lists, max_bytes=0).collect()}
    assert large == found
    near = {(r.topic_id, r["rank"], r.list_id) for r in ivf.probe(q, lists, 4).collect()}
    assert near == {(r.topic_id, r["rank"], r.list_id) for r in plain.where("rank <= 4").collect()}


def test_a_list_without_an_id_takes_its_place(spark):
    q, lists = _queries_and_lists(spark)
    odd = lists.selectExpr("CAST(nullif(list_id, 40) AS INT) AS list_id", "centroid")
    plain = dense.dense_topk(q, odd, 40, c_id="list_id", c_vec="centroid", normalize_queries=False)
    near = ivf.probe(q, odd, 4)
    assert near.schema["list_id"].dataType == odd.schema["list_id"].dataType
    told = sorted((r.topic_id, r["rank"], str(r.list_id)) for r in near.collect())
    assert told == sorted((r.topic_id, r["rank"], str(r.list_id)) for r in plain.where("rank <= 4").collect()) and any(x == "None" for *_, x in told)
    wanted = spark.createDataFrame([(i, 7) for i in range(10, 60)], "topic_id long, list_id long")
    found = {r.topic_id: r["rank"] for r in ivf.list_places(q, wanted, odd).collect()}
    assert found == {r.topic_id: r["rank"] for r in plain.where("list_id = 7 AND topic_id BETWEEN 10 AND 59").collect()}


def test_places_of_lists_do_not_hold_all_lists_of_all_queries():
    rng = np.random.default_rng(6)
    vectors, centres = rng.normal(size=(20_000, 8)), rng.normal(size=(1_000, 8))
    tracemalloc.start()
    asked = np.arange(20_000)
    place = ivf._places(vectors, asked, np.ones(20_000, np.int64), asked, asked % 1_000, centres, 20_000)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 20  # all products would be 160
    score = vectors[:50] @ centres.T
    assert place[:50].tolist() == [1 + int((score[i] > score[i, i]).sum()) for i in range(50)]


def test_probes_are_chosen_without_ranking_every_list(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)], "id long, embedding array<double>")
    folder = str(tmp_path / "index")
    ivf.build_index(corpus, folder)
    trial = corpus.where("id % 20 = 7").select(corpus.id.alias("topic_id"), "embedding")
    monkeypatch.setattr(ivf, "probe", lambda *a, **k: pytest.fail("a rank for each query and list"))
    assert 1 <= ivf.probes_for_recall(trial, corpus, folder, 5, 0.9) <= 20


def test_documents_are_counted_by_the_task_that_scores_them(spark, tables):
    plan = queries.queries()["text_threshold"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    docs = spark.createDataFrame([(i, f"w{i % 5} W{i % 7} w{i % 5}, x{i}") for i in range(60)] + [(60, None), (61, "")], "id long, full_text string")
    asked = embed.term_vectors(spark.createDataFrame([(1, "w1 w2"), (2, "x7 w3 w3"), (3, "")], "topic_id long, topic string"), "topic_id", "topic").withColumnRenamed("id", "topic_id")
    for options in ({}, {"threshold": 0.3}, {"max_topics": 1}):
        once = search.text_topk(asked, embed.term_lists(docs), 9, **options)
        stored = search.text_topk(asked, embed.term_vectors(docs), 9, **options)
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, stored.collect()))


def test_counting_and_scoring_hold_little_beside_a_batch():
    batch = _large_batch()
    topics = pa.table({"topic_id": list(range(40)), "terms": [[f"w{i}", f"w{i + 9}"] for i in range(40)], "tf": [[1, 2]] * 40, "sumsq": [5] * 40})
    found, most = _peak(search._block_scorer(topics, 5, ["id"])(embed._counted_terms(iter([batch]))))
    assert sum(b.num_rows for b in found) == 200 and most < 15


class _Searched(Exception):
    pass


@pytest.mark.parametrize("name", ["summary_text", "storyline_files", "relation_edges", "text_threshold", "eval_metrics", "grounding_report",
                                  "context_blocks", "best_attempt", "eval_aggregate", "graph_counts", "timeline"])
def test_a_searching_query_starts_one_python_worker_a_task(spark, tables, monkeypatch, name):
    """The documents' tokens come out of the JVM uncounted, so no second worker holds a batch beside the scorer's."""
    def searched(topics, docs, *a, **k):
        assert docs.columns[-1] == "terms" and "tf" not in docs.columns
        assert "MapInArrow" not in docs._jdf.queryExecution().executedPlan().toString()
        raise _Searched
    monkeypatch.setattr(search, "text_topk", searched)
    with pytest.raises(_Searched):
        queries.queries()[name](spark, tables)

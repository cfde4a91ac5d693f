"""Readers, writers and the streaming ingest."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from storyloom.operators import clean, evaluate
from storyloom.sources import news, sinks
from storyloom.sources.store import Store
from storyloom.streaming.incremental import start_ingest

ART = {"id": "7", "title": "A headline that is long", "content": "body", "source_rating": 9, "tags": ["x"]}


def _tmp():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_news_reader_bare_and_wrapped(spark):
    d = _tmp()
    with open(f"{d}/a.json", "w") as f:
        json.dump([ART, dict(ART, id="8")], f, indent=2)
    with open(f"{d}/b.json", "w") as f:
        json.dump({"articles": [dict(ART, id="9", source_rating="abc")]}, f, indent=2)
    raw = news.read_news_json(spark, d)
    got = {r.id: r for r in clean.clean_articles(raw).collect()}
    assert set(got) == {"7", "8", "9"}
    assert got["7"].source_rating == 9.0 and got["9"].source_rating == 0.0
    news.land(raw, f"{d}/landed", "overwrite")
    landed = spark.read.parquet(f"{d}/landed")
    assert landed.count() == 3
    rated = clean.clean_articles(landed, min_rating=5)
    assert {r.id for r in rated.collect()} == {"7", "8"}
    assert "GreaterThanOrEqual(rating_value,5.0)" in rated._jdf.queryExecution().toString()


def test_eval_set_reader(spark):
    d = _tmp()
    with open(f"{d}/golden.jsonl", "w") as f:
        f.write("# comment line\n\n")
        f.write(json.dumps({"topic": "t1", "reference": "r1"}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"topic": "t2", "reference": ""}) + "\n")
        f.write(json.dumps({"topic": "t3", "reference": "r3"}) + "\n")
    rows, rejects = evaluate.read_eval_set(spark, f"{d}/golden.jsonl")
    assert sorted(r.topic for r in rows.collect()) == ["t1", "t3"]
    assert rejects.count() >= 2


def test_metrics_and_nan_mean(spark):
    pq = spark.createDataFrame([(1, "a", 1.0, float("nan"), 0.5, 1.0), (2, "b", 0.0, float("nan"), None, 0.0)],
                               "topic_id long, user_input string, faithfulness double, answer_relevancy double, "
                               "context_precision double, context_recall double")
    agg = evaluate.aggregate(pq).collect()[0]
    assert agg.num_samples == 2 and agg.faithfulness == 0.5 and agg.answer_relevancy is None and agg.context_precision == 0.5
    cv = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "topic_id long, rank int, useful boolean")
    cp = {r.topic_id: r.context_precision for r in evaluate.context_precision(cv).collect()}
    assert abs(cp[1] - (1.0 + 2 / 3) / 2) < 1e-12 and cp[2] == 0.0


def test_sinks(spark):
    d = _tmp()
    hits = spark.createDataFrame([(1, 2, 0.5, "t2", ("e2", "c", "GET", "u2")), (1, 1, 0.91234, "t1", ("e1", "c", "GET", "u1"))],
                                 "topic_id long, rank int, similarity_score double, text string, "
                                 "metadata struct<endpoint_name:string,category:string,method:string,url:string>")
    sinks.write_hits(hits, f"{d}/txt", fmt="text")
    text = "".join(open(os.path.join(f"{d}/txt", p)).read() for p in sorted(os.listdir(f"{d}/txt")) if p.startswith("part"))
    assert text.count("=" * 80) == 3 and text.rstrip().endswith("=" * 80)  # a rule before each hit and one at the end
    assert "Similarity Score: 0.9123" in text and text.index("Rank: 1") < text.index("Rank: 2")
    sinks.write_hits(hits, f"{d}/json")
    assert spark.read.json(f"{d}/json").count() == 2
    agg = spark.createDataFrame([(2, 0.5)], "num_samples long, faithfulness double")
    sinks.write_evaluation(hits.select("topic_id"), agg, f"{d}/eval")
    assert spark.read.json(f"{d}/eval/aggregate").collect()[0].results_path == f"{d}/eval"


def test_streaming_ingest_encodes_each_text_once(spark):
    d = _tmp()
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/1.json", "w") as f:
        for i, t in enumerate(["same body text", "same body text", "other text"]):
            f.write(json.dumps({"id": str(i), "title": "Headline number %d" % i, "content": t}) + "\n")
    q = start_ingest(spark, f"{d}/in", f"{d}/out", f"{d}/chk")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{d}/out/articles").count() == 3
    first = Store(spark, f"{d}/out/vectors").read().count()
    assert first == 3  # full_text includes the distinct headline
    with open(f"{d}/in/2.json", "w") as f:
        f.write(json.dumps({"id": "9", "title": "Headline number 0", "content": "same body text"}) + "\n")
    q = start_ingest(spark, f"{d}/in", f"{d}/out", f"{d}/chk")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{d}/out/articles").count() == 4
    assert Store(spark, f"{d}/out/vectors").read().count() == first  # same text: not encoded again


def test_streaming_batch_replay_is_idempotent(spark):
    from storyloom.streaming.incremental import _write_batch_partition
    d = _tmp()
    df = spark.createDataFrame([("k1", 0), ("k2", 0)], "key string, batch_id long")
    _write_batch_partition(df, f"{d}/t")
    _write_batch_partition(df, f"{d}/t")          # the same batch written again
    _write_batch_partition(spark.createDataFrame([("k3", 1)], "key string, batch_id long"), f"{d}/t")
    assert sorted(r.key for r in spark.read.parquet(f"{d}/t").collect()) == ["k1", "k2", "k3"]


def test_storyline_documents_written_as_json(spark):
    from pyspark.sql import Window
    from storyloom.operators import storyline
    d = _tmp()
    topics = spark.createDataFrame([(1, "metro"), (2, "empty topic")], "topic_id long, topic string")
    rows = [(1, 1, "a", "Metro phase opens crisis looms", "x", "2024-01-05T00:00:00", "", "S1", 10.0, 0.9),
            (1, 2, "b", "Metro phase delays announced today", "y", "2024-02-01T00:00:00", "", "S2", 0.0, 0.5)]
    ta = spark.createDataFrame(rows, "topic_id long, rank int, id string, headline string, full_text string, date string, "
                                     "url string, source string, source_rating double, similarity_score double")
    ta = ta.withColumn("pos", F.row_number().over(Window.partitionBy("topic_id").orderBy("date", "rank")))
    gen = spark.createDataFrame([(1, "Generated [1].")], "topic_id long, summary string")
    docs = storyline.storyline_documents(topics, ta, "2024-02-03", gen)
    sinks.write_storylines(docs, f"{d}/docs")
    back = {r.topic_id: r for r in spark.read.json(f"{d}/docs").collect()}
    assert back[1].generation_mode == "rag_vllm" and back[1].narrative_summary == "Generated [1]."
    assert [t.headline for t in back[1].timeline] == ["Metro phase opens crisis looms", "Metro phase delays announced today"]
    assert back[1].graph.node_count == 2
    assert back[2].generation_mode == "heuristic"
    assert back[2].narrative_summary == "No relevant articles found for topic: empty topic"
    assert back[2].clusters[0].theme == "General Coverage" and back[2].graph.node_count == 0


def test_pipelines_end_to_end(spark):
    from storyloom.plans import pipelines
    from tests.test_endpoints import COLLECTION
    d = _tmp()
    arts = [{"id": str(i + 1), "title": f"Metro line {w} opens downtown", "content": f"The metro {w} story", "published_at": f"2024-01-{10 + i}T00:00:00Z",
             "source_rating": 5} for i, w in enumerate(["north", "south", "east"])]
    with open(f"{d}/news.json", "w") as f:
        json.dump({"items": arts}, f)
    topics = spark.createDataFrame([(1, "metro line north"), (2, "unrelated zzz")], "topic_id long, topic string")
    docs = {r.topic_id: r for r in pipelines.storylines(spark, f"{d}/news.json", topics, "2024-01-15").collect()}
    assert docs[1].generation_mode == "heuristic" and len(docs[1].timeline) == 3
    # A topic without any shared term still gets min(k, n) articles, with score 0.
    assert len(docs[2].timeline) == 3
    gen = lambda batch: ['{"summary": "Metro [1].", "timeline": [{"id": "1", "why_it_matters": "first"}]}' for _ in batch]
    docs = {r.topic_id: r for r in pipelines.storylines(spark, f"{d}/news.json", topics, "2024-01-15", generate_fn=gen).collect()}
    assert docs[1].generation_mode == "rag_vllm" and docs[1].narrative_summary == "Metro [1]."
    assert [t.why_it_matters for t in docs[1].timeline if t.headline.endswith("north opens downtown")] == ["first"]
    with open(f"{d}/api.json", "w") as f:
        json.dump(COLLECTION, f)
    q = spark.createDataFrame([(7, "get items id")], "topic_id long, topic string")
    hits = sorted(pipelines.search_docs(spark, f"{d}/api.json", q).collect(), key=lambda r: r.rank)
    assert hits[0].metadata.endpoint_name == "Get one" and hits[0].rank == 1


def test_unknown_fields_survive_to_the_storylines(spark):
    from storyloom.plans import pipelines
    d = _tmp()
    rows = [{"id": i, "title": f"Harbour report number {i}", "content": "tide", "region": {"code": f"r{i}"}, "source_rating": i} for i in range(4)]
    with open(f"{d}/news.json", "w") as f:
        json.dump({"data": rows}, f)
    arts, seen = pipelines.load_articles(spark, f"{d}/news.json", min_rating=2)
    assert seen == {"total_read": 4, "rating_passed": 2, "kept": 2}
    assert sorted(r[0] for r in arts.select(F.variant_get("raw", "$.region.code", "string")).collect()) == ["r2", "r3"]
    topics = spark.createDataFrame([(1, "harbour report"), (2, "harbour")], "topic_id long, topic string")
    for r in pipelines.storylines(spark, f"{d}/news.json", topics, "2024-01-15").collect():
        assert sorted(json.loads(s.raw)["region"]["code"] for s in r.sources) == ["r0", "r1", "r2", "r3"]


def test_evaluation_run_from_files(spark):
    from storyloom.operators import clean
    from storyloom.plans import pipelines
    d = _tmp()
    with open(f"{d}/golden.jsonl", "w") as f:
        f.write('# comment\n\n{"topic": "harbour tide", "reference": "Tide rose. Ships left"}\n{"topic": "no reference"}\nnot json\n')
    raw = spark.createDataFrame([("1", "Harbour closed by the tide", "Tide rose. Later it fell"), ("2", "Harbour open again today", "calm")], "id string, title string, content string")
    gen = lambda batch: ['{"summary": "Closed [1], open [2].", "timeline": []}' for _ in batch]

    def judge(samples, sources):
        t = samples.select("topic_id")
        return {"claims": t.select("topic_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("supported")),
                "questions": t.select("topic_id", F.lit(0.25).alias("cosine")),
                "contexts": sources.select("topic_id", "rank", (F.col("rank") == 2).alias("useful")),
                "statements": t.select("topic_id", F.explode(F.array(F.lit(True), F.lit(True), F.lit(False), F.lit(True))).alias("attributed"))}

    per_query, aggregate = pipelines.evaluation_run(spark, f"{d}/golden.jsonl", clean.clean_articles(raw), gen, judge, f"{d}/out")
    row = per_query.first()
    assert per_query.count() == 1 and row.user_input == "harbour tide"
    assert (row.faithfulness, row.answer_relevancy, row.context_precision, row.context_recall) == (0.5, 0.25, 0.5, 0.75)
    assert spark.read.json(f"{d}/out/per_query").count() == 1
    assert spark.read.json(f"{d}/out/aggregate").first().results_path == f"{d}/out"
    with open(f"{d}/empty.jsonl", "w") as f:
        f.write("# nothing\n")
    try:
        pipelines.evaluation_run(spark, f"{d}/empty.jsonl", clean.clean_articles(raw), gen, judge, f"{d}/out2")
        raise AssertionError("an empty golden set must be refused")
    except ValueError:
        pass


def test_dense_storylines_reuse_stored_vectors(spark):
    from storyloom.plans import pipelines
    d = _tmp()
    arts = [{"title": f"Council votes on the {w} budget", "content": w * 3, "published_at": f"2024-02-0{i + 1}"} for i, w in enumerate(["harbour", "school", "library"])]
    arts.append({"title": "Council votes on the school budget", "content": "second report", "published_at": "2024-02-09"})
    with open(f"{d}/news.json", "w") as f:
        json.dump(arts, f)

    def make_encoder():
        import numpy as np
        import zlib

        def encode(texts):
            out = np.zeros((len(texts), 16), np.float32)
            for i, t in enumerate(texts):
                for w in str(t).lower().split():
                    out[i, zlib.crc32(w.encode()) % 16] += 1
            return out
        return encode

    topics = spark.createDataFrame([(1, "Council votes on the school budget"), (2, "the library")], "topic_id long, topic string")
    retrieve = pipelines.dense_hits(f"{d}/vectors", make_encoder, 16, "toy")
    plain = pipelines.dense_hits(f"{d}/hashed")
    for docs in [{r.topic_id: r for r in pipelines.storylines(spark, f"{d}/news.json", topics, "2024-02-10", k=2, retrieve=plain).collect()}]:
        assert sum("school" in t.headline for t in docs[1].timeline) == 2
    for _ in range(2):
        docs = {r.topic_id: r for r in pipelines.storylines(spark, f"{d}/news.json", topics, "2024-02-10", k=3, retrieve=retrieve).collect()}
        assert all(len(r.timeline) == 3 for r in docs.values())
        assert sum("school" in t.headline for t in docs[1].timeline) == 2
    assert Store(spark, f"{d}/vectors").read().count() == 4

"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query reads the given tables (through the adapters in ``sources.testbed``) and
runs over all of their rows.  Output columns are scalars with the same names as the
matching statement in ``plans.oracle``; scores are rounded to 6 decimals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.text import source_from_url
from storyloom.operators import clean, search
from storyloom.plans import params as P
from storyloom.session import ensure_checkpoint_dir, ship_package
from storyloom.sources import testbed
from storyloom.sources.store import corpus_version


def _round(c: str = "similarity_score", name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def articles(spark: SparkSession, sf_dir: str, min_rating: float = P.MIN_RATING) -> DataFrame:
    return clean.clean_articles(testbed.raw_articles(spark, sf_dir), min_rating=min_rating)


def centroid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = search.label_centroids(testbed.dense_vectors(spark, sf_dir))
    return cents.select(F.col("list_id").alias("topic_id"), F.col("centroid").alias("embedding"))


# ------------------------------------------------------------------ queries
def q_vector_topk(spark, sf_dir):
    corpus = testbed.dense_vectors(spark, sf_dir)
    hits = search.search(centroid_queries(spark, sf_dir), corpus, P.DENSE_K, normalize_queries=False)
    return hits.select("topic_id", "rank", "id", _round())


def q_clean_articles(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("id", "headline", "content", "full_text", "date", "url", "source",
                    _round("source_rating"), "author", "category")


def q_load_accounting(spark, sf_dir):
    return clean.load_accounting(testbed.raw_articles(spark, sf_dir), P.ACCOUNTING_MIN_RATING)


def q_article_stats(spark, sf_dir):
    from storyloom.operators import stats
    st = stats.article_statistics(articles(spark, sf_dir))
    return st.withColumn("avg_content_length", F.round("avg_content_length", 6))


def q_source_from_url(spark, sf_dir):
    p = testbed.page_urls(spark, sf_dir)
    return p.select("page_id", "url", F.coalesce(source_from_url(F.col("url")), F.lit("Unknown")).alias("source"))




# ------------------------------------------------------------------ text search + storylines
def story_inputs(spark: SparkSession, sf_dir: str, k: int = P.STORY_K, with_articles: bool = True):
    """``(topics, articles, hits, topic_articles)`` for the storyline queries."""
    from storyloom.operators import embed, storyline

    arts = articles(spark, sf_dir)
    tps = testbed.topics(spark, sf_dir)
    doc_tv = embed.term_lists(arts.withColumn("row_key", clean.row_key()), "id", "full_text", carry=["row_key"])
    topic_tv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    # The hit list feeds many branches (replies, grounding, contexts, storylines); it is
    # written once to the checkpoint folder so each branch reads k rows per topic
    # instead of re-running the search.
    hits = search.text_topk(topic_tv, doc_tv, k, carry=["row_key"]).checkpoint()
    # Topic articles (k rows per topic) are read by a dozen storyline branches; one
    # article scan fills them, the branches read the checkpoint.
    ta = storyline.topic_articles(hits, arts).checkpoint() if with_articles else None
    return tps, arts, hits, ta


def q_text_cosine_topk(spark, sf_dir):
    _, _, hits, _ = story_inputs(spark, sf_dir, with_articles=False)
    return hits.select("topic_id", "rank", "id", _round())


def q_text_threshold(spark, sf_dir):
    """Text search that only scores documents which can reach the threshold."""
    from storyloom.operators import embed
    doc_tv = embed.term_lists(articles(spark, sf_dir), "id", "full_text")
    topic_tv = embed.term_vectors(testbed.topics(spark, sf_dir), "topic_id", "topic").withColumnRenamed("id", "topic_id")
    return search.text_topk(topic_tv, doc_tv, P.STORY_K, threshold=P.THRESHOLD).select("topic_id", "rank", "id", _round())


def q_timeline(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.timeline(ta, P.AS_OF)


def q_top_sources(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.top_sources(ta)


def q_peak_month(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.peak_month(ta)


def q_narrative_arc(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.topic_stats(ta)


def q_keyword_counts(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.keyword_counts(ta)


def q_relation_edges(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.relation_edges(ta).select("topic_id", "source", "target", "relation", "weight")


def q_graph_counts(spark, sf_dir):
    from storyloom.operators import storyline
    tps, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.graph_counts(tps, ta, storyline.relation_edges(ta))


def q_key_events(spark, sf_dir):
    from storyloom.operators import storyline
    _, _, _, ta = story_inputs(spark, sf_dir)
    ke = storyline.key_events(ta)
    return ke.select("topic_id", F.posexplode("key_events").alias("event_pos", "event")) \
             .select("topic_id", (F.col("event_pos") + 1).alias("event_pos"), "event")


def q_keyword_clusters(spark, sf_dir):
    from storyloom.operators import storyline
    tps, _, _, ta = story_inputs(spark, sf_dir)
    cl = storyline.keyword_clusters(tps, ta)
    return cl.select("topic_id", "cluster_id", "theme", "article_count",
                     F.array_join("articles", ",").alias("articles"),
                     F.array_join("key_terms", ",").alias("key_terms"))


def q_summary_text(spark, sf_dir):
    from storyloom.operators import storyline
    tps, _, _, ta = story_inputs(spark, sf_dir)
    return storyline.heuristic_summary(tps, ta).select("topic_id", F.col("heuristic_summary").alias("summary"))


def q_storyline_docs(spark, sf_dir):
    from storyloom.operators import storyline
    tps, _, _, ta = story_inputs(spark, sf_dir)
    docs = storyline.storyline_documents(tps, ta, P.AS_OF)
    return docs.select(
        "topic_id", "generation_mode", "narrative_summary",
        F.size("timeline").alias("timeline_count"),
        F.size("clusters").alias("cluster_count"),
        F.col("graph.node_count").alias("node_count"),
        F.col("graph.edge_count").alias("edge_count"),
        F.element_at("timeline", 1)["headline"].alias("first_headline"),
        F.array_join(F.transform("clusters", lambda c: c["theme"]), "|").alias("themes"))


def q_storyline_files(spark, sf_dir):
    """Storyline documents written as JSON and read back."""
    from storyloom.operators import storyline
    from storyloom.sources import sinks
    folder = _store(spark, "storylines")
    tps, _, _, ta = story_inputs(spark, sf_dir)
    docs = storyline.storyline_documents(tps, ta, P.AS_OF)
    sinks.write_storylines(docs, folder)
    return spark.read.schema(docs.schema).json(folder).select("topic_id", "generation_mode", "narrative_summary", F.size("timeline").alias("timeline_count"))


def q_section_pack(spark, sf_dir):
    from storyloom.operators import endpoints
    docs = testbed.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = endpoints.split_large(docs, "text", P.CHUNK_MAX_CHARS, sep=P.SECTION_SEP)
    return parts.select("doc_id", "part", F.col("text").alias("part_text"), F.length("text").alias("part_len"))


def q_vector_neighbors(spark, sf_dir):
    corpus = testbed.dense_vectors(spark, sf_dir)
    top1 = search.dense_topk(centroid_queries(spark, sf_dir), corpus, 1, normalize_queries=False)
    nb = search.neighbours(corpus, top1.select("id"), P.DENSE_K)
    return nb.select("anchor_id", "rank", "id", _round())


def q_vector_similarity_pairs(spark, sf_dir):
    corpus = testbed.dense_vectors(spark, sf_dir)
    hits = search.dense_topk(centroid_queries(spark, sf_dir), corpus, P.DENSE_K, normalize_queries=False)
    pairs = search.similarity_pairs(hits.select("topic_id", "id"), corpus)
    return pairs.select("topic_id", "id1", "id2", _round("similarity"))


queries_batch2 = {
    "text_cosine_topk": q_text_cosine_topk,
    "text_threshold": q_text_threshold,
    "timeline": q_timeline,
    "top_sources": q_top_sources,
    "peak_month": q_peak_month,
    "narrative_arc": q_narrative_arc,
    "keyword_counts": q_keyword_counts,
    "relation_edges": q_relation_edges,
    "graph_counts": q_graph_counts,
    "key_events": q_key_events,
    "keyword_clusters": q_keyword_clusters,
    "summary_text": q_summary_text,
    "storyline_docs": q_storyline_docs,
    "storyline_files": q_storyline_files,
    "section_pack": q_section_pack,
    "vector_neighbors": q_vector_neighbors,
    "vector_similarity_pairs": q_vector_similarity_pairs,
}


# ------------------------------------------------------------------ generation and grounding
def grounding_inputs(spark: SparkSession, sf_dir: str, k: int = P.STORY_K, with_articles: bool = False):
    from storyloom.operators import grounding

    tps, arts, hits, ta = story_inputs(spark, sf_dir, k, with_articles)
    replies = testbed.synthetic_replies(tps, hits)
    parsed = grounding.extract_json(replies)
    # One row per (topic, attempt), read by the attempt choice, the cleaned timeline
    # and the evaluation branches.
    report = grounding.check_grounding(parsed, hits).checkpoint()
    return tps, arts, hits, ta, report


def q_reply_json(spark, sf_dir):
    from storyloom.operators import grounding
    tps, _, hits, _ = story_inputs(spark, sf_dir, with_articles=False)
    parsed = grounding.extract_json(testbed.synthetic_replies(tps, hits))
    return parsed.select("topic_id", "attempt", "parsed", "summary", F.size("timeline").alias("n_timeline"),
                         F.array_join(F.transform("timeline", lambda e: e["id"]), ",").alias("timeline_ids"))


def q_grounding_report(spark, sf_dir):
    _, _, _, _, report = grounding_inputs(spark, sf_dir)
    return report.select("topic_id", "attempt", "n_sources", "n_cited", "bad_citations", "n_bad_timeline",
                         "grounded", "feedback")


def q_best_attempt(spark, sf_dir):
    from storyloom.operators import grounding
    tps, _, hits, _, report = grounding_inputs(spark, sf_dir)
    final, _ = grounding.final_generation(tps, report, hits, P.MAX_ATTEMPTS)
    return final


def q_clean_timeline(spark, sf_dir):
    from storyloom.operators import grounding
    tps, _, hits, _, report = grounding_inputs(spark, sf_dir)
    _, tl = grounding.final_generation(tps, report, hits, P.MAX_ATTEMPTS)
    return tl.select("topic_id", "entry_pos", "id", "why_it_matters")


def q_context_blocks(spark, sf_dir):
    from storyloom.operators import grounding
    _, _, _, ta = story_inputs(spark, sf_dir)
    cb = grounding.context_blocks(ta, P.CONTEXT_CHARS)
    return cb.select("topic_id", "n_sources", "context_block")


def q_generation_mode(spark, sf_dir):
    from storyloom.operators import grounding, storyline
    tps, _, hits, ta, report = grounding_inputs(spark, sf_dir, with_articles=True)
    final, _ = grounding.final_generation(tps, report, hits, P.MAX_ATTEMPTS)
    hs = storyline.heuristic_summary(tps, ta)
    use_gen = F.coalesce(F.col("summary"), F.lit("")) != ""
    j = hs.join(final.select("topic_id", "summary"), "topic_id", "left")
    return j.select("topic_id", F.when(use_gen, F.lit(storyline.MODE_GENERATED)).otherwise(F.lit(storyline.MODE_HEURISTIC)).alias("generation_mode"),
                    F.when((F.col("article_count") > 0) & use_gen, F.col("summary")).otherwise(F.col("heuristic_summary")).alias("narrative_summary"))


def q_timeline_reasons(spark, sf_dir):
    """Timeline whose reasons come from the accepted generation when there is one."""
    from storyloom.operators import grounding, storyline
    tps, _, hits, ta, report = grounding_inputs(spark, sf_dir, with_articles=True)
    final, tl = grounding.final_generation(tps, report, hits, P.MAX_ATTEMPTS)
    gen_topics = final.filter(F.coalesce(F.col("summary"), F.lit("")) != "").select("topic_id")
    reasons = tl.join(gen_topics, "topic_id", "left_semi")
    return storyline.timeline(ta, P.AS_OF, reasons).select("topic_id", "pos", "id", "why_it_matters")


queries_batch3 = {
    "reply_json": q_reply_json,
    "grounding_report": q_grounding_report,
    "best_attempt": q_best_attempt,
    "clean_timeline": q_clean_timeline,
    "context_blocks": q_context_blocks,
    "generation_mode": q_generation_mode,
    "timeline_reasons": q_timeline_reasons,
}


# ------------------------------------------------------------------ evaluation
def eval_inputs(spark: SparkSession, sf_dir: str):
    from storyloom.operators import evaluate, grounding

    tps, _, hits, ta, report = grounding_inputs(spark, sf_dir, P.EVAL_K, with_articles=True)
    final, _ = grounding.final_generation(tps, report, hits, P.MAX_ATTEMPTS)
    cb = grounding.context_blocks(ta, P.CONTEXT_CHARS)
    eval_rows = tps.select("topic_id", "topic", F.col("topic").alias("reference"))
    # One row per topic, read by all four metric branches.
    return ta, evaluate.samples(eval_rows, final, cb).checkpoint()


def q_eval_samples(spark, sf_dir):
    _, smp = eval_inputs(spark, sf_dir)
    return smp.select("topic_id", "user_input", "response", F.size("retrieved_contexts").alias("n_contexts"),
                      F.array_join("retrieved_contexts", "\n||\n").alias("contexts"), "reference")


def _per_query(spark, sf_dir):
    from storyloom.operators import evaluate
    ta, smp = eval_inputs(spark, sf_dir)
    return evaluate.per_query(smp, testbed.derived_verdicts(smp, ta))


def q_eval_metrics(spark, sf_dir):
    from storyloom.operators.evaluate import METRICS
    pq = _per_query(spark, sf_dir)
    return pq.select("topic_id", "user_input", *[F.round(m, 6).alias(m) for m in METRICS])


def q_eval_aggregate(spark, sf_dir):
    from storyloom.operators import evaluate
    return evaluate.aggregate(_per_query(spark, sf_dir))


# ------------------------------------------------------------------ partitioned search, endpoints, caches
def q_ivf_topk(spark, sf_dir):
    corpus = testbed.dense_vectors(spark, sf_dir)
    # The centroids are the index model (one row per list), read three times below.
    cents = search.label_centroids(corpus).checkpoint()
    assigned = search.assign_lists(corpus, cents)
    queries_ = cents.select(F.col("list_id").alias("topic_id"), F.col("centroid").alias("embedding"))
    hits = search.ivf_topk(queries_, assigned, cents, P.DENSE_K, nprobe=P.IVF_NPROBE, normalize_queries=False)
    return hits.select("topic_id", "rank", "id", _round())


def _endpoints(spark, sf_dir):
    from storyloom.operators import endpoints
    return endpoints.extract_endpoints(testbed.page_collections(spark, sf_dir))


def q_endpoint_rows(spark, sf_dir):
    e = _endpoints(spark, sf_dir)
    return e.select("collection_id", "endpoint_path", "name", "category", "method", "url", "description",
                    F.size("parameters").alias("n_parameters"),
                    F.array_join(F.transform("parameters", lambda p: F.concat(p["key"], F.lit("="), p["description"], F.lit(":"), p["disabled"].cast("string"))), ",").alias("parameters"),
                    F.array_join(F.transform("path_variables", lambda v: F.concat(v["key"], F.lit(":"), v["type"])), ",").alias("path_variables"),
                    F.array_join(F.transform("response_examples", lambda r: F.concat(r["name"], F.lit(":"), r["code"].cast("string"), F.lit(":"), r["status"])), ",").alias("responses"))


def q_endpoint_chunks(spark, sf_dir):
    from storyloom.operators import endpoints
    ch = endpoints.endpoint_chunks(_endpoints(spark, sf_dir))
    return ch.select("collection_id", "endpoint_path", "part", "text", F.col("metadata.endpoint_name").alias("endpoint_name"),
                     F.col("metadata.category").alias("category"), F.col("metadata.method").alias("method"),
                     F.col("metadata.url").alias("url"))


def _term_embed(todo: DataFrame) -> DataFrame:
    from storyloom.operators import embed
    return embed.term_vectors(todo, "key", "full_text").withColumnRenamed("id", "key")


def _store(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_incremental_embed(spark, sf_dir):
    """Two loads: January articles first, then every article; the second load encodes
    only texts whose (model, text) key is not stored yet, and duplicate texts once."""
    from storyloom.operators import embed
    folder = _store(spark, "vectors")
    arts = articles(spark, sf_dir).select("id", "full_text", "date")
    embed.embed_with_store(arts.filter(F.substring("date", 1, 7) == "2024-01"), folder, P.MODEL_NAME, _term_embed)
    out = embed.embed_with_store(arts, folder, P.MODEL_NAME, _term_embed)
    return out.select("id", "key", F.size("terms").alias("n_terms"), "sumsq", F.when(F.col("fresh"), 2).otherwise(1).alias("round"))


def q_answer_reuse(spark, sf_dir):
    """Two request batches: topics starting with A-M first, then all topics; answers of
    the first batch are served from the store, only the rest are searched."""
    from storyloom.operators import embed
    arts = articles(spark, sf_dir)
    # The document vectors are the index both request batches search: built once.
    doc_tv = embed.term_vectors(arts, "id", "full_text").checkpoint()

    def run(todo: DataFrame) -> DataFrame:
        tv = embed.term_vectors(todo, "key", "topic").withColumnRenamed("id", "topic_id")
        h = search.text_topk(tv, doc_tv, P.DOC_SEARCH_K)
        return h.select(F.col("topic_id").alias("key"), "rank", "id", "similarity_score")

    folder = _store(spark, "answers")
    tps = testbed.topics(spark, sf_dir)
    version = corpus_version(arts, "id", "full_text")
    first = tps.filter(F.upper(F.substring("topic", 1, 1)).between("A", "M"))
    search.cached_search(first, folder, run, P.DOC_SEARCH_K, P.MODEL_NAME, version)
    answers = search.cached_search(tps, folder, run, P.DOC_SEARCH_K, P.MODEL_NAME, version)
    return answers.select("topic_id", "key", "rank", "id", _round(), F.when(F.col("fresh"), "fresh").otherwise("store").alias("served_from"))


def q_vector_stats(spark, sf_dir):
    """A8 + V4: vector count and dimension, and vectors vs. documents as their items, both ways."""
    from storyloom.operators import embed
    from storyloom.operators import stats
    v = testbed.dense_vectors(spark, sf_dir)
    align = embed.check_alignment(v, testbed.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 64)
    return stats.vector_statistics(v).crossJoin(align)


def q_article_validation(spark, sf_dir):
    """Articles with both headline and content vs. the quarantine."""
    ok = clean.is_complete()
    return articles(spark, sf_dir).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("quarantined"))


# ------------------------------------------------------------------ block products, stored index, whole runs
def _every_nth(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("id") % P.SEARCH_STEP == 0)


def q_vector_self_topk(spark, sf_dir):
    """T6 for many anchors: every row whose id is divisible by 20, against all other rows."""
    corpus = testbed.dense_vectors(spark, sf_dir)
    return search.neighbours(corpus, _every_nth(corpus), P.DENSE_K).select("anchor_id", "rank", "id", _round())


def q_ivf_recall(spark, sf_dir):
    """A trained index is stored, its number of probes chosen on other queries and
    searched; one row says whether it finds enough of the exact hits."""
    corpus = testbed.dense_vectors(spark, sf_dir)
    folder = _store(spark, "index")
    search.build_index(corpus, folder)
    trial = corpus.where(F.col("id") % P.TRIAL_STEP == 7).select(F.col("id").alias("topic_id"), "embedding")
    nprobe = search.probes_for_recall(trial, corpus, folder, P.DENSE_K, P.TRIAL_RECALL)
    asked = _every_nth(corpus).select(F.col("id").alias("topic_id"), "embedding")
    exact = search.search(asked, corpus, P.DENSE_K)
    found = search.search(asked, corpus, P.DENSE_K, mode="ivf", nprobe=nprobe, folder=folder)
    both = exact.join(found.select("topic_id", "id", F.lit(1).alias("hit")), ["topic_id", "id"], "left")
    return both.agg(F.countDistinct("topic_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"),
                    (F.count("hit") >= P.RECALL * F.count(F.lit(1))).alias("enough_found"))


def q_encode_documents(spark, sf_dir):
    """V1, V3: every article's vector of the built-in encoder, summed up."""
    from storyloom.operators import embed
    v = embed.hashed_vectors(articles(spark, sf_dir), "id", "full_text", P.HASHED_DIM)
    size = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    used = F.size(F.filter("embedding", lambda x: x != 0))
    top = F.array_position("embedding", F.array_max("embedding")) - 1
    return v.select("id", used.alias("n_used"), F.round(size, 6).alias("l1"), F.when(used > 0, top).alias("top_dimension"))


def _counting_encoder():
    """A caller's encoder: characters and letters e of each text."""
    import numpy as np
    return lambda texts: np.array([[len(t), t.count("e")] for t in map(str, texts.ravel())], np.float32)


def q_encoder_hook(spark, sf_dir):
    """V1: articles through a caller's encoder in Arrow batches."""
    from storyloom.operators import embed
    v = embed.encode(articles(spark, sf_dir).select("id", "full_text"), "full_text", _counting_encoder, 2, normalize_output=False)
    return v.select("id", F.get("embedding", F.lit(0)).cast("long").alias("n_chars"), F.get("embedding", F.lit(1)).cast("long").alias("n_e"))


def q_dense_story(spark, sf_dir):
    """Topics against articles on stored vectors of the built-in encoder."""
    from storyloom.plans import pipelines
    arts = articles(spark, sf_dir).withColumn("row_key", clean.row_key())
    hits = pipelines.dense_hits(_store(spark, "hashed"), dim=P.HASHED_DIM)(testbed.topics(spark, sf_dir), arts, P.DENSE_K)
    return hits.select("topic_id", "rank", "id", _round())


def q_doc_search(spark, sf_dir):
    """S2, T8 and the documentation route: stored chunks, searched twice; the second call answers from the store."""
    from storyloom.operators import endpoints
    from storyloom.plans import pipelines
    folder, answers = _store(spark, "chunks"), _store(spark, "answers")
    pages = testbed.page_urls(spark, sf_dir)
    asked = pages.where(F.col("page_id") % P.SEARCH_STEP == 0).select(F.col("page_id").alias("topic_id"), F.col("url").alias("topic"))
    version = pipelines.store_chunks(endpoints.endpoint_chunks(endpoints.extract_endpoints(testbed.page_collections(spark, sf_dir))), folder)
    pipelines.search_chunks(asked, folder, version, P.DOC_SEARCH_K, answers)
    hits = pipelines.search_chunks(asked, folder, version, P.DOC_SEARCH_K, answers)
    return hits.select("topic_id", "rank", _round(), F.col("metadata.endpoint_name").alias("endpoint_name"), "fresh")


def q_readable_hits(spark, sf_dir):
    """The documentation hits as text blocks with their rules."""
    from storyloom.operators import endpoints
    from storyloom.plans import pipelines
    from storyloom.sources import sinks
    folder = _store(spark, "chunks")
    asked = testbed.page_urls(spark, sf_dir).where(F.col("page_id") % P.SEARCH_STEP == 0).select(F.col("page_id").alias("topic_id"), F.col("url").alias("topic"))
    version = pipelines.store_chunks(endpoints.endpoint_chunks(endpoints.extract_endpoints(testbed.page_collections(spark, sf_dir))), folder)
    return sinks.hits_readable(pipelines.search_chunks(asked, folder, version, P.DOC_SEARCH_K)).select("topic_id", "rank", F.col("value").alias("block"))


def q_missing_ids(spark, sf_dir):
    """Articles without an id, or with 0, get the hash of what they tell."""
    raw = testbed.raw_articles(spark, sf_dir)
    number = F.col("id").cast("long") % 3
    bare = raw.withColumn("id", F.when(number == 1, F.lit("0")).when(number == 2, F.col("id")))
    return clean.clean_articles(bare).select("id", "headline", "date")


def q_short_labels(spark, sf_dir):
    """Document texts cut to a label, and lengths clamped to a share."""
    from storyloom.functions.text import clamp, ellipsis
    docs = testbed.read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", ellipsis(F.col("text"), 40).alias("label"), clamp(F.col("n_chars") / 1000.0 - 0.5).alias("share"))


def q_label_similarity(spark, sf_dir):
    """T7 on large sets: all pairs of vectors of a label, summed up."""
    corpus = testbed.dense_vectors(spark, sf_dir)
    pairs = search.similarity_pairs(corpus.select(F.col("label").alias("topic_id"), "id"), corpus)
    return pairs.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("similarity"), 6).alias("mean_similarity"),
                                         F.round(F.max("similarity"), 6).alias("max_similarity"), F.round(F.min("similarity"), 6).alias("min_similarity"))


def q_article_raw(spark, sf_dir):
    """Articles from JSON files; fields that the cleaner does not know, out of the whole article."""
    from storyloom.plans import pipelines
    folder = _store(spark, "feed")
    testbed.write_feed(spark, sf_dir, folder)
    arts, _ = pipelines.load_articles(spark, folder)
    told = lambda path, kind: F.try_variant_get("raw", path, kind)
    return arts.select("id", "headline", told("$.n_chars", "long").alias("n_chars"), told("$.meta.lang", "string").alias("meta_lang"), told("$.meta.source", "string").alias("meta_source"))


def q_feed_accounting(spark, sf_dir):
    """A7 observed while the articles are landed."""
    from storyloom.plans import pipelines
    folder = _store(spark, "feed")
    testbed.write_feed(spark, sf_dir, folder)
    _, seen = pipelines.load_articles(spark, folder, P.ACCOUNTING_MIN_RATING)
    return spark.createDataFrame([tuple(seen[c] for c in ("total_read", "rating_passed", "kept"))], "total_read long, rating_passed long, kept long")


def q_generate_loop(spark, sf_dir):
    """The live loop with a generator that answers to the prompt, over
    articles whose ids repeat, so that a topic's sources share ids."""
    from storyloom.operators import embed, grounding, storyline
    # Ids that are no numbers (hashes of articles without an id) count by their checksum.
    number = F.coalesce(F.col("id").try_cast("long"), F.crc32(F.col("id").cast("binary")))
    arts = articles(spark, sf_dir).withColumn("id", (number % P.LOOP_IDS).cast("string"))
    tps = testbed.topics(spark, sf_dir)
    doc_tv = embed.term_lists(arts.withColumn("row_key", clean.row_key()), "id", "full_text", carry=["row_key"])
    hits = search.text_topk(embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id"), doc_tv, P.LOOP_K, carry=["row_key"]).checkpoint()
    sources = storyline.topic_articles(hits, arts).checkpoint()
    final, told = grounding.generate_grounded(tps, sources, testbed.reply_to_prompt, P.MAX_ATTEMPTS)
    n = sources.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_sources"))
    entries = told.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_timeline"))
    return final.join(n, "topic_id").join(entries, "topic_id", "left").select("topic_id", "attempt", "grounded", "summary", "n_sources", F.coalesce("n_timeline", F.lit(0)).alias("n_timeline"))


def q_evaluation_run(spark, sf_dir):
    """Golden set from files, generation, verdicts, metrics; read back from the files written."""
    from storyloom.operators.evaluate import METRICS
    from storyloom.plans import pipelines
    golden, out = _store(spark, "golden"), _store(spark, "evaluation")
    line = F.to_json(F.struct("topic", F.col("topic").alias("reference")))
    testbed.topics(spark, sf_dir).select(F.concat(F.lit("# a golden row\n"), line, F.lit("\n"))).write.text(golden)
    pipelines.evaluation_run(spark, golden, articles(spark, sf_dir), testbed.reply_to_prompt, testbed.derived_verdicts, out, P.EVAL_K, context_chars=P.CONTEXT_CHARS)
    rows = spark.read.schema("user_input string, " + ", ".join(f"{m} double" for m in METRICS)).json(f"{out}/per_query")
    return rows.select("user_input", *[F.round(m, 6).alias(m) for m in METRICS])


queries_batch4 = {
    "vector_self_topk": q_vector_self_topk,
    "ivf_recall": q_ivf_recall,
    "label_similarity": q_label_similarity,
    "doc_search": q_doc_search,
    "readable_hits": q_readable_hits,
    "missing_ids": q_missing_ids,
    "short_labels": q_short_labels,
    "encode_documents": q_encode_documents,
    "dense_story": q_dense_story,
    "encoder_hook": q_encoder_hook,
    "article_raw": q_article_raw,
    "feed_accounting": q_feed_accounting,
    "generate_loop": q_generate_loop,
    "evaluation_run": q_evaluation_run,
    "eval_samples": q_eval_samples,
    "eval_metrics": q_eval_metrics,
    "eval_aggregate": q_eval_aggregate,
    "ivf_topk": q_ivf_topk,
    "endpoint_rows": q_endpoint_rows,
    "endpoint_chunks": q_endpoint_chunks,
    "incremental_embed": q_incremental_embed,
    "answer_reuse": q_answer_reuse,
    "vector_stats": q_vector_stats,
    "article_validation": q_article_validation,
}



def _wide_ints(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Report every integral output column as BIGINT (positions, ranks and sizes are
    INT in Spark), so result schemas are the same whichever engine computes them."""
    from pyspark.sql import types as T

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)  # shared tables are materialised with checkpoint()
        ship_package(spark)
        df = fn(spark, sf_dir)
        small = (T.ByteType, T.ShortType, T.IntegerType)
        return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
                           for f in df.schema.fields])

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {
        "vector_topk": q_vector_topk,
        "clean_articles": q_clean_articles,
        "load_accounting": q_load_accounting,
        "article_stats": q_article_stats,
        "source_from_url": q_source_from_url,
    }
    out.update(queries_batch2)
    out.update(queries_batch3)
    out.update(queries_batch4)
    return {name: _wide_ints(fn) for name, fn in out.items()}

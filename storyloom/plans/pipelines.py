"""End-to-end jobs composed from the operators (the two flows of the matched tools).

* ``storylines``: news JSON -> landed Parquet -> cleaned articles -> term or encoder vectors
  -> top-k per topic -> optional generation with grounding -> one storyline document per topic.
* ``evaluation_run``: golden set -> retrieval -> grounded generation -> samples -> judge
  -> the four metrics, written per query and in aggregate.
* ``search_docs``: API collections -> endpoints -> chunks -> term vectors -> top-k chunks
  per query with text and metadata.

Both take a whole table of topics/queries at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from storyloom.operators import clean, embed, endpoints, evaluate, grounding, search, storyline
from storyloom.sources import news, sinks
from storyloom.sources.store import Store, corpus_version
from storyloom.session import ensure_checkpoint_dir

# Default number of hits (storylines / documentation search / evaluation).
STORY_TOP_K = 50
DOC_TOP_K = 5
EVAL_TOP_K = 20


def load_articles(spark: SparkSession, news_path: str | list[str], min_rating: float = 0.0) -> tuple[DataFrame, dict]:
    """(cleaned articles, accounting): the JSON is read once and landed as Parquet in the
    shared folder, with the whole article in ``raw``; the counts of A7 are observed while it
    is written, without a pass of their own."""
    landed = f"{ensure_checkpoint_dir(spark).rstrip('/')}/news-{uuid.uuid4().hex}"
    seen = Observation()
    rows = clean.with_raw_fields(news.read_news_json(spark, news_path))
    # The counts are taken below the write, in the same pass.
    news.land(rows.observe(seen, *clean.accounting(min_rating)), landed)
    return clean.clean_articles(spark.read.parquet(landed), min_rating=min_rating), seen.get


def text_hits(topics: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """Retriever on term vectors; ``articles`` has ``row_key``, which the hits carry."""
    doc_tv = embed.term_lists(articles, "id", "full_text", carry=["row_key"])
    topic_tv = embed.term_vectors(topics, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    return search.text_topk(topic_tv, doc_tv, k, carry=["row_key"])


def dense_hits(folder: str, make_encoder: Callable | None = None, dim: int = embed.HASHED_DIM, model: str | None = None, rebuild: bool = False) -> Callable:
    """Retriever on dense vectors, for ``storylines(retrieve=...)``: those of the built-in
    encoder (``embed.hashed_vectors``) or of a caller's (see ``embed.encode``, with ``model``
    as its name).

    Vectors of article texts are kept in ``folder``, keyed by model and text, so a later
    run encodes new texts only.
    """
    model = model or f"hashed-{dim}"

    def encode(todo: DataFrame) -> DataFrame:
        if make_encoder is None:
            return embed.hashed_vectors(todo, "key", "full_text", dim)
        return embed.encode(todo, "full_text", make_encoder, dim).select("key", "embedding")

    def retrieve(topics: DataFrame, articles: DataFrame, k: int) -> DataFrame:
        stored = embed.embed_with_store(articles.select("id", "row_key", "full_text"), folder, model, encode, rebuild=rebuild)
        if make_encoder is None:
            queries = embed.hashed_vectors(topics, "topic_id", "topic", dim)
        else:
            queries = embed.encode(topics, "topic", make_encoder, dim).select("topic_id", "embedding")
        return search.dense_topk(queries, stored, k, carry=["row_key"])

    return retrieve


def storylines(spark: SparkSession, news_path: str, topics: DataFrame, as_of: str, k: int = STORY_TOP_K,
               min_rating: float = 0.0, generate_fn: Callable | None = None,
               max_attempts: int = grounding.MAX_ATTEMPTS,
               retrieve: Callable[[DataFrame, DataFrame, int], DataFrame] = text_hits) -> DataFrame:
    """Storyline documents for every row of ``topics`` (``topic_id, topic``).

    The JSON is landed as Parquet (``load_articles``), and the documents' ``sources`` hold the
    articles with all their fields.  ``retrieve(topics,
    articles, k)`` gives ``(topic_id, rank, id, row_key, similarity_score)``: ``text_hits``,
    ``dense_hits(...)`` or the caller's own.  With ``generate_fn`` the summary and
    per-article reasons come from the generator after the grounding check (topics whose
    accepted summary is empty fall back to the heuristic summary); without it every topic
    is heuristic.
    """
    arts, _ = load_articles(spark, news_path, min_rating)
    hits = retrieve(topics, arts.withColumn("row_key", clean.row_key()), k).checkpoint()
    ta = storyline.topic_articles(hits, arts).checkpoint()
    generated, reasons = None, None
    if generate_fn is not None:
        final, tl = grounding.generate_grounded(topics, ta, generate_fn, max_attempts)
        generated = final.filter(F.coalesce(F.col("summary"), F.lit("")) != "")
        reasons = tl.join(generated.select("topic_id"), "topic_id", "left_semi")
    return storyline.storyline_documents(topics, ta, as_of, generated, reasons)


def evaluation_run(spark: SparkSession, eval_path: str, articles: DataFrame, generate_fn: Callable,
                   judge: Callable[[DataFrame, DataFrame], dict[str, DataFrame]], out: str, k: int = EVAL_TOP_K,
                   retrieve: Callable[[DataFrame, DataFrame, int], DataFrame] = text_hits,
                   max_attempts: int = grounding.MAX_ATTEMPTS, context_chars: int = grounding.CONTEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """S3, R1-R12, E1-E6 and S7 in one job: ``(per query, aggregate)``, also written to ``out``.

    ``eval_path``: the golden set (JSON lines of topic and reference).  ``judge(samples,
    sources)`` gives the verdict tables claims, questions, contexts and statements (see
    ``operators.evaluate``); sources are the retrieved articles of each topic.  A golden set
    without a usable row is an error.
    """
    ensure_checkpoint_dir(spark)
    rows, _ = evaluate.read_eval_set(spark, eval_path)
    golden = rows.withColumn("topic_id", F.monotonically_increasing_id()).checkpoint()
    if golden.isEmpty():
        raise ValueError(f"no usable rows in {eval_path}")
    topics = golden.select("topic_id", "topic")
    hits = retrieve(topics, articles.withColumn("row_key", clean.row_key()), k).checkpoint()
    sources = storyline.topic_articles(hits, articles).checkpoint()
    final, _ = grounding.generate_grounded(topics, sources, generate_fn, max_attempts, context_chars)
    samples = evaluate.samples(golden, final, grounding.context_blocks(sources, context_chars)).checkpoint()
    per_query = evaluate.per_query(samples, judge(samples, sources)).drop("topic_id").checkpoint()
    aggregate = evaluate.aggregate(per_query)
    sinks.write_evaluation(per_query, aggregate, out)
    return per_query, aggregate


def index_docs(spark: SparkSession, collection_path: str, folder: str) -> str:
    """Store the chunks of API collections with their term vectors; gives the corpus version.

    ``folder`` is a versioned store keyed by collection file, endpoint path, part and text:
    chunks that are stored already are not encoded again.  Chunks that the collections no
    longer hold are not hits (the version names those that count).
    """
    ensure_checkpoint_dir(spark)
    raw = spark.read.text(collection_path, wholetext=True).select(
        F.xxhash64("_metadata.file_path").alias("collection_id"), F.col("value").alias("json"))
    return store_chunks(endpoints.endpoint_chunks(endpoints.extract_endpoints(raw)), folder)


def store_chunks(chunks: DataFrame, folder: str) -> str:
    """Store ``endpoint_chunks`` rows (see ``index_docs``)."""
    named = chunks.withColumn("id", F.concat_ws(":", F.col("collection_id").cast("string"), "endpoint_path", F.col("part").cast("string")))
    keyed = named.withColumn("key", F.md5(F.concat_ws("|", "id", "text"))).select("key", "id", "text", "metadata").dropDuplicates(["key"]).checkpoint()
    version = corpus_version(keyed, "key")
    todo = Store(keyed.sparkSession, folder).missing(keyed)
    vectors = embed.term_vectors(todo.withColumn("chunk", F.struct("id", "text", "metadata")), "key", "text", carry=["chunk"])
    Store(keyed.sparkSession, folder).append(vectors.select(F.col("id").alias("key"), "chunk", "terms", "tf", "sumsq"))
    # The keys of this state of the collections, beside the store and named by the version.
    keyed.select("key").write.mode("overwrite").parquet(f"{folder}-{version}")
    return version


def search_chunks(queries: DataFrame, folder: str, version: str, k: int = DOC_TOP_K, answers: str | None = None) -> DataFrame:
    """Top-k stored chunks for every row of ``queries``: ``(topic_id, rank, similarity_score,
    text, metadata)``.  With ``answers`` (a store) queries that were answered for this
    version are not searched again."""
    spark = queries.sparkSession
    current = spark.read.parquet(f"{folder}-{version}")
    stored = Store(spark, folder).read().join(current, "key", "left_semi").select("chunk.*", "terms", "tf", "sumsq")

    def run(todo: DataFrame) -> DataFrame:
        tv = embed.term_vectors(todo, "key", "topic").withColumnRenamed("id", "topic_id")
        found = search.text_topk(tv, stored.select("id", "terms", "tf", "sumsq"), k)
        return found.select(F.col("topic_id").alias("key"), "rank", "id", "similarity_score")

    answers = answers or f"{ensure_checkpoint_dir(spark).rstrip('/')}/answers-{uuid.uuid4().hex}"
    hits = search.cached_search(queries, answers, run, k, "term-counts", version)
    return search.attach(hits, stored.select("id", "text", "metadata")).select("topic_id", "rank", "similarity_score", "text", "metadata", "fresh")


def search_docs(spark: SparkSession, collection_path: str, queries: DataFrame, k: int = DOC_TOP_K,
                folder: str | None = None, answers: str | None = None) -> DataFrame:
    """Top-k documentation chunks for every row of ``queries`` (``topic_id, topic``):
    ``(topic_id, rank, similarity_score, text, metadata)``.

    ``folder`` and ``answers`` keep the chunks' vectors and the answers for later calls.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    version = index_docs(spark, collection_path, folder)
    return search_chunks(queries, folder, version, k, answers).drop("fresh")

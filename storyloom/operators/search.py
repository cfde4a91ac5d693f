"""Top-k search for many queries at once.

Dense search is a product of matrices next to the vectors (``operators.dense``), or inside
the probed lists of a stored index (``operators.ivf``).  Text search is a sparse product in
Arrow batches, next to the documents, with a top-k per task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.vectors import list_slices
from storyloom.operators.dense import assign_lists, dense_topk, label_centroids, neighbours, rank_topk, similarity_pairs  # noqa: F401
from storyloom.operators.embed import _counted_terms
from storyloom.operators.ivf import DEFAULT_NPROBE, build_index, ivf_topk, probes_for_recall, search_index  # noqa: F401
from storyloom.session import ensure_checkpoint_dir, path_exists, ship_package
from storyloom.sources.store import Store

# Largest table broadcast by a hint, and topics of a text search sent to the tasks in one piece.
MAX_BROADCAST_BYTES = 64 << 20
MAX_TOPIC_BYTES = 16 << 20
MAX_TOPICS = 5_000
# Scores of a text search computed at once.
CELLS = 1 << 18


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table of scalars (strings as they are, 16 for other values and for each row)."""
    width = lambda f: F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 8 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16)
    total = F.lit(16)
    for f in df.schema.fields:
        total = total + width(f)
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).first()[0]


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its bytes, counted first, allow it."""
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df


def search(queries: DataFrame, corpus: DataFrame, k: int, mode: str = "flat",
           nprobe: int = DEFAULT_NPROBE, folder: str | None = None, **kw) -> DataFrame:
    """Mode choice (T4): ``flat`` is exact at every size; ``ivf``, a stored index with
    ``int(sqrt(n))`` trained lists, is approximate and only runs when asked for.  The index
    in ``folder`` is used if it is there, and otherwise built first.  Scores are inner
    products in both."""
    if mode not in ("flat", "ivf"):
        raise ValueError(f"unknown search mode {mode!r}")
    if mode == "flat":
        return dense_topk(queries, corpus, k, **kw)
    spark = corpus.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    if not path_exists(spark, f"{folder}/lists"):
        build_index(corpus, folder, c_id=kw.pop("c_id", "id"), c_vec=kw.pop("c_vec", "embedding"))
    return search_index(queries, folder, k, nprobe, **kw)


def reachable(row: np.ndarray, tf: np.ndarray, sumsq: np.ndarray, need: float) -> np.ndarray:
    """Documents whose cosine with some topic may be ``need`` or more, from (row, tf) of the
    terms they share with any topic: by Cauchy-Schwarz it is at most the norm of that part
    of the document over its whole norm."""
    shared = np.bincount(row, tf.astype(float) ** 2, len(sumsq))
    return np.flatnonzero(shared * (1 + 1e-9) >= max(need, 0.0) ** 2 * sumsq)


def _block_scorer(topics: pa.Table, k: int, keys: list[str], threshold: float = -np.inf) -> Callable:
    """Function over Arrow batches of document vectors: the task's ``k`` best rows of each topic.

    The topics' terms form an inverted index, so a slice of documents is scored by one
    gather and one weighted count; only ``k`` rows per topic are held between slices (of a
    bounded number of terms).
    Documents that no topic can want (below ``threshold``, or below the k-th score of every
    topic so far) are left out before they are scored.
    """
    cells, n_topics = CELLS, topics.num_rows

    def ranked(table: pa.Table) -> pa.Table:
        table = table.sort_by([("topic", "ascending"), ("similarity_score", "descending"), *((c, "ascending") for c in keys)])
        topic = table["topic"].to_numpy()
        return table.filter(pa.array(np.arange(len(topic)) - np.searchsorted(topic, topic) < k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.concat_arrays(topics["terms"].chunks)
        words, t_tf = lists.flatten(), pa.concat_arrays(topics["tf"].chunks).flatten().to_numpy(zero_copy_only=False)
        vocabulary = pc.unique(words)
        code = pc.index_in(words, vocabulary).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        post_topic = np.repeat(np.arange(n_topics), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[order]
        post_tf = t_tf[order].astype(float)
        begin = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        t_sumsq = topics["sumsq"].to_numpy().astype(float)
        floor = np.full(n_topics, threshold)
        held: list[pa.Table] = []
        for batch in list_slices(batches, "terms"):
            batch = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in keys]))
            n, lists = batch.num_rows, batch.column("terms")
            row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            code = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy(zero_copy_only=False)
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)
            known = code >= 0
            row, code, tf = row[known], code[known], tf[known].astype(float)
            if floor.min() > 0:
                wanted = reachable(row, tf, batch.column("sumsq").to_numpy(zero_copy_only=False).astype(float), floor.min())
                if len(wanted) < n:
                    place = np.full(n, -1)
                    place[wanted] = np.arange(len(wanted))
                    row = place[row]
                    there = row >= 0
                    row, code, tf = row[there], code[there], tf[there]
                    batch, n = batch.take(pa.array(wanted)), len(wanted)
            if not n:
                continue
            many = begin[code + 1] - begin[code]
            d_sumsq = batch.column("sumsq").to_numpy(zero_copy_only=False).astype(float)
            work = np.cumsum(np.maximum(n_topics, np.bincount(row, many, n)))
            borders = [0, *(np.flatnonzero(np.diff(work // cells)) + 1).tolist(), n]
            for lo, hi in zip(borders, borders[1:]):
                a, z = np.searchsorted(row, [lo, hi])
                m, width = many[a:z], hi - lo
                at = np.arange(m.sum()) + np.repeat(begin[code[a:z]] - (np.cumsum(m) - m), m)
                cell = post_topic[at] * width + np.repeat(row[a:z] - lo, m)
                dots = np.bincount(cell, np.repeat(tf[a:z], m) * post_tf[at], n_topics * width).reshape(n_topics, width)
                norm = np.sqrt(np.outer(t_sumsq, d_sumsq[lo:hi]))
                score = np.divide(dots, norm, out=np.zeros(dots.shape), where=norm > 0)
                open_ = np.flatnonzero((score >= floor[:, None]).any(axis=1))
                best = np.argsort(-score[open_], axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(score[open_], best, 1)
                keep = top >= floor[open_][:, None]
                found = {"topic": np.broadcast_to(open_[:, None], best.shape)[keep], "similarity_score": top[keep]}
                place = pa.array(best[keep] + lo)
                held.append(pa.table(found | {c: batch.column(c).take(place) for c in keys}))
                if sum(t.num_rows for t in held) >= 2 * n_topics * k:
                    held = [ranked(pa.concat_tables(held))]
                    count = np.bincount(held[0]["topic"].to_numpy(), minlength=n_topics)
                    last = np.cumsum(count) - 1
                    floor = np.where(count >= k, held[0]["similarity_score"].to_numpy()[np.maximum(last, 0)], threshold)
        if held:
            out = ranked(pa.concat_tables(held))
            ids = pa.concat_arrays(topics["topic_id"].chunks).take(pa.concat_arrays(out["topic"].chunks))
            yield from out.drop_columns("topic").add_column(0, "topic_id", ids).select(["topic_id", *keys, "similarity_score"]).to_batches()

    return run


def text_topk(topic_tv: DataFrame, doc_tv: DataFrame, k: int, carry: Sequence[str] = (),
              max_bytes: int = MAX_TOPIC_BYTES, max_topics: int = MAX_TOPICS, threshold: float | None = None) -> DataFrame:
    """Cosine top-k of term vectors: ``(topic_id, rank, id, *carry, similarity_score)``.

    Both inputs come from ``term_vectors`` (topics with their id renamed ``topic_id``);
    documents may also come from ``term_lists``, which are counted by the task that scores them.
    Documents are scored where they were read, a batch at a time, against the topics'
    inverted index; ``k`` rows per topic and task leave it, so the corpus is not shuffled.
    The index goes to the tasks whole; topics beyond ``max_bytes`` of terms or ``max_topics``
    rows are dealt into blocks by hash, one pass over the documents each; a block's hits are
    written before the next block is fetched, so only one is held.  Dot products and norms are exact integers, so equal texts get bit-identical scores.

    Every topic gets ``min(k, n)`` hits: documents without a shared term score 0 and fill
    up by id.  With ``threshold`` (T9) only hits of that score or more count, and documents
    that cannot reach it are not scored.  Ties go by id, then by the ``carry`` columns of ``doc_tv`` (kept in the
    hits, to tell rows with equal ids apart); rows equal in all of them are separate hits.
    """
    keys = ["id", *carry]
    term_bytes = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + F.octet_length(t) + 8)
    size = topic_tv.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(term_bytes), F.lit(0)).alias("bytes")).first()
    blocks = max(1, math.ceil(size["bytes"] / max_bytes), math.ceil(size["n"] / max_topics))
    field = {f.name: f for f in [*doc_tv.schema.fields, *topic_tv.schema.fields]}
    schema = T.StructType([*(T.StructField(c, field[c].dataType) for c in ["topic_id", *keys]), T.StructField("similarity_score", T.DoubleType())])
    ship_package(doc_tv.sparkSession)
    counted = "tf" in doc_tv.columns
    docs = doc_tv.select(*keys, "terms", *(["tf", "sumsq"] if counted else []))
    scored = None
    for b in range(blocks):
        some = topic_tv if blocks == 1 else topic_tv.where(F.pmod(F.xxhash64("topic_id"), F.lit(blocks)) == b)
        topics = some.select("topic_id", "terms", "tf", "sumsq").toArrow()
        scorer = _block_scorer(topics, k, keys, -np.inf if threshold is None else threshold)
        run = scorer if counted else lambda batches, scorer=scorer: scorer(_counted_terms(batches))
        part = docs.mapInArrow(run, schema) if topics.num_rows else docs.sparkSession.createDataFrame([], schema)
        part = part.checkpoint() if blocks > 1 else part
        scored = part if scored is None else scored.unionByName(part)
    return rank_topk(scored, k, ties=carry).select("topic_id", "rank", *keys, "similarity_score")


def attach(hits: DataFrame, items: DataFrame, on: str = "id") -> DataFrame:
    """Late materialisation (J1): join item fields onto hits after the top-k."""
    return hits.join(items, on, "inner")


def min_score(hits: DataFrame, threshold: float | None = None) -> DataFrame:
    """Optional similarity floor (T9); ``None`` keeps every hit."""
    return hits if threshold is None else hits.filter(F.col("similarity_score") >= threshold)


def cached_search(queries: DataFrame, folder: str, run: Callable[[DataFrame], DataFrame], k: int, model: str,
                  version: str, q_id: str = "topic_id", q_text: str = "topic", rebuild: bool = False) -> DataFrame:
    """Answer reuse (T8): ``(q_id, key, rank, id, similarity_score, fresh)`` of all queries.

    key = md5 of query text, k, model and corpus version (``store.corpus_version`` of the
    searched table: answers go stale when it changes).  ``folder`` is a versioned store with
    a row per answered key and its hits (an empty list is an answer, too).  Keys it lacks
    are searched, each once, and added in one write; all answers are read back from it.
    ``run(df)`` takes ``(key, <query columns>)`` rows and returns hits keyed by
    ``key``; it is not called when every key is there.  ``rebuild`` replaces the table.
    """
    spark = queries.sparkSession
    keyed = queries.withColumn("key", F.md5(F.concat_ws("|", F.col(q_text), F.lit(str(k)), F.lit(model), F.lit(version))))
    todo = keyed.dropDuplicates(["key"])
    store = Store(spark, folder)
    stored = not rebuild and store.manifest() is not None
    todo = (store.missing(todo) if stored else todo).checkpoint()
    call = uuid.uuid4().hex
    if not stored or not todo.isEmpty():
        hits = run(todo).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "similarity_score"))).alias("hits"))
        rows = todo.select("key").join(hits, "key", "left").withColumn("written_by", F.lit(call))
        store.append(rows, replace=rebuild)
    answers = keyed.select(q_id, "key").join(store.read(store.prefixes(keyed)), "key")
    return answers.select(q_id, "key", F.inline("hits"), (F.col("written_by") == call).alias("fresh"))

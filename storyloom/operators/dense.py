"""Dense top-k search, neighbours and pairwise similarities as matrix products.

Vectors stay where they are read: a batch of them is one matrix, and its product with the
query matrix gives all scores at once.  Each task holds ``k`` rows per query and only those
leave it.  The queries go to the tasks whole while they are small (their bytes are counted
first); larger query tables are dealt into blocks that meet blocks of vectors.

A product of matrices may differ in the last bit with the shape of the batch.  It only
chooses candidates, with a margin; their scores are sums in array order, so equal vectors
get equal scores wherever they are, and ties go by id.

Vectors that are null, have another length than the query or hold a null or NaN have no
score and are no hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.vectors import l2_normalize
from storyloom.session import ship_package

#: Largest query table (as 64-bit numbers) that is sent to every task.
MAX_QUERY_BYTES = 32 << 20
#: Scores computed at once, and vectors of a block when queries are dealt into blocks.
CELLS, BLOCK_ROWS = 1 << 21, 1 << 14
#: Members of a set that are compared in one task, as a block against a block.
PAIR_BLOCK = 512
#: A top-k is merged in this many groups of tasks before the last merge.
MERGE_GROUPS = 64


def rank_topk(scored: DataFrame, k: int, q_id: str = "topic_id", c_id: str = "id",
              score: str = "similarity_score", ties: Sequence[str] = ()) -> DataFrame:
    """Keep the k best rows per query: score descending, then id and ``ties`` ascending; 1-based rank.

    Merged in two steps, groups of tasks first, so that no task gets k rows of every task.
    """
    order = [F.col(score).desc(), F.col(c_id).asc(), *(F.col(c).asc() for c in ties)]
    group = Window.partitionBy(q_id, "task_group").orderBy(*order)
    best = scored.withColumn("task_group", F.spark_partition_id() % MERGE_GROUPS)
    best = best.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= k).drop("task_group", "rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(q_id).orderBy(*order))).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ numbers
def vector_groups(column: pa.Array | pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of 64-bit numbers) of the usable vectors, one pair for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    begin = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        matrix = flat.reshape(-1, size) if len(rows) == len(sizes) else flat[begin[rows][:, None] + np.arange(size)]
        sound = ~np.isnan(matrix).any(axis=1)
        out.append((rows[sound], matrix[sound]))
    return out


def ordered_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in array order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_pairs(queries: np.ndarray, vectors: np.ndarray, place: np.ndarray, k: int, floor: np.ndarray, excluded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the ``k`` best vectors of each query that reach its ``floor``.

    ``place`` orders vectors of equal score; ``excluded`` has the query (or -1) that a
    vector must not be a hit of.
    """
    found: list[tuple[np.ndarray, ...]] = []
    n = len(vectors)
    if not n or not len(queries):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    step = max(1, CELLS // n)
    width = np.sqrt((vectors ** 2).sum(1).max())
    for start in range(0, len(queries), step):
        some = queries[start:start + step]
        rough = some @ vectors.T
        if excluded is not None:
            own = np.flatnonzero((excluded >= start) & (excluded < start + len(some)))
            rough[excluded[own] - start, own] = -np.inf
        least = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
        margin = 1e-12 * some.shape[1] * width * np.sqrt((some ** 2).sum(1)) + 1e-300
        least = np.maximum(np.maximum(least, floor[start:start + len(some)]) - margin, np.finfo(float).min)
        q, v = np.nonzero(rough >= least[:, None])
        score = np.concatenate([ordered_products(some[q[i:i + CELLS]], vectors[v[i:i + CELLS]]) for i in range(0, len(q), CELLS)] or [np.zeros(0)])
        order = np.lexsort((place[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[keep] + start, v[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


# ------------------------------------------------------------------ top-k
def _scorer(queries: pa.Table, k: int, keys: list[str], vector: str, exclude_self: bool) -> tuple[Callable, Callable]:
    """``(hits of one table, table of the best of several)``; ``queries`` has query, vector."""
    groups = vector_groups(queries["vector"])
    n_queries = queries.num_rows

    def ranked(table: pa.Table) -> pa.Table:
        order = [("query", "ascending"), ("similarity_score", "descending"), *((c, "ascending") for c in keys)]
        table = table.take(pc.sort_indices(table, order, null_placement="at_start"))
        query = table["query"].to_numpy()
        return table.filter(pa.array(np.arange(len(query)) - np.searchsorted(query, query) < k))

    def hits(rows: pa.Table, floor: np.ndarray) -> list[pa.Table]:
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in keys], null_placement="at_start"))
        excluded = None
        if exclude_self:
            excluded = pc.fill_null(pc.index_in(rows[keys[0]], queries["query"].combine_chunks()), -1).to_numpy()
        out = []
        for at, vectors in vector_groups(rows[vector]):
            for own, matrix in groups:
                if matrix.shape[1] == vectors.shape[1]:
                    local = None
                    if excluded is not None:
                        where = np.full(n_queries + 1, -1)
                        where[own] = np.arange(len(own))
                        local = where[excluded[at]]
                    q, v, score = best_pairs(matrix, vectors, np.arange(len(at)), k, floor[own], local)
                    place = pa.array(at[v])
                    out.append(pa.table({"query": own[q], "similarity_score": score} | {c: rows[c].take(place) for c in keys}))
        return out

    return hits, ranked


def _named(found: pa.Table, queries: pa.Table, q_id: str, keys: list[str]) -> pa.Table:
    ids = queries["query"].combine_chunks().take(found["query"].combine_chunks())
    return pa.table([ids, *(found[c] for c in keys), found["similarity_score"]], [q_id, *keys, "similarity_score"])


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "topic_id", q_vec: str = "embedding",
               c_id: str = "id", c_vec: str = "embedding", exclude_self: bool = False, carry: Sequence[str] = (),
               normalize_queries: bool = True, max_query_bytes: int = MAX_QUERY_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact inner-product top-k for every query: ``(q_id, rank, id, *carry, similarity_score)``.

    Query vectors are L2-normalised like the encoder's query path (skip with
    ``normalize_queries=False`` when they already are).  With ``exclude_self`` a query
    never matches the corpus row with its own id.  ``carry`` columns of the corpus break
    ties behind the id and stay in the hits.
    """
    ship_package(corpus.sparkSession)
    keys = [c_id, *carry]
    qv = l2_normalize(F.col(q_vec)) if normalize_queries else F.col(q_vec)
    q = queries.select(F.col(q_id).alias("query"), qv.cast("array<double>").alias("vector"))
    c = corpus.select(*keys, F.col(c_vec).alias("corpus_vector"))
    field = {f.name: f.dataType for f in c.schema.fields}
    schema = T.StructType([T.StructField(q_id, q.schema["query"].dataType), *(T.StructField(x, field[x]) for x in keys), T.StructField("similarity_score", T.DoubleType())])
    size = q.agg(F.coalesce(F.sum(F.size("vector") * 8 + 64), F.lit(0))).first()[0]
    if size <= max_query_bytes:
        found = _beside_vectors(q, c, k, q_id, keys, schema, exclude_self)
    else:
        found = _block_by_block(q, c, k, q_id, keys, schema, exclude_self, math.ceil(size / max_query_bytes) + 1, block_rows)
    return rank_topk(found, k, q_id, c_id, ties=carry).select(q_id, "rank", *keys, "similarity_score")


def _beside_vectors(q: DataFrame, c: DataFrame, k: int, q_id: str, keys: list[str], schema: T.StructType, exclude_self: bool) -> DataFrame:
    """All queries are sent to the tasks that read the vectors."""
    sent = q.toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.num_rows:
            return
        hits, ranked = _scorer(sent, k, keys, "corpus_vector", exclude_self)
        floor = np.full(sent.num_rows, -np.inf)
        held: list[pa.Table] = []
        for batch in batches:
            held += hits(pa.Table.from_batches([batch]), floor)
            if held and sum(t.num_rows for t in held) >= 2 * sent.num_rows * k:
                held = [ranked(pa.concat_tables(held))]
                query = held[0]["query"].to_numpy()
                last = np.searchsorted(query, np.arange(sent.num_rows), "right") - 1
                full = np.bincount(query, minlength=sent.num_rows) >= k
                floor[full] = held[0]["similarity_score"].to_numpy()[last[full]]
        if held:
            yield from _named(ranked(pa.concat_tables(held)), sent, q_id, keys).to_batches()

    return c.mapInArrow(run, schema)


def meet_blocks(rows: pa.Table, asked: pa.Table, k: int, q_id: str, keys: list[str], exclude_self: bool = False) -> pa.Table:
    """The ``k`` best of a block of vectors (keys, corpus_vector) for each of a block of queries (query, vector)."""
    hits, ranked = _scorer(asked, k, keys, "corpus_vector", exclude_self)
    found = hits(rows, np.full(asked.num_rows, -np.inf)) if rows.num_rows and asked.num_rows else []
    if not found:
        return pa.table([asked["query"].slice(0, 0), *(rows[x].slice(0, 0) for x in keys), pa.array([], pa.float64())], [q_id, *keys, "similarity_score"])
    return _named(ranked(pa.concat_tables(found)), asked, q_id, keys)


def _block_by_block(q: DataFrame, c: DataFrame, k: int, q_id: str, keys: list[str], schema: T.StructType, exclude_self: bool, query_blocks: int, block_rows: int) -> DataFrame:
    """Blocks of vectors meet blocks of queries, each pair in a task."""
    row_blocks = max(1, math.ceil(c.count() / block_rows))
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = c.select("*", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(row_blocks)).cast("int").alias("row_block"), places(query_blocks).alias("query_block"))
    asked = q.select("*", places(row_blocks).alias("row_block_"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("query_block_"))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return meet_blocks(rows, asked, k, q_id, keys, exclude_self)

    return rows.groupBy("row_block", "query_block").cogroup(asked.groupBy("row_block_", "query_block_")).applyInArrow(meet, schema)


def neighbours(corpus: DataFrame, anchors: DataFrame, k: int = 10, c_id: str = "id", c_vec: str = "embedding") -> DataFrame:
    """Nearest corpus rows of given anchor ids, the anchor itself removed.

    Unknown anchor ids produce no rows (inner join), as an empty answer.
    """
    q = corpus.join(anchors.select(F.col(c_id)).distinct(), c_id, "inner").select(
        F.col(c_id).alias("anchor_id"), F.col(c_vec).alias("embedding"))
    return dense_topk(q, corpus, k, q_id="anchor_id", exclude_self=True, c_id=c_id, c_vec=c_vec,
                      normalize_queries=False)


# ------------------------------------------------------------------ pairs inside sets
def similarity_pairs(members: DataFrame, vectors: DataFrame, group: str = "topic_id", c_id: str = "id",
                     c_vec: str = "embedding", block: int = PAIR_BLOCK) -> DataFrame:
    """Pairwise inner products inside member sets (T7), long form ``id1 < id2``.

    ``members`` is ``(group, id)``.  A set's members are dealt to blocks of about ``block``
    rows by hash; each two blocks (and each block with itself) are one small product in a
    task of its own, so a large set is spread over (its blocks) ** 2 / 2 tasks.
    """
    ship_package(vectors.sparkSession)
    m = members.select(group, c_id).join(vectors.select(c_id, F.col(c_vec).alias("vector")), c_id)
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = m.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(c_id, F.lit(1)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = dealt.select(F.col(group), F.col(c_id).alias("id"), "vector", "own", other)
    cells = cells.select(group, "id", "vector", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    kinds = {f.name: f.dataType for f in cells.schema.fields}
    schema = T.StructType([T.StructField(group, kinds[group]), T.StructField("id1", kinds["id"]), T.StructField("id2", kinds["id"]), T.StructField("similarity", T.DoubleType())])

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.take(pc.sort_indices(cell, [("id", "ascending")]))
        own, low = cell["own"].to_numpy(), cell["low"].to_numpy()
        alone = cell["high"][0].as_py() == cell["low"][0].as_py()
        rank = pc.rank(cell["id"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        first, second, score = [], [], []
        for at, x in vector_groups(cell["vector"]):
            left = np.flatnonzero(own[at] == low[at])
            right = left if alone else np.flatnonzero(own[at] != low[at])
            total = np.zeros((len(left), len(right)))
            for j in range(x.shape[1]):  # in array order
                total += np.outer(x[left, j], x[right, j])
            i, j = np.nonzero(rank[at[left]][:, None] < rank[at[right]][None, :]) if alone else np.nonzero(rank[at[left]][:, None] != rank[at[right]][None, :])
            a, b = at[left[i]], at[right[j]]
            first.append(np.minimum(a, b))  # rows are in order of ids
            second.append(np.maximum(a, b))
            score.append(total[i, j])
        one, two = (pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (first, second))
        ids = cell["id"].combine_chunks()
        return pa.table([pa.repeat(cell[group][0], len(one)), ids.take(one), ids.take(two), pa.array(np.concatenate(score) if score else np.zeros(0))], [group, "id1", "id2", "similarity"])

    return cells.groupBy(group, "low", "high").applyInArrow(run, schema)


# ------------------------------------------------------------------ lists of an inverted file
def label_centroids(corpus: DataFrame, label: str = "label", c_vec: str = "embedding") -> DataFrame:
    """Unit mean vector per label: ``(list_id, centroid ARRAY<DOUBLE>)``.

    Per-dimension sums are combined map-side before the shuffle, so the shuffle carries
    only (label, dimension) partial sums.
    """
    e = corpus.select(F.col(label).alias("list_id"), F.posexplode(c_vec).alias("pos", "x"))
    per_dim = e.groupBy("list_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = per_dim.groupBy("list_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    return vec.select("list_id", l2_normalize(F.col("centroid")).alias("centroid"))


def nearest_of(groups: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """For each vector the number of its nearest centroid (largest product, then lowest
    number), or -1; ``groups``: ``vector_groups`` of the centroids."""
    out = np.full(len(column), -1, np.int64)
    for at, vectors in vector_groups(column):
        for own, matrix in groups:
            if matrix.shape[1] == vectors.shape[1]:
                v, c, _ = best_pairs(vectors, matrix, numbers[own], 1, np.full(len(vectors), -np.inf))
                out[at[v]] = numbers[own[c]]
    return out


def assign_lists(corpus: DataFrame, centroids: DataFrame, c_id: str = "id", c_vec: str = "embedding",
                 max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """``(id, vector, list_id)``: the nearest centroid of every vector, -1 without one.

    A small centroid table is sent to the tasks that read the vectors; a larger one is
    searched block by block.  ``ivf.build_index`` goes through two levels instead.
    """
    ship_package(corpus.sparkSession)
    rows = corpus.select(c_id, c_vec)
    cents = centroids.select(F.col("list_id").cast("long").alias("list_id"), F.col("centroid").cast("array<double>").alias("centroid"))
    size = cents.agg(F.coalesce(F.sum(F.size("centroid") * 8), F.lit(0))).first()[0]
    if size > max_query_bytes:
        named = rows.withColumn("row_", F.monotonically_increasing_id()).checkpoint()
        nearest = dense_topk(named, cents, 1, q_id="row_", q_vec=c_vec, c_id="list_id", c_vec="centroid", normalize_queries=False, max_query_bytes=max_query_bytes)
        found = named.join(nearest.select("row_", "list_id"), "row_", "left")
        return found.select(c_id, c_vec, F.coalesce("list_id", F.lit(-1).cast("long")).alias("list_id"))
    sent = cents.toArrow()
    schema = T.StructType([*rows.schema.fields, T.StructField("list_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, numbers = vector_groups(sent["centroid"]), sent["list_id"].to_numpy()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest_of(groups, numbers, batch.column(1)))], [*batch.schema.names, "list_id"])

    return rows.mapInArrow(run, schema)

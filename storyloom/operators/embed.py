"""Vector columns: batch encoding hook, normalisation, term vectors, alignment, caching.

* ``encode``         (V1/V3) caller-supplied batch encoder run with ``predict_batch_udf``
* ``hashed_vectors`` (V1/V3) built-in encoder: signed feature hashing of terms
* ``normalize``      (V2) native L2 normalisation
* ``term_vectors``   (V5) exact term-count vectors, counted in Arrow batches, no shuffle
* ``term_lists``     the tokens they are counted from, for a search that counts as it scores
* ``check_alignment``(V4) vectors vs. items, both ways, plus dimension check
* ``embed_with_store`` (S4) encode only texts whose (model, md5(text)) key is not stored
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.vectors import l2_normalize, list_slices, tokens
from storyloom.session import ship_package
from storyloom.sources.store import Store

# Default encoder batch size and the character cut applied before a
# pretrained encoder (its input window).
ENCODE_BATCH_SIZE = 32


def encode(df: DataFrame, text_col: str, make_encoder: Callable, dim: int,
           batch_size: int = ENCODE_BATCH_SIZE, normalize_output: bool = True,
           max_chars: int | None = None, out_col: str = "embedding") -> DataFrame:
    """Run a caller-supplied encoder over a text column in Arrow batches.

    ``make_encoder()`` is called once per Python worker and must return a function
    ``np.ndarray[str] -> np.ndarray[float32] (n, dim)``.  Output is L2-normalised with
    native expressions unless ``normalize_output`` is False.
    """
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size, input_tensor_shapes=None)
    text = F.col(text_col) if max_chars is None else F.substring(F.col(text_col), 1, max_chars)
    out = df.withColumn(out_col, udf(F.coalesce(text, F.lit(""))))
    if normalize_output:
        out = out.withColumn(out_col, l2_normalize(F.col(out_col)).cast("array<float>"))
    return out


def normalize(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    return df.withColumn(vec_col, l2_normalize(F.col(vec_col)))


def _counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column, ``terms`` (tokens in order), is counted: distinct terms, ``tf``, ``sumsq``."""
    for batch in list_slices(batches, "terms"):
        lists = batch.column("terms")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        n_words = max(1, len(order))
        cell, count = np.unique(row * n_words + place[coded.indices.to_numpy()], return_counts=True)
        owner, code = np.divmod(cell, n_words)
        offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
        terms = pa.ListArray.from_arrays(offsets, coded.dictionary.take(order).take(pa.array(code)))
        tf = pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))
        sumsq = np.bincount(owner, count.astype(float) ** 2, batch.num_rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], terms, tf, pa.array(sumsq)], [*batch.schema.names, "tf", "sumsq"])


def term_lists(df: DataFrame, id_col: str = "id", text_col: str = "full_text",
               max_chars: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, *carry, terms)``: the tokens of each text in order, repeats kept.

    ``search.text_topk`` takes them for vectors that are scored once and not stored: it
    counts them in the tasks that score them, so a task keeps one Python worker and one
    batch at a time, and the vectors do not travel.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return df.select(F.col(id_col).alias("id"), *carry, tokens(text).alias("terms"))


def term_vectors(df: DataFrame, id_col: str = "id", text_col: str = "full_text",
                 max_chars: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``(id, *carry, terms, tf, sumsq)``: distinct sorted terms, their counts and sum of squares.

    The whole text is used unless ``max_chars`` asks for an encoder-style cut.  Tokens are
    cut out in the JVM and counted in slices of Arrow batches (``list_slices``): a slice's words
    are numbered in sorted order, and one sort of (row, word) numbers counts all its rows.
    Nothing is shuffled.
    """
    rows = term_lists(df, id_col, text_col, max_chars, carry)
    schema = T.StructType([*rows.schema.fields, T.StructField("tf", T.ArrayType(T.IntegerType())), T.StructField("sumsq", T.LongType())])
    ship_package(df.sparkSession)
    return rows.mapInArrow(_counted_terms, schema)


# Dimensions of the built-in encoder.
HASHED_DIM = 256


def hashed_vectors(df: DataFrame, id_col: str = "id", text_col: str = "full_text", dim: int = HASHED_DIM, out_col: str = "embedding") -> DataFrame:
    """``(id_col, out_col)``: unit vectors by signed feature hashing, an encoder without a model.

    A term's MD5 gives its dimension (the first 8 hex digits modulo ``dim``) and its sign
    (the next digit: below 8 plus, else minus); a text's vector counts its terms with their
    signs, so inner products estimate those of the term counts without bias.  Distinct terms
    of a batch are hashed once.  A text without terms has a vector of zeros.
    """
    rows = df.select(F.col(id_col), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    schema = T.StructType([rows.schema[id_col], T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                n, lists = batch.num_rows, batch.column("terms")
                row = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                coded = lists.flatten().dictionary_encode()
                digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
                place = np.array([int(h[:8], 16) % dim for h in digests], np.int64)
                sign = np.array([1.0 if int(h[8], 16) < 8 else -1.0 for h in digests])
                code = coded.indices.to_numpy()
                counts = np.bincount(row * dim + place[code], sign[code], n * dim).reshape(n, dim) if len(row) else np.zeros((n, dim))
                norm = np.sqrt((counts ** 2).sum(1, keepdims=True))
                unit = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, out_col])

    return rows.mapInArrow(run, schema)


def check_alignment(vectors: DataFrame, items: DataFrame, dim: int,
                    vec_id: str = "id", item_id: str = "id", vec_col: str = "embedding") -> DataFrame:
    """One row: counts of vectors, items, items without vector, vectors without item,
    and vectors whose length is not ``dim``.  A full outer join on the id does both
    directions in one shuffle."""
    v = vectors.select(F.col(vec_id).alias("_vid"), F.size(vec_col).alias("_dim"))
    i = items.select(F.col(item_id).alias("_iid"))
    j = v.join(i, v["_vid"] == i["_iid"], "full_outer")
    return j.agg(
        F.count("_vid").alias("n_vectors"),
        F.count("_iid").alias("n_items"),
        F.count_if(F.col("_vid").isNull()).alias("items_without_vector"),
        F.count_if(F.col("_iid").isNull()).alias("vectors_without_item"),
        F.count_if(F.col("_vid").isNotNull() & (F.col("_dim") != dim)).alias("bad_dimension"),
    )


def text_key(text_col: str, model: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(model), F.coalesce(F.col(text_col), F.lit(""))))


def embed_with_store(items: DataFrame, folder: str, model: str, embed: Callable[[DataFrame], DataFrame],
                     text_col: str = "full_text", rebuild: bool = False, tag: str | None = None) -> DataFrame:
    """Encode each distinct text once, store its vector and read stored vectors back.

    ``folder`` is a versioned store (``sources.store``) of ``(key, <vector columns>,
    written_by)``, keyed by md5 of model and text (NULL = empty); only the prefixes of the
    items' keys are read.  ``embed(df_with_key_and_text)`` must return ``key`` plus the
    vector columns.  Returns the items with key, vector columns and fresh (encoded by this
    call); a repeated call encodes nothing.  ``rebuild`` replaces the store's content.
    """
    store = Store(items.sparkSession, folder)
    keyed = items.withColumn("key", text_key(text_col, model))
    todo = keyed.select("key", F.col(text_col)).dropDuplicates(["key"])
    if not rebuild:
        todo = store.missing(todo)
    call = uuid.uuid4().hex
    store.append(embed(todo).withColumn("written_by", F.lit(call)), tag, rebuild)
    out = keyed.join(store.read(store.prefixes(keyed)), "key")
    return out.withColumn("fresh", F.col("written_by") == call).drop("written_by")

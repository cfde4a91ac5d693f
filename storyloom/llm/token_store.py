"""Token ids in a binary format with a shared zstandard dictionary.

Every document is tokenized, closed with an end id, and its id array (little-endian
unsigned integers, 16 bit when the vocabulary allows it) is compressed as a frame of its
own with one dictionary that was trained on a bounded sample of such arrays.  A store is
a folder

    dictionary/   one row: the dictionary, its SHA-256 and the width of an id
    blocks/       rows of (part, block): the frames of a run of documents end to end,
                  with their doc ids, frame offsets, token counts and the dictionary hash

Parts and blocks follow ascending doc_id (nulls first, ties by text), so a short document
is read by pruning blocks on first_id / last_id and decompressing one frame.

Null texts count as empty (the end id alone); repeated rows are stored each; a very long
text is encoded word by word and is one frame of a block of its own; an empty
table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import byte_slices

END_ID = 1
#: Bounds of the dictionary's training sample and of the dictionary.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 8 << 20, 64 << 10
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 8 << 20
LEVEL = 3
#: Words a worker remembers with their ids between batches; it starts anew beyond that.
REMEMBERED_WORDS = 800_000
#: A special token of the vocabulary, put between words that are encoded in one call.
MARK = b"<|startoftext|>"

IDS = "doc_id long, tie long, width int, n_tokens long, ids binary"
BLOCKS = ("part int, block int, first_id long, last_id long, dictionary_sha256 string, n_total long, "
          "doc_ids array<long>, offsets array<long>, n_tokens array<long>, payload binary")

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    """The tokenizer, the worker's word memory and whether A-Z and a-z are the same to it."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        same_case = all(tokenizer.encode(c).ids == tokenizer.encode(c.lower()).ids for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        _TOKENIZERS[path] = (tokenizer, {}, same_case)
    return _TOKENIZERS[path]


def _learn(tokenizer, words: list[bytes], known: dict[bytes, bytes]) -> None:
    """Encode words, many to a call, a special token between them marking where each ends."""
    odd = [w for w in words if MARK in w]
    plain = [w for w in words if MARK not in w] if odd else words
    mark = tokenizer.token_to_id(MARK.decode())
    if mark is None:  # a vocabulary without it: one by one
        odd, plain = words, []
    for w in odd:
        known[w] = np.array(tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
    runs = [plain[k:k + 500] for k in range(0, len(plain), 500)]
    for run, e in zip(runs, tokenizer.encode_batch_fast([MARK.join(r).decode() for r in runs], add_special_tokens=False)):
        ids = np.array(e.ids, np.uint32)
        data, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == mark)).tolist()
        for w, a, z in zip(run, [0, *[c + 4 for c in cuts]], [*cuts, len(data)]):
            known[w] = data[a:z]


def encode_texts(texts: list[bytes], path: str, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and the number of ids of each text.

    The vocabulary's normalizer and splitter never join across white space, so a text's
    ids are its words' ids in order and each distinct word is encoded once.
    """
    tokenizer, known, same_case = _tokenizer(path)
    if len(known) > REMEMBERED_WORDS:
        known.clear()
    words, counts, seen = [], [], {}
    for raw in texts:
        # Fewer distinct words; special tokens ("<|...") are matched before case is folded.
        own = (raw.lower() if same_case and b"<|" not in raw else raw).split()
        words.append([seen.setdefault(w, len(seen)) for w in own])
        counts.append(len(own))
    new = [w for w in seen if w not in known]
    _learn(tokenizer, new, known)
    table = [known[w] for w in seen]
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    flat = np.frombuffer(b"".join(table), np.uint32)
    first = np.cumsum(sizes) - sizes
    index = np.fromiter((i for own in words for i in own), np.int64, sum(counts))
    own_sizes = sizes[index]
    total = np.add.reduceat(np.r_[own_sizes, 0], np.cumsum([0, *counts[:-1]])) * (np.array(counts) > 0) if texts else np.zeros(0, np.int64)
    out = np.empty(int(total.sum()) + (len(texts) if end_id is not None else 0), np.uint32)
    extra = 1 if end_id is not None else 0
    ends = np.cumsum(total + extra)
    if extra:
        out[ends - 1] = end_id
    # Scatter the words' ids: the place of each is the running size plus the end ids before it.
    at = np.cumsum(own_sizes) - own_sizes + extra * np.repeat(np.arange(len(texts)), counts)
    within = np.arange(int(own_sizes.sum())) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
    out[np.repeat(at, own_sizes) + within] = flat[np.repeat(first[index], own_sizes) + within]
    return out, total + extra


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, bytes]]:
    """Slices of the batches with the width of an id, the ids of each row and all ids as bytes."""
    width = 2 if max(_tokenizer(path)[0].get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    for whole in batches:
        for batch in byte_slices(whole, "text", SLICE_BYTES):
            ids, n = encode_texts([x.as_py() for x in batch.column("text").cast(pa.binary())], path, end_id)
            yield batch, width, n, ids.astype("<u2" if width == 2 else "<u4").tobytes()


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """``IDS``: one row per document with its serialized id array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, width, n, data in _encoded(batches, path, end_id):
            offsets = np.r_[0, np.cumsum(n) * width].astype(np.int32)
            column = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(n), width, np.int32)), pa.array(n, pa.int64()), column],
                                             ["doc_id", "tie", "width", "n_tokens", "ids"])
    return _rows(docs, text, key).mapInArrow(run, IDS)


def train_dictionary(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id",
                     sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary from the id arrays of a bounded sample: the ``sample_docs`` non-empty
    documents with the smallest hash, each cut to ``sample_bytes / sample_docs`` bytes.

    Empty bytes when the sample is too small to train on; frames then use no dictionary.
    """
    each = sample_bytes // sample_docs
    sample = (docs.where(F.length(text) > 0).select(key, F.substring(text, 1, each).alias("text"))
              .orderBy(F.xxhash64(F.col(key), F.lit(7)), "text").limit(sample_docs))
    rows = [bytes(r["ids"])[:each] for r in encode(sample, path, "text", key).select("ids").collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_store(docs: DataFrame, folder: str, path: str, text: str = "text", key: str = "doc_id",
                end_id: int = END_ID, block_bytes: int = BLOCK_BYTES, level: int = LEVEL) -> None:
    """Encode all documents and write the store to ``folder`` (a path that Spark reads and writes).

    The texts are shuffled once, by ranges of doc_id; each task encodes, compresses and
    writes its range, one slice of texts at a time.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, text, key)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(bytearray(dictionary), sha)], "dictionary binary, sha256 string").write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}
        pack = zstandard.ZstdCompressor(level=level, write_checksum=False, **options).compress
        part, block = TaskContext.get().partitionId(), 0
        ids, offsets, counts, frames, held = [], [0], [], [], 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "block": block, "first_id": ids[0], "last_id": ids[-1], "dictionary_sha256": sha, "n_total": sum(counts),
                   "doc_ids": ids, "offsets": offsets, "n_tokens": counts, "payload": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch, width, n_ids, data in _encoded(batches, path, end_id):
            ends = np.cumsum(n_ids) * width
            for doc, n, z in zip(batch.column("doc_id").to_pylist(), n_ids.tolist(), ends.tolist()):
                frame = bytes([width]) + pack(data[z - n * width:z])
                if ids and held + len(frame) > block_bytes:
                    yield closed()
                    block, ids, offsets, counts, frames, held = block + 1, [], [0], [], [], 0
                ids.append(doc)
                counts.append(n)
                frames.append(frame)
                held += len(frame)
                offsets.append(held)
        if ids:
            yield closed()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary_sha256", pa.string()), ("n_total", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = _rows(docs, text, key).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks, with ``block_start``: the tokens of all blocks before.

    Running sums go over the blocks of a part, and over one total per part.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.select("part", "block", "n_total")
    parts = sizes.groupBy("part").agg(F.sum("n_total").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = F.coalesce(F.sum("n_total").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(before, "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("block_start"))
    return blocks.join(starts, ["part", "block"])


def _dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return bytes(row["dictionary"]), row["sha256"]


def read_store(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids (32-bit little endian).

    With ``doc_ids``, only blocks whose range can hold them are read, and only their frames
    are decompressed.
    """
    blocks = read_blocks(spark, folder)
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        hit = F.lit(False)
        for i in sorted(wanted):
            hit = hit | F.lit(i).between(F.col("first_id"), F.col("last_id"))
        blocks = blocks.where(hit)
    dictionary, sha = _dictionary(spark, folder)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = {"dict_data": zstandard.ZstdCompressionDict(shared.value)} if shared.value else {}
        unpack = zstandard.ZstdDecompressor(**options).decompress
        for batch in batches:
            for b in range(batch.num_rows):
                if batch.column("dictionary_sha256")[b].as_py() != sha:
                    raise ValueError("block was written with another dictionary")
                start, payload = batch.column("block_start")[b].as_py(), batch.column("payload")[b].as_py()
                ids, offsets, counts = (batch.column(c)[b].as_py() for c in ("doc_ids", "offsets", "n_tokens"))
                rows, size = [], 0
                for doc, a, z, n in zip(ids, offsets, offsets[1:], counts):
                    if wanted is None or doc in wanted:
                        raw = unpack(payload[a + 1:z])
                        own = raw if payload[a] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                        rows.append((doc, start, n, own))
                        size += len(own)
                        if size > SLICE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                    start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names, kinds = ["doc_id", "start", "n_tokens", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read documents."""
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())

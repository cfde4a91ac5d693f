"""Suffix-array dedup by bucket-pointer refinement.

Every byte covered by a ``MIN_BYTES``-byte string that also starts anywhere else (in any
document, the same one included) is removed; strings are judged on the input.  Matches
never cross documents.

The start positions are sorted into buckets of equal strings, first by q-grams, then
bucket by bucket by the identifiers of later offsets, until a bucket stands for equal
strings of ``MIN_BYTES`` bytes; a bucket with one member is finished and drops out.

1. Initial buckets.  Each start belongs to the smallest q-gram (by hash) inside its
   string, so equal strings fall into the same q-gram's bucket at the same distance.  A
   run of starts with one such q-gram is an entry.  A q-gram with one entry in the whole
   corpus is unique: all its starts drop out.  If all entries of a q-gram have the same
   surroundings, all their strings repeat.  Both are decided by aggregates of one small
   row per entry.
2. Refinement.  Of the other q-grams, one entry for each different surrounding goes on,
   with its bytes.  The entries of a q-gram meet in a task (``repeated_starts``): each place
   has a pointer to its bucket, buckets are refined by sorting on the pointers at later
   offsets, and the new pointers are what the next refinement reads.  Very large q-gram
   buckets are not brought together: their starts become rows, with hashes of their
   strings, that an ordinary aggregate counts.
3. The spans found are joined back and cut out.

Q-grams and surroundings are compared by 64-bit hashes.  Ties are none, repeated rows count
as equal documents.  Null texts count as empty; shorter
documents than ``MIN_BYTES`` never change; equal documents, repeated rows included, lose
all their bytes; an empty table gives an empty table; all columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import byte_slices, free_name, materialize

MIN_BYTES = 400
Q = 50
FIRST = 8  # bytes of the first buckets of a refinement: 8, 16, ... 256, 400
SLICE_BYTES = 1 << 20
#: Different surroundings of one q-gram that may meet in a task.
TOGETHER = 20_000
#: A q-gram with more than this part of all rows is joined by broadcast (so there are fewer than FREQUENT of them).
FREQUENT = 1000
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_rng.integers(1, 1 << 62)) * 8 + 5
UNBASE = pow(BASE, -1, 1 << 64)

ENTRIES = "gram long, around long, doc_key long, anchor long, first long, last long"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


class Ids:
    """Bucket ids of the strings of one buffer: equal ids for equal strings of equal length."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        self.up = _powers(BASE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[buffer] * _powers(UNBASE, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[start]

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return (self.sums[q:] - self.sums[:n]) * self.up[:n]


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if width > have else v


def entries_of(buffer: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, min_bytes: int = MIN_BYTES, q: int = Q) -> tuple:
    """The entries of the documents that lie end to end in ``buffer`` (less than 2 ** 24 bytes).

    Returns document index, q-gram id, id of the surroundings, anchor, first and last start.
    """
    n = len(buffer)
    sizes = doc_ends - doc_starts
    own = np.flatnonzero(sizes >= min_bytes)
    empty = np.zeros(0, np.int64)
    if not len(own):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    ids = Ids(buffer)
    low = np.uint64((1 << 24) - 1)
    v = (_mixed(ids.grams(q)) & ~low) | np.arange(n - q + 1, dtype=np.uint64)
    least = _window_min(v, min_bytes - q + 1) & low  # of the string that starts here
    counts = sizes[own] - min_bytes + 1
    doc = np.repeat(own, counts)
    begin = np.cumsum(counts) - counts
    start = np.arange(int(counts.sum())) - np.repeat(begin - doc_starts[own], counts)
    anchor = least[start].astype(np.int64)
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(new)
    first, last = start[at], start[np.r_[at[1:] - 1, len(start) - 1]]
    a, d = anchor[at], doc[at]
    gram = _mixed(ids.of(a, a + q))
    around = _mixed(ids.of(first, last + min_bytes) + (a - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (last - first).astype(np.uint64))
    base = doc_starts[d]
    return d, gram, around, a - base, first - base, last - base


def _scan(rows: DataFrame, min_bytes: int, q: int) -> DataFrame:
    """``ENTRIES`` of rows (doc_key, text)."""
    piece = 4 << 20

    def of_buffer(keys: np.ndarray, raws: list[bytes], shift: int = 0) -> Iterator[pa.RecordBatch]:
        buffer = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        d, gram, around, a, first, last = entries_of(buffer, ends - np.array([len(r) for r in raws]), ends, min_bytes, q)
        if len(d):
            columns = [gram.view(np.int64), around.view(np.int64), keys[d], a + shift, first + shift, last + shift]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in ENTRIES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                keys = batch.column("doc_key").to_numpy()
                raws = [x.as_py() for x in batch.column("text").cast(pa.binary())]
                if len(raws) == 1 and len(raws[0]) > piece:  # a very long text goes piece by piece, its starts dealt out
                    for k in range(0, len(raws[0]) - min_bytes + 1, piece):
                        yield from of_buffer(keys, [raws[0][k:k + piece + min_bytes - 1]], k)
                else:
                    yield from of_buffer(keys, raws)

    return rows.mapInArrow(run, ENTRIES)


def _buckets(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Bucket identifiers of pairs of numbers from 0 on: equal for equal pairs, -1 for a pair on its own."""
    if not len(first):
        return np.zeros(0, np.int64)
    key = first * (int(second.max()) + 1) + second
    order = np.argsort(key)
    key = key[order]
    bucket = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    out = np.empty(len(key), np.int64)
    out[order] = np.where(np.bincount(bucket)[bucket] > 1, bucket, -1)
    return out


def repeated_starts(contents: list[bytes], groups: np.ndarray, many: np.ndarray, min_bytes: int = MIN_BYTES) -> np.ndarray:
    """Which starts of the contents (all their ``len - min_bytes + 1`` starts, end to end) begin
    a string that repeats within their group; all starts of a content that is there ``many`` times do.

    Every place holds a pointer to its bucket, at first that of its q-gram (``FIRST`` bytes)
    in its group.  A bucket is refined by sorting its places by the pointers at a later
    offset, which makes it stand for longer strings; the new pointers replace the old and
    are what the next refinement looks up.  Places alone in their bucket drop out, and so
    do those that point to such a place.  Bytes and pointers are compared, no hashes.
    """
    sizes = np.array([len(c) for c in contents])
    begin = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    have = min(FIRST, min_bytes)
    grams = np.ndarray(n, "<u8", b"".join(contents) + bytes(8), strides=(1,)) & np.uint64((1 << 8 * have) - 1)
    end = np.repeat(begin + sizes, sizes)
    at = np.flatnonzero(np.arange(n) + have <= end)
    own = np.repeat(np.unique(groups, return_inverse=True)[1], sizes)
    pointer = np.full(n, -1)
    pointer[at] = _buckets(np.unique(grams[at], return_inverse=True)[1], own[at])
    while have < min_bytes:
        step = min(have, min_bytes - have)
        at = at[(pointer[at] >= 0) & (at + have + step <= end[at])]
        at = at[pointer[at + step] >= 0]
        found = _buckets(pointer[at], pointer[at + step])
        pointer = np.full(n, -1)
        pointer[at] = found
        have += step
    counts = sizes - min_bytes + 1
    start = np.arange(int(counts.sum())) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return np.repeat(many, counts) | (pointer[start] >= 0)


def _runs(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content index, first and last start (from the content's begin) of each run of found starts."""
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(found)
    if not len(at):
        return at, at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:] - 1, len(at) - 1]
    return owner[at[begin]], inside[at[begin]], inside[at[end]]


def _contents(joined: DataFrame, text_name: str, list_name: str, min_bytes: int) -> DataFrame:
    """One row per entry of the rows' lists, with the bytes of all its strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text_name, SLICE_BYTES):
                raws, lists = batch.column(text_name).cast(pa.binary()), batch.column(list_name).to_pylist()
                rows = [(e["gram"], e["around"], e["n"], e["kinds"], raw[e["first"]:e["last"] + min_bytes]) for raw, own in zip((x.as_py() or b"" for x in raws), lists) for e in own]
                for k in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 2000]), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["gram", "around", "n", "kinds", "content"])
    return joined.mapInArrow(run, "gram long, around long, n long, kinds long, content binary")


FOUND = "gram long, around long, run_first long, run_last long"


def _refine(contents: DataFrame, min_bytes: int, q: int) -> DataFrame:
    """``FOUND``: runs of repeated starts of each content, for q-grams whose contents meet in a task."""
    rows = contents.repartition("gram").sortWithinPartitions("gram")
    names = [x.split()[0] for x in FOUND.split(", ")]

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(held)
        grams, around, n = (part[c].to_numpy() for c in ("gram", "around", "n"))
        contents = part["content"].to_pylist()
        found = repeated_starts(contents, grams, n > 1, min_bytes)
        owner, a, z = _runs(found, np.array([len(c) - min_bytes + 1 for c in contents]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (grams[owner], around[owner], a, z)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("gram").to_numpy()
            borders = [0, *(np.flatnonzero(grams[1:] != grams[:-1]) + 1).tolist(), len(grams)]
            for a, z in zip(borders, borders[1:]):
                if size > CHUNK_BYTES and held[-1].column("gram")[-1].as_py() != grams[a]:
                    yield from emit(held)
                    held, size = [], 0
                held.append(batch.slice(a, z - a))
                size += pc.sum(pc.binary_length(held[-1].column("content"))).as_py()
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, FOUND)


def _refine_spread(contents: DataFrame, min_bytes: int) -> DataFrame:
    """``FOUND`` for q-grams with very many contents: a row per start, counted by an aggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(batch.column("content")[i].as_py(), np.uint8)
                start = np.arange(len(raw) - min_bytes + 1)
                bucket = _mixed(Ids(raw).of(start, start + min_bytes)).view(np.int64)
                gram, around, n = (np.full(len(start), batch.column(c)[i].as_py()) for c in ("gram", "around", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (gram, around, n, start, bucket)], ["gram", "around", "n", "start", "bucket"])

    starts = contents.mapInArrow(run, "gram long, around long, n long, start long, bucket long")
    together = starts.groupBy("gram", "bucket").agg(F.sum("n").alias("members")).where("members > 1").select("gram", "bucket")
    return starts.join(together, ["gram", "bucket"]).select("gram", "around", F.col("start").alias("run_first"), F.col("start").alias("run_last"))


def _with_counts(rows: DataFrame, counts: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` of ``counts`` (gram, n, column; n: the gram's rows), for grams found there.

    Both tables are written ones.  A q-gram that very many rows share would be one task of
    the join; those are few by their definition, and the others are dealt by gram.
    """
    total = rows.count()
    often = F.col("n") * FREQUENT > total
    marked = rows.join(F.broadcast(counts.where(often).select("gram", F.col(column).alias("often_"))), "gram", "left")
    seldom = marked.where("often_ IS NULL").drop("often_").join(counts.where(~often).select("gram", column), "gram")
    return marked.where("often_ IS NOT NULL").withColumnRenamed("often_", column).unionByName(seldom)


def find_repeats(rows: DataFrame, min_bytes: int = MIN_BYTES, q: int = Q, together: int = TOGETHER, key: str = "doc_key", text: str = "text") -> DataFrame:
    """(doc_key, spans): array of (first byte, end byte) covered by repeated strings, unmerged.

    ``rows`` has ``key`` (equal for rows with equal ids and texts only) and ``text``.  The
    bytes of an entry leave its document only if its q-gram's surroundings differ, and once
    per surrounding, so copied texts add a row and not their bytes.
    """
    narrow = rows.select(F.col(key).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    entries = materialize(_scan(narrow, min_bytes, q))
    grams = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("around") == F.max("around")).alias("same")).where("n > 1")
    shared = materialize(_with_counts(entries, materialize(grams), "same"))
    plain = shared.where("same").select("doc_key", "first", F.col("last").alias("end"))

    mixed = shared.where("not same")
    one = mixed.groupBy("gram", "around").agg(F.min(F.struct("doc_key", "first", "last")).alias("e"), F.count(F.lit(1)).alias("n"))
    one = materialize(one)
    kinds = one.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).withColumn("kinds", F.col("n"))
    one = _with_counts(one, materialize(kinds), "kinds")
    listed = one.groupBy(F.col("e.doc_key").alias("list_key")).agg(F.collect_list(F.struct("gram", "around", "n", "kinds", F.col("e.first").alias("first"), F.col("e.last").alias("last"))).alias("entry_list"))
    contents = _contents(rows.join(listed, F.col(key) == F.col("list_key")), text, "entry_list", min_bytes)
    # Repeated rows (equal ids and texts) give equal contents; one of each leaves its task.
    contents = materialize(contents.dropDuplicates(["gram", "around"]))
    found = _refine(contents.where(F.col("kinds") <= together), min_bytes, q).unionByName(_refine_spread(contents.where(F.col("kinds") > together), min_bytes))
    spread = mixed.join(found, ["gram", "around"]).select("doc_key", (F.col("first") + F.col("run_first")).alias("first"), (F.col("first") + F.col("run_last")).alias("end"))
    spans = plain.unionByName(spread).select("doc_key", F.struct("first", (F.col("end") + min_bytes).alias("end")).alias("span"))
    return spans.groupBy("doc_key").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted((s["first"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", min_bytes: int = MIN_BYTES, q: int = Q, together: int = TOGETHER) -> DataFrame:
    """``docs`` with removed (array of byte spans) and kept (binary: the remaining bytes)."""
    names = docs.columns
    key_name, list_name, removed, kept = (free_name(names, n) for n in ("doc_key", "spans", "removed", "kept"))
    rows = docs.withColumn(key_name, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    found = find_repeats(rows, min_bytes, q, together, key_name, text)
    found = found.select(F.col("doc_key").alias("found_key_"), F.col("spans").alias(list_name))
    joined = rows.join(found, F.col(key_name) == F.col("found_key_"), "left").select(*[rows[f"`{c}`"] for c in names], list_name)
    span_type = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(removed, span_type), T.StructField(kept, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, text, SLICE_BYTES):
                cut, rest = [], []
                for raw, spans in zip(batch.column(text).cast(pa.binary()), batch.column(list_name).to_pylist()):
                    raw, spans = raw.as_py() or b"", merged(spans or [])
                    at, parts = 0, []
                    for a, z in spans:
                        parts.append(raw[at:a])
                        at = z
                    cut.append([{"first": a, "end": z} for a, z in spans])
                    rest.append(b"".join([*parts, raw[at:]]))
                kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cut, kinds), pa.array(rest, pa.binary())], [*names, removed, kept])

    return joined.mapInArrow(run, schema)


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; a character cut apart goes whole."""
    out = remove_repeats(docs, text, key, **options)
    removed, kept = out.columns[-2:]
    changed = F.size(F.col(removed)) > 0
    # Cutting bytes can leave parts of characters; those are replaced and then dropped.
    clean = F.regexp_replace(F.call_function("make_valid_utf8", F.col(kept).cast("string")), "\ufffd", "")
    text_out = F.when(changed, clean).otherwise(F.col(f"`{text}`"))
    return out.select(*[(text_out if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def digest(out: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    removed, kept = out.columns[-2:]
    n_removed = F.aggregate(F.col(removed), F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    return out.select(F.col(key).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), n_removed.alias("n_removed"),
                      F.size(removed).cast("long").alias("n_spans"), F.sha2(F.col(kept), 256).alias("kept_sha256"))

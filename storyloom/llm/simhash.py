"""SimHash near-duplicates through pigeonhole blocks.

A text is lower-cased (A-Z), cut into words at ASCII white space and into shingles of
``SHINGLE`` words, repeats included; a bit of the 64-bit fingerprint is set when it is
set in over half of the shingles' XXH64 values (seed 42).  Texts with fewer words have
one shingle; texts without words have fingerprint zero and are linked like any other.

Fingerprints that differ in at most two bits agree in at least two of four 16-bit blocks,
so they meet in one of six joins on a pair of blocks; the distance is then verified.  A
block pair that many fingerprints share is not paired off: two fingerprints are at most
two bits apart exactly when both are at most one bit from some third value, so the
members of a large block are grouped by their one-bit variants and each group is linked
to its smallest member, which is linear in its size and leaves the same components.

Null texts count as empty.  Rows with equal texts, repeated rows included, share a
fingerprint and each have a row in the result.  A bit that exactly half of the shingles
have is not set (the one tie there is).  A component's id is its smallest doc_id (nulls
only where all its ids are null).  Very long texts are hashed whole, their bits counted
run by run.  An empty table gives an empty table; further columns, whatever their names,
are ignored (``deduplicate`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import byte_slices, free_name, materialize
from storyloom.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Block pairs with more fingerprints than this are linked through one-bit variants.
PAIRED_BLOCK = 32
SLICE_BYTES = 2 << 20
ROWS_AT_ONCE = 1 << 16


def _bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), ROWS_AT_ONCE):
        some = hashes[k:k + ROWS_AT_ONCE]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1:].tolist())]
    return _bits(np.array(hashes, "<u8"))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fingerprint (signed 64 bits) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                found = np.array([text_fingerprint(x.as_py(), shingle) for x in batch.column("text").cast(pa.binary())], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def links(values: DataFrame, max_bits: int = MAX_BITS, paired_block: int = PAIRED_BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs at most ``max_bits`` apart.

    ``values`` has distinct ``fingerprint``s.  Both kinds of blocks verify the distance.
    """
    if max_bits != 2:
        raise ValueError("blocks and variants are laid out for two bits")
    part = lambda i: F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(F.lit(0xFFFF))
    blocks = [F.struct(F.lit(c).alias("c"), (F.shiftleft(part(i), 16) + part(j)).alias("v"), F.lit(i).alias("i"), F.lit(j).alias("j"))
              for c, (i, j) in enumerate(combinations(range(4), 2))]
    rows = values.select("fingerprint", F.explode(F.array(*blocks)).alias("block"))
    rows = rows.select("fingerprint", (F.col("block.c").cast("long") * (1 << 32) + F.col("block.v")).alias("block"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "block")

    small = rows.where(F.col("n") <= paired_block).select("block", F.col("fingerprint").alias("a"))
    pairs = small.join(small.select("block", F.col("a").alias("b")), "block").where("a < b").where(_near("a", "b", max_bits)).select("a", "b")

    # The values that differ from a fingerprint in at most one bit outside the shared blocks.
    large = rows.where(F.col("n") > paired_block).select("fingerprint").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda k: F.when(k < 0, F.col("fingerprint")).otherwise(F.col("fingerprint").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    variants = large.select("fingerprint", F.explode(flips).alias("variant"))
    groups = variants.groupBy("variant").agg(F.min("fingerprint").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("variant", "least")
    stars = variants.join(groups, "variant").where("fingerprint <> least").select(F.col("least").alias("a"), F.col("fingerprint").alias("b")).distinct()
    return pairs.unionByName(stars.where(_near("a", "b", max_bits)))


def components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fingerprint, root): the smallest fingerprint reachable, for linked fingerprints only."""
    return connected_components(links(marked.select("fingerprint").distinct(), max_bits)).select(F.col("node").alias("fingerprint"), "root")


def _by_root(marked: DataFrame, max_bits: int) -> DataFrame:
    """(fingerprint, root, first) of each distinct fingerprint, first being its earliest row."""
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key"))).alias("first")
    values = marked.groupBy("fingerprint").agg(earliest)
    roots = values.join(components(marked, max_bits), "fingerprint", "left")
    return roots.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Copies collapse to one fingerprint before any join; fingerprints are written once and
    the last join brings them back to the rows (a copied text is a key that Spark splits).
    """
    marked = materialize(fingerprints(docs, text, key, shingle))
    roots = _by_root(marked, max_bits)
    ids = roots.groupBy("root").agg(F.min("first").alias("first"))
    named = roots.select("fingerprint", "root").join(ids, "root").select("fingerprint", F.col("first.doc_id").alias("component_id"))
    joined = marked.join(named, "fingerprint")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the smallest doc_id (ties by the text's hash, nulls last); columns of ``docs``."""
    marked = materialize(fingerprints(docs, text, key, shingle))
    first = _by_root(marked, max_bits).groupBy("root").agg(F.min("first").alias("first"))
    id_name, text_name = (free_name(docs.columns, n) for n in ("kept_doc_id", "kept_text_key"))
    keep = first.select(F.col("first.doc_id").alias(id_name), F.col("first.text_key").alias(text_name))
    rows = docs.withColumn(text_name, F.xxhash64(f"`{text}`")).alias("d")
    same = F.col(f"d.`{key}`").cast("long").eqNullSafe(F.col(f"k.`{id_name}`")) & (F.col(f"d.`{text_name}`") == F.col(f"k.`{text_name}`"))
    kept = rows.join(keep.alias("k"), same, "left_semi")
    return kept.dropDuplicates([key, text_name]).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A text is lower-cased (A-Z) and cut into words at ASCII white space; its set holds the
distinct shingles of ``SHINGLE`` words (fewer words: the whole sequence as one; none: the
empty set, which is linked with nothing).  Documents are linked when the Jaccard
similarity of their sets is at least ``PERCENT`` / 100.

1. Signatures.  Each of ``PERMUTATIONS`` hash permutations is evaluated once for a set and
   gives two values, its minimum and its maximum; either agrees between two sets with the
   probability of their similarity, and together they vary less than two minima.  Runs of
   ``ROWS`` minima, and of ``ROWS`` maxima, of different permutations form the bands.
2. Equal sets (by a 128-bit hash of the set) are one content from here on.
3. Candidates.  Contents that share a band are in one bucket.  A bucket is not paired off:
   first all its members meet its smallest one, its hub, and those links give components.
   A bucket whose members are all in one component is finished.  In the others, blocks of
   members meet block by block (never two blocks of one component), as a product of their
   incidence with hashes, and only pairs that would join components leave a task.
4. Each candidate pair is confirmed on the two texts' sets of words, not of hashes.  The
   members of a hub are dealt to groups, each of which gets the hub's text once.

Two sets of similarity s miss each other with probability (1 - s ** ROWS) ** bands: at 0.8
less than 5e-7, at 0.9 less than 1e-15.

Defined cases.  Null texts count as empty.  A component's id is its smallest doc_id (null
only where all its ids are null); rows with equal ids are kept or dropped together, and
``kept`` compares ids with null equal to null.  Very long texts are hashed whole, in runs
of permutations.  An empty table gives an empty table; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import byte_slices, free_name, materialize
from storyloom.llm.components import connected_components

SHINGLE = 2
PERCENT = 80
PERMUTATIONS = 144
ROWS = 6
SLICE_BYTES = 2 << 20
#: Shingles under which all permutations are taken at once (in cache).
SHINGLES_AT_ONCE = 1 << 14
#: Members that share one copy of a hub's text.
GROUP = 64
#: Contents and shingles of a block, and shingles that are counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096

_rng = np.random.default_rng(20251)
MULTIPLIERS = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND_KEYS = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, text_key binary, n_shingles long, content binary, bands array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[bytes], known: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; ``known`` has hashes of words."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = _mixed(total + hashes[k:n + k])
    return np.unique(total)


def signatures(sets: list[np.ndarray], permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each non-empty set (rows) under each permutation (columns)."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    least, most = np.empty((permutations, len(sets)), np.uint64), np.empty((permutations, len(sets)), np.uint64)
    buffer = np.empty_like(flat)
    for k in range(permutations):
        np.multiply(flat, MULTIPLIERS[k], out=buffer)
        least[k], most[k] = np.minimum.reduceat(buffer, first), np.maximum.reduceat(buffer, first)
    return least.T, most.T


def bands_of(least: np.ndarray, most: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Band values (64 bits): ``rows`` minima or maxima each, the band's number mixed in."""
    values = np.concatenate([least, most], axis=1)
    n = values.shape[1] // rows
    total = np.broadcast_to(BAND_KEYS[:n], (len(values), n)).copy()
    for k in range(rows):
        total = _mixed(total + values[:, k:n * rows:rows])
    return total


def _runs(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Runs of sets with about ``SHINGLES_AT_ONCE`` shingles."""
    start, held = 0, 0
    for k, s in enumerate(sets):
        if k > start and held + len(s) > SHINGLES_AT_ONCE:
            yield start, k
            start, held = k, 0
        held += len(s)
    if start < len(sets):
        yield start, len(sets)


def sign(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """``SIGNED``: a row for each row of ``docs``; sets too small to be linked with another set have no bands."""
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.unhex(F.md5(f"`{text}`")).alias("text_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # The most similar set that differs has one shingle more.
    least_size = -(-percent // max(1, 100 - percent)) if percent < 100 else 1 << 62
    names = [x.split()[0] for x in SIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                if len(known) > 300_000:
                    known.clear()
                sets = [shingle_hashes(x.as_py().lower().split(), known, shingle) for x in batch.column("text").cast(pa.binary())]
                contents = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                bands: list = [[]] * len(sets)
                banded = [k for k, s in enumerate(sets) if len(s) >= least_size]
                for a, z in _runs([sets[k] for k in banded]):
                    own = banded[a:z]
                    for k, b in zip(own, bands_of(*signatures([sets[k] for k in own], permutations), rows).view(np.int64)):
                        bands[k] = b
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(contents, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names)

    return narrow.mapInArrow(run, SIGNED)


def word_shingles(raw: bytes, shingle: int = SHINGLE) -> set:
    words = raw.lower().split()
    if len(words) <= shingle:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(shingle))))


EDGES = "a binary, b binary"


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``EDGES``: the pairs (a, b) whose texts' sets are similar enough; ``texts`` has (content, text)."""
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups"))
    dealt = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), "groups").alias("group"))
    members = dealt.join(texts.withColumnRenamed("content", "a"), "a").select("b", "group", F.lit(True).alias("member"), "a", "text")
    hubs = dealt.select("b", "group").distinct().join(texts.withColumnRenamed("content", "b"), "b").select("b", "group", F.lit(False).alias("member"), F.col("b").alias("a"), "text")
    met = members.unionByName(hubs).repartition("b", "group").sortWithinPartitions("b", "group", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            found = []
            for b, is_member, a, text in zip(*(batch.column(c) for c in ("b", "member", "a", "text"))):
                own = word_shingles(text.as_py().encode(), shingle)
                if not is_member.as_py():
                    hub = own
                elif 100 * len(own & hub) >= percent * len(own | hub):
                    found.append((a.as_py(), b.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])

    return met.mapInArrow(run, EDGES)


def contents_of(signed: DataFrame) -> DataFrame:
    """(content, n_shingles, text_key, bands, least): a row for each distinct set that is not empty."""
    return signed.where("content IS NOT NULL").groupBy("content").agg(
        F.first("n_shingles").alias("n_shingles"), F.min("text_key").alias("text_key"), F.first("bands").alias("bands"), F.min("doc_id").alias("least"))


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a content and the smallest content of a bucket of its (column b), where sizes allow a link."""
    hubs = rows.groupBy("band").agg(F.min(F.struct(F.col("content").alias("b"), F.col("n_shingles").alias("b_size"))).alias("hub")).select("band", "hub.*")
    met = rows.join(hubs, "band").where("content <> b")
    allowed = F.least("n_shingles", "b_size") * 100 >= F.greatest("n_shingles", "b_size") * percent
    return met.where(allowed).select(F.col("content").alias("a"), "b").distinct()


def _open(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    several = rows.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    return rows.join(several, "band")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(content, hashes): the sorted hashes of its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                if len(known) > 300_000:
                    known.clear()
                sets = [shingle_hashes(x.as_py().lower().split(), known, shingle).tobytes() for x in batch.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(sets, pa.binary())], ["content", "hashes"])

    return texts.select("content", "text").mapInArrow(run, "content binary, hashes binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left and right array of distinct values have in common."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    sides = []
    for some in (left, right):
        flat = np.concatenate(some)
        row = np.repeat(np.arange(len(some)), [len(x) for x in some])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        found = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[found], kind="stable")
        sides.append((row[found][order], at[found][order]))
    for start in range(0, len(both), COLUMNS):
        parts = []
        for some, (row, at) in zip((left, right), sides):
            a, z = np.searchsorted(at, [start, start + COLUMNS])
            part = np.zeros((len(some), min(COLUMNS, len(both) - start)), np.float32)
            part[row[a:z], at[a:z] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def cell_links(roots: tuple[list, list], sizes: tuple[np.ndarray, np.ndarray], sets: tuple[list, list], percent: int) -> list[tuple[int, int]]:
    """Pairs (of places left and right), as few as join the components that the cell's similar pairs join."""
    common = common_counts(*sets).astype(np.float64)
    number = {r: k for k, r in enumerate(dict.fromkeys([*roots[0], *roots[1]]))}
    a, b = (np.array([number[r] for r in side]) for side in roots)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    i, j = np.nonzero((a[:, None] != b[None, :]) & (100 * common >= percent * union))
    _, first = np.unique(a[i] * len(number) + b[j], return_index=True)
    out = []
    up = list(range(len(number)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k
    for k in first.tolist():
        p, q = top(a[i[k]]), top(b[j[k]])
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((int(i[k]), int(j[k])))
    return out


def _across(rows: DataFrame, sets: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """``EDGES``, to be confirmed, between components that share a bucket (rows: band, content, n_shingles, root).

    A bucket's members are dealt to blocks, large components to blocks of their own, and
    each two blocks that may hold different components are a cell.
    """
    counts = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    label = F.when(F.col("n") > block // 4, F.col("root")).otherwise(F.lit(b""))
    blocks = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.sum("size") / block_shingles)).cast("int")
    dealt = materialize(counts.withColumn("label", label).groupBy("band", "label").agg(blocks.alias("blocks")))
    of_root = counts.select("band", "root", label.alias("label")).join(dealt, ["band", "label"])
    place = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    members = materialize(rows.join(of_root, ["band", "root"]).select("band", "label", place.alias("block"), "content", "n_shingles", "root"))

    each = dealt.select("band", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = each.select("band", F.col("label").alias("label_2"), F.col("block").alias("block_2"))
    mine, yours = F.struct("label", "block"), F.struct(F.col("label_2").alias("label"), F.col("block_2").alias("block"))
    cells = each.join(other, "band").where((F.col("label") != F.col("label_2")) & (mine < yours) | (F.col("label") == F.lit(b"")) & (F.col("label_2") == F.lit(b"")) & (F.col("block") <= F.col("block_2")))
    cell = F.xxhash64("band", "label", "block", "label_2", "block_2").alias("cell")
    cells = materialize(cells.select("band", "label", "block", "label_2", "block_2", cell))
    left = members.join(cells, ["band", "label", "block"]).select("cell", F.lit(0).alias("side"), "content", "n_shingles", "root")
    crossing = cells.where("label <> label_2 OR block <> block_2").select("cell", "band", F.col("label_2").alias("label"), F.col("block_2").alias("block"))
    right = members.join(crossing, ["band", "label", "block"]).select("cell", F.lit(1).alias("side"), "content", "n_shingles", "root")
    met = left.unionByName(right).join(sets, "content")

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        names, roots = table["content"].to_pylist(), table["root"].to_pylist()
        sizes, raws = table["n_shingles"].to_numpy(), table["hashes"].to_pylist()
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        parts = [([roots[k] for k in x], sizes[x], [np.frombuffer(raws[k], np.uint64) for k in x]) for x in (a, b)]
        found = cell_links(*zip(*parts), percent) if len(a) and len(b) else []
        return pa.table([pa.array([names[a[i]] for i, _ in found], pa.binary()), pa.array([names[b[j]] for _, j in found], pa.binary())], ["a", "b"])

    found = met.groupBy("cell").applyInArrow(run, EDGES)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(contents: DataFrame, docs: DataFrame, text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``EDGES`` whose components are those of all similar pairs that share a bucket.

    ``contents``: a written table of ``contents_of``.
    """
    rows = contents.select("content", "n_shingles", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = materialize(rows.join(shared.select("band"), "band").select("band", "content", "n_shingles"))
    needed = contents.join(live.select("content").distinct(), "content", "left_semi").select("content", "text_key")
    whole = docs.select(F.unhex(F.md5(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    texts = materialize(whole.join(needed, "text_key").groupBy("content").agg(F.first("text").alias("text")))

    to_hubs = materialize(confirm(materialize(_hubs(live, percent)), texts, shingle, percent))
    roots = connected_components(to_hubs).select(F.col("node").alias("content"), "root")
    open_ = materialize(_open(live.join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))))
    sets = _sets(texts.join(open_.select("content").distinct(), "content", "left_semi"), shingle)
    across = materialize(_across(open_, materialize(sets), percent, block, block_shingles))
    return materialize(to_hubs.unionByName(confirm(across, texts, shingle, percent)))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    signed = materialize(sign(docs, text, key, shingle, permutations, rows, percent))
    contents = materialize(contents_of(signed))
    roots = connected_components(links(contents, docs, text, shingle, percent, block, block_shingles)).select(F.col("node").alias("content"), "root")
    named = contents.select("content", "least").join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "root").select("content", "component_id")
    full = signed.where("content IS NOT NULL").join(ids, "content").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("content IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (all rows with that id); rows without id stay."""
    found = near_duplicates(docs, text, key, **options)
    name = free_name(docs.columns, "kept_id")
    dropped = found.where("not kept").select(F.col("doc_id").alias(name)).distinct()
    kept = found.where("kept").select(F.col("doc_id").alias(name)).distinct()
    gone = dropped.join(kept, name, "left_anti")  # an id whose other row leads a component stays
    return docs.join(gone, F.col(f"`{key}`").cast("long") == F.col(name), "left_anti")

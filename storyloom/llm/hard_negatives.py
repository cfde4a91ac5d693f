"""Hard negatives of labelled vectors through a GNAT-style multiway hyperplane tree.

Vectors are of integers; a row's score with an anchor is their inner product, higher
scores first, ties by smaller id.  An anchor's positives are its ``POSITIVES`` best other
rows of its label; the negatives of a positive are the ``NEGATIVES`` best rows of other
labels whose score lies between ``LOW`` and ``HIGH`` percent of the positive's.

1. Space.  One more coordinate lifts every row to the same length, so a row's distance to
   an anchor falls as its score rises, and a window of scores is an annulus.
2. Tree.  A node has up to ``FANOUT`` split points far from each other, and a row goes to
   the nearest.  The split points come from a bounded sample (``SAMPLE_ROWS`` rows,
   ``SAMPLE_BYTES``); every row is then indexed, and for each split point and each of its
   siblings the least and greatest distance to the sibling's rows is stored, over all rows.
3. Search.  From the anchor's distance to a split point and the annulus follows the range
   in which that split point's distance to a wanted row must lie; a sibling whose stored
   range does not meet it is eliminated.  A first visit of one leaf raises the lower end of
   the window to the k-th best score found there, then all remaining leaves are visited.
4. Leaves are compared exactly: blocks of a leaf's rows meet blocks of the anchors that
   visit it, as one integer-valued matrix product, and k rows of each window leave a task.
   Only the pairing of blocks depends on sizes, so no leaf is one task's.

The eliminations are safe (with a margin for rounding), so results are those of comparing
all pairs.

Defined cases.  Rows with a null label or vector, or with a null or non-finite component,
take no part.  Components are held to +-2**26 so that scores fit 64 bits; shorter vectors
count as filled up with zeros.  Rows with the anchor's own id are neither its positives
nor its negatives; a null id differs from every id and comes last among ties.  Repeated
rows count each, and a repeated anchor returns its rows again.  Anchors without positives,
and positives whose window holds no row (any positive with a score below zero), return no
rows.  An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import materialize

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
FANOUT, LEAF_ROWS, MAX_DEPTH = 8, 2048, 6
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Rows and anchors that meet in one product; anchors that are multiplied at a time.
BLOCK_ROWS, BLOCK_ANCHORS, ANCHORS_AT_ONCE = 16_384, 4_096, 128
LIMIT = 1 << 26
EMPTY = (np.inf, -np.inf)


def integer_rows(rows: DataFrame, vector: Column, key: Column, label: Column) -> DataFrame:
    """(vec_id, label, q, size): the rows that take part, ``vector`` (array of numbers) as 32-bit integers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(vector, lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double")))).cast("int"))
    whole = rows.where(label.isNotNull() & vector.isNotNull() & F.coalesce(sound, F.lit(False)))
    narrow = whole.select(key.cast("long").alias("vec_id"), label.cast("long").alias("label"), held.alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [np.array(x.as_py(), "<i4") for x in batch.column("q")]
            size = [int((x.astype(np.int64) ** 2).sum()) for x in q]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(size, pa.int64())], ["vec_id", "label", "q", "size"])

    return narrow.mapInArrow(run, "vec_id long, label long, q binary, size long")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    raws = column.to_pylist()
    if all(len(r) == 4 * dim for r in raws):
        return np.frombuffer(b"".join(raws), "<i4").reshape(len(raws), dim).astype(np.float64)
    out = np.zeros((len(raws), dim))
    for k, r in enumerate(raws):
        out[k, :len(r) // 4] = np.frombuffer(r, "<i4")
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    largest = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if largest < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Node:
    points: np.ndarray  # split points
    lift: np.ndarray  # their further coordinate
    children: list[int]  # node number, or -1 - leaf number
    ranges: np.ndarray  # [i, j]: least and greatest distance of split point i to the rows of child j


class Tree:
    """Split points of every node; ``ranges`` are filled from all rows."""

    def __init__(self, dim: int, length2: int):
        self.dim, self.length2 = dim, length2
        self.nodes: list[Node] = []
        self.leaves = 0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.length2 - (x * x).sum(1)))

    def distances(self, x: np.ndarray, lift: np.ndarray, node: Node) -> np.ndarray:
        """Of rows (given their further coordinate) to a node's split points."""
        return np.sqrt(np.maximum(0.0, 2 * (self.length2 - x @ node.points.T - np.outer(lift, node.lift))))

    def grow(self, x: np.ndarray, leaf_rows: int, fanout: int, depth: int = 0) -> int:
        """Build the subtree of sample rows ``x``; gives its number as a child."""
        node = self._split(x, fanout) if len(x) > leaf_rows and depth < MAX_DEPTH else None
        if node is None:
            self.leaves += 1
            return -self.leaves
        self.nodes.append(node)
        at = len(self.nodes) - 1
        nearest = self.distances(x, self.lifted(x), node).argmin(1)
        node.children = [self.grow(x[nearest == j], leaf_rows, fanout, depth + 1) for j in range(len(node.points))]
        return at

    def _split(self, x: np.ndarray, fanout: int) -> Node | None:
        """Split points far from each other, out of some candidates; None if all rows are equal."""
        kinds = np.unique(x[np.random.default_rng(len(x)).permutation(len(x))[:8 * fanout]], axis=0)
        some = np.random.default_rng(len(kinds)).permutation(kinds)[:3 * fanout]
        if len(some) < 2:
            return None
        chosen, away = [0], None
        while len(chosen) < min(fanout, len(some)):
            gap = ((some - some[chosen[-1]]) ** 2).sum(1)
            away = gap if away is None else np.minimum(away, gap)
            chosen.append(int(away.argmax()))
        points = some[chosen]
        k = len(points)
        return Node(points, self.lifted(points), [], np.broadcast_to(np.array(EMPTY), (k, k, 2)).copy())

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; widens the ranges to hold the rows."""
        leaf, lift = np.zeros(len(x), np.int64), self.lifted(x)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            away = self.distances(x[rows], lift[rows], node)
            nearest = away.argmin(1)
            for j, child in enumerate(node.children):
                here = nearest == j
                if here.any():
                    node.ranges[:, j, 0] = np.minimum(node.ranges[:, j, 0], away[here].min(0))
                    node.ranges[:, j, 1] = np.maximum(node.ranges[:, j, 1], away[here].max(0))
                    if child < 0:
                        leaf[rows[here]] = -1 - child
                    else:
                        todo.append((child, rows[here]))
        return leaf

    def visits(self, x: np.ndarray, inner: np.ndarray, outer: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs that the annuli around the rows may reach; with ``first`` one promising leaf a row."""
        if not self.nodes:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        own2 = (x * x).sum(1)
        slack = 1e-6 * (1 + np.sqrt(own2 + self.length2))
        rows_out, leaves_out = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            away = np.sqrt(np.maximum(0.0, own2[rows, None] + self.length2 - 2 * (x[rows] @ node.points.T)))
            near = np.maximum(away - outer[rows, None], inner[rows, None] - away) - slack[rows, None]
            far = away + outer[rows, None] + slack[rows, None]
            met = (node.ranges[None, :, :, 0] <= far[:, :, None]) & (node.ranges[None, :, :, 1] >= near[:, :, None])
            alive = met.all(1)
            if first:  # the child whose split point lies just outside the inner radius, else the farthest
                value = np.where(away >= inner[rows, None], away, 4 * math.sqrt(self.length2 + 1) + own2[rows, None] - away)
                value[~alive] = np.inf
                pick = np.zeros_like(alive)
                pick[np.arange(len(rows)), value.argmin(1)] = True
                alive &= pick
            for j, child in enumerate(node.children):
                here = rows[alive[:, j]]
                if len(here) and child < 0:
                    rows_out.append(here)
                    leaves_out.append(np.full(len(here), -1 - child))
                elif len(here):
                    todo.append((child, here))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(rows_out or empty), np.concatenate(leaves_out or empty)


@dataclass
class Index:
    tree: Tree
    rows: DataFrame  # at, leaf, vec_id, label, q
    sizes: DataFrame  # leaf, n


INDEXED = "leaf int, at long, vec_id long, label long, q binary, node int, i int, j int, least double, most double"
INDEXED_NAMES = [x.split()[0] for x in INDEXED.split(", ")]


def build_index(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> Index:
    """Index all ``rows`` (of ``integer_rows``); split points come from a sample chosen by hash."""
    rows = materialize(rows)
    n, length2, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max(F.octet_length("q")), F.lit(0))).first()
    tree = Tree(max(1, width // 4), length2)
    most = max(2, min(sample_rows, sample_bytes // (4 * tree.dim)))
    share = min(1 << 20, math.ceil((1 << 20) * 1.2 * most / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "q"), F.lit(1 << 20)) < share).select("q").limit(most).collect()
    if sample:
        x = matrix(pa.array([bytes(r["q"]) for r in sample], pa.binary()), tree.dim)
        order = np.lexsort(x.T)
        tree.grow(x[order], max(fanout, math.ceil(leaf_rows * min(1.0, len(x) / n))), fanout)
    tree.leaves = max(1, tree.leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        at = (context.partitionId() if context else 0) << 33
        for batch in batches:
            m = batch.num_rows
            leaf = tree.place(matrix(batch.column("q"), tree.dim))
            columns = [pa.array(leaf.astype(np.int32)), pa.array(np.arange(at, at + m)), batch.column("vec_id"), batch.column("label"), batch.column("q"), *[pa.nulls(m, pa.int32())] * 3, *[pa.nulls(m, pa.float64())] * 2]
            at += m
            yield pa.RecordBatch.from_arrays(columns, INDEXED_NAMES)
        for k, node in enumerate(tree.nodes):  # the ranges over this task's rows
            i, j = np.nonzero(node.ranges[:, :, 0] <= node.ranges[:, :, 1])
            if len(i):
                m = len(i)
                columns = [pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.binary()), pa.array(np.full(m, k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(node.ranges[i, j, 0]), pa.array(node.ranges[i, j, 1])]
                yield pa.RecordBatch.from_arrays(columns, INDEXED_NAMES)

    placed = materialize(rows.mapInArrow(run, INDEXED))
    # A row for each pair of split points of a node: bounded by the sample.
    for r in placed.where("node IS NOT NULL").groupBy("node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
        tree.nodes[r["node"]].ranges[r["i"], r["j"]] = (r["least"], r["most"])
    whole = placed.where("leaf IS NOT NULL").select("at", "leaf", "vec_id", "label", "q")
    return Index(tree, whole, materialize(whole.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))))


VISITS = "leaf int, anchor long, anchor_id long, anchor_label long, anchor_q binary, windows array<struct<w:int,low:long,high:long>>"
WINDOW = pa.struct([("w", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def _route(index: Index, anchors: DataFrame, windows: DataFrame, first: bool) -> DataFrame:
    """``VISITS`` of the anchors' windows (anchor, w, low, high; null ends are open)."""
    tree = index.tree
    asked = windows.groupBy("anchor").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows"))
    rows = anchors.join(asked, "anchor").select("anchor", "anchor_id", "anchor_label", "anchor_q", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                x = matrix(batch.column("anchor_q"), tree.dim)
                asked = batch.column("windows").to_pylist()
                owner = np.array([k for k, own in enumerate(asked) for _ in own], np.int64)
                flat = [w for own in asked for w in own]
                reach = (x * x).sum(1)[owner] + tree.length2
                inner = np.array([0.0 if w["high"] is None else math.sqrt(max(0.0, r - 2 * w["high"])) for w, r in zip(flat, reach)])
                outer = np.array([np.inf if w["low"] is None else math.sqrt(max(0.0, r - 2 * w["low"])) for w, r in zip(flat, reach)])
                at, leaf = tree.visits(x[owner], inner, outer, first)
                order = np.lexsort((at, leaf))
                at, leaf = at[order], leaf[order]
                new = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (owner[at[1:]] != owner[at[:-1]])]) if len(at) else []
                if len(new):
                    own = pa.array(owner[at[new]])
                    lists = [[flat[k] for k in run_] for run_ in np.split(at, new[1:])]
                    columns = [pa.array(leaf[new].astype(np.int32)), *(batch.column(c).take(own) for c in range(4)), pa.array(lists, pa.list_(WINDOW))]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VISITS.split(", ")])

    return rows.mapInArrow(run, VISITS)


FOUND = "anchor long, w int, vec_id long, score long"


def _search(index: Index, visits: DataFrame, k: int, same: bool, block_rows: int, block_anchors: int) -> DataFrame:
    """``FOUND``: the ``k`` best rows of each window in each block of the visited leaves."""
    dim = index.tree.dim
    visits = materialize(visits)
    asked = visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("asked"))
    # One row for each leaf, and their number is bounded by the sample.
    plan = index.sizes.join(asked, "leaf").select("leaf", F.ceil(F.col("n") / block_rows).cast("int").alias("row_blocks"), F.ceil(F.col("asked") / block_anchors).cast("int").alias("anchor_blocks"))
    plan = F.broadcast(plan)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    rows = index.rows.join(plan, "leaf").select("leaf", dealt("at", "row_blocks").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("anchor_blocks") - 1)).alias("anchor_block"), "vec_id", "label", "q")
    anchors = visits.join(plan, "leaf").select(F.col("leaf").alias("leaf_"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block_"), dealt("anchor", "anchor_blocks").alias("anchor_block_"), "anchor", "anchor_id", "anchor_label", "anchor_q", "windows")

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        nulls: list[np.ndarray] = []
        if rows.num_rows and anchors.num_rows:
            x = matrix(rows["q"].combine_chunks(), dim)
            labels = rows["label"].to_numpy()
            no_id = rows["vec_id"].is_null().to_numpy()
            ids = rows["vec_id"].fill_null(0).to_numpy()
            # Rows in order of ids, null last: with a stable sort by score, ties stand by id.
            order = np.lexsort((ids, no_id))
            x, labels, no_id, ids = x[order], labels[order], no_id[order], ids[order]
            for start in range(0, anchors.num_rows, ANCHORS_AT_ONCE):
                some = anchors.slice(start, ANCHORS_AT_ONCE)
                products = scores(matrix(some["anchor_q"].combine_chunks(), dim), x)
                for s, key, own, label, windows in zip(products, *(some[c].to_pylist() for c in ("anchor", "anchor_id", "anchor_label", "windows"))):
                    right = labels == label if same else labels != label
                    if own is not None:
                        right &= no_id | (ids != own)
                    for w in windows:
                        fits = right
                        if w["low"] is not None:
                            fits = fits & (s >= w["low"])
                        if w["high"] is not None:
                            fits = fits & (s <= w["high"])
                        at = np.flatnonzero(fits)
                        if len(at) > k:
                            least = np.partition(s[at], len(at) - k)[len(at) - k]
                            at = at[s[at] >= least]
                        at = at[np.argsort(-s[at], kind="stable")[:k]]
                        out.append((np.full(len(at), key), np.full(len(at), w["w"], np.int32), ids[at], s[at]))
                        nulls.append(no_id[at])
        if not out:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], ["anchor", "w", "vec_id", "score"])
        anchor, w, vec_id, score = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(anchor), pa.array(w), pa.array(vec_id, mask=np.concatenate(nulls)), pa.array(score)], ["anchor", "w", "vec_id", "score"])

    return rows.groupBy("leaf", "row_block", "anchor_block").cogroup(anchors.groupBy("leaf_", "row_block_", "anchor_block_")).applyInArrow(meet, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, with their rank."""
    place = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def best_in_windows(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same: bool, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """(anchor, w, vec_id, score, rank): for each window (anchor, w, low, high) the first ``k``
    rows of the anchor's label (``same``) or of other labels whose score lies inside."""
    first = materialize(_best(_search(index, _route(index, anchors, windows, True), k, same, block_rows, block_anchors), k))
    least = first.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("anchor", "w", "least")
    narrowed = windows.join(least, ["anchor", "w"], "left").select("anchor", "w", F.greatest("low", "least").alias("low"), "high")
    return _best(_search(index, _route(index, anchors, narrowed, False), k, same, block_rows, block_anchors), k)


def _share(percent: int, up: bool) -> Column:
    """``percent`` of ``positive_score`` in whole numbers, rounded down (or up)."""
    sign = "-" if up else ""
    return F.expr(f"{sign}(({sign}{percent} * positive_score - pmod({sign}{percent} * positive_score, 100L)) div 100L)")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors.

    ``rows``: those of ``integer_rows``; ``is_anchor``: a condition on vec_id and label.
    """
    index = build_index(rows, sample_rows, leaf_rows=leaf_rows, fanout=fanout)
    anchors = materialize(index.rows.where(is_anchor).select(F.col("at").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("q").alias("anchor_q")))
    open_ = anchors.select("anchor", F.lit(0).alias("w"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    positives = best_in_windows(index, anchors, open_, n_positives, True, block_rows, block_anchors)
    positives = materialize(positives.select("anchor", F.col("rank").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.select("anchor", "w", _share(low, True).alias("low"), _share(high, False).alias("high")).where("low <= high")
    negatives = best_in_windows(index, anchors, windows, n_negatives, False, block_rows, block_anchors)
    out = negatives.select("anchor", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["anchor", "w"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

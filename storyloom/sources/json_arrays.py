"""Elements of large JSON arrays, each file read by many tasks.

A file is a bare array of objects, an object that wraps the array under one of some keys,
or objects one after the other (a single article, JSON lines).  It may be laid out in any
way, so a task that starts somewhere inside does not know whether it is inside a string or
how deep it is.  The work is done in two scans of splits (Spark's text source, with ``}``
as the separator of records, so that any file system it reads is split):

1. Each split is summarised for both cases, start outside and inside a string: quotes,
   change of depth, and the last bracket opened at each of the lowest depths, with its key.
   Running sums over the splits of a file turn the summaries into the state at each start.
2. With its state known, each split cuts out the elements that begin in it.  Parts of
   elements that cross a border are the only texts that are shuffled, to be joined.

Escapes and quotes are honoured; nothing is parsed here, so each element is parsed once, by
whoever reads the result.  Elements that are not objects are left out.  Text after the last
closing bracket is ignored, and so is an element that the file breaks off in, unless a
closing brace is all that it lacks.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.session import ensure_checkpoint_dir, ship_package

SLICE_BYTES = 4 << 20
#: Splits whose states are sent to all tasks at once (more go in several passes over the files).
STATES_AT_ONCE = 1_000_000
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
BOM = b"\xef\xbb\xbf"

SPLIT = "file string, block long"
SUMMARY = f"{SPLIT}, first string, quotes long, change array<long>, opened array<array<struct<depth:long,kind:string,key:string,named:array<string>>>>"
STATE = "in_string boolean, depth long, root string, wanted string, kind string, key string"
CUT = f"{SPLIT}, at int, whole boolean, begins boolean, text string"


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets, their depth change, the parity of the quotes before each, and the number of quotes."""
    buf = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(buf == 34)
    if (slash := np.flatnonzero(buf == 92)).size:
        # Backslashes before a quote: the distance to the last byte that is none.
        others = np.ones(len(buf) + 1, bool)
        others[slash + 1] = False
        last = np.maximum.accumulate(np.where(others, np.arange(len(buf) + 1), -1))
        quotes = quotes[(quotes - last[quotes]) % 2 == 0]
    folded = buf & 0xDF  # { [ and } ] differ in this bit only
    places = np.flatnonzero((folded == 0x5B) | (folded == 0x5D))
    step = np.where(folded[places] == 0x5B, 1, -1)
    return places, step, np.searchsorted(quotes, places) % 2, len(quotes)


def key_before(data: bytes, place: int) -> str | None:
    found = KEY.search(data[max(0, place - 500):place])
    return found[1].decode("utf-8", "replace") if found else None


def _runs(batches: Iterator[pa.RecordBatch], carried: Sequence[str] = ()) -> Iterator[tuple[str, int, dict, Iterator[bytes]]]:
    """Slices of bytes of each split: (file, block, carried columns, bytes); a split may come in several."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").cast(pa.binary()).to_pylist()
        extra = {c: batch.column(c) for c in carried}
        start, size = 0, 0
        for k in range(batch.num_rows + 1):
            if k == batch.num_rows or k > start and ((files[k], blocks[k]) != (files[start], blocks[start]) or size > SLICE_BYTES):
                if k > start:
                    yield files[start], blocks[start], {c: x[start].as_py() for c, x in extra.items()}, b"}".join(values[start:k]) + b"}"
                start, size = k, 0
            if k < batch.num_rows:
                size += len(values[k]) + 1


class _Summary:
    """Of one split, for a start outside (0) and inside a string (1)."""

    def __init__(self) -> None:
        self.first: str | None = None
        self.quotes = 0
        self.change = [0, 0]
        self.opened: list[dict[int, list]] = [{}, {}]

    def add(self, data: bytes, keys: Sequence[str]) -> None:
        if self.first is None and (text := data.removeprefix(BOM).lstrip()):
            self.first = text[:1].decode("utf-8", "replace")
        places, step, inside, n = structure(data)
        for case in (0, 1):
            real = (inside + self.quotes) % 2 == case
            at, move = places[real], step[real]
            depth = self.change[case] + np.cumsum(move) - move  # before each bracket
            for k in np.flatnonzero((move > 0) & (depth <= 1)):
                kind, key = chr(data[at[k]]), key_before(data, int(at[k]))
                known = self.opened[case].get(int(depth[k]), [None, None, []])
                named = known[2] + [key] if kind == "[" and key in keys and key not in known[2] else known[2]
                self.opened[case][int(depth[k])] = [kind, key, named]
            self.change[case] += int(move.sum())
        self.quotes += n

    def row(self, file: str, block: int) -> tuple:
        opened = [[{"depth": d, "kind": k, "key": x, "named": names} for d, (k, x, names) in case.items()] for case in self.opened]
        return file, block, self.first, self.quotes, self.change, opened


def _splits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", "false").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _states(splits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(file, block, ``STATE``) of each split's start."""
    kind = pa.struct([("depth", pa.int64()), ("kind", pa.string()), ("key", pa.string()), ("named", pa.list_(pa.string()))])
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(kind))]
    names = ["file", "block", "first", "quotes", "change", "opened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], _Summary] = {}
        for file, block, _, data in _runs(batches):
            found.setdefault((file, block), _Summary()).add(data, keys)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(s.row(*k) for k, s in found.items())), kinds)], names)

    rows = splits.mapInArrow(run, SUMMARY).checkpoint()
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    case = F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).cast("int")
    rows = rows.withColumn("case", case).withColumn("own", F.get("change", F.col("case")))
    rows = rows.withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0).cast("long")))
    # The bracket opened last at depth 1, and the wrapper keys whose arrays open there.
    here = F.get(F.filter(F.get("opened", F.col("case")), lambda x: x["depth"] + F.col("depth") == 1), F.lit(0))
    rows = rows.withColumn("here", here)
    last = F.last(F.when(F.col("here").isNotNull(), F.struct("here.kind", "here.key")), ignorenulls=True).over(before)
    rows = rows.withColumn("carry", last).withColumn("root", F.first("first", ignorenulls=True).over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    named = F.flatten(F.collect_list(F.coalesce("here.named", F.array().cast("array<string>"))).over(whole))
    wanted = F.coalesce(*[F.when(F.array_contains("all_named", k), F.lit(k)) for k in keys]) if keys else F.lit(None).cast("string")
    rows = rows.withColumn("all_named", named).withColumn("wanted", F.when(F.col("root") == "{", wanted))
    return rows.select("file", "block", (F.col("case") == 1).alias("in_string"), "depth", "root", "wanted", "carry.kind", "carry.key").checkpoint()


class _Cutter:
    """Cuts the elements out of one split, slice by slice."""

    def __init__(self, in_string: bool, depth: int, root: str | None, wanted: str | None, kind: str | None, key: str | None):
        self.quotes, self.depth = int(in_string), depth
        self.wanted = wanted
        self.level = 1 if root == "[" else 2 if wanted is not None else 0
        self.container = (kind, key)
        self.open = self._elements() and depth > self.level  # inside an element that began earlier
        self.begun_here = False
        self.held: list[bytes] = []
        self.count = 0

    def _elements(self) -> bool:
        return self.level < 2 or self.container == ("[", self.wanted)

    def _part(self, whole: bool, begins: bool, ends_text: bytes) -> tuple:
        self.count += 1
        return self.count, whole, begins, ends_text

    def add(self, data: bytes) -> Iterator[tuple]:
        places, step, inside, n = structure(data)
        real = (inside + self.quotes) % 2 == 0
        at, move = places[real], step[real]
        depth = self.depth + np.cumsum(move) - move
        # Brackets that open or close an element, or change the container.
        low = np.flatnonzero((depth == self.level) & (move > 0) | (depth + move == self.level) & (move < 0) | (depth == 1) & (move > 0))
        start = 0
        for k in low.tolist():
            place, byte = int(at[k]), data[at[k]]
            if self.level == 2 and depth[k] == 1 and move[k] > 0:
                self.container = (chr(byte), key_before(data, place))
            elif self.open and depth[k] + move[k] == self.level and move[k] < 0:
                self.held.append(data[start:place + 1])
                yield self._part(self.begun_here, self.begun_here, b"".join(self.held))
                self.held, self.open = [], False
            elif not self.open and depth[k] == self.level and move[k] > 0 and byte == 0x7B and self._elements():
                self.open, self.begun_here, start = True, True, place
        if self.open:
            self.held.append(data[start:])
        self.depth += int(move.sum())
        self.quotes += n

    def end(self) -> Iterator[tuple]:
        if self.open and self.held:
            yield self._part(False, self.begun_here, b"".join(self.held))


def _cut(splits: DataFrame) -> DataFrame:
    """``CUT``: whole elements, and parts of those that cross a border."""
    names = ["file", "block", "at", "whole", "begins", "text"]
    carried = [x.split()[0] for x in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cutter = None, None

        def packed(split: tuple, parts: list) -> pa.RecordBatch:
            at, whole, begins, text = zip(*parts)
            columns = [pa.repeat(split[0], len(at)), pa.repeat(pa.scalar(split[1], pa.int64()), len(at)), pa.array(at, pa.int32()), pa.array(whole), pa.array(begins)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([t.decode("utf-8", "replace") for t in text], pa.string())], names)

        for file, block, state, data in _runs(batches, carried):
            if (file, block) != last:
                if cutter and (parts := list(cutter.end())):
                    yield packed(last, parts)
                last, cutter = (file, block), _Cutter(**state)
            if parts := list(cutter.add(data)):
                yield packed(last, parts)
        if cutter and (parts := list(cutter.end())):
            yield packed(last, parts)

    return splits.mapInArrow(run, CUT)


def read_elements(spark: SparkSession, path: str | list[str], keys: Sequence[str] = (), states_at_once: int = STATES_AT_ONCE) -> DataFrame:
    """(file, block, at, text): every element of the files at ``path``, as JSON text.

    ``keys``: wrapper keys; of those under which a file's top object has an array, the
    first one counts.  (file, block, at) orders the elements.
    """
    ship_package(spark)
    splits = _splits(spark, path)
    states = _states(splits, keys)
    # A few dozen bytes for each split of 128 MB; beyond the limit the files go in several passes.
    passes = max(1, -(-states.count() // states_at_once))
    out = None
    for p in range(passes):
        some = states.where(F.pmod(F.xxhash64("file"), F.lit(passes)) == p)
        cut = _cut(splits.join(F.broadcast(some), ["file", "block"]))
        out = cut if out is None else out.unionByName(cut)
    # Written once: whole elements and parts are read from it separately.
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/elements-{uuid.uuid4().hex}"
    out.write.parquet(folder)
    out = spark.read.schema(out.schema).parquet(folder)
    # A part that ends is followed by others of other elements: number the beginnings.
    order = Window.partitionBy("file").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = out.where("not whole").withColumn("element", F.sum(F.col("begins").cast("int")).over(order))
    joined = parts.where("element > 0").groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("block", "at", "text"))).alias("parts"), F.min("block").alias("block"))
    text = F.array_join(F.transform("parts", lambda x: x["text"]), "")
    joined = joined.select("file", "block", F.get("parts", F.lit(0))["at"].alias("at"), text.alias("text"))
    closed = joined.where(F.try_parse_json("text").isNotNull())  # not one that the file breaks off in
    return out.where("whole").select("file", "block", "at", "text").unionByName(closed)

"""Language-model scoring with a hierarchical Pitman-Yor model.

Every token is a customer in the restaurant of its context, the word before it (one more
context is the start of a text); the tables of all context restaurants are customers of
one parent restaurant, whose own parent is the uniform distribution over the V known words
and one unknown word.  Words and contexts are told apart by 64-bit hashes.

Seating is sampled by Gibbs sweeps: dish by dish, the customers of a word get up and sit
down again one after the other (in blocks of a few per cent where a word has over
``ONE_BY_ONE`` customers in a restaurant), given everybody else's tables.  After
``BURN_IN`` sweeps the predictive probabilities of ``SAMPLES`` sweeps are averaged.

Distribution.  Texts are cut into blocks of bounded size, kept as packed word numbers.  A
block sends each part of the contexts one packed row, its cell: the distinct (context, word)
with their training counts.  Parts follow the input's size; a context with very many tokens
is dealt over several parts by the next word.  A part sums its cells' counts and keeps the
pairs with several customers (a single customer always has one table).  In a sweep it seats
them anew and sends the new tables summed by word (and by dealt-out context); these are
summed over all parts, the parent seats its customers, and each part gets back the parent's
probabilities of its words: every sweep sees the totals of the whole table.  Only the
parent's two totals, and the names of the dealt-out contexts (at most four times as many as
parts), reach the driver.  At the end the parts answer each cell with the counts and tables
of its pairs, and the blocks, joined with the values of their words and contexts, add up the
probabilities by document.

Shuffle files and tables that a later table replaces are deleted on the way, so that the
disk holds the blocks, one sweep and one exchange at a time.  Draws are seeded by sweep and
part, so scores vary a little with the number of parts.

Null texts count as empty (the end token alone); documents without an id count as
training text; repeated rows are scored each; ties do not occur; a very long text is a
block of its own; further columns are ignored; an empty table gives an empty table.

``_probabilities`` is the same chain over plain rows, ``Part`` over hash classes of contexts,
in memory and without Spark; the tests hold the model against them.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import arrow_map, byte_slices, materialize, utf8_size

HELD_OUT_MOD = 10
DISCOUNT, STRENGTH = 0.85, 5.0
TOP_DISCOUNT, TOP_STRENGTH = 0.6, 50.0
BURN_IN, SAMPLES, SEED = 4, 3, 99
ONE_BY_ONE = 64
SLICE_BYTES = 8 << 20
PART_BYTES = 12 << 20
END = b"\n"  # cannot be a word
DOCS = "i8,i1,i1,i8"  # id, whether it has one, whether it is training text, tokens
SMOOTH = 0.1
#: The context of a text's first token; like END it cannot be a word.
START = np.uint64(xxhash.xxh64_intdigest(b"\r"))
LAST = np.uint64(xxhash.xxh64_intdigest(END))

BLOCKS = "part int, batch long, train binary, docs binary, words binary, counts binary, body binary"
TOTALS = "kind int, context int, value long"
PAIRS = "word long, context long, n_train long, batch long, at int, block binary"
PACKED = "block long, docs binary, tokens binary, words binary"
WORDS = "word long, block long, at long, n_train long, n_all long"
CELLS = "part int, block long, body binary"
#: What parts send: sums of tables by word (TABLES) or dealt-out context (DEALT), their own
#: state (STATE), pairs with one customer by word and by context.
SENT = "part int, kind int, key long, own long, body binary"
TABLES, DEALT, STATE, SINGLE_WORD, SINGLE_CONTEXT = range(5)
#: Shuffle files go when the command that needed them ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def is_training(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % HELD_OUT_MOD != 0


def tokenize(raw: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, then the end token."""
    return [*raw.lower().split(), END]


def _blocks(batch: pa.RecordBatch, number: int, n_parts: int, contexts: int) -> Iterator[tuple]:
    """One row of ``BLOCKS`` for each part with tokens in this batch (part 0 always)."""
    seen: dict[bytes, int] = {}
    index, sizes = [], []
    for raw in batch.column("text").cast(pa.binary()):
        words = tokenize(raw.as_py())
        index += [seen.setdefault(w, len(seen)) for w in words]
        sizes.append(len(words))
    sizes = np.array(sizes)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
    word = np.array(index)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    context = np.empty(len(word), np.int64)  # class of the word before
    context[1:] = ((hashes >> np.uint64(8)) % np.uint64(contexts)).astype(np.int64)[word[:-1]]
    context[np.cumsum(sizes) - sizes] = contexts
    part = (hashes >> np.uint64(33)) % np.uint64(n_parts)
    order = np.lexsort((hashes, part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rows = np.sort((rank[word] << 32) | (context << 16) | doc)  # by part, word, context, document
    counts = np.bincount(rows >> 32, minlength=len(order))
    borders = np.searchsorted(part[order], np.arange(n_parts + 1))
    ends = np.r_[0, np.cumsum(counts)]
    ids = batch.column("doc_id").to_pylist()
    train = np.array([is_training(i) for i in ids], np.uint8).tobytes()
    docs = np.rec.fromarrays([[i or 0 for i in ids], [i is not None for i in ids], sizes], dtype="i8,i1,i8").tobytes()
    pack = zstandard.ZstdCompressor(level=1).compress
    for p in range(n_parts):
        a, z = borders[p], borders[p + 1]
        if a < z or p == 0:
            own = rows[ends[a]:ends[z]]
            body = ((own >> 16) & 0xFFFF).astype("<u2").tobytes() + (own & 0xFFFF).astype("<u2").tobytes()
            yield p, number, pack(train), pack(docs) if p == 0 else None, hashes[order[a:z]].tobytes(), pack(counts[a:z].astype("<u4").tobytes()), pack(body)


def _pairs(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """Rows of ``PAIRS``: the distinct (word, context) of a block, and one row (its number and no context, ``at`` -1) with its documents."""
    seen: dict[bytes, int] = {}
    index, sizes = [], []
    for raw in batch.column("text").cast(pa.binary()):
        words = tokenize(raw.as_py())
        index += [seen.setdefault(w, len(seen)) for w in words]
        sizes.append(len(words))
    sizes = np.array(sizes)
    hashes = np.r_[np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen)), START]
    word = np.array(index)
    before = np.r_[0, word[:-1]]
    before[np.cumsum(sizes) - sizes] = len(seen)
    pairs, at = np.unique(before * len(seen) + word, return_inverse=True)
    ids = batch.column("doc_id").to_pylist()
    train = np.array([is_training(i) for i in ids])
    n_train = np.bincount(at[np.repeat(train, sizes)], minlength=len(pairs))
    docs = np.rec.fromarrays([[i or 0 for i in ids], [i is not None for i in ids], train, sizes], dtype=DOCS).tobytes()
    block = zstandard.ZstdCompressor(level=1).compress(docs + at.astype("<u4").tobytes())
    n = len(pairs)
    contexts = pa.array(np.r_[hashes[pairs // len(seen)].view(np.int64), 0], mask=np.arange(n + 1) == n)
    columns = [np.r_[hashes[pairs % len(seen)].view(np.int64), number], contexts, np.r_[n_train, 0], np.full(n + 1, number), np.r_[np.arange(n, dtype=np.int32), np.int32(-1)]]
    blocks = pa.array([None] * n + [len(sizes).to_bytes(4, "little") + block], pa.binary())
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), blocks], [x.split()[0] for x in PAIRS.split(", ")])


def _freeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in as many bytes a number as its largest needs."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x).astype("<u8")
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [struct.pack("<IB", len(x), width), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _thaw(body: bytes) -> list[np.ndarray]:
    """The arrays of ``_freeze``, of four bytes a number or eight."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<IB", raw, at)
        wide = 4 if width <= 4 else 8
        x = np.zeros((n, wide), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.view(f"<u{wide}").ravel())
        at += 5 + n * width
    return out


def _packed(batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    """The row of ``PACKED`` of a block; words are numbered by falling frequency, the last number is the start's."""
    seen: dict[bytes, int] = {}
    index, sizes = [], []
    for raw in batch.column("text").cast(pa.binary()):
        words = tokenize(raw.as_py())
        index += [seen.setdefault(w, len(seen)) for w in words]
        sizes.append(len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in seen), np.uint64, len(seen))
    word, sizes = np.array(index), np.array(sizes)
    order = np.argsort(-np.bincount(word, minlength=len(seen)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[word]
    ids = batch.column("doc_id").to_pylist()
    train = np.array([is_training(i) for i in ids])
    docs = np.rec.fromarrays([[i or 0 for i in ids], [i is not None for i in ids], train, sizes], dtype=DOCS).tobytes()
    n_train = np.bincount(word[np.repeat(train, sizes)], minlength=len(seen))
    words = _freeze(np.r_[hashes[order], START], np.r_[n_train, 0], np.r_[np.bincount(word, minlength=len(seen)), len(ids)])
    columns = [[number], [zstandard.ZstdCompressor(level=1).compress(docs)], [_freeze(word)], [words]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], [x.split()[0] for x in PACKED.split(", ")])


def _blocks_of(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``PACKED`` rows of all blocks."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for some in byte_slices(whole, "text", SLICE_BYTES):
                if some.num_rows:
                    yield _packed(some, number)
                    number += 1

    return rows.mapInArrow(run, PACKED)


def _words_of(blocks: DataFrame) -> DataFrame:
    """``WORDS``: each block's words by number, with their training and all tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words")):
                hashes, n_train, n_all = _thaw(words.as_py())
                columns = [hashes.astype(np.uint64).view(np.int64), np.full(len(hashes), block), np.arange(len(hashes)), n_train.astype(np.int64), n_all.astype(np.int64)]
                found = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in WORDS.split(", ")])
                yield from (found.slice(k, 1 << 16) for k in range(0, found.num_rows, 1 << 16))

    return blocks.select("block", "words").mapInArrow(run, WORDS)


class Block:
    """The distinct (context, word) of a block, their places and their parts."""

    def __init__(self, docs: bytes, tokens: bytes, words: bytes, n_parts: int, dealt: dict[int, int]):
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(docs), DOCS)
        self.hashes = _thaw(words)[0].astype(np.uint64)
        word = _thaw(tokens)[0].astype(np.int64)
        n, sizes = len(self.hashes), self.docs["f3"]
        before = np.r_[n - 1, word[:-1]]
        before[np.cumsum(sizes) - sizes] = n - 1
        pairs, self.at = np.unique(before * n + word, return_inverse=True)
        self.context, self.word = pairs // n, pairs % n
        self.n_train = np.bincount(self.at[np.repeat(self.docs["f2"] == 1, sizes)], minlength=len(pairs))
        spread = np.ones(n, np.uint64)
        for i in np.flatnonzero(np.isin(self.hashes, np.array(list(dealt), np.uint64))):
            spread[i] = dealt[int(self.hashes[i])]
        part = ((self.hashes >> np.uint64(33))[self.context] + (self.hashes >> np.uint64(17))[self.word] % spread[self.context]) % np.uint64(n_parts)
        self.order = np.argsort(part, kind="stable")  # by part, context, word
        self.part = part[self.order].astype(np.int64)

    def cells(self) -> Iterator[tuple[int, bytes]]:
        """Part and cell: contexts and how many pairs each has, words, the pairs' words and training counts."""
        cuts = np.flatnonzero(np.r_[True, self.part[1:] != self.part[:-1], True])
        for a, z in zip(cuts, cuts[1:]):
            own = self.order[a:z]
            contexts, n = np.unique(self.context[own], return_counts=True)
            words, at = np.unique(self.word[own], return_inverse=True)
            yield int(self.part[a]), _freeze(self.hashes[contexts], n, self.hashes[words], at, self.n_train[own])


def _cells_of(blocks: DataFrame, n_parts: int, dealt: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = Block(row["docs"], row["tokens"], row["words"], n_parts, dealt).cells()
                parts, bodies = zip(*cells)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([row["block"]] * len(parts)), pa.array(bodies, pa.binary())], [x.split()[0] for x in CELLS.split(", ")])

    return blocks.mapInArrow(run, CELLS)


def _gathered(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A part's contexts, words, pairs (their context, word and training count), and the pair of each entry of its cells, with the cells' borders."""
    opened = [_thaw(x.as_py()) for x in cells["body"]]
    borders = np.cumsum([0, *(len(x[3]) for x in opened)])
    contexts, u = np.unique(np.concatenate([x[0] for x in opened]).astype(np.uint64), return_inverse=True)
    words, w = np.unique(np.concatenate([x[2] for x in opened]).astype(np.uint64), return_inverse=True)
    begin = np.cumsum([0, *(len(x[2]) for x in opened)])
    pairs = np.repeat(u, np.concatenate([x[1] for x in opened])) * len(words)
    for x, b, a, z in zip(opened, begin, borders, borders[1:]):
        pairs[a:z] += w[b:][x[3]]
    n_train = np.concatenate([x[4] for x in opened])
    del opened, u, w
    pairs, where = np.unique(pairs, return_inverse=True)
    where = where.astype(np.int32)
    c = np.bincount(where, n_train, len(pairs)).astype(np.int64)
    return contexts, words, pairs // len(words), pairs % len(words), c, where, borders


def _message(part: int, sums: list[tuple[int, np.ndarray, np.ndarray]], state: bytes) -> pa.Table:
    kinds = np.concatenate([[STATE], *(np.full(len(k), kind) for kind, k, _ in sums)])
    keys = np.concatenate([[0], *(k.view(np.int64) for _, k, _ in sums)])
    own = np.concatenate([[0], *(n for _, _, n in sums)])
    columns = [pa.array(np.full(len(keys), part), pa.int32()), pa.array(kinds.astype(np.int32)), pa.array(keys.astype(np.int64)), pa.array(own.astype(np.int64)), pa.array([state] + [None] * (len(keys) - 1), pa.binary())]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in SENT.split(", ")])


def _first(dealt: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
    """A part's first message, from its cells: one table for each pair."""
    def run(cells: pa.Table) -> pa.Table:
        contexts, words, u, w, c, _, _ = _gathered(cells)
        one, many = c == 1, c > 1
        by_word, by_context = np.bincount(w[one], minlength=len(words)), np.bincount(u[one], minlength=len(contexts))
        hot = np.isin(contexts, np.array(list(dealt), np.uint64))
        kept, own = np.union1d(u[many], np.flatnonzero(hot)), np.unique(w[many])
        ci, wi, single = np.searchsorted(kept, u[many]), np.searchsorted(own, w[many]), by_context[kept]
        tables = single + np.bincount(ci, minlength=len(kept))
        sums = [(TABLES, words[own], np.bincount(wi, minlength=len(own))), (DEALT, contexts[kept][hot[kept]], tables[hot[kept]]),
                (SINGLE_WORD, words[by_word > 0], by_word[by_word > 0]), (SINGLE_CONTEXT, contexts[by_context > 0], by_context[by_context > 0])]
        return _message(cells["part"][0].as_py(), sums, _freeze(contexts[kept], words[own], ci, wi, c[many], single, tables, hot[kept]))

    return run


def _sweep(sweep: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A part's next message, from its state and what came back for its words and dealt-out contexts."""
    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        part = state["part"][0].as_py()
        contexts, words, *numbers = _thaw(state["body"][0].as_py())
        contexts, words = contexts.astype(np.uint64), words.astype(np.uint64)
        ci, wi, c, single, tables, hot, *kept = (x.astype(np.int64) for x in numbers)
        kind, key, value = (answers[x].to_numpy() for x in ("kind", "key", "value"))
        parent = np.zeros(len(words))
        parent[np.searchsorted(words, key[kind == TABLES].view(np.uint64))] = value[kind == TABLES]
        tables[np.searchsorted(contexts, key[kind == DEALT].view(np.uint64))] = value[kind == DEALT]
        t = reseat(c, (STRENGTH + DISCOUNT * tables[ci]) * parent[wi], DISCOUNT, np.random.default_rng([SEED, sweep, part]))
        tables = single + np.bincount(ci, t, len(single)).astype(np.int64)
        kept += [t] if sweep >= BURN_IN else []
        sums = [(TABLES, words, np.bincount(wi, t, len(words))), (DEALT, contexts[hot == 1], tables[hot == 1])]
        return _message(part, sums, _freeze(contexts, words, ci, wi, c, single, tables, hot, *kept))

    return run


def _replies(cells: pa.Table, state: pa.Table) -> pa.Table:
    """Rows (block, part, body) that answer a part's cells: each pair's count, and its tables summed over the samples."""
    _, _, _, _, c, where, borders = _gathered(cells)
    tables = SAMPLES * np.minimum(c, 1)
    tables[c > 1] = sum(x.astype(np.int64) for x in _thaw(state["body"][0].as_py())[8:])
    bodies = [_freeze(c[where[a:z]], tables[where[a:z]]) for a, z in zip(borders, borders[1:])]
    return pa.Table.from_arrays([cells["block"], cells["part"], pa.array(bodies, pa.binary())], ["block", "part", "body"])


def reseat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after each dish's customers sat down one after the other.

    The next customer opens a table with probability weight / (weight + seated - discount * tables).
    """
    tables = np.ones(len(customers), np.int64)
    order = np.argsort(-customers, kind="stable")
    c, w, t = customers[order], weight[order], tables[order]
    n = len(c)
    seated = 1
    while True:
        n = int(np.searchsorted(-c[:n], -seated, side="left"))  # dishes with more customers than are seated
        if not n:
            break
        step = 1 if seated < ONE_BY_ONE else seated // 32
        p = w[:n] / (w[:n] + seated + (step - 1) / 2 - discount * t[:n])
        t[:n] += rng.random(n) < p if step == 1 else rng.binomial(np.minimum(step, c[:n] - seated), np.minimum(p, 1.0))
        seated += step
    tables[order] = np.minimum(t, c)
    return tables


class Part:
    """The customers of one part's words, and the chain of seatings."""

    def __init__(self, rows: list[dict], part: int, n_parts: int, contexts: int):
        unpack = zstandard.ZstdDecompressor().decompress
        self.rows, self.contexts, self.n_parts = rows, contexts, n_parts
        self.train = [np.frombuffer(unpack(r["train"]), np.uint8) for r in rows]
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        counts = [np.frombuffer(unpack(r["counts"]), "<u4") for r in rows]
        bodies = [np.frombuffer(unpack(r["body"]), "<u2") for r in rows]
        known, where = np.unique(np.concatenate(words), return_inverse=True)
        cuts = np.cumsum([0, *map(len, words)])
        self.keys, self.owners = [], []  # (word, context) and document of each token, by block
        width = contexts + 1
        for k, body in enumerate(bodies):
            half = len(body) // 2
            self.keys.append(np.repeat(where[cuts[k]:cuts[k + 1]], counts[k]) * width + body[:half])
            self.owners.append(body[half:])
        learnt = np.concatenate([key[t[o] == 1] for key, t, o in zip(self.keys, self.train, self.owners)])
        self.pairs, self.c = np.unique(learnt, return_counts=True)
        self.word, self.context = self.pairs // width, self.pairs % width
        self.n_words, self.width = len(known), width
        self.count = np.bincount(self.word, self.c, self.n_words).astype(np.int64)  # training count of each word
        self.rng = np.random.default_rng([SEED, part])

    def chain(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Kept samples: tables of each pair, customers and tables of each word in the parent restaurant."""
        known = self.count > 0
        tables = np.ones(len(self.c), np.int64)
        top = known.astype(np.int64)
        many = np.flatnonzero(self.c > 1)
        n_types = self.n_parts * int(known.sum())
        customers = np.bincount(self.word, tables, self.n_words).astype(np.int64)
        for sweep in range(BURN_IN + SAMPLES):
            open_top = (TOP_STRENGTH + TOP_DISCOUNT * self.n_parts * top.sum()) / (n_types + 1)
            parent = (customers - TOP_DISCOUNT * top + open_top) / (TOP_STRENGTH + self.n_parts * customers.sum())
            totals = self.n_parts * np.bincount(self.context, tables, self.width)
            weight = (STRENGTH + DISCOUNT * totals[self.context[many]]) * parent[self.word[many]]
            tables[many] = reseat(self.c[many], weight, DISCOUNT, self.rng)
            customers = np.bincount(self.word, tables, self.n_words).astype(np.int64)
            top = np.zeros(self.n_words, np.int64)
            top[known] = reseat(customers[known], np.full(int(known.sum()), open_top), TOP_DISCOUNT, self.rng)
            if sweep >= BURN_IN:
                yield tables, customers, top

    def totals(self) -> Iterator[tuple[int, int, int]]:
        """Rows of ``TOTALS``: kind 0 counts of contexts, 1 (0 words, 1 tokens); for sample m, 2 + 2m
        tables by context and 3 + 2m (0 customers, 1 tables) of the parent."""
        yield from ((0, u, int(n)) for u, n in enumerate(np.bincount(self.context, self.c, self.width)) if n)
        yield 1, 0, int((self.count > 0).sum())
        yield 1, 1, int(self.c.sum())
        for m, (tables, customers, top) in enumerate(self.chain()):
            yield from ((2 + 2 * m, u, int(n)) for u, n in enumerate(np.bincount(self.context, tables, self.width)) if n)
            yield 3 + 2 * m, 0, int(customers.sum())
            yield 3 + 2 * m, 1, int(top.sum())

    def scores(self, totals: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: known tokens, base score and model score of each document's tokens here."""
        n_types, n_tokens = int(totals[1][0]), int(totals[1][1])
        seen, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        word, context = seen // self.width, seen % self.width
        at = np.minimum(np.searchsorted(self.pairs, seen), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == seen if len(self.pairs) else np.zeros(len(seen), bool)
        mean = np.zeros(len(seen))
        for m, (tables, customers, top) in enumerate(self.chain()):
            by_context, (all_customers, all_top) = totals[2 + 2 * m], totals[3 + 2 * m][:2]
            open_top = (TOP_STRENGTH + TOP_DISCOUNT * all_top) / (n_types + 1)
            parent = (customers - TOP_DISCOUNT * top + open_top) / (TOP_STRENGTH + all_customers)
            own = np.zeros(len(seen))
            own[hit] = (self.c - DISCOUNT * tables)[at[hit]]
            mean += (own + (STRENGTH + DISCOUNT * by_context[context]) * parent[word]) / (STRENGTH + totals[0][context])
        score = np.log10(mean / SAMPLES)
        base = np.log10((self.count[word] + SMOOTH) / (n_tokens + SMOOTH * (n_types + 1)))
        known = (self.count[word] > 0).astype(float)
        begin = 0
        for k, (owner, train) in enumerate(zip(self.owners, self.train)):
            mine = where[begin:begin + len(owner)]
            begin += len(owner)
            yield k, *(np.bincount(owner, x[mine], len(train)) for x in (known, base, score))


def _reseated(rows: DataFrame, customers: str, weight: str, discount: float, sweep: int, name: str) -> DataFrame:
    """``rows`` with the column ``name``: tables after each dish's customers sat down again."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, sweep, TaskContext.get().partitionId()])
        for batch in batches:
            if batch.num_rows:
                found = reseat(batch.column(customers).to_numpy(), batch.column(weight).to_numpy(), discount, rng)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])
    return rows.mapInArrow(run, schema)


def _seatings(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[float], int, int]:
    """The chain over ``pairs`` (word, context, c).

    Returns pairs with c > 1 and their tables t0, t1, ... of the kept samples; contexts with
    their customers and tables; words with their count and the parent's probabilities p0,
    p1, ...; the parent's probability of the unknown word by sample; known words; tokens.
    """
    learnt = pairs.where("c > 0")
    single = F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("single")
    contexts = materialize(learnt.groupBy("context").agg(F.sum("c").alias("customers"), single))
    words = materialize(learnt.groupBy("word").agg(F.sum("c").alias("count"), single, F.count(F.lit(1)).alias("customers")).withColumn("top", F.lit(1).cast("long")))
    many = materialize(learnt.where("c > 1").select("word", "context", "c", F.lit(1).cast("long").alias("t")))
    n_types, n_tokens, all_customers = (x or 0 for x in words.agg(F.count(F.lit(1)), F.sum("count"), F.sum("customers")).first())
    all_top, unknown = n_types, []
    for sweep in range(BURN_IN + SAMPLES):
        open_top = (TOP_STRENGTH + TOP_DISCOUNT * all_top) / (n_types + 1)
        parent = (F.col("customers") - TOP_DISCOUNT * F.col("top") + open_top) / (TOP_STRENGTH + all_customers)
        totals = many.groupBy("context").agg(F.sum("t").alias("own")).join(contexts, "context").select("context", (F.col("own") + F.col("single")).alias("tables"))
        weighted = many.join(totals, "context").join(words.select("word", parent.alias("parent")), "word")
        weighted = weighted.withColumn("weight", (STRENGTH + DISCOUNT * F.col("tables")) * F.col("parent")).drop("t", "tables", "parent").sortWithinPartitions("word", "context")
        many = materialize(_reseated(weighted, "c", "weight", DISCOUNT, sweep, "t").drop("weight"))
        sums = many.groupBy("word").agg(F.sum("t").alias("own"))
        words = words.drop("customers", "top").join(sums, "word", "left").withColumn("customers", F.col("single") + F.coalesce("own", F.lit(0))).drop("own")
        words = materialize(_reseated(words.withColumn("weight", F.lit(open_top)).sortWithinPartitions("word"), "customers", "weight", TOP_DISCOUNT, 1000 + sweep, "top").drop("weight"))
        all_customers, all_top = (x or 0 for x in words.agg(F.sum("customers"), F.sum("top")).first())
        if sweep >= BURN_IN:
            m = sweep - BURN_IN
            open_top = (TOP_STRENGTH + TOP_DISCOUNT * all_top) / (n_types + 1)
            unknown.append(open_top / (TOP_STRENGTH + all_customers))
            many = many.withColumn(f"t{m}", F.col("t"))
            words = words.withColumn(f"p{m}", (F.col("customers") - TOP_DISCOUNT * F.col("top") + open_top) / (TOP_STRENGTH + all_customers))
    kept = [f"t{m}" for m in range(SAMPLES)]
    sums = many.groupBy("context").agg(*[F.sum(t).alias(t) for t in kept])
    contexts = contexts.join(sums, "context", "left").select("context", "customers", *[(F.col("single") + F.coalesce(t, F.lit(0))).alias(f"all_{t}") for t in kept])
    return many.select("word", "context", *kept), contexts, words.select("word", "count", *[f"p{m}" for m in range(SAMPLES)]), unknown, n_types, n_tokens


def _probabilities(pairs: DataFrame) -> tuple[DataFrame, int]:
    """``pairs`` (word, context, c and further columns) with known, base and score (log10), and the number of training tokens."""
    many, contexts, words, unknown, n_types, n_tokens = _seatings(pairs)
    kept = [f"t{m}" for m in range(SAMPLES)]
    few = pairs.where("c <= 1").withColumns({t: F.col("c") for t in kept})
    rows = few.unionByName(pairs.where("c > 1").join(many, ["word", "context"])).join(contexts, "context", "left").join(words, "word", "left")
    zero = F.lit(0)
    mean = sum((F.col("c") - DISCOUNT * F.col(t) + (STRENGTH + DISCOUNT * F.coalesce(f"all_{t}", zero)) * F.coalesce(f"p{m}", F.lit(unknown[m]))) / (STRENGTH + F.coalesce("customers", zero))
               for m, t in enumerate(kept)) / SAMPLES
    base = F.log10((F.coalesce("count", zero) + SMOOTH) / (n_tokens + SMOOTH * (n_types + 1)))
    return rows.select(*pairs.columns, F.col("count").isNotNull().alias("known"), base.alias("base"), F.log10(mean).alias("score")), n_tokens


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def _discard(written: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    spark = written.sparkSession
    for folder in {os.path.dirname(f) for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _chain(cells: DataFrame, vocabulary: DataFrame, dealt: dict[int, int]) -> tuple[DataFrame, DataFrame, list[float], int, int]:
    """The chain over the parts of ``cells``.

    Returns the parts' last states; values of words and contexts: count, the parent's
    probabilities p0, p1, ... and the context's tables t0, t1, ... by sample; the parent's
    probability of the unknown word by sample; known words; training tokens.
    """
    sent = materialize(cells.groupBy("part").applyInArrow(_first(dealt), SENT))
    by_word = sent.where(F.col("kind").isin(TABLES, SINGLE_WORD)).groupBy(F.col("key").alias("word"))
    by_word = by_word.agg(F.sum(F.when(F.col("kind") == SINGLE_WORD, F.col("own")).otherwise(0)).alias("single"), F.sum("own").alias("customers"))
    words = materialize(vocabulary.where("count > 0").select("word", "count").join(by_word, "word").withColumn("top", F.lit(1).cast("long")))
    singles = materialize(sent.where(F.col("kind") == SINGLE_CONTEXT).groupBy(F.col("key").alias("word")).agg(F.sum("own").alias("own")))
    n_types, n_tokens, all_customers = (x or 0 for x in words.agg(F.count(F.lit(1)), F.sum("count"), F.sum("customers")).first())
    all_top, unknown = n_types, []
    for sweep in range(BURN_IN + SAMPLES):
        old_sent, old_words = sent, words
        open_top = (TOP_STRENGTH + TOP_DISCOUNT * all_top) / (n_types + 1)
        parent = (F.col("customers") - TOP_DISCOUNT * F.col("top") + open_top) / (TOP_STRENGTH + all_customers)
        asked = sent.where(F.col("kind") == TABLES).select(F.col("part").alias("to"), "kind", "key")
        answers = asked.join(words.select(F.col("word").alias("key"), parent.alias("value")), "key").select("to", "kind", "key", "value")
        if dealt:
            parted = sent.where(F.col("kind") == DEALT).select(F.col("part").alias("to"), "kind", "key", "own")
            totals = parted.groupBy("key").agg(F.sum("own").cast("double").alias("value"))
            answers = answers.unionByName(parted.drop("own").join(totals, "key").select("to", "kind", "key", "value"))
        states = sent.where(F.col("kind") == STATE).select("part", "body")
        sent = materialize(states.groupBy("part").cogroup(answers.groupBy("to")).applyInArrow(_sweep(sweep), SENT))
        sums = sent.where(F.col("kind") == TABLES).groupBy(F.col("key").alias("word")).agg(F.sum("own").alias("own"))
        words = words.drop("customers", "top").join(sums, "word", "left").withColumn("customers", F.col("single") + F.coalesce("own", F.lit(0))).drop("own")
        words = materialize(_reseated(words.withColumn("weight", F.lit(open_top)).sortWithinPartitions("word"), "customers", "weight", TOP_DISCOUNT, 1000 + sweep, "top").drop("weight"))
        all_customers, all_top = (x or 0 for x in words.agg(F.sum("customers"), F.sum("top")).first())
        _discard(old_sent)
        _discard(old_words)
        if sweep >= BURN_IN:
            m = sweep - BURN_IN
            open_top = (TOP_STRENGTH + TOP_DISCOUNT * all_top) / (n_types + 1)
            unknown.append(open_top / (TOP_STRENGTH + all_customers))
            old_words = words
            words = materialize(words.withColumn(f"p{m}", (F.col("customers") - TOP_DISCOUNT * F.col("top") + open_top) / (TOP_STRENGTH + all_customers)))
            _discard(old_words)
    states = sent.where(F.col("kind") == STATE).select("part", "body")
    kept = [f"t{m}" for m in range(SAMPLES)]

    def tables(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for body in batch.column("body"):
            contexts, _, ci, _, _, _, _, _, *samples = _thaw(body.as_py())
            columns = [contexts.astype(np.uint64).view(np.int64), *(np.bincount(ci.astype(np.int64), t.astype(float), len(contexts)).astype(np.int64) for t in samples)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", *kept])

    several = arrow_map(states.select("body"), tables, "word long, " + ", ".join(f"{t} long" for t in kept))
    contexts = several.unionByName(singles.select("word", *[F.col("own").alias(t) for t in kept])).groupBy("word").agg(*[F.sum(t).alias(t) for t in kept])
    values = materialize(words.select("word", "count", *[f"p{m}" for m in range(SAMPLES)]).join(contexts, "word", "full"))
    _discard(words)
    _discard(singles)
    return states, values, unknown, n_types, n_tokens


def _valued(rows: pa.Table) -> pa.Table:
    """One row (block, body) with the values of a block's words in order of their numbers."""
    rows = rows.sort_by("at")
    counts = [rows[c].to_numpy() for c in ("count", *(f"t{m}" for m in range(SAMPLES)))]
    body = _freeze(*counts, *(np.ascontiguousarray(rows[f"p{m}"].to_numpy()).view(np.uint64) for m in range(SAMPLES)))
    return pa.Table.from_arrays([pa.array([rows["block"][0].as_py()]), pa.array([body], pa.binary())], ["block", "body"])


def _closed(rows: pa.Table, n_parts: int, dealt: dict[int, int], n_types: int, n_tokens: int) -> pa.RecordBatch:
    """``SCORED`` of one block from its own row, its cells' answers by part and its words' values by number."""
    block = Block(*(rows[c][0].as_py() for c in ("docs", "tokens", "words")), n_parts, dealt)
    kind = rows["kind"].to_numpy()
    answers = [_thaw(x.as_py()) for x in rows["body"].filter(pa.array(kind == 1))]
    c, tables = np.empty(len(block.order)), np.empty(len(block.order))
    c[block.order], tables[block.order] = (np.concatenate([x[k] for x in answers]).astype(float) for k in (0, 1))
    count, *values = _thaw(rows["body"].filter(pa.array(kind == 2))[0].as_py())
    count = count.astype(float)
    tables_of, parents = values[:SAMPLES], [x.astype(np.uint64).view(float) for x in values[SAMPLES:]]
    customers = count.copy()  # every training token but the last is the context of one
    customers[-1] = count[block.hashes == LAST][0]
    u, w = block.context, block.word
    mean = SAMPLES * c - DISCOUNT * tables
    for m in range(SAMPLES):
        mean += (STRENGTH + DISCOUNT * tables_of[m].astype(float)[u]) * parents[m][w]
    score = np.log10(mean / (STRENGTH + customers[u]) / SAMPLES)
    base = np.log10((count + SMOOTH) / (n_tokens + SMOOTH * (n_types + 1)))[w]
    known = (count > 0).astype(float)[w]
    ids = block.docs
    n, owner = len(ids), np.repeat(np.arange(len(ids)), ids["f3"])
    known, base, score = (np.bincount(owner, x[block.at], n) for x in (known, base, score))
    return pa.RecordBatch.from_arrays([pa.array(ids["f0"], mask=ids["f1"] == 0), pa.array(ids["f2"] == 0), pa.array(ids["f3"]), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                                      [x.split()[0] for x in SCORED.split(", ")])


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """``SCORED`` and train_tokens: log10 probabilities of every text, learnt from the training documents."""
    spark = docs.sparkSession
    n_parts = max(1, math.ceil((docs.agg(F.sum(utf8_size(text))).first()[0] or 0) / part_bytes))
    with _shuffles_freed(spark):
        blocks = materialize(_blocks_of(docs, text, key))
        vocabulary = materialize(_words_of(blocks).groupBy("word").agg(F.sum("n_train").alias("count"), F.sum("n_all").alias("n_all")))
        share = (vocabulary.agg(F.sum("n_all")).first()[0] or 0) / (4 * n_parts)  # a context with more tokens is dealt out
        often = vocabulary.where((F.col("n_all") > share) & F.lit(n_parts > 1)).select("word", "n_all").collect()
        dealt = {r["word"] % (1 << 64): min(n_parts, math.ceil(2 * r["n_all"] / share)) for r in often}
        cells = _cells_of(blocks, n_parts, dealt)
        states, values, unknown, n_types, n_tokens = _chain(cells, vocabulary, dealt)
        replies = materialize(cells.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(_replies, "block long, part int, body binary"))
        zero = F.lit(0).cast("long")
        of_words = _words_of(blocks).select("word", "block", "at").join(values, "word", "left")
        of_words = of_words.select("block", "at", F.coalesce("count", zero).alias("count"), *[F.coalesce(f"p{m}", F.lit(unknown[m])).alias(f"p{m}") for m in range(SAMPLES)], *[F.coalesce(f"t{m}", zero).alias(f"t{m}") for m in range(SAMPLES)])
        of_words = materialize(of_words.groupBy("block").applyInArrow(_valued, "block long, body binary"))
    rows = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "docs", "tokens", "words")
    rows = rows.unionByName(replies.select("block", F.lit(1).alias("kind"), F.col("part").cast("long").alias("at"), "body"), allowMissingColumns=True)
    rows = rows.unionByName(of_words.select("block", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("at"), "body"), allowMissingColumns=True)
    together = rows.repartition("block").sortWithinPartitions("block", "kind", "at")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    if held and held[0].column("block")[0].as_py() != number[a]:
                        yield _closed(pa.Table.from_batches(held), n_parts, dealt, n_types, n_tokens)
                        held = []
                    held.append(batch.slice(a, z - a))
        if held:
            yield _closed(pa.Table.from_batches(held), n_parts, dealt, n_types, n_tokens)

    return together.mapInArrow(add, SCORED).withColumn("train_tokens", F.lit(int(n_tokens)).cast("long"))


def perplexity(score: str = "score") -> Column:
    """Aggregate expression: perplexity per token of rows of ``score_documents``."""
    return F.pow(F.lit(10.0), -F.sum(score) / F.sum("n_tokens"))

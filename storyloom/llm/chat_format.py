"""Chat formatting by columnar byte assembly.

The turns of a conversation become a string

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n ...

together with the code-point spans of the loss mask, which cover the assistant texts.  The
string comes as one row or, where the conversation is long or lies across partitions, as
several (its runs of turns, ascending ``run``), each of about ``RUN_BYTES`` at most besides
its last turn; ``with_starts`` adds where each begins in the whole string.
Control strings inside texts and roles are escaped with a backslash after their first
character (backslashes are doubled), so the format can be read back exactly.

A batch of sorted turns is assembled with numpy: segment lengths, cumulative offsets and
scatter indices are computed for all headers, texts and endings at once, and the bytes
are copied into one buffer that Arrow then uses as it is.

Null texts and roles count as empty; rows are ordered by turn (nulls first), then role
and text, so ties and repeated rows give the same output in any input order; rows with a
null conversation id form one conversation.  An empty table gives an empty table.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import byte_slices

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that must not appear unescaped in a text (the first two are this template's).
CONTROL = ["<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|endoftext|>"]
LOSS_ROLE = "assistant"
#: Text bytes of a run of turns, each turn counted with TURN_BYTES more.
RUN_BYTES, TURN_BYTES = 4 << 20, 64
KEY_CHARS = 64

FORMATTED = "conv_id long, run long, formatted string, n_chars long, n_turns long, loss_spans array<struct<start: long, length: long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_UNESCAPE = re.compile(r"\\(\\?)", re.S)


def escape(texts: pa.Array, control=CONTROL) -> pa.Array:
    """Escaped texts; whole columns at a time."""
    out = pc.replace_substring(texts, "\\", "\\\\")
    for c in control:
        if pc.any(pc.match_substring(out, c)).as_py():
            out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return out


def unescape(text: str) -> str:
    """Doubled backslashes become one, single ones go."""
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _scatter(out: np.ndarray, starts: np.ndarray, offsets: np.ndarray, source: np.ndarray) -> None:
    """Copy piece i, ``source[offsets[i]:offsets[i + 1]]``, to ``out[starts[i]:]``."""
    lengths = np.diff(offsets)
    total = int(lengths.sum())
    if total:
        shift = np.repeat(starts - offsets[:-1], lengths)
        at = np.arange(offsets[0], offsets[0] + total)
        out[at + shift] = source[offsets[0]:offsets[0] + total]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array, control=CONTROL) -> tuple[np.ndarray, pa.Array, np.ndarray, list]:
    """Format the turns of whole conversations, given as runs of equal ``conv``.

    Returns the first row of each conversation, the formatted strings, the turns of each
    and the loss spans of each (start and length in code points).
    """
    n = len(conv)
    is_loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    shown = pc.replace_substring(escape(roles, control), "\n", "\\\n")
    heads = pc.binary_join_element_wise(pa.scalar(START), shown, pa.scalar("\n"), "")
    bodies = escape(texts, control)
    chars = np.empty((n, 3), np.int64)
    sizes = np.empty((n, 3), np.int64)
    chars[:, 0], chars[:, 1], chars[:, 2] = pc.utf8_length(heads), pc.utf8_length(bodies), len(END)
    sizes[:, 0], sizes[:, 1], sizes[:, 2] = pc.binary_length(heads), pc.binary_length(bodies), len(END)
    ends = np.cumsum(sizes.ravel()).reshape(n, 3)
    starts = ends - sizes
    out = np.empty(int(ends[-1, 2]), np.uint8)
    for k, column in ((0, heads), (1, bodies)):
        offsets, source = _buffer(column)
        _scatter(out, starts[:, k], offsets, source)
    tail = np.frombuffer(END.encode(), np.uint8)
    out[starts[:, 2][:, None] + np.arange(len(tail))] = tail

    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    bounds = np.r_[starts[first, 0], ends[-1, 2]]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    char_start = np.cumsum(chars.ravel()).reshape(n, 3) - chars
    turns = np.diff(np.r_[first, n])
    inside = char_start[:, 1] - np.repeat(char_start[first, 0], turns)
    spans = [[{"start": int(inside[i]), "length": int(chars[i, 1])} for i in range(a, a + m) if is_loss[i]] for a, m in zip(first, turns)]
    return first, formatted, turns, spans


def _range_keys() -> list[Column]:
    """Short keys in the order of (conv_id, turn, role, text): equal or ascending where those ascend."""
    text = F.when(F.char_length("role") <= KEY_CHARS, F.substring("text", 1, KEY_CHARS)).otherwise("")
    return [F.col("conv_id"), F.col("turn"), F.substring("role", 1, KEY_CHARS + 1), text]


def format_conversations(turns: DataFrame, control=CONTROL, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The runs of turns of each conversation: ``FORMATTED``.

    ``turns`` has conv_id, turn, role, text.  One shuffle by ranges of turns, so a hot
    conversation lies in several partitions; a task keeps one run of turns at a time.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*_range_keys()).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("run", pa.int64()), ("formatted", pa.string()), ("n_chars", pa.int64()), ("n_turns", pa.int64()),
                        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def emit(part: pa.Table, number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        ids = part["conv_id"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # Nulls sort first, so one change of validity and the value tell runs apart.
        conv = np.where(known, ids.fill_null(0).to_numpy(), 0)
        runs = np.cumsum(np.r_[False, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])])
        first, formatted, n, spans = assemble(runs, part["role"].combine_chunks(), part["text"].combine_chunks(), control)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array([next(number) for _ in first]), formatted.cast(pa.string()), pc.utf8_length(formatted).cast(pa.int64()),
                                         pa.array(n, pa.int64()), pa.array(spans, schema.field(5).type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        number = itertools.count(TaskContext.get().partitionId() << 32)  # ranges ascend with the partitions
        for batch in (some for whole in batches for some in byte_slices(whole, "text", run_bytes)):
            ids = batch.column(0)
            last = ids[-1].as_py()
            same = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            cut = batch.num_rows - int(pc.sum(same).as_py())  # where the last conversation of the batch begins
            if cut:
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, cut)]), number)
                held, size = [], 0
            elif held and held[-1].column(0)[-1].as_py() != last:
                yield from emit(pa.Table.from_batches(held), number)
                held, size = [], 0
            held.append(batch.slice(cut))
            size += (pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0) + TURN_BYTES * held[-1].num_rows
            if size >= run_bytes:  # the conversation goes on in its next run
                yield from emit(pa.Table.from_batches(held), number)
                held, size = [], 0
        if held:
            yield from emit(pa.Table.from_batches(held), number)

    return rows.mapInArrow(run, FORMATTED)


def with_starts(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``start``: the code points of the conversation before this run."""
    before = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return formatted.withColumn("start", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        cut = part.index("\n")
        while (cut - len(part[:cut].rstrip("\\"))) % 2:  # an escaped line break belongs to the role
            cut = part.index("\n", cut + 1)
        turns.append((unescape(part[:cut]), unescape(part[cut + 1:-len(END)])))
    return turns


class _Read:
    """What the runs of one conversation hold, added up in order."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[dict]) -> None:
        for r, t in read_back(text):
            self.n_turns += 1
            self.whole.update(f"{r}\n{t}\n".encode())
        for s in spans:
            said = unescape(text[s["start"]:s["start"] + s["length"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from their runs in order: ``DIGEST``."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Read | None = None
        for batch in batches:
            done = []
            for conv, text, spans in zip(*(batch.column(c) for c in ("conv_id", "formatted", "loss_spans"))):
                conv = conv.as_py()
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.row())
                    held = _Read(conv)
                held.add(text.as_py(), spans.as_py())
            if done:
                yield packed(done)
        if held is not None:
            yield packed([held.row()])

    rows = formatted.select("conv_id", "run", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "run")
    return rows.mapInArrow(run, DIGEST)

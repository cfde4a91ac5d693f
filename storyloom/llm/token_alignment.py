"""Alignment of two tokenizers over the same texts, on Arrow arrays.

Every text is encoded by a byte-level BPE (A) and a SentencePiece model (B) as space +
text.  Byte offsets where tokens of both end cut them into groups; an A and a B token are
linked where their byte ranges overlap; an id pair's count is its number of links in the
whole corpus.

1. Encoding.  A text is cut before every space that follows a character other than white
   space: no token of either vocabulary crosses such a place, so each distinct unit is
   encoded once per slice of texts.  The ids of a text are its units' ids, taken as Arrow
   lists and flattened; parent indices lead back to the documents.
2. Alignment.  Running sums of token lengths, restarted at each document, are the ends of
   the tokens.  A full outer hash join of both sides on the document-end key, in order of
   that key, has a row for every piece between two borders, and such a piece lies in one A
   and one B token: filling the ids backwards gives the links, rows found on both sides
   end the groups.
3. Counting.  Links are counted per slice by ``Table.group_by``; Spark adds the slices'
   counts and finds each B id's highest.  The counts of a slice's pairs go back to the
   slice, where they meet the documents' links, kept as compressed pair numbers.

Defined cases.  Null and empty texts, and texts whose tokens' bytes differ from space +
text (for instance with U+2581, which B reads as a space), have no tokens: zeros and an
empty digest.  Ties: links whose count equals the highest all count as best.  Repeated
rows are documents of their own, told apart by their place, and all their links count.  A
text longer than ``SLICE_BYTES`` is aligned piece by piece, cut between units; a single
unit is encoded whole.  An empty table gives an empty table; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import byte_slices, materialize

SLICE_BYTES = 2 << 20
#: Units that are encoded in one call, and units a worker remembers (it starts anew beyond that).
UNITS_AT_ONCE, REMEMBERED_UNITS = 500, 150_000
SPACE = "▁"  # B's mark of a space
WHITE = re.compile(r"(?:^|\s) ")  # a space that follows white space
UNIT_BORDER = re.compile(r"(?<=\S) ")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes in order for the
    characters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers of a worker with their tokens' bytes, and the units it has encoded."""

    _held: dict[tuple[str, str], Vocabularies] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        names = sorted((i, name) for name, i in self.a.get_vocab().items())
        a_bytes = [b""] * (names[-1][0] + 1)
        for i, name in names:
            a_bytes[i] = bytes(letters[c] for c in name)
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.tokens = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Vocabularies:
        if (a_path, b_path) not in cls._held:
            pa.set_cpu_count(1)
            cls._held[a_path, b_path] = cls(a_path, b_path)
        return cls._held[a_path, b_path]

    def _joined(self, side: int, ids: np.ndarray) -> bytes:
        taken = self.tokens[side].take(pa.array(ids))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int32)[taken.offset:taken.offset + len(taken) + 1]
        return data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None and len(taken) else b""

    def _alone(self, unit: str) -> tuple[bytes, bytes, bool]:
        """A unit behind a letter, whose ids are then taken off."""
        text = "a " + unit
        both = (self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text))
        first = (self.a.encode("a", add_special_tokens=False).ids, self.b.encode("a"))
        ids = [np.array(x[len(f):], np.int32) for x, f in zip(both, first)]
        whole = (" " + unit).encode()
        return ids[0].tobytes(), ids[1].tobytes(), all(self._joined(s, x) == whole for s, x in enumerate(ids))

    def learn(self, units: list[str]) -> None:
        """Encode units that are new, many to a text; each side's ids are cut at the units' ends."""
        if len(self.known) > REMEMBERED_UNITS:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        # White space at the end would join the next unit's space.
        plain = [u for u in new if u and not u[-1].isspace() and SPACE not in u]
        for u in set(new).difference(plain):
            self.known[u] = self._alone(u)
        for k in range(0, len(plain), 100 * UNITS_AT_ONCE):
            self._learn_plain(plain[k:k + 100 * UNITS_AT_ONCE])

    def _learn_plain(self, units: list[str]) -> None:
        runs = [" ".join(units[k:k + UNITS_AT_ONCE]) for k in range(0, len(units), UNITS_AT_ONCE)]
        coded = ([e.ids for e in self.a.encode_batch_fast([" " + r for r in runs], add_special_tokens=False)], self.b.encode(runs, num_threads=1))
        whole = "".join(" " + r for r in runs).encode()
        ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units)))
        cuts, raws = [], []
        for side, encoded in enumerate(coded):
            ids = np.concatenate([np.array(x, np.int32) for x in encoded])
            reach = np.cumsum(self.sizes[side][ids])
            at = np.searchsorted(reach, ends)
            if not len(reach) or at[-1] >= len(reach) or not np.array_equal(reach[at], ends) or self._joined(side, ids) != whole:
                for u in units:  # bytes are lost somewhere: one by one
                    self.known[u] = self._alone(u)
                return
            cuts.append([0, *(4 * (at + 1)).tolist()])
            raws.append(ids.tobytes())
        for k, u in enumerate(units):
            self.known[u] = (raws[0][cuts[0][k]:cuts[0][k + 1]], raws[1][cuts[1][k]:cuts[1][k + 1]], True)

    def lists(self, units: list[str]) -> tuple[pa.ListArray, pa.ListArray, np.ndarray]:
        """Lists of A and of B ids of each unit, and whether their bytes are the unit's."""
        self.learn(units)
        found = [self.known[u] for u in units]
        out = []
        for side in (0, 1):
            offsets = np.cumsum([0, *(len(f[side]) // 4 for f in found)], dtype=np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(f[side] for f in found), np.int32))))
        return out[0], out[1], np.fromiter((f[2] for f in found), bool, len(found))


def units_of(texts: list[str]) -> pa.ListArray:
    """Each text's units, without the space in front of each (and of the text)."""
    odd = [bool(WHITE.search(t)) for t in texts]
    split = pc.split_pattern(pa.array(texts, pa.string()), " ")
    if not any(odd):
        return split
    return pa.array([UNIT_BORDER.split(t) if o else s for t, o, s in zip(texts, odd, split.to_pylist())], pa.list_(pa.string()))


@dataclass
class Aligned:
    """The aligned texts of a slice; all arrays run over all valid texts, in order."""

    valid: np.ndarray  # of each text
    ids: tuple[pa.Array, pa.Array]  # A and B ids
    per_text: np.ndarray  # rows: A tokens, B tokens, groups and links up to the end of each valid text
    group_ends: tuple[np.ndarray, np.ndarray]  # A and B tokens up to the end of each group
    links: tuple[np.ndarray, np.ndarray]  # A and B id of each link


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], ends]).astype(np.int32))


def align_texts(texts: list[str], words: Vocabularies) -> Aligned:
    """Align texts that are not empty."""
    return align_units(units_of(texts), words)


def align_units(units: pa.ListArray, words: Vocabularies) -> Aligned:
    """Align texts given as lists of their units, at least one each."""
    coded = units.flatten().dictionary_encode()
    a_lists, b_lists, whole = words.lists(coded.dictionary.to_pylist())
    index = pa.ListArray.from_arrays(units.offsets, coded.indices)
    first = units.offsets.to_numpy()[:-1]
    valid = np.logical_and.reduceat(whole[coded.indices.to_numpy()], first)
    index = index.filter(pa.array(valid))
    unit, owner = index.flatten(), pc.list_parent_indices(index)

    sides, per_text = [], []
    n = int(valid.sum())
    for side, lists in enumerate((a_lists, b_lists)):
        own = lists.take(unit)
        ids, text = own.flatten(), owner.take(pc.list_parent_indices(own))
        ends = pc.cumulative_sum(pa.array(words.sizes[side]).take(ids))
        per_text.append(np.cumsum(np.bincount(text.to_numpy(), minlength=n)))
        sides.append((ids, ends))
    (a_ids, a_ends), (b_ids, b_ends) = sides
    # All texts lie end to end: the running end names both the text and the place in it.
    of_a = pa.table({"end": a_ends, "a": a_ids, "a_at": pa.array(np.arange(len(a_ids)))})
    of_b = pa.table({"end": b_ends, "b": b_ids, "b_at": pa.array(np.arange(len(b_ids)))})
    both = of_a.join(of_b, "end", join_type="full outer", use_threads=False)
    both = both.take(pc.sort_indices(both["end"]))
    links = tuple(pc.fill_null_backward(both[c]).to_numpy().astype(np.int64) for c in ("a", "b"))
    cut = both.filter(pc.and_(pc.is_valid(both["a_at"]), pc.is_valid(both["b_at"])))
    text_ends = a_ends.to_numpy()[per_text[0] - 1] if n else np.zeros(0, np.int64)
    per_text += [np.searchsorted(t["end"].to_numpy(), text_ends, "right") for t in (cut, both)]
    return Aligned(valid, (a_ids, b_ids), np.array(per_text).reshape(4, n), tuple(cut[c].to_numpy() + 1 for c in ("a_at", "b_at")), links)


def group_texts(found: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each valid text."""
    sides = [pc.binary_join(pa.ListArray.from_arrays(_offsets(ends), ids.cast(pa.string())), ",") for ids, ends in zip(found.ids, found.group_ends)]
    groups = pc.binary_join_element_wise(*sides, "|")
    return [x.as_buffer().to_pybytes() for x in pc.binary_join(pa.ListArray.from_arrays(_offsets(found.per_text[2]), groups), ";")]


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for whole in batches:
        for batch in byte_slices(whole, "text", limit):
            yield batch, batch.column("text").to_pylist()


def _pieces(text: str, words: Vocabularies, limit: int) -> list[str] | None:
    """A long text's pieces between units, or None if its tokens lose bytes."""
    pieces, held, size = [], [], 0
    for unit in UNIT_BORDER.split(text):
        held.append(unit)
        size += len(unit) + 1
        if size > limit // 4:
            pieces.append(held)
            held, size = [], 0
    pieces += [held] if held else []
    for units in pieces:
        if not words.lists(list(set(units)))[2].all():
            return None
    return pieces


def _aligned(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, limit: int) -> Iterator[tuple[list, list, Aligned | None]]:
    """(rows, last, alignment): rows has (row, doc_id, valid) of the texts that were aligned
    together; last says whether a row's text ends here (long texts come in several pieces)."""
    words = Vocabularies.of(a_path, b_path)
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 33
    for batch, texts in _slices(batches, limit):
        ids = batch.column("doc_id").to_pylist()
        rows = [(row + k, d) for k, d in enumerate(ids)]
        row += len(ids)
        none = [r for r, t in zip(rows, texts) if not t]
        if none:
            yield [(*r, False) for r in none], [True] * len(none), None
        there = [(r, t) for r, t in zip(rows, texts) if t]
        if len(there) == 1 and len(there[0][1]) > limit:
            (r, text), = there
            pieces = _pieces(text, words, limit)
            if pieces is None:
                yield [(*r, False)], [True], None
                continue
            for k, units in enumerate(pieces):
                yield [(*r, True)], [k == len(pieces) - 1], align_units(pa.array([units], pa.list_(pa.string())), words)
        elif there:
            found = align_texts([t for _, t in there], words)
            yield [(*r, bool(v)) for (r, _), v in zip(there, found.valid)], [True] * len(there), found


GROUPS = "row long, doc_id long, piece int, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``GROUPS``: both sides' ids of every text, and how many of them lie up to each group's end.

    Texts without tokens have empty lists; long texts have a row for each piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = 0
        for rows, last, found in _aligned(batches, a_path, b_path, slice_bytes):
            out, k = [], 0
            for r, d, valid in rows:
                if valid:
                    z = found.per_text[:, k]
                    y = found.per_text[:, k - 1] if k else np.zeros(4, np.int64)
                    out.append((r, d, piece, *(x[y[s]:z[s]].to_pylist() for s, x in enumerate(found.ids)), *((e[y[2]:z[2]] - y[s]).tolist() for s, e in enumerate(found.group_ends))))
                    k += 1
                else:
                    out.append((r, d, 0, [], [], [], []))
            piece = 0 if last[-1] else piece + 1
            kinds = [pa.int64(), pa.int64(), pa.int32()] + [pa.list_(pa.int32())] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in GROUPS.split(", ")])

    return _narrow(docs, text, key).mapInArrow(run, GROUPS)


def _narrow(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


#: Rows of texts (or their pieces) with their links as numbers of the slice's pairs, and rows of those pairs.
COUNTED = ("pair boolean, slice long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "links binary, a int, b int, at int, n long")
COUNTED_NAMES = [x.split()[0] for x in COUNTED.split(", ")]
_KINDS = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.binary(), *[pa.int32()] * 3, pa.int64()]


def _count(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        context = TaskContext.get()
        at_slice = (context.partitionId() if context else 0) << 33
        digest = hashlib.sha256()
        for rows, last, found in _aligned(batches, a_path, b_path, slice_bytes):
            at_slice += 1
            counts = np.zeros((4, len(rows)), np.int64)
            shas, links = [""] * len(rows), [None] * len(rows)
            if found is not None and found.per_text.shape[1]:
                table = pa.table({"a": found.links[0], "b": found.links[1]}).group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
                table = table.sort_by([("count_all", "descending"), ("a", "ascending"), ("b", "ascending")])
                a, b, n = (table[c].to_numpy() for c in ("a", "b", "count_all"))
                number = pc.index_in(pa.array((found.links[0] << 32) | found.links[1]), pa.array((a << 32) | b)).to_numpy()
                own = [k for k, r in enumerate(rows) if r[2]]
                counts[:, own] = np.diff(found.per_text, axis=1, prepend=0)
                z = found.per_text[3]
                for k, i, end, groups in zip(own, range(len(own)), z, group_texts(found)):
                    mine = number[z[i - 1] if i else 0:end].astype("<u4")
                    links[k] = pack.compress(mine.view(np.uint8).reshape(-1, 4).T.tobytes())
                    digest.update(groups)
                    if last[k]:
                        shas[k], digest = digest.hexdigest(), hashlib.sha256()
                    else:
                        digest.update(b";")
                m = len(n)
                columns = [pa.array(np.ones(m, bool)), pa.array(np.full(m, at_slice)), *[pa.nulls(m, pa.int64())] * 6, pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()),
                           pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, COUNTED_NAMES)
            m = len(rows)
            columns = [pa.array(np.zeros(m, bool)), pa.array(np.full(m, at_slice)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                       *[pa.array(c) for c in counts], pa.array(shas, pa.string()), pa.array(links, pa.binary()), *[pa.nulls(m, t) for t in _KINDS[10:]]]
            yield pa.RecordBatch.from_arrays(columns, COUNTED_NAMES)

    return docs.mapInArrow(run, COUNTED)


SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


def _score_slice(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """The links of a slice's texts with the whole corpus's counts of its pairs."""
    order = pairs["at"].to_numpy()
    count, best = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    count[order], best[order] = pairs["count"].to_numpy(), pairs["best"].to_numpy()
    open_ = zstandard.ZstdDecompressor()
    n_best, total = [], []
    for packed in texts["links"]:
        if packed.is_valid:
            planes = np.frombuffer(open_.decompress(packed.as_py()), np.uint8)
            number = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
            n_best.append(int(best[number].sum()))
            total.append(int(count[number].sum()))
        else:
            n_best.append(0)
            total.append(0)
    kept = texts.select(["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(a, b, count, best): the corpus's links of each id pair, and 1 where no pair of its B id has more."""
    counts = materialize(counted.where("pair").groupBy("a", "b").agg(F.sum("n").alias("count")))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def alignment_report(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    counted = materialize(_count(_narrow(docs, text, key), a_path, b_path, slice_bytes))
    valued = counted.where("pair").select("slice", "a", "b", "at").join(pair_counts(counted), ["a", "b"]).select(F.col("slice").alias("of_slice"), "at", "count", "best")
    texts = counted.where("not pair").drop("pair", "a", "b", "at", "n")
    scored = texts.groupBy("slice").cogroup(valued.groupBy("of_slice")).applyInArrow(_score_slice, SCORED)
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

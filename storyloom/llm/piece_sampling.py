"""SentencePiece encoding and decoding: sampled segmentations without replacement.

A text's lattice has an edge for every vocabulary piece at every place (characters without
a piece get their UTF-8 byte pieces).  A segmentation's probability is the normalized
product of its pieces' weights, a power of the piece's rank in the vocabulary.

Pieces never reach across a word's end, so the lattice is a chain of word lattices; equal
words share one, and sums over all completions are computed once for each word of a slice.
The search is top-down and perturbed (A* with truncated Gumbels): the whole lattice gets a
Gumbel and a sampled path; what is left is split by the first word at which another path
differs, every split part with the Gumbel of its mass, cut off at its parent's; the best
part is opened next.  Paths come out distinct and in Gumbel order, which is sampling
without replacement.  The Gumbel of the first part left unopened gives every path its
inclusion score, the log of its chance to be among the k.

All random numbers are hashes of the row's key, so a row's result does not depend on its
neighbours, and repeated rows get equal samples (equal parts tie in the search; the first
word counts).  ``decode`` restores the text exactly.  A very long text is one lattice; long
stretches without a space are walked from edges chosen for all their characters at once.

Null texts count as empty (one segmentation without pieces).  A text with fewer than k
segmentations gives as many rows as it has; the rest of a word whose mass is below
``ROUNDING`` counts as none.  An empty table gives an empty table.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import byte_slices

SAMPLES = 2
#: Weight of a piece: (1 + rank) ** -POWER.
POWER = 1.0
SEED = 10
SLICE_BYTES = 2 << 20
#: Edges of a path that are drawn one after the other, for all words at once.
LONG_PATH = 48
#: A rest of a word's mass below this is what rounding leaves of nothing.
ROUNDING = 1e-11
SPACE = "\u2581"
#: A space run belongs to the word behind it; line breaks and literal SPACE signs have no piece.
CHUNKS = re.compile(" +[^ \\n\u2581]*|[^ \\n\u2581]+|\\n|\u2581")
SAMPLED = "doc_id long, text_key long, sample int, n_pieces long, log_prob double, inclusion double, ids binary"

_MODELS: dict = {}


class _Slots:
    """Where distinct keys are, by open addressing: a key's slot or one of the next holds its place."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.place[slot] < 0)
            self.place[slot[free]] = left[free]  # the last of those with one slot stays
            on = self.place[slot] != left
            left, slot = left[on], (slot[on] + 1) & self.mask

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are keys, their places)."""
        slot = self._slot(h)
        place = self.place[slot]
        same = self.keys[place] == h
        again = np.flatnonzero((place >= 0) & ~same)
        while len(again):
            slot[again] = (slot[again] + 1) & self.mask
            p = self.place[slot[again]]
            place[again] = p
            same[again] = self.keys[p] == h[again]
            again = again[(p >= 0) & ~same[again]]
        hit = np.flatnonzero(same & (place >= 0))
        return hit, place[hit]


class Vocabulary:
    def __init__(self, path: str, power: float = POWER):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        # Only pieces that a chunk can hold: space signs first, no line breaks.
        usable = [(i, p) for i, p in zip(plain, pieces) if SPACE not in p.lstrip(SPACE) and "\n" not in p and " " not in p]
        self.longest = max(len(p) for _, p in usable)
        order = np.argsort([-sp.get_score(i) for i, _ in usable], kind="stable")
        rank = np.empty(len(usable))
        rank[order] = np.arange(len(usable))
        weight = -power * np.log(1 + rank)
        self.byte_weight = -power * float(np.log(1 + len(usable)))
        # By length: hashes of all pieces' beginnings, with the id and weight of those that are pieces.
        self.by_length: list[tuple[np.ndarray, _Slots, np.ndarray, np.ndarray]] = []
        for length in range(1, self.longest + 1):
            found = {p[:length]: (-1, -np.inf) for _, p in usable if len(p) >= length}
            found.update({p: (i, weight[k]) for k, (i, p) in enumerate(usable) if len(p) == length})
            keys = _hash(np.array([[ord(c) for c in p] for p in found], np.uint64))
            by = np.argsort(keys)
            ids, weights = (np.array(x) for x in zip(*found.values()))
            keys = keys[by]
            self.by_length.append((keys, _Slots(keys), ids[by].astype(np.int32), weights[by].astype(np.float32)))
        # For decoding: the bytes of every id, the space sign as a space.
        texts = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            texts[i] = bytes([b])
        self.sizes = np.array([len(t) for t in texts])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)


def vocabulary(path: str, power: float = POWER) -> Vocabulary:
    """Loaded once per Python worker."""
    if (path, power) not in _MODELS:
        _MODELS[path, power] = Vocabulary(path, power)
    return _MODELS[path, power]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _STEP + codes[:, k]
    return h


def _stirred(key: np.ndarray, *parts) -> np.ndarray:
    """A key mixed with further numbers."""
    x = key
    for p in parts:
        x = (x + np.asarray(p).astype(np.uint64) + np.uint64(1)) * _STEP
        x = x ^ (x >> np.uint64(31))
    return x


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) that only depend on the key and the parts."""
    x = _stirred(key, *parts) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


class Lattices:
    """The lattices of distinct chunks, as lists of the edges that leave each character.

    Characters are numbered end to end; the edges of those with equally many characters
    left in their chunk lie together, so sums run over whole slices of the edge list.
    """

    def __init__(self, chunks: list[str], v: Vocabulary):
        self.lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        literal = np.array([c == SPACE for c in chunks], bool)
        n = len(codes)
        left = np.repeat(self.starts + self.lengths, self.lengths) - np.arange(n)  # characters to the chunk's end
        look = np.where(codes == 32, np.uint64(ord(SPACE)), codes)
        look[self.starts[literal]] = 0  # a literal sign is spelled in bytes
        found = []
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(v.longest):  # only beginnings of pieces go on to the next length
            h = h * _STEP + look[at + k]
            _, slots, ids, weights = v.by_length[k]
            hit, place = slots.find(h)
            at, h = at[hit], h[hit]
            whole = ids[place] >= 0
            found.append((at[whole], ids[place[whole]], weights[place[whole]]))
            on = left[at] > k + 1
            at, h = at[on], h[on]
            if not len(at):
                break
        bare = np.ones(n, bool)
        if n:
            bare[found[0][0]] = False
        bare = np.flatnonzero(bare)
        # No piece for the character: its bytes, marked by the negative code point.
        size = 1 + (codes[bare] > 0x7F) + (codes[bare] > 0x7FF) + (codes[bare] > 0xFFFF)
        found.append((bare, -1 - codes[bare].astype(np.int64), v.byte_weight * size))

        degree = np.zeros(n, np.int64)
        for at, _, _ in found:
            degree[at] += 1
        order = np.argsort(left, kind="stable")
        ends = np.cumsum(degree[order])
        self.first = np.empty(n, np.int64)
        self.first[order] = ends - degree[order]
        self.last = self.first + degree - 1
        total = int(ends[-1]) if n else 0
        self.ids, self.log, self.step = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int16)
        target = np.empty(total, np.int32)
        slot = self.first.copy()
        for k in range(len(found) - 1, -1, -1):  # bytes, then the longest pieces first
            at, ids, weights = found[k]
            step = 1 if k == len(found) - 1 else k + 1
            e = slot[at]
            slot[at] += 1
            self.ids[e], self.log[e], self.step[e] = ids, weights, step
            target[e] = np.where(left[at] == step, n, at + step)
        # Log sums of all completions, from the chunks' ends backwards.
        after = np.zeros(n + 1)
        self.cumulative = np.empty(total)
        borders = np.searchsorted(left[order], np.arange(1, (left.max() if n else 0) + 2))
        for a, z in zip(borders, borders[1:]):
            rows = order[a:z]
            deg = degree[rows]
            e0, e1 = self.first[rows[0]], ends[z - 1]
            seg = self.first[rows] - e0
            x = self.log[e0:e1] + after[target[e0:e1]]
            top = np.maximum.reduceat(x, seg)
            e = np.exp(x - np.repeat(top, deg))
            sums = np.add.reduceat(e, seg)
            after[rows] = top + np.log(sums)
            self.log[e0:e1] = x - np.repeat(after[rows], deg)  # from here on: log probability of the edge
            e /= np.repeat(sums, deg)
            run = np.cumsum(e)
            self.cumulative[e0:e1] = run - np.repeat(run[seg] - e[seg], deg)

    def edges(self, p: int) -> range:
        """Numbers of the edges that leave a character."""
        return range(int(self.first[p]), int(self.last[p]) + 1)

    def _choose(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each character, by cumulative probabilities."""
        e, last = self.first[p], self.last[p]
        go = np.flatnonzero((self.cumulative[e] <= u) & (e < last))
        while len(go):
            e[go] += 1
            go = go[(self.cumulative[e[go]] <= u[go]) & (e[go] < last[go])]
        return e

    def sample(self, at: np.ndarray, end: np.ndarray, key: np.ndarray, *parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path from each character ``at`` to ``end``: log probabilities, number of edges, edges end to end."""
        n = len(at)
        key = _stirred(key, *parts)
        at = at.copy()
        log, count = np.zeros(n), np.zeros(n, np.int64)
        active, steps, long = np.flatnonzero(at < end), [], {}
        while len(active):
            if len(steps) == LONG_PATH:  # the rest of each long path: edges of all its characters at once
                for k in active.tolist():
                    long[k] = self._walk(int(at[k]), int(end[k]), key[k:k + 1])
                    log[k] += self.log[long[k]].sum()
                    count[k] += len(long[k])
                break
            p = at[active]
            e = self._choose(p, _uniform(key[active], len(steps)))
            log[active] += self.log[e]
            steps.append((active, e))
            count[active] += 1
            at[active] = p + self.step[e]
            active = active[at[active] < end[active]]
        first = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for s, (who, e) in enumerate(steps):
            edges[first[who] + s] = e
        for k, e in long.items():
            edges[first[k] + len(steps):first[k] + count[k]] = e
        return log, count, edges

    def _walk(self, at: int, end: int, key: np.ndarray) -> np.ndarray:
        """A path chosen character by character: each has its edge, whether it is reached or not."""
        e = self._choose(np.arange(at, end), _uniform(np.repeat(key, end - at), LONG_PATH, np.arange(end - at)[::-1]))
        chosen, jump = e.tolist(), (np.arange(end - at) + self.step[e]).tolist()
        out, p = [], 0
        while p < end - at:
            out.append(chosen[p])
            p = jump[p]
        return np.array(out, np.int64)

    def path_log(self, path: tuple[int, ...]) -> float:
        return float(self.log[list(path)].sum())

    def sample_other(self, chunk: np.ndarray, count: np.ndarray, edges: np.ndarray, key: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk a path that differs from the given one (``count`` edges each, end to end).

        Of all other paths those that leave the given one at its i-th edge have the mass of
        the edges before, times what the i-th edge leaves over; so the place is drawn first,
        then another edge there, and from its end on the path is free.
        """
        n = len(chunk)
        path = np.repeat(np.arange(n), count)
        first = np.cumsum(count) - count
        log = self.log[edges]
        before = np.cumsum(log) - log
        before -= np.repeat(before[first], count)
        leave = np.exp(before) * -np.expm1(np.minimum(log, 0.0))
        leave /= np.repeat(np.maximum(np.add.reduceat(leave, first), 1e-300), count)
        run = np.cumsum(leave)
        low = np.r_[0.0, run][first]
        total = run[first + count - 1] - low
        pick = np.searchsorted(run, low + _uniform(key, tag, 0) * total, side="right")
        pick = np.clip(pick, first, first + count - 1)
        # Where rounding picked an edge without another beside it: the last one that has one.
        begins = self._from(chunk, count, edges)
        single = np.flatnonzero(self.first[begins[pick]] == self.last[begins[pick]])
        for k in single.tolist():
            own = np.flatnonzero(leave[first[k]:first[k] + count[k]] > 0)
            pick[k] = first[k] + (own[-1] if len(own) else 0)
        place = begins[pick]
        degree = self.last[place] - self.first[place] + 1
        owner = np.repeat(np.arange(n), degree)
        begin = np.cumsum(degree) - degree
        beside = np.repeat(self.first[place] - begin, degree) + np.arange(int(degree.sum()))
        mass = np.where(beside == np.repeat(edges[pick], degree), 0.0, np.exp(self.log[beside]))
        run = np.cumsum(mass)
        low = np.r_[0.0, run][begin]
        at = np.searchsorted(run, low + _uniform(key, tag, 1) * (run[begin + degree - 1] - low), side="right")
        at = np.clip(at, begin, begin + degree - 1)
        for k in np.flatnonzero(mass[at] <= 0).tolist():
            own = np.flatnonzero(mass[begin[k]:begin[k] + degree[k]] > 0)
            at[k] = begin[k] + (own[-1] if len(own) else 0)
        other = beside[at]
        end = self.starts[chunk] + self.lengths[chunk]
        rest_log, rest_count, rest = self.sample(place + self.step[other], end, key, tag, 2)
        kept = pick - first
        out_count = kept + 1 + rest_count
        out = np.empty(int(out_count.sum()), np.int64)
        to = np.cumsum(out_count) - out_count
        _copy(out, to, edges, first, kept)
        out[to + kept] = other
        _copy(out, to + kept + 1, rest, np.cumsum(rest_count) - rest_count, rest_count)
        return before[pick] + self.log[other] + rest_log, out_count, out

    def _from(self, chunk: np.ndarray, count: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The character that each edge of the chunks' paths leaves."""
        step = self.step[edges].astype(np.int64)
        run = np.cumsum(step) - step
        first = np.cumsum(count) - count
        return np.repeat(self.starts[chunk] - run[first], count) + run

    def sample_none_of(self, chunk: int, not_these: list[tuple[int, ...]], key: np.uint64, tag: int) -> tuple[float, tuple[int, ...]]:
        """A path of one chunk that is none of several: at each edge, the mass of the excluded
        paths that go through it is taken off."""
        p, end = int(self.starts[chunk]), int(self.starts[chunk] + self.lengths[chunk])
        suffix = [np.cumsum(self.log[list(q)][::-1])[::-1] for q in not_these]
        excluded = list(range(len(not_these)))
        log, out, step = 0.0, [], 0
        while p < end:
            a = int(self.first[p])
            mass = np.exp(self.log[a:int(self.last[p]) + 1])
            for x in excluded:
                mass[not_these[x][step] - a] -= np.exp(suffix[x][step])
            mass = np.maximum(mass, 0.0)
            u = float(_uniform(np.array([key]), tag, step)[0]) * mass.sum()
            most = np.flatnonzero(mass > 0)
            k = int(min(np.searchsorted(np.cumsum(mass), u, side="right"), most[-1] if len(most) else 0))
            excluded = [x for x in excluded if len(not_these[x]) > step + 1 and not_these[x][step] == a + k]
            log += float(self.log[a + k])
            out.append(a + k)
            p += int(self.step[a + k])
            step += 1
            if not excluded:
                more, _, rest = self.sample(np.array([p]), np.array([end]), np.array([key], np.uint64), tag, step)
                return log + float(more[0]), (*out, *rest.tolist())
        return log, tuple(out)


def spell(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the marked characters as byte pieces, and the number of ids made of each."""
    size = np.ones(len(ids), np.int64)
    marked = np.flatnonzero(ids < 0)
    if not len(marked):
        return ids.astype(np.uint16 if len(v.sizes) <= 1 << 16 else np.uint32), size
    code = -1 - ids[marked].astype(np.int64)
    n = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    size[marked] = n
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint16 if len(v.sizes) <= 1 << 16 else np.uint32)
    plain = ids >= 0
    out[at[plain]] = ids[plain]
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        own = n > k
        shift = 6 * (n[own] - 1 - k)
        bits = code[own] >> shift
        byte = np.where(n[own] == 1, bits, (lead[n[own]] | bits) if k == 0 else (0x80 | (bits & 0x3F)))
        out[at[marked[own]] + k] = v.byte[byte]
    return out, size


def sample_texts(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int = SAMPLES) -> Iterator[tuple]:
    """For sample number 1, 2, ...: text numbers, log probabilities, Gumbels, and (ids, ids of each text);
    at the end, number 0: the Gumbel of the best unopened part of each text (-inf: none)."""
    own = [CHUNKS.findall(" " + t) if t else [] for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    coded = pa.array(list(chain.from_iterable(own)), pa.string()).dictionary_encode()
    lattice = Lattices(coded.dictionary.to_pylist(), v)
    chunk = coded.indices.to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(chunk)) - first[text]
    key = keys.astype(np.uint64)[text]
    some = np.flatnonzero(sizes > 0)

    def summed(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts))
        if len(some):
            out[some] = np.add.reduceat(x, first[some])
        return out

    def parts(log: np.ndarray, bound: np.ndarray, number: int) -> np.ndarray:
        """Truncated Gumbels of the parts that first differ from a path at each word."""
        before = np.cumsum(log) - log
        before -= before[first[some]].repeat(sizes[some]) if len(some) else 0
        with np.errstate(divide="ignore"):
            mass = before + np.log(-np.expm1(np.minimum(log, 0.0)))
        mass[log > -ROUNDING] = -np.inf  # the only path, up to rounding
        return _cut_gumbel(mass, bound[text], _uniform(key, SEED + 1, number, inside))

    gumbel = -np.log(-np.log(_uniform(keys.astype(np.uint64), SEED + 2)))
    begin, end = lattice.starts[chunk], lattice.starts[chunk] + lattice.lengths[chunk]
    log, count, edges = lattice.sample(begin, end, key, SEED, 1, inside)
    paths = [(log, count, edges)]  # of all words, by opened path
    nodes = [parts(log, gumbel, 1)]
    ruled_out: dict[tuple[int, int], list[tuple[int, ...]]] = {}  # (path, word) -> paths of that word excluded there
    yield 1, np.arange(len(texts)), summed(log), gumbel, (lattice.ids[edges], summed(count).astype(np.int64))

    for number in range(2, k + 2):
        best, node, word = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for j, g in enumerate(nodes):
            if not len(some):
                continue
            top = np.maximum.reduceat(g, first[some])
            better = top > best[some]
            where = some[better]
            best[where], node[where] = top[better], j
            hit = np.flatnonzero(g == np.repeat(top, sizes[some]))
            owner, at = np.unique(text[hit], return_index=True)
            place = np.zeros(len(texts), np.int64)
            place[owner] = hit[at]
            word[where] = place[where]
        if number > k:
            yield 0, np.arange(len(texts)), best, best, None
            return
        open_ = np.flatnonzero(~np.isneginf(best))
        log, count = np.zeros(len(chunk)), np.zeros(len(chunk), np.int64)
        # Words behind the split are free; the split word avoids what it may not be; those before it are kept.
        is_open = np.zeros(len(texts), bool)
        is_open[open_] = True
        split = word[text]
        index = np.arange(len(chunk))
        free = np.flatnonzero(is_open[text] & (index > split))
        free_log, free_count, free_edges = lattice.sample(begin[free], end[free], key[free], SEED, number, inside[free])
        log[free], count[free] = free_log, free_count
        begins = [np.cumsum(c) - c for _, c, _ in paths]
        words, froms = word[open_], node[open_]
        # Most split words may not be one path only; they are drawn together.
        many = [n for n, (w, j) in enumerate(zip(words.tolist(), froms.tolist())) if (j, w) in ruled_out]
        one = np.setdiff1d(np.arange(len(open_)), many)
        old_size = np.zeros(len(open_), np.int64)
        old_begin = np.zeros(len(open_), np.int64)
        for j, (_, old_count, _) in enumerate(paths):
            own = froms == j
            old_size[own], old_begin[own] = old_count[words[own]], begins[j][words[own]]
        old = np.empty(int(old_size.sum()), np.int64)
        old_at = np.cumsum(old_size) - old_size
        for j, (_, _, old_edges) in enumerate(paths):
            own = np.flatnonzero(froms == j)
            _copy(old, old_at[own], old_edges, old_begin[own], old_size[own])
        picked = np.concatenate([old[old_at[n]:old_at[n] + old_size[n]] for n in one]) if many and len(one) else old if len(one) else old[:0]
        own_log, own_count, own_edges = lattice.sample_other(chunk[words[one]], old_size[one], picked, keys[open_[one]].astype(np.uint64), number) if len(one) else (np.zeros(0), np.zeros(0, np.int64), old[:0])
        log[words[one]], count[words[one]] = own_log, own_count
        gone = np.zeros(len(open_))
        if len(one):
            gone[one] = np.exp(np.add.reduceat(lattice.log[picked], np.cumsum(old_size[one]) - old_size[one])) + np.exp(own_log)
        others: dict[int, tuple[int, ...]] = {}
        for n in many:
            w, j, t = int(words[n]), int(froms[n]), int(open_[n])
            log[w], others[w] = lattice.sample_none_of(int(chunk[w]), ruled_out[j, w], keys[t].astype(np.uint64), number)
            count[w] = len(others[w])
            gone[n] = sum(np.exp(lattice.path_log(q)) for q in ruled_out[j, w]) + np.exp(log[w])
        for j in range(len(paths)):
            nodes[j][words[froms == j]] = -np.inf
        for j, (old_log, old_count, _) in enumerate(paths):
            keep = is_open[text] & (index < split) & (node[text] == j)
            log[keep], count[keep] = old_log[keep], old_count[keep]
        at = np.cumsum(count) - count
        edges = np.empty(int(count.sum()), np.int64)
        for j, (_, old_count, old_edges) in enumerate(paths):
            keep = np.flatnonzero(is_open[text] & (index < split) & (node[text] == j))
            _copy(edges, at[keep], old_edges, begins[j][keep], old_count[keep])
        _copy(edges, at[free], free_edges, np.cumsum(free_count) - free_count, free_count)
        _copy(edges, at[words[one]], own_edges, np.cumsum(own_count) - own_count, own_count)
        for w, path in others.items():
            edges[at[w]:at[w] + len(path)] = path
        if number < k:  # what the split words may not be when they are split again
            for n, (w, j) in enumerate(zip(words.tolist(), froms.tolist())):
                banned = ruled_out.get((j, w), [tuple(old[old_at[n]:old_at[n] + old_size[n]].tolist())])
                ruled_out[number - 1, w] = [*banned, tuple(edges[at[w]:at[w] + count[w]].tolist())]
        paths.append((log, count, edges))
        fresh = parts(log, best, number)
        fresh[~is_open[text] | (index < split)] = -np.inf
        # At the split word, everything ruled out and the new path are gone.
        ahead = np.cumsum(log) - log
        ahead = ahead[words] - ahead[first[open_]]
        with np.errstate(invalid="ignore", divide="ignore"):
            rest = np.where(gone < 1 - ROUNDING, ahead + np.log1p(-np.minimum(gone, 1.0)), -np.inf)
        fresh[words] = _cut_gumbel(rest, best[open_], _uniform(keys[open_].astype(np.uint64), SEED + 3, number))
        nodes.append(fresh)
        yield number, open_, summed(log)[open_], best[open_], (lattice.ids[edges], summed(count).astype(np.int64)[open_])


def _cut_gumbel(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels with location ``mass``, at most ``bound``."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        out = mass - np.log(np.exp(mass - bound) - np.log(u))
    out[np.isneginf(mass)] = -np.inf
    return np.minimum(out, bound)


def _copy(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    total = int(size.sum())
    if total:
        step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = source[np.repeat(begin, size) + step]


def sample_segmentations(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", k: int = SAMPLES, power: float = POWER, decoded: bool = False) -> DataFrame:
    """``SAMPLED``: up to ``k`` distinct segmentations of every text with log probability and inclusion score.

    With ``decoded`` the ids are decoded in the same pass, into a further column.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
                       F.xxhash64(F.lit(SEED), F.col(key)).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = SAMPLED + (", decoded string" if decoded else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, power)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                doc, text_key = batch.column("doc_id"), batch.column("text_key")
                keys = batch.column("row_key").to_numpy().view(np.uint64)
                found = []
                for number, who, log, gumbel, segments in sample_texts(batch.column("text").to_pylist(), keys, v, k):
                    if number:
                        out, size = spell(segments[0], v)
                        ends = np.cumsum(np.r_[0, size])
                        cuts = ends[np.r_[0, np.cumsum(segments[1])]]  # ids of each text
                        found.append((number, who, log, np.diff(cuts), out, cuts))
                    else:
                        threshold = gumbel
                for number, who, log, n, out, cuts in found:
                    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                        # log(1 - exp(-exp(log p - threshold))); 0 when nothing is left out
                        inclusion = np.where(np.isneginf(threshold[who]), 0.0, np.log(-np.expm1(-np.exp(log - threshold[who]))))
                    data = pa.py_buffer(out.astype("<u2" if out.dtype == np.uint16 else "<u4"))
                    column = pa.BinaryArray.from_buffers(pa.binary(), len(who), [None, pa.py_buffer((cuts * out.itemsize).astype(np.int32)), data])
                    index = pa.array(who)
                    told = [decode_ids(out, n, v)] if decoded else []
                    yield pa.RecordBatch.from_arrays([doc.take(index), text_key.take(index), pa.array(np.full(len(who), number, np.int32)), pa.array(n, pa.int64()), pa.array(log), pa.array(inclusion), column, *told], names)

    return rows.mapInArrow(run, schema)


def decode_ids(data: np.ndarray, counts: np.ndarray, v: Vocabulary) -> pa.Array:
    """Texts of ids that lie end to end: bytes of all pieces copied at once, first space off."""
    size = v.sizes[data]
    out = np.empty(int(size.sum()), np.uint8)
    _copy(out, np.cumsum(size) - size, v.bytes, v.begins[data], size)
    ends = np.r_[0, np.cumsum(np.r_[0, size])[np.cumsum(counts)]]
    filled = np.diff(ends) > 0
    keep = np.ones(len(out), bool)
    keep[ends[:-1][filled]] = False
    ends = ends - np.r_[0, np.cumsum(filled)]
    texts = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[keep]))
    return texts.cast(pa.string())


def decode(sampled: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``sampled`` with the column ``decoded``."""
    names = [*sampled.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        width = np.dtype("<u2" if len(v.sizes) <= 1 << 16 else "<u4")
        for whole in batches:
            for batch in byte_slices(whole, ids, SLICE_BYTES):
                column = batch.column(ids)
                counts = np.array([len(x.as_buffer()) for x in column]) // width.itemsize
                data = np.frombuffer(b"".join(x.as_py() for x in column), width)
                yield pa.RecordBatch.from_arrays([*batch.columns, decode_ids(data, counts, v)], names)

    return sampled.mapInArrow(run, T.StructType([*sampled.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, sample, n_pieces, log_prob, inclusion, ids_crc32 and whether decoding gave the text back."""
    return decoded.select("doc_id", "sample", "n_pieces", "log_prob", "inclusion", F.crc32("ids").alias("ids_crc32"), (F.xxhash64("decoded") == F.col("text_key")).alias("round_trip"))

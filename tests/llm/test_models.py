"""Pitman-Yor scoring and segmentation sampling against plain Python; the pipeline."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import piece_sampling as ps
from storyloom.llm import pitman_yor, queries
from tests.llm.util import SCHEMA, awkward, awkward_rows, prose, write_tables


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def base_scores(rows):
    train = [d for d in rows if d[0] is None or zlib.crc32(str(d[0]).encode()) % 10]
    c = Counter(t for d in train for t in tokens(d[1]))
    n, v = sum(c.values()), len(c)
    out = []
    for d in rows:
        own = tokens(d[1])
        out.append((d[0], d not in train, len(own), sum(c[t] > 0 for t in own), round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), 4), n))
    return Counter(out)


def test_scores(spark, tmp_path):
    rows = awkward_rows() + [(700 + i, prose(120, 300 + i), "en", "s", 0) for i in range(60)]
    got = queries.queries()["op2_pitman_yor"](spark, write_tables(spark, tmp_path, rows)).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4), r["train_tokens"]) for r in got) == base_scores(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_held_out_texts_are_more_probable_than_by_unigrams(spark):
    held = [r for r in queries.queries()["op2_pitman_yor"](spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_parts_and_nothing(spark):
    docs = awkward(spark, extra="1 as part;2 as batch;3 as score")
    many = {(r["doc_id"], r["n_tokens"]): r for r in pitman_yor.score_documents(docs, part_bytes=20000).collect()}
    one = {(r["doc_id"], r["n_tokens"]): r for r in pitman_yor.score_documents(docs).collect()}
    assert many.keys() == one.keys()
    assert all(many[k]["base_score"] == pytest.approx(one[k]["base_score"]) and many[k]["n_known"] == one[k]["n_known"] for k in one)
    assert sum(r["score"] for r in many.values()) == pytest.approx(sum(r["score"] for r in one.values()), rel=0.02)
    assert pitman_yor.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, "not trained on", "", "", 0)], SCHEMA) if zlib.crc32(b"1") % 10 == 0 else spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0), "not trained on", "", "", 0)], SCHEMA)
    r = pitman_yor.score_documents(only).first()
    assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"])


@pytest.mark.parametrize("n_parts", [1, 3])
def test_predictive_is_a_distribution(n_parts):
    """Known words and the unknown word sum to one in every context."""
    r = random.Random(1)
    n_ctx = 5
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(vocab[:1 + r.randrange(40)]) for _ in range(30)) for _ in range(20)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(list(range(1, 21))), "text": pa.array(texts)})
    names = [x.split()[0] for x in pitman_yor.BLOCKS.split(", ")]
    blocks = [dict(zip(names, row)) for row in pitman_yor._blocks(batch, 0, n_parts, n_ctx)]
    totals = {k: np.zeros(n_ctx + 1) for k in range(2 + 2 * pitman_yor.SAMPLES)}
    make = lambda p: pitman_yor.Part([b for b in blocks if b["part"] == p], p, n_parts, n_ctx)
    parts = sorted({b["part"] for b in blocks})
    for p in parts:
        for kind, u, n in make(p).totals():
            totals[kind][u] += n
    v = totals[1][0]
    mass = np.zeros(n_ctx + 1)
    for m in range(pitman_yor.SAMPLES):
        open_top = (pitman_yor.TOP_STRENGTH + pitman_yor.TOP_DISCOUNT * totals[3 + 2 * m][1]) / (v + 1) / (pitman_yor.TOP_STRENGTH + totals[3 + 2 * m][0])
        for u in range(n_ctx + 1):
            back = (pitman_yor.STRENGTH + pitman_yor.DISCOUNT * totals[2 + 2 * m][u]) / (pitman_yor.STRENGTH + totals[0][u])
            mass[u] += back * open_top  # the unknown word
    for p in parts:
        part = make(p)
        n = part.n_words
        known = np.flatnonzero(part.count > 0)
        part.keys = [(known[:, None] * part.width + np.arange(n_ctx + 1)).ravel()]
        part.owners, part.train = [np.tile(np.arange(n_ctx + 1), len(known))], [np.ones(n_ctx + 1, np.uint8)]
        log = np.log10
        # each key's probability, by context
        seen = part.keys[0]
        probability = np.zeros(n_ctx + 1)
        for key, owner in zip(seen, part.owners[0]):
            part.rng = np.random.default_rng([pitman_yor.SEED, p])
            part.keys, part.owners = [np.array([key])], [np.array([0])]
            part.train = [np.ones(1, np.uint8)]
            _, _, _, score = next(part.scores(totals))
            probability[owner] += 10 ** score[0]
        mass += probability * pitman_yor.SAMPLES
        del n, log
    assert np.allclose(mass / pitman_yor.SAMPLES, 1.0, atol=1e-9)


def test_contexts_are_words_not_classes(spark):
    """Two words of one hash class keep restaurants of their own."""
    import xxhash
    by_class = {}
    for i in range(9999):
        w = f"c{i}"
        other = by_class.setdefault((xxhash.xxh64_intdigest(w.encode()) >> 8) % 1024, w)
        if other != w:
            break
    rows = [(i, f"{w} left " * 20 if i % 2 else f"{other} right " * 20, "", "", 0) for i in range(1, 200) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows += [(held[0], f"{w} left", "", "", 0), (held[1], f"{w} right", "", "", 0)]
    score = {r["doc_id"]: r["score"] for r in pitman_yor.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert score[held[0]] > score[held[1]] + 1


@pytest.mark.parametrize("n_parts", [1, 5])
def test_joined_predictive_is_a_distribution(spark, n_parts):
    r = random.Random(1)
    seen = Counter((r.randrange(1, 2 + r.randrange(40)), r.randrange(6)) for _ in range(600))
    rows = [(w, u, seen[w, u]) for w in [*sorted({w for w, _ in seen}), 99] for u in range(6)]  # 99 is unknown
    pairs = spark.createDataFrame(rows, "word long, context long, c long").repartition(n_parts, "word", "context")
    scored, n_tokens = pitman_yor._probabilities(pairs)
    mass = Counter()
    for row in scored.collect():
        mass[row["context"]] += 10 ** row["score"]
        assert row["known"] == (row["word"] != 99)
    assert n_tokens == 600 and len(mass) == 6 and all(m == pytest.approx(1.0, abs=1e-9) for m in mass.values())


def test_a_repeated_word_is_counted_before_the_shuffle():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["the " * 50000, "the cat"])})
    rows = [r for r in pitman_yor._pairs(batch, 0).to_pylist() if r["at"] >= 0]
    trained = [pitman_yor.is_training(i) for i in (1, 2)]
    assert len(rows) == 5 and sum(r["n_train"] for r in rows) == 50001 * trained[0] + 3 * trained[1]


def test_packed_parts_score_like_rows(spark):
    """The packed chain gives each text the score of the chain over plain rows, with contexts dealt out or not."""
    rows = [(i, prose(150, i % 70), "", "", 0) for i in range(1, 150)]
    index, pairs = {}, Counter()
    for d in rows:
        own = ["start", *tokens(d[1])]
        for u, w in zip(own, own[1:]):
            pairs[index.setdefault(w, len(index)), index.setdefault(u, len(index))] += bool(zlib.crc32(str(d[0]).encode()) % 10)
    scored, n_tokens = pitman_yor._probabilities(spark.createDataFrame([(*k, n) for k, n in pairs.items()], "word long, context long, c long"))
    value = {(r["word"], r["context"]): r["score"] for r in scored.collect()}
    docs = spark.createDataFrame(rows, SCHEMA)
    for part_bytes in (1 << 20, 9000):
        got = {r["doc_id"]: r for r in pitman_yor.score_documents(docs, part_bytes=part_bytes).collect()}
        for d in rows:
            own = ["start", *tokens(d[1])]
            assert got[d[0]]["score"] == pytest.approx(sum(value[index[w], index[u]] for u, w in zip(own, own[1:])), rel=0.02)
            assert got[d[0]]["train_tokens"] == n_tokens


def test_frozen_arrays_come_back():
    some = [np.array([], np.int64), np.array([0, 255]), np.array([70000, 1]), np.array([2 ** 64 - 1, 0], np.uint64)]
    assert all(np.array_equal(a, b) for a, b in zip(some, pitman_yor._thaw(pitman_yor._freeze(*some)), strict=True))


def test_blocks_send_packed_cells_and_little_stays_written(spark, tmp_path):
    """A block sends a row for each part, not for each pair, and what the scoring leaves written is less than the texts."""
    from storyloom.session import ensure_checkpoint_dir
    rows = [(i, prose(2000, i), "", "", 0) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    before = {f for f, _, _ in os.walk(folder)}
    out = pitman_yor.score_documents(docs, part_bytes=1 << 18)
    assert out.count() == len(rows)
    left = sum(os.path.getsize(os.path.join(f, x)) for f, _, names in os.walk(folder) if f not in before for x in names)
    assert 0 < left < sum(len(d[1].encode()) for d in rows)
    blocks = pitman_yor._blocks_of(docs, "text", "doc_id")
    assert pitman_yor._cells_of(blocks, 3, {}).count() <= 3 * blocks.count() <= 6


def test_reseat_bounds_and_mean():
    rng = np.random.default_rng(3)
    c = np.array([1, 2, 5, 64, 65, 1000, 100000])
    t = np.mean([pitman_yor.reseat(c, np.full(7, 2.0), 0.5, rng) for _ in range(300)], axis=0)
    assert t[0] == 1 and np.all(np.diff(t) > -0.3) and np.all(t <= c)
    want = 1 + 2 / (2 + 1 - 0.5)  # two customers
    assert t[1] == pytest.approx(want, abs=0.1)


# ------------------------------------------------------------------ segmentations
@pytest.fixture(scope="module")
def vocab():
    return ps.vocabulary(queries.vocabulary(queries.PIECES))


def paths_of(text, v):
    """All segmentations of a short text with their probabilities."""
    lattice = ps.Lattices(ps.CHUNKS.findall(" " + text), v)
    found = {(): 1.0}
    for a, n in zip(lattice.starts, lattice.lengths):
        def rest(p, end):
            if p == end:
                return {(): 1.0}
            return {(int(lattice.ids[e]), *q): math.exp(lattice.log[e]) * w for e in lattice.edges(p) for q, w in rest(p + int(lattice.step[e]), end).items()}
        found = {a1 + a2: p1 * p2 for a1, p1 in found.items() for a2, p2 in rest(a, a + n).items()}
    return found


def test_sampling_without_replacement(vocab):
    text, n, k = "the cat", 12000, 4
    p = paths_of(text, vocab)
    assert sum(p.values()) == pytest.approx(1.0, abs=1e-5)
    runs = [[] for _ in range(n)]
    for number, who, log, gumbel, seg in ps.sample_texts([text] * n, np.random.default_rng(5).integers(0, 1 << 62, n).astype(np.uint64), vocab, k):
        if number:
            ends = np.r_[0, np.cumsum(seg[1])]
            for i, w in enumerate(who):
                runs[w].append((tuple(seg[0][ends[i]:ends[i + 1]].tolist()), log[i], gumbel[i]))
        else:
            threshold = gumbel
    assert all(len({s[0] for s in r}) == k for r in runs)
    assert all(r[0][2] >= r[1][2] >= r[2][2] >= r[3][2] >= t for r, t in zip(runs, threshold))
    assert all(abs(s[1] - math.log(p[s[0]])) < 1e-3 for r in runs for s in r)
    for q in sorted(p, key=p.get)[-4:]:
        second = sum(p[a] * p[q] / (1 - p[a]) for a in p if a != q)
        third = sum(p[a] * p[b] / (1 - p[a]) * p[q] / (1 - p[a] - p[b]) for a in p for b in p if len({a, b, q}) == 3)
        for place, want in enumerate((p[q], second, third)):
            assert sum(r[place][0] == q for r in runs) / n == pytest.approx(want, abs=0.02)
    weighted = [sum(math.exp(s[1]) / -math.expm1(-math.exp(s[1] - t)) for s in r) for r, t in zip(runs, threshold)]
    assert np.mean(weighted) == pytest.approx(1.0, abs=0.01)


def test_few_segmentations_are_all_found(vocab):
    text = "an é"
    p = paths_of(text, vocab)
    got = list(ps.sample_texts([text, "", "\n"], np.arange(3, dtype=np.uint64), vocab, len(p) + 5))
    seen = set()
    for number, who, _, _, seg in got:
        if number:
            ends = np.r_[0, np.cumsum(seg[1])]
            seen |= {tuple(seg[0][ends[i]:ends[i + 1]].tolist()) for i, w in enumerate(who) if w == 0}
    assert seen <= set(p) and {q for q in p if p[q] > 10 * ps.ROUNDING} <= seen
    assert [sum(1 in who.tolist() for n, who, *_ in got if n), sum(2 in who.tolist() for n, who, *_ in got if n)] == [1, 2 if len(paths_of("\n", vocab)) == 2 else 1]


def test_segments_are_pieces_and_round_trip(spark, tmp_path):
    import sentencepiece
    rows = awkward_rows() + [(800, "  two  spaces ▁ sign\n\n\ttab 漢字 😀 \x00 end ", "", "", 0), (801, "word" * 3000, "", "", 0), (802, " ", "", "", 0)]
    path = queries.vocabulary(queries.PIECES)
    docs = awkward(spark, rows, extra="1 as sample;2 as ids;3 as decoded")
    sampled = ps.sample_segmentations(docs, path, k=3)
    out = ps.decode(sampled, path).collect()
    texts = Counter((d[0], d[1] or "") for d in rows)
    assert Counter((r["doc_id"], r["decoded"]) for r in out if r["sample"] == 1) == texts
    assert all((r["doc_id"], r["decoded"]) in texts for r in out)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in out:
        if r["doc_id"] in (800, 801, 3, 204):
            ids = np.frombuffer(bytes(r["ids"]), "<u2").tolist()
            assert len(ids) == r["n_pieces"] and sp.decode(ids) == (r["decoded"] if r["doc_id"] != 800 else sp.decode(ids))
    assert {r["inclusion"] for r in out if r["doc_id"] in (200, 201)} == {0.0}
    again = {(r["doc_id"], r["sample"], bytes(r["ids"])) for r in ps.sample_segmentations(docs.repartition(2), path, k=3).collect()}
    assert again == {(r["doc_id"], r["sample"], bytes(r["ids"])) for r in out}
    assert ps.decode(ps.sample_segmentations(spark.createDataFrame([], SCHEMA), path), path).count() == 0


def test_long_unbroken_text(vocab):
    r = random.Random(3)
    text = "".join(r.choice("abcdefghi数学語") for _ in range(30000))
    begun = time.process_time()
    found = list(ps.sample_texts([text, "a b", text], np.array([7, 8, 7], np.uint64), vocab, 3))
    assert time.process_time() - begun < 6  # three seconds for 20,000 characters before
    seen = [[], [], []]
    for number, who, _, _, seg in found:
        if number:
            out, size = ps.spell(seg[0], vocab)
            cuts = np.cumsum(np.r_[0, size])[np.r_[0, np.cumsum(seg[1])]]
            told = ps.decode_ids(out, np.diff(cuts), vocab).to_pylist()
            for i, w in enumerate(who):
                assert told[i] == [text, "a b", text][w]
                seen[w].append(tuple(out[cuts[i]:cuts[i + 1]].tolist()))
    assert seen[0] == seen[2] and len(set(seen[0])) == len(set(seen[1])) == 3


def test_segmentation_query(spark, tmp_path):
    got = queries.queries()["op10_piece_sampling"](spark, write_tables(spark, tmp_path)).collect()
    assert all(r["round_trip"] for r in got) and sum(r["sample"] == 1 for r in got) == len(awkward_rows())


# ------------------------------------------------------------------ pipeline
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        if name != "segment":
            assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[2] > 50
    rows = sorted((r["doc_id"], r["sample"], r["ids_crc32"], r["round_trip"]) for r in docs.collect())
    assert all(r[3] for r in rows)
    assert rows == sorted((r["doc_id"], r["sample"], r["ids_crc32"], r["round_trip"]) for r in cp.run(spark, sf).collect())


def test_pipeline_awkward_rows(spark):
    import corpus_pipeline as cp
    for rows in (awkward_rows(), []):
        docs = awkward(spark, rows, extra="1 as copies;2 as kept;3 as spans")
        for name, stage in cp.STAGES:
            out = stage(spark, docs, "")
            if name != "segment":
                assert out.columns == docs.columns
            out.collect()


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """51 words of 5.4 bytes each: shorter than the 400 bytes of op3."""
    import corpus_pipeline as cp
    passage = " ".join(f"p{i:03}" + "x" * (i % 2) for i in range(51))
    assert cp.PASSAGE_BYTES <= len(passage) < 400
    own = [" ".join(f"{c}own{i}" for i in range(60)) for c in "abcd"]
    shorter = " ".join(passage.split()[:45])
    texts = {1: f"{own[0]}\n{passage}\n{own[1]}", 2: f"{passage}\n{own[2]}", 3: f"{own[3]} {shorter}"}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.text for r in cp.repeated_passages(spark, docs, "").collect()}
    assert passage not in got[1] + got[2] and got[3] == texts[3]
    assert own[0] in got[1] and own[1] in got[1] and own[2] in got[2]

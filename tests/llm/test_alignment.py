"""Tokenizer alignment against plain Python over whole-text encodings."""

import hashlib
from collections import Counter

from storyloom.llm import queries, token_alignment
from tests.llm.util import awkward, awkward_rows, write_tables

A, B = queries.vocabulary(queries.BYTE_BPE), queries.vocabulary(queries.PIECES)
ODD = ["a  b\n c \t x  ", " lead", "  two", "x\n y", "x\n  y", "tail \n", " ", "\n", "\n\n  \n", "nb sp ace", "　wide 　 gap", "ﬁ ① é x</s> <s> <unk> <0x41>",
       "<|endoftext|> in <|endoftext|>text", "a▁b c", "don't we'll  I'm", "数学和语言没有空格", "🙂 🙂🙂 é", "tab\tand\x1cold \x85 seps", "x" * 300, "1234567 89,00.5"]


def brute(rows):
    words = token_alignment.Vocabularies(A, B)
    bytes_of = [t.to_pylist() for t in words.tokens]
    out, links_of = [], []
    for d, text in rows:
        ids = (words.a.encode(" " + text, add_special_tokens=False).ids, words.b.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(bytes_of[s][i] for i in x) != whole for s, x in enumerate(ids)):
            out.append([d, 0, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for s in (0, 1):
            at, own = 0, []
            for i in ids[s]:
                own.append((at, at + len(bytes_of[s][i]), i))
                at += len(bytes_of[s][i])
            spans.append(own)
        ends = sorted({z for _, z, _ in spans[0]} & {z for _, z, _ in spans[1]})
        groups, first = [], 0
        for z in ends:
            groups.append("|".join(",".join(str(i) for a, e, i in own if first <= a and e <= z) for own in spans))
            first = z
        links_of.append([(i, j) for a, z, i in spans[0] for b, y, j in spans[1] if a < y and b < z])
        out.append([d, len(ids[0]), len(ids[1]), len(ends), len(links_of[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    count = Counter(x for own in links_of for x in own)
    best = {}
    for (i, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    return Counter((*x, sum(count[y] == best[y[1]] for y in own), sum(count[y] for y in own)) for x, own in zip(out, links_of))


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in df.collect())


def rows():
    short = [(d, t and t[:3000], *rest) for d, t, *rest in awkward_rows()]  # the plain recount is quadratic in a text
    return short + [(2000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]


def test_alignment_query(spark, tmp_path):
    df = queries.queries()["op11_token_alignment"](spark, write_tables(spark, tmp_path, rows()))
    want = brute([r[:2] for r in rows()])
    assert got(df) == want
    assert sum(1 for x in want if x[1]) > 50


def test_long_texts_in_pieces(spark):
    words = token_alignment.Vocabularies.of(A, B)
    text = " ".join(t for t in ODD if token_alignment.SPACE not in t)
    some = [(1, text), (2, "short"), (3, text + " a▁b"), (4, text[::-1]), (None, None), (5, "word " * 500)]
    df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    for limit in (40, 400):
        assert len(token_alignment._pieces(text, words, limit)) >= 3
        assert token_alignment._pieces(text + " a▁b", words, limit) is None
        assert got(token_alignment.alignment_report(df, A, B, slice_bytes=limit)) == brute(some)
        pieces = sorted((r.piece, list(r.a_ids)) for r in token_alignment.align(df, A, B, slice_bytes=limit).collect() if r.doc_id == 1)
        assert sum((x for _, x in pieces), []) == words.a.encode(" " + text, add_special_tokens=False).ids


def test_align_gives_groups_and_ignores_clashing_columns(spark):
    df = awkward(spark, rows(), "text AS a;doc_id AS row;doc_id AS slice;text AS piece;1 AS pair")
    out = token_alignment.align(df, A, B).collect()
    assert len(out) == len(rows())
    words = token_alignment.Vocabularies.of(A, B)
    by_id = {r[0]: r[1] for r in rows() if r[0] is not None and r[0] >= 2000}
    for r in out:
        assert len(r.a_ends) == len(r.b_ends) and (not r.a_ends or (r.a_ends[-1], r.b_ends[-1]) == (len(r.a_ids), len(r.b_ids)))
        if r.doc_id in by_id and r.a_ids:
            assert list(r.b_ids) == words.b.encode(by_id[r.doc_id])
    report = token_alignment.alignment_report(df, A, B)
    assert got(report) == brute([r[:2] for r in rows()])


def test_empty_table(spark):
    df = awkward(spark, rows()).limit(0)
    assert token_alignment.alignment_report(df, A, B).count() == 0
    assert token_alignment.align(df, A, B).count() == 0

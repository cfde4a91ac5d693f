"""Min-max hashing against all pairs in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from storyloom.llm import minmax_dedup, queries
from tests.llm.test_duplicates import roots_of
from tests.llm.util import SCHEMA, awkward, awkward_rows, prose, write_tables


def shingles(text, width=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(rows, width=2, percent=80):
    sets = [frozenset(shingles(r[1], width)) for r in rows]
    kinds = sorted(set(sets) - {frozenset()}, key=lambda s: sorted(s))
    number = {s: i for i, s in enumerate(kinds)}
    near = [(i, j) for i, a in enumerate(kinds) for j, b in enumerate(kinds[:i]) if 100 * len(a & b) >= percent * len(a | b)]
    root = roots_of(range(len(kinds)), near)
    least = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            k = root[number[s]]
            least[k] = min(r[0], least.get(k, r[0]))
    out = Counter()
    for r, s in zip(rows, sets):
        c = least.get(root[number[s]]) if s else r[0]
        out[r[0], len(s), c, r[0] == c] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_rows():
    r = random.Random(5)
    rows = awkward_rows()
    base = prose(120, 50).split(" ")
    for i in range(60):  # a group of near copies, many of them at the border
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(120)] = f"w{r.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(words), "en", "s", 0))
    for i in range(40):  # small sets: 4 of 5 shingles in common link, 3 of 4 do not
        rows.append((2000 + i, " ".join("abcdef"[:r.randrange(1, 7)]) + (f" {i % 3}" if i % 2 else ""), "en", "s", 0))
    chain = [f"c{k}" for k in range(60)]
    for i in range(30):  # each near the next only
        rows.append((3000 + i, " ".join(chain[i:i + 24]), "en", "s", 0))
    rows += [(4000 + i, "Copy OF a text", "en", "s", 0) for i in range(5)] + [(4010, "copy of\ta  TEXT", "en", "s", 0)]
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 8, "block_shingles": 500}])
def test_min_max_dedup(spark, tmp_path, options):
    rows = near_rows()
    want = brute(rows)
    if not options:
        assert got(queries.queries()["op12_minmax_dedup"](spark, write_tables(spark, tmp_path, rows))) == want
    df = awkward(spark, rows, "text AS content;doc_id AS band;text AS A;1 AS text_key")
    assert got(minmax_dedup.near_duplicates(df, **options)) == want
    assert sum(n for (d, _, c, _), n in want.items() if d and 1000 <= d < 1060 and c == 1000) > 15


def test_other_lengths_and_limits(spark):
    rows = near_rows()
    df = awkward(spark, rows)
    assert got(minmax_dedup.near_duplicates(df, shingle=5, percent=50, permutations=128, rows=4)) == brute(rows, 5, 50)
    assert got(minmax_dedup.near_duplicates(df, percent=100)) == brute(rows, 2, 100)


def test_deduplicate_keeps_columns_and_one_id_of_a_component(spark):
    rows = near_rows()
    out = minmax_dedup.deduplicate(awkward(spark, rows, "doc_id AS kept_id;1 AS kept")).collect()
    lead = {d for (d, _, c, k), _ in brute(rows).items() if k}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows if r[0] in lead or r[0] is None)
    assert out[0].kept == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert minmax_dedup.near_duplicates(df).count() == 0


def test_estimates_are_unbiased_and_vary_less():
    r = np.random.default_rng(3)
    whole = r.integers(1, 1 << 63, 300, dtype=np.uint64)
    a, b = whole[:220], whole[60:]  # 160 of 300 in common
    least, most = minmax_dedup.signatures([a, b], 2000)
    x, y = least[0] == least[1], most[0] == most[1]
    assert abs(np.concatenate([x, y]).mean() - 160 / 300) < 0.03
    assert np.cov(x, y)[0, 1] < 0.02  # the second value of a permutation is worth almost a further one

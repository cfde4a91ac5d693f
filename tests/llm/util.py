"""Fixtures shared by the tests: a small table with the awkward rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "light", "a", "tree", "house", "is", "in", "old", "cloud", "Für", "été", "war,", "peace."]
    out = []
    for k in range(n):
        out.append(r.choice(words) + (str(r.randrange(50)) if r.random() < 0.5 else ""))
        if k % 9 == 8:
            out[-1] += "\n"
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls, empty and white-space texts, a long text, copies, repeated rows and ties."""
    rows = [(i, prose(20 + 13 * i, i), "en", f"s{i % 4}" if i % 7 else None, 0) for i in range(30)]
    rows += [(100 + i, prose(150, 77), "en", "s0", 0) for i in range(12)]  # copies
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n", "en", "s1", 3), (203, "one", "en", "s2", 3), (204, "two Words", "en", "", 9)]
    rows += [(300, prose(20000, 5), "de", "s3", 0)]
    rows += [(None, "a row without id " * 5, "en", "s1", 0), (400, "the same row", "en", "s2", 0), (400, "the same row", "en", "s2", 0), (400, "same id, other text", "en", "s2", 0)]
    return rows


def awkward(spark, rows=None, extra: str = ""):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *extra.split(";")) if extra else df


def write_tables(spark, tmp_path, rows=None) -> str:
    """A folder like those of the test data, with the awkward documents."""
    awkward(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)

"""Properties: Python parity of the text rules and partitioning independence of search."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom.functions.text import PY_WHITESPACE, py_strip, py_words
from storyloom.operators import embed, search

ALPHABET = "abcXYZ éÉñ 09-_.,!\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  　"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=40, max_size=40))
def test_strip_and_split_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, list(r.w)) for r in df.select("i", py_strip(F.col("t")).alias("s"), py_words(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t.strip(), t.split()), repr(t)
    assert len(PY_WHITESPACE) == 29


def test_text_topk_independent_of_partitioning(spark):
    rnd = random.Random(4)
    vocab = ["one", "two", "three", "four", "five", "six", "seven"]
    rows = [(str(i), " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 15)))) for i in range(150)]
    tps = spark.createDataFrame([(t, " ".join(rnd.choice(vocab) for _ in range(2))) for t in range(6)], "topic_id long, topic string")
    ttv = embed.term_vectors(tps, "topic_id", "topic").withColumnRenamed("id", "topic_id")
    results = []
    for parts in (1, 3, 11):
        docs = spark.createDataFrame(rows, "id string, full_text string").repartition(parts)
        hits = search.text_topk(ttv, embed.term_vectors(docs, "id", "full_text"), 7)
        results.append(sorted(tuple(r) for r in hits.collect()))
    assert results[0] == results[1] == results[2]
    per_topic = {}
    for t, rank, _, _ in results[0]:
        per_topic.setdefault(t, []).append(rank)
    assert all(sorted(r) == list(range(1, len(r) + 1)) and len(r) <= 7 for r in per_topic.values())


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZéÉñÑüÜ 09-_.,'!/", max_size=25), min_size=40, max_size=40))
def test_title_case_matches_python(spark, texts):
    from storyloom.functions.text import title_case
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", title_case(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == t.title(), repr(t)

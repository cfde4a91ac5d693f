"""Splitting of JSON arrays against Python's parser, with splits of a few bytes."""

import json
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from storyloom.sources import json_arrays, news


def value(r, depth=0):
    kinds = ["text", "number", "null"] + (["list", "object"] if depth < 3 else [])
    kind = r.choice(kinds)
    if kind == "text":
        return "".join(r.choice(['a', 'é', '"', "\\", "{", "}", "[", "]", ",", ":", "\n", " ", "items"]) for _ in range(r.randrange(12)))
    if kind == "number":
        return r.choice([0, -5, 3.25, 10 ** 12])
    if kind == "list":
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return None if kind == "null" else {r.choice(["x", "items", 'q"}', "data"]): value(r, depth + 1) for _ in range(r.randrange(4))}


def article(r, i):
    return {"id": i, "title": value(r), "body": {"deep": value(r)}, "tags": ["t}", "u\\"]}


def files(folder):
    r = random.Random(7)
    want = {}
    for k in range(24):
        articles = [article(r, 1000 * k + i) for i in range(r.randrange(0, 14))]
        indent = r.choice([None, 1, 4])
        if k % 4 == 0:
            whole = articles
        elif k % 4 == 1:
            whole = {"meta": {"a": [{"no": 1}], "items": [{"not": "these"}]}, "items": articles, "tail": {"b": [{"no": 2}]}}
        elif k % 4 == 2:
            whole = {"news": [{"later": "key"}], "n": 3, "data": [{"also": "later"}], "articles": articles, "list": [{"no": 3}]}
        else:
            whole = None  # one after the other
        text = "\n".join(json.dumps(a, ensure_ascii=False) for a in articles) if whole is None else json.dumps(whole, indent=indent, ensure_ascii=bool(k % 2))
        if k % 5 == 0:
            text = "﻿" + text
        with open(f"{folder}/f{k:02}.json", "w", encoding="utf-8") as f:
            f.write(text + r.choice(["", "\n", "  \n"]))
        want[f"f{k:02}.json"] = articles
    return want


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, str(n if "max" in k else 1)) for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_elements_equal_the_parsed_ones(spark, small_splits, size):
    folder = tempfile.mkdtemp(prefix="run-")
    want = files(folder)
    small_splits(size)
    out = json_arrays.read_elements(spark, folder, news.WRAPPER_KEYS, states_at_once=100).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.file, r.block, r["at"])):
        got.setdefault(os.path.basename(r.file), []).append(json.loads(r.text))
    assert got == {k: v for k, v in want.items() if v}
    if size == 150:
        splits = json_arrays._splits(spark, folder).select("file", "block").distinct().count()
        assert splits > 60 and any(r.block for r in out)


def test_one_file_is_read_by_many_tasks_and_equals_sparks_reader(spark, small_splits):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = [{"id": i, "title": f"Headline number {i} of the \"day\"", "story": "text }{ " * (i % 9), "rating": str(i % 10), "tags": ["a", "b"], "extra": {"n": i}} for i in range(500)]
    with open(f"{folder}/news.json", "w") as f:
        json.dump({"source": {"items": "none"}, "articles": rows}, f)
    small_splits(2000)
    assert json_arrays._splits(spark, folder).rdd.getNumPartitions() > 8
    got = news.read_news_json(spark, folder)
    assert got.where("title IS NOT NULL").count() == 500
    plain = spark.read.schema("articles array<struct<id:string,title:string,story:string,rating:string,tags:array<string>>>").option("multiLine", True).json(folder).select(F.inline("articles"))
    same = got.select("id", "title", "story", "rating", "tags")
    assert same.exceptAll(plain).isEmpty() and plain.exceptAll(same).isEmpty()
    extra = got.select(F.variant_get("raw", "$.extra.n", "long").alias("n")).agg(F.sum("n")).first()[0]
    assert extra == sum(range(500))


def test_broken_empty_and_single(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    texts = {"a": "", "b": "[]", "c": '{"items": []}', "d": '[{"id": 1}, {"id": [2', "e": '{"title": "alone", "x": [{"y": 1}]}', "f": '[1, "two", [{"in": 1}], null, {"id": 3}]', "g": "[{bad}, {\"id\": 4}]"}
    for name, text in texts.items():
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    out = json_arrays.read_elements(spark, folder, news.WRAPPER_KEYS).collect()
    got = sorted((os.path.basename(r.file)[0], r.text) for r in out)
    assert got == [("d", '{"id": 1}'), ("e", texts["e"]), ("f", '{"id": 3}'), ("g", '{"id": 4}'), ("g", "{bad}")]
    raw = news.read_news_json(spark, folder)
    assert raw.count() == 5 and raw.where("raw IS NULL").count() == 1

"""Versioned stores: two writers, killed writes, prefixes, tags, merging, fingerprints."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from storyloom.sources.store import Store, corpus_version


def rows(spark, ids, note="x"):
    return spark.createDataFrame([(i, f"{note}{i}") for i in ids], "n long, note string").select(F.md5(F.col("n").cast("string")).alias("key"), "n", "note")


def stored(store, **named):
    return sorted((r.n, r.note) for r in store.read(**named).collect())


@pytest.fixture
def store(spark):
    return Store(spark, tempfile.mkdtemp(prefix="run-") + "/store")


def test_versions_and_reading(spark, store):
    assert store.manifest() is None and store.read() is None and store.missing(rows(spark, [1])).count() == 1
    first = store.append(rows(spark, range(5)))
    second = store.append(store.missing(rows(spark, range(3, 8), "y")))
    assert (first.version, first.rows, second.version, second.rows) == (1, 5, 2, 8)
    assert stored(store) == [(i, f"x{i}") for i in range(5)] + [(i, f"y{i}") for i in range(5, 8)]
    assert stored(store, manifest=store.manifest(1)) == [(i, f"x{i}") for i in range(5)]
    assert store.append(store.missing(rows(spark, range(8)))).version == 2  # nothing new, no version
    assert store.append(rows(spark, [1], "z"), replace=True).version == 3 and stored(store) == [(1, "z1")]


def test_second_writer_leaves_out_what_came_in_between(spark, store):
    store.append(rows(spark, [0]))
    one, two = rows(spark, range(1, 6), "one"), rows(spark, range(4, 9), "two")
    a, b = store.stage(one), store.stage(two)  # both chosen against version 1
    assert store.commit(a, one.schema, 1).version == 2
    told = store.commit(b, two.schema, 1)
    assert told.version == 3 and told.rows == 9
    assert stored(store) == [(0, "x0")] + [(i, f"one{i}") for i in range(1, 6)] + [(i, f"two{i}") for i in range(6, 9)]


def test_a_version_is_published_once(spark, store):
    manifest = store.append(rows(spark, [1]))
    assert not store._publish(manifest) and store.versions() == [1]
    assert not [f for f in os.listdir(f"{store.folder}/commits") if f.startswith("_")]


def test_killed_write_leaves_a_readable_store(spark, store):
    store.append(rows(spark, range(4)))
    lost = store.stage(rows(spark, range(4, 9)))  # and no commit
    open(f"{store.folder}/commits/_half", "w").close()  # a manifest that was not renamed
    assert stored(store) == [(i, f"x{i}") for i in range(4)] and store.manifest().version == 1
    assert store.vacuum() == 1 and not os.path.exists(f"{store.folder}/data/{lost}")
    assert store.append(rows(spark, [7])).rows == 5


def test_few_keys_read_few_files(spark, store):
    store.append(rows(spark, range(3000)))
    some = rows(spark, range(20))
    read = store.read(store.prefixes(some))
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in store.read().select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 20 < len(every) and "PartitionFilters: [prefix" in read._jdf.queryExecution().toString()
    assert read.join(some, "key", "left_semi").count() == 20 and store.missing(rows(spark, range(2990, 3010))).count() == 10


def test_tags_merge_and_fingerprint(spark, store):
    for k in range(4):
        store.append(rows(spark, [k]), tag=f"batch-{k}")
        store.append(rows(spark, [k + 100]), tag=f"batch-{k}")  # a replay writes nothing
    assert store.manifest().rows == 4 and len(store.manifest().folders) == 4
    before = store.manifest()
    merged = store.merge()
    assert len(merged.folders) == 1 and merged.fingerprint == before.fingerprint and stored(store) == [(i, f"x{i}") for i in range(4)]
    other = Store(spark, tempfile.mkdtemp(prefix="run-") + "/store")
    other.append(rows(spark, [3, 1, 2, 0]))
    assert other.manifest().fingerprint == merged.fingerprint
    other.append(rows(spark, [9]), merge_after=1)
    assert other.manifest().fingerprint != merged.fingerprint


def test_empty_store_and_null_keys(spark, store):
    assert store.append(rows(spark, [])).version == 1 and store.read().count() == 0
    with pytest.raises(Exception, match="needs a key"):
        store.append(rows(spark, [1]).withColumn("key", F.lit(None).cast("string")))
    assert store.read().count() == 0


def test_corpus_version(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "n long, t string, u string")
    same = corpus_version(df, "n", "t", "u")
    assert same == corpus_version(df.orderBy(F.desc("n")).repartition(3), "n", "t", "u") != corpus_version(df.where("n = 1"), "n", "t", "u")
    assert corpus_version(df.limit(0), "n") == "0-0"

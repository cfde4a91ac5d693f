"""Source mix, sharding, chat format, quality rules and token store against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from storyloom.llm import chat_format, oracle, quality_bands, queries, shard_shuffle, source_mix, token_store
from tests.llm.util import SCHEMA, awkward, awkward_rows, prose, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ source mix
def water_fill(sizes, weights, cap):
    """Targets by repeated resharing."""
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in sizes if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return share | {s: cap * sizes[s] for s in full}
        full |= set(over)


def test_mix_targets_and_cuts(spark, tmp_path):
    rows = queries.queries()["op4_source_mix"](spark, write_tables(spark, tmp_path)).collect()
    docs = awkward_rows()
    assert len(rows) == len(docs)
    sizes, by = defaultdict(int), defaultdict(list)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None]
    want = water_fill(dict(sizes), {s: 1 + i % 3 for i, s in enumerate(order)}, 3)
    found = {(r["doc_id"], r["size"]): r for r in rows}
    for d in docs:
        r = found[d[0], len(WORD.findall(d[1] or ""))]
        assert r["source_size"] == sizes[d[3]] and r["target"] == pytest.approx(want[d[3]], rel=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by[d[3]].append(r)
    for s, own in by.items():
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(r["size"] for r in own)
    again = queries.queries()["op4_source_mix"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mix_rows_agree_with_report(spark):
    docs = awkward(spark, extra="n_chars as mix_copies;1 as copies;'x' as epochs")
    taken = Counter((r["doc_id"], r["size"]) for r in source_mix.mix_report(docs).collect() for _ in range(r["taken"] // max(r["size"], 1)) if r["size"])
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter((r["doc_id"], n) for r in mixed.collect() if (n := len(WORD.findall(r["text"] or "")))) == taken


def test_mix_cuts_between_repeated_rows(spark):
    rows = [(7, "five words are in it", "en", "a", 0)] * 200 + [(i, "one two three", "en", "b", 0) for i in range(10, 110)] + [(300, "x " * 40, "en", "c", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    report = source_mix.mix_report(docs).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in report:
        by[{7: "a", 300: "c"}.get(r["doc_id"], "b")][0] += r["taken"]
        by[{7: "a", 300: "c"}.get(r["doc_id"], "b")][1] = r["target"]
    assert by["a"][1] not in (0, 1000.0) and all(abs(taken - target) <= size for (taken, target), size in ((by["a"], 5), (by["b"], 3), (by["c"], 40)))
    mixed = Counter(r["doc_id"] for r in source_mix.mix(docs).collect())
    assert mixed[7] * 5 == by["a"][0] and sum(n for d, n in mixed.items() if 10 <= d < 110) * 3 == by["b"][0]


def test_mix_empty_and_wordless(spark):
    assert source_mix.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], SCHEMA)
    assert {(r["doc_id"], r["target"], r["taken"]) for r in source_mix.mix_report(only).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


# ------------------------------------------------------------------ sharding
def test_shards(spark, tmp_path):
    rows = queries.queries()["op5_shard_shuffle"](spark, write_tables(spark, tmp_path)).collect()
    docs = awkward_rows()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d[0], 1 + len((d[1] or "").encode()), zlib.crc32((d[1] or "").encode())) for d in docs)
    by = defaultdict(list)
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert set(by) <= set(range(16)) and max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shard_buckets_columns_and_files(spark, tmp_path):
    docs = awkward(spark, extra="1 as shard;2 as slot;3 as shard_place;4 as bucket")
    out = shard_shuffle.shard(docs, n_shards=3, bucket_bytes=20000)  # several buckets
    assert out.columns[:len(docs.columns)] == docs.columns and out.columns[-2:] == ["_shard", "_slot"]
    a, b = ({(r["doc_id"], r["text"]): (r["_shard"], r["_slot"]) for r in shard_shuffle.shard(docs, n_shards=3, bucket_bytes=20000).collect()} for _ in range(2))
    differ = [k for k in a if a[k] != b[k] and k != (400, "the same row")]
    assert not differ
    shard_shuffle.write_shards(out, f"{tmp_path}/shards", len(docs.columns))
    assert spark.read.parquet(f"{tmp_path}/shards").count() == docs.count()
    assert shard_shuffle.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shuffle_is_not_the_hash_order(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = shard_shuffle.shard(docs, n_shards=1).collect()
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"])]
    moved = sum(abs(i - d) for i, d in enumerate(order)) / len(order)
    assert 500 < moved < 850  # a uniform permutation moves a record by a third of the length


# ------------------------------------------------------------------ chat format
TURNS = [(1, 0, "system", "be \\ <|im_end|>\n brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\\\b<|im_start|>"), (1, 2, "assistant", "a\\\\b<|im_start|>"),
         (2, 0, None, None), (2, None, "odd\nrole\\", "é<\\|im_start|>\\"), (3, 0, "assistant", ""), (None, 0, "assistant", "no id"), (4, 5, "user", "x" * 100000)]


def expected_chat(turns):
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumnRenamed("x", "x").selectExpr("*", "1 as formatted", "2 as n_turns")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        formatted = chat_format.format_conversations(df)
        got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
        texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = expected_chat(TURNS)
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert all(got[c]["formatted_chars"] == len(t) for c, t in texts.items())
    assert "</s>" not in texts[1] and "[INST]" not in texts[1] and texts[1].count("<|im_start|>") == 4
    assert chat_format.digest(chat_format.format_conversations(df.where("false"))).count() == 0


def test_chat_long_conversations_come_in_runs(spark):
    """A hot conversation is never one value, and its runs read back as the whole."""
    turns = [(None if i % 3 else i % 7, i if i % 5 else None, ("user", "assistant", "r" * 70)[i % 3 if i % 2 else 1], f"turn é {i % 11} </s> " * 20) for i in range(900)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat_format.format_conversations(df, run_bytes=5000).checkpoint()
    rows = chat_format.with_starts(formatted).orderBy("conv_id", "run").collect()
    assert max(len(r["formatted"].encode()) for r in rows) < 12000 and sum(r["conv_id"] is None for r in rows) > 30
    got = {r["conv_id"]: r for r in chat_format.digest(formatted).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == expected_chat(turns)
    for c in got:
        runs = [r for r in rows if r["conv_id"] == c]
        whole = "".join(r["formatted"] for r in runs)
        assert len(whole) == got[c]["formatted_chars"] and all(whole[r["start"]:].startswith(r["formatted"]) for r in runs)
        spans = [(r["start"] + s["start"], s["length"]) for r in runs for s in r["loss_spans"]]
        assert hashlib.sha256("".join(chat_format.unescape(whole[a:a + n]) for a, n in spans).encode()).hexdigest() == got[c]["loss_sha256"]


def test_chat_query_matches_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.queries()["op6_chat_format"](spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert got == sorted(con.sql(oracle.oracle_sql()["op6_chat_format"]).fetchall())


# ------------------------------------------------------------------ quality rules
def brute_signals(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality_signals(spark, tmp_path):
    rows = awkward_rows() + [(500, "buy now! " * 300, "en", "s", 0), (501, "\n".join([prose(12, 3)] * 3), "en", "s", 0), (502, "a b c a b c d", "en", "s", 0),
                             (503, " ".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(300)), "en", "s", 0), (504, "# < > | a *b $c% &\n\n\n", "en", "s", 0)]
    got = queries.queries()["op7_quality_bands"](spark, write_tables(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    base = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert base == Counter((d[0], *brute_signals(d[1] or "")) for d in rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[500] and not kept[200] and not kept[201] and kept[100] and all(not r["kept"] for r in got if r["base_failed"])


def test_quality_bands_reject_extremes():
    import base64
    import random
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    r = random.Random(1)
    encoded = base64.b64encode(r.randbytes(12000)).decode()
    blob = " ".join(encoded[i:i + 60] for i in range(0, len(encoded), 60)).encode()
    repeated = " ".join(f"{i} all work and no play makes a dull day for everyone in this large house{i}" for i in range(400)).encode()
    clean = prose(3000, 9).encode()
    assert not quality_bands.judge(blob, pack)[-1] and not quality_bands.judge(repeated, pack)[-1]
    assert quality_bands.judge(clean, pack)[-1]


def test_quality_bands_reject_one_bad_chunk_in_three():
    import base64
    import random
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    clean = prose(3000, 9).encode()[:8192]
    spam = (b"buy now click here best price " * 200)[:4096]
    encoded = base64.b64encode(random.Random(1).randbytes(4096))[:4096]
    encoded = b" ".join(encoded[i:i + 60] for i in range(0, 4096, 60))[:4096]
    for bad in (spam, encoded):
        for text in (clean + bad, bad + clean, clean[:4096] + bad + clean[4096:], prose(30000, 9).encode()[:81920] + bad):
            found = quality_bands.judge(text, pack)
            assert 0 < found[6] < 0.34 and not found[7] and not found[8]
    assert quality_bands.judge(prose(3000, 9).encode()[:12288], pack)[-1]


def test_quality_filter_columns(spark):
    docs = awkward(spark, extra="1 as quality;true as kept")
    out = quality_bands.quality_filter(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert quality_bands.quality_filter(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ token store
def whole_text_ids(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocabulary(queries.WORD_BPE)).encode(text, add_special_tokens=False).ids + [1]


def test_store_round_trip(spark, tmp_path):
    rows = [d for d in awkward_rows() if d[0] != 300] + [(600, "ΑΣ  x y İ <|endoftext|>z\x1cw é ́q don't", "en", "s", 0)]
    got = sorted(map(tuple, queries.queries()["op9_token_store"](spark, write_tables(spark, tmp_path, rows)).collect()), key=lambda r: r[1])
    start, left = 0, Counter()
    for d in rows:
        left[d[0], d[1] or ""] += 1
    assert [r[0] for r in got] == sorted((d[0] for d in rows), key=lambda x: (x is not None, x))
    by = defaultdict(list)
    for d in rows:
        ids = whole_text_ids(d[1] or "")
        by[d[0]].append((len(ids), token_store.crc32_of(ids)))
    for doc, at, n, crc in got:
        assert at == start
        by[doc].remove((n, crc))
        start += n


def test_store_short_access_and_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(60, i), "en", "s", 0) for i in range(400)], SCHEMA)
    folder = f"{tmp_path}/store"
    token_store.write_store(docs, folder, queries.vocabulary(queries.WORD_BPE), block_bytes=2000)
    blocks = spark.read.parquet(f"{folder}/blocks")
    sha = spark.read.parquet(f"{folder}/dictionary").first()
    assert blocks.count() > 3 and hashlib.sha256(bytes(sha["dictionary"])).hexdigest() == sha["sha256"]
    assert {r[0] for r in blocks.select("dictionary_sha256").distinct().collect()} == {sha["sha256"]}
    whole = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in token_store.read_store(spark, folder).collect()}
    some = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in token_store.read_store(spark, folder, [5, 250]).collect()}
    assert some == {k: whole[k] for k in (5, 250)}


def test_store_of_nothing(spark, tmp_path):
    folder = f"{tmp_path}/none"
    token_store.write_store(spark.createDataFrame([], SCHEMA), folder, queries.vocabulary(queries.WORD_BPE))
    assert token_store.read_store(spark, folder).count() == 0

"""SimHash, suffix dedup and SpotSigs against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from storyloom.llm import queries, simhash, spotsigs, suffix_dedup
from storyloom.llm.components import connected_components
from tests.llm.util import SCHEMA, awkward, awkward_rows, prose, write_tables


def roots_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 40)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert got == {k: v for k, v in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ SimHash
def brute_fingerprint(text):
    words = bytes((text or "").encode()).lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [(d[0], brute_fingerprint(d[1])) for d in rows]
    values = sorted({f for _, f in fps})
    root = roots_of(values, [(a, b) for i, a in enumerate(values) for b in values[i:] if bin(a ^ b).count("1") <= 2])
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return Counter((d, f"{f:016x}", least.get(root[f])) for d, f in fps)


def near_rows():
    base = prose(400, 50).split(" ")
    rows = awkward_rows()
    for i in range(25):
        words = list(base)
        words[(37 * i) % 400] = f"changed{i}"
        rows.append((1000 + i, " ".join(words), "en", "s", 0))
    return rows


def test_simhash_query(spark, tmp_path):
    rows = near_rows()
    got = queries.queries()["op1_simhash"](spark, write_tables(spark, tmp_path, rows)).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute_components(rows)
    assert len({r["component_id"] for r in got if r["doc_id"] and r["doc_id"] >= 1000}) < 25  # near copies are found


@pytest.mark.parametrize("paired", [0, 3, 10 ** 6])
def test_block_links_are_exact(spark, paired):
    r = random.Random(8)
    centre = [r.getrandbits(64) for _ in range(12)]
    values = set(centre)
    for c in centre[:4]:
        for _ in range(30):
            x = c
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in sorted(values)]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), paired_block=paired)
    got = {x["node"]: x["root"] for x in connected_components(edges).collect()}
    only = [s[0] for s in signed]
    want = roots_of(only, [(a, b) for a in only for b in only if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    assert all(got.get(n, n) == want[n] for n in only)


def test_simhash_keeps_one_of_each(spark):
    docs = awkward(spark, near_rows(), extra="1 as kept_doc_id;2 as fingerprint;3 as root")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == {c for _, _, c in brute_components(near_rows())}
    assert ids.count(400) == 2 and len(ids) == len(set(ids)) + 1  # two texts share the id 400
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ suffix dedup
def brute_removed(rows, size):
    starts = defaultdict(list)
    raws = [(d[1] or "").encode() for d in rows]
    for i, raw in enumerate(raws):
        for k in range(len(raw) - size + 1):
            starts[raw[k:k + size]].append((i, k))
    hit = [bytearray(len(r)) for r in raws]
    for places in starts.values():
        if len(places) > 1:
            for i, k in places:
                hit[i][k:k + size] = b"\1" * size
    out = Counter()
    for d, raw, mask in zip(rows, raws, hit):
        kept = bytes(b for b, m in zip(raw, mask) if not m)
        spans = sum(1 for k, m in enumerate(mask) if m and (k == 0 or not mask[k - 1]))
        out[d[0], len(raw), sum(mask), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeat_rows():
    r = random.Random(3)
    shared, other = prose(90, 900), prose(70, 901)
    rows = [d for d in awkward_rows() if d[0] != 300]
    for i in range(12):
        text = prose(30 + i, 700 + i)
        cut = r.randrange(len(shared) // 4)
        rows.append((2000 + i, text + shared[cut:] + prose(20, 800 + i) + (other if i % 3 else ""), "en", "s", 0))
    rows.append((3000, "ab" * 500, "en", "s", 0))  # repeats itself
    rows.append((3001, "é" * 450, "en", "s", 0))
    rows.append((3002, "x" * 401, "en", "s", 0))
    rows.append((3003, "y" * 400, "en", "s", 0))
    rows.append((3004, prose(200, 77), "en", "s", 0))  # extends the copied text
    return rows


def test_suffix_query(spark, tmp_path):
    rows = repeat_rows()
    got = queries.queries()["op3_suffix_dedup"](spark, write_tables(spark, tmp_path, rows)).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_removed(rows, 400)
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] for r in got)


@pytest.mark.parametrize("together", [0, 2, 10 ** 6])
def test_suffix_small_sizes_are_exact(spark, together):
    r = random.Random(11)
    parts = ["".join(r.choice("abcd") for _ in range(r.randrange(5, 60))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 12))), "", "", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), min_bytes=40, q=5, together=together)
    assert Counter(map(tuple, suffix_dedup.digest(out).collect())) == brute_removed(rows, 40)


def test_suffix_long_text_in_pieces(spark):
    text = prose(30000, 1)
    far = text[:500] + prose(1_700_000, 2) + text[:450]
    docs = spark.createDataFrame([(1, far, "", "", 0), (2, None, "", "", 0)], SCHEMA)
    got = {r["doc_id"]: r for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert len(far) > 9 << 20 and got[1]["n_removed"] >= 900 and got[1]["n_spans"] == 2 and got[2]["n_bytes"] == 0


def test_suffix_repeated_rows_do_not_multiply(spark):
    shared = prose(40, 900)
    for copies in (2, 60):
        rows = [(1, prose(30, 901) + shared + prose(30, 902), "en", "s", 0)] * copies + [(2, prose(25, 903) + shared + prose(25, 904), "en", "s", 0), (3, shared[:90], "en", "s", 0)]
        docs = awkward(spark, rows)
        got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs.select("doc_id", "text"), min_bytes=40, q=5)).collect()
        assert Counter(map(tuple, got)) == brute_removed(rows, 40)
        spans = suffix_dedup.find_repeats(docs.selectExpr("xxhash64(doc_id, text) AS doc_key", "text"), 40, 5).selectExpr("size(spans) AS n", "size(array_distinct(spans)) AS different").collect()
        assert all(r.n == r.different for r in spans)


def test_suffix_rows_and_columns(spark):
    docs = awkward(spark, repeat_rows(), extra="1 as doc_key;2 as spans;3 as removed;4 as kept;5 as gram")
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[100] == "" and texts[200] is None and texts[203] == "one"
    assert suffix_dedup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


# ------------------------------------------------------------------ SpotSigs
def brute_signatures(text):
    import re
    words = re.findall(r"[^\W_]+", text.lower())
    anchors = set(spotsigs.ANCHORS)
    content = [w for w in words if w not in anchors]
    out, seen = set(), 0
    for w in words:
        if w in anchors:
            if seen + 2 <= len(content):
                out.add((w, content[seen], content[seen + 1]))
        else:
            seen += 1
    return out or {("", " ".join(words))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket", [1500, 1 << 25])
def test_spotsigs_neighbours(spark, bucket):
    rows = [d for d in awkward_rows() if d[0] != 400]
    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(awkward(spark, rows, extra="1 as next;2 as bucket;3 as guest"), bucket_bytes=bucket).collect()}
    order = sorted(rows, key=lambda d: (d[0] is None, -(d[0] or 0)))
    for i, d in enumerate(order):
        text, after = d[1] or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = got[d[0]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(brute_signatures, (text, edited, after))
        assert r["near_edited"] == pytest.approx(jaccard(a, b)) and r["near_next"] == pytest.approx(jaccard(a, c))
        assert r["fingerprint"].count(",") + 1 == len(a) and r["edited_fingerprint"].count(",") + 1 == len(b)
    assert len({got[100 + i]["fingerprint"] for i in range(12)}) == 1


def test_spotsigs_repeated_rows_and_nothing(spark, tmp_path):
    sf = write_tables(spark, tmp_path)
    assert queries.queries()["op8_spotsigs"](spark, sf).count() == len(awkward_rows())
    assert spotsigs.edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spotsigs_texts_without_chains(spark):
    """Near copies of texts without anchors, or with long stretches without, stay near."""
    plain = [f"row{i} value{i * 7 % 31}" for i in range(60)]
    edited = [*plain[:30], "changed", *plain[31:]]
    few = "the first table " + " ".join(plain)
    texts = [" ".join(plain), " ".join(edited), few, "the first table " + " ".join(edited), "one two three four", "one two three five", "one two"]
    sets = [set(r["signatures"]) for r in spotsigs.fingerprints(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()]
    assert len(sets[0]) == 118 and jaccard(sets[0], sets[1]) > 0.9
    assert len(sets[2]) == 121 and jaccard(sets[2], sets[3]) > 0.9 and jaccard(sets[0], sets[2]) > 0.9
    assert len(sets[4]) == 2 and jaccard(sets[4], sets[5]) == pytest.approx(1 / 3) and len(sets[6]) == 1
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts[:4])]
    assert all(r["n_links"] for r in spotsigs.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())


def test_spotsigs_near_duplicates_are_whole(spark):
    r = random.Random(2)
    rows = [(i, prose(60, i % 25), "", "", 0) for i in range(30)]
    for i in range(30):
        words = prose(300, 500 + i // 6).split(" ")
        for _ in range(i % 6):
            words[r.randrange(300)] = f"new{r.randrange(99)}"
        rows.append((100 + i, " ".join(words), "", "", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {d[0]: frozenset(brute_signatures(d[1])) for d in rows}
    classes = set(sets.values())
    want = {d: sum(jaccard(s, o) >= 0.8 for o in classes if o != s) for d, s in sets.items()}
    got = spotsigs.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want and any(want.values())
    assert len({r["class_id"] for r in got}) == len(classes)

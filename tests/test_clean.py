"""Article cleaning on hand-made raw rows (aliases, gates, ratings, dates, sources, ids)."""

from storyloom.functions.text import parse_date, source_from_url, title_case
from storyloom.operators import clean
from pyspark.sql import functions as F

RAW = ("id string, title string, headline string, text string, content string, published_at string, "
       "source string, url string, source_rating string, sourceRating string, rating string")


def _clean(spark, rows, min_rating=0.0):
    return clean.clean_articles(spark.createDataFrame(rows, RAW), min_rating).collect()


def test_aliases_and_gate(spark):
    rows = [
        ("1", "", "Metro phase two opens", None, "body", None, "S", None, None, None, None),
        ("2", "   ", "A valid headline here", None, "body", None, "S", None, None, None, None),
        ("3", "123456789", None, None, "c", None, "S", None, None, None, None),
        ("4", "1234567890", None, None, "c", None, "S", None, None, None, None),
    ]
    got = {r.id: r for r in _clean(spark, rows)}
    assert got["1"].headline == "Metro phase two opens"
    assert "2" not in got          # whitespace title is truthy, then fails the length gate
    assert "3" not in got and "4" in got
    assert got["1"].full_text == "Metro phase two opens. body"


def test_ratings(spark):
    base = ("x", "Headline long enough", None, None, "c", None, "S", None)
    rows = [
        ("1",) + base[1:] + ("0", None, "9"),
        ("2",) + base[1:] + (None, None, None),
        ("3",) + base[1:] + ("abc", None, None),
        ("4",) + base[1:] + ("5", None, None),
    ]
    got = {r.id: r.source_rating for r in _clean(spark, rows)}
    assert got == {"1": 9.0, "2": 0.0, "3": 0.0, "4": 5.0}
    kept = {r.id for r in _clean(spark, rows, min_rating=5.0)}
    assert kept == {"1", "4"}    # threshold is inclusive


def test_dates(spark):
    cases = {
        "2024-01-01T00:00:00Z": "2024-01-01T00:00:00+00:00",
        "2024-01-01T00:00:00-05:00": "2024-01-01T00:00:00-05:00",
        "2024-01-01T00:00:00+05:30": "2024-01-01T00:00:00",
        "2024-01-01T00:00:00.123Z": "2024-01-01T00:00:00",
        "1-2-2024": "2024-02-01T00:00:00",
        "2024/1/2": "2024-01-02T00:00:00",
        "2024-01-01": "2024-01-01T00:00:00",
        "2024-01-01 10:00:00": "2024-01-01 10:00:00",
        "1700000000": "1700000000",
        "24-1-1": "24-1-1",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string")
    out = {r.s: (r.d.date, r.d.date_ts) for r in df.select("s", parse_date(F.col("s")).alias("d")).collect()}
    for k, v in cases.items():
        assert out[k][0] == v, k
    assert out[None][0] == ""
    assert out["2024-01-01T00:00:00-05:00"][1].hour == 5


def test_source_from_url_and_title_case(spark):
    df = spark.createDataFrame([("https://www.foo-bar.com/x",), ("foo.com/x",), ("ht tp://x y",), (None,),
                                ("http://user@host.com:80/p",)], "u string")
    got = [r.s for r in df.select(F.coalesce(source_from_url(F.col("u")), F.lit("Unknown")).alias("s")).collect()]
    assert got == ["Foo-Bar", "Unknown", "Unknown", "Unknown", "User@Host"]
    t = spark.createDataFrame([("foo bar-baz 3d",)], "s string").select(title_case(F.col("s")).alias("t")).collect()[0].t
    assert t == "foo bar-baz 3d".title()


def test_missing_id_uses_stable_hash(spark):
    rows = [(None, "Headline long enough", None, None, "c", None, "S", None, None, None, None),
            ("0", "Headline long enough", None, None, "c", None, "S", None, None, None, None)]
    ids = [r.id for r in _clean(spark, rows)]
    assert ids[0] == ids[1] and len(ids[0]) == 16


def test_load_accounting_and_validation(spark):
    rows = [("1", "Headline long enough", None, None, "", None, "S", None, "9", None, None),
            ("2", "short", None, None, "c", None, "S", None, "9", None, None),
            ("3", "Headline long enough", None, None, "c", None, "S", None, "1", None, None)]
    raw = spark.createDataFrame(rows, RAW)
    acc = clean.load_accounting(raw, 5.0).collect()[0]
    assert (acc.total_read, acc.rating_passed, acc.kept) == (3, 2, 1)
    valid, bad = clean.split_valid(clean.clean_articles(raw))
    assert valid.count() == 1 and bad.count() == 1


def test_ellipsis_clamp_and_min_score(spark):
    from storyloom.functions.text import clamp, ellipsis
    from storyloom.operators import search
    df = spark.createDataFrame([("short", 1.7), ("x" * 120, -0.2)], "t string, s double")
    got = df.select(ellipsis(F.col("t"), 100).alias("e"), clamp(F.col("s")).alias("c")).collect()
    assert got[0].e == "short" and got[1].e == "x" * 97 + "..." and len(got[1].e) == 100
    assert (got[0].c, got[1].c) == (1.0, 0.0)
    hits = spark.createDataFrame([(1, 0.2), (1, 0.9)], "topic_id long, similarity_score double")
    assert search.min_score(hits).count() == 2 and search.min_score(hits, 0.5).count() == 1


def test_encode_hook_normalises(spark):
    import numpy as np
    from storyloom.operators import embed

    def make_encoder():
        def enc(texts):
            return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=np.float32)
        return enc

    df = spark.createDataFrame([("aaa",), ("banana split",)], "full_text string")
    out = embed.encode(df, "full_text", make_encoder, dim=3).collect()
    for r in out:
        assert abs(sum(x * x for x in r.embedding) - 1.0) < 1e-5


def test_statistics(spark):
    from storyloom.operators import stats
    arts = spark.createDataFrame([("a", "S1", "2024-01-02T00:00:00", "xx"), ("b", "S2", "", "xxxx"), ("c", "S1", "2024-01-01T00:00:00", "")],
                                 "id string, source string, date string, content string")
    r = stats.article_statistics(arts).collect()[0]
    assert (r.total_articles, r.sources, r.earliest_date, r.latest_date, r.avg_content_length) == (3, 2, "2024-01-01T00:00:00", "2024-01-02T00:00:00", 2.0)

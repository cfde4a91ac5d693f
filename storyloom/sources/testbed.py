"""Adapters that shape the given driver tables into the inputs the operators expect.

* raw articles   = documents + labels (rating) + events (publication time)
* topics         = benchmark passages
* dense vectors  = embeddings
* API collections = one small collection document per page, built from its URL

Everything is derived with Spark from the tables, so the work grows with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Publication dates in ``events`` fall in one month; each article's date is moved by
# ``doc_id % 90`` days so that month-level statistics have something to show.
DATE_SPREAD_DAYS = 90


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw article rows (string fields, as a JSON feed would deliver them)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    joined = docs.join(labels, "doc_id", "left").join(events, "doc_id", "left")
    nl = F.instr("text", "\n")
    shifted = F.col("ts") + F.make_dt_interval(F.pmod(F.col("doc_id"), F.lit(DATE_SPREAD_DAYS)).cast("int"))
    return joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(F.col("text")).alias("title"),
        F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit("")).alias("content"),
        F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("published_at"),
        F.col("source"),
        (F.col("quality") * 10).cast("string").alias("source_rating"),
        F.col("lang").alias("contentType"),
    )


def write_feed(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The raw articles as JSON files with a wrapped array each, and fields no cleaner knows."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "n_chars", F.struct("lang", "source").alias("meta"))
    rows = raw_articles(spark, sf_dir).join(docs, "id")
    texts = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = '{"origin": {"items": "none"}, "articles": [\n'
        for batch in batches:
            if batch.num_rows:
                lines = batch.column(0).to_pylist()
                lines = [before + lines[0], *(", " + line for line in lines[1:])]
                before = ", "
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if before == ", ":
            yield pa.RecordBatch.from_arrays([pa.array(["]}"], pa.string())], ["value"])

    texts.mapInArrow(wrap, "value string").write.text(folder)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic table ``(topic_id, topic)`` from the benchmark passages."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("topic_id"), F.col("text").alias("topic"))


def dense_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored unit vectors ``(id, embedding, label)``."""
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", "label")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", "url")


def page_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API-collection JSON document per page: ``(collection_id, json)``.

    The page URL becomes a request (protocol, host labels, path segments, query
    parameters) inside a folder named after the language segment; pages whose path has
    three or more segments get a second folder level, and pages with a fragment
    (``#..``) get a plain URL string and a response example.  This exercises folders,
    structured and plain URLs, parameters and responses of the collection reader.
    """
    p = page_urls(spark, sf_dir)
    protocol = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/?([^?#]*)", 1)
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    fragment = F.regexp_extract("url", r"#(.*)$", 1)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    params = F.transform(
        F.filter(F.split(query, "&"), lambda s: s != ""),
        lambda kv: F.struct(
            F.split_part(kv, F.lit("="), F.lit(1)).alias("key"),
            F.split_part(kv, F.lit("="), F.lit(2)).alias("description"),
            (F.split_part(kv, F.lit("="), F.lit(1)) == "ref").alias("disabled"),
        ),
    )
    url_obj = F.struct(
        protocol.alias("protocol"),
        F.split(host, r"\.").alias("host"),
        segs.alias("path"),
        params.alias("query"),
        F.array(F.struct(F.lit("page").alias("key"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("description"))).alias("variable"),
    )
    request_struct = F.to_json(F.struct(F.lit("GET").alias("method"), url_obj.alias("url"),
                                        F.concat(F.lit("Fetch "), F.col("url")).alias("description")))
    request_plain = F.to_json(F.struct(F.lit("POST").alias("method"), F.col("url").alias("url")))
    name = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    leaf = F.when(
        fragment != "",
        F.concat(F.lit('{"name":"'), name, F.lit('","request":'), request_plain,
                 F.lit(',"response":[{"name":"ok","code":200,"status":"OK"}]}')),
    ).otherwise(
        F.concat(F.lit('{"name":"'), name, F.lit('","request":'), request_struct, F.lit("}")))
    lang = F.coalesce(F.element_at(segs, 1), F.lit("root"))
    inner = F.when(F.size(segs) >= 3,
                   F.concat(F.lit('{"name":"deep","item":['), leaf, F.lit("]}"))).otherwise(leaf)
    doc = F.concat(F.lit('{"info":{"name":"pages"},"item":[{"name":"'), lang, F.lit('","item":['), inner,
                   F.lit(']},{"name":"note only"}]}'))
    return p.select(F.col("page_id").alias("collection_id"), doc.alias("json"))


def _json_id(c):
    """An id as a JSON value: bare number when it is all digits, else a quoted string."""
    return F.when(c.rlike(r"^[0-9]+$"), c).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


# Number of reply cases cycled through by topic id (see ``synthetic_replies``).
REPLY_CASES = 15


def synthetic_replies(topics_df: DataFrame, hits: DataFrame) -> DataFrame:
    """Deterministic generator replies ``(topic_id, attempt, reply)`` for attempts 1-2.

    Derived from each topic's hits, one case per topic in rotation (topic_id mod 15):
    valid; fenced; in prose after a non-JSON brace group; out-of-range citations then
    valid; no citation; fabricated timeline id; huge citation number; garbage then
    valid; empty; valid with trailing text; top-level array; numeric ids; a repeated key; a
    NaN value; a citation number of 40 digits.
    """
    h = hits.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("id", "rank").alias("id1"),
        F.max_by("id", F.when(F.col("rank") <= 2, F.col("rank"))).alias("id2"))
    t = topics_df.select("topic_id").join(h, "topic_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = t.withColumn("id1", F.coalesce("id1", F.lit("none"))).withColumn("id2", F.coalesce("id2", F.lit("none")))
    tl_valid = F.concat(F.lit('[{"id": "'), F.col("id1"), F.lit('", "why_it_matters": "first report"}, {"id": "'),
                        F.col("id2"), F.lit('", "why_it_matters": "follow-up"}]'))
    valid = F.concat(F.lit('{"summary": "Coverage of the topic [1] and its follow-up [2].", "timeline": '), tl_valid, F.lit("}"))
    out_range = F.concat(F.lit('{"summary": "Claim [1] and [0] and ['), (F.col("n") + 1).cast("string"),
                         F.lit('].", "timeline": '), tl_valid, F.lit("}"))
    no_cite = F.concat(F.lit('{"summary": "Nobody is quoted in this text.", "timeline": '), tl_valid, F.lit("}"))
    fabricated = F.concat(F.lit('{"summary": "Cited [1].", "timeline": [{"id": "'), F.col("id1"),
                          F.lit('", "why_it_matters": "ok"}, {"id": "fake-'), F.col("topic_id").cast("string"),
                          F.lit('", "why_it_matters": "made up"}]}'))
    huge = F.concat(F.lit('{"summary": "Big [99999999999999999999] claim [1].", "timeline": '), tl_valid, F.lit("}"))
    numeric = F.concat(F.lit('{"summary": "Numbers [1].", "timeline": [{"id": '), _json_id(F.col("id1")),
                       F.lit(', "why_it_matters": "numeric id"}]}'))
    repeated = F.concat(F.lit('{"summary": "draft [9]", "timeline": '), tl_valid, F.lit(', "summary": "Repeated key [1]."}'))
    not_a_number = F.concat(F.lit('{"summary": "Not a number [1].", "score": NaN, "timeline": '), tl_valid, F.lit("}"))
    long_number = F.concat(F.lit('{"summary": "Long [' + "9" * 40 + '] claim [01].", "timeline": '), tl_valid, F.lit("}"))
    case = F.pmod(F.col("topic_id"), F.lit(REPLY_CASES))
    rows = []
    for attempt in (1, 2):
        reply = (F.when(case == 0, valid)
                  .when(case == 1, F.concat(F.lit("The object follows.\n```json\n"), valid, F.lit("\n```\nEnd of reply")))
                  .when(case == 2, F.concat(F.lit("Notes {rough draft} and now the result: "), valid, F.lit(" (final version)")))
                  .when(case == 3, out_range if attempt == 1 else valid)
                  .when(case == 4, no_cite)
                  .when(case == 5, fabricated)
                  .when(case == 6, huge)
                  .when(case == 7, F.lit("busy, please ask later") if attempt == 1 else valid)
                  .when(case == 8, F.lit(""))
                  .when(case == 9, F.concat(valid, F.lit(" trailing words")))
                  .when(case == 10, F.concat(F.lit("["), valid, F.lit("]")))
                  .when(case == 11, numeric)
                  .when(case == 12, repeated)
                  .when(case == 13, not_a_number)
                  .otherwise(long_number))
        rows.append(t.select("topic_id", F.lit(attempt).alias("attempt"), reply.alias("reply")))
    return rows[0].unionByName(rows[1])


def reply_to_prompt(pairs: list[tuple[str, str]]) -> list[str]:
    """A generator whose replies follow from the prompt (stand-in for a model).

    By the length of the topic modulo 3: right at once; a source too many at first, right
    when told so; always a source too many, and a timeline entry of no source.
    """
    out = []
    for _, prompt in pairs:
        topic = prompt[len("Topic: "):prompt.index("\n\nNumbered source articles:\n")]
        ids = re.findall(r"^\[\d+\] \(id=([^,]*), date=", prompt, re.M)
        n, case, told = len(ids), len(topic) % 3, "The last reply had these problems" in prompt
        entry = f'{{"id": "{ids[0]}", "why_it_matters": "first report"}}'
        if case == 0 or case == 1 and told:
            out.append(f'{{"summary": "Sources [1] and [{n}] tell of it.", "timeline": [{entry}]}}')
        else:
            other = ', {"id": "absent", "why_it_matters": "made up"}' if case == 2 else ""
            out.append(f'{{"summary": "Source [{n + 1}] tells of it.", "timeline": [{entry}{other}]}}')
    return out


# Similarity at or above which a retrieved context counts as useful in the derived
# context verdicts.
USEFUL_SIMILARITY = 0.3


def derived_verdicts(sample_rows: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Judge verdict tables derived from the samples and their sources (stand-ins for a judge).

    ``sources``: the retrieved articles of each topic (``storyline.topic_articles``).

    * claims: each ``[n]`` citation in the response; supported when 1 <= n <= sources
    * questions: one per topic, scored by cosine of response and topic term vectors
    * contexts: a hit is useful when its similarity is >= ``USEFUL_SIMILARITY``
    * statements: sentences of the reference (split on ". "); attributed when some
      retrieved article contains the sentence, anywhere in its text
    """
    from storyloom.functions.text import py_strip
    from storyloom.operators import evaluate
    from storyloom.operators.embed import term_vectors

    n = sources.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_sources"))
    cited = F.regexp_replace("c", "^0+(?=[0-9])", "")
    top = F.col("n_sources").cast("string")
    in_range = (cited != "0") & ((F.length(cited) < F.length(top)) | ((F.length(cited) == F.length(top)) & (cited <= top)))
    claims = (sample_rows.select("topic_id", F.posexplode(F.regexp_extract_all("response", F.lit(r"\[(\d+)\]"), 1)).alias("claim_id", "c"))
                         .join(n, "topic_id", "left")
                         .select("topic_id", "claim_id",
                                 F.coalesce(in_range, F.lit(False)).alias("supported")))
    asked = term_vectors(sample_rows.withColumn("q", F.lit(0)), "topic_id", "response", carry=["q"]).withColumnRenamed("id", "topic_id")
    told = term_vectors(sample_rows, "topic_id", "user_input").withColumnRenamed("id", "topic_id")
    questions = evaluate.question_scores(asked, told)
    contexts = sources.select("topic_id", "rank", (F.col("similarity_score") >= USEFUL_SIMILARITY).alias("useful"))
    stmts = sample_rows.select("topic_id", F.posexplode(F.filter(F.transform(F.split("reference", r"\. "), lambda s: py_strip(s)),
                                                                 lambda s: s != "")).alias("statement_id", "statement"))
    body = F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("headline"), F.lit(""))
    ctx = sources.select("topic_id", body.alias("ctx"))
    hit_rows = (stmts.join(ctx, "topic_id").filter(F.instr(F.col("ctx"), F.col("statement")) > 0)
                     .select("topic_id", "statement_id").distinct().withColumn("attributed", F.lit(True)))
    statements = stmts.join(hit_rows, ["topic_id", "statement_id"], "left") \
                      .select("topic_id", "statement_id", F.coalesce("attributed", F.lit(False)).alias("attributed"))
    return {"claims": claims, "questions": questions, "contexts": contexts, "statements": statements}

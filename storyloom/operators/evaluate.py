"""Evaluation: samples per topic and the four retrieval/answer metrics from verdict tables.

A judge model is outside Spark; its verdicts arrive as tables and the metrics are plain
aggregates and windows over them:

* faithfulness      = supported claims / claims                  (claim_verdicts)
* answer relevancy  = mean cosine(question vector, topic vector)  (question scores)
* context precision = sum(precision@i * useful_i) / sum(useful_i) (context_verdicts)
* context recall    = attributable statements / statements        (statement_verdicts)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]


def read_eval_set(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: JSONL golden set -> ``(rows, rejects)``.

    Blank lines, ``#`` comments and unparsable lines land in ``_corrupt_record``; rows
    need both ``topic`` and ``reference`` non-empty.  Rejects are kept for inspection.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).select(F.from_json("value", "topic string, reference string, _corrupt_record string", options).alias("row"), "value")
    raw = lines.select("row.topic", "row.reference", F.coalesce("row._corrupt_record", F.when(F.col("row").isNull(), F.col("value"))).alias("_corrupt_record"))
    ok = (F.col("_corrupt_record").isNull() & (F.coalesce("topic", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != ""))
    return raw.filter(ok).select("topic", "reference"), raw.filter(~ok)


def samples(eval_rows: DataFrame, final: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(topic_id, user_input, response, retrieved_contexts, reference)``; a topic
    without contexts gets ``[""]``."""
    j = eval_rows.join(final.select("topic_id", "summary"), "topic_id", "left") \
                 .join(contexts.select("topic_id", "contexts"), "topic_id", "left")
    ctx = F.when(F.coalesce(F.size("contexts"), F.lit(0)) > 0, F.col("contexts")).otherwise(F.array(F.lit("")))
    return j.select("topic_id", F.col("topic").alias("user_input"), F.coalesce("summary", F.lit("")).alias("response"),
                    ctx.alias("retrieved_contexts"), "reference")


def faithfulness(claims: DataFrame) -> DataFrame:
    return claims.groupBy("topic_id").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def question_scores(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """``(topic_id, q, cosine)`` of each question with its topic, both as term vectors.

    ``questions``: topic_id, q, terms, tf, sumsq; ``topics``: topic_id, terms, tf, sumsq (see
    ``embed.term_vectors``).  Without a common term the cosine is 0.
    """
    flat = lambda df, name, *keys: df.select(*keys, F.col("sumsq").alias(f"{name}_ss"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tf").alias(f"{name}_tf"))))
    met = flat(questions, "q", "topic_id", "q").join(flat(topics, "t", "topic_id"), ["topic_id", "term"])
    dots = met.groupBy("topic_id", "q", "q_ss", "t_ss").agg(F.sum(F.col("q_tf").cast("long") * F.col("t_tf").cast("long")).alias("dot"))
    cosine = F.col("dot") / F.sqrt(F.col("q_ss").cast("double") * F.col("t_ss").cast("double"))
    return questions.select("topic_id", "q").join(dots, ["topic_id", "q"], "left").select("topic_id", "q", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))


def answer_relevancy(question_scores: DataFrame) -> DataFrame:
    """``question_scores``: ``(topic_id, q, cosine)``."""
    return question_scores.groupBy("topic_id").agg(F.avg("cosine").alias("answer_relevancy"))


def context_precision(context_verdicts: DataFrame) -> DataFrame:
    """Rank-weighted precision: running precision at each useful rank, averaged over
    the useful ranks (0 when nothing is useful)."""
    w = Window.partitionBy("topic_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = F.col("useful").cast("double")
    p = context_verdicts.withColumn("_p", F.sum(u).over(w) / F.count(F.lit(1)).over(w)).withColumn("_u", u)
    return p.groupBy("topic_id").agg(
        F.when(F.sum("_u") > 0, F.sum(F.col("_p") * F.col("_u")) / F.sum("_u")).otherwise(F.lit(0.0)).alias("context_precision"))


def context_recall(statements: DataFrame) -> DataFrame:
    return statements.groupBy("topic_id").agg(F.avg(F.col("attributed").cast("double")).alias("context_recall"))


def metrics_table(sample_rows: DataFrame, *parts: DataFrame) -> DataFrame:
    """E6 per-query rows: every sample with its four metrics (NULL when not defined)."""
    out = sample_rows.select("topic_id", "user_input")
    for p in parts:
        out = out.join(p, "topic_id", "left")
    return out


def per_query(sample_rows: DataFrame, verdicts: dict[str, DataFrame]) -> DataFrame:
    """The four metrics of every sample from the verdict tables claims, questions, contexts and statements."""
    return metrics_table(sample_rows, faithfulness(verdicts["claims"]), answer_relevancy(verdicts["questions"]),
                         context_precision(verdicts["contexts"]), context_recall(verdicts["statements"]))


def nan_safe_mean(c: str):
    """Mean ignoring NaN and NULL; NULL when nothing is left."""
    return F.avg(F.nullif(F.col(c), F.lit(float("nan"))))


def aggregate(per_query: DataFrame) -> DataFrame:
    """E6 aggregate row: sample count and NaN-safe mean per metric."""
    return per_query.agg(F.count(F.lit(1)).alias("num_samples"),
                         *[F.round(nan_safe_mean(m), 6).alias(m) for m in METRICS])

"""Incremental article ingestion with Structured Streaming.

New JSON-lines article files dropped into a folder are cleaned as they arrive
(stateless projection + filter), and each micro-batch appends to two Parquet tables:

* ``articles``: cleaned rows, with the whole article in ``raw``
* ``vectors``:  a versioned store (``sources.store``) of term vectors keyed by ``md5(model |
  text)``; a text stored by an earlier batch is not encoded again (the S4 cache rule), and
  only the prefixes of a batch's keys are read.

Each micro-batch writes only its own ``batch_id`` partition of the articles with dynamic
overwrite, and its vectors under a tag of its own, so a batch replayed after a failure
replaces its earlier output, or finds it, instead of duplicating it.
Progress is kept in the query's checkpoint location, so a restarted query resumes where
it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.clean import clean_articles
from storyloom.operators.embed import term_vectors, text_key
from storyloom.sources.news import parse_articles
from storyloom.sources.store import Store


def _write_batch_partition(df: DataFrame, path: str) -> None:
    """Replace exactly this micro-batch's partition: a replay rewrites, never appends twice."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def start_ingest(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str,
                 model: str = "term-count-v1", min_rating: float = 0.0, available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``."""
    lines = spark.readStream.text(source_dir).where(F.length(F.trim("value")) > 0)
    cleaned = clean_articles(parse_articles(lines, "value"), min_rating=min_rating)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("key", text_key("full_text", model)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        _write_batch_partition(keyed, f"{out_dir}/articles")
        # Read back, so that the batch is parsed and cleaned once and nothing is cached.
        rows = spark.read.schema(keyed.schema).parquet(f"{out_dir}/articles").where(F.col("batch_id") == batch_id)
        store = Store(spark, f"{out_dir}/vectors")
        todo = store.missing(rows.select("key", "full_text").dropDuplicates(["key"]))
        tv = term_vectors(todo, "key", "full_text").withColumnRenamed("id", "key").withColumn("model", F.lit(model))
        store.append(tv, tag=f"batch-{batch_id}")

    writer = cleaned.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()

"""Sinks: storyline documents (S5), search hits (S6) and evaluation output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULE = "=" * 80


def write_storylines(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per topic."""
    docs.write.mode(mode).json(path)


def hits_readable(hits: DataFrame) -> DataFrame:
    """S6 text form: one block per hit (rank, score with 4 decimals, endpoint fields, text),
    and a closing rule behind the last hit of a query.

    ``hits`` needs ``rank, similarity_score, text, metadata{endpoint_name, category,
    method, url}``.
    """
    block = F.concat_ws("\n", F.lit("\n" + RULE),
                        F.concat(F.lit("Rank: "), F.col("rank").cast("string")),
                        F.concat(F.lit("Similarity Score: "), F.format_string("%.4f", F.col("similarity_score"))),
                        F.concat(F.lit("Endpoint: "), F.col("metadata.endpoint_name")),
                        F.concat(F.lit("Category: "), F.col("metadata.category")),
                        F.concat(F.lit("Method: "), F.col("metadata.method")),
                        F.concat(F.lit("URL: "), F.col("metadata.url")),
                        F.concat(F.lit("\n"), F.col("text")))
    keys = [c for c in ("topic_id",) if c in hits.columns]
    last = F.max("rank").over(Window.partitionBy(*keys)) == F.col("rank")
    closed = F.when(last, F.concat(block, F.lit(f"\n\n{RULE}"))).otherwise(block)
    return hits.select(*keys, "rank", closed.alias("value"))


def write_hits(hits: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Hits as JSON lines, or as readable text blocks ordered by rank per query."""
    if fmt == "json":
        hits.write.mode(mode).json(path)
        return
    keys = [c for c in ("topic_id",) if c in hits.columns]
    out = hits_readable(hits)
    if keys:
        out = out.repartition(*keys)
    out.sortWithinPartitions(*keys, "rank").select("value").write.mode(mode).text(path)


def write_evaluation(per_query: DataFrame, aggregate: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-query metric rows and one aggregate row (with ``results_path``)."""
    per_query.write.mode(mode).json(f"{path}/per_query")
    aggregate.withColumn("results_path", F.lit(path)).write.mode(mode).json(f"{path}/aggregate")

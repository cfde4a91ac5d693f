"""Dataset statistics: articles (A2/A6) and vector sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def article_statistics(articles: DataFrame) -> DataFrame:
    """One row: article count, distinct sources, earliest/latest non-empty date and the
    mean content length.  An empty input gives a count of 0 and NULL statistics."""
    dated = F.nullif(F.col("date"), F.lit(""))
    return articles.agg(F.count(F.lit(1)).alias("total_articles"), F.countDistinct("source").alias("sources"),
                        F.min(dated).alias("earliest_date"), F.max(dated).alias("latest_date"),
                        F.avg(F.length("content")).alias("avg_content_length"))


def vector_statistics(vectors: DataFrame, vec_col: str = "embedding", label: str | None = "label") -> DataFrame:
    """One row: number of vectors, dimension (longest vector) and, when given, labels."""
    aggs = [F.count(F.lit(1)).alias("total_vectors"), F.max(F.size(vec_col)).alias("embedding_dim")]
    if label:
        aggs.append(F.countDistinct(label).alias("labels"))
    return vectors.agg(*aggs)

"""Read news article JSON (bare array, object wrapping the array, or articles one by one) and land it.

Files are read by many tasks each (``sources.json_arrays``).  Every article is parsed once,
into a VARIANT that keeps all its fields; the fields that the cleaner reads are taken from
it by path, as strings, so ratings such as ``"abc"`` do not fail the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.clean import LANDED_RATING, RAW_STRING_FIELDS, resolve_rating, with_raw_fields
from storyloom.sources.json_arrays import read_elements

# Fixed value: wrapper keys, tried in this order.
WRAPPER_KEYS = ["items", "articles", "data", "news"]


def read_news_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw article rows from JSON files at ``path``: the cleaner's fields and ``raw``, the
    whole article as VARIANT.  An article that is not valid JSON has nulls only."""
    return parse_articles(read_elements(spark, path, WRAPPER_KEYS), "text")


def parse_articles(rows: DataFrame, text: str) -> DataFrame:
    """The cleaner's fields and ``raw`` of JSON texts, one article each."""
    parsed = rows.select(F.try_parse_json(F.col(text)).alias("raw"))
    fields = [F.try_variant_get("raw", f"$.{c}", "string").alias(c) for c in RAW_STRING_FIELDS]
    return parsed.select(*fields, F.try_variant_get("raw", "$.tags", "array<string>").alias("tags"), "raw")


def land(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write raw rows as Parquet (the copy later jobs read), ``raw`` included, with the
    rating as a number: the cleaner's rating filter is pushed into the scan of the copy."""
    rated = with_raw_fields(df).withColumn(LANDED_RATING, resolve_rating())
    rated.write.mode(mode).parquet(path)

"""Article cleaning: alias resolution, rating filter, validity gate, dates, sources, ids.

Input is a raw article frame with any subset of the alias columns below (missing ones
are treated as NULL).  Everything is a single projection + filter, so it fuses into
the scan stage (ratings are read through casts, so the predicate runs behind the scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import (first_truthy, parse_date, py_strip, source_from_url, truthy)

# Alias fields of a raw article, in the order they are tried.
HEADLINE_ALIASES = ["title", "headline", "text", "summary"]
CONTENT_ALIASES = ["story", "content", "description", "text", "body"]
DATE_ALIASES = ["published_at", "publishedAt", "date", "timestamp"]
RATING_ALIASES = ["source_rating", "sourceRating", "rating"]
MIN_HEADLINE_CHARS = 10

RAW_STRING_FIELDS = sorted(set(HEADLINE_ALIASES + CONTENT_ALIASES + DATE_ALIASES + RATING_ALIASES
                               + ["id", "source", "url", "author", "contentType"]))

CLEAN_COLUMNS = ["id", "headline", "content", "full_text", "date", "date_ts", "url", "source",
                 "source_rating", "author", "category", "tags"]


def with_raw_fields(raw: DataFrame) -> DataFrame:
    """Add every alias column the cleaner reads as a NULL when it is absent."""
    present = set(raw.columns)
    cols = [F.col(c) for c in raw.columns]
    cols += [F.lit(None).cast("string").alias(c) for c in RAW_STRING_FIELDS if c not in present]
    if "tags" not in present:
        cols.append(F.lit(None).cast("array<string>").alias("tags"))
    return raw.select(*cols)


def resolve_rating(c=F.col) -> Column:
    """Rating: first non-zero of the aliases (last one may be zero), as DOUBLE, 0.0 if unusable."""
    r = [F.col(a).cast("string").try_cast("double") for a in RATING_ALIASES]
    return F.coalesce(F.nullif(r[0], F.lit(0.0)), F.nullif(r[1], F.lit(0.0)), r[2], F.lit(0.0))


#: Column of landed articles with the resolved rating, so that a rating filter reaches the scan.
LANDED_RATING = "rating_value"


def _rating(raw: DataFrame) -> Column:
    return F.col(LANDED_RATING) if LANDED_RATING in raw.columns else resolve_rating()


def _headline_raw() -> Column:
    return F.coalesce(first_truthy(*[F.col(a) for a in HEADLINE_ALIASES]), F.lit(""))


def _is_valid() -> Column:
    return F.length(py_strip(_headline_raw())) >= MIN_HEADLINE_CHARS


def clean_articles(raw: DataFrame, min_rating: float = 0.0, keep_raw: bool = False) -> DataFrame:
    """Rating filter (inclusive) + validity gate + normalised article columns.

    The whole article stays in ``raw`` when the input has that column (see ``sources.news``),
    or as JSON text with ``keep_raw``.  Missing ids fall back to a stable hash of headline, content, date and url (first 16 hex
    digits of the MD5), so the same article gets the same id on every run and others do not.
    """
    df = with_raw_fields(raw)
    rating = _rating(raw)
    headline_raw = _headline_raw()
    content_raw = F.coalesce(first_truthy(*[F.col(a) for a in CONTENT_ALIASES]), F.lit(""))
    date_raw = first_truthy(*[F.col(a) for a in DATE_ALIASES])
    parsed = parse_date(date_raw)
    source = F.coalesce(truthy(F.col("source")), source_from_url(F.col("url")), F.lit("Unknown"))
    told = F.concat_ws("\x1f", headline_raw, content_raw, F.coalesce(date_raw, F.lit("")), F.coalesce(F.col("url"), F.lit("")))
    raw_id = truthy(F.col("id").cast("string"))
    ident = F.coalesce(F.when(raw_id != "0", raw_id), F.substring(F.md5(told), 1, 16))
    cols = [
        ident.alias("id"),
        py_strip(headline_raw).alias("headline"),
        py_strip(content_raw).alias("content"),
        py_strip(F.concat(headline_raw, F.lit(". "), content_raw)).alias("full_text"),
        parsed["date"].alias("date"),
        parsed["date_ts"].alias("date_ts"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        source.alias("source"),
        rating.alias("source_rating"),
        F.coalesce(F.col("author"), F.lit("")).alias("author"),
        F.coalesce(F.col("contentType"), F.lit("General")).alias("category"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
    ]
    if "raw" in raw.columns:  # the whole article, as landed
        cols.append(F.col("raw"))
    elif keep_raw:
        cols.append(F.to_json(F.struct(*[F.col(c) for c in raw.columns])).alias("raw"))
    return df.filter((rating >= F.lit(min_rating)) & _is_valid()).select(*cols)


def row_key() -> Column:
    """Tells cleaned articles with equal ids apart (equal only for rows equal in all columns)."""
    return F.xxhash64(*[F.col(c) for c in CLEAN_COLUMNS])


def accounting(min_rating: float = 0.0) -> list[Column]:
    """Rows read, rows passing the rating filter, rows kept after the gate, as aggregates
    over ``with_raw_fields`` rows; for ``agg`` or, without a pass of their own, ``observe``."""
    passes = resolve_rating() >= F.lit(min_rating)
    return [F.count(F.lit(1)).alias("total_read"), F.count_if(passes).alias("rating_passed"), F.count_if(passes & _is_valid()).alias("kept")]


def load_accounting(raw: DataFrame, min_rating: float = 0.0) -> DataFrame:
    """One row: rows read, rows passing the rating filter, rows kept after the gate."""
    return with_raw_fields(raw).agg(*accounting(min_rating))


def is_complete() -> Column:
    """Required-field check: headline and content are non-empty."""
    return (F.coalesce(F.col("headline"), F.lit("")) != "") & (F.coalesce(F.col("content"), F.lit("")) != "")


def split_valid(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)`` by the required-field check."""
    return articles.filter(is_complete()), articles.filter(~is_complete())

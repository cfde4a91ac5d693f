"""Column expressions for the text rules of the article and endpoint pipelines.

All functions take and return ``Column`` objects and stay JVM-side (built-in
functions and higher-order functions only, no Python UDFs).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's ``str.isspace`` accepts (derived by rule, 29 characters);
# ``str.split()`` and ``str.strip()`` use exactly this set.  (Java's ``(?U)\s`` would miss
# the four separator controls U+001C-U+001F.)
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())
_WS_RUN = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]+"


def truthy(c: Column) -> Column:
    """NULL for the values a Python ``or`` chain skips on strings (None and '')."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """``a or b or c`` over strings: first value that is neither NULL nor ''."""
    return F.coalesce(*[truthy(c) for c in cols])


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing whitespace of any kind (native
    ``btrim`` with Python's whitespace set)."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def py_words(c: Column) -> Column:
    """``str.split()`` without arguments: whitespace-separated words, no empty items."""
    return F.filter(F.split(c, _WS_RUN), lambda w: w != "")


def title_case(c: Column) -> Column:
    """``str.title()``: upper-case the first letter of every run of letters.

    ``initcap`` only splits on spaces (``foo-bar`` -> ``Foo-bar``), Python splits on
    every non-letter (``Foo-Bar``); cutting the text into letter / non-letter runs first
    gives the Python result.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def contains_any(c: Column, words: list[str]) -> Column:
    """True when any of ``words`` occurs as a substring of ``c``."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


# URL authority the way ``urllib.parse.urlparse(..).netloc`` finds it: an optional
# scheme (a letter, then letters, digits, ``+ - .``) followed by ``//``.
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def url_authority(url: Column) -> Column:
    """Authority part of a URL, '' when there is none (no scheme, bad scheme)."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def source_from_url(url: Column) -> Column:
    """Publisher name from a URL: authority without ``www.``, first dot label, title-cased.

    NULL when nothing usable is left, so callers can ``coalesce`` to a default.
    """
    host = F.replace(url_authority(url), F.lit("www."), F.lit(""))
    return truthy(title_case(F.split_part(host, F.lit("."), F.lit(1))))


# The five date layouts, tried in this order (same as the loader being
# matched): "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d".
_ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss"
_F_DATETIME = "yyyy-M-d'T'H:m:s"
_F_YMD = "yyyy-M-d"
_F_DMY = "d-M-yyyy"
_F_YMD_SLASH = "yyyy/M/d"


def parse_date(raw: Column) -> Column:
    """Normalise a raw date string; returns ``struct<date STRING, date_ts TIMESTAMP>``.

    The text is cut at the first ``+`` and then at the first ``.`` before matching, so
    ``+05:30`` offsets and fractions vanish while ``Z`` and ``-hh:mm`` are kept and
    printed as ``+00:00`` / ``-hh:mm``.  Unmatched text is returned unchanged, missing
    text as ''.  ``date_ts`` is the UTC instant (NULL when unparsed).
    """
    s = raw.cast("string")
    cleaned = F.split_part(F.split_part(s, F.lit("+"), F.lit(1)), F.lit("."), F.lit(1))
    f1 = F.try_to_timestamp(cleaned, F.lit(_F_DATETIME))

    zone_re = r"^(.*?)(Z|-(\d\d):?([0-5]\d))$"
    body = F.regexp_extract(cleaned, zone_re, 1)
    zone = F.regexp_extract(cleaned, zone_re, 2)
    zh = F.regexp_extract(cleaned, zone_re, 3)
    zm = F.regexp_extract(cleaned, zone_re, 4)
    f2 = F.when(zone != "", F.try_to_timestamp(body, F.lit(_F_DATETIME)))
    utc_zero = (zone == "Z") | ((zh == "00") & (zm == "00"))
    zone_txt = F.when(utc_zero, F.lit("+00:00")).otherwise(F.concat(F.lit("-"), zh, F.lit(":"), zm))
    f2_utc = F.when(utc_zero, f2).otherwise(
        f2 + F.make_dt_interval(F.lit(0), zh.cast("int"), zm.cast("int")))

    f3 = F.try_to_timestamp(cleaned, F.lit(_F_YMD))
    f4 = F.try_to_timestamp(cleaned, F.lit(_F_DMY))
    f5 = F.try_to_timestamp(cleaned, F.lit(_F_YMD_SLASH))
    plain = F.coalesce(f1, F.when(f2.isNull(), F.coalesce(f3, f4, f5)))

    date = (F.when(truthy(s).isNull(), F.lit(""))
             .when(f1.isNotNull(), F.date_format(f1, _ISO_OUT))
             .when(f2.isNotNull(), F.concat(F.date_format(f2, _ISO_OUT), zone_txt))
             .when(plain.isNotNull(), F.date_format(plain, _ISO_OUT))
             .otherwise(s))
    date_ts = F.coalesce(f1, f2_utc, plain)
    return F.struct(date.alias("date"), date_ts.alias("date_ts"))


def ellipsis(c: Column, max_length: int = 100) -> Column:
    """Cut to ``max_length`` characters including a trailing ``...``."""
    return F.when(F.length(c) <= max_length, c).otherwise(
        F.concat(F.substring(c, 1, max_length - 3), F.lit("...")))


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp a score into ``[lo, hi]``."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))

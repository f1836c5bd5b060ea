"""URL extraction and normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: a URL inside text, the punctuation that never ends one, its parts.
URL = r"(?i)https?://[^\s)\\\]\"'<>]+"
MARKET_URL = r"https?://\S+"
TRAILING = r"[.,;:!?)\]}'\"]+$"
MARKET_TRAILING = r"[.,);\]]+$"
PARTS = r"(?i)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def urls(text: Column, pattern: str = URL, trailing: str = TRAILING) -> Column:
    """Distinct URLs of a text without their trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, trailing, "")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    """Slashes collapsed, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, PARTS, 3), "/+", "/"), "/$", "")


def query_string(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, PARTS, 4), "&+$", "")


def normalised(url: Column) -> Column:
    """Scheme and host in lower case, path tidied, fragment dropped."""
    scheme = F.lower(F.regexp_extract(url, PARTS, 1))
    q = query_string(url)
    return F.concat(
        scheme, F.lit("://"), host(url), path(url), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))
    )


def prefixes(text: Column, lengths: Column) -> Column:
    """Leading parts of ``text`` with the given lengths, as far as it reaches.

    ``lengths`` are those the other side of a prefix join has, so only parts that
    could match are formed.
    """
    size = F.char_length(text)
    return F.transform(
        F.filter(lengths, lambda n: n <= size), lambda n: F.substring(text, F.lit(1), n)
    )


def length_set(rows: DataFrame, column: str, shortest: int) -> Column:
    """Distinct text lengths of a column from ``shortest`` up, as a scalar array.

    Bounded by the longest URL, not by the number of rows.
    """
    sizes = rows.select(F.char_length(column).alias("n")).where(F.col("n") >= shortest)
    return sizes.agg(F.array_sort(F.collect_set("n"))).scalar()

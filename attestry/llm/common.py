"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.sources.storage import scratch_path

# Fixed values of the operators' contracts: what separates words, and what a word is.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_BYTES = b" \t\n\x0b\x0c\r"

# Column type of a document row carried through an operator untouched.
ROW = "row"


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(word_list(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The whole row as one struct next to ``more``, so added names cannot clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *more)


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Later steps read files that outlive any executor, and prune columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus

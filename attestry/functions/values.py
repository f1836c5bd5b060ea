"""Tolerant scalar conversions shared by the importers and the catalog.

All functions take and return Columns; a value that does not parse is NULL,
never an error, also under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: the number spellings the log and catalog formats accept.
NUMBER_TEXT = r"^[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
WHITESPACE = " \t\n\x0b\x0c\r"
INTEGER_TEXT = r"^[+-]?\d+$"


def null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def nonblank(text: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(trimmed(text), F.lit(""))


def trimmed(text: Column) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_nonblank(*texts: Column) -> Column:
    return F.coalesce(*[nonblank(t) for t in texts])


def number(text: Column) -> Column:
    """DOUBLE of a numeric text.

    The pattern test comes first: it refuses the cast's type suffixes (``1d``) and
    is far cheaper than a failing cast.
    """
    t = trimmed(text)
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast("double"))


def integer(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t.rlike(INTEGER_TEXT), t.try_cast("bigint"))


def json_text(variant: Column, path: str) -> Column:
    """Text of a scalar at ``path``; JSON null and absent are NULL."""
    return F.try_variant_get(variant, path, "string")


def json_type(variant: Column, path: str) -> Column:
    """Type name at ``path``: STRING, BOOLEAN, a numeric name, OBJECT<..., ARRAY<... ."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def json_number(variant: Column, path: str) -> Column:
    """DOUBLE of a JSON number or of a numeric string; anything else is NULL."""
    kind = json_type(variant, path)
    return F.when(
        ~kind.isin("BOOLEAN", "VOID") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"),
        number(json_text(variant, path)),
    )


def truncated(value: Column) -> Column:
    """BIGINT toward zero; out of range is NULL."""
    return value.try_cast("bigint")

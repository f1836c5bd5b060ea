"""Slash-separated paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_absolute(path: Column) -> Column:
    """A home-relative path counts as absolute."""
    return path.startswith("/") | path.startswith("~")


def clean_segments(path: Column) -> Column:
    """Segments of an absolute path with ``.`` and ``..`` folded away."""
    return F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda seen, s: F.when(s.isin("", "."), seen)
        .when(s == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.concat(seen, F.array(s))),
    )


def normal(path: Column) -> Column:
    """Outer blanks, a leading ``./`` and outer slashes dropped; backslashes turned."""
    text = F.regexp_replace(path, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"^\./", "")
    return F.translate(F.regexp_replace(text, "^/+|/+$", ""), "\\", "/")


def ancestors(path: Column) -> Column:
    """The path and every folder above it."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )

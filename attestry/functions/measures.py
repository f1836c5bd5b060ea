"""Text measures.  The word definitions differ on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: what counts as a word, a number with its unit, and a URL.
BLANKS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Blanks as a complement: a printable ASCII character is told by one comparison.
BLANK = f"[^!-~[^{BLANKS}]]"
TOKEN_WORD = r"[A-Za-z0-9_'-]+"
BOUNDED_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"
NUMERIC_FACT = (
    r"(?i)(?<![A-Za-z])(?:[$€£]?\d[\d,]*(?:\.\d+)?\s?(?:%|percent|x|k|m|b|million|billion|ms|s"
    r"|seconds|minutes|hours|days|users|customers|requests|rows|records|gb|mb)?)"
)
NON_WORD = r"[^\p{L}\p{N}_]"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def spaced_words(text: Column) -> Column:
    """Words between blanks: the pieces of the text but for an empty one at either end."""
    return F.array_size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), f"{BLANK}+")) - 2


def token_words(text: Column) -> Column:
    return count(text, TOKEN_WORD)


def bounded_words(text: Column) -> Column:
    return count(text, BOUNDED_WORD)


def lines(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def visible_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, f"{BLANK}+", ""))


def numeric_facts(text: Column) -> Column:
    """Distinct numbers with their unit."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC_FACT), F.lit(0)))


def missing(required: list[str], present: Column) -> Column:
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def assertion_count(text: Column, pattern: str) -> Column:
    return count(text, pattern)


def substantive_lines(text: Column) -> Column:
    """Lines that are neither blank nor comments; at least 1."""
    kept = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"^\s*($|#|//|/\*|\*)"))
    return F.greatest(F.size(kept), F.lit(1))


# Fixed patterns: how test runners report how many tests passed.
TEST_COUNT_PATTERNS = [
    r"Tests:\s+.*?(\d+)\s+passed",
    r"Test Files\s+.*?(\d+)\s+passed",
    r"(\d+)\s+passed(?:,|\s+in|\s*$)",
    r"collected\s+(\d+)\s+items?",
    r"Ran\s+(\d+)\s+tests?",
    r"(\d+)\s+passing",
]


def test_count(output: Column, patterns: list[str] | None = None) -> Column:
    """Largest count any pattern finds; NULL when none does."""
    found = [
        F.regexp_extract_all(output, F.lit("(?idms)" + p), F.lit(1))
        for p in (patterns or TEST_COUNT_PATTERNS)
    ]
    numbers = F.transform(F.flatten(F.array(*found)), lambda n: n.try_cast("bigint"))
    return F.array_max(numbers)

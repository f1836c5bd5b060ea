"""Text forms of measures, costs, events and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.functions.values import nonblank

SIGNIFICANT = 4


def milliseconds(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + F.lit(0.5)).cast("bigint")


def whole_tokens(tokens: Column) -> Column:
    return F.floor(tokens).cast("bigint")


def rate_text(rate: Column) -> Column:
    return F.format_string("%.2f", rate)


def display_name(display: Column, slug: Column) -> Column:
    shown = F.nullif(display, F.lit(""))
    return (
        F.when(shown.isNull() | (shown == slug), slug)
        .otherwise(F.concat(shown, F.lit(" ("), slug, F.lit(")")))
    )


def harness_or_unknown(harness: Column) -> Column:
    return F.coalesce(F.nullif(harness, F.lit("")), F.lit("unknown"))


def short_cost(cost: Column) -> Column:
    """Unknown is covered by a plan; small amounts are cents.

    Halves round up here; engines that print the exact binary value may differ
    on ties, so keep the raw cost next to this text.
    """
    cents = cost * 100
    return (
        F.when(cost.isNull(), "in plan")
        .when(cost == 0, "free")
        .when((cost < 0.10) & (cents < 1), "<1¢")
        .when(cost < 0.10, F.concat(F.lit("~"), F.round(cents).cast("int").cast("string"), F.lit("¢")))
        .otherwise(F.format_string("$%.2f", cost))
    )


def significant(value: Column, digits: int = SIGNIFICANT) -> Column:
    """Shortest text with ``digits`` significant digits, exponent form outside 1e-4..10^digits."""
    parts = F.format_string(f"%.{digits - 1}e", value)
    mantissa = F.substring_index(parts, "e", 1)
    exponent = F.substring_index(parts, "e", -1).cast("int")
    plain = F.lit(None).cast("string")
    for e in range(-4, digits):
        plain = F.when(exponent == e, F.format_string(f"%.{digits - 1 - e}f", value)).otherwise(plain)
    scientific = F.concat(
        _strip_zeros(mantissa), F.lit("e"),
        F.when(exponent < 0, "-").otherwise("+"),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    # lpad would cut a three-digit exponent
    scientific = F.when(
        F.abs(exponent) >= 100,
        F.concat(
            _strip_zeros(mantissa), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
            F.abs(exponent).cast("string"),
        ),
    ).otherwise(scientific)
    return F.when(exponent.between(-4, digits - 1), _strip_zeros(plain)).otherwise(scientific)


def _strip_zeros(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(trimmed, r"\.$", "")


def price_text(price: Column, variable: Column) -> Column:
    return (
        F.when(variable | price.isNull(), "var").when(price == 0, "0").otherwise(significant(price))
    )


def float_text(value: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def event_text(
    ts: Column, model_id: Column, kind: Column, payload: Column
) -> Column:
    """One line per change event."""
    head = F.concat_ws(" ", ts, model_id, kind)
    prices = F.concat(
        F.lit(": in "), float_text(payload["old_prompt_per_m"]), F.lit("->"),
        float_text(payload["new_prompt_per_m"]), F.lit(", out "),
        float_text(payload["old_completion_per_m"]), F.lit("->"),
        float_text(payload["new_completion_per_m"]),
    )
    return (
        F.when(kind == "price_change", F.concat(head, prices))
        .when((kind == "added") & payload["free"], F.concat(head, F.lit(" FREE")))
        .otherwise(head)
    )


# Fixed character class: what a file-name component may hold.
UNSAFE_NAME = "[^A-Za-z0-9._-]+"
UNSAFE_SESSION = "[^A-Za-z0-9_.-]+"


def safe_name(text: Column) -> Column:
    """One path component; an empty result becomes ``unnamed``."""
    cleaned = F.regexp_replace(F.regexp_replace(text, UNSAFE_NAME, "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unnamed"))


def safe_session(text: Column) -> Column:
    """Session variant: ``_`` for unsafe runs, outer dots and underscores dropped."""
    cleaned = F.regexp_replace(F.regexp_replace(text, UNSAFE_SESSION, "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown-session"))


def marker_key(session: Column, event: Column) -> Column:
    """Once-only marker of a (session, event): SHA-256 of both, NUL separated."""
    return F.sha2(F.concat(session, F.lit("\0"), event), 256)


# Fixed lists: extensions by deliverable kind, and the report names by priority.
WEB_SUFFIXES = [".html", ".htm"]
IMAGE_SUFFIXES = [".avif", ".gif", ".jpeg", ".jpg", ".png", ".svg", ".webp"]
TEXT_SUFFIXES = [".md", ".txt", ".log"]
REPORT_NAMES = ["report.md", "report.html"]


def file_suffix(name: Column) -> Column:
    """Last extension in lower case with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def deliverable_kind(name: Column) -> Column:
    suffix = file_suffix(name)
    return (
        F.when(suffix.isin(*WEB_SUFFIXES), "web page")
        .when(suffix.isin(*IMAGE_SUFFIXES), "image")
        .when(suffix.isin(*TEXT_SUFFIXES), "document")
        .otherwise("download")
    )


def _spaced_stem(name: Column) -> Column:
    return nonblank(F.translate(file_stem(name), "_-", "  "))


def deliverable_label(name: Column) -> Column:
    stem = _spaced_stem(name)
    pretty = F.concat(F.upper(F.left(stem, F.lit(1))), F.substring(stem, 2, 2**31 - 1))
    return F.concat(F.coalesce(pretty, F.lit("Work")), F.lit(" — "), deliverable_kind(name))


def deliverable_title(name: Column) -> Column:
    stem = _spaced_stem(name)
    capital = F.concat(
        F.upper(F.left(stem, F.lit(1))), F.lower(F.substring(stem, 2, 2**31 - 1))
    )
    return (
        F.when(F.lower(name) == "worker.log", "Work log")
        .when(F.lower(name).isin(*REPORT_NAMES), "What this worker produced")
        .otherwise(F.coalesce(capital, F.lit("Worker output")))
    )


def report_name(names: Column) -> Column:
    """The report among a task's deliverable names; Markdown before HTML."""
    found = F.lit(None).cast("string")
    for name in reversed(REPORT_NAMES):
        found = F.when(F.array_contains(names, name), F.lit(name)).otherwise(found)
    return found

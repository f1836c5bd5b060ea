"""Table invariants: all rules of a check run in one aggregate over the records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType

from attestry.functions.values import null, number

# Fixed list: sections a validation report must have.
REPORT_SECTIONS = [
    "## verdict", "## row counts", "## schema", "## empty value scan", "## spot invariants",
    "## rejects", "## assumptions",
]
ORDERING = (">=", "<=", ">", "<")
OPERATORS = ("==", "!=", *ORDERING)
FIELD = re.compile(r"[\w.-]+", re.ASCII)


@dataclass(frozen=True)
class Invariant:
    """``count``, ``unique``, ``nonempty``, or a predicate in scope ``all``/``any``."""

    kind: str
    field: str = ""
    op: str = ""
    value: str = ""

    @property
    def name(self) -> str:
        if self.kind in ("unique", "nonempty"):
            return f"{self.kind}:{self.field}"
        scope = "any:" if self.kind == "any" else ""
        return f"{scope}{self.field or 'count'}{self.op}{self.value}"


def invariant(text: str) -> Invariant:
    """One invariant from its text form, for example ``count>=10`` or ``any:status==F``.

    Only the first colon ends a scope, and only the first operator splits a predicate,
    so times, addresses and operators may stand in the compared value.
    """
    head, colon, rest = text.partition(":")
    scoped = bool(colon) and head in ("any", "all", "unique", "nonempty")
    scope, body = (head, rest.strip()) if scoped else ("all", text.strip())
    if scope in ("unique", "nonempty"):
        return Invariant(scope, field=body)
    places = [(body.find(op), -len(op), op) for op in OPERATORS if op in body]
    if places:
        at, _, op = min(places)
        field, value = body[:at].rstrip(), body[at + len(op) :].strip()
        if field == "count" and value.isdecimal() and not scoped:
            return Invariant("count", op=op, value=value)
        if FIELD.fullmatch(field) and value:
            return Invariant(scope, field, op, value.strip("'\""))
    raise ValueError(f"unsupported invariant: {text}")


def _compare(left: Column, op: str, right: Column) -> Column:
    return {
        "==": left == right, "!=": left != right, ">=": left >= right,
        "<=": left <= right, ">": left > right, "<": left < right,
    }[op]


def _field(records: DataFrame, name: str) -> Column:
    if name not in records.columns:
        return null("string")
    return plain_text(F.col(f"`{name}`"), records.schema[name].dataType)


def plain_text(value: Column, kind: DataType) -> Column:
    """A value as the checks print it: ``True``, ``10000000.0``, ``1e-05``; others as Spark does.

    The least double keeps the two digits Spark gives it.
    """
    if isinstance(kind, BooleanType):
        return F.when(value, "True").when(~value, "False")
    if not isinstance(kind, (DoubleType, FloatType)):
        return value
    text = spark_text(value, kind)
    power, digits = _power(text), _digits(text)
    return written(value, text, power, digits, F.char_length(digits))


def spark_text(value: Column, kind: DataType) -> Column:
    return (value if isinstance(kind, FloatType) else value.cast("double")).cast("string")


def _power(text: Column) -> Column:
    return F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")


def _digits(text: Column) -> Column:
    mantissa = F.split_part(text, F.lit("E"), F.lit(1))
    return F.regexp_replace(F.regexp_replace(mantissa, "[-.]", ""), "0+$", "")


def written(value: Column, text: Column, power: Column, digits: Column, count: Column) -> Column:
    """A number as the checks print it, from the parts of Spark's text."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    large = F.concat(
        F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."),
        F.when(count > power + 1, F.substring(digits, power + 2, count)).otherwise("0"),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(""),
        F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.char_length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")),
    )
    plain = F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)
    return (
        F.when(F.isnan(value), "nan").when(text.contains("Infinity"), F.concat(sign, F.lit("inf")))
        .when(power.isNull(), text).otherwise(F.concat(sign, plain))
    )


def printed(records: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Records with the named fields as the checks print them, and where each one is.

    A number's text and its parts are columns on the way: each is made once a row, however
    many rules read the field.
    """
    columns: dict[str, Column] = {}
    steps: list[dict[str, Column]] = [{}, {}, {}, {}]
    for i, name in enumerate(dict.fromkeys(names)):
        kind = records.schema[name].dataType if name in records.columns else None
        if not isinstance(kind, (BooleanType, DoubleType, FloatType)):
            columns[name] = _field(records, name)
            continue
        value, text, power, digits, count, out = F.col(f"`{name}`"), *(f"_{part}{i}" for part in ("text", "power", "digits", "count", "out"))
        columns[name] = F.col(out)
        if isinstance(kind, BooleanType):
            steps[3][out] = plain_text(value, kind)
            continue
        steps[0][text] = spark_text(value, kind)
        steps[1] |= {power: _power(F.col(text)), digits: _digits(F.col(text))}
        steps[2][count] = F.char_length(F.col(digits))
        steps[3][out] = written(value, F.col(text), F.col(power), F.col(digits), F.col(count))
    for step in steps:
        records = records.withColumns(step) if step else records
    return records, columns


def is_empty(value: Column) -> Column:
    text = value.cast("string")
    return text.isNull() | ~text.rlike(r"\S")


def satisfied(value: Column, op: str, expected: str) -> Column:
    """Row test: numbers for ordering operators, trimmed text otherwise.

    A missing value reads as the text ``None``; what is not a number fails an
    ordering test, and so does NaN.
    """
    text = F.coalesce(value.cast("string"), F.lit("None"))
    if op in ORDERING:
        bound = number(F.lit(expected))
        amount = number(F.replace(text, F.lit(","), F.lit("")))
        return F.coalesce(_compare(amount, op, bound) & ~F.isnan(amount) & ~F.isnan(bound), F.lit(False))
    return _compare(F.regexp_replace(text, r"^\s+|\s+$", ""), op, F.lit(expected))


def check_records(
    records: DataFrame,
    invariants: list[Invariant],
    required: list[str] = (),
    schema_fields: list[str] = (),
    min_rows: int = 0,
) -> DataFrame:
    """One row per rule: ``rule``, ``ok`` and the number of offending rows."""
    measures: dict[str, Column] = {"n": F.count("*")}
    results: list[Column] = []
    given = records.columns
    records, fields = printed(records, [*required, *[inv.field for inv in invariants if inv.field]])

    def measure(column: Column) -> Column:
        name = f"m{len(measures)}"
        measures[name] = column
        return F.col(name)

    def result(rule: str, ok: Column, bad: Column) -> None:
        results.append(
            F.struct(F.lit(rule).alias("rule"), ok.alias("ok"), bad.cast("bigint").alias("bad"))
        )

    n = F.col("n")
    if min_rows:
        result(f"min_rows:{min_rows}", n >= min_rows, F.greatest(F.lit(min_rows) - n, F.lit(0)))
    for name in schema_fields:
        present = name in given
        result(f"schema:{name}", F.lit(present), F.lit(0 if present else 1))
    for name in required:
        empties = measure(F.count_if(is_empty(fields[name])))
        result(f"required:{name}", empties == 0, empties)
    for inv in invariants:
        value = fields[inv.field] if inv.field else None
        if inv.kind == "count":
            ok = _compare(n, inv.op, F.lit(int(inv.value)))
            result(inv.name, ok, F.when(ok, 0).otherwise(1))
        elif inv.kind == "unique":
            filled = F.when(~is_empty(value), value.cast("string"))
            extra = measure(F.count(filled)) - measure(F.count_distinct(filled))
            result(inv.name, extra == 0, extra)
        elif inv.kind == "nonempty":
            empties = measure(F.count_if(is_empty(value)))
            result(inv.name, empties == 0, empties)
        else:
            test = satisfied(value, inv.op, inv.value)
            failing = measure(F.count_if(~test))
            if inv.kind == "any":
                result(inv.name, n > failing, F.when(n > failing, 0).otherwise(failing))
            else:
                result(inv.name, failing == 0, failing)
    totals = records.agg(*[c.alias(name) for name, c in measures.items()])
    return totals.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def duplicates(records: DataFrame, field: str) -> DataFrame:
    """Non-empty values that occur more than once, compared as text."""
    value = F.col(field).cast("string")
    return (
        records.where(~is_empty(value)).groupBy(value.alias("value"))
        .agg(F.count("*").alias("n")).where(F.col("n") > 1)
    )


def empty_counts(records: DataFrame, fields: list[str]) -> DataFrame:
    """Empty values of every field in one pass, one row per field."""
    totals = records.agg(*[F.count_if(is_empty(F.col(f))).alias(f) for f in fields])
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("empty")) for f in fields]
    return totals.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def observed_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Union of the keys of JSON object lines."""
    return lines.select(F.explode(F.json_object_keys(line)).alias("field")).distinct()


def missing_fields(lines: DataFrame, required: list[str], line: str = "line") -> DataFrame:
    names = [F.struct(F.lit(f).alias("field")) for f in required]
    wanted = lines.sparkSession.range(1).select(F.inline(F.array(*names)))
    return wanted.join(observed_fields(lines, line), "field", "left_anti")


def reject_count(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(F.col(line).rlike(r"\S")).agg(F.count("*").alias("rejects"))


def report_agreement(reports: DataFrame, records: DataFrame, rejects: DataFrame) -> DataFrame:
    """Findings of reports that miss a section or do not state the true totals."""
    rows = records.agg(F.count("*")).scalar().cast("string")
    bad = rejects.select("rejects").scalar().cast("string")
    text = F.lower("text")
    tests = [(s, text.contains(s)) for s in REPORT_SECTIONS]
    found = [F.when(~ok, F.concat(F.lit("missing section "), F.lit(name))) for name, ok in tests]
    found.append(F.when(~text.contains(rows), F.lit("row count not stated")))
    found.append(F.when(~text.contains(bad), F.lit("reject count not stated")))
    return reports.select("report_id", F.explode(F.array_compact(F.array(*found))).alias("finding"))



def log_findings(logs: DataFrame, text: str = "text") -> DataFrame:
    """Logs that are missing or empty, or that record no row counts: other columns and ``finding``."""
    low = F.lower(text)
    finding = F.when(F.coalesce(F.col(text), F.lit("")) == "", "missing or empty log").when(
        ~low.contains("row count") & ~low.contains("rows"), "no row counts"
    )
    return logs.withColumn("finding", finding).where("finding is not null").drop(text)

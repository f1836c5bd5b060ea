"""Record files under check: CSV, a JSON array, or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CORRUPT = "_corrupt_record"
JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def read_records(spark: SparkSession, path: str, form: str, schema: str | None = None) -> DataFrame:
    """Records of ``form`` ``csv`` (header, all text), ``json`` (array) or ``jsonl``.

    A quoted CSV field may hold line ends and doubled quotes, so a file is one split.
    JSON without a schema is read twice, once to infer the union of the keys.
    """
    if form == "csv":
        reader = spark.read.option("header", "true").option("inferSchema", "false")
        reader = reader.option("multiLine", "true").option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if form == "json":
        reader = reader.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def bad_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Non-blank lines that are not JSON objects, with what they are instead."""
    # The parser stops behind the first value; as a list, a line must have one member.
    members = F.size(F.from_json(F.concat(F.lit("["), F.col(line), F.lit("]")), "array<string>", JSON_OPTIONS))
    kind = F.when(members == 1, F.schema_of_variant(F.try_parse_json(line)))
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return lines.where(F.col(line).rlike(r"\S") & ~is_object).withColumn(
        "found", F.coalesce(kind, F.lit("not JSON"))
    )


def reject_counts(spark: SparkSession, path: str | None, require_file: bool = False) -> DataFrame:
    """One row: ``rejects``, the records of a reject file, and a ``finding`` if it must exist and does not.

    A CSV file counts records under its header, whatever lines they span; any other file
    counts lines that are not blank.  Without a file nothing was rejected.
    """
    none = spark.createDataFrame([(0, None)], "rejects long, finding string")
    if path is None:
        return none
    try:
        if path.lower().endswith(".csv"):
            rows = read_records(spark, path, "csv")
        else:
            rows = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            return none
        finding = f"missing rejects file: {path}" if require_file else None
        return spark.createDataFrame([(0, finding)], "rejects long, finding string")
    return rows.agg(F.count("*").alias("rejects")).withColumn("finding", F.lit(None).cast("string"))

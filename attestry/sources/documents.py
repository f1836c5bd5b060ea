"""Sources for run states, active runs, libraries, catalogs, notes and binaries.

Folders of one-document files become ``(path, modified, body)`` rows; the
parsing functions work on such rows, so the same code reads a folder, a table or
a stream of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attestry.operators import library, runs
from attestry.schemas import ACTIVE_RUN, RUN_STATE


def read_documents(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Text documents with path and modification time: whole files, or one document a line.

    A folder or file that is not there holds none.
    """
    try:
        texts = spark.read.text(path, wholetext=not one_per_line)
    except AnalysisException:
        return spark.createDataFrame([], "path string, modified timestamp, body string")
    return texts.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("body"),
    )


def read_run_states(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Run states below a folder with their files' times; malformed files give no row."""
    return runs.parse_run_states(read_documents(spark, path, one_per_line).drop("path"), RUN_STATE)


def read_active_runs(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame | None:
    """Active runs; None where there is no such file, so that nothing is taken for dead."""
    found = read_documents(spark, path, one_per_line)
    return None if found.isEmpty() else active_runs(found)


def read_library(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Library entries; garbage and a missing file read as an empty library."""
    return library.library_entries(read_documents(spark, path, one_per_line))


def read_notes(spark: SparkSession, default: str, override: str | None = None) -> DataFrame:
    """Notes as ``(doc_id, text)``, the file's path as id.

    An override takes the default's place even where it cannot be read: then there are
    no notes.
    """
    found = read_documents(spark, default if override is None else override)
    return found.select(F.col("path").alias("doc_id"), F.col("body").alias("text"))


def active_runs(documents: DataFrame, body: str = "body") -> DataFrame:
    """Rows of JSON objects keyed by run id; malformed documents are empty."""
    entries = F.from_json(body, f"map<string, {ACTIVE_RUN}>")
    return (
        documents.where(F.try_parse_json(body).isNotNull())
        .select(F.explode(entries).alias("run_id", "r"))
        .select("run_id", "r.*")
    )


def binary_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with size and time; contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")

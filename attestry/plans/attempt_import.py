"""The whole log import: parse, fold dialects, backfill, split, append."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attestry.operators import ingest
from attestry.session import cut_lineage
from attestry.sources import storage


def classified_rows(
    lines: DataFrame, run_tasks: DataFrame | None = None, mapping: DataFrame | None = None
) -> DataFrame:
    """Every non-blank line as an attempt row with its reject reason."""
    rows = ingest.coalesce_attempts(ingest.parse_lines(lines))
    if run_tasks is not None:
        rows = ingest.backfill_model(rows, run_tasks)
    if mapping is not None:
        rows = ingest.backfill_task_type(rows, mapping)
    return ingest.classify(rows)


def run_import(
    lines: DataFrame, path: str, run_tasks: DataFrame | None = None,
    mapping: DataFrame | None = None, dry_run: bool = False,
) -> DataFrame:
    """Append the valid rows to ``path`` and return the imported/skipped counts."""
    rows = classified_rows(lines, run_tasks, mapping)
    if not dry_run:
        rows = cut_lineage(rows)  # written and counted, parsed once
        storage.append_attempts(ingest.accepted(rows), path)
    return ingest.import_counts(rows)

"""Query registration: a Spark callable and, where SQL can say it, its check SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from attestry.fixtures import VIEWS, Dialect


ROWS_A_TASK = 100_000
ROWS_A_CORE = 2_000  # fewer are not worth a task of their own


@dataclass(frozen=True)
class Inputs:
    """Access to the driver tables and the views derived from them."""

    spark: SparkSession
    root: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _source(self, name: str) -> str:
        return f"parquet.`{self.root}/{name}.parquet`"

    def __call__(self, view: str) -> DataFrame:
        return self.spark.sql(VIEWS[view](Dialect(self._source)))

    def dealt_table(self, name: str) -> DataFrame:
        """A table of narrow rows dealt evenly to tasks, however few row groups its files have.

        For rows that cost far more to judge than to move; their number is read from the
        files' footers.
        """
        rows = self.table(name)
        n = rows.count()
        cores = self.spark.sparkContext.defaultParallelism
        return rows.repartition(max(1, n // ROWS_A_TASK, min(n // ROWS_A_CORE, cores)))

    def dealt(self, view: str) -> DataFrame:
        """A view over tables that are dealt out like that."""
        names: list[str] = []

        def source(table: str) -> str:
            names.append(f"dealt_{table}_{uuid.uuid4().hex}")
            self.dealt_table(table).createTempView(names[-1])
            return names[-1]

        rows = self.spark.sql(VIEWS[view](Dialect(source)))
        for name in names:
            self.spark.catalog.dropTempView(name)
        return rows


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(inputs) -> DataFrame``; ``views`` become CTEs of the check SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, root: fn(Inputs(spark, root.rstrip("/")))
        if oracle is not None:
            ORACLES[key] = with_views(oracle, views)
        return fn

    return register


def with_views(body: str, views: tuple[str, ...]) -> str:
    d = Dialect()
    ctes = [f"{name} as ({VIEWS[name](d)})" for name in views]
    text = body.strip()
    if text.lower().startswith("with "):
        # The body brings its own CTEs; put the views in front of them.
        text = text[5:].lstrip()
        recursive = text.lower().startswith("recursive ")
        if recursive:
            text = text[len("recursive "):]
        head = "with recursive " if recursive else "with "
        return head + ",\n".join([*ctes, text])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + text

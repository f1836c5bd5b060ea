"""Catalog refresh: normalise a payload, diff it with the snapshot before it, store both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import catalog
from attestry.sources import storage


def refresh(models: DataFrame, root: str, fetched_at: str, position: Column | None = None) -> DataFrame:
    """Store the change events of ``models`` and its snapshot; returns the events.

    Events are kept by payload: a payload's events are what changed since the newest
    snapshot before it, however often and in whatever order payloads are refreshed.  A
    payload that arrives after a later one also renews the later one's events.  Events
    are written before the snapshot is listed, so a crash in between only repeats them.
    """
    spark = models.sparkSession
    new = catalog.snapshot_rows(models.drop("fetched_at"), position).select(
        *[c for c in catalog.SNAPSHOT if c in models.columns]
    )
    before = storage.time_beside(spark, root, fetched_at)
    _store(storage.read_snapshot(spark, root, before), new, root, fetched_at)
    storage.write_snapshot(new, root, fetched_at)
    after = storage.time_beside(spark, root, fetched_at, after=True)
    if after is not None:
        later = storage.read_snapshot(spark, root, after).drop("fetched_at")
        _store(storage.read_snapshot(spark, root, fetched_at), later, root, after)
    return storage.read_events(spark, root, fetched_at)


def _store(old: DataFrame | None, new: DataFrame, root: str, fetched_at: str) -> None:
    before = new.limit(0) if old is None else old.drop("fetched_at")
    storage.append_events(catalog.diff(before, new, F.lit(fetched_at)), root, fetched_at)

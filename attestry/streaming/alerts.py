"""Once-only alerts and liveness from keyed state.

A key's rows of one batch are folded chunk by chunk into numbers; beyond the names kept as
state, texts are never gathered.  Alerted sessions and finished runs are forgotten after a
stated time; a session's edit count and a run's last outcome stay, a few values each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attestry.operators.sessions import BURST_EDITS, BURST_FILES, needs_routing
from attestry.streaming import runtime

LIBRARY_SECONDS = 5
KEEP_SECONDS = 30 * 24 * 3600  # of alerted sessions and finished runs
BUCKETS = 1_024  # of sessions or runs whose state is read and written together
BEFORE, AFTER = np.iinfo("int64").min, np.iinfo("int64").max


def bucket(name: str, buckets: int) -> Column:
    """A row's bucket by name; their number must not change while a checkpoint is in use."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int").alias("bucket")


def keep_first(known: dict[str, int], path: str | None, seq: int, files: int) -> None:
    """Keep the ``files`` files seen earliest, each with its first place; blank paths are none."""
    if path in known:
        known[path] = min(seq, known[path])
    elif path and path.strip():
        if len(known) == files:
            latest = max(known, key=known.get)
            if seq >= known[latest]:
                return
            del known[latest]
        known[path] = seq


class EditBurst(StatefulProcessor):
    """Fires once per session, at the first edit past both thresholds with nothing live.

    A key is a bucket of sessions: calls and reads of state cost far more than the rows of
    one session, so they are made once a bucket.  State per session is small: the count, up
    to the needed number of file names, and whether it fired.  Of a batch a task holds
    thirteen bytes per edit of the bucket, and each session's earliest files.
    """

    def __init__(self, edits: int, files: int):
        self.edits, self.files = edits, files

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "bursts", "sessions array<string>, edits array<bigint>, files array<array<string>>, fired array<boolean>"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, edits, files, fired = (list(part) for part in self.state.get()) if self.state.exists() else ([], [], [], [])
        at = {name: n for n, name in enumerate(names)}
        # Known files come before any of the batch.
        firsts = [dict.fromkeys(paths, BEFORE) for paths in files]
        parts = []
        for chunk in rows:
            session = [at.setdefault(name, len(at)) for name in chunk["session_id"]]
            firsts += [{} for _ in range(len(at) - len(firsts))]
            seq = chunk["seq"].to_numpy("int64")
            parts.append((np.array(session, "int32"), seq, chunk["live"].to_numpy("bool")))
            for n, path, place in zip(session, chunk["file_path"], seq.tolist()):
                keep_first(firsts[n], path, place, self.files)
        new = len(at) - len(names)
        before, quiet = np.array(edits + [0] * new, "int64"), ~np.array(fired + [False] * new, "bool")

        session, seqs, live = (np.concatenate(part) for part in zip(*parts))
        order = np.lexsort((seqs, session))
        session, seqs, live = session[order], seqs[order], live[order]
        counts = np.bincount(session, minlength=len(at))
        place = np.arange(1, len(session) + 1) - (np.cumsum(counts) - counts)[session] + before[session]
        start = np.array([max(known.values()) if len(known) == self.files else AFTER for known in firsts], "int64")
        ready = quiet[session] & (place >= self.edits) & ~live & (start[session] < AFTER) & (seqs >= start[session])
        hits = np.flatnonzero(ready)
        if len(hits):
            alerted, first = np.unique(session[hits], return_index=True)
            quiet[alerted] = False
            found, first = list(at), hits[first]
            yield pd.DataFrame(
                {"session_id": pd.Series([found[n] for n in alerted], dtype="object"), "seq": seqs[first], "edits": place[first]}
            )
        # A session that has fired is not asked for its files again.
        kept = [sorted(known) if waits else [] for known, waits in zip(firsts, quiet)]
        self.state.update((list(at), (before + counts).tolist(), kept, (~quiet).tolist()))

    def close(self) -> None:
        pass


def edit_bursts(edits: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streaming frame of burst alerts from (session_id, seq, file_path, live) edits."""
    runtime.use_rocksdb(edits.sparkSession)
    rows = edits.select(bucket("session_id", buckets), "session_id", "seq", "file_path", "live")
    return rows.groupBy("bucket").transformWithStateInPandas(
        EditBurst(BURST_EDITS, BURST_FILES), "session_id string, seq bigint, edits bigint",
        "Append", "None",
    )


def command_alerts(commands: DataFrame, tool: str, keep_seconds: int = KEEP_SECONDS) -> DataFrame:
    """Sessions with a command to route; suppressed ones do not use up the once.

    A session is remembered for ``keep_seconds`` after its alert.  The time is that of
    the batch, so no command is ever too late to count.
    """
    hits = commands.where(needs_routing(F.col("command"), tool) & ~F.col("live"))
    stamped = hits.select("session_id", F.current_timestamp().alias("met_at"))
    return (
        stamped.withWatermark("met_at", f"{keep_seconds} seconds")
        .dropDuplicatesWithinWatermark(["session_id"]).select("session_id")
    )


class OutcomeThrottle(StatefulProcessor):
    """Lets an outcome through when it changes or the last one is old enough.

    A key is a bucket of runs, as for sessions.  Of a batch a task holds the times, numbers
    and outcome codes of the bucket's rows.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("lasts", "runs array<string>, outcomes array<string>, times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, last, at = (list(part) for part in self.state.get()) if self.state.exists() else ([], [], [])
        places = {name: n for n, name in enumerate(names)}
        codes: dict[str, int] = {}
        parts = []
        for chunk in rows:
            run = np.array([places.setdefault(name, len(places)) for name in chunk["run_id"]], "int32")
            code = np.array([codes.setdefault(outcome, len(codes)) for outcome in chunk["outcome"]], "int32")
            parts.append((run, chunk["at"].to_numpy("float64"), chunk["seq"].to_numpy("int64"), code))
        new = len(places) - len(names)
        names, last, at = list(places), last + [None] * new, at + [0.0] * new
        runs, times, seqs, outcomes = (np.concatenate(p) for p in zip(*parts))
        shown = list(codes)
        kept = []
        for n in np.lexsort((seqs, times, runs)):
            run, outcome, time = runs[n], shown[outcomes[n]], float(times[n])
            if outcome != last[run] or time - at[run] >= self.seconds:
                last[run], at[run] = outcome, time
                kept.append((names[run], int(seqs[n]), outcome))
        self.state.update((names, last, at))
        if kept:
            yield pd.DataFrame(kept, columns=["run_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def library_updates(snapshots: DataFrame, seconds: int = LIBRARY_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """Streaming frame of library writes from (run_id, seq, at seconds, outcome)."""
    runtime.use_rocksdb(snapshots.sparkSession)
    rows = snapshots.select(bucket("run_id", buckets), "run_id", "seq", "at", "outcome")
    return rows.groupBy("bucket").transformWithStateInPandas(
        OutcomeThrottle(seconds), "run_id string, seq bigint, outcome string", "Append", "None"
    )


class Heartbeat(StatefulProcessor):
    """A run that is not done and stays silent past the timeout is reported dead.

    Each heartbeat moves the run's single event-time timer.  A finished run is remembered
    for ``keep_ms`` of event time after its last heartbeat, then its state goes unreported.
    """

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, max(keep_ms, timeout_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "seen_ms bigint, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, done = self.state.get() if self.state.exists() else (-1, False)
        if seen >= 0:
            self.handle.deleteTimer(seen + self._wait(done))
        for chunk in rows:
            seen = max(seen, int(chunk["at_ms"].max()))
            done = bool(done or chunk["done"].any())
        self.state.update((seen, done))
        self.handle.registerTimer(seen + self._wait(done))
        yield pd.DataFrame({"run_id": [], "last_seen_ms": []}).astype(
            {"run_id": "object", "last_seen_ms": "int64"}
        )

    def _wait(self, done: bool) -> int:
        return self.keep_ms if done else self.timeout_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, done = self.state.get()
        self.state.clear()
        dead = [] if done else [(key[0], seen)]
        yield pd.DataFrame(dead, columns=["run_id", "last_seen_ms"]).astype({"run_id": "object", "last_seen_ms": "int64"})

    def close(self) -> None:
        pass


def dead_runs(
    heartbeats: DataFrame, timeout_ms: int, lateness: str = "0 seconds", keep_ms: int = KEEP_SECONDS * 1000
) -> DataFrame:
    """Streaming frame of dead runs from (run_id, at timestamp, at_ms, done) heartbeats."""
    runtime.use_rocksdb(heartbeats.sparkSession)
    return (
        heartbeats.withWatermark("at", lateness)
        .groupBy("run_id")
        .transformWithStateInPandas(
            Heartbeat(timeout_ms, keep_ms), "run_id string, last_seen_ms bigint", "Append", "EventTime"
        )
    )


def stream_rows(rows: DataFrame, root: str, name: str, **options) -> StreamingQuery:
    """Append the rows of a streaming frame, one replay-safe folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        runtime.write_batch(batch, root, batch_id)

    writer = rows.writeStream.outputMode("append").foreachBatch(write)
    return runtime.start(writer, rows.sparkSession, name, **options)


# State processors travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

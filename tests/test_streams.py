"""Streams replayed in small batches equal their batch twins, also out of order."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import logs, runs, scoreboard, sessions
from attestry.streaming import alerts, board_state, imports, runtime, tasks


def files_stream(spark, frames, path):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


CHUNK = "run_id string, task_key string, seq bigint, chunk string"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 2, 0)])
def test_tail_in_any_arrival_order(spark, tmp_path, order):
    rows = [("r", "t", i, f"{i}:" + "x" * (i % 4)) for i in range(30)]
    slices = [rows[:10], rows[10:20], rows[20:]]
    frames = [spark.createDataFrame(slices[i], CHUNK) for i in order]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    runtime.finish(tasks.stream_output_tail(stream, str(tmp_path / "out"), cap=25, block=4, checkpoint=str(tmp_path / "cp")))
    got = tasks.current_tails(spark, str(tmp_path / "out"), 20, cap=25, block=4).first().tail
    assert got == logs.output_tails(spark.createDataFrame(rows, CHUNK), 20, 25, 4).first().tail


def test_task_state_in_any_arrival_order(spark, tmp_path):
    schema = "seq bigint, run_id string, task_key string, op string, status string, attempt int, ts string"
    rows = [
        (1, "r", "t", "set_status", "running", 1, "a"), (2, "r", "t", "set_result", "failed", 1, "b"),
        (3, "r", "t", "set_status", "running", 2, "c"), (4, "r", "u", "set_status", "running", 1, "d"),
    ]
    frames = [spark.createDataFrame(rows[2:], schema), spark.createDataFrame(rows[:2], schema)]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    runtime.finish(tasks.stream_task_state(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")))
    got = {r.task_key: r.asDict() for r in tasks.current_task_state(spark, str(tmp_path / "out")).collect()}
    want = {r.task_key: r.asDict() for r in runs.task_state(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    assert (got["t"]["status"], got["t"]["attempt"], got["t"]["started_at"], got["t"]["ended_at"]) == ("running", 2, "a", "b")


STATUS = "seq bigint, run_id string, task_key string, op string, status string, attempt int, ts string"


@pytest.mark.parametrize("every", [2, 3])
def test_merged_batches_equal_the_whole(spark, tmp_path, every):
    """Bases replace batches; tails and states stay those of the whole log."""
    rows = [("r", f"t{i % 3}", i, f"{i}:" + "x" * (i % 5)) for i in range(70)]
    frames = [spark.createDataFrame(rows[i : i + 10], CHUNK) for i in (30, 0, 60, 10, 50, 20, 40)]
    root = str(tmp_path / "tails")
    runtime.finish(tasks.stream_output_tail(
        files_stream(spark, frames, str(tmp_path / "in")), root, cap=25, block=4, every=every, checkpoint=str(tmp_path / "cp")
    ))
    whole = logs.output_tails(spark.createDataFrame(rows, CHUNK), 20, 25, 4)
    got = tasks.current_tails(spark, root, 20, cap=25, block=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    upto = runtime.compacted_upto(spark, root)
    assert upto == 7 // every * every - 2 and len(list((tmp_path / "tails").glob("base/upto=*"))) <= 2
    left = sorted(int(p.name[6:]) for p in (tmp_path / "tails").glob("batch=*"))
    assert left[-1] == 6 and left[0] >= upto - every + 1
    base = spark.read.parquet(f"{root}/base/upto={upto}")
    assert base.groupBy("task_key").agg(F.sum(F.octet_length("chunk")).alias("n")).agg(F.max("n")).first()[0] <= 25
    commands = [(i, "r", f"t{i % 4}", "set_result" if i % 3 else "set_status", f"s{i}", i, f"at{i}") for i in range(35)]
    frames = [spark.createDataFrame(commands[i : i + 5], STATUS) for i in (30, 0, 25, 10, 20, 15, 5)]
    root = str(tmp_path / "state")
    runtime.finish(tasks.stream_task_state(
        files_stream(spark, frames, str(tmp_path / "in2")), root, every=every, checkpoint=str(tmp_path / "cp2")
    ))
    want = runs.task_state(spark.createDataFrame(commands, STATUS))
    assert sorted(map(tuple, tasks.current_task_state(spark, root).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_idle_tasks_go_at_a_merge(spark, tmp_path):
    frames = [spark.createDataFrame([("r", f"t{i}", i, "x")], CHUNK) for i in range(4)]
    root = str(tmp_path / "out")
    runtime.finish(tasks.stream_output_tail(
        files_stream(spark, frames, str(tmp_path / "in")), root, every=2, keep_seconds=0, checkpoint=str(tmp_path / "cp")
    ))
    assert spark.read.parquet(f"{root}/base/upto=2").count() == 0
    assert [r.task_key for r in tasks.current_tails(spark, root, 20).collect()] == ["t3"]


def test_replayed_batch_leaves_its_base(spark, tmp_path):
    root = str(tmp_path)
    for n in range(3):
        runtime.write_batch(spark.range(n + 1), root, n)
    for merge in (lambda rows: rows, lambda rows: rows.limit(0)):
        runtime.compact(spark, root, 2, merge)
        assert runtime.read_compacted(spark, root).count() == 6


def test_suppressed_burst_does_not_use_up_the_once(spark, tmp_path):
    schema = "seq bigint, session_id string, file_path string, live boolean"
    rows = [(i, "s", f"f{i % 3}", i < 12) for i in range(15)] + [(i, "two", f"f{i % 2}", False) for i in range(20)]
    rows += [(i, "few", f"f{i}", False) for i in range(7)] + [(i, "blank", " ", False) for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    frames = [df.where("seq < 6"), df.where("seq between 6 and 10"), df.where("seq > 10")]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    query = alerts.stream_rows(alerts.edit_bursts(stream), str(tmp_path / "out"), "burst", checkpoint=str(tmp_path / "cp"))
    runtime.finish(query)
    got = [(r.session_id, r.seq) for r in runtime.read_batches(spark, str(tmp_path / "out")).collect()]
    assert got == [("s", 12)]
    assert [(r.session_id, r.seq) for r in sessions.burst_alerts(df).collect()] == got


def test_bursts_of_a_bucket_are_told_apart(spark, tmp_path):
    """State is kept by bucket, and each session fires where a plain walk over its edits says."""
    paths = ["a", "b", "c", "d", " ", "\u00a0", "", None]
    draw = random.Random(5)
    sessions_of = [None, *(f"s{n}" for n in range(40))]
    rows = [(i, draw.choice(sessions_of), draw.choice(paths), draw.choice([True, True, False, None])) for i in range(1_200)]
    late = [(i % 2 * 1_200 + (i if i % 2 else -i), "late", f"f{i % 5}", i % 4 == 0) for i in range(40)]
    frames = [[r for r in rows if r[0] < 300], [r for r in rows if 300 <= r[0] < 500] + late[:20], [r for r in rows if r[0] >= 500] + late[20:]]
    wanted, edits, files = {}, {}, {}
    for frame in frames:
        for seq, session, path, live in sorted(frame, key=lambda r: r[0]):
            edits[session] = edits.get(session, 0) + 1
            files.setdefault(session, set()).update({path} if path and path.strip() else set())
            if edits[session] >= 8 and len(files[session]) >= 3 and not live:
                wanted.setdefault(session, (seq, edits[session]))
    df = [spark.createDataFrame(f, "seq bigint, session_id string, file_path string, live boolean") for f in frames]
    stream = files_stream(spark, df, str(tmp_path / "in"))
    query = alerts.stream_rows(alerts.edit_bursts(stream, buckets=4), str(tmp_path / "out"), "burst", checkpoint=str(tmp_path / "cp"))
    runtime.finish(query)
    got = [(r.session_id, (r.seq, r.edits)) for r in runtime.read_batches(spark, str(tmp_path / "out")).collect()]
    assert len(got) == len(wanted) > 20 and dict(got) == wanted
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4


def test_outcomes_of_a_bucket_are_throttled_run_by_run(spark, tmp_path):
    draw = random.Random(6)
    rows = [
        (draw.choice([None, *(f"r{n}" for n in range(30))]), i, float(i // 4 * 3), draw.choice(["live", "live", "pass", None]))
        for i in range(900)
    ]
    frames = [rows[:200], rows[500:], rows[200:500]]
    wanted, last = [], {}
    for frame in frames:
        for run, seq, at, outcome in sorted(frame, key=lambda r: (r[2], r[1])):
            shown, then = last.get(run, (None, 0.0))
            if outcome != shown or at - then >= 60:
                last[run] = outcome, at
                wanted.append((run, seq, outcome))
    df = [spark.createDataFrame(f, "run_id string, seq bigint, at double, outcome string") for f in frames]
    stream = files_stream(spark, df, str(tmp_path / "in"))
    rows = alerts.library_updates(stream, seconds=60, buckets=4)
    query = alerts.stream_rows(rows, str(tmp_path / "out"), "library", checkpoint=str(tmp_path / "cp"))
    runtime.finish(query)
    got = [(r.run_id, r.seq, r.outcome) for r in runtime.read_batches(spark, str(tmp_path / "out")).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators) <= 4


def test_replayed_batch_overwrites(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        runtime.write_batch(spark.range(3), root, 7)
    assert runtime.read_batches(spark, root).count() == 3


MODEL = (
    "id string, name string, context_length int, modality string, prompt_per_m double, completion_per_m double, "
    "variable_pricing boolean, pricing_unknown boolean, free boolean, fetched_at string, position long, total long"
)


def payload(fetched_at, prices):
    return [
        (f"m{i}", f"M{i}", 8, "text", p, p, False, False, p == 0, fetched_at, i, len(prices)) for i, p in enumerate(prices)
    ]


FIRST, SECOND, THIRD = payload("2026-01-01T00:00:00Z", [1.0] * 4), payload("2026-01-02T00:00:00Z", [1.0, 2.0, 0.0]), payload("2026-01-03T00:00:00Z", [5.0] * 3)
EVENTS = sorted(
    [("2026-01-01T00:00:00Z", "added", f"m{i}") for i in range(4)]
    + [("2026-01-02T00:00:00Z", k, m) for k, m in (("removed", "m3"), ("price_change", "m1"), ("price_change", "m2"), ("went_free", "m2"))]
    + [("2026-01-03T00:00:00Z", k, m) for k, m in (("price_change", "m0"), ("price_change", "m1"), ("price_change", "m2"), ("went_paid", "m2"))]
)


@pytest.mark.parametrize(
    "files",
    [
        [FIRST[:2], FIRST[2:], SECOND, THIRD],  # one payload in two files
        [FIRST + SECOND, THIRD],  # two payloads in one file
        [FIRST[:1], FIRST[1:] + SECOND[:2], SECOND[:2], SECOND[2:] + THIRD, THIRD, FIRST],  # parts come again
        [THIRD, SECOND[1:], FIRST, SECOND[:1]],  # later ones first
    ],
)
def test_catalog_payloads_arrive_in_parts(spark, tmp_path, files):
    frames = [spark.createDataFrame(rows, MODEL) for rows in files]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    runtime.finish(imports.stream_catalog(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")))
    got = imports.catalog_events(spark, str(tmp_path / "out")).select("ts", "kind", "model_id").collect()
    assert sorted(tuple(r) for r in got) == EVENTS


def test_incomplete_payload_gives_no_events(spark, tmp_path):
    frames = [spark.createDataFrame(FIRST, MODEL), spark.createDataFrame(SECOND[:2], MODEL)]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    runtime.finish(imports.stream_catalog(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "cp")))
    assert {r.ts for r in imports.catalog_events(spark, str(tmp_path / "out")).collect()} == {"2026-01-01T00:00:00Z"}


ATTEMPT = "id long, run_id string, task_key string, model string, engine string, task_type string, verdict string, tokens long, duration_s double, created_at string"


def attempt(i, run, model, verdict="PASS", tokens=10, duration=1.0):
    return (i, run, "t", model, "e" + str(i % 2), "x", verdict, tokens, duration, f"2026-01-01T00:00:{i:02}Z")


ATTEMPTS = [
    [attempt(1, "a", "m1", "FAIL", 5, 2.0), attempt(2, "b", "m1", tokens=-1), attempt(3, "c", "m2", duration=None)],
    [attempt(4, "a", "m2", tokens=7, duration=4.0), attempt(5, "d", "m3"), attempt(6, "b", "m1", "FAIL", 9, 8.0)],
    [attempt(9, "d", "m1", tokens=1, duration=3.0), attempt(7, "e", " ", tokens=2), attempt(8, "e", "m2", "fail", 3, 6.0)],
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_scoreboard_state_equals_the_batch(spark, tmp_path, order):
    """Instances move between models, and a model loses its last one."""
    frames = [spark.createDataFrame(ATTEMPTS[i], ATTEMPT) for i in order]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    root = str(tmp_path / "out")
    runtime.finish(imports.stream_scoreboard(stream, root, buckets=3, checkpoint=str(tmp_path / "cp")))
    want = scoreboard.scoreboard_models(spark.createDataFrame(sum(ATTEMPTS, []), ATTEMPT))
    got = imports.current_scoreboard(spark, root).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_scoreboard_trigger_reads_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path)
    many = [attempt(i % 60, f"run{i}", f"m{i}") for i in range(60)]
    board_state.take_in(spark.createDataFrame(many, ATTEMPT), 0, root, 32)
    small = spark.createDataFrame([attempt(59, "new", "m7", tokens=99)], ATTEMPT)
    for _ in range(2):  # a replay changes nothing
        models, counted = board_state.take_in(small, 1, root, 32)
        assert [r.model for r in models.collect()] == ["m7"]
        board = board_state.rollup(counted).collect()
        assert [(r.model, r.tasks, r.median_tokens) for r in board] == [("m7", 2, 54.5)]
    state = board_state.BoardState(spark, root, 32)
    wanted = [r.bucket for r in small.select(state.bucket("model")).collect()]
    assert len(state.versions("models", wanted, 2)) == 1 and "batch=1" in state.versions("models", wanted, 2)[0]
    written = spark.read.schema(board_state.SCHEMAS["models"]).parquet(f"{root}/models/batch=1")
    assert {r.bucket for r in written.select("bucket").distinct().collect()} == set(wanted)
    assert len(state.versions("models", list(range(32)), 1)) > 10


def kept_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_finished_runs_leave_the_state_unreported(spark, tmp_path):
    beat = "run_id string, at_ms bigint, done boolean"
    beats = [[("a", 1_000, False), ("b", 1_000, True), ("b", 500, False), ("c", 9_000, False)], [("c", 30_000, False)], [("c", 31_000, False)]]
    frames = [spark.createDataFrame(b, beat).withColumn("at", F.timestamp_millis("at_ms")) for b in beats]
    stream = files_stream(spark, frames, str(tmp_path / "in"))
    query = alerts.stream_rows(alerts.dead_runs(stream, 2_000, keep_ms=5_000), str(tmp_path / "out"), "dead", checkpoint=str(tmp_path / "cp"))
    runtime.finish(query)
    dead = {tuple(r) for r in runtime.read_batches(spark, str(tmp_path / "out")).select("run_id", "last_seen_ms").collect()}
    assert dead == {("a", 1_000)}
    counts = kept_rows(query)
    assert counts[-1] < max(counts)

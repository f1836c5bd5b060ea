"""Import semantics on literal rows."""

import json

import pytest

from attestry.operators import ingest
from attestry.plans import attempt_import
from attestry.sources import documents, storage


def rows(spark, *objects):
    lines = [(i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    df = spark.createDataFrame(lines, "line_no bigint, line string")
    return [r for r in ingest.coalesce_attempts(ingest.parse_lines(df)).orderBy("id").collect()]


@pytest.mark.parametrize(
    "row,expected",
    [
        ({"retry": True}, 1), ({"retry": False, "notes": "retry=true"}, 0), ({"retry": "TRUE "}, 1), ({"retry": "False"}, 0),
        ({"retry": 2}, 2), ({"retry": 0}, 0), ({"retry": -3}, 0), ({"retry": "2"}, 2), ({"retry": 1.9}, 1),
        ({"retry": "maybe", "notes": "x retry=true"}, 1), ({"retry": None, "notes": "retry=true"}, 1), ({"notes": "none"}, 0), ({}, 0),
        ({"retry": [1]}, 0),
    ],
)
def test_retry(spark, row, expected):
    assert rows(spark, row)[0].retry == expected


@pytest.mark.parametrize(
    "row,duration,tokens",
    [
        ({"duration_s": 1.5, "duration_ms": 9}, 1.5, -1), ({"duration_ms": 2500}, 2.5, -1), ({"duration_s": "x", "duration_ms": "10"}, 0.01, -1),
        ({"tokens": 12.9}, 0.0, 12), ({"tokens": None, "worker_tokens": "7"}, 0.0, 7), ({"tokens": True}, 0.0, -1), ({"tokens": "1d"}, 0.0, -1),
    ],
)
def test_numbers(spark, row, duration, tokens):
    got = rows(spark, row)[0]
    assert (got.duration_s, got.tokens) == (duration, tokens)


def test_five_lines_one_good(spark, tmp_path):
    lines = [
        '{"run_id":"r","task_key":"t","worker_engine":"codex","verdict":"pass","notes":"n","orchestrator":"me","logged_at":"2026-01-01T00:00:00Z"}',
        "not json", '{"run_id":"","task_key":"t","verdict":"PASS"}', '{"run_id":"r","verdict":"PASS"}', '{"run_id":"r","task_key":"t"}', "", "   ",
    ]
    source = tmp_path / "log.jsonl"
    source.write_text("\n".join(lines))
    df = documents.read_lines(spark, str(source)).selectExpr("monotonically_increasing_id() as line_no", "line")
    out = str(tmp_path / "attempts")
    counts = attempt_import.run_import(df, out, dry_run=True).first()
    assert (counts.imported, counts.skipped) == (1, 4) and not (tmp_path / "attempts").exists()
    attempt_import.run_import(df, out)
    row = storage.read_attempts(spark, out).first()
    assert (row.engine, row.verdict, row.check_output, row.identity, row.created_at) == ("codex", "PASS", "n", "me", "2026-01-01T00:00:00Z")


def test_not_objects_are_rejected(spark):
    got = rows(spark, "[1]", '"text"', "null", "{'a':1}", '{"a":1} x', "{}")
    assert [r.parsed for r in got] == [False, False, False, False, False, True]


def test_task_type_tiers(spark):
    mapping = spark.createDataFrame(
        [("run:t", "pair"), ("run", "whole"), ("name:ab", "short"), ("name:abcdef", ""), ("name:", "never"), ("blank:t", ""), ("blank", "fallback")],
        "k string, v string",
    )
    df = spark.createDataFrame(
        [(1, "run", "t", ""), (2, "run", "u", ""), (3, "abc", "t", ""), (4, "abcdefg", "t", ""), (5, "zzz", "t", ""), (6, "", "t", ""), (7, "blank", "t", ""), (8, "run", "t", "own")],
        "id bigint, run_id string, task_key string, task_type string",
    )
    got = {r.id: r.task_type for r in ingest.backfill_task_type(df, mapping).collect()}
    # The longest prefix wins even with a blank value, which voids the tier.
    assert got == {1: "pair", 2: "whole", 3: "short", 4: "", 5: "", 6: "", 7: "fallback", 8: "own"}


def test_model_backfill_takes_the_first_task(spark):
    tasks = spark.createDataFrame([("r", "t", 1, "second"), ("r", "t", 0, "first"), ("r", "b", 0, "")], "run_id string, task_key string, pos int, model string")
    df = spark.createDataFrame([(1, "r", "t", ""), (2, "r", "b", ""), (3, "r", "t", "own"), (4, "x", "t", "")], "id bigint, run_id string, task_key string, model string")
    got = {r.id: r.model for r in ingest.backfill_model(df, tasks).collect()}
    assert got == {1: "first", 2: "", 3: "own", 4: ""}


def test_export_import_round_trip(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.createDataFrame([(1, "r", "t", None, 3)], "id bigint, run_id string, task_key string, model string, tokens bigint")
    storage.export_jsonl(df, path)
    line = documents.read_lines(spark, path).first().line
    assert json.loads(line) == {"id": 1, "run_id": "r", "task_key": "t", "model": None, "tokens": 3}


def test_a_key_listed_twice_adds_no_rows(spark):
    df = spark.createDataFrame([(1, "r", "t", "")], "id long, run_id string, task_key string, task_type string")
    mapping = spark.createDataFrame([("r:t", "a"), ("r:t", "b"), ("r", "c")], "k string, v string")
    assert [r.task_type for r in ingest.backfill_task_type(df, mapping).collect()] == ["b"]


def test_one_object_a_line(spark):
    one, nested = '{"run_id":"a","task_key":"t"}', '{"run_id":"a","extra":[{"x":1},{"y":2}]}'
    lines = [one + one, one + " , " + one, one + " {}", nested, "  " + one + "  ", '{"run_id":"}{"}', one + "]"]
    parsed = ingest.parse_lines(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")).orderBy("line_no").collect()
    assert [r._j is not None for r in parsed] == [False, False, False, True, True, True, False]

"""Catalog, identity and exploration semantics on literal rows."""

import json

import pytest
from pyspark.sql import functions as F

from attestry.functions import display
from attestry.operators import catalog, identity
from attestry.plans import catalog_refresh
from attestry.sources import documents, storage

MODEL = (
    "id string, name string, context_length int, modality string, prompt_per_m double, "
    "completion_per_m double, variable_pricing boolean, pricing_unknown boolean, free boolean"
)


def model(id, p, c, free=False, variable=False, context=64000, modality="text->text"):
    return (id, id, context, modality, p, c, variable, False, free)


def normalise(spark, *raw):
    df = spark.createDataFrame([(json.dumps(r),) for r in raw], "raw string")
    return {r.id: r for r in catalog.normalise(df).collect()}


def test_normalise_cases(spark):
    got = normalise(
        spark,
        {"id": "paid", "pricing": {"prompt": "0.0000005", "completion": "0.0000015"}, "context_length": 12.9},
        {"id": "x/y:free", "pricing": {"prompt": "0", "completion": "0"}, "context_length": " 7 "},
        {"id": "unknown", "name": " Named "},
        {"id": "negative", "pricing": {"prompt": "-1", "completion": "0.0000001"}, "context_length": "7.5"},
        {"id": "suffix", "pricing": {"prompt": "1d", "completion": 0}},
        {"id": " "},
    )
    assert set(got) == {"paid", "x/y:free", "unknown", "negative", "suffix"}
    paid = got["paid"]
    assert (round(paid.prompt_per_m, 9), round(paid.completion_per_m, 9), paid.free) == (0.5, 1.5, False)
    assert paid.context_length == 12 and paid.name == "paid"
    free = got["x/y:free"]
    assert (free.prompt_per_m, free.free, free.context_length) == (0.0, True, 7)
    unknown = got["unknown"]
    assert unknown.variable_pricing and unknown.pricing_unknown and unknown.prompt_per_m is None
    assert unknown.name == "Named"
    negative = got["negative"]
    assert negative.variable_pricing and not negative.pricing_unknown and negative.context_length == 0
    assert got["suffix"].pricing_unknown


def test_diff_cases(spark):
    old = spark.createDataFrame(
        [model("keep", 1.0, 2.0), model("goes", 1.0, 1.0), model("reprice", 1.0, 1.0), model("tofree", 1.0, 1.0)], MODEL
    )
    new = spark.createDataFrame(
        [model("keep", 1.0, 2.0), model("reprice", 3.0, 1.0), model("tofree", 0.0, 0.0, True), model("brand", 5.0, 5.0)], MODEL
    )
    events = catalog.ordered_events(catalog.diff(old, new, F.lit("t"))).collect()
    assert [(e.kind, e.model_id) for e in events] == [
        ("added", "brand"), ("removed", "goes"), ("price_change", "reprice"),
        ("price_change", "tofree"), ("went_free", "tofree"),
    ]
    reprice = events[2].payload
    assert (reprice.old_prompt_per_m, reprice.new_prompt_per_m) == (1.0, 3.0)
    assert catalog.diff(old, old, F.lit("t")).count() == 0


def test_variable_pricing_suppresses_the_rest(spark):
    old = spark.createDataFrame([model("a", 1.0, 1.0), model("b", None, None, variable=True)], MODEL)
    new = spark.createDataFrame([model("a", None, None, True, True), model("b", 0.0, 0.0, True)], MODEL)
    kinds = {(e.kind, e.model_id) for e in catalog.diff(old, new, F.lit("t")).collect()}
    assert kinds == {("pricing_variable", "a"), ("pricing_fixed", "b"), ("went_free", "b")}


def test_last_duplicate_wins(spark):
    rows = spark.createDataFrame([(1, *model("a", 1.0, 1.0)), (2, *model("a", 9.0, 1.0)), (3, *model("", 1.0, 1.0))], "n int, " + MODEL)
    kept = catalog.snapshot_rows(rows, F.col("n")).collect()
    assert [(r.id, r.prompt_per_m) for r in kept] == [("a", 9.0)]
    picks = {catalog.snapshot_rows(rows.drop("n").repartition(k)).first().prompt_per_m for k in (1, 3)}
    assert picks == {9.0}


def test_refresh_keeps_events_and_snapshots(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([model("a", 1.0, 1.0)], MODEL)
    second = spark.createDataFrame([model("a", 2.0, 1.0), model("b", 1.0, 1.0)], MODEL)
    assert catalog_refresh.refresh(first, root, "2026-01-01T00:00:00Z").count() == 1
    events = catalog_refresh.refresh(second, root, "2026-01-02T00:00:00Z")
    assert {(e.kind, e.model_id) for e in events.collect()} == {("price_change", "a"), ("added", "b")}
    again = catalog_refresh.refresh(second, root, "2026-01-02T00:00:00Z")
    assert again.count() == 2 and storage.read_events(spark, root).count() == 3
    newest = storage.latest_snapshot(spark, root)
    assert {r.id for r in newest.collect()} == {"a", "b"}
    assert catalog_refresh.refresh(first.limit(0), root, "2026-01-01T12:00:00Z").count() == 1
    assert [(e.kind, e.model_id) for e in storage.read_events(spark, root, "2026-01-02T00:00:00Z").orderBy("model_id").collect()] == [
        ("added", "a"), ("added", "b")
    ]
    assert catalog.stale(newest, F.lit("2026-01-02T23:00:00Z")).first().stale is False
    assert catalog.stale(newest, F.lit("2026-01-03T00:00:01Z")).first().stale is True
    assert catalog.stale(newest.limit(0), F.lit("2026-01-03T00:00:00Z")).first().stale is True


def test_document_shapes(spark, tmp_path):
    ready = {"id": "n", "name": "N", "context_length": 5, "prompt_per_m": 1.5, "free": True}
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"id": "r", "pricing": {"prompt": "0.000001", "completion": 0}}, "junk"]}))
    (tmp_path / "b.json").write_text(json.dumps({"models": [ready, {"name": "no id"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{**ready, "id": "l"}]))
    (tmp_path / "d.json").write_text("{broken")
    docs = documents.read_documents(spark, str(tmp_path)).select("body")
    got = {r.id: r for r in catalog.models_from_documents(docs).collect()}
    assert set(got) == {"r", "n", "l"}
    assert round(got["r"].prompt_per_m, 6) == 1 and got["n"].prompt_per_m == 1.5 and got["l"].free


def test_explore_candidates(spark):
    rows = [
        model("tested", 1.0, 1.0), model("short", 1.0, 1.0, context=8000), model("image", 1.0, 1.0, modality="text+image->text"),
        model("image-only", 1.0, 1.0, modality="image->image"), model("blank", 1.0, 1.0, modality=""), model("plain", 2.0, 2.0, modality="text"),
        model("free", 0.0, 0.0, free=True), model("edge", 3.0, 3.0, context=32000), model("var", None, None, variable=True),
    ]
    tested = spark.createDataFrame([("tested",)], "model string")
    queue = catalog.explore_queue(spark.createDataFrame(rows, MODEL), tested)
    # "text+image->text" does not contain "text->text".
    assert [r.id for r in queue.collect()] == ["free", "blank", "plain", "edge", "var"]
    top = catalog.explore_queue(spark.createDataFrame(rows, MODEL), tested, limit=2)
    assert [r.id for r in top.collect()] == ["free", "blank"]


@pytest.mark.parametrize(
    "cost,text",
    [(None, "in plan"), (0.0, "free"), (0.0435, "~4¢"), (0.005, "<1¢"), (0.5, "$0.50"), (1.25, "$1.25")],
)
def test_short_cost(spark, cost, text):
    df = spark.createDataFrame([(cost,)], "c double")
    assert df.select(display.short_cost(F.col("c")).alias("t")).first().t == text


@pytest.mark.parametrize(
    "value,text",
    [(0.5, "0.5"), (12345.0, "1.234e+04"), (0.00001234, "1.234e-05"), (3.0, "3"), (9999.6, "1e+04"), (0.0001, "0.0001"), (1234.4, "1234")],
)
def test_significant_digits(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    got = df.select(display.significant(F.col("v")).alias("t")).first().t
    # 12345 lies on a tie, which rounds up here.
    assert got == text or (value == 12345.0 and got == "1.235e+04")


def test_identity_ladder(spark):
    engines = spark.createDataFrame(
        [("codex", "Codex CLI", "OAuth plan", "gpt-5.5"), ("opencode", "OpenCode", "OpenRouter API", "")],
        "engine string, harness string, access string, default_model_key string",
    )
    models = spark.createDataFrame(
        [("codex", "gpt-5.5", "GPT-5.5", "verified", "docs"), ("opencode", "openrouter/z-ai/glm-5.2", "GLM 5.2", "verified", "slug")],
        "engine string, model_key string, display string, confidence string, source string",
    )
    labels = spark.createDataFrame(
        [(1, "codex", "gpt-5.5"), (2, "codex", " "), (3, "opencode", "openrouter/z-ai/glm-5.2"), (4, "opencode", "openrouter/new/x"),
         (5, "mystery", "m"), (6, "codex", "other"), (7, "", "")],
        "n int, engine string, model string",
    )
    got = {r.n: (r.model_display, r.harness, r.access, r.confidence) for r in identity.resolve(labels, engines, models).collect()}
    assert got[1] == got[2] == ("GPT-5.5", "Codex CLI", "OAuth plan", "verified")
    assert got[3][0] == "GLM 5.2"
    assert got[4] == ("new/x", "OpenCode", "OpenRouter API", "fallback")
    assert got[5] == ("mystery", "mystery", "unknown", "unknown")
    assert got[6] == ("other", "Codex CLI", "OAuth plan", "fallback")
    assert got[7] == ("unknown", "unknown", "unknown", "unknown")

"""Plan shapes and skew: what has to hold when the data is a thousand times larger."""

import gzip
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attestry.functions import measures
from attestry.operators import library, lint, links, quality, scoreboard
from attestry.registry import QUERIES
from attestry.registry import runs as run_queries
from attestry.registry.base import Inputs
from attestry.session import ensure_checkpoint_dir, shuffles_removed

STREAMING = {k for k in QUERIES if k.startswith("stream_")}
WRITING = {
    "catalog_snapshot_write", "catalog_events_append", "catalog_refresh", "report_json", "append_attempts",
    "export_attempts_jsonl", "scan_records_any_format", "binary_listing",
}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMING - WRITING))
def test_no_pairwise_joins_or_single_task_windows(spark, sf_dir, key):
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        # A window without partition keys would gather a table in one task.
        assert not ("+- Window " in line and "windowspecdefinition(" not in line)
        if "windowspecdefinition(" in line and "WindowGroupLimit" not in line:
            first = line.split("windowspecdefinition(")[1].split(",")[0]
            assert "ASC" not in first and "DESC" not in first, line


def test_scan_is_pruned(spark, sf_dir):
    plan = QUERIES["instance_first_final"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1][:200]


@pytest.mark.parametrize("key", ["review_findings", "review_findings_strict", "copy_contracts", "doc_sections", "section_contract"])
def test_documents_are_read_once_and_not_shuffled(spark, sf_dir, key):
    """As many scans as the view itself has, and no exchange beyond its own."""
    views = {
        "review_findings": "review_reports", "review_findings_strict": "strict_reviews", "copy_contracts": "copy_docs",
        "doc_sections": "doc_files", "section_contract": "contract_docs",
    }
    view = Inputs(spark, sf_dir)(views[key])._jdf.queryExecution().executedPlan().toString()
    plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == view.count("FileScan") and plan.count("Exchange") == view.count("Exchange")


def test_version_rank_is_limited_before_the_shuffle(spark, sf_dir):
    plan = QUERIES["library_versions_top20"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_hot_instance_tokens_are_whole(spark):
    """A third of all attempts in one instance: every token still counts."""
    rows = spark.range(9_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 500)).alias("run_id"),
        F.lit("t").alias("task_key"), F.lit("codex").alias("engine"), F.lit("M").alias("model"), F.lit("").alias("task_type"),
        F.lit("PASS").alias("verdict"), F.lit(1.0).alias("duration_s"), F.col("id").alias("tokens"), F.lit("2026").alias("created_at"),
    )
    instances = scoreboard.first_final(rows)
    assert scoreboard.labelled_tokens(instances, rows).count() == 9_000
    assert scoreboard.scoreboard_models(rows).first().median_tokens == 4499.5


def test_hot_name_versions(spark):
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("j"), F.col("id") % 40)).otherwise("hot").alias("run_name"),
        F.format_string("r%05d", "id").alias("run_id"), F.format_string("%05d", F.col("id") % 900).alias("finished_at"),
    )
    kept, pruned = library.kept_versions(rows), library.pruned_versions(rows)
    assert kept.where("run_name = 'hot'").count() == 20
    assert kept.count() + pruned.count() == 3_000
    assert kept.join(pruned, ["run_name", "run_id"]).count() == 0


def test_hot_host(spark):
    """All URLs on one host: work grows with the rows, not their pairs."""
    cited = spark.range(20_000).select(F.concat(F.lit("http://h.com/section/page"), "id").alias("url"))
    allowed = spark.range(10_000).select(F.concat(F.lit("http://h.com/section/page"), F.col("id") * 7, F.lit("/sub")).alias("url"))
    outside = links.outside_allowlist(cited, allowed)
    brute = set(range(20_000)) - {i for i in range(20_000) if any(str(7 * j).startswith(str(i)) for j in _sevens(i))}
    assert outside.count() == len(brute)


def _sevens(i):
    """Multiples of 7 below 70,000 that can start with ``i``."""
    text, hits = str(i), []
    for extra in range(0, 6 - len(text)):
        low = i * 10**extra
        high = low + 10**extra - 1
        first = -(-low // 7)
        hits += [j for j in range(first, high // 7 + 1) if j < 10_000]
    return hits


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "key", ["copy_brand_kit", "copy_listing", "copy_contracts", "copy_brand_board", "doc_sections", "review_findings_strict", "lint_tasks"]
)
def test_rules_are_judged_in_a_projection_of_their_own(spark, sf_dir, key):
    """What explodes is a plain column, and no filter below judges the rules a second time."""
    plan = plan_of(QUERIES[key](spark, sf_dir))
    generated = re.findall(r"Generate explode\((.{0,40})", plan)
    assert generated and all(re.match(r"_\w+#\d+\)", g) for g in generated), generated
    assert not re.search(r"Filter .*size\(_?found", plan)


def test_word_counts_keep_no_words(spark):
    """Blanks beyond ASCII count, and neither form lists every match."""
    rows = spark.createDataFrame([(" a\u00a0b\u3000c\x1fd ",), ("",), ("\u2028",), (None,), ("\U0001f600 \u00e9",)], "t string")
    found = rows.select(measures.spaced_words(F.col("t")).alias("w"), measures.visible_chars(F.col("t")).alias("v"))
    assert [tuple(r) for r in found.collect()] == [(4, 4), (0, 0), (0, 0), (None, None), (2, 2)]
    assert "regexp_extract_all" not in plan_of(found)


def test_a_table_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(30_000).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size", "'x' as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    raw = Inputs(spark, str(tmp_path)).dealt("catalog_raw")
    sizes = [n for n in raw.rdd.glom().map(len).collect() if n]
    assert len(sizes) == 8 and max(sizes) < 5_000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt_")]


def test_task_texts_do_not_meet_the_manifests(spark):
    manifests = spark.createDataFrame([("m", "r", "/w", 1, False, "")], "manifest_id string, run_name string, workdir string, max_parallel int, worktrees boolean, repo string")
    tasks = spark.createDataFrame([("m", 0, "k", "long text", " "), ("m", 1, "j", None, None)], "manifest_id string, pos int, task_key string, spec string, check_cmd string")
    found = lint.validate(manifests, tasks)
    assert sorted((r.pos, r.rule) for r in found.collect()) == [(1, "check-required"), (1, "spec-required")]
    projected = [line for line in plan_of(found).splitlines() if "Project [" in line]
    assert not any(re.search(r"[\[ ](spec|check_cmd)#\d+[,\]]", line) for line in projected)


def test_printed_numbers_are_made_once_a_row(spark):
    rules = ["any:x==1.5", "any:x==1e-06", "x!=3.0", "any:x==nan"]
    rows = spark.createDataFrame([(1.5,), (1e-6,), (float("nan"),), (None,)], "x double")
    found = quality.check_records(rows, [quality.invariant(r) for r in rules])
    assert [(r.rule, r.ok) for r in found.collect()] == [(r, True) for r in rules]
    # The digits are cut from the text by two replacements; each rule trims once.
    assert plan_of(found).count("regexp_replace") <= 2 + 2 * len(rules)


def test_libraries_are_parsed_once_for_both_sides_of_the_join(spark, sf_dir):
    plan = plan_of(QUERIES["scan_library"](spark, sf_dir))
    assert plan.count("Join Inner") == 1 and "from_json" not in plan and "parseJson" not in plan


def test_a_name_in_two_libraries_keeps_all_versions(spark, tmp_path):
    """Each entry of a name meets the versions of all entries of that name."""
    rows = [(7, 1, "F", "1-URGENT"), (7, 2, "O", "1-URGENT"), (None, 3, "O", "1-URGENT"), (8, 4, "O", "5-LOW")]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["scan_library"](spark, str(tmp_path)).select("run_name", "current_run_id", "pos", "tasks_fail").collect()
    assert sorted((r.current_run_id, r.pos, r.tasks_fail or 0) for r in found) == sorted(
        (f"r{c}", p, n) for c in (1, 2) for p, n in ((0, 0), (0, 0), (1, 1), (1, 2))
    ) and {r.run_name for r in found} == {"job-7"}


def run_tables(spark, folder):
    """2,000 orders, every 50th key null and every 100th twice; two of three have lines, some of these alike."""
    orders = spark.range(2_000).selectExpr(
        "if(id % 50 = 7, null, id) as o_orderkey", "id % 90 as o_custkey", "substr('FOP', 1 + cast(id % 3 as int), 1) as o_orderstatus",
        "timestamp_ntz '2026-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 700 as int)) as o_orderdate",
        "if(id % 4 = 0, '5-LOW', '1-URGENT') as o_orderpriority",
    )
    orders.union(orders.where("o_orderkey % 100 = 0")).write.parquet(f"{folder}/orders.parquet")
    spark.range(8_000).selectExpr(
        "if(id % 50 = 7, null, id % 2000) as l_orderkey", "cast(id div 4000 as int) as l_linenumber", "id % 97 as l_partkey", "id % 31 as l_suppkey",
        "cast(id % 9 as double) as l_quantity", "if(id % 2 = 0, 'A', 'R') as l_returnflag", "'O' as l_linestatus",
        "timestamp_ntz '2026-02-01 00:00:00' as l_shipdate",
    ).where("l_orderkey is null or l_orderkey % 3 > 0").write.parquet(f"{folder}/lineitem.parquet")
    return folder


def shuffle_files(spark) -> set[str]:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in map(lambda i: blocks.apply(i).getName(), range(blocks.size())) if f.startswith("shuffle_")}


def left_over(spark, before: set[str]) -> set[str]:
    """Shuffle files that stay; they are removed in the background."""
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


@pytest.mark.parametrize("slices", [1, 5])
def test_run_states_take_little_disk(spark, tmp_path, monkeypatch, slices):
    """Documents are compressed, in short files, and the shuffles that nest them go with their slice."""
    folder = str(run_tables(spark, tmp_path))
    for name, value in (("ROWS_A_SLICE", 100_000 if slices == 1 else 1), ("SLICES", slices), ("DOCS_A_FILE", 300)):
        monkeypatch.setattr(run_queries, name, value, raising=False)
    scratch, conf = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "scratch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    known, before, was = set(scratch.glob("run-states-*")), shuffle_files(spark), spark.conf.get(conf)
    found = QUERIES["scan_run_states"](spark, folder)
    assert not left_over(spark, before) and spark.conf.get(conf) == was
    (written,) = set(scratch.glob("run-states-*")) - known
    files = list(written.glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()) for f in files]
    assert sum(f.stat().st_size for f in files) < sum(map(len, texts)) / 4
    assert sum(t.count(b"\n") for t in texts) == 2_020 and max(t.count(b"\n") for t in texts) <= 300
    got = [(r.run_id, r.done, r.tasks) for r in found.collect()]
    keys = [i for i in range(2_000) if i % 50 != 7 and not (i % 3 == 2 and i % 4 == 0)]
    keys += [i for i in range(0, 2_000, 100) if not (i % 3 == 2 and i % 4 == 0)]
    assert sorted(got) == sorted((f"run-{i}", i % 3 != 2, 2 if i % 3 else 0) for i in keys)


def test_slices_of_run_states_make_the_whole(spark, tmp_path):
    v = Inputs(spark, str(run_tables(spark, tmp_path)))
    whole = sorted(r.body for r in run_queries.state_documents(v).select("body").collect())
    parts = [[r.body for r in run_queries.state_documents(v, at, 4).select("body").collect()] for at in range(4)]
    assert min(map(len, parts)) > 300 and sorted(sum(parts, [])) == whole
    assert sum('"deliverables":[{"task_key":"task-0","name":"report.md","path":"/out/run-4","bytes":' in t for t in whole) == 1


def test_the_setting_for_shuffles_comes_back(spark):
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(conf)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(conf) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(conf) == was

"""Notes, quality, lint, display, log and contract semantics on literal rows."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from attestry.functions import clock, display, measures, patterns, shell, status, urls
from attestry.operators import contracts, lint, links, logs, media, notes, quality, runs, scope, sessions
from attestry.schemas import RUN_STATE
from attestry.sources import documents, records, storage

NOTES = """# File
- 2026-01-01 before any section
## openrouter/z-ai/glm-5.2 (lane)
- 2026-07-06 — **Good** at `code`,
  goes on
- undated
- 2026-07-09 newer [link](http://x)
stray
  dropped
## GPT-5.5
- 2026-13-01 odd month
"""


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_notes(spark):
    docs = spark.createDataFrame([(1, NOTES)], "doc_id int, text string")
    sections = notes.sections(docs)
    assert [r.heading for r in sections.orderBy("sec_idx").collect()] == ["openrouter/z-ai/glm-5.2 (lane)", "GPT-5.5"]
    bullets = notes.bullets(sections).orderBy("sec_idx", "bullet_idx").collect()
    assert [b.bullet.split("\n")[0][:10] for b in bullets] == ["2026-07-06", "2026-07-09", "2026-13-01"]
    models = spark.createDataFrame([("openrouter/z-ai/glm-5.2",), ("gpt-5.5",), ("glm-5",), ("nobody",), (" ",)], "model string")
    shown = notes.newest_notes(models, sections).orderBy("model", "rank").collect()
    assert [(r.model, r.date, r.body) for r in shown] == [
        ("gpt-5.5", "2026-13-01", "odd month"),
        ("openrouter/z-ai/glm-5.2", "July 9", "newer link"),
        ("openrouter/z-ai/glm-5.2", "July 6", "Good at code, goes on"),
    ]


def test_note_matching_prefers_exact_then_longer_then_earlier(spark):
    heads = spark.createDataFrame(
        [(1, 0, "abc and more words"), (1, 1, "abc"), (1, 2, "x-abc"), (1, 3, "abc more"), (1, 4, "(a\\E.b)")], "doc_id int, sec_idx int, heading string"
    )
    models = spark.createDataFrame([("ABC",), ("more",), ("x",), ("a\\E.b",)], "model string")
    got = {r.model: r.sec_idx for r in notes.matched_sections(models, heads.withColumn("body", F.lit(""))).collect()}
    assert got == {"ABC": 1, "more": 0, "a\\E.b": 4}


def test_note_matching_with_a_token_in_every_heading(spark):
    """A common token, equal headings, names of one token only: as the plain search finds them."""
    rows = [(i % 50, i // 50, f"Model {'lane' if i % 3 else 'Lane'} v{i % 700} gpt-{i % 11}") for i in range(6_000)]
    rows += [(60, i, "model") for i in range(300)] + [(61, 0, None), (61, 1, "")]
    names = ["model", "lane v7", "MODEL lane", "gpt-5", "v699 gpt-1", "v70", "nothing", "model nothing", "gpt", "", None]
    heads = spark.createDataFrame(rows, "doc_id int, sec_idx int, heading string").withColumn("body", F.lit(""))
    models = spark.createDataFrame([(n,) for n in names], "model string")
    want = {}
    for name in filter(None, names):
        at = re.compile(f"(?<![{notes.NAME_CHARS}]){re.escape(name.lower())}(?![{notes.NAME_CHARS}])")
        hits = [(h.lower() == name.lower(), len(h), -d, -s) for d, s, h in rows if h and at.search(h.lower())]
        if hits:
            want[name] = (-max(hits)[2], -max(hits)[3])
    for share in (10_000, 40):
        got = {r.model: (r.doc_id, r.sec_idx) for r in notes.matched_sections(models, heads, share).collect()}
        assert got == want


CHECKS = [
    ("true", (True, False)), (" : ", (True, False)), ("exit 0 # fine", (True, False)), ("echo a && echo b", (True, False)), ("echo a; ls", (False, False)),
    ("echo 'a > b'", (False, False)), ("test -s '#x'", (False, True)), ("[ -f a ]", (False, True)), ("test -s a && grep -q x b", (False, True)),
    ("grep -iq x f 2>/dev/null", (False, True)), ("grep x f", (False, False)), ("diff -q a b", (False, True)), ("diff -q a b || echo no", (False, False)),
    ("diff -q a b || { cat a; exit 1; }", (False, False)), ("diff -q a b || exit 1", (False, True)), ("test -s a || echo no", (False, False)),
    ("grep 'x y' -c f && [ -d 'a b' ]", (False, False)), ("[ -d 'a b' ] && grep -c '-q' f 2>&1", (False, True)), ("echo 'a; b'", (False, False)),
    ("(diff -q a b) || { exit 1; }", (False, True)), ("echo \"a \\\" b\"\necho c;", (True, False)), ("echo a # | b", (True, False)),
    ("echo a#b > c", (False, False)), ("[ -f ]", (False, False)), ("test -f a >x 2>&1", (False, True)), ("test -n a", (False, False)),
    ("diff -q 'a b' c && true || printf '%s' no", (False, False)), ("echoes a", (False, False)), (None, (False, False)),
    ("test -s a | cat", (False, False)), ("echo 'open", (False, False)), ("", (False, False)), ("# only", (False, False)), ("python3 check.py", (False, False)),
]


def test_check_commands(spark):
    rows = [(i, command) for i, (command, _) in enumerate(CHECKS)]
    judged = spark.createDataFrame(rows, "i int, c string").select("i", shell.judge_check("c").alias("j")).collect()
    wrong = [(CHECKS[r.i], tuple(r.j)) for r in judged if tuple(r.j) != CHECKS[r.i][1]]
    assert len(judged) == len(CHECKS) and not wrong


@pytest.mark.parametrize(
    "spec,expected",
    [
        ("then git commit", True), ("do not git commit", False), ("Don't run `git commit`", False), ("never, ever git commit", True),
        ("do not git commit. later GIT COMMIT it", True), ("no git commit and never git commit", False), ("do not " + "x " * 30 + "git commit", True), ("nothing", False),
    ],
)
def test_commit_instruction(spark, spec, expected):
    assert one(spark, lint.instructs_commit(F.lit(spec))) is expected


def test_manifest_validation(spark):
    heads = spark.createDataFrame(
        [("a", "run", "/w", 1, False, ""), ("b", "", "", -1, True, ""), ("c", "run", "rel/w", 0, False, "")],
        "manifest_id string, run_name string, workdir string, max_parallel int, worktrees boolean, repo string",
    )
    rows = [("a", i, k, "s", "c") for i, k in enumerate(["k", "k", "../x", "../w/ok", "logs/a", "/logs", "..", "x/../logs", "logsx"])]
    rows += [("c", 0, "../../../y", "", ""), ("c", 1, "fine", "s", "c")]
    tasks = spark.createDataFrame(rows, "manifest_id string, pos int, task_key string, spec string, check_cmd string")
    got = {(r.manifest_id, r.pos, r.rule) for r in lint.validate(heads, tasks, "/home/u").collect()}
    assert got == {
        ("a", 1, "duplicate-key"), ("a", 2, "key-escapes"), ("a", 4, "key-reserved"), ("a", 5, "key-reserved"), ("a", 6, "key-escapes"), ("a", 7, "key-reserved"),
        ("b", None, "run-name"), ("b", None, "workdir"), ("b", None, "no-tasks"), ("b", None, "worktrees-without-repo"), ("b", None, "max-parallel"),
        ("c", 0, "key-escapes"), ("c", 0, "spec-required"), ("c", 0, "check-required"),
    }


@pytest.mark.parametrize(
    "seconds,duration,ago",
    [(9, "9s", "9 seconds"), (59.5, "1m 00s", "59 seconds"), (63, "1m 03s", "1 minute 3 seconds"), (60, "1m 00s", "1 minute"), (7260, "121m 00s", "2 hours 1 minute"), (3600, "60m 00s", "1 hour"), (1, "1s", "1 second")],
)
def test_durations(spark, seconds, duration, ago):
    s = F.lit(float(seconds))
    assert (one(spark, clock.duration_text(s)), one(spark, clock.ago_text(s))) == (duration, ago)


def test_elapsed_is_zero_when_unusable(spark):
    def at(a, b):
        return one(spark, clock.elapsed_seconds(F.lit(a), F.lit(b)))

    assert at("2026-01-01T00:00:00Z", "2026-01-01T01:00:00+01:00") == 0
    assert at("2026-01-01T00:00:00Z", "2026-01-01T00:00:02.5Z") == 2.5
    assert at("2026-01-01T00:00:05Z", "2026-01-01T00:00:00Z") == 0 and at("soon", "2026-01-01T00:00:00Z") == 0


def test_names(spark):
    assert one(spark, display.safe_name(F.lit("--a b/c--"))) == "a-b-c" and one(spark, display.safe_name(F.lit("//"))) == "unnamed"
    assert one(spark, display.safe_session(F.lit("._a b_."))) == "a_b" and one(spark, display.safe_session(F.lit(""))) == "unknown-session"
    assert one(spark, display.deliverable_title(F.lit("my_NOTES.md"))) == "My notes"
    assert one(spark, display.deliverable_label(F.lit("out/chart-a.PNG"))) == "Chart a — image"
    assert one(spark, display.deliverable_label(F.lit(""))) == "Work — download"


def test_retry_hides_old_proof(spark):
    df = spark.createDataFrame([("r", "t", "running", 2, "old", "tail")], "run_id string, task_key string, status string, attempt int, verified string, check_tail string")
    row = runs.task_notes(df).first()
    assert row.kind == "retry" and row.proof is None and row.how_checked is None


def test_quality_edge_cases(spark):
    df = spark.createDataFrame([("1,200", None), ("nan", "x"), ("2", " x ")], "amount string, note string")
    rules = ["amount>=2", "note==None", "any:note==x", "amount!=2", "missing!=None", "count==3"]
    got = {r.rule: (r.ok, r.bad) for r in quality.check_records(df, [quality.invariant(r) for r in rules]).collect()}
    assert got == {
        "amount>=2": (False, 1), "note==None": (False, 2), "any:note==x": (True, 0), "amount!=2": (False, 1), "missing!=None": (False, 3), "count==3": (True, 0),
    }
    empty = quality.check_records(df.limit(0), [quality.invariant(r) for r in ("amount>=2", "any:note==x", "unique:note")])
    assert {r.rule: r.ok for r in empty.collect()} == {"amount>=2": True, "any:note==x": False, "unique:note": True}
    with pytest.raises(ValueError):
        quality.invariant("amount ~ 3")


def test_tokens(spark):
    text = F.lit("tokens used 10\nTokens\nused: 9\ntokens used: 75,417")
    assert one(spark, logs.scrape_tokens(text, r"tokens\s+used\s*:?\s*([0-9][0-9,]*)")) == 75417
    assert one(spark, logs.scrape_tokens(text, r"[0-9,]+")) == 75417
    for bad in ("", "([", "zzz", r"(tokens)"):
        assert one(spark, logs.scrape_tokens(text, bad)) == -1


def test_tail_cuts_bytes(spark):
    assert one(spark, logs.tail_text(F.lit("aé"), 1)) == "�" and one(spark, logs.tail_text(F.lit("abc"), 10)) == "abc"


@pytest.mark.parametrize("limit,cap,expected", [(100, 100, "aabbbc"), (4, 100, "bbbc"), (100, 4, "bbbc"), (100, 3, "c"), (2, 1, "c"), (3, 4, "bbc")])
def test_output_tail(spark, limit, cap, expected):
    df = spark.createDataFrame([("r", "t", 1, "aa"), ("r", "t", 2, "bbb"), ("r", "t", 3, "c")], "run_id string, task_key string, seq bigint, chunk string")
    for block in (1, 2, 100):
        assert logs.output_tails(df, limit, cap, block).first().tail == expected


def test_one_oversized_chunk_is_kept(spark):
    df = spark.createDataFrame([("r", "t", 1, "aa"), ("r", "t", 2, "bbbbb")], "run_id string, task_key string, seq bigint, chunk string")
    assert logs.output_tails(df, 10, 3, 1).first().tail == "bbbbb"


def test_output_tail_at_the_shipped_limits(spark):
    """256 KiB of chunks of a megabyte, of one byte and of none, in blocks of 65,536."""
    def chunk(task, i):
        return {"big": chr(97 + i % 26) * 1_000_000, "thin": chr(97 + i % 26), "none": ""}[task]

    sizes = {"big": 40, "thin": 300_000, "none": 70_000}
    df = None
    for task, n in sizes.items():
        letter = F.chr(97 + F.col("id") % 26)
        text = {"big": F.repeat(letter, 1_000_000), "thin": letter, "none": F.lit("")}[task]
        rows = spark.range(n).select(F.lit("r").alias("run_id"), F.lit(task).alias("task_key"), F.col("id").alias("seq"), text.alias("chunk"))
        df = rows if df is None else df.unionByName(rows)
    got = {r.task_key: r.tail for r in logs.output_tails(df, logs.RETAINED_BYTES).collect()}
    thin = "".join(chunk("thin", i) for i in range(sizes["thin"]))
    assert got == {"big": chunk("big", 39)[-logs.RETAINED_BYTES :], "thin": thin[-logs.RETAINED_BYTES :], "none": ""}


def test_long_characters_at_the_cut(spark):
    df = spark.createDataFrame([("r", "t", 1, "é" * 9), ("r", "t", 2, "aé" * 6)], "run_id string, task_key string, seq bigint, chunk string")
    for limit in range(1, 40):
        whole = ("é" * 9 + "aé" * 6).encode()[-limit:].decode("utf-8", "replace")
        assert logs.output_tails(df, limit, 100, 4, 2).first().tail == whole


def test_orchestrator_commands_are_left_alone(spark):
    def needs(c):
        return one(spark, sessions.needs_routing(F.lit(c), "conductor"))

    assert needs("python3 conductor_probe.py") and needs("grep conductor api.openai.com")
    assert not needs("/usr/bin/conductor run eval api.openai.com") and not needs("python3 conductor.py probe.py") and not needs("  ")


def test_url_cover_rules(spark):
    def outside(cited, allowed):
        c = spark.createDataFrame([(u,) for u in cited], "url string")
        a = spark.createDataFrame([(u,) for u in allowed], "url string")
        return {r.url for r in links.outside_allowlist(c, a).collect()}

    assert outside(["http://A.com/x/"], ["https://a.com//x"]) == set()
    assert outside(["http://a.com/x"], ["http://a.com/xyz", "http://b.com/x"]) == {"http://a.com/x"}
    assert outside(["http://a.com/longpath/more"], ["http://a.com/longpath"]) == set()
    assert outside(["http://a.com/longpath"], ["http://a.com/longpath/more"]) == set()
    assert outside(["http://a.com"], ["http://a.com/longpath/more"]) == {"http://a.com"}
    assert outside(["http://a.com/x?q=1"], ["http://a.com/x?q=2"]) == {"http://a.com/x?q=1"}
    assert outside(["http://a.com/x?q=1", "http://a.com/x"], ["http://a.com/x"]) == set()
    assert outside(["http://a.com/x"], ["http://a.com/x?q=2"]) == set()


def test_whole_url_prefix_needs_34_characters(spark):
    base = "https://example.com/" + "a" * 14  # 34 characters
    cited = spark.createDataFrame([(base + "/more",), (base[:33],), (base + "/",)], "url string")
    allowed = spark.createDataFrame([(base,)], "url string")
    assert {r.url for r in links.outside_sources(cited, allowed).collect()} == {base[:33]}


def test_measures(spark):
    assert one(spark, measures.bounded_words(F.lit("don't foo- -bar a--b"))) == 4
    assert one(spark, measures.test_count(F.lit("Tests: 2 failed, 14 passed\nRan 9 tests"))) == 14
    assert one(spark, measures.test_count(F.lit("none"))) is None
    assert one(spark, urls.normalised(F.lit("HTTP://A.com//b//c/?q=1&#f"))) == "http://a.com/b/c?q=1"


def test_scope_variants(spark):
    schema = "task_id string, path string"
    changed = spark.createDataFrame([("t", "src/a.py"), ("t", "src2/a.py"), ("t", "docs"), ("w", "any/thing")], schema)
    owned = spark.createDataFrame([("t", "./src/"), ("t", "docs/deep/file"), ("w", "*")], schema)
    assert {r.path for r in scope.outside_scope(changed, owned).collect()} == {"src2/a.py", "docs"}
    assert {r.path for r in scope.outside_scope(changed, owned, parents_allowed=True).collect()} == {"src2/a.py"}
    assert {r.path for r in scope.in_forbidden(changed, owned).collect()} == {"src/a.py"}


def test_texts_held_match_brute_force(spark):
    """Short, long, blank-holding and many-line needles; long pieces and a hot start."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abA_") for _ in range(n))
    texts = [(g, " ".join(word(rng.randint(1, 30)) for _ in range(60)) + "\n" + word(40) + "\n\t" + word(3_000)) for g in (1, 1, 2)]
    texts += [(1, None), (2, ""), (1, "same_start_here_" * 300 + "end")]
    needles = {(g, t[at : at + n]) for g, t in texts if t for n in (1, 2, 11, 12, 13, 40, 1_500) for at in rng.sample(range(len(t)), 6)}
    needles |= {(2, n) for g, n in needles if g == 1} | {(1, "same_start_here_same_start_herf"), (1, "here_end")}
    want = {(g, n) for g, n in needles if n and any(g == h and n in (t or "") for h, t in texts)}
    got = scope.texts_held(
        spark.createDataFrame(sorted(needles) + [(1, ""), (1, None)], "g int, needle string"), spark.createDataFrame(texts, "g int, content string"), ["g"]
    ).collect()
    assert len(got) == len(want) and {(r.g, r.needle) for r in got} == want
    nothing = spark.createDataFrame([], "g int, needle string")
    assert scope.texts_held(nothing, spark.createDataFrame(texts, "g int, content string"), ["g"]).count() == 0


def test_blank_needles_and_edges_of_words(spark):
    text = "alpha beta\n\n  gamma delta epsilon\tzeta"
    yes = ["beta\n\n  gam", " ", "\n\n", "  ", "\n  g", "ta e", "a d", "gamma delta epsilon", "\tz", "alpha", "pha be", "a beta\n"]
    no = ["beta gamma", "\n\n\n", "   ", "ha bet gam", "amma del epsilon", "zeta ", " alpha", "delta\tepsilon", "\t\t"]
    needles = spark.createDataFrame([(n,) for n in yes + no], "needle string")
    texts = spark.createDataFrame([(text,), ("other words",), (text,)], "content string")
    assert sorted(r.needle for r in scope.texts_held(needles, texts).collect()) == sorted(yes)


def test_one_long_snippet_is_found_by_its_rarest_gram(spark):
    """Neither a row per character nor a tail as long as the longest needle."""
    rng = random.Random(3)
    body = "\n".join(" ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(10)) for _ in range(5_700))
    snippets = [body[200_000:203_000], body[200_000:203_000] + "#", "common"]
    texts = spark.createDataFrame([(body,)] + [("common " * 50,)] * 20, "content string")
    found = scope.texts_held(spark.createDataFrame([(n,) for n in snippets], "needle string"), texts)
    assert {r.needle for r in found.collect()} == {snippets[0], "common"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(content" not in plan and "Cartesian" not in plan


def test_large_files_are_searched_unless_a_limit_is_given(spark):
    files = spark.createDataFrame([("t", "src/big.py", "x" * 1_100_000 + " needle"), ("t", "src/small.py", "hay")], "task_id string, path string, content string")
    owned = spark.createDataFrame([("t", "src")], "task_id string, path string")
    snippets = spark.createDataFrame([("t", "needle"), ("t", "absent")], "task_id string, snippet string")
    assert {r.snippet for r in scope.missing_text(snippets, owned, files).collect()} == {"absent"}
    assert {r.snippet for r in scope.missing_text(snippets, owned, files, 1_000_000).collect()} == {"absent", "needle"}
    assert [r.path for r in scope.oversized(files, 1_000_000).collect()] == ["src/big.py"]


def test_symbols_in_searchable_files(spark):
    symbols = spark.createDataFrame([(1, f"s{i}") for i in range(20)] + [(1, "in.bin"), (1, "skipped"), (1, "x(y)")], "doc_id int, symbol string")
    files = spark.createDataFrame(
        [("a.py", bytearray(b"s1 xs2x s19 x(y)")), ("b.bin", bytearray(b"\0in.bin")), ("dist/c.py", bytearray(b"skipped"))], "path string, content binary"
    )
    found = {r.symbol for r in scope.symbols_found(symbols, files).collect()}
    assert found == {"s1", "s2", "s19", "x(y)"}


def test_review_block_fields(spark):
    text = "# Review Report\n## Summary\nok\n## Findings\n### Finding: a\nEvidence: src/a.py:3\nImpact: x\nFix: y\nPriority: p1\nConfidence: HIGH\n## Clean\nall\n## Assumptions\n-"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert contracts.review_findings(df).count() == 0
    block = contracts.review_blocks(df).first()
    assert (block.priority, block.confidence, block.evidence) == ("P1", "high", "src/a.py:3")


def test_strict_findings_read_labelled_paragraphs(spark):
    good = (
        "## Summary\nFinding: a\nEvidence: src/a.py:3 shows it plainly\nImpact: x\nFix\t: y\n"
        "priority:\n p2 now\nConfidence: HIGH"
    )
    thin = good.replace("src/a.py:3 shows it plainly", "short")
    # Evidence that is empty is taken from the next paragraph; a bare last label is thin.
    empty = good.replace("Evidence: src/a.py:3 shows it plainly\nImpact: x", "Evidence:\nImpact: something long enough")
    last = good.replace("Evidence: src/a.py:3 shows it plainly\n", "") + "\nEvidence: "
    wrong = good.replace("p2", "P7").replace("HIGH", "highly").replace("Fix\t", "Fix notes")
    df = spark.createDataFrame(list(enumerate([good, thin, empty, last, wrong, "I  fixed it. NO FINDINGS", None])), "doc_id int, text string")
    found = {}
    for r in contracts.strict_review_findings(df).collect():
        found.setdefault(r.doc_id, set()).add((r.finding, r.rule))
    assert found == {
        1: {(1, "thin-evidence")}, 3: {(1, "thin-evidence")},
        4: {(1, "priority"), (1, "confidence"), (1, "label:Fix")}, 5: {(0, "section:Summary"), (0, "claims-edit")},
    }


@pytest.mark.parametrize("text, claimed", [
    ("we then Patched\nthe file", True), ("(I pushed)", True), ("I have fixed it", False), ("ski fixed", False),
    ("committed them", False), ("I, fixed", False), ("x" * 200_000, False),
])
def test_claims_of_edits(spark, text, claimed):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert (contracts.claims_of_edits(df).count() == 1) == claimed


def test_transcript_answer_ends_at_the_next_part(spark):
    rows = [
        "x\nmodel response:\n\n first\nstill: it\nABC: too short\nNEXT_ PART: no", "MODEL RESPONSE: VERDICT: quoted\n##\nrest",
        "MODEL RESPONSE: a\n###no\n## End", "nothing here", None,
    ]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r.a for r in df.select(contracts.after_marker(F.col("t"), "MODEL RESPONSE:").alias("a")).collect()]
    assert got == ["first\nstill: it\nABC: too short", "VERDICT: quoted", "a\n###no", "", ""]


def test_links_and_images_of_a_page(spark):
    html = (
        "<img SRC = 'HTTPS://a.b/c'><a data-href=\"http://d\">x</a><a href='/e'><img srcset=\"http://f\">"
        "<a href=http://g><i x='src=' y><a href=\"http://\"><b src=\"http://h"
        "<p> data:image/PNG;base64,AA data:image/gif;base64,BB data:image/webp;base64,CC"
    )
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page_id int, html string")
    assert sorted(r.url for r in contracts.external_urls(df).collect())[:2] == ["HTTPS://a.b/c", "http://d"]
    assert contracts.external_urls(df).count() == 3
    assert df.where("page_id = 1").select(contracts.embedded_images(F.col("html"))).first()[0] == 2


def test_unknown_symbols_are_findings(spark):
    text = "# API symbols\n`known` `gone` `allowed`\n"
    docs = spark.createDataFrame([(1, text), (2, "# API symbols\n`allowed`")], "doc_id int, text string")
    files = spark.createDataFrame([("a.py", "def known(): pass")], "path string, content string")
    missing = scope.missing_symbols(contracts.symbol_spans(docs, "API symbols"), files)
    found = contracts.doc_sections(docs, [], 0, 0, "API symbols", "python", ["allowed"], missing).where("rule not like 'no-example%'")
    assert {tuple(r) for r in found.collect()} == {(1, "unknown-symbol:gone"), (2, "no-symbols")}


def test_png(spark):
    png = bytearray.fromhex("89504e470d0a1a0a0000000d4948445200000280000001e0") + b"rest"
    df = spark.createDataFrame([("a", png), ("b", png[:20]), ("c", bytearray(b"GIF"))], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in media.png_sizes(df).collect()} == {"a": (640, 480), "b": (None, None), "c": (None, None)}


def test_document_sources(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"run_id":"r1","done":true,"tasks":[{"key":"t","status":"passed","deliverables":[{"name":"a","bytes":3}]}],"extra":1}')
    (tmp_path / "bad.json").write_text('{"run_id":')
    (tmp_path / "noid.json").write_text('{"run_name":"x"}')
    docs = documents.read_documents(spark, str(tmp_path))
    states = runs.parse_run_states(docs, RUN_STATE)
    row = states.first()
    assert states.count() == 1 and row.tasks[0].deliverables[0].bytes == 3 and row.modified is not None
    listing = documents.binary_listing(spark, str(tmp_path))
    assert listing.count() == 3 and "content" not in listing.columns
    active = spark.createDataFrame([('{"r1":{"pid":4}}',), ("nope",)], "body string")
    assert [(r.run_id, r.pid) for r in documents.active_runs(active).collect()] == [("r1", 4)]


def test_record_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount\n01,2\n")
    (tmp_path / "a.json").write_text('[{"id":"01"},\n{"amount":2}]')
    (tmp_path / "a.jsonl").write_text('{"id":"01"}\n\n[1]\n')
    assert records.read_records(spark, str(tmp_path / "a.csv"), "csv").first().id == "01"
    assert set(records.read_records(spark, str(tmp_path / "a.json"), "json").columns) == {"id", "amount"}
    lines = documents.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r.line for r in records.bad_lines(lines).collect()] == ["[1]"]


def test_missing_active_table_flags_nothing(spark):
    df = spark.createDataFrame([("r", False), ("d", True)], "run_id string, done boolean")
    assert runs.flag_orphans(df, None).where("died").count() == 0
    active = spark.createDataFrame([("x",)], "run_id string")
    assert [r.run_id for r in runs.flag_orphans(df, active).where("died").collect()] == ["r"]


def test_status_ladders(spark):
    assert one(spark, status.attempt_verdict(F.lit(True), F.lit(True), F.lit(True))) == "TIMEOUT"
    assert one(spark, status.attempt_verdict(F.lit(False), F.lit(True), F.lit(True))) == "ERROR"
    assert one(spark, status.status_verdict(F.lit("queued"))) == "ERROR"
    assert one(spark, status.known_tokens(F.lit(-1))) == "-"


@pytest.mark.parametrize("text,field,op,value", [
    ("any:created_at>=2026-07-01T00:00:00Z", "created_at", ">=", "2026-07-01T00:00:00Z"),
    ("all:url==http://x.y/z?a==b", "url", "==", "http://x.y/z?a==b"), ("amount <= 3", "amount", "<=", "3"),
])
def test_values_may_hold_colons_and_operators(text, field, op, value):
    rule = quality.invariant(text)
    assert (rule.field, rule.op, rule.value) == (field, op, value)


def test_quoted_csv_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note\n1,"a ""q"" b"\n2,"two\nlines"\n')
    got = {r.id: r.note for r in records.read_records(spark, str(tmp_path / "q.csv"), "csv").collect()}
    assert got == {"1": 'a "q" b', "2": "two\nlines"}


def test_unusable_patterns_give_the_unknown_count(spark):
    rows = [(i, e, "used 12, used 34") for i, e in enumerate(("good", "named", "broken", "group", "none"))]
    engines = [("good", r"used (\d+)", 1), ("named", r"used (?P<token_count>\d+)(?#total)", 1), ("broken", "([x", 1), ("group", "used", 2)]
    got = logs.scrape_by_table(
        spark.createDataFrame(rows, "id long, engine string, tail string"),
        spark.createDataFrame(engines, "engine string, token_regex string, token_group int"),
    )
    assert {r.engine: r.tokens for r in got.collect()} == {"good": 34, "named": 34, "broken": -1, "group": -1, "none": -1}


PATTERNS = [
    r"(?P<a_b>\d+)(?#note) (?P=a_b)", r"(\d+)(?#c)", r"(?i)TOTAL\s*=\s*([\d,]+)$", r"(?x) used \  (\d+) # end", r"(?m)^n: (\w+)$",
    r"[^x\W]+", r"[\D,]+", r"[^\d\S]+", r"[a&&b]+", r"[[a]+", r"(?:a|b(?:c))+?d", r"(?<=: )\S+", r"(?<!\d)\d{2}(?!\d)", r"(?s)n.(\d)",
    r"n.(\d)", r"\bend\Z", r"(?i:TOTAL) = (\d+)", r"(?a)\w+", r"(?>ab*)c", r"x*+y", "caf\u00e9|\\u00e9+", r"([\]\-^.])", r"\$(\d+)",
]
TEXT = "7 7\ntotal = 1,234\nused 55\nn: abc\nn\r9\n42 bcd &&a [a] x: caf\u00e9 \u0663 $8 ^-] abbc xxy\u00a0end"


def test_patterns_mean_what_they_meant(spark):
    for pattern in PATTERNS:
        written = patterns.java_pattern(pattern)
        groups = re.compile(pattern).groups
        found = spark.range(1).select(F.regexp_extract_all(F.lit(TEXT), F.lit(written), F.lit(min(groups, 1)))).first()[0]
        assert found == [m.group(min(groups, 1)) or "" for m in re.finditer(pattern, TEXT)], (pattern, written)
    assert [patterns.java_pattern(p) for p in ("([x", r"(a)?(?(1)b|c)", "a**")] == [None] * 3


def test_values_print_as_the_checks_print_them(spark):
    values = [0.0, -0.0, 1.5, 1e7, 12345678.9, -2.5e8, 1e15, 123456789012345.6, 1e16, 1.5e22, 1e-3, 1.25e-4, 1e-4, 9.9e-5, -1e-5, 1.5e-10, 1e100, 2.25e-300,
              float("inf"), float("-inf"), float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in rows.select(quality.plain_text(F.col("x"), rows.schema["x"].dataType)).collect()]
    assert got == [str(v) for v in values]
    flags = spark.createDataFrame([(True,), (False,), (None,)], "x boolean")
    assert [r[0] for r in flags.select(quality.plain_text(F.col("x"), flags.schema["x"].dataType)).collect()] == ["True", "False", None]


def test_words_end_at_any_blank(spark):
    text = "a\u00a0b\u3000c d\u2028e\x1ff\u200bg"
    assert one(spark, measures.spaced_words(F.lit(text))) == len(text.split()) == 6


def test_folders_of_documents(spark, tmp_path):
    """Files, their times, and what cannot be read."""
    folder = tmp_path / "runs"
    folder.mkdir()
    for name, body, at in (
        ("old", '{"run_id": "r1", "done": true, "tasks": []}', 100), ("new", '{"run_id": "r2",\n "done": false}', 300),
        ("mid", '{"run_id": "r3", "done": false}', 200), ("cut", '{"run_id": "r4"', 400), ("anon", '{"done": true}', 500),
    ):
        (folder / f"{name}.json").write_text(body)
        os.utime(folder / f"{name}.json", (at, at))
    (tmp_path / "active.json").write_text('{"r2": {"pid": 7}}')
    states = documents.read_run_states(spark, str(folder))
    active = documents.read_active_runs(spark, str(tmp_path / "active.json"))
    got = [(r.run_id, r.died) for r in runs.recent_runs(states, active, "modified", limit=2).orderBy(F.desc("modified")).collect()]
    assert got == [("r2", False), ("r3", True)]
    assert documents.read_active_runs(spark, str(tmp_path / "none.json")) is None
    assert documents.read_run_states(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "library.json").write_text('{"artifacts": {"job": {"state": "live", "versions": []}}}')
    assert [r.run_name for r in documents.read_library(spark, str(tmp_path / "library.json")).collect()] == ["job"]
    (tmp_path / "library.json").write_text("garbage")
    assert documents.read_library(spark, str(tmp_path / "library.json")).count() == 0


def test_an_override_of_the_notes_is_never_the_default(spark, tmp_path):
    (tmp_path / "notes.md").write_text("## model-a\n- 2026-01-01 fine\n")
    default = str(tmp_path / "notes.md")
    assert [r.heading for r in notes.sections(documents.read_notes(spark, default)).collect()] == ["model-a"]
    assert documents.read_notes(spark, default, str(tmp_path / "missing.md")).count() == 0


def test_report_is_one_document(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 2 else f"n{i}") for i in range(50)], "i int, name string").repartition(4).orderBy("i")
    storage.write_report({"rollup": rows, "groups": rows.limit(0)}, str(tmp_path / "r"))
    files = list((tmp_path / "r").glob("part-*"))
    assert len(files) == 1
    document = json.loads(files[0].read_text())
    assert list(document) == ["rollup", "groups"] and document["groups"] == []
    assert document["rollup"] == [{"i": i, "name": None if i % 2 else f"n{i}"} for i in range(50)]


def test_reject_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,why\n1,"two\nlines"\n\n2,b\n')
    (tmp_path / "r.jsonl").write_text('{"id": 1}\n  \n{"id": 2}\n\n{"id": 3}\n')
    (tmp_path / "empty.csv").write_text("")
    count = lambda name, **k: tuple(records.reject_counts(spark, name and str(tmp_path / name), **k).first())
    assert (count("r.csv"), count("r.jsonl"), count("empty.csv"), count(None)) == ((2, None), (3, None), (0, None), (0, None))
    assert count("gone.csv") == (0, None)
    assert count("gone.csv", require_file=True) == (0, f"missing rejects file: {tmp_path / 'gone.csv'}")


def test_logs_record_row_counts(spark):
    rows = [("a", "ROW COUNT 3"), ("b", "3 rows"), ("c", ""), ("d", None), ("e", "done")]
    found = {r.stage: r.finding for r in quality.log_findings(spark.createDataFrame(rows, "stage string, text string")).collect()}
    assert found == {"c": "missing or empty log", "d": "missing or empty log", "e": "no row counts"}

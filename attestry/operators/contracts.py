"""Bulk contract checks over documents, reports, transcripts and pages.

Every check is one projection: its rules become a small array of rule names and
the ones that hold are exploded, so a table of documents is read once and never
shuffled.  Clean documents give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import measures
from attestry.functions.measures import NON_WORD
from attestry.functions.values import trimmed


def findings(rows: DataFrame, ids: list[str], rules: list[tuple[str | Column, Column]]) -> DataFrame:
    """(ids..., rule) for every rule whose condition is true."""
    return exploded(rows.select(*ids, F.array(*judged(rules)).alias("_found")), "_found", "rule")


def exploded(rows: DataFrame, found: str, name: str) -> DataFrame:
    """The non-null elements of an array column, one a row.

    The array is a column of a projection of its own: only there does Spark compute what
    rules share (a lower-cased text, a count) once per row.  A plain explode would put a
    filter below that projection, which judges every rule a second time.
    """
    others = [c for c in rows.columns if c != found]
    return rows.select(*others, F.explode_outer(found).alias(name)).where(F.col(name).isNotNull())


def numbered(part: Column | int, rules: Column) -> Column:
    """Rule names as (part, rule), part 0 being the whole document."""
    place = F.lit(part) if isinstance(part, int) else part
    return F.transform(rules, lambda rule: F.struct(place.cast("int").alias("part"), rule.alias("rule")))


def of_whole(rules: list[tuple[str | Column, Column]]) -> Column:
    """(0, rule) for every rule of the whole document that holds, null for the others."""
    return F.array(*[F.when(rule.isNotNull(), F.struct(F.lit(0).alias("part"), rule.alias("rule"))) for rule in judged(rules)])


def part_findings(parts: Column, rules) -> Column:
    """(part, rule) for every part of an array, counted from 1; ``rules`` judges one part."""
    return F.flatten(F.transform(parts, lambda p, at: numbered(at + 1, violations(rules(p)))))


def judged(rules: list[tuple[str | Column, Column]]) -> list[Column]:
    """Each rule's name where its condition is true, else null."""
    return [F.when(bad, name if isinstance(name, Column) else F.lit(name)) for name, bad in rules]


def violations(rules: list[tuple[str | Column, Column]]) -> Column:
    return F.array_compact(F.array(*judged(rules)))


def matches(text: Column, pattern: str) -> Column:
    """Multi-line, case-blind search; only \\n ends a line."""
    return text.rlike("(?idm)" + pattern)


def headed(text: Column) -> Column:
    """The ``##`` sections of a document as (name in lower case, trimmed body), in order."""
    blocks = F.filter(F.split(text, r"(?dm)^(?=##\s)"), lambda b: b.rlike(r"^##\s"))
    return F.transform(
        blocks,
        lambda b: F.struct(
            F.lower(trimmed(F.regexp_extract(b, r"^##\s+([^\n]*)", 1))).alias("name"),
            trimmed(F.regexp_replace(b, r"^##\s+[^\n]*", "")).alias("body"),
        ),
    )


def section_names(sections: Column) -> Column:
    return F.transform(sections, lambda s: s["name"])


def lacks_heading(names: Column, heading: str) -> Column:
    return ~F.array_contains(names, heading.lower())


def has_title(text: Column, title: str) -> Column:
    return matches(text, rf"^#\s+{re.escape(title)}\s*$")


def contains_any_case(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def section(sections: Column, heading: str) -> Column:
    """Body of the first of the sections with that name; blank when absent."""
    named = F.filter(sections, lambda s: s["name"] == heading.lower())
    return F.when(sections.isNotNull(), F.coalesce(F.get(named, F.lit(0))["body"], F.lit("")))


def mentions_any(text: Column, words: list[str]) -> Column:
    """Some word of a list occurs anywhere in the text, in either case."""
    low = F.lower(text)
    return reduce(or_, [low.contains(w) for w in words])


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"\S")))


def has_placeholder(value: Column) -> Column:
    return value.contains("{{") | value.contains("}}")


# --- section contracts -------------------------------------------------------


@dataclass(frozen=True)
class Contract:
    """Title, sections, word bounds and patterns one kind of document must keep."""

    name: str
    title: str = ""
    headings: tuple[str, ...] = ()
    max_words: int = 0
    min_words: int = 0
    patterns: tuple[tuple[str, str], ...] = ()
    phrases: tuple[str, ...] = ()
    names_model: bool = False


GRADE = ("grade", r"\b(PASS|FAIL|MIXED)\b")

# Fixed contracts: what each kind of document must contain.
CONTRACTS = [
    Contract(
        "bakeoff", "Bakeoff Cell", ("Criteria Grades", "Evidence", "Failures Or Costs"), 1000,
        patterns=(("verdict", r"^VERDICT:\s*\S"), GRADE), names_model=True,
    ),
    Contract("reaction", "Persona Reaction", ("What Landed", "What Felt Wrong", "Would I Continue")),
    Contract(
        "evaluator-notes", "Evaluator Notes", ("Criteria Grades", "Evidence", "Assumptions"),
        patterns=(GRADE,), phrases=("evidence",),
    ),
    Contract(
        "fix-summary", "Fix Summary", ("Summary", "Files Changed", "Verification", "Assumptions"), 700
    ),
    Contract(
        "research", "Research Report",
        ("Summary", "Answer", "Evidence", "Uncertain", "Assumptions"), 1600,
        patterns=(("urls", r"https?://"), ("access-date", r"\bAccessed:\s*\d{4}-\d{2}-\d{2}\b")),
        phrases=("Claim:", "Source:", "Quoted Evidence:"),
    ),
    Contract("proof", "Executable Proof", ("Claim", "How To Run", "What It Proves", "Limits"), 900),
    Contract(
        "synthesis", min_words=400,
        phrases=(
            "## decision summary", "## comparison table", "## strongest evidence",
            "## gaps and could-not-fetch items", "## recommended follow-up",
        ),
    ),
]


def contract_rules(c: Contract, text: Column, names: Column) -> list[tuple[str, Column]]:
    rules: list[tuple[str, Column]] = []
    if c.max_words:
        rules.append(("too-long", measures.spaced_words(text) > c.max_words))
    if c.min_words:
        rules.append(("too-short", measures.bounded_words(text) < c.min_words))
    if c.title:
        rules.append(("title", ~has_title(text, c.title)))
    rules += [(f"section:{h}", lacks_heading(names, h)) for h in c.headings]
    rules += [(f"pattern:{name}", ~matches(text, p)) for name, p in c.patterns]
    rules += [(f"phrase:{p}", ~contains_any_case(text, p)) for p in c.phrases]
    if c.names_model:
        rules.append(("model-not-named", ~text.contains(F.col("expected_model"))))
    return rules


def section_contracts(documents: DataFrame, contracts: list[Contract] = CONTRACTS) -> DataFrame:
    """Findings of documents against the contract of their ``doc_type``; empty ones say so."""
    text, names = F.col("text"), F.col("_names")
    found = F.array().cast("array<string>")
    for c in contracts:
        found = F.when(F.col("doc_type") == c.name, F.array(*judged(contract_rules(c, text, names)))).otherwise(found)
    found = F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit("empty"))).otherwise(found)
    named = documents.withColumn("_names", section_names(headed(text)))
    return exploded(named.select("doc_id", "doc_type", found.alias("_found")), "_found", "rule")


def total_length(pairs: DataFrame, max_words: int = 1500) -> DataFrame:
    """Reaction and notes of a session together must stay below a word limit."""
    words = measures.spaced_words(F.concat("reaction", F.lit("\n"), "notes"))
    both = (F.col("reaction") != "") & (F.col("notes") != "")
    return findings(pairs, ["doc_id"], [("too-long", both & (words > max_words))])


# --- review reports ----------------------------------------------------------

REVIEW_HEADINGS = ["Summary", "Findings", "Clean", "Assumptions"]
REVIEW_FIELDS = ["Evidence:", "Impact:", "Fix:", "Priority:", "Confidence:"]
REVIEW_WORDS = 1200
SUMMARY_LINES = 3


def _finding_blocks(body: Column) -> Column:
    parts = F.filter(F.split(body, r"(?idm)(?=^###\s+Finding:)"), lambda b: b.rlike(r"\S"))
    return F.when(matches(body, r"^###\s+Finding:"), parts)


def _priority(block: Column) -> Column:
    return F.upper(F.regexp_extract(block, r"(?i)Priority:\s*(P[0-3])\b", 1))


def _confidence(block: Column) -> Column:
    return F.lower(F.regexp_extract(block, r"(?i)Confidence:\s*(high|medium|low)\b", 1))


def _file_line(block: Column) -> Column:
    return F.regexp_extract(block, r"\b([\w./-]+:\d+)\b", 1)


def review_blocks(reports: DataFrame) -> DataFrame:
    """Finding blocks of review reports with their parsed fields."""
    body = section(headed(F.col("text")), "Findings")
    rows = reports.withColumn("_body", body).select(
        "doc_id", F.posexplode(_finding_blocks(F.col("_body"))).alias("_pos", "block")
    )
    b = F.col("block")
    return rows.select(
        "doc_id", (F.col("_pos") + 1).alias("finding"), "block",
        _priority(b).alias("priority"), _confidence(b).alias("confidence"), _file_line(b).alias("evidence"),
    )


def _block_rules(b: Column) -> list[tuple[str, Column]]:
    return [
        *[(f"field:{f}", ~contains_any_case(b, f)) for f in REVIEW_FIELDS],
        ("no-file-line", b.contains("Evidence:") & (_file_line(b) == "")),
        ("priority", _priority(b) == ""),
        ("confidence", _confidence(b) == ""),
    ]


def _exploded(rows: DataFrame, part_name: str, *found: Column) -> DataFrame:
    """(doc_id, part, rule) of the (part, rule) arrays of each document."""
    none = F.array().cast("array<struct<part:int,rule:string>>")
    every = F.concat(*[F.coalesce(f, none) for f in found])
    return exploded(rows.select("doc_id", every.alias("_found")), "_found", "_f").select(
        "doc_id", F.col("_f.part").alias(part_name), F.col("_f.rule").alias("rule")
    )


def review_findings(reports: DataFrame) -> DataFrame:
    """Report-level findings (finding 0) and block-level ones (finding 1, 2, ...).

    A report is read and parsed once: its sections are bound first, then the rules of
    the whole and of every block are judged inside the row.
    """
    text, sections, body = F.col("text"), F.col("_sections"), F.col("_body")
    rows = (
        reports.withColumn("_sections", headed(text))
        .withColumn("_body", section(sections, "Findings"))
        .withColumn("_names", section_names(sections))
    )
    explicit = matches(body, r"^###\s+Finding:") | contains_any_case(body, "no findings")
    whole = of_whole(
        [
            ("too-long", measures.spaced_words(text) > REVIEW_WORDS),
            ("title", ~has_title(text, "Review Report")),
            *[(f"section:{h}", lacks_heading(F.col("_names"), h)) for h in REVIEW_HEADINGS],
            ("summary-too-long", nonblank_lines(section(sections, "Summary")) > SUMMARY_LINES),
            ("findings-empty", body == ""),
            ("findings-not-explicit", (body != "") & ~explicit),
        ]
    )
    return _exploded(rows, "finding", whole, part_findings(_finding_blocks(body), _block_rules))


STRICT_LABELS = ["Finding", "Evidence", "Impact", "Fix", "Priority", "Confidence"]
EVIDENCE_CHARS = 20
# Fixed phrases: what a reviewer who changed the code says.
EDIT_CLAIMS = [
    "i fixed", "i patched", "i committed", "i pushed", "i modified",
    "patched the", "committed the", "pushed the",
]


def claims_edit(text: Column) -> Column:
    """Two neighbouring words, with nothing but blanks between them, claim an edit."""
    low = F.lower(text)
    # Only words that begin a claim are looked at, each with the word behind it.
    firsts = "|".join(sorted({c.split()[0] for c in EDIT_CLAIMS}))
    neighbours = F.lit(rf"(?U)\b({firsts})\s++(?=(\w++))")
    pairs = F.zip_with(
        F.regexp_extract_all(low, neighbours, F.lit(1)), F.regexp_extract_all(low, neighbours, F.lit(2)),
        lambda first, second: F.concat(first, F.lit(" "), second),
    )
    return F.arrays_overlap(pairs, F.array(*[F.lit(c) for c in EDIT_CLAIMS]))


def labelled(block: Column) -> Column:
    """The labelled paragraphs of a block as (label in lower case, body, whole), in order.

    A label is two or more letters and blanks before a colon at the start of a line.
    """
    return F.transform(
        F.split(block, r"\n(?=[A-Za-z][A-Za-z ]+\s*:)"),
        lambda part: F.struct(
            F.lower(trimmed(F.substring_index(part, ":", 1))).alias("label"),
            F.regexp_replace(part, r"\A[^:]*:", "").alias("body"), part.alias("whole"),
        ),
    )


def _strict_rules(parts: Column) -> list[tuple[str, Column]]:
    """Rules of one finding; a label with nothing behind it speaks for the next paragraph."""
    labels = F.transform(parts, lambda p: p["label"])

    def some(label: str, pattern: str) -> Column:
        return F.exists(parts, lambda p: (p["label"] == label) & p["body"].rlike(pattern))

    at = F.array_position(labels, "evidence").cast("int")
    own = F.get(parts, at - 1)["body"]
    evidence = F.when(at > 0, F.when(trimmed(own) != "", own).otherwise(F.coalesce(F.get(parts, at)["whole"], own)))
    return [
        *[(f"label:{name}", ~F.array_contains(labels, name.lower())) for name in STRICT_LABELS],
        ("priority", ~some("priority", r"(?i)^\s*P[0-3]\b")),
        ("confidence", ~some("confidence", r"(?i)^\s*(high|medium|low)\b")),
        ("thin-evidence", (evidence != "") & (F.char_length(trimmed(evidence)) < EVIDENCE_CHARS)),
    ]


def strict_review_findings(reports: DataFrame) -> DataFrame:
    """Block-label variant: every ``Finding:`` block needs all labels and solid evidence."""
    text, blocks = F.col("text"), F.col("_blocks")
    parts = F.split(text, r"(?idm)^Finding\s*:\s*")
    rows = reports.withColumn(
        "_blocks",
        F.transform(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            lambda b: labelled(F.concat(F.lit("Finding: "), b)),
        ),
    )
    whole = of_whole(
        [
            ("section:Summary", ~matches(text, r"^#+\s*summary\b")),
            ("nothing-stated", (F.size(blocks) == 0) & ~matches(text, r"\bNO FINDINGS\b")),
            ("claims-edit", claims_edit(text)),
        ]
    )
    return _exploded(rows, "finding", whole, part_findings(blocks, _strict_rules))


def claims_of_edits(reports: DataFrame) -> DataFrame:
    return reports.where(claims_edit(F.col("text"))).select("doc_id")


# --- documentation files -----------------------------------------------------

HEADING_BLOCK = r"(?dm)(?=^#{1,6}[^\S\n]+[^\n])"
HEADING_LINE = r"^#{1,6}[^\S\n]+([^\n]+)"


def slug(heading: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", " "))


def doc_blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, slug, body) per heading block, any level."""
    blocks = F.filter(F.split("text", HEADING_BLOCK), lambda b: b.rlike(HEADING_LINE))
    rows = documents.select("doc_id", F.posexplode(blocks).alias("pos", "_b"))
    return rows.select(
        "doc_id", "pos", slug(F.regexp_extract("_b", HEADING_LINE, 1)).alias("slug"),
        F.regexp_replace("_b", HEADING_LINE, "").alias("body"),
    )


def section_words(documents: DataFrame) -> DataFrame:
    """Words per section; blocks under the same heading text are one section."""
    return doc_blocks(documents).groupBy("doc_id", "slug").agg(
        F.sum(measures.token_words(F.col("body"))).alias("words")
    )


def heading_blocks(text: Column) -> Column:
    """Heading blocks of any level as (slug, body), in order."""
    return F.transform(
        F.filter(F.split(text, HEADING_BLOCK), lambda b: b.rlike(HEADING_LINE)),
        lambda b: F.struct(
            slug(F.regexp_extract(b, HEADING_LINE, 1)).alias("slug"),
            F.regexp_replace(b, HEADING_LINE, "").alias("body"),
        ),
    )


def _slug_of(name: str) -> str:
    return " ".join(re.sub("[^a-z0-9]+", " ", name.lower()).split())


def _blocks_of(blocks: Column, target: str) -> Column:
    return F.filter(blocks, lambda b: b["slug"] == target)


def symbols_of(blocks: Column, section_name: str, allowlist: list[str] = ()) -> Column:
    """Code spans of the first run of symbol-section blocks, URLs and allowed ones left out."""
    target = _slug_of(section_name)
    hits = F.transform(blocks, lambda b: b["slug"] == target)
    # First hit, then the run of hits that follows it without a break.
    first = F.array_position(hits, True).cast("int")
    after = F.slice(hits, F.greatest(first, F.lit(1)), F.size(hits))
    stop = F.array_position(after, False).cast("int")
    length = F.when(first == 0, 0).when(stop > 0, stop - 1).otherwise(F.size(after))
    run = F.slice(blocks, F.greatest(first, F.lit(1)), length)
    body = F.array_join(F.transform(run, lambda b: b["body"]), "\n")
    spans = F.transform(
        F.regexp_extract_all(body, F.lit("`([^`\\n]+)`"), F.lit(1)),
        lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    )
    skip = F.array(*[F.lit(a) for a in allowlist]) if allowlist else F.array().cast("array<string>")
    return F.filter(
        F.array_distinct(spans),
        lambda s: (s != "") & ~s.startswith("http://") & ~s.startswith("https://")
        & ~F.array_contains(skip, s),
    )


def symbol_spans(documents: DataFrame, section_name: str, allowlist: list[str] = ()) -> DataFrame:
    """(doc_id, symbol) for every documented symbol."""
    rows = documents.withColumn("_blocks", heading_blocks(F.col("text")))
    return rows.select("doc_id", F.explode(symbols_of(F.col("_blocks"), section_name, allowlist)).alias("symbol"))


def fenced_blocks(text: Column, language: str) -> Column:
    """Number of fenced blocks labelled with the language."""
    infos = F.regexp_extract_all(text, F.lit(r"(?ds)```([^\n`]*)\n(?:.*?)\n```"), F.lit(1))
    labels = F.transform(infos, lambda i: F.lower(F.regexp_extract(i, r"^\s*(\S+)", 1)))
    return F.size(F.filter(labels, lambda x: x == language.strip().lower()))


def doc_sections(
    documents: DataFrame, required: list[str], min_words: int, min_section_words: int,
    symbol_section: str, language: str, allowlist: list[str] = (), missing: DataFrame | None = None,
) -> DataFrame:
    """Findings of documentation files, evaluated inside each row.

    ``allowlist`` names symbols that count neither as documented nor as missing.
    ``missing`` (doc_id, symbol), as ``scope.missing_symbols`` gives it, adds a finding
    ``unknown-symbol:NAME`` for every documented symbol no source file holds.
    """
    text, blocks = F.col("text"), F.col("_blocks")
    rows = documents.withColumn("_blocks", heading_blocks(text))
    rules: list[tuple[str, Column]] = [("too-short", measures.token_words(text) < min_words)]
    for name in required:
        mine = _blocks_of(blocks, _slug_of(name))
        words = F.aggregate(mine, F.lit(0), lambda total, b: total + measures.token_words(b["body"]))
        rules.append((f"section:{name}", F.size(mine) == 0))
        rules.append((f"thin:{name}", (F.size(mine) > 0) & (words < min_section_words)))
    rules.append((f"no-example:{language}", fenced_blocks(text, language) == 0))
    rules.append(("no-symbols", F.size(symbols_of(blocks, symbol_section, allowlist)) == 0))
    whole = findings(rows, ["doc_id"], rules)
    if missing is None:
        return whole
    named = missing.where(~F.col("symbol").isin(list(allowlist))) if allowlist else missing
    return whole.unionByName(named.select("doc_id", F.concat(F.lit("unknown-symbol:"), "symbol").alias("rule")))


# --- probe transcripts -------------------------------------------------------

POSTMORTEM_MARKERS = [
    "failure observed:", "evidence:", "likely cause:", "next check:", "verdict:",
]
RESPONSE_MARKERS = ["MODEL RESPONSE:", "ASSISTANT:", "RESPONSE:"]


def opens_section(line: Column) -> Column:
    """A line that starts a new part: a second-level heading, or a label in capitals."""
    label = F.substring_index(line, ":", 1)
    capitals = (F.char_length(label) >= 4) & (F.regexp_replace(label, "[A-Z _-]+", "") == "") & label.rlike("^[A-Z]")
    return line.rlike(r"^##(\s|$)") | (line.contains(":") & capitals)


def after_marker(text: Column, marker: str) -> Column:
    """Text after a marker, trimmed, up to the next line that opens a section.

    The line the text starts in never ends it; blank when there is no marker.
    """
    rest = trimmed(F.get(F.split(text, "(?i)" + re.escape(marker), 2), F.lit(1)))
    lines = F.split(rest, "\n")
    ends = F.array_position(F.transform(lines, lambda line, at: (at > 0) & opens_section(line)), True).cast("int")
    kept = F.when(ends > 0, F.slice(lines, F.lit(1), ends - 1)).otherwise(lines)
    return F.coalesce(trimmed(F.array_join(kept, "\n")), F.lit(""))


def probe_transcripts(
    transcripts: DataFrame, min_response_chars: int = 120, must_contain: str = "NONE"
) -> DataFrame:
    """Mode rules over (tid, mode, transcript, output)."""
    transcript = F.col("transcript")
    combined = F.lower(F.concat("transcript", F.lit("\n"), "output"))
    low = F.lower(transcript)
    mode = F.col("mode")
    response = F.coalesce(
        *[F.nullif(after_marker(transcript, m), F.lit("")) for m in RESPONSE_MARKERS], F.lit("")
    )
    model, api = mode == "model", mode == "api"
    answered = model & (response != "")
    rules: list[tuple[str, Column]] = []
    if must_contain.strip() and must_contain.strip().upper() != "NONE":
        rules.append(("marker", ~combined.contains(must_contain.strip().lower())))
    rules += [
        ("no-response", model & (response == "")),
        ("short-response", answered & (measures.visible_chars(response) < min_response_chars)),
        ("no-prompt", answered & ~low.contains("prompt:") & ~low.contains("commands run")),
        ("error-unexplained", answered & combined.contains("error") & ~low.contains("model response")),
        (
            "no-status",
            api & ~combined.contains("http_status:")
            & ~combined.rlike(r"\bstatus(?: code)?:\s*\d{3}"),
        ),
        ("no-behavior", api & ~low.contains("observed behavior:")),
        ("no-verdict", api & ~low.contains("verdict:")),
        *[
            (f"postmortem:{m}", (mode == "postmortem") & ~low.contains(m))
            for m in POSTMORTEM_MARKERS
        ],
        (
            "generic-empty",
            (mode == "generic") & ~low.contains("observed behavior") & ~low.contains("verdict:"),
        ),
    ]
    return findings(transcripts, ["tid", "mode"], rules)


# --- web pages ---------------------------------------------------------------

# Fixed words: image types a page may embed, attributes that load or link, words that
# admit what is unfinished, that answer an objection, or that a draft left behind.
IMAGE_TYPES = ["jpeg", "jpg", "png", "webp"]
LINK_ATTRIBUTES = ["src", "href"]
HONEST_WORDS = ["draft", "tbd", "placeholder", "assumption", "coming soon", "to be measured"]
FINAL_HONEST_WORDS = ["draft", "tbd", "placeholder", "coming soon", "to be measured"]
TRUST_WORDS = ["objection", "small print", "refund", "replace", "trust", "guarantee"]
TRUST_SPELLINGS = ["make.it.right"]
LEFTOVER_WORDS = ["working title", "placeholder brand"]
PRICE_WORDS = ["price", "pricing", "offer"]


def embedded_images(html: Column) -> Column:
    """Number of images embedded as data URIs of a known type."""
    types = F.regexp_extract_all(html, F.lit("(?i)data:image/([a-z]+);base64,"), F.lit(1))
    return F.size(F.filter(types, lambda t: F.lower(t).isin(IMAGE_TYPES)))


def linked(html: Column) -> Column:
    """Absolute URLs that a quoted link attribute holds, in order.

    The page is cut at its quotes: a value is the piece behind ``name =``.
    """
    pieces = F.split(html, "[\"']")
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    values = F.slice(pieces, F.lit(2), F.size(pieces))

    def holds_link(name: Column) -> Column:
        assigned = trimmed(name)
        left = F.lower(trimmed(F.left(assigned, F.char_length(assigned) - 1)))
        return F.endswith(assigned, F.lit("=")) & F.exists(
            F.array(*[F.lit(a) for a in LINK_ATTRIBUTES]), lambda a: F.endswith(left, a)
        )

    return F.array_compact(
        F.zip_with(before, values, lambda name, value: F.when(value.rlike("(?is)^https?://.") & holds_link(name), value))
    )


@dataclass(frozen=True)
class Site:
    """What a page must carry."""

    min_bytes: int = 0
    min_images: int = 0
    terms: tuple[str, ...] = ()
    brand: str = ""
    tagline: str = ""
    palette: tuple[str, ...] = field(default_factory=tuple)
    pitch: str = ""


def page_contract(pages: DataFrame, site: Site) -> DataFrame:
    """First-round page rules: self-contained, honest, with a way to order."""
    html = F.col("html")
    return findings(
        pages, ["page_id"],
        [
            *_media_rules(html, site),
            *[(f"term:{t}", ~contains_any_case(html, t)) for t in site.terms],
            ("no-form", ~contains_any_case(html, "<form") & ~contains_any_case(html, "interest")),
            ("no-honesty", ~mentions_any(html, HONEST_WORDS)),
        ],
    )


def final_page_contract(pages: DataFrame, site: Site) -> DataFrame:
    """Final page rules: brand, palette, winning pitch, wordmark and trust copy."""
    html = F.col("html")
    rules: list[tuple[str, Column]] = [("brand", ~contains_any_case(html, site.brand))]
    if site.tagline:
        rules.append(("tagline", ~contains_any_case(html, site.tagline)))
    rules += [(f"color:{c}", ~contains_any_case(html, c)) for c in site.palette]
    if site.pitch:
        rules.append(("pitch", ~contains_any_case(html, site.pitch)))
    rules += [
        ("leftover", mentions_any(html, LEFTOVER_WORDS)),
        *_media_rules(html, site),
        ("no-svg", ~contains_any_case(html, "<svg")),
        ("no-honesty", ~mentions_any(html, FINAL_HONEST_WORDS)),
        (
            "no-trust",
            ~mentions_any(html, TRUST_WORDS) & ~F.lower(html).rlike("|".join(TRUST_SPELLINGS)),
        ),
    ]
    return findings(pages, ["page_id"], rules)


def _media_rules(html: Column, site: Site) -> list[tuple[str, Column]]:
    return [
        ("too-small", F.octet_length(html) < site.min_bytes),
        ("few-images", embedded_images(html) < site.min_images),
        ("external", F.size(linked(html)) > 0),
    ]


def external_urls(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.array_distinct(linked(F.col("html")))).alias("url"))


# --- copy documents ----------------------------------------------------------

SEP = r"[:\-—]"
HEX = r"#[0-9a-fA-F]{6}\b"


def _labels(text: Column, label: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?idm)^{NON_WORD}*{label}\\s*{SEP}\\s*(.+)$"), F.lit(1))


def _picked(text: Column) -> Column:
    return matches(text, rf"^{NON_WORD}*my pick\s*{SEP}")


def _parts(text: Column, word: str) -> Column:
    pieces = F.split(text, rf"(?idm)^#+\s*(?:\d+[\).]?\s*)?{word}\b")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))


def _candidate_rules(text: Column) -> Column:
    """Names, pitches, taglines and a pick."""
    pitches = _labels(text, r"pitch\s*[abc123]")
    taglines = F.regexp_extract_all(
        text, F.lit(f"(?idm)^{NON_WORD}*tagline\\b[^:\\-\\u2014]*{SEP}\\s*(.+)$"), F.lit(1)
    )
    wordy = F.exists(
        F.slice(pitches, F.lit(1), F.lit(3)), lambda p: measures.spaced_words(p) > 30
    )
    rules = [
        ("names", F.size(_labels(text, r"name\s*\d*")) < 8),
        ("pitches", F.size(pitches) < 3), ("pitch-too-long", wordy),
        ("taglines", F.size(taglines) < 3), ("no-pick", ~_picked(text)),
    ]
    return of_whole(rules)


def _board_rules(text: Column, parts: Column) -> Column:
    """Three directions with colors, type and reasons, and a pick."""

    def direction(p: Column) -> list[tuple[str, Column]]:
        return [
            ("colors", measures.count(p, HEX) < 4),
            ("headline-type", ~matches(p, r"headline\s*(type|font)")),
            ("body-type", ~matches(p, r"body\s*(type|font)")),
            ("why", ~matches(p, r"why\s*(it\s*fits|this)")),
        ]

    whole = of_whole([("directions", F.size(parts) < 3), ("no-pick", ~_picked(text))])
    return F.concat(whole, part_findings(parts, direction))


def _colors(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), F.upper))


def _kit_rules(text: Column, colors: Column, brand: str, tagline: str, palette: list[str]) -> Column:
    """Brand, tagline, palette, type, wordmark and price of a brand kit."""
    svg = F.regexp_extract(text, r"(?i)(<svg[\s\S]*?</svg>)", 1)
    rules: list[tuple[str, Column]] = [("brand", ~contains_any_case(text, brand))]
    if tagline:
        rules.append(("tagline", ~contains_any_case(text, tagline)))
    rules += [
        *[(f"color:{c.upper()}", ~F.array_contains(colors, c.upper())) for c in palette],
        ("few-colors", F.size(colors) < 4),
        ("type-section", ~matches(text, r"^#+\s*(?:\d+[\).]?\s*)?(type|typography)\b")),
        ("no-svg", svg == ""),
        ("svg-without-brand", (svg != "") & ~contains_any_case(svg, brand)),
        ("no-pricing", ~mentions_any(text, PRICE_WORDS)),
    ]
    return of_whole(rules)


def _listing_rules(text: Column, parts: Column) -> Column:
    """Three products with title and bullets; honest, long enough, with an about part."""

    def product(p: Column) -> Column:
        return F.struct(
            F.regexp_extract(p, f"(?idm)^{NON_WORD}*title\\s*{SEP}\\s*(.+)$", 1).alias("title"),
            measures.count(p, r"(?dm)^\s*[-*]\s+\S").alias("bullets"),
        )

    def rules(p: Column) -> list[tuple[str, Column]]:
        return [
            ("no-title", p["title"] == ""), ("title-too-long", F.char_length(p["title"]) > 140), ("bullets", p["bullets"] < 3),
        ]

    whole = of_whole(
        [
            ("products", F.size(parts) < 3), ("too-short", measures.spaced_words(text) < 250),
            ("no-honesty", ~mentions_any(text, HONEST_WORDS)), ("no-about", ~matches(text, r"^#+\s*about")),
        ]
    )
    return F.concat(whole, part_findings(F.transform(F.slice(parts, F.lit(1), F.lit(3)), product), rules))


def _read(documents: DataFrame, *wanted: str) -> DataFrame:
    """What the rules of copy documents share, found once per text: parts and colors."""
    text = F.col("text")
    found = {"_directions": _parts(text, "direction"), "_products": _parts(text, "product"), "_colors": _colors(text)}
    return documents.withColumns({name: found[name] for name in wanted})


def candidate_copy(documents: DataFrame) -> DataFrame:
    return _exploded(documents, "part", _candidate_rules(F.col("text"))).drop("part")


def brand_board(documents: DataFrame) -> DataFrame:
    return _exploded(_read(documents, "_directions"), "part", _board_rules(F.col("text"), F.col("_directions")))


def brand_kit(documents: DataFrame, brand: str, tagline: str, palette: list[str]) -> DataFrame:
    rules = _kit_rules(F.col("text"), F.col("_colors"), brand, tagline, palette)
    return _exploded(_read(documents, "_colors"), "part", rules).drop("part")


def listing_copy(documents: DataFrame) -> DataFrame:
    return _exploded(_read(documents, "_products"), "part", _listing_rules(F.col("text"), F.col("_products")))


def palette_coverage(documents: DataFrame, palette: list[str]) -> DataFrame:
    """Required colors a document does not show."""
    colors = _colors(F.col("text"))
    absent = measures.missing([c.upper() for c in palette], colors)
    return documents.select("doc_id", F.explode(absent).alias("color"))


# Fixed fields of a persona reaction and what each may hold.
PERSONA_FIELDS = {
    "VERDICT": r"(?:BUY|MAYBE|PASS)\b.*", "PITCH": r"[ABC]\b.*", "NAME": ".+",
    "WOULD PAY": r"\$?\d+.*", "WHERE": ".+", "TOP OBJECTION": ".+",
}


def persona_fields(documents: DataFrame) -> DataFrame:
    """The six labelled fields as columns; NULL when not parseable."""
    def value(name: str, pattern: str) -> Column:
        found = F.regexp_extract(
            "text", f"(?idm)^{NON_WORD}*{name}\\s*{SEP}\\s*({pattern})\\s*$", 1
        )
        return F.nullif(F.regexp_replace(found, r"^\s+|\s+$", ""), F.lit(""))

    columns = [
        value(name, pattern).alias(name.lower().replace(" ", "_"))
        for name, pattern in PERSONA_FIELDS.items()
    ]
    verdict = F.upper(F.regexp_extract("verdict", r"(?i)^(BUY|MAYBE|PASS)\b", 1))
    keep = [c for c in documents.columns if c != "text"]
    return documents.select(
        *keep, measures.spaced_words(F.col("text")).alias("words"), *columns
    ).withColumn("choice", F.nullif(verdict, F.lit("")))


def persona_findings(documents: DataFrame, min_words: int) -> DataFrame:
    parsed = persona_fields(documents)
    names = [n.lower().replace(" ", "_") for n in PERSONA_FIELDS]
    return findings(
        parsed, ["doc_id"],
        [("too-short", F.col("words") < min_words)] + [(f"field:{n}", F.col(n).isNull()) for n in names],
    )


def verdict_distribution(parsed: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Verdict counts per cell of a scenario × model matrix, one column per verdict."""
    counts = [
        F.count_if(F.col("choice") == value).alias(value.lower()) for value in values
    ]
    return parsed.groupBy(rows, columns).agg(*counts, F.count("*").alias("total"))


def placeholders(rows: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Fields that still hold an unfilled template placeholder."""
    found = F.array_compact(F.array(*[F.when(has_placeholder(F.col(f)), F.lit(f)) for f in fields]))
    return rows.select(*ids, F.explode(found).alias("field"))


def research_evidence(documents: DataFrame) -> DataFrame:
    """Evidence half of the research contract."""
    research = next(c for c in CONTRACTS if c.name == "research")
    text = F.col("text")
    rules = [(f"pattern:{n}", ~matches(text, p)) for n, p in research.patterns]
    rules += [(f"phrase:{p}", ~contains_any_case(text, p)) for p in research.phrases]
    return findings(documents, ["doc_id"], rules)


def copy_contracts(
    documents: DataFrame, brand: str, tagline: str, palette: list[str]
) -> DataFrame:
    """All copy checks over one table: (kind, doc_id, part, rule); each text is read once."""
    text = F.col("text")
    checks = {
        "candidates": _candidate_rules(text), "brand_board": _board_rules(text, F.col("_directions")),
        "brand_kit": _kit_rules(text, F.col("_colors"), brand, tagline, palette),
        "listing": _listing_rules(text, F.col("_products")),
    }
    none = F.array().cast("array<struct<part:int,rule:string>>")
    kinds = F.array(
        *[F.struct(F.lit(kind).alias("kind"), F.coalesce(rules, none).alias("found")) for kind, rules in checks.items()]
    )
    rows = _read(documents, "_directions", "_products", "_colors").select("doc_id", kinds.alias("_kinds"))
    each = exploded(rows, "_kinds", "_k").select("doc_id", F.col("_k.kind").alias("kind"), F.col("_k.found").alias("_found"))
    return exploded(each, "_found", "_f").select("kind", "doc_id", "_f.part", "_f.rule")

"""Document, report and page contract queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from attestry.functions import measures, urls
from attestry.operators import contracts, links, reports
from attestry.registry.base import ORACLES, query

WORDS = "len(regexp_extract_all({t}, '[^" + measures.BLANKS.replace("{", "{{").replace("}", "}}") + "]+'))"
BOUNDED = r"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?'))"
TOKENS = r"len(regexp_extract_all({t}, '[A-Za-z0-9_''-]+'))"
NW = r"[^\p{L}\p{N}_]"
SEP = "[:\\-—]"


def hit(text: str, pattern: str, flags: str = "im") -> str:
    escaped = pattern.replace("'", "''")
    return f"regexp_matches({text}, '(?{flags}){escaped}')"


def rules_sql(table: str, ids: str, rules: list[tuple[str, str]]) -> str:
    """The check SQL's form of a rule list: one pass per rule, united."""
    return " union all ".join(
        f"select {ids}, '{name.replace(chr(39), chr(39) * 2)}' as rule from {table} where {cond}"
        for name, cond in rules
    )


def no(condition: str) -> str:
    return f"not ({condition})"


def has(text: str, part: str) -> str:
    return f"contains(lower({text}), '{part.lower()}')"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(has(text, w) for w in words) + ")"


# Two words with blanks between them, anywhere in a text.
CLAIMS = "(?:" + "|".join(c.replace(" ", r"\s+") for c in contracts.EDIT_CLAIMS) + ")"

DOCS = "documents"


@query("text_measures", rf"""select doc_id, {WORDS.format(t='text')} as spaced_words, {TOKENS.format(t='text')} as token_words,
 {BOUNDED.format(t='text')} as bounded_words, octet_length(encode(text)) as bytes, len(string_split(text, chr(10))) as lines,
 length(regexp_replace(text, '[{measures.BLANKS}]+', '', 'g')) as visible_chars
 from (select doc_id, concat(text, chr(160), 'one', chr(12288), 'two', chr(31), '3') as text from documents)""")
def _(v):
    """Texts with blanks beyond ASCII at their end."""
    t = F.concat("text", F.lit("\u00a0one\u3000two\x1f3"))
    return v.table(DOCS).select(
        "doc_id", measures.spaced_words(t).alias("spaced_words"),
        measures.token_words(t).alias("token_words"), measures.bounded_words(t).alias("bounded_words"),
        F.octet_length(t).alias("bytes"), measures.lines(t).alias("lines"),
        measures.visible_chars(t).alias("visible_chars"),
    )


UNIT = "(?:%|percent|x|k|m|b|million|billion|ms|s|seconds|minutes|hours|days|users|customers|requests|rows|records|gb|mb)?"


@query("numeric_facts", rf"""with m as (select report_id, regexp_extract_all(regexp_replace(text, '([A-Za-z])([$€£0-9])', '\1' || chr(1) || '\2', 'g'),
  chr(1) || '?[$€£]?\d[\d,]*(?:\.\d+)?\s?(?i:{UNIT})') as ms from cited_reports),
 f as (select report_id, list_transform(ms, lambda x: case when starts_with(x, chr(1)) then regexp_extract(x[3:], '(?s)[0-9].*') else x end) as fs from m)
 select report_id, len(list_distinct(list_filter(fs, lambda x: x <> ''))) as facts from f""", ("cited_reports",))
def _(v):
    return v("cited_reports").select(
        "report_id", F.size(measures.numeric_facts(F.col("text"))).alias("facts")
    )


URL_SQL = r"""list_distinct(list_transform(regexp_extract_all({t}, '(?i)https?://[^\s)\\\]"''<>]+'), lambda u: regexp_replace(u, '[.,;:!?)\]}}''"]+$', '')))"""
CITED = f"cited as (select report_id, unnest({URL_SQL.format(t='text')}) as url from cited_reports)"
NORM = r"""norm as (select distinct side, url, lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) as host,
  regexp_replace(regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') as path,
  regexp_replace(regexp_extract(url, '(?i)^https?://[^?#]*\?([^#]*)', 1), '&+$', '') as q
  from (select 'c' as side, url from cited union all select 'a', url from allowlist))"""
OUTSIDE = rf"""{CITED}, {NORM}, outside as (select url from norm c where side = 'c' and not exists (select 1 from norm a where a.side = 'a' and a.host = c.host
  and (a.q = '' or c.q = '' or a.q = c.q) and (a.path = c.path or (length(trim(case when length(c.path) <= length(a.path) then c.path else a.path end, '/')) >= 8
   and (starts_with(a.path, c.path) or starts_with(c.path, a.path))))))"""


@query("url_extract_normalise", rf"""with {CITED} select report_id, url, concat(lower(regexp_extract(url, '(?i)^(https?)', 1)), '://', lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)),
 regexp_replace(regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', ''),
 regexp_replace(regexp_extract(url, '(?i)^https?://[^?#]*(\?[^#]+)', 1), '&+$', '')) as normal from cited""", ("cited_reports",))
def _(v):
    return links.cited_urls(v("cited_reports")).withColumn("normal", urls.normalised(F.col("url")))


@query("url_allowlist", f"with {OUTSIDE} select url from outside", ("cited_reports", "allowlist"))
def _(v):
    return links.outside_allowlist(links.cited_urls(v("cited_reports")), v("allowlist"))


@query("urls_subset_of_sources", f"""with s as (select report_id, group_id, unnest({URL_SQL.format(t='text')}) as url from synthesis_reports),
 k as (select distinct group_id, unnest({URL_SQL.format(t='text')}) as url from cited_reports)
 select group_id, url, report_id from s where not exists (select 1 from k where k.group_id = s.group_id and k.url = s.url)""", ("synthesis_reports", "cited_reports"))
def _(v):
    return links.new_urls(v("synthesis_reports"), v("cited_reports"))


FACTS = """nf as (select report_id, len(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '([A-Za-z])([$€£0-9])', '\\1' || chr(1) || '\\2', 'g'),
  chr(1) || '?[$€£]?\\d[\\d,]*(?:\\.\\d+)?\\s?(?i:UNIT)'), lambda x: case when starts_with(x, chr(1)) then regexp_extract(x[3:], '(?s)[0-9].*') else x end), lambda x: x <> ''))) as n from cited_reports)""".replace("UNIT", UNIT)


@query("teardown_report", f"with {OUTSIDE}, {FACTS} " + rules_sql("cited_reports", "report_id", [
    ("few-citations", f"len({URL_SQL.format(t='text')}) < 4"), ("too-short", BOUNDED.format(t="text") + " < 500"),
    ("few-numbers", "report_id in (select report_id from nf where n < 3)"), ("angle:pricing", no(has("text", "pricing"))),
    *[(f"section:{s}", no(has("text", s))) for s in reports.TEARDOWN_SECTIONS],
    ("no-fetch-status", no(has("text", "could not fetch") + " or " + has("text", "fetched"))),
    ("outside-allowlist", "report_id in (select report_id from cited join outside using (url))"),
]), ("cited_reports", "allowlist"))
def _(v):
    return reports.teardown_report(
        v("cited_reports"), v("allowlist"), angles=["pricing"], min_citations=4
    )


MARKET = rf"""mc as (select report_id, unnest(list_distinct(list_transform(regexp_extract_all(text, 'https?://\S+'), lambda u: regexp_replace(u, '[.,);\]]+$', '')))) as url from cited_reports),
 bad as (select distinct url from mc where not exists (select 1 from allowlist a where rtrim(a.url, '/') = rtrim(mc.url, '/')
  or ((starts_with(rtrim(a.url, '/'), rtrim(mc.url, '/')) or starts_with(rtrim(mc.url, '/'), rtrim(a.url, '/'))) and least(length(rtrim(a.url, '/')), length(rtrim(mc.url, '/'))) >= 34))),
 tl as (select report_id, count(*) filter (where url not in (select url from bad)) as good, count(*) filter (where url in (select url from bad)) as wrong from mc group by report_id),
 mr as (select c.*, coalesce(good, 0) as good, coalesce(wrong, 0) as wrong from cited_reports c left join tl using (report_id))"""


@query("market_report", f"with {MARKET} " + rules_sql("mr", "report_id", [
    ("too-short", WORDS.format(t="text") + " < 400"), ("few-citations", "good < 2"), ("outside-allowlist", "wrong > 0"),
    ("term:pricing", no(has("text", "pricing"))), ("term:Source Log", no(has("text", "source log"))),
]), ("cited_reports", "allowlist"))
def _(v):
    return reports.market_report(
        v("cited_reports"), v("allowlist"), ["pricing", "Source Log"], min_words=400, min_citations=2
    )


def _contract_sql() -> str:
    parts = ["select doc_id, doc_type, 'empty' as rule from contract_docs where text = ''"]
    for c in contracts.CONTRACTS:
        rules: list[tuple[str, str]] = []
        if c.max_words:
            rules.append(("too-long", f"{WORDS.format(t='text')} > {c.max_words}"))
        if c.min_words:
            rules.append(("too-short", f"{BOUNDED.format(t='text')} < {c.min_words}"))
        if c.title:
            rules.append(("title", no(hit("text", rf"^#\s+{re.escape(c.title)}\s*$"))))
        rules += [(f"section:{h}", no(hit("text", rf"^##\s+{re.escape(h)}\s*$"))) for h in c.headings]
        rules += [(f"pattern:{n}", no(hit("text", p))) for n, p in c.patterns]
        rules += [(f"phrase:{p}", no(has("text", p))) for p in c.phrases]
        if c.names_model:
            rules.append(("model-not-named", "not contains(text, expected_model)"))
        parts.append(rules_sql(f"(select * from contract_docs where text <> '' and doc_type = '{c.name}')", "doc_id, doc_type", rules))
    return " union all ".join(parts)


@query("section_contract", "with z as (select 1) " + _contract_sql(), ("contract_docs",))
def _(v):
    return contracts.section_contracts(v("contract_docs"))


@query("session_length", f"select doc_id, 'too-long' as rule from documents where text <> '' and lang <> '' and {WORDS.format(t='text || chr(10) || lang')} > 1500")
def _(v):
    return contracts.total_length(
        v.table(DOCS).select("doc_id", F.col("text").alias("reaction"), F.col("lang").alias("notes"))
    )


@query("research_evidence", "with z as (select 1) " + rules_sql("contract_docs", "doc_id", [
    ("pattern:urls", no(hit("text", "https?://"))), ("pattern:access-date", no(hit("text", r"\bAccessed:\s*\d{4}-\d{2}-\d{2}\b"))),
    *[(f"phrase:{p}", no(has("text", p))) for p in ("Claim:", "Source:", "Quoted Evidence:")],
]), ("contract_docs",))
def _(v):
    return contracts.research_evidence(v("contract_docs"))


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _section(heading: str) -> str:
    body = rf"regexp_replace(regexp_extract(text, '(?ims)^##\s+{heading}\s*$(.*)', 1), '(?ms)^##\s.*', '')"
    return TRIM.format(body)


REVIEW = rf"""
sec as (select doc_id, text, {_section('Summary')} as summary, {_section('Findings')} as body from review_reports),
bk as (select doc_id, unnest(list_filter(string_split(regexp_replace(body, '(?im)^(###\s+Finding:)', chr(1) || '\1', 'g'), chr(1)), lambda b: regexp_matches(b, '\S'))) as block,
  generate_subscripts(list_filter(string_split(regexp_replace(body, '(?im)^(###\s+Finding:)', chr(1) || '\1', 'g'), chr(1)), lambda b: regexp_matches(b, '\S')), 1) as finding
  from sec where regexp_matches(body, '(?im)^###\s+Finding:')),
blk as (select doc_id, cast(finding as int) as finding, block, upper(regexp_extract(block, '(?i)Priority:\s*(P[0-3])\b', 1)) as priority,
  lower(regexp_extract(block, '(?i)Confidence:\s*(high|medium|low)\b', 1)) as confidence, regexp_extract(block, '\b([\w./-]+:\d+)\b', 1) as evidence from bk)
"""


@query("review_findings_table", f"with {REVIEW} select doc_id, finding, priority, confidence, evidence from blk", ("review_reports",))
def _(v):
    return contracts.review_blocks(v("review_reports")).drop("block")


@query("review_findings", f"with {REVIEW} " + rules_sql("sec", "doc_id, 0 as finding", [
    ("too-long", WORDS.format(t="text") + " > 1200"), ("title", no(hit("text", r"^#\s+Review Report\s*$"))),
    *[(f"section:{h}", no(hit("text", rf"^##\s+{h}\s*$"))) for h in contracts.REVIEW_HEADINGS],
    ("summary-too-long", r"len(list_filter(string_split(summary, chr(10)), lambda l: regexp_matches(l, '\S'))) > 3"),
    ("findings-empty", "body = ''"),
    ("findings-not-explicit", r"body <> '' and not regexp_matches(body, '(?im)^###\s+Finding:') and not contains(lower(body), 'no findings')"),
]) + " union all " + rules_sql("blk", "doc_id, finding", [
    *[(f"field:{f}", no(has("block", f))) for f in contracts.REVIEW_FIELDS],
    ("no-file-line", "contains(block, 'Evidence:') and evidence = ''"), ("priority", "priority = ''"), ("confidence", "confidence = ''"),
]), ("review_reports",))
def _(v):
    return contracts.review_findings(v("review_reports"))


STRICT = r"""
sp as (select doc_id, text, list_transform(string_split(regexp_replace(text, '(?im)^Finding\s*:\s*', chr(1), 'g'), chr(1))[2:], lambda b: 'Finding: ' || b) as bs from strict_reviews),
sb as (select doc_id, cast(generate_subscripts(bs, 1) as int) as finding, unnest(bs) as b from sp),
ev as (select *, regexp_extract(b, '(?ims)^Evidence\s*:\s*(.+?)(?:\n[A-Z][A-Za-z ]+\s*:|\z)', 1) as evidence from sb)
"""


@query("review_findings_strict", f"with {STRICT} " + rules_sql("sp", "doc_id, 0 as finding", [
    ("section:Summary", no(hit("text", r"^#+\s*summary\b"))),
    ("nothing-stated", "len(bs) = 0 and " + no(hit("text", r"\bNO FINDINGS\b"))), ("claims-edit", hit("text", rf"\b{CLAIMS}\b")),
]) + " union all " + rules_sql("ev", "doc_id, finding", [
    *[(f"label:{n}", no(hit("b", rf"^{n}\s*:"))) for n in contracts.STRICT_LABELS],
    ("priority", no(hit("b", r"^Priority\s*:\s*(P[0-3])\b"))), ("confidence", no(hit("b", r"^Confidence\s*:\s*(high|medium|low)\b"))),
    ("thin-evidence", "evidence <> '' and length(" + TRIM.format("evidence") + ") < 20"),
]), ("strict_reviews",))
def _(v):
    return contracts.strict_review_findings(v("strict_reviews"))


@query("claims_of_edits", "select doc_id from review_reports where " + hit("text", rf"\b{CLAIMS}\b"), ("review_reports",))
def _(v):
    return contracts.claims_of_edits(v("review_reports"))


SECTIONS = r"""
dl as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from doc_files),
dh as (select *, regexp_matches(line, '^#{1,6}\s+.') as is_head, trim(regexp_replace(lower(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)), '[^a-z0-9]+', ' ', 'g')) as hs from dl),
dn as (select *, sum(case when is_head then 1 else 0 end) over (partition by doc_id order by n) as blk from dh),
db as (select doc_id, blk, max(case when is_head then hs end) as slug, coalesce(string_agg(case when not is_head then line end, chr(10) order by n), '') as body from dn where blk > 0 group by doc_id, blk),
sw as (select doc_id, slug, cast(sum(len(regexp_extract_all(body, '[A-Za-z0-9_''-]+'))) as bigint) as words from db group by doc_id, slug),
hitb as (select *, slug = 'api symbols' as hit from db), firsth as (select doc_id, min(blk) as f from hitb where hit group by doc_id),
stop as (select h.doc_id, min(blk) as s from hitb h join firsth using (doc_id) where not hit and blk > f group by h.doc_id),
sym as (select distinct doc_id, unnest(list_transform(regexp_extract_all(body, '`([^`\n]+)`', 1), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))) as symbol
  from hitb join firsth using (doc_id) left join stop using (doc_id) where blk >= f and blk < coalesce(s, 1000000)),
sym2 as (select * from sym where symbol <> '' and not starts_with(symbol, 'http://') and not starts_with(symbol, 'https://'))
"""


@query("doc_section_words", f"with {SECTIONS} select doc_id, slug, words from sw", ("doc_files",))
def _(v):
    return contracts.section_words(v("doc_files"))


@query("doc_symbols", f"with {SECTIONS} select doc_id, symbol from sym2", ("doc_files",))
def _(v):
    return contracts.symbol_spans(v("doc_files"), "API Symbols")


@query("doc_sections", f"with {SECTIONS} " + rules_sql("doc_files d", "doc_id", [
    ("too-short", TOKENS.format(t="text") + " < 300"),
    ("section:Over View", "doc_id not in (select doc_id from sw where slug = 'over view')"), ("thin:Over View", "doc_id in (select doc_id from sw where slug = 'over view' and words < 120)"),
    ("section:API symbols", "doc_id not in (select doc_id from sw where slug = 'api symbols')"), ("thin:API symbols", "doc_id in (select doc_id from sw where slug = 'api symbols' and words < 120)"),
    ("section:Usage", "doc_id not in (select doc_id from sw where slug = 'usage')"), ("thin:Usage", "doc_id in (select doc_id from sw where slug = 'usage' and words < 120)"),
    ("no-example:python", r"not regexp_matches(text, '(?is)```\s*python[^\n`]*\n.*?\n```')"),
    ("no-symbols", "doc_id not in (select doc_id from sym2)"),
]), ("doc_files",))
def _(v):
    return contracts.doc_sections(
        v("doc_files"), ["Over View", "API symbols", "Usage"], 300, 120, "API symbols", "python"
    )


def _after(marker: str) -> str:
    body = rf"regexp_extract(transcript, '(?is){marker}\s*(.*)', 1)"
    return TRIM.format(rf"regexp_replace({body}, '(?s)\n(?:##\s+|[A-Z][A-Z _-]{{3,}}:).*', '')")


PROBE = f"""pr as (select *, lower(transcript || chr(10) || output) as comb, lower(transcript) as low,
 coalesce(nullif({_after('MODEL RESPONSE:')}, ''), nullif({_after('ASSISTANT:')}, ''), nullif({_after('RESPONSE:')}, ''), '') as response from transcripts)"""


@query("probe_transcripts", f"with {PROBE} " + rules_sql("pr", "tid, mode", [
    ("marker", "not contains(comb, 'e')"), ("no-response", "mode = 'model' and response = ''"),
    ("short-response", r"mode = 'model' and response <> '' and length(regexp_replace(response, '\s+', '', 'g')) < 120"),
    ("no-prompt", "mode = 'model' and response <> '' and not contains(low, 'prompt:') and not contains(low, 'commands run')"),
    ("error-unexplained", "mode = 'model' and response <> '' and contains(comb, 'error') and not contains(low, 'model response')"),
    ("no-status", r"mode = 'api' and not contains(comb, 'http_status:') and not regexp_matches(comb, '\bstatus(?: code)?:\s*\d{3}')"),
    ("no-behavior", "mode = 'api' and not contains(low, 'observed behavior:')"), ("no-verdict", "mode = 'api' and not contains(low, 'verdict:')"),
    *[(f"postmortem:{m}", f"mode = 'postmortem' and not contains(low, '{m}')") for m in contracts.POSTMORTEM_MARKERS],
    ("generic-empty", "mode = 'generic' and not contains(low, 'observed behavior') and not contains(low, 'verdict:')"),
]), ("transcripts",))
def _(v):
    return contracts.probe_transcripts(v("transcripts"), must_contain="E")


SITE = contracts.Site(
    min_bytes=2500, min_images=2, terms=("Lamp", "</article>"), brand="Acme", tagline="draft prices",
    palette=("#AA11BB",), pitch="Money Back",
)
IMAGES = "(?:" + "|".join(contracts.IMAGE_TYPES) + ")"
# Pieces between quotes; a link's piece starts with its scheme, the one before ends with its name.
QUOTED = """string_split(replace(html, '"', chr(39)), chr(39))"""
LINKS = rf"""list_transform(list_filter(range(2, len({QUOTED}) + 1), lambda i: regexp_matches({QUOTED}[i], '(?is)^https?://.')
 and regexp_matches({QUOTED}[i - 1], '(?i)(?:{"|".join(contracts.LINK_ATTRIBUTES)})\s*=\s*$')), lambda i: {QUOTED}[i])"""
MEDIA = [
    ("too-small", "octet_length(encode(html)) < 2500"),
    ("few-images", f"len(regexp_extract_all(html, '(?i)data:image/{IMAGES};base64,')) < 2"),
    ("external", f"len({LINKS}) > 0"),
]


@query("page_contract", "with z as (select 1) " + rules_sql("site_pages", "page_id", [
    *MEDIA, ("term:Lamp", no(has("html", "lamp"))), ("term:</article>", no(has("html", "</article>"))),
    ("no-form", no(has("html", "<form") + " or " + has("html", "interest"))), ("no-honesty", no(has_any("html", contracts.HONEST_WORDS))),
]), ("site_pages",))
def _(v):
    return contracts.page_contract(v("site_pages"), SITE)


@query("page_contract_final", "with z as (select 1) " + rules_sql("site_pages", "page_id", [
    ("brand", no(has("html", "acme"))), ("tagline", no(has("html", "draft prices"))), ("color:#AA11BB", no(has("html", "#aa11bb"))),
    ("pitch", no(has("html", "money back"))), ("leftover", has_any("html", contracts.LEFTOVER_WORDS)), *MEDIA, ("no-svg", no(has("html", "<svg"))),
    ("no-honesty", no(has_any("html", contracts.FINAL_HONEST_WORDS))), ("no-trust", no(has_any("html", contracts.TRUST_WORDS) + " or " + hit("html", contracts.TRUST_SPELLINGS[0]))),
]), ("site_pages",))
def _(v):
    return contracts.final_page_contract(v("site_pages"), SITE)


@query("page_external_urls", f"select distinct page_id, unnest({LINKS}) as url from site_pages", ("site_pages",))
def _(v):
    return contracts.external_urls(v("site_pages"))


def _label(label: str) -> str:
    return f"regexp_extract_all(text, '(?im)^{NW}*{label}\\s*{SEP}\\s*(.+)$', 1)"


PICK = no(f"regexp_matches(text, '(?im)^{NW}*my pick\\s*{SEP}')")


@query("copy_candidates", "with z as (select 1) " + rules_sql("copy_docs", "doc_id", [
    ("names", f"len({_label('name' + chr(92) + 's*' + chr(92) + 'd*')}) < 8"), ("pitches", f"len({_label('pitch' + chr(92) + 's*[abc123]')}) < 3"),
    ("pitch-too-long", f"len(list_filter({_label('pitch' + chr(92) + 's*[abc123]')}[1:3], lambda p: {WORDS.format(t='p')} > 30)) > 0"),
    ("taglines", f"len(regexp_extract_all(text, '(?im)^{NW}*tagline\\b[^:\\-—]*{SEP}\\s*(.+)$', 1)) < 3"), ("no-pick", PICK),
]), ("copy_docs",))
def _(v):
    return contracts.candidate_copy(v("copy_docs"))


def _blocks(word: str, limit: str = "") -> str:
    return rf"""cp as (select doc_id, text, string_split(regexp_replace(text, '(?im)^#+\s*(?:\d+[\).]?\s*)?{word}\b', chr(1), 'g'), chr(1))[2:] as ps from copy_docs),
 pp as (select doc_id, cast(generate_subscripts(ps{limit}, 1) as int) as part, unnest(ps{limit}) as p from cp)"""


@query("copy_brand_board", f"with {_blocks('direction')} " + rules_sql("cp", "doc_id, 0 as part", [("directions", "len(ps) < 3"), ("no-pick", PICK)]) + " union all " + rules_sql("pp", "doc_id, part", [
    ("colors", r"len(regexp_extract_all(p, '#[0-9a-fA-F]{6}\b')) < 4"), ("headline-type", no(hit("p", r"headline\s*(type|font)"))),
    ("body-type", no(hit("p", r"body\s*(type|font)"))), ("why", no(hit("p", r"why\s*(it\s*fits|this)"))),
]), ("copy_docs",))
def _(v):
    return contracts.brand_board(v("copy_docs"))


COLORS = r"list_transform(regexp_extract_all(text, '#[0-9a-fA-F]{6}\b'), lambda c: upper(c))"
PALETTE = ["#112233", "#abcdef", "#778899"]


@query("copy_brand_kit", "with z as (select 1) " + rules_sql("copy_docs", "doc_id", [
    ("brand", no(has("text", "acme"))), ("tagline", no(has("text", "price list"))),
    *[(f"color:{c.upper()}", f"not list_contains({COLORS}, '{c.upper()}')") for c in PALETTE], ("few-colors", f"len(list_distinct({COLORS})) < 4"),
    ("type-section", no(hit("text", r"^#+\s*(?:\d+[\).]?\s*)?(type|typography)\b"))), ("no-svg", r"not regexp_matches(text, '(?is)<svg.*?</svg>')"),
    ("svg-without-brand", r"regexp_matches(text, '(?is)<svg.*?</svg>') and not contains(lower(regexp_extract(text, '(?is)<svg.*?</svg>')), 'acme')"),
    ("no-pricing", no(has_any("text", contracts.PRICE_WORDS))),
]), ("copy_docs",))
def _(v):
    return contracts.brand_kit(v("copy_docs"), "Acme", "Price list", PALETTE)


@query("palette_coverage", f"""select doc_id, c as color from copy_docs, (values ('#112233'), ('#ABCDEF'), ('#778899'), ('#00FF00')) as t(c)
 where not list_contains({COLORS}, c)""", ("copy_docs",))
def _(v):
    return contracts.palette_coverage(v("copy_docs"), [*PALETTE, "#00ff00"])


@query("copy_listing", f"with {_blocks('product', '[1:3]')} " + rules_sql("cp", "doc_id, 0 as part", [
    ("products", "len(ps) < 3"), ("too-short", WORDS.format(t="text") + " < 250"),
    ("no-honesty", no(has_any("text", contracts.HONEST_WORDS))), ("no-about", no(hit("text", r"^#+\s*about"))),
]) + " union all " + rules_sql("(select *, regexp_extract(p, '(?im)^" + NW + "*title\\s*" + SEP + "\\s*(.+)$', 1) as title from pp)", "doc_id, part", [
    ("no-title", "title = ''"), ("title-too-long", "length(title) > 140"), ("bullets", r"len(regexp_extract_all(p, '(?m)^\s*[-*]\s+\S')) < 3"),
]), ("copy_docs",))
def _(v):
    return contracts.listing_copy(v("copy_docs"))


def _persona_sql() -> str:
    columns = []
    for name, pattern in contracts.PERSONA_FIELDS.items():
        value = rf"regexp_extract(text, '(?im)^{NW}*{name}\s*{SEP}\s*({pattern})\s*$', 1)"
        columns.append(f"nullif({TRIM.format(value)}, '') as {name.lower().replace(' ', '_')}")
    return (
        f"pf as (select doc_id, scenario, model, {WORDS.format(t='text')} as words, {', '.join(columns)} from persona_docs), "
        r"pc as (select *, nullif(upper(regexp_extract(verdict, '(?i)^(BUY|MAYBE|PASS)\b', 1)), '') as choice from pf)"
    )


@query("persona_fields", f"with {_persona_sql()} select * from pc", ("persona_docs",))
def _(v):
    return contracts.persona_fields(v("persona_docs"))


@query("persona_findings", f"with {_persona_sql()} " + rules_sql("pc", "doc_id", [
    ("too-short", "words < 60"), *[(f"field:{n.lower().replace(' ', '_')}", f'"{n.lower().replace(" ", "_")}" is null') for n in contracts.PERSONA_FIELDS],
]), ("persona_docs",))
def _(v):
    return contracts.persona_findings(v("persona_docs"), 60)


@query("verdict_distribution", f"""with {_persona_sql()} select scenario, model, count(case when choice = 'BUY' then 1 end) as buy, count(case when choice = 'MAYBE' then 1 end) as maybe,
 count(case when choice = 'PASS' then 1 end) as pass, count(*) as total from pc group by scenario, model""", ("persona_docs",))
def _(v):
    parsed = contracts.persona_fields(v("persona_docs"))
    return contracts.verdict_distribution(parsed, "scenario", "model", ["BUY", "MAYBE", "PASS"])


@query("placeholder_scan", """select doc_id, 'text' as field from documents where contains(text, '{{') or contains(text, '}}')
 union all select doc_id, 'note' from documents where doc_id % 4 = 0 union all select doc_id, 'close' from documents where doc_id % 6 = 0""")
def _(v):
    rows = v.table(DOCS).select(
        "doc_id", "text", F.expr("case when doc_id % 4 = 0 then '{{NAME}}' else source end").alias("note"),
        F.expr("case when doc_id % 6 = 0 then 'x}}' else lang end").alias("close"),
    )
    return contracts.placeholders(rows, ["doc_id"], ["text", "note", "close"])


@query("assertion_density", r"""select doc_id, len(regexp_extract_all(text, '\b(assert|expect)\b')) as assertions,
 greatest(len(list_filter(string_split(text, chr(10)), lambda l: not regexp_matches(l, '^\s*($|#|//|/\*|\*)'))), 1) as lines from test_files""", ("test_files",))
def _(v):
    t = F.col("text")
    return v("test_files").select(
        "doc_id", measures.assertion_count(t, r"\b(assert|expect)\b").alias("assertions"),
        measures.substantive_lines(t).alias("lines"),
    )


@query("test_count", r"""with c as (select doc_id, list_max(list_transform(flatten([regexp_extract_all(output, '(?ims)Tests:\s+.*?(\d+)\s+passed', 1), regexp_extract_all(output, '(?ims)Test Files\s+.*?(\d+)\s+passed', 1),
 regexp_extract_all(output, '(?ims)(\d+)\s+passed(?:,|\s+in|\s*$)', 1), regexp_extract_all(output, '(?ims)collected\s+(\d+)\s+items?', 1), regexp_extract_all(output, '(?ims)Ran\s+(\d+)\s+tests?', 1),
 regexp_extract_all(output, '(?ims)(\d+)\s+passing', 1)]), lambda x: cast(x as bigint))) as tests from test_files)
 select doc_id, tests, coalesce(tests > 12, false) as grew from c""", ("test_files",))
def _(v):
    counted = v("test_files").select("doc_id", measures.test_count(F.col("output")).alias("tests"))
    return counted.withColumn("grew", F.coalesce(F.col("tests") > 12, F.lit(False)))


def _part(key: str, table: str) -> str:
    """One copy check's SQL as a named CTE with its kind."""
    return f"{table} as ({ORACLES[key]})"


@query("copy_contracts", "with " + ", ".join(
    _part(f"copy_{k}", f"c{n}") for n, k in enumerate(("candidates", "brand_board", "brand_kit", "listing"))
) + """ select 'candidates' as kind, doc_id, 0 as part, rule from c0 union all select 'brand_board', doc_id, part, rule from c1
 union all select 'brand_kit', doc_id, 0, rule from c2 union all select 'listing', doc_id, part, rule from c3""")
def _(v):
    return contracts.copy_contracts(v("copy_docs"), "Acme", "Price list", PALETTE)

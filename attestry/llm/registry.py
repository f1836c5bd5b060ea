"""The dealt operators as queries, with check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from attestry.llm import credentials, divergence, exact, host_rules, language, licenses, lines, minhash, mixing, packing, pii, prefix_trie, quality
from attestry.llm.common import remainder, shared, text_of, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


@query(
    "op3_host_rules",
    rf"""
with base as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
lined as (
  select rid, unnest(string_split(text, chr(10))) as line from base),
lines as (
  select rid, count(*) - count(distinct line) as n_dup_lines from lined
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
worded as (
  select rid, unnest(w) as w, unnest(range(len(w))) as pos
  from (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from base)),
windows as (
  select rid, pos, w as a, lead(w, 1) over d as b, lead(w, 2) over d as c from worded
  window d as (partition by rid order by pos)),
again as (
  select rid, pos from (
    select rid, pos, count(*) over (partition by rid, a, b, c) as n from windows where c is not null)
  where n > 1),
covered as (
  select rid, count(distinct pos + step) as n_repeat_words
  from again, (select unnest([0, 1, 2]) as step) group by rid),
measured as (
  select base.rid, doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from base left join lines using (rid) left join covered using (rid)),
ruled as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured),
hosts as (
  select source, count(*) as n,
    count(*) filter (where base_failed or n_symbols > {host_rules.SYMBOL_SHARE} * word_chars
                     or n_dup_lines >= {host_rules.DUP_LINES}) as f
  from ruled group by source),
sums as (
  select sum(f) / sum(n) as m, sum(n) as d, count(*) as h, sum(f * f / n) as q from hosts),
spread as (
  select m, greatest((q - d * m * m - (h - 1) * m * (1 - m)) / d, 0) as v from sums),
prior as (
  select m, case when v > 0 then least(greatest(m * (1 - m) / v - 1, 1), 1e6) else 1e6 end as s from spread),
rated as (
  select source, (f + m * s) / (n + s) as r, n + s as t from hosts, prior),
verdicts as (
  select source, r - {host_rules.SURE} * sqrt(r * (1 - r) / (t + 1)) > {host_rules.HOST_LIMIT} as rejected from rated)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not rejected as kept
from ruled join verdicts on ruled.source is not distinct from verdicts.source
""",
)
def op3(spark: SparkSession, root: str) -> DataFrame:
    return host_rules.host_rules(documents(spark, root)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    "op6_water_filling",
    rf"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w
  from sized group by source),
filled as (
  select source, source_size, w, 3 * source_size as cap, sum(source_size) over () as total,
    coalesce(sum(3 * source_size) over b, 0) as caps_before,
    sum(w) over () - coalesce(sum(w) over b, 0) as weight_left
  from sources
  window b as (order by (3 * source_size)::double / w, source is null, source
               rows between unbounded preceding and 1 preceding)),
flagged as (
  select *, cap::double * weight_left <= w::double * (total - caps_before) as clamped from filled),
goals as (
  select source, source_size, case when clamped then cap::double else (w * rest)::double / open_w end as target
  from (select *, total - sum(case when clamped then cap else 0 end) over () as rest,
          sum(case when clamped then 0 else w end) over () as open_w from flagged)),
placed as (
  select doc_id, sized.source, size, source_size, target,
    case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole,
    sum(size) over (partition by sized.source
      order by md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')), doc_id nulls last, size
      rows between unbounded preceding and current row) - size / 2.0::double as middle
  from sized join goals on sized.source is not distinct from goals.source)
select doc_id, size::bigint as size, source_size, target,
  (size * (whole + (target > whole * source_size and middle <= target - whole * source_size)::int))::bigint as taken
from placed
""",
)
def op6(spark: SparkSession, root: str) -> DataFrame:
    sized = documents(spark, root).select("doc_id", "source", word_count(text_of()).alias("size"))
    return mixing.mix(shared(sized, "mix-sizes")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query("op2_sum_of_squares_packing")
def op2(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(documents(spark, root), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query(
    "op5_extendible_hash_dedup",
    r"""
with base as (
  select doc_id, coalesce(text, '') as text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
ranked as (
  select *, first_value(doc_id) over best as keep_id, row_number() over best as place,
    count(*) over (partition by body) as group_size
  from base window best as (partition by body order by length(text) desc, doc_id nulls last))
select doc_id, keep_id, group_size, place = 1 as kept, sha256(body) as text_sha256 from ranked
""",
)
def op5(spark: SparkSession, root: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, root).select("doc_id", "text")).drop("row")


@query(
    "op7_bayesian_minhash",
    r"""
with recursive base as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from base where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (
  select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
least_of as (select a, min(b) as m from reach group by a)
select base.doc_id, coalesce(n, 0) as n_shingles, least(base.doc_id, coalesce(m, base.doc_id)) as component_id,
  base.doc_id = least(base.doc_id, coalesce(m, base.doc_id)) as kept
from base left join sizes using (doc_id) left join least_of on a = base.doc_id
""",
)
def op7(spark: SparkSession, root: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, root).select("doc_id", "text")).drop("row", "stays")


@query("op4_kneser_ney_language")
def op4(spark: SparkSession, root: str) -> DataFrame:
    held_out = remainder("doc_id", 4) == 2
    docs = documents(spark, root)
    model = language.fit(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", (remainder("row.doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query("op8_fuzzy_notices")
def op8(spark: SparkSession, root: str) -> DataFrame:
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["label"], *[s[k].cast("string") for k in ("first_word", "end_word", "errors")]))
    return licenses.scan(documents(spark, root).select("doc_id", "text")).select(
        "row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.array_join(spans, ",").alias("spans"),
    )


@query("op9_credential_linking")
def op9(spark: SparkSession, root: str) -> DataFrame:
    found = credentials.scan(documents(spark, root).select("doc_id", "text"))
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


@query("op10_weak_supervision_pii")
def op10(spark: SparkSession, root: str) -> DataFrame:
    found = pii.scan(documents(spark, root).select("doc_id", "text"))
    return found.select("row.doc_id", *[c for c in found.columns if c != "row"])


@query("op1_non_negative_pu")
def op1(spark: SparkSession, root: str) -> DataFrame:
    docs = documents(spark, root).select("doc_id", "text")
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels, remainder("doc_id", 5) != 0)
    return quality.score(docs, model).select(
        "row.doc_id", (remainder("row.doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op11_radix_prefix_trie",
    r"""
with base as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (
  select conv_id as c,
    list(struct_pack(r := role, t := text, w := len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))
         order by turn nulls first, role, sha256(length(role)::varchar || ':' || role || text)) as own
  from base group by conv_id),
hashed as (
  select c, own, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
      lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))) as crc
  from convs),
headed as (
  select h.c, h.own, b.own as head, (xor(h.crc, 4294967295::ubigint) % 4)::bigint as k
  from hashed h left join convs b on b.c = h.c - h.c % 20),
rebuilt as (
  select c, list_concat(coalesce(head[1:k], []), own[k + 1:]) as turns from headed),
prefixes as (
  select c, len(turns) as d_all, unnest(range(0, len(turns) + 1)) as depth, turns from rebuilt),
nodes as (
  select turns[1:depth] as path, depth, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d_all = depth), '')) as ends_sha256
  from prefixes group by turns[1:depth], depth),
kids as (
  select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0
  group by path[1:depth - 1], depth),
whole as (
  select nodes.*, coalesce(n_children, 0) as n_children,
    case when nodes.depth = 0 then 0 else (n_convs - 1) * nodes.path[nodes.depth].w end as saved
  from nodes left join kids on nodes.path = kids.path and nodes.depth = kids.depth),
above as (
  select path[1:a] as path, a as depth, (n_children = 0)::int as leaf, saved
  from (select *, unnest(range(0, depth + 1)) as a from whole)),
sums as (select path, depth, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from above group by path, depth)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
from whole w join sums s on w.path = s.path and w.depth = s.depth
left join nodes p on w.depth > 0 and p.depth = w.depth - 1 and p.path = w.path[1:w.depth - 1]
""",
)
def op11(spark: SparkSession, root: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{root}/conversations.parquet"))


@query(
    "op12_two_bloom_lines",
    r"""
with base as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
split as (
  select rid, doc_id, unnest(l) as line, unnest(range(len(l))) as pos
  from (select rid, doc_id, string_split(text, chr(10)) as l from base)),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split),
firsts as (
  select k, min(doc_id) as first from keyed where length(k) >= 10
  group by k having count(distinct doc_id) > 1),
judged as (
  select rid, doc_id, line, pos, coalesce(doc_id > first, false) as dropped
  from keyed left join firsts on keyed.k = firsts.k)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by rid, doc_id
""",
)
def op12(spark: SparkSession, root: str) -> DataFrame:
    found = lines.drop_repeated_lines(documents(spark, root).select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op13_divergence_tree",
    r"""
with base as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
tokens as (
  select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from base),
vocabulary as (
  select lang, term, count(*)::hugeint as lang_n from tokens group by lang, term having count(distinct rid) >= 3),
counted as (
  select lang, source, term, count(*)::hugeint as n from tokens group by lang, source, term),
kept as (select counted.*, lang_n from counted join vocabulary using (lang, term)),
sizes as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from vocabulary group by lang),
stats as (
  select g.lang, g.source, coalesce(total, 0)::hugeint as total, coalesce(v, 0)::hugeint as v, lang_total
  from (select distinct lang, source from base) g
  left join (select lang, source, sum(n)::hugeint as total from kept group by lang, source) t using (lang, source)
  left join sizes using (lang)),
chances as (
  select s.lang, s.source, term, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (total + v) as p
  from stats s join vocabulary using (lang) left join counted using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from chances a join chances b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source
  union all
  select a.lang, a.source, b.source, 0 from stats a join stats b on a.lang = b.lang and a.source <> b.source
  where a.v = 0),
terms as (
  select lang, source, term as item, ((p - q) * (p - q)) // q as value
  from (select lang, source, term, 1 + (1000000000 * (n + 1)) // (total + v) as p,
          1 + (1000000000 * (lang_n + 1)) // (lang_total + v) as q
        from kept join stats using (lang, source))
  where p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
  from (select *, 'pair' as part from pairs union all select *, 'term' as part from terms))
select lang, source, part, item, value::bigint as value, rank::integer as rank
from ranked where part = 'pair' or rank <= 200
""",
)
def op13(spark: SparkSession, root: str) -> DataFrame:
    return divergence.audit(documents(spark, root))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, root: str) -> DataFrame:
    return corpus_pipeline.run(spark, root)

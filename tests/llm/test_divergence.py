import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from attestry.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows):
    """Brute force over ``(text, lang, source)``: every kept term for every pair of sources."""
    low = {c: c + 32 for c in range(65, 91)}
    docs = [(TERM.findall((t or "").translate(low)), g or "", s or "") for t, g, s in rows]
    spread, groups = Counter(), defaultdict(Counter)
    for terms, lang, source in docs:
        groups[lang, source].update(terms)
        for term in set(terms):
            spread[lang, term] += 1
    out = set()
    chance = lambda c, n, v: 1 + 10**9 * (c + 1) // (n + v)
    for lang in {g for g, _ in groups}:
        vocabulary = [t for g, t in spread if g == lang and spread[g, t] >= 3]
        v, all_of = len(vocabulary), Counter()
        sources = {s: {t: c[t] for t in vocabulary} for (g, s), c in groups.items() if g == lang}
        for counts in sources.values():
            all_of.update(counts)
        sums = {s: sum(c.values()) for s, c in sources.items()}
        for s, counts in sources.items():
            pairs, terms = [], []
            for other in sources.keys() - {s}:
                value = 0
                for t in vocabulary:
                    p, q = chance(counts[t], sums[s], v), chance(sources[other][t], sums[other], v)
                    value += (p - q) ** 2 // q
                pairs.append((-value, other.encode(), other))
            for t in vocabulary:
                p, q = chance(counts[t], sums[s], v), chance(all_of[t], sum(sums.values()), v)
                if counts[t] and p > q:
                    terms.append((-((p - q) ** 2 // q), t.encode(), t))
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:200])):
                out |= {(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)}
    return out


def docs_of(spark, rows):
    schema = "doc_id long, text string, lang string, source string, term string, total int"
    return spark.createDataFrame(
        [Row(doc_id=i, text=t, lang=g, source=s, term="x", total=1) for i, (t, g, s) in enumerate(rows)], schema
    ).repartition(3)


ODD = [
    ("The cat sat on the mat", "en", "a"), ("the Cat ran", "en", "b"), ("a cat and the dog", "en", None),
    ("dog dog dog the", "en", "b"), ("dog ÉTÉ été", "en", "a"), ("été x1y2", "en", "c"), ("x y été", None, "a"),
    (None, "en", "d"), ("", "en", ""), ("123 ...", "en", "e"), ("solo words", "fr", "a"), (None, "fr", "b"),
    ("the cat", None, None), ("w " * 60_000 + "cat", "en", "a"), ("the cat", "en", "b"), ("the cat", "en", "b"),
    ("漢字 kana the", "en", "zz"), ("only one source", "de", "one"), ("only one source", "de", "one"), ("only one", "de", "one"),
]


def test_odd_rows(spark):
    result = divergence.audit(docs_of(spark, ODD))
    rows = result.collect()
    assert result.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in rows} == plain(ODD) and len(rows) == len(plain(ODD))


def test_empty_table(spark):
    assert divergence.audit(docs_of(spark, ODD).where("false")).collect() == []


def test_skewed_source_and_more_terms_than_ranks(spark):
    rows = [(" ".join(f"w{i * j % 409}x{'abcdefg'[j % 7]}" for j in range(1, 40)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    rows = [(re.sub(r"\d", lambda m: "qrstuvwxyz"[int(m[0])], t), g, s) for t, g, s in rows]
    assert {tuple(r) for r in divergence.audit(docs_of(spark, rows)).collect()} == plain(rows)


@pytest.mark.parametrize("cut", [1, 3, 100])
def test_a_tree_cut_anywhere_sums_to_the_same(cut):
    """Shared paths count once per node and ancestor; sorted rows may be cut at any place."""
    rows = sorted(
        [(s, n, t) for s, n, t in zip("abcd", counts, (50, 60, 70, 80)) if n]
        for counts in itertools.product((0, 1, 2), (0, 3), (0, 1), (0, 5))
    )
    whole, parts = divergence.Tree(), Counter()
    for row in rows:
        whole.insert(row, 2)
    whole.close()
    assert len(whole.pairs) < sum(len(r) * (len(r) - 1) // 2 for r in rows)
    wanted = {(r["source"], r["item"]): int(r["value"]) for r in whole.corrections("en", 40)}
    for start in range(0, len(rows), cut):
        tree = divergence.Tree()
        for row in rows[start:start + cut]:
            tree.insert(row, 2)
        tree.close()
        for r in tree.corrections("en", 40):
            parts[r["source"], r["item"]] += int(r["value"])
    assert dict(parts) == wanted


def test_long_texts_are_sliced_behind_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 5)
    text = "Alpha beta-gamma  deltaepsilon zeta ÉTÉ".encode()
    assert [t for part in divergence.term_slices(text) for t in part] == [t.encode() for t in TERM.findall("alpha beta-gamma  deltaepsilon zeta ÉtÉ")]

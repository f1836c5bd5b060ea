"""Host rules, mixing and exact dedup against plain Python on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from attestry.llm import exact, host_rules, mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated),
    )


TEXTS = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "x x x x", "l\nl\n\nl\n", "é ü # $ % |", "a　b c",
    "word " * 5000, "\n".join(f"line {i % 7} of many words" for i in range(300)), "<a> & <b> & <a> & <b>",
]


def test_rule_counts_of_odd_texts(table):
    docs = [(i, t, "en", None if i % 3 else f"h{i}") for i, t in enumerate(TEXTS)]
    got = host_rules.host_rules(table(*docs, *docs)).collect()
    seen = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert seen == Counter({(i, *plain_counts(t)): 2 for i, t in enumerate(TEXTS)})
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_a_bad_host_loses_its_good_documents_and_a_small_one_does_not(table):
    def good(i):
        return " ".join(f"w{i}x{k}" for k in range(80))

    docs = [(i, good(i), "en", f"good{i % 5}") for i in range(200)]
    docs += [(1000 + i, "too short" if i % 20 else good(i), "en", "bad") for i in range(200)]
    docs += [(2000, "short", "en", "small"), (2001, good(2001), "en", "small")]
    kept = {r.doc_id for r in host_rules.host_rules(table(*docs)).where("kept").collect()}
    assert kept == set(range(200)) | {2001}


def water_filled(sizes, weights, epochs):
    left, target, rest = dict(sizes), {}, float(sum(sizes.values()))
    while left:
        share = rest / sum(weights[s] for s in left)
        over = [s for s in left if weights[s] * share >= epochs * left[s]]
        if not over:
            return {**target, **{s: weights[s] * share for s in left}}
        for s in over:
            target[s] = float(epochs * left.pop(s))
            rest -= target[s]
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_repeated_redistribution(spark, seed):
    rng = random.Random(seed)
    names = [*sorted(f"s{i:02}" for i in range(rng.randint(1, 11))), None]
    sizes = {n: rng.choice([0, 1, 5, 70, 900, 40_000]) for n in names}
    weights = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = water_filled(sizes, weights, 3)
    assert {r.source: r.target for r in got} == {n: pytest.approx(want[n]) for n in names}


def test_exact_copies_of_odd_texts(table, spark):
    docs = [(9, "a b"), (2, "ab"), (5, " a\tb "), (1, None), (3, ""), (4, " \n"), (None, "ab"), (7, "a b"), (2, "ab")]
    docs += [(100 + i, "z" * 5000) for i in range(50)]
    got = exact.exact_dedup(table(*docs, partitions=5)).collect()
    assert len(got) == len(docs)
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for i, t in docs:
        body = re.sub("[\x20\x09-\x0d]", "", t or "")
        best = min(groups[body])
        want[i, best[2], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact.exact_dedup(table((1, "x")).limit(0)).count() == 0


def test_empty_tables_of_rules(table):
    assert host_rules.host_rules(table((1, "x")).limit(0)).count() == 0


def test_mix_of_clashing_names_and_odd_rows(spark):
    names = "doc_id long, source string, size long, target string, whole int, mix_key string, copies int, row string, slice_start int"
    rows = [(i, f"s{i % 3}" if i % 5 else None, i % 7, "t", 1, "k", -1, "r", 0) for i in range(200)] + [(None, "s1", 4, "t", 1, "k", -1, "r", 0)] * 2
    frame = spark.createDataFrame(rows, names)
    got = mixing.mix(frame)
    assert got.columns == ["row", "doc_id", "source", "size", "source_size", "target", "copies"]
    found = got.collect()
    assert Counter(tuple(r.row) for r in found) == Counter(rows)
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 7 and max(r.copies for r in mine) <= 3
    assert mixing.mix(frame.limit(0)).count() == 0

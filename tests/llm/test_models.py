import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import language, minhash, quality
from attestry.llm.common import remainder
from attestry.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def held_out(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_language_on_held_out_texts(spark):
    got = QUERIES["op4_kneser_ney_language"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    assert all(r.held_out == held_out(r.doc_id, 4, 2) for r in got)
    own = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in own]) > 0.97
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(table):
    docs = [(i, "the quick brown fox jumps over the lazy dog and runs away " * 3, "en") for i in range(8)]
    docs += [(10 + i, "el perro corre por la calle y la casa tiene una puerta roja " * 3, "es") for i in range(8)]
    docs += [(30, None, "en"), (31, "", None), (32, "123 $$$", "en"), (33, "这是一个完全不同的文字系统" * 20, None),
             (34, "la puerta de la casa", None), (35, "\x01the dog\x01" * 2000, None)]
    frame = table(*docs)
    model = language.fit(frame, F.col("doc_id") < 30)
    got = {r.row.doc_id: r for r in language.identify(frame, model).collect()}
    assert len(got) == len(docs) and model.langs == ["en", "es"]
    assert [got[i].lang_pred for i in (30, 31, 32)] == ["und"] * 3 and got[32].score == 0
    assert got[33].rejected and not got[34].rejected
    assert (got[34].lang_pred, got[35].lang_pred) == ("es", "en")
    empty = frame.limit(0)
    assert language.fit(empty, F.lit(True)) is None
    assert {r.lang_pred for r in language.identify(frame, None).collect()} == {"und"}


def test_rejection_limits_come_from_every_labelled_text(spark):
    """Exact quantiles over 45,000 texts, most of them alike, rare long and odd ones too."""
    text = F.concat(
        F.lit("plain words "), F.when(F.col("id") % 41 == 7, F.concat(F.lit("qxzj"), F.col("id") % 97, F.lit("vvk"))).otherwise("again and again"),
        F.when(F.col("id") % 4_001 == 5, F.repeat(F.lit(" longer than most"), F.lit(9))).otherwise(""),
    )
    docs = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(text, F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    model = language.fit(docs, F.lit(True))
    entropy, size, _ = model.entropies([r.text for r in docs.select("text").collect()])
    low, step = entropy.min(axis=1), np.log2(size).astype(int)
    # Shorter texts never have a lower limit than longer ones.
    wanted, limit = {}, 0.0
    for b in sorted(set(step), reverse=True):
        high = np.quantile(low[step == b], 0.99)
        limit = max(limit, high + language.MARGIN * (np.log(language.ALPHABET) - high))
        wanted[b] = limit
    assert len(wanted) > 2
    assert all(abs(model.limits[b] - value) < 1e-9 for b, value in wanted.items())


def test_language_probabilities_sum_to_one():
    packed, _, _ = language.grams(["abab cab", "bca bac abc"])
    keys, n = np.unique(packed, return_counts=True)
    model = language.Language.fit(keys, n.astype(float))
    for history in ("ab ", "zzz", "\x01\x01\x01"):
        context = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(history))
        every = np.uint64(context) + np.arange(1 << 16, dtype=np.uint64)
        assert abs(np.exp(model.log_probs(every)).sum() - 1) < 1e-3


def plain_kneser_ney(texts, gram):
    """Interpolated Kneser-Ney by its definition, on strings."""
    start = "\x01"
    counts = Counter(
        padded[i - 3:i + 1] for padded in (start * 3 + t for t in texts) for i in range(3, len(padded))
    )
    p = 1 / (1 << 16)
    for width in range(1, 5):
        level = counts
        for shorter in range(3, width - 1, -1):
            level = Counter(g[1:] for g in level)
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once else 0.5
        context = {g: n for g, n in level.items() if g[:-1] == gram[4 - width:-1]}
        if not context:
            break
        total = sum(context.values())
        p = max(context.get(gram[4 - width:], 0) - discount, 0) / total + discount * len(context) / total * p
    return p


def test_language_probabilities_match_the_definition():
    texts = ["abab cab", "bca bac abc", "a b c abba", "cabbage"]
    packed, _, _ = language.grams(texts)
    keys, n = np.unique(packed, return_counts=True)
    model = language.Language.fit(keys, n.astype(float))
    for gram in ("abab", "bca ", "zzzz", "\x01\x01\x01a", "xaba", "cabz", "ge a", "\x01\x01zb"):
        key = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(gram))], np.uint64)
        assert abs(np.exp(model.log_probs(key)[0]) / plain_kneser_ney(texts, gram) - 1) < 1e-5


def test_many_languages_and_any_memory_setting(table, monkeypatch):
    """176 languages over one alphabet, told apart by their words; nothing is pruned."""
    dice = random.Random(1)
    vocabulary = [["".join(dice.choice("abcdefghij") for _ in range(5)) for _ in range(12)] for _ in range(176)]
    docs = [(1000 * k + i, " ".join(dice.choices(vocabulary[k], k=30)), f"l{k:03}") for k in range(176) for i in range(4)]
    frame = table(*docs)
    found = []
    for held in (language.HELD_GRAMS, 2_000):
        real = language.count_grams

        def small(batches, held=held, real=real):
            language.HELD_GRAMS = held
            yield from real(batches)

        monkeypatch.setattr(language, "count_grams", small)
        model = language.fit(frame, F.col("doc_id") % 1000 < 3)
        monkeypatch.setattr(language, "count_grams", real)
        found.append({r.row.doc_id: (r.lang_pred, round(r.entropy, 9)) for r in language.identify(frame, model).collect()})
    assert found[0] == found[1]
    assert all(found[0][doc][0] == lang for doc, _, lang in docs)


def test_marks_alone_are_no_letters(table):
    frame = table(*[(i, "plain words in a row", "en") for i in range(4)], (9, "\u0301\u0302 \u0303", None), (10, "e\u0301", None))
    got = {r.row.doc_id: r for r in language.identify(frame, language.fit(frame, F.col("doc_id") < 9)).collect()}
    assert got[9].lang_pred == "und" and got[9].score == 0 and got[10].lang_pred == "en"


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_non_negative_pu"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(held_out(r.doc_id, 5, 0) for r in got)
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_of_odd_texts(table, spark):
    docs = table((1, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000), (None, "plain words here"))
    labels = spark.createDataFrame([(3, 1), (None, 1), (99, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(docs, labels.limit(0), F.lit(True)) is None
    assert quality.score(docs.limit(0), model).count() == 0


def test_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(5)
    width = len(quality.text_features(b""))
    good, bad = rng.normal(0, 1, (3000, width)), rng.normal(1.5, 1, (3000, width))
    model = quality.fit_arrays(np.abs(good[:1000]), np.abs(np.vstack([good[1000:], bad[:1000]])))
    assert (model.scores(np.abs(good[1000:])) > 0.5).mean() > 0.9
    assert (model.scores(np.abs(bad)) < 0.5).mean() > 0.9
    assert 0.4 < model.prior < 0.85


def brute_components(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for k, t in texts.items()}
    part = {k: k for k in texts}
    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return part


def test_near_duplicates_of_a_loose_group(table):
    """A group whose members are partly linked, partly just below the threshold."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(80)]
    texts = {}
    for k in range(150):
        words = list(base)
        for at in rng.choice(80, rng.integers(0, 5), replace=False):
            words[at] = f"x{rng.integers(1000)}"
        texts[k] = " ".join(words)
    texts |= {200: None, 201: "", 202: "a b", 203: "A  b", 204: "a b c", 205: "long " * 30_000}
    got = {r.doc_id: r for r in minhash.near_duplicates(table(*texts.items())).collect()}
    want = brute_components(texts)
    assert {k: got[k].component_id for k in texts} == want
    assert got[200].n_shingles == 0 and got[205].n_shingles == 1 and got[203].component_id == 202


def test_rounds_do_not_depend_on_block_size(table, monkeypatch):
    frame = {"class_id": [1, 2, 3], "component": [1, 2, 3], "block": [0, 0, 0]}
    import pandas as pd

    text = " ".join(f"w{i}" for i in range(60))
    texts = [text, text + " tail", "other words entirely " * 20]
    signatures = [minhash.signature(minhash.shingles(t.encode())) for t in texts]
    matrix = np.frombuffer(b"".join(signatures), "<u4").reshape(3, minhash.BANDS, minhash.BAND_ROWS)
    first = int((matrix[0] == matrix[1]).all(axis=1).argmax())
    made = pd.DataFrame(frame).assign(text=texts, signature=signatures, i=0, j=0)
    assert minhash.compare_block(made.assign(number=first)).values.tolist() == [[1, 2]]
    assert minhash.compare_block(made.assign(number=(first + 1) % minhash.BANDS)).empty


def test_pruning_bounds_keep_similar_pairs():
    rng = np.random.default_rng(2)
    left = rng.integers(0, 2**32, (20_000, minhash.HASHES), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.75, left, left + 1)
    assert minhash.plausible(left, right).mean() > 0.9999
    right = np.where(rng.random(left.shape) < 0.3, left, left + 1)
    assert minhash.plausible(left, right).mean() < 0.001

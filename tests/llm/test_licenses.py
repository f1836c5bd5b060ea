import random
import re
import time

from attestry.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in found})))


def scanned(docs):
    return {r.row.doc_id: r for r in licenses.scan(docs).collect()}


def test_base_equals_a_plain_scan(table, spark, sf_dir):
    texts = {
        1: "Under the MIT License. under-the-mit-license! CC BY-NC, cc by nc cc by nc", 2: None, 3: "",
        4: "été Apache License,\nVersion 2.0 " * 50, 5: "under the mit licenses", 6: "\x7f\x00 é",
    }
    docs = table(*texts.items())
    got = scanned(docs)
    for key, text in texts.items():
        r = got[key]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in real.collect()}
    for key, r in scanned(real).items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[key])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_notices_with_errors_are_found_and_others_are_not(table):
    near = "Some words. Licensd undr the Apache License, Version 2. More words."
    far = "Some words. Licensed by a patchy license, version too. More words."
    got = scanned(table((1, near), (2, far), (3, "all rights reservd"), (4, "all night observed")))
    assert "apache-2" in got[1].labels and 0 < got[1].score < 1 or got[1].n_base
    span = next(s for s in got[1].spans if s.label == "apache-2")
    words = WORD.findall(near.lower())
    assert distance(" ".join(words[span.first_word : span.end_word]), "licensed under the apache license version 2") == span.errors == 2
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "all-rights-reserved" and got[4].labels == ""


def test_every_single_error_is_caught():
    phrase, label, errors = "gnu general public license version", "gpl", 2
    notice = licenses.Notice.of(phrase, label, errors)
    for at in range(len(phrase)):
        for wrong in (phrase[:at] + phrase[at + 1 :], phrase[:at] + "q" + phrase[at + 1 :], phrase[:at] + "q" + phrase[at:]):
            assert licenses.fuzzy(f" before {wrong.strip()} after ".encode(), notice), wrong


def test_fuzzy_spans_equal_a_search_of_every_word_range():
    """Every run of words is compared with every notice by plain edit distance."""
    rng = random.Random(4)
    listed = tuple(n for n in licenses.NOTICES if n[1] in ("artistic", "bsd", "all-rights-reserved", "epl"))
    for _ in range(60):
        words = []
        for _ in range(8):
            words += rng.choice(("some", "other", "rights", "public", "é", "license")).split()
            phrase = list(rng.choice(listed)[0])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(phrase))
                phrase[at] = rng.choice(("", "x", phrase[at] + "y"))
            words += "".join(phrase).split()
        padded = f" {' '.join(words)} ".encode()
        for notice in licenses.notices(listed):
            size = len(notice.phrase.split())
            near = {
                i for i in range(len(words)) for n in range(max(1, size - 3), size + 4) if i + n <= len(words)
                and abs(len(" ".join(words[i : i + n])) - len(notice.phrase)) <= notice.errors
                and distance(" ".join(words[i : i + n]), notice.phrase) <= notice.errors
            }
            got = licenses.fuzzy(padded, notice)
            assert all(s[1] in near for s in got)
            # Every place is reported or overlaps one that is.
            assert all(any(s[1] - size - 3 <= i < s[2] for s in got) for i in near), (near, got, words)
            for s in got:
                assert distance(" ".join(words[s[1] : s[2]]), notice.phrase) == s[3]


def test_a_megabyte_of_notices_and_of_one_word():
    for text in ("licensed under the apache licence version 2 and released undr the mit license " * 13_000, "mozilla" * 150_000, "public " * 150_000):
        begin = time.perf_counter()
        licenses.scan_text(text.encode())
        assert time.perf_counter() - begin < 5


def test_empty_table_and_repeats(table):
    assert licenses.scan(table((1, "x")).limit(0)).count() == 0
    assert licenses.scan(table(*[(None, "under the mit license")] * 3)).where("n_base = 1").count() == 3

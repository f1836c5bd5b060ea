import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm import packing

COLUMNS = ["doc_id", "text", "lang", "source", "rid"]
FRENCH = "le chat est sur la table et la maison est grande avec un jardin pour les enfants "
ENGLISH = "the cat sits on the table and the house is large with a garden for the children "


def rows():
    out = [(i, f"{ENGLISH} number {'abcdefghij'[i % 10]} " * (1 + i % 4) + "word" * i, "en", f"s{i % 3}") for i in range(40)]
    out += [(100 + i, f"{FRENCH} numero {'klmnopqrst'[i % 10]} " * (1 + i % 4) + "mot" * i, "fr", None) for i in range(40)]
    out += [(300, out[0][1] + "  ", "en", "s1"), (301, None, "en", "s1"), (302, "12345 !!", "en", "s1"), (303, out[1][1], None, "s2")]
    return out


def collected(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def test_stages_are_those_asked_for():
    assert len(corpus_pipeline.STAGES) == 5


def test_language_stage_keeps_texts_and_drops_what_has_no_letters(table, spark):
    got = collected(corpus_pipeline.known_language(spark, table(*rows()), ""))
    assert {r[0] for r in got} == {r[0] for r in rows()} - {301, 302}
    assert {r[4] for r in got} == {7}


def test_exact_stage_keeps_one_of_each_group(table, spark):
    got = collected(corpus_pipeline.without_copies(spark, table(*rows(), *rows()), ""))
    groups = {}
    for r in rows():
        body = "".join((r[1] or "").split())
        groups.setdefault(body, []).append((-len(r[1] or ""), r[0]))
    assert Counter(r[0] for r in got) == Counter(min(g)[1] for g in groups.values())


def test_near_stage_keeps_one_of_each_component(table, spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = [(5, base), (2, base.replace("w7 ", "x ")), (9, base.replace("w7 ", "x ").replace("w60 ", "y ")), (1, "other " + base[:90]),
            (None, base), (3, ""), (4, None), (3, "")]
    got = collected(corpus_pipeline.without_near_copies(spark, table(*docs), ""))
    assert Counter(r[0] for r in got) == Counter([2, 1, 3, 3, 4])


def test_mix_stage_repeats_documents_near_targets(table, spark):
    docs = rows()
    got = Counter(r[0] for r in collected(corpus_pipeline.mixed_sources(spark, table(*docs), "")))
    assert got and max(got.values()) <= 3
    size = {r[0]: len((r[1] or "").split()) for r in docs}
    by_source = {}
    for r in docs:
        by_source.setdefault(r[3], []).append(r[0])
    for source, weight in (("s0", 5), ("s1", 2), ("s2", 1), (None, 5)):
        taken = sum(size[i] * got[i] for i in by_source[source])
        own = sum(size[i] for i in by_source[source])
        assert taken <= 3 * own + max(size.values())
        assert taken > 0


def test_packing_stage_places_every_token(table, spark):
    docs = [*rows(), (None, "x"), (7, "y"), (7, "y"), (500, "long text " * 6000)]
    got = corpus_pipeline.packed_sequences(spark, table(*docs), "").collect()
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for r in docs:
        ids = [*whole.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = np.array(ids[at : at + packing.CAPACITY], "<u4")
            want[r[0], piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // packing.CAPACITY) + 1


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns[:2] == ["doc_id", "piece"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_tables(table, spark, name, stage):
    assert stage(spark, table((1, "x")).limit(0), "").count() == 0

"""A training corpus from raw documents: five stages, each on all its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import exact, language, minhash, mixing, packing
from attestry.llm.common import packed, remainder, shared, text_of, unpacked, word_count

TOKENIZER = "word_bpe_49k.json"

# No SQL can express the stages; tests hold every one against a brute-force version.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go.

    Null texts, empty ones and those without a letter go; long ones are judged whole.
    Repeated rows and ties are judged alike, other columns pass through whatever their
    names, and an empty table stays empty.
    """
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    return unpacked(language.identify(docs, model).where(~F.col("rejected")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, blanks aside.

    The longest original stays, then the smallest id, null last; of rows that agree in
    both the first.  Null and empty texts are one group.  Other columns pass through
    whatever their names, and an empty table stays empty.
    """
    return unpacked(exact.exact_dedup(docs).where("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest id, null last.

    Texts without words, null ones too, are near to nothing and stay.  Of repeated rows
    one stays.  Other columns pass through whatever their names, and an empty table
    stays empty.
    """
    return unpacked(minhash.near_duplicates(docs).where("stays"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it; some not at all.

    Words are counted once; texts stay out of the ordering and meet its result by row.
    A null source is a source.  Null and empty texts have no words and take up nothing of
    a target.  Repeated rows are separate documents.  Other columns pass through whatever
    their names, and an empty table stays empty.
    """
    sized = shared(
        packed(
            docs, F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.col("source"),
            word_count(text_of()).alias("size"),
        ),
        "mix-rows",
    )
    taken = mixing.mix(sized.select("rid", "doc_id", "source", "size")).where("copies > 0").select("row.rid", "copies")
    repeated = sized.select("rid", "row").join(taken, "rid").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    )
    return unpacked(repeated)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    A null or empty text is one end token; a longer text than a sequence is cut.  Equal
    lengths are packed in the order they are met, repeated rows as separate documents.
    Only ids and texts are read, and an empty table gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

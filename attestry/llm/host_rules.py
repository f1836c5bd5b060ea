"""Quality rules judged per host: failures by host, shrunk rates, verdicts joined back.

Every document gets exact rule counts inside its own row.  Failures are then counted
per host, each host's failure rate is shrunk towards the corpus by a beta prior
fitted to the hosts, and a host whose rate is surely above the limit loses all its
documents.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import BLANK, let, shared, text_of, word_list

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50

# The method's own rules and limits.
SYMBOL_SHARE = 0.1  # symbols against characters in words
DUP_LINES = 3
HOST_LIMIT = 0.5  # a host fails above this share of failing documents
SURE = 2.0  # posterior standard deviations the rate must lie above the limit
MAX_STRENGTH = 1e6


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text.

    Windows are compared by 64-bit hashes of their words.  Windows are sorted by
    hash, so the cost is n log n in the words of one text however often it repeats.
    """
    def windows(hashes: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(hashes) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"),
                    i.alias("at"),
                ),
            )
        )

    def repeated(ordered: Column) -> Column:
        found = F.filter(
            ordered,
            lambda w, j: (w["h"] == F.get(ordered, j - 1)["h"]) | (w["h"] == F.get(ordered, j + 1)["h"]),
        )
        return F.sort_array(F.transform(found, lambda w: w["at"]))

    def covered(places: Column) -> Column:
        # Each window adds the words that the window before it did not cover.
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda s, at: F.struct(
                at.alias("last"), (s["n"] + F.least(F.lit(3), at - s["last"])).cast("long").alias("n")
            ),
            lambda s: s["n"],
        )

    counted = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda hashes: let(windows(hashes), lambda ordered: covered(repeated(ordered))),
    )
    return F.when(F.size(words) >= 3, counted).otherwise(F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(
        F.filter(F.split(text, "\n", -1), lambda line: F.length(F.regexp_replace(line, BLANK, "")) > 0),
        lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Rule counts and failures per document: one projection, nothing is shuffled."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), text_of(text).alias("text"))
    worded = body.withColumn("words", word_list(F.col("text")))
    counts = worded.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counts.withColumn("base_failed", base).withColumn(
        "failed",
        F.col("base_failed") | (F.col("n_symbols") > SYMBOL_SHARE * F.col("word_chars"))
        | (F.col("n_dup_lines") >= DUP_LINES),
    )


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT, sure: float = SURE) -> DataFrame:
    """Per host: documents, failures, shrunk rate and whether the host is rejected.

    The beta prior has the corpus failure rate as its mean; its strength comes from
    how much host rates vary beyond what their sizes explain (method of moments).
    With one host, or no such variance, the prior is as strong as it may be.  The
    prior is one row, read as scalar subqueries.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    sums = hosts.agg(
        F.sum("n").cast("double").alias("docs"), F.sum("failures").cast("double").alias("fails"),
        F.count(F.lit(1)).cast("double").alias("hosts"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("squares"),
    )
    mean = F.col("fails") / F.col("docs")
    spread = F.greatest(
        (F.col("squares") - F.col("docs") * mean * mean - (F.col("hosts") - 1) * mean * (1 - mean)) / F.col("docs"),
        F.lit(0.0),
    )
    strength = F.when(
        spread > 0, F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(MAX_STRENGTH))
    ).otherwise(MAX_STRENGTH)
    prior = sums.where("docs > 0").select((mean * strength).alias("alpha"), ((1 - mean) * strength).alias("beta"))
    judged = hosts.withColumn("alpha", prior.select("alpha").scalar()).withColumn(
        "beta", prior.select("beta").scalar()
    )
    total = F.col("n") + F.col("alpha") + F.col("beta")
    rate = (F.col("failures") + F.col("alpha")) / total
    deviation = F.sqrt(rate * (1 - rate) / (total + 1))
    return judged.select("host", "n", "failures", rate.alias("rate"), (rate - sure * deviation > limit).alias("rejected"))


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
               limit: float = HOST_LIMIT, sure: float = SURE) -> DataFrame:
    """Rule counts, the host's shrunk rate and the verdict of every document row.

    Null texts count as empty: no words, so the base rule fails.  A null host is a
    host of its own.  Repeated rows are judged row by row.  Empty tables give no
    rows.  Only the three named columns are read, so other columns cannot clash.
    The measured table is written to the shared folder: texts are read once.
    """
    measured = shared(measures(docs, doc_id, text, host), "host-rules")
    verdicts = host_verdicts(measured, limit, sure).select(F.col("host").alias("judged"), "rate", "rejected")
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("judged"))).drop("judged").withColumn(
        "kept", ~F.col("base_failed") & ~F.col("rejected")
    )

"""Report checks that need other tables: teardown and market reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import measures, urls
from attestry.operators import contracts, links

TEARDOWN_SECTIONS = ["## Target", "## Source Log", "## Angle Findings", "## Extracted Numbers"]


def teardown_report(
    reports: DataFrame, allowed: DataFrame, angles: list[str] = (), min_words: int = 500,
    min_citations: int = 3, min_numbers: int = 3,
) -> DataFrame:
    """Findings (report_id, rule): allowlisted citations, numbers, angles and sections."""
    text = F.col("text")
    low = F.lower(text)
    rules = [
        ("few-citations", F.size(urls.urls(text)) < min_citations),
        ("too-short", measures.bounded_words(text) < min_words),
        ("few-numbers", F.size(measures.numeric_facts(text)) < min_numbers),
        *[(f"angle:{a}", ~low.contains(a.lower())) for a in angles],
        *[(f"section:{s}", ~low.contains(s.lower())) for s in TEARDOWN_SECTIONS],
        ("no-fetch-status", ~low.contains("could not fetch") & ~low.contains("fetched")),
    ]
    own = contracts.findings(reports, ["report_id"], rules)
    cited = links.cited_urls(reports)
    outside = links.outside_allowlist(cited, allowed)
    bad = cited.join(outside.repartition("url"), "url", "left_semi").select("report_id").distinct()
    return own.unionByName(bad.withColumn("rule", F.lit("outside-allowlist")))


def market_report(
    reports: DataFrame, sources: DataFrame, terms: list[str], min_words: int, min_citations: int
) -> DataFrame:
    """Findings (report_id, rule) with the whole-URL prefix rule."""
    text = F.col("text")
    found = urls.urls(text, urls.MARKET_URL, urls.MARKET_TRAILING)
    cited = reports.select("report_id", F.explode(found).alias("url"))
    bad = links.outside_sources(cited, sources)
    marked = cited.join(bad.withColumn("_bad", F.lit(1)).repartition("url"), "url", "left")
    tally = marked.groupBy("report_id").agg(
        F.count_if(F.col("_bad").isNull()).alias("_good"), F.count("_bad").alias("_wrong")
    )
    rows = reports.join(tally, "report_id", "left")
    low = F.lower(text)
    return contracts.findings(
        rows, ["report_id"],
        [
            ("too-short", measures.spaced_words(text) < min_words),
            ("few-citations", F.coalesce("_good", F.lit(0)) < min_citations),
            ("outside-allowlist", F.coalesce("_wrong", F.lit(0)) > 0),
            *[(f"term:{t}", ~low.contains(t.lower())) for t in terms],
        ],
    )

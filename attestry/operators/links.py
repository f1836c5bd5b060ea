"""Cited URLs against allowlists and source reports.

"Same host and one path a prefix of the other" is turned into equi joins on
(host, path prefix, query key): each side lists its prefixes once, both sides are
distinct, and only semi/anti joins follow, so no host ever yields all its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import urls

MIN_PREFIX = 8
MIN_WHOLE_PREFIX = 34
ANY = "*"


def cited_urls(reports: DataFrame, text: str = "text", id_column: str = "report_id") -> DataFrame:
    return reports.select(id_column, F.explode(urls.urls(F.col(text))).alias("url"))


def _parts(rows: DataFrame) -> DataFrame:
    u = F.col("url")
    return rows.select("url").distinct().select(
        "url", urls.host(u).alias("host"), urls.path(u).alias("path"),
        urls.query_string(u).alias("query"),
    )


def _long(path: Column) -> Column:
    """Long enough without outer slashes to count as a prefix."""
    return F.char_length(F.regexp_replace(path, "^/+|/+$", "")) >= MIN_PREFIX


def _path_prefixes() -> Column:
    """Prefixes of ``path`` with a length that occurs on the other side."""
    return F.filter(urls.prefixes(F.col("path"), F.col("lengths")), _long)


def outside_allowlist(cited: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct cited URLs that no allowed URL covers.

    Covered: same host, queries equal or one of them empty, and equal paths or one
    path a prefix of the other, the shorter one at least eight characters.
    """
    c, a = _parts(cited), _parts(allowed)
    c_lengths, a_lengths = (urls.length_set(rows, "path", MIN_PREFIX) for rows in (c, a))
    c, a = c.withColumn("lengths", a_lengths), a.withColumn("lengths", c_lengths)
    # A cited query finds allowed rows with the same or no query; without one it finds all.
    cited_keys = F.when(F.col("query") == "", F.array(F.lit(ANY))).otherwise(
        F.array(F.lit(""), F.concat(F.lit("="), "query"))
    )
    allowed_keys = F.array(
        F.lit(ANY),
        F.when(F.col("query") == "", F.lit("")).otherwise(F.concat(F.lit("="), "query")),
    )

    def spread(rows: DataFrame, keys: Column, paths: Column) -> DataFrame:
        return (
            rows.withColumn("qk", F.explode(keys))
            .withColumn("p", F.explode(paths))
            .select("url", "host", "qk", "p")
        )

    whole = F.array("path")
    on = ["host", "qk", "p"]

    def covered(left: DataFrame, right: DataFrame) -> DataFrame:
        # Exchanges of their own on both sides let adaptive execution split a hot host.
        keys = right.select(*on).distinct().repartition(*on)
        return left.join(keys, on, "left_semi").select("url")

    starts = F.array_distinct(F.concat(whole, _path_prefixes()))
    forward = covered(spread(c, cited_keys, starts), spread(a, allowed_keys, whole))
    backward = covered(
        spread(c, cited_keys, F.filter(whole, _long)), spread(a, allowed_keys, _path_prefixes())
    )
    matched = forward.unionByName(backward).distinct()
    return c.select("url").join(matched, "url", "left_anti")


def outside_sources(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Market variant: whole URLs equal, or one a prefix of the other from 34 characters."""
    trimmed = F.regexp_replace("url", "/+$", "")
    c = cited.select("url", trimmed.alias("p")).distinct()
    a = sources.select(trimmed.alias("p")).distinct()
    sizes_a = urls.length_set(a, "p", MIN_WHOLE_PREFIX)
    sizes_c = urls.length_set(c, "p", MIN_WHOLE_PREFIX)
    c, a = c.withColumn("lengths", sizes_a), a.withColumn("lengths", sizes_c)
    same = c.join(a.select("p"), "p", "left_semi").select("url")
    longer = (
        c.select("url", F.explode(urls.prefixes(F.col("p"), F.col("lengths"))).alias("p"))
        .join(a.select("p").repartition("p"), "p", "left_semi").select("url")
    )
    shorter = c.join(
        a.select(F.explode(urls.prefixes(F.col("p"), F.col("lengths"))).alias("p")).distinct(), "p", "left_semi"
    ).select("url")
    matched = same.unionByName(longer).unionByName(shorter).distinct()
    return c.select("url").distinct().join(matched, "url", "left_anti")


def new_urls(synthesis: DataFrame, scouts: DataFrame) -> DataFrame:
    """URLs of a synthesis that none of its group's source reports cite."""
    ours = synthesis.select("report_id", "group_id", F.explode(urls.urls(F.col("text"))).alias("url"))
    theirs = scouts.select("group_id", F.explode(urls.urls(F.col("text"))).alias("url")).distinct()
    return ours.join(theirs.repartition("group_id", "url"), ["group_id", "url"], "left_anti")

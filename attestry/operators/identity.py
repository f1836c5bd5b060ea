"""Resolving (engine, model) labels to display names, harness and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.values import nonblank, trimmed

# Fixed names: the one engine whose unlisted keys are router slugs, and their prefix.
ROUTER_ENGINE = "opencode"
ROUTER_PREFIX = "openrouter/"
ROUTER_HARNESS = "OpenCode"
ROUTER_ACCESS = "OpenRouter API"


def registry_engines(engines: DataFrame) -> DataFrame:
    """Engine dimension: trimmed, blanks defaulted, one row per engine."""
    name = trimmed(F.col("engine"))
    rows = engines.select(
        name.alias("engine"),
        F.coalesce(nonblank(F.col("harness")), name).alias("harness"),
        F.coalesce(nonblank(F.col("access")), F.lit("unknown")).alias("access"),
        nonblank(F.col("default_model_key")).alias("default_model_key"),
    ).where(F.col("engine") != "")
    return rows.groupBy("engine").agg(
        F.min(F.struct("harness", "access", "default_model_key")).alias("m")
    ).select("engine", "m.*")


def registry_models(models: DataFrame) -> DataFrame:
    """Model dimension: blank keys dropped, display defaults to the key."""
    key = trimmed(F.col("model_key"))
    rows = models.select(
        trimmed(F.col("engine")).alias("engine"), key.alias("model_key"),
        F.coalesce(nonblank(F.col("display")), key).alias("display"),
        trimmed(F.col("confidence")).alias("confidence"), trimmed(F.col("source")).alias("source"),
    ).where((F.col("engine") != "") & (F.col("model_key") != ""))
    return rows.groupBy("engine", "model_key").agg(
        F.min(F.struct("display", "confidence", "source")).alias("m")
    ).select("engine", "model_key", "m.*")


def resolve(labels: DataFrame, engines: DataFrame, models: DataFrame) -> DataFrame:
    """Adds model_display, harness, access, confidence and source to ``labels``.

    ``labels`` has ``engine`` and ``model``.  Two left joins on small dimensions
    (adaptive execution broadcasts them when their measured size allows) and one
    ladder of fallbacks: listed key, router slug, known engine, unknown.
    """
    meta = registry_engines(engines).select(
        F.col("engine").alias("_ek"), F.col("harness").alias("_h"), F.col("access").alias("_a"),
        F.col("default_model_key").alias("_default"),
    )
    listed = registry_models(models).select(
        F.col("engine").alias("_le"), F.col("model_key").alias("_lk"), F.col("display").alias("_d"),
        F.col("confidence").alias("_c"), F.col("source").alias("_s"),
    )
    engine, raw = F.coalesce(trimmed(F.col("engine")), F.lit("")), trimmed(F.col("model"))
    base = labels.withColumn("_engine", engine).withColumn("_raw", F.coalesce(raw, F.lit("")))
    joined = base.join(meta, F.col("_engine") == F.col("_ek"), "left").withColumn(
        "_lookup", F.coalesce(F.nullif(F.col("_raw"), F.lit("")), F.col("_default"))
    )
    joined = joined.join(
        listed, (F.col("_engine") == F.col("_le")) & (F.col("_lookup") == F.col("_lk")), "left"
    )
    hit = F.col("_lk").isNotNull()
    known = F.col("_ek").isNotNull()
    slug = (F.col("_engine") == ROUTER_ENGINE) & F.col("_raw").startswith(ROUTER_PREFIX)
    fallback = known & F.col("_lookup").isNotNull()
    unknown = F.coalesce(F.nullif(F.col("_engine"), F.lit("")), F.lit("unknown"))

    def ladder(found: Column, routed: Column, default: Column, other: Column) -> Column:
        return F.when(hit, found).when(slug, routed).when(fallback, default).otherwise(other)

    return joined.select(
        *labels.columns,
        ladder(
            F.col("_d"), F.substr(F.col("_raw"), F.lit(len(ROUTER_PREFIX) + 1)),
            F.col("_lookup"), unknown,
        ).alias("model_display"),
        ladder(
            F.col("_h"), F.coalesce("_h", F.lit(ROUTER_HARNESS)), F.col("_h"), unknown
        ).alias("harness"),
        ladder(
            F.col("_a"), F.coalesce("_a", F.lit(ROUTER_ACCESS)), F.col("_a"), F.lit("unknown")
        ).alias("access"),
        ladder(F.col("_c"), F.lit("fallback"), F.lit("fallback"), F.lit("unknown")).alias("confidence"),
        ladder(
            F.col("_s"), F.lit("unlisted OpenRouter slug"), F.lit("engine default model key"), F.lit("")
        ).alias("source"),
    )

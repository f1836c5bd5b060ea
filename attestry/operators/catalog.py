"""Price catalog: normalisation, ordering, snapshot diff and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.values import (
    integer, json_number, json_text, json_type, nonblank, null, number, truncated,
)

SNAPSHOT = [
    "id", "name", "context_length", "modality", "prompt_per_m", "completion_per_m",
    "variable_pricing", "pricing_unknown", "free",
]
FREE_SUFFIX = ":free"
PER_MILLION = 1e6
MAX_AGE_HOURS = 24
EXPLORE_CONTEXT = 32_000


def normalise(raw: DataFrame, document: str = "raw", fetched_at: Column | None = None) -> DataFrame:
    """Flat catalog rows from a column of raw JSON objects, one model each.

    A price is unknown when blank or unparseable; a model with an unknown or a
    negative price has variable pricing and no per-million prices.  Rows without
    an id are dropped.
    """
    v = F.col("_v")
    parsed = raw.withColumn("_v", F.try_parse_json(document))
    fields = parsed.select(
        *[c for c in raw.columns if c != document],
        F.coalesce(nonblank(json_text(v, "$.id")), F.lit("")).alias("id"),
        nonblank(json_text(v, "$.name")).alias("_name"),
        _context(v, "$.context_length").alias("context_length"),
        F.coalesce(nonblank(json_text(v, "$.architecture.modality")), F.lit("")).alias("modality"),
        number(json_text(v, "$.pricing.prompt")).alias("_prompt"),
        number(json_text(v, "$.pricing.completion")).alias("_completion"),
    ).where(F.col("id") != "")
    prompt, completion = F.col("_prompt"), F.col("_completion")
    unknown = prompt.isNull() | completion.isNull()
    variable = unknown | (prompt < 0) | (completion < 0)
    slug_free = F.col("id").endswith(FREE_SUFFIX)
    return fields.select(
        *[c for c in raw.columns if c != document],
        "id", F.coalesce("_name", "id").alias("name"), "context_length", "modality",
        F.when(~variable, prompt * PER_MILLION).alias("prompt_per_m"),
        F.when(~variable, completion * PER_MILLION).alias("completion_per_m"),
        variable.alias("variable_pricing"), unknown.alias("pricing_unknown"),
        (slug_free | (~variable & (prompt == 0) & (completion == 0))).alias("free"),
        *([fetched_at.alias("fetched_at")] if fetched_at is not None else []),
    )


def _context(v: Column, path: str) -> Column:
    """JSON numbers are truncated, strings must be whole, anything else is 0."""
    text = json_type(v, path) == "STRING"
    whole = F.when(text, integer(json_text(v, path))).otherwise(truncated(json_number(v, path)))
    return F.coalesce(whole.try_cast("int"), F.lit(0))


def models_from_documents(documents: DataFrame, body: str = "body") -> DataFrame:
    """Catalog rows from whole documents of any accepted shape.

    ``{"data": [raw, ...]}`` goes through :func:`normalise`; ``{"models": [...]}``
    and a bare list already hold normalised rows.
    """
    v = F.try_parse_json(body)
    shaped = documents.withColumn("_v", v).select(
        *[c for c in documents.columns if c != body],
        F.try_variant_get("_v", "$.data", "array<variant>").alias("_raw"),
        F.coalesce(
            F.try_variant_get("_v", "$.models", "array<variant>"),
            F.try_variant_get("_v", "$", "array<variant>"),
        ).alias("_ready"),
    )
    keep = [c for c in documents.columns if c != body]
    raw = shaped.where(F.col("_raw").isNotNull()).select(
        *keep, F.explode("_raw").alias("_r")
    ).select(*keep, F.to_json("_r").alias("raw"))
    ready = shaped.where(F.col("_raw").isNull() & F.col("_ready").isNotNull()).select(
        *keep, F.explode("_ready").alias("_m")
    )
    m = F.col("_m")

    def flag(name: str) -> Column:
        return F.coalesce(F.try_variant_get(m, f"$.{name}", "boolean"), F.lit(False)).alias(name)

    typed = ready.select(
        *keep,
        F.coalesce(json_text(m, "$.id"), F.lit("")).alias("id"),
        F.coalesce(json_text(m, "$.name"), F.lit("")).alias("name"),
        F.coalesce(F.try_variant_get(m, "$.context_length", "int"), F.lit(0)).alias("context_length"),
        F.coalesce(json_text(m, "$.modality"), F.lit("")).alias("modality"),
        F.try_variant_get(m, "$.prompt_per_m", "double").alias("prompt_per_m"),
        F.try_variant_get(m, "$.completion_per_m", "double").alias("completion_per_m"),
        flag("variable_pricing"), flag("pricing_unknown"), flag("free"),
    ).where(F.col("id") != "")
    return normalise(raw).unionByName(typed)


def snapshot_rows(models: DataFrame, position: Column | None = None) -> DataFrame:
    """Keyed snapshot: blank ids dropped, the last row of an id by ``position`` wins.

    Without a position the choice among duplicates is by value, so that every
    recomputation picks the same row.
    """
    kept = F.struct(*[c for c in models.columns if c != "id"])
    pick = F.max(kept) if position is None else F.max_by(kept, position)
    named = models.where(F.col("id") != "")
    return named.groupBy("id").agg(pick.alias("_r")).select("id", "_r.*")


def price_sum() -> Column:
    return F.coalesce("prompt_per_m", F.lit(0.0)) + F.coalesce("completion_per_m", F.lit(0.0))


def catalog_order() -> list[Column]:
    """Fixed prices first, cheapest first; variable rows go by id alone."""
    return [
        F.col("variable_pricing"),
        F.when(F.col("variable_pricing"), F.lit(float("inf"))).otherwise(price_sum()),
        F.col("id"),
    ]


def sorted_catalog(models: DataFrame, free_only: bool = False) -> DataFrame:
    rows = free_models(models) if free_only else models
    return rows.orderBy(*catalog_order())


def free_models(models: DataFrame) -> DataFrame:
    return models.where(F.col("free"))


def stale(snapshot: DataFrame, now: Column, max_age_hours: int = MAX_AGE_HOURS) -> DataFrame:
    """One row: the newest fetch stamp and whether the snapshot needs a refresh."""
    newest = snapshot.agg(F.max("fetched_at").alias("newest"))
    age = F.try_to_timestamp(now) - F.try_to_timestamp("newest")
    old = age > F.make_dt_interval(hours=F.lit(max_age_hours))
    return newest.withColumn("stale", F.coalesce(old, F.lit(True)))


def key_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of both snapshots with the side they are on."""
    o = old.where(F.col("id") != "").select("id", F.lit(True).alias("_old"))
    n = new.where(F.col("id") != "").select("id", F.lit(True).alias("_new"))
    side = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .otherwise("common")
    )
    return o.join(n, "id", "full_outer").select("id", side.alias("side"))


def diff(old: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """Change events between two keyed snapshots.

    One full outer join on id; every event kind of a row comes from one array,
    so nothing is scanned or shuffled twice.  ``grp``/``pos`` give the event
    order: added, removed, then changes by id.
    """
    o = old.where(F.col("id") != "").select("id", F.struct(*_present(old)).alias("o"))
    n = new.where(F.col("id") != "").select("id", F.struct(*_present(new)).alias("n"))
    both = o.join(n, "id", "full_outer")

    def price(side: str, field: str) -> Column:
        return F.coalesce(F.col(f"{side}.{field}"), F.lit(0.0))

    moved = (price("o", "prompt_per_m") != price("n", "prompt_per_m")) | (
        price("o", "completion_per_m") != price("n", "completion_per_m")
    )
    o_var, n_var = F.col("o.variable_pricing"), F.col("n.variable_pricing")
    o_free, n_free = F.col("o.free"), F.col("n.free")
    fixed = ~o_var & ~n_var
    kinds = (
        F.when(F.col("o").isNull(), F.array(F.lit("added")))
        .when(F.col("n").isNull(), F.array(F.lit("removed")))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when(n_var & ~o_var, F.lit("pricing_variable")),
                    F.when(~n_var & o_var, F.lit("pricing_fixed")),
                    F.when(fixed & moved, F.lit("price_change")),
                    F.when(
                        (~n_var & o_var & n_free) | (fixed & n_free & ~o_free), F.lit("went_free")
                    ),
                    F.when(fixed & o_free & ~n_free, F.lit("went_paid")),
                )
            )
        )
    )
    one = F.coalesce("n", "o")
    listed = F.col("o").isNull() | F.col("n").isNull()
    payload = F.struct(
        F.when(listed, one["name"])
        .otherwise(F.coalesce(F.nullif(F.col("n.name"), F.lit("")), F.col("o.name"))).alias("name"),
        *[
            F.when(listed, F.coalesce(one[c], F.lit(0.0))).alias(c)
            for c in ("prompt_per_m", "completion_per_m")
        ],
        *[
            F.when(listed, one[c]).alias(c)
            for c in ("variable_pricing", "pricing_unknown", "free", "context_length", "modality")
        ],
        *[
            F.when(~listed, price(side, f"{field}_per_m")).alias(f"{word}_{field}_per_m")
            for field in ("prompt", "completion")
            for side, word in (("o", "old"), ("n", "new"))
        ],
        F.when(~listed, o_free).alias("old_free"),
        F.when(~listed, n_free).alias("new_free"),
    )
    group = F.when(F.col("o").isNull(), 0).when(F.col("n").isNull(), 1).otherwise(2)
    # The payload is built before the explode: a generator drops aliases inside structs.
    rows = both.select(
        group.alias("grp"), F.col("id").alias("model_id"), payload.alias("payload"),
        kinds.alias("kinds"),
    )
    return rows.select(
        ts.alias("ts"), "model_id", "payload", "grp", F.posexplode("kinds").alias("pos", "kind")
    ).select("ts", "kind", "model_id", "payload", "grp", "pos")


def _present(snapshot: DataFrame) -> list[str]:
    return [c for c in SNAPSHOT if c != "id" and c in snapshot.columns]


def event_order() -> list[Column]:
    return [F.col("ts"), F.col("grp"), F.col("model_id"), F.col("pos")]


def ordered_events(events: DataFrame) -> DataFrame:
    return events.orderBy(*event_order())


def event_rows(events: DataFrame) -> DataFrame:
    """Events with the payload as JSON text; fields of the other event family stay out."""
    return events.withColumn("payload", F.to_json("payload"))


def recent_events(events: DataFrame, limit: int) -> DataFrame:
    newest = [F.desc("ts"), F.desc("grp"), F.desc("model_id"), F.desc("pos")]
    return events.orderBy(*newest).limit(limit)


def untested(catalog: DataFrame, tested: DataFrame, strip_prefix: bool = False) -> DataFrame:
    """Catalog models without local evidence.

    ``tested.model`` holds labels as they were logged; by default they are
    compared as they stand, so a router-prefixed label does not count.
    """
    from attestry.operators.scoreboard import catalog_key

    label = catalog_key(F.col("model")) if strip_prefix else F.col("model")
    return catalog.join(tested.select(label.alias("id")).distinct(), "id", "left_anti")


def explorable(catalog: DataFrame, min_context: int = EXPLORE_CONTEXT) -> DataFrame:
    """Text models with enough context; a blank modality counts as text."""
    modality = F.col("modality")
    return catalog.where(
        (F.col("context_length") >= min_context)
        & (modality.contains("text->text") | modality.isin("text", ""))
    )


def explore_queue(
    catalog: DataFrame, tested: DataFrame, limit: int | None = None, strip_prefix: bool = False
) -> DataFrame:
    """Untested candidates in catalog order; uncapped unless ``limit`` asks for a top."""
    queue = explorable(untested(catalog, tested, strip_prefix)).orderBy(*catalog_order())
    return queue if limit is None else queue.limit(limit)

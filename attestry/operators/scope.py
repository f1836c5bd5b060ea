"""Path scoping, symbol lookup and required text over file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.paths import ancestors, normal
from attestry.session import cut_lineage

WILDCARD = "*"
BINARY_PROBE = 2_048
# Lengths of the n-grams looked up: the longest that a run of a needle has room for.
GRAM_CHARS = [6, 3, 2, 1]
# Fixed list: folders that are never searched.
SKIP_DIRS = [
    ".git", ".hg", ".svn", "node_modules", ".next", "dist", "build", "coverage", "__pycache__",
    ".venv", "venv",
]


def under(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (task_id, path) of ``changed`` that lie at or below a root of their task.

    Each path lists its ancestors, so "starts with" becomes an equi semi join.
    """
    keys = roots.select("task_id", normal(F.col("path")).alias("_p")).where("_p <> ''").distinct()
    spread = changed.select("task_id", "path").distinct().withColumn(
        "_p", F.explode(ancestors(normal(F.col("path"))))
    )
    return spread.join(keys.repartition("task_id", "_p"), ["task_id", "_p"], "left_semi").select(
        "task_id", "path"
    ).distinct()


def above(changed: DataFrame, roots: DataFrame) -> DataFrame:
    """Changed folders that contain a root (an untracked parent shows as one entry)."""
    keys = roots.select(
        "task_id", F.explode(ancestors(normal(F.col("path")))).alias("_p")
    ).distinct()
    rows = changed.select("task_id", "path").distinct().withColumn("_p", normal(F.col("path")))
    return rows.join(keys, ["task_id", "_p"], "left_semi").select("task_id", "path")


def outside_scope(changed: DataFrame, owned: DataFrame, parents_allowed: bool = False) -> DataFrame:
    """Changed paths no owned prefix covers; a ``*`` entry owns everything of its task."""
    allowed = under(changed, owned)
    if parents_allowed:
        allowed = allowed.unionByName(above(changed, owned))
    free = owned.where(F.trim("path") == WILDCARD).select("task_id").distinct()
    return (
        changed.select("task_id", "path").distinct()
        .join(free, "task_id", "left_anti")
        .join(allowed, ["task_id", "path"], "left_anti")
    )


def unchanged_tasks(tasks: DataFrame, changed: DataFrame) -> DataFrame:
    """Tasks that changed no path at all: nothing was added or edited."""
    touched = changed.select("task_id").distinct()
    return tasks.select("task_id").distinct().join(touched, "task_id", "left_anti")


def in_forbidden(changed: DataFrame, forbidden: DataFrame) -> DataFrame:
    return under(changed, forbidden)


def searchable(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Text files outside the skipped folders; ``max_bytes`` leaves larger ones out."""
    folders = F.split("path", "/")
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    data = F.col("content").cast("binary")
    # Hex pairs: only a pair at an even offset is a zero byte.
    binary = F.hex(F.substring(data, 1, BINARY_PROBE)).rlike("^(?:..)*?00")
    return within(files.where(~skipped & ~binary), max_bytes)


def within(files: DataFrame, max_bytes: int | None) -> DataFrame:
    return files if max_bytes is None else files.where(F.octet_length("content") <= max_bytes)


def oversized(files: DataFrame, max_bytes: int) -> DataFrame:
    """Paths a size limit keeps out of a search, with their sizes."""
    size = F.octet_length("content")
    return files.where(size > max_bytes).select("path", size.alias("bytes"))


BLANKS = r"\s+"


LONG_RUN = 64


def _grams(run: Column, size: Column) -> Column:
    """Distinct n-grams of a run that is at least ``size`` long.

    Cutting at a place counts characters from the run's beginning, so a long run is
    walked once instead: what lies ahead of each of its characters.
    """
    places = F.sequence(F.lit(1), F.char_length(run) - size + 1)
    cut = F.transform(places, lambda at: F.substring(run, at, size))
    ahead = F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))."))
    walked = F.regexp_extract_all(run, ahead, F.lit(1))
    return F.array_distinct(F.when(F.char_length(run) <= LONG_RUN, cut).otherwise(walked))


def texts_held(needles: DataFrame, texts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct needles that occur in a text of their group: columns ``by`` and ``needle``.

    ``needles`` has columns ``by`` and ``needle``, ``texts`` has ``by`` and ``content``.
    Needles and texts are cut at blanks.  Where a needle occurs, each of its words lies in
    a word of the text, so an index of n-grams is made of the distinct words of all texts,
    and each needle looks up the one n-gram of its own that fewest texts hold.  A needle
    without blanks is found once such a word contains it; any other is compared with the
    texts that hold a fitting word.  Needles without a common n-gram go before any text is
    compared.  Needles of nothing but blanks are looked up in the distinct runs of blanks.
    Empty needles occur nowhere; null ones and null texts are left out.
    """
    by = list(by)
    names = needles.where(F.col("needle") != "").select(*by, "needle").distinct()
    blank = F.col("needle").rlike(r"\A\s+\z")
    single = ~F.col("needle").rlike(r"\s") | blank
    words = F.when(blank, F.array("needle")).otherwise(F.split("needle", BLANKS))
    size = F.lit(GRAM_CHARS[-1])
    for n in GRAM_CHARS[-2::-1]:
        size = F.when(F.char_length("run") >= n, n).otherwise(size)
    keys = (
        names.withColumns({"single": single, "words": words})
        .select(*by, "needle", "single", F.size("words").alias("words"), F.posexplode("words").alias("at", "run"))
        .where("run <> ''").withColumn("size", size)
        .withColumn("gram", F.explode(_grams(F.col("run"), F.col("size"))))
    )
    seen = keys.agg(
        F.struct(F.collect_set("size").alias("sizes"), F.bool_or(blank).alias("blank"), F.bool_or(~F.col("single")).alias("across"))
    ).scalar()
    any_across = F.coalesce(seen["across"], F.lit(False))
    none = F.array().cast("array<string>")

    held = texts.where("content is not null").select(*by, F.col("content").cast("string").alias("content"))
    cut = F.split("content", BLANKS)
    gaps = F.when(seen["blank"], F.regexp_extract_all("content", F.lit(BLANKS), F.lit(0))).otherwise(none)
    # Two branches, so that cutting the texts does not wait for what needles there are.
    pieces = (
        held.select(*by, F.explode(F.array_distinct(cut)).alias("piece")).where("piece <> ''")
        .groupBy(*by, "piece").agg(F.count("*").alias("texts"))
        .unionByName(
            held.select(*by, F.explode(F.array_distinct(gaps)).alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("texts"))
        )
        .withColumn("sizes", seen["sizes"])
    )
    fitting = F.filter("sizes", lambda n: n <= F.char_length("piece"))
    index = pieces.select(
        *by, "piece", "texts", F.explode(F.flatten(F.transform(fitting, lambda n: _grams(F.col("piece"), n)))).alias("gram")
    )
    # Both readers below would make all n-grams of all words again.
    hits = cut_lineage(index.join(keys.select(*by, "gram").distinct(), [*by, "gram"], "left_semi"))
    counts = hits.groupBy(*by, "gram").agg(F.sum("texts").alias("held"))
    # A needle with an n-gram that no text holds occurs nowhere.
    held_by = F.coalesce("held", F.lit(0))
    rarest = (
        keys.join(counts, [*by, "gram"], "left").groupBy(*by, "needle")
        .agg(F.min_by(F.struct("single", "words", "gram", "run", "at"), held_by).alias("best"), F.min(held_by).alias("held"))
        .where("held > 0").select(*by, "needle", "best.*")
    )
    whole = rarest.where(F.col("needle") == F.col("gram")).select(*by, "needle")
    first, last = F.col("at") == 0, F.col("at") == F.col("words") - 1
    fits = (
        F.when(F.col("single"), F.contains("piece", "run")).when(first, F.endswith("piece", "run"))
        .when(last, F.startswith("piece", "run")).otherwise(F.col("piece") == F.col("run"))
    )
    near = rarest.where(F.col("needle") != F.col("gram")).join(hits, [*by, "gram"]).where(fits)
    inside = near.where("single").select(*by, "needle")
    keyed = held.withColumn("text_key", F.xxhash64("content"))
    across = (
        near.where(~F.col("single")).select(*by, "needle", "piece")
        .join(
            keyed.select(*by, "text_key", F.explode(F.array_distinct(F.when(any_across, cut).otherwise(none))).alias("piece")),
            [*by, "piece"],
        )
        .select(*by, "needle", "text_key").distinct()
        .join(keyed.where(any_across), [*by, "text_key"]).where(F.contains("content", "needle")).select(*by, "needle")
    )
    return whole.unionByName(inside).unionByName(across).distinct()


def symbols_found(symbols: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Distinct symbols that occur in some searchable file."""
    held = texts_held(symbols.select(F.col("symbol").alias("needle")), searchable(files, max_bytes))
    return held.withColumnRenamed("needle", "symbol")


def missing_symbols(symbols: DataFrame, files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Documented symbols that occur in no source file."""
    found = symbols_found(symbols, files, max_bytes)
    return symbols.join(found.repartition("symbol"), "symbol", "left_anti").select("doc_id", "symbol")


def missing_text(
    snippets: DataFrame, owned: DataFrame, files: DataFrame, max_bytes: int | None = None
) -> DataFrame:
    """Required snippets that no owned file of their task contains.

    Files above ``max_bytes`` are left out, see ``oversized``; by default none is.
    """
    small = within(files, max_bytes)
    wild = owned.where(F.trim("path") == WILDCARD).select("task_id").distinct()
    mine = under(small, owned.where(F.trim("path") != WILDCARD))
    named = small.join(wild, "task_id", "left_anti").join(mine, ["task_id", "path"], "left_semi")
    texts = small.join(wild, "task_id", "left_semi").unionByName(named).select("task_id", "content")
    wanted = snippets.select("task_id", F.col("snippet").alias("needle")).distinct()
    return wanted.join(texts_held(wanted, texts, ["task_id"]), ["task_id", "needle"], "left_anti").select(
        "task_id", F.col("needle").alias("snippet")
    )

"""Secret scan: single secrets by pattern, and credentials linked from their parts.

Matches are located by the text between them: ``split`` gives the gaps, so running
sums of gap and match lengths are positions.  Some parts are too weak to report
alone (a 40-character string, an identifier, an endpoint).  They are joined by
interval within a scope of the same document, and reported only where complementary
parts stand together.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import packed, shared, text_of

# Fixed values of the contract: base patterns and least lengths, in the order listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS, ACCESS_LENGTH = r"AKIA[A-Z0-9]+", 20
HEX_LENGTH = 24
# A run of at least so many characters is the run that [0-9a-f]+ finds and keeps.
HEX = rf"[0-9a-f]{{{HEX_LENGTH},}}"

# The method's own parts.
STRING = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
IDENTIFIER = (
    r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
)
ENDPOINT = r"""(?:https?|ftp|postgres|mysql|mongodb|redis)://[^\s"'<>\\)]+"""
SCOPE = 300  # code points between parts of one credential


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    role: str  # what the part is in a credential
    weak: bool = False
    least: int = 0
    value: bool = False  # the length rule is about the first group
    hint: str | None = None  # a cheap pattern without which the other cannot match


KINDS = (
    Kind("assign", ASSIGN, "secret", least=ASSIGN_VALUE, value=True, hint="(?i)password|passwd|secret|token|api_?key"),
    Kind("access", ACCESS, "identifier", least=ACCESS_LENGTH, hint="AKIA"),
    Kind("hex", HEX, "secret", least=HEX_LENGTH),
    Kind("string", STRING, "secret", weak=True),
    Kind("identifier", IDENTIFIER, "identifier", weak=True, hint="(?i)_?id|name|login"),
    Kind("endpoint", ENDPOINT, "endpoint", weak=True, hint="://"),
)


def matches(text: Column, kind: Kind) -> Column:
    """Per match: length of the gap before it, its own length, length to be judged."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)) if kind.value else found
    rows = F.zip_with(
        F.zip_with(
            F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(found)), found,
            lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size")),
        ),
        judged,
        lambda at, value: F.struct(at["gap"].alias("gap"), at["size"].alias("size"), F.length(value).alias("judged")),
    )
    likely = text.contains(kind.hint) if kind.hint in ("AKIA", "://") else text.rlike(kind.hint or kind.pattern)
    return F.when(likely & text.rlike(kind.pattern), rows)


def parts(located: DataFrame) -> DataFrame:
    """``(rid, kind, start, end)`` of every match that passes its length rule."""
    rows = located.select(
        "rid", F.explode("found").alias("f")
    ).select("rid", "f.kind", F.posexplode("f.at").alias("place", "m")).select("rid", "kind", "place", "m.*")
    running = Window.partitionBy("rid", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(running)
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    return rows.withColumn("end", end).where(F.col("judged") >= least).select(
        "rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end"
    )


def kinds_of(role: str | None = None, weak: bool | None = None) -> list[int]:
    return [i for i, k in enumerate(KINDS) if role in (None, k.role) and weak in (None, k.weak)]


def near(these: DataFrame, others: DataFrame, overlap: bool = False) -> DataFrame:
    """Rows of ``these`` with a row of ``others`` of the same document in scope.

    Both sides meet in stretches of one scope's length: the others are entered in
    every stretch they are within reach of, so the join is on equal keys and stops at
    the first partner.
    """
    reach = 0 if overlap else SCOPE
    low = F.floor((F.col("start") - reach) / SCOPE)
    entered = others.select(
        F.col("rid").alias("in_rid"), F.col("start").alias("from"), F.col("end").alias("to"),
        F.explode(F.sequence(low, F.floor((F.col("end") + reach) / SCOPE))).alias("in_stretch"),
    )
    meets = (F.col("start") < F.col("to") + reach) & (F.col("from") < F.col("end") + reach)
    stretched = these.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE))))
    return stretched.join(
        entered, (F.col("rid") == F.col("in_rid")) & (F.col("stretch") == F.col("in_stretch")) & meets, "left_semi"
    ).drop("stretch").distinct()


def linked(found: DataFrame) -> DataFrame:
    """Weak parts that complement others: a secret and an identifier in one scope, an
    endpoint with both.  A weak part inside a base match says nothing new."""
    base = found.where(F.col("kind").isin(kinds_of(weak=False)))
    weak = found.where(F.col("kind").isin(kinds_of(weak=True)))
    weak = weak.join(near(weak, base, overlap=True), ["rid", "kind", "start", "end"], "left_anti")

    def of(rows: DataFrame, role: str) -> DataFrame:
        return rows.where(F.col("kind").isin(kinds_of(role=role)))

    every = base.unionByName(weak)
    secrets, identifiers = of(every, "secret"), of(every, "identifier")
    return (
        near(of(weak, "secret"), identifiers)
        .unionByName(near(of(weak, "identifier"), secrets))
        .unionByName(near(near(of(weak, "endpoint"), secrets), identifiers))
    )


def spelled(rows: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(
        F.transform(
            F.sort_array(rows),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as one struct, with counts and spans per document.

    A null text counts as empty: no counts, empty strings.  Repeated rows are scanned
    each by itself, empty tables give no rows, other columns cannot clash.  Texts are
    read once; from then on only lengths of gaps and matches travel, and documents
    without a match meet no join partner.
    """
    found = F.filter(
        F.array(*[F.struct(F.lit(i).alias("kind"), matches(F.col("text"), k).alias("at")) for i, k in enumerate(KINDS)]),
        lambda f: f["at"].isNotNull(),
    )
    located = shared(
        packed(docs, F.monotonically_increasing_id().alias("rid"), text_of(text).alias("text")).select("row", "rid", found.alias("found")),
        "credential-parts",
    )
    every = shared(parts(located.where(F.size("found") > 0)), "credential-places")
    base = every.where(F.col("kind").isin(kinds_of(weak=False)))
    place = F.struct("start", "kind", "end")
    reported = base.withColumn("base", F.lit(True)).unionByName(linked(every).withColumn("base", F.lit(False)))
    by_document = reported.groupBy("rid").agg(
        *[F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if not k.weak],
        F.collect_list(F.when(F.col("base"), place)).alias("base_spans"),
        F.collect_list(place).alias("all_spans"),
    ).withColumnRenamed("rid", "of")
    none = F.lit(0).cast("long")
    return located.select("row", "rid").join(by_document, F.col("rid") == F.col("of"), "left").select(
        "row",
        *[F.coalesce(f"n_{k.name}", none).alias(f"n_{k.name}") for k in KINDS if not k.weak],
        F.sha2(F.coalesce(spelled(F.col("base_spans")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(spelled(F.col("all_spans")), F.lit("")).alias("spans"),
    )

"""What an expansion shows: order by the hierarchy, designations, displays, supplements and weights.

Designations are (code, lang, use, value, active, ord); lang may be null. A wanted language list is configuration, given as Python texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import catalogues as cat
from tessera.session import settled

DISPLAY_USES = ("display", "preferredForLanguage")  # Fixed values: uses that count as a display, beside none


def preorder(edges: DataFrame, codes: DataFrame, kept: Column) -> DataFrame:
    """(code, parent, depth, place) of the kept codes in depth-first order, children by code; a code under several parents stands where it comes first.

    Codes that aren't kept (abstract or inactive ones) are skipped, and their children go to the nearest kept ancestor; ``depth`` counts kept ancestors.
    Level by level: a round extends only paths that are new or come earlier, and a path never meets a code twice, so cycles end. Codes that no root
    leads to are left out.
    """
    c = settled(codes.select("code", F.coalesce(kept, F.lit(False)).alias("kept")).distinct())
    steps = settled(edges.select(F.col("parent").alias("at"), "child").filter("at IS NOT NULL AND child IS NOT NULL").distinct().join(c.select(F.col("code").alias("child"), F.col("kept").alias("child_kept")), "child"))
    tops = c.join(steps.select(F.col("child").alias("code")), "code", "left_anti")
    above = lambda code, keep, up: F.when(keep, F.concat(up, F.array(code))).otherwise(up)
    none = F.array().cast("array<string>")
    front = settled(tops.select("code", "kept", F.array("code").alias("path"), none.alias("up")))
    known = front
    while front.take(1):
        step = front.join(steps, F.col("code") == F.col("at")).filter(~F.array_contains("path", F.col("child")))
        step = step.select(F.col("child").alias("code"), F.col("child_kept").alias("kept"), F.concat("path", F.array("child")).alias("path"), above(F.col("code"), F.col("kept"), F.col("up")).alias("up"))
        best = step.groupBy("code").agg(F.min_by(F.struct("kept", "path", "up"), "path").alias("b")).select("code", "b.*")
        front = settled(best.join(known.select("code", F.col("path").alias("old")), "code", "left").filter("old IS NULL OR path < old").drop("old"))
        known = settled(known.join(front.select("code"), "code", "left_anti").unionByName(front))
    rows = known.filter("kept").select("code", F.try_element_at("up", F.lit(-1)).alias("parent"), F.size("up").alias("depth"), "path")
    return cat.numbered(rows, [F.col("path")], "place").drop("path")


def language_fits(lang: Column, wanted: list[str], level: int, default: str | None = None) -> Column:
    """Whether a language is wanted: 3 means the same tag, 2 the same language and region, 1 the same language. A missing language fits, and so does the default's."""
    hits = [text.language_match(lang, w) >= level for w in wanted]
    out = lang.isNull() | F.lit(not wanted)
    for hit in hits + ([text.language_match(lang, default) >= 3] if default else []):
        out = out | hit
    return F.coalesce(out, F.lit(True))


def is_display(use: Column) -> Column:
    return use.isNull() | use.isin(*DISPLAY_USES)


def chosen_designations(rows: DataFrame, wanted: list[str], uses: list[str] = ()) -> DataFrame:
    """Designations in a wanted language (all, if none is named) or of a wanted use."""
    fits = F.lit(not wanted and not uses)
    if wanted:
        fits = fits | (rows["lang"].isNotNull() & language_fits(rows["lang"], wanted, 1))
    return rows.filter(fits | F.coalesce(rows["use"].isin(*uses), F.lit(False)) if uses else fits)


def without_display(designations: DataFrame, displays: DataFrame) -> DataFrame:
    """Designations without those that only repeat the display (code, display) that is shown, in its language or none."""
    shown = displays.select("code", F.col("display").alias("value"), F.lit(True).alias("again")).distinct()
    return designations.join(shown, ["code", "value"], "left").filter("again IS NULL OR NOT (use IS NULL OR use = 'display')").select(*designations.columns)


def display_counts(rows: DataFrame, wanted: list[str], default: str | None = None) -> DataFrame:
    """(code, n): how many displays fit the wanted languages, by whole tags; if none does by language and region, then by language."""
    d = rows.filter(is_display(F.col("use")) & F.col("value").isNotNull() & (F.col("value") != ""))
    g = d.groupBy("code").agg(*[F.count_if(language_fits(F.col("lang"), wanted, k, default)).alias(f"n{k}") for k in (3, 2, 1)])
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return g.select("code", F.coalesce(zero("n3"), zero("n2"), F.col("n1")).alias("n"))


def allowed_displays(rows: DataFrame, wanted: list[str], most: int | None = None) -> DataFrame:
    """(code, displays): each code's different active displays in a wanted language, in order; with ``most`` only the first of them, for messages."""
    d = rows.filter(F.col("active") & is_display(F.col("use")) & (F.col("value") != "") & language_fits(F.col("lang"), wanted, 1))
    one = d.groupBy("code", "value").agg(F.min("ord").alias("ord"))
    if most:
        one = cat.first_by(one, ["code"], [F.asc("ord"), F.asc("value")], most=most)
    return one.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|").alias("displays"))


def overlaid(concepts: DataFrame, supplements: DataFrame) -> DataFrame:
    """(code, prop, value, source) of (code, prop, value) rows and the rows that supplements add to codes that are there; a pair that both have is the system's."""
    own = concepts.select("code", "prop", "value", F.lit("system").alias("source"), F.lit(0).alias("rank"))
    codes = concepts.select("code").distinct()
    more = supplements.join(codes, "code", "left_semi").select("code", "prop", "value", F.lit("supplement").alias("source"), F.lit(1).alias("rank"))
    return own.unionByName(more).groupBy("code", "prop", "value").agg(F.min_by("source", "rank").alias("source"))


def weights(rows: DataFrame, supplements: DataFrame) -> DataFrame:
    """(code, weight) of codes: their own weight text as a decimal, else the first one of supplements (code, weight, ord); what isn't a number is null."""
    more = supplements.filter("weight IS NOT NULL").groupBy("code").agg(F.min_by("weight", "ord").alias("added"))
    return rows.select("code", "weight").join(more, "code", "left").select("code", F.coalesce("weight", "added").try_cast("decimal(20,6)").alias("weight"))


def property_uris(props: DataFrame, declared: DataFrame, definitions: DataFrame) -> DataFrame:
    """(prop, uri) of the properties in use: the uri of the definition at hand, else the one that the system declares."""
    first = definitions.groupBy("prop").agg(F.min("uri").alias("here"))
    own = declared.groupBy("prop").agg(F.min("uri").alias("own"))
    return props.select("prop").distinct().join(first, "prop", "left").join(own, "prop", "left").select("prop", F.coalesce("here", "own").alias("uri"))


def capped(expansion: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """At most so many codes of each system, the first in order: an option for previews, off unless it is asked for."""
    return expansion.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= most).drop("_k")


def translated(rows: DataFrame, lang: str, dictionary: DataFrame) -> DataFrame:
    """rows (id, lang, region): a language's name in another language, with the region's in brackets, from a dictionary (tag, kind, wanted, name); what it lacks stays as the tag."""
    d = dictionary.filter(F.col("wanted") == lang)
    name = lambda kind, key, out: d.filter(F.col("kind") == kind).groupBy(F.col("tag").alias(key)).agg(F.min("name").alias(out))
    r = rows.join(name("language", "lang", "ln"), "lang", "left").join(name("region", "region", "rn"), "region", "left")
    head = F.coalesce("ln", "lang")
    return r.select("id", F.when(F.col("region").isNull(), head).otherwise(F.concat(head, F.lit(" ("), F.coalesce("rn", "region"), F.lit(")"))).alias("name"))


def by_display(wanted: DataFrame, concepts: DataFrame) -> DataFrame:
    """(display, code): the code of each wanted display; of several the last by code, null for none."""
    d = concepts.groupBy("display").agg(F.max("code").alias("code"))
    return wanted.select("display").distinct().join(d, "display", "left")

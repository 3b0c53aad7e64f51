"""Filters and look-ups that belong to kinds of code systems: countries, currencies, media types, drug codes, laboratory codes, vocabularies.

Filters are Columns over a system's own columns, so they meet the scan; look-ups are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which filters (property, operator) each kind of system takes.
CAPABILITIES = {
    "country": {("code", "regex")}, "currency": {("decimals", "equals")}, "area": {("type", "="), ("class", "=")}, "unit": {("canonical", "=")},
    "language": {("language", "exists"), ("script", "exists"), ("region", "exists")}, "vocabulary": {("domain", "=")}, "drug": {("code-type", "=")},
}


def takes(kind: str, prop: str, op: str) -> bool:
    return (prop, op) in CAPABILITIES.get(kind, ())


def system_filter(kind: str, prop: str, op: str, value: str) -> Column:
    """The filter of a system's kind over its columns code, decimals, class and domain; one that the kind doesn't take is an error."""
    if not takes(kind, prop, op):
        raise ValueError(f"the filter {prop} {op} {value} is not supported for {kind}")
    if kind == "country":
        return F.col("code").rlike(f"^(?:{value})$")
    if kind == "currency":
        return F.col("decimals").cast("string") == value
    if kind == "area":
        return F.col("class") == value
    if kind == "vocabulary":
        return (F.col("domain") == value) & (F.col("standard") == "S")
    raise ValueError(f"the filter of {kind} is an operator of its own")


def media_type(code: Column) -> Column:
    """A media type without its parameters as (type, subtype, valid); an invalid one has empty parts."""
    bare = F.trim(F.split(F.trim(code), ";")[0])
    p = F.split(bare, "/")
    ok = F.coalesce((F.size(p) == 2) & (F.get(p, 0) != "") & (F.get(p, 1) != ""), F.lit(False))
    return F.struct(F.when(ok, F.get(p, 0)).otherwise("").alias("type"), F.when(ok, F.get(p, 1)).otherwise("").alias("subtype"), ok.alias("valid"))


def is_uri(code: Column) -> Column:
    """Any text without white space that names a scheme is a code of the system of uris, which can't be listed."""
    return F.coalesce(code.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), F.lit(False))


def as_boolean(value: Column) -> Column:
    """true and false in any case; anything else is null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "false"), v == "true")


def value_name(json: Column) -> Column:
    """The name of the first ``value[x]`` member of a JSON object, null if it has none."""
    return F.get(F.filter(F.json_object_keys(json), lambda k: k.rlike("^value[A-Z]")), 0)


def is_inward(rel: Column, rela: Column, rels: list[str], patterns: list[str]) -> Column:
    """Whether a drug relationship leads to what a concept is made of: by its kind, or by a part of its name."""
    return F.coalesce(rel.isin(rels), F.lit(False)) | F.coalesce(rela.rlike("|".join(patterns)), F.lit(False))


def located(wanted: DataFrame, current: DataFrame, archive: DataFrame) -> DataFrame:
    """(code, display, archived) of wanted codes: the current name, else the archived one; codes in neither have nulls."""
    name = lambda df, out: df.groupBy("code").agg(F.min("display").alias(out))
    r = wanted.select("code").distinct().join(name(current, "now"), "code", "left").join(name(archive, "then"), "code", "left")
    return r.select("code", F.coalesce("now", "then").alias("display"), F.when(F.col("now").isNotNull(), False).when(F.col("then").isNotNull(), True).alias("archived"))


def suppressed(names: DataFrame, archive: DataFrame) -> DataFrame:
    """(code, inactive) of drug names (code, kind, suppress) and archived codes: archived without a name, or with a suppressed name that isn't a synonym."""
    g = names.groupBy("code").agg(F.bool_or((F.col("suppress") == "1") & (F.col("kind") != "SY")).alias("s"))
    a = archive.select("code").distinct().withColumn("old", F.lit(True))
    return g.join(a, "code", "full").select("code", F.coalesce("s", "old", F.lit(False)).alias("inactive"))


def with_every_stem(names: DataFrame, stems: DataFrame, wanted: list[str], where: Column) -> DataFrame:
    """(code) of names that pass a predicate and have every wanted stem: one count of a code's different stems, whatever their number."""
    n = len(set(wanted))
    hit = stems.filter(F.col("stem").isin(wanted)).select("code", "stem").distinct().groupBy("code").agg(F.count("*").alias("n")).filter(F.col("n") == n)
    rows = names.filter(where).select("code").distinct()
    return rows.join(hit.select("code"), "code", "left_semi") if n else rows


def related(concepts: DataFrame, relations: DataFrame, kinds: DataFrame) -> DataFrame:
    """(code, kind, target, target_display) of relations (code, kind_id, target) with their kinds' names; targets that aren't there go."""
    t = concepts.select(F.col("code").alias("target"), F.col("display").alias("target_display"))
    return relations.join(kinds, "kind_id").join(t, "target").select("code", "kind", "target", "target_display")


def drug_details(products: DataFrame, packages: DataFrame, organisations: DataFrame, kinds: DataFrame) -> DataFrame:
    """(code, description, name, organisation, kind, active) of packages and products, with the names of their look-up tables."""
    p = products.select(F.col("code").alias("product"), "name", "org_id", "kind_id", "active")
    rows = packages.select("code", "product", "description").unionByName(products.select("code", F.col("code").alias("product"), F.lit(None).cast("string").alias("description")))
    return rows.join(p, "product").join(organisations, "org_id", "left").join(kinds, "kind_id", "left").select("code", F.coalesce("description", "name").alias("description"), "name", "organisation", "kind", "active")


def lookup_table(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """(key, name): the different values of a column with a stable key, a hash of the value, so that no task numbers them all."""
    return rows.select(F.col(value).alias(name)).filter(f"{name} IS NOT NULL").distinct().select(F.xxhash64(name).alias(key), name)


def synonyms(concepts: DataFrame, names: DataFrame, languages: DataFrame) -> DataFrame:
    """(code, name, lang) of a vocabulary's other names (code, name, lang_code), each language by its tag; names that repeat the display go."""
    r = names.join(languages, "lang_code").join(concepts.select("code", "display"), "code").filter("name <> display")
    return r.select("code", "name", "lang").distinct()

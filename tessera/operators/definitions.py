"""Concept definitions from defining relationships: normal forms, equivalence, and structural subsumption.

A definition is a set of groups, each a set of (type, target) pairs; pairs of group 0 stand alone, each a group of its own.
A normal form is a text of the groups in order without repeats, so equal definitions are equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_forms(rels: DataFrame) -> DataFrame:
    """(source, form): each group as its pairs in order, each form once. A group holds the pairs of one concept's group only."""
    pair = F.concat_ws("=", "rel", "target")
    own = F.when(F.col("grp") > 0, F.col("grp").cast("string")).otherwise(pair)
    g = rels.select("source", own.alias("g"), pair.alias("pair")).distinct()
    return g.groupBy("source", "g").agg(F.array_join(F.array_sort(F.collect_list("pair")), ",").alias("form")).select("source", "form").distinct()


def normal_forms(rels: DataFrame) -> DataFrame:
    """(code, n_groups, form): the hash of a concept's groups in order."""
    return group_forms(rels).groupBy(F.col("source").alias("code")).agg(F.count("*").alias("n_groups"), F.sha2(F.array_join(F.array_sort(F.collect_list("form")), ";"), 256).alias("form"))


def equivalents(rels: DataFrame) -> DataFrame:
    """(form, n, first): definitions that several concepts share, and the smallest of these."""
    return normal_forms(rels).groupBy("form").agg(F.count("*").alias("n"), F.min("code").alias("first")).filter("n > 1")


def defined_by(rels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Concepts that have every wanted (rel, target) pair, in any group: candidates for what a definition subsumes."""
    w = wanted.select("rel", "target").distinct()
    n = w.groupBy().agg(F.count("*").alias("needed"))
    hit = rels.join(w, ["rel", "target"], "left_semi").select("source", "rel", "target").distinct().groupBy("source").agg(F.count("*").alias("n"))
    return hit.join(n, F.col("n") == F.col("needed")).select(F.col("source").alias("code"))


# Attributes, the hierarchy that their concepts are meant to be in, and the one that their values are from.
DOMAINS = {"116676008": "404684003", "363698007": "404684003", "42752001": "71388002", "260686004": "71388002", "405815000": "71388002"}
RANGES = {"116676008": "49755003", "363698007": "442083009", "42752001": "404684003", "47429007": "78621006"}


def outside_rules(rels: DataFrame, pairs: DataFrame, rules: dict[str, str], of: str) -> DataFrame:
    """Relationships whose ``of`` (source for domains, target for ranges) is neither the hierarchy that the attribute's rule names nor below it; advice, not errors."""
    hierarchy = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv]), F.col("rel"))
    asked = rels.withColumn("hierarchy", hierarchy).filter("hierarchy IS NOT NULL")
    inside = pairs.select(F.col("ancestor").alias("hierarchy"), F.col("descendant").alias(of)).distinct()
    return asked.filter(F.col(of) != F.col("hierarchy")).join(inside, ["hierarchy", of], "left_anti").select(*rels.columns, "hierarchy")


def among(pairs: DataFrame, wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """(wide, narrow) of the strict ancestor pairs whose two codes are in ``wide`` (code) and ``narrow`` (code): of a large hierarchy, only what these can meet."""
    p = pairs.filter("ancestor <> descendant").select(F.col("ancestor").alias("wide"), F.col("descendant").alias("narrow"))
    return p.join(wide.select(F.col("code").alias("wide")), "wide", "left_semi").join(narrow.select(F.col("code").alias("narrow")), "narrow", "left_semi").distinct()


def subsumed(requests: DataFrame, rels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(code_a, code_b, subsumes): whether a's definition subsumes b's: for every group of a some group of b has, for each of a's pairs, the same type with the same or a narrower target.

    Pairs of group 0 stand alone. A concept without a definition says nothing, so it subsumes all. Pairs of b go up to their targets' ancestors that are targets
    themselves, so that pairs of a meet equal ones only. Each pair of a carries its group's size, so only what met is counted; groups are not gathered.
    One pair of each a is looked for first: all pairs of a are moved only for the requests that have it.
    """
    own = F.when(F.col("grp") > 0, F.col("grp").cast("string")).otherwise(F.concat_ws("=", "rel", "target"))
    r = requests.select("code_a", "code_b").repartition("code_a").distinct()
    a = rels.select(F.col("source").alias("code_a"), F.when(F.col("grp") > 0, F.col("grp")).otherwise(0).alias("grp"), "rel", "target").repartition("code_a").distinct()
    a = a.select("code_a", own.alias("g_a"), "rel", "target").withColumn("needed", F.count("*").over(Window.partitionBy("code_a", "g_a")))
    r = r.join(a.groupBy("code_a", "g_a").agg(F.count("*").alias("n")).groupBy("code_a").agg(F.count("*").alias("groups")), "code_a", "left")
    targets = rels.select(F.col("target").alias("code")).distinct()
    up = among(pairs, targets, targets)
    b = rels.select(F.col("source").alias("code_b"), own.alias("g_b"), "rel", "target").join(up, F.col("target") == F.col("narrow"), "left")
    b = b.select("code_b", "g_b", "rel", F.explode(F.array_compact(F.array("target", "wide"))).alias("target")).repartition("code_b", "rel", "target").distinct()
    one = a.withColumn("at", F.row_number().over(Window.partitionBy("code_a").orderBy("g_a", "rel", "target"))).filter("at = 1")
    probe = r.select("code_a", "code_b").join(one, "code_a").select("code_a", "code_b", "rel", "target")
    alive = probe.join(b, ["code_b", "rel", "target"], "left_semi").select("code_a", "code_b")
    met = alive.join(a, "code_a").join(b, ["code_b", "rel", "target"])
    whole = met.groupBy("code_a", "code_b", "g_a", "g_b").agg(F.count("*").alias("n"), F.min("needed").alias("needed")).filter("n = needed").select("code_a", "code_b", "g_a").distinct()
    done = whole.groupBy("code_a", "code_b").agg(F.count("*").alias("found"))
    ok = F.col("groups").isNull() | F.col("code_b").isNull() | (F.coalesce("found", F.lit(0)) == F.col("groups"))
    return r.join(done, ["code_a", "code_b"], "left").select("code_a", "code_b", ok.alias("subsumes"))


def narrowest(rels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Relationships without those that a narrower target of the same type in the same group of the concept makes redundant.

    Each target goes up to its ancestors that are targets themselves: a wide target with many codes below it costs nothing.
    """
    r = rels.select("source", "grp", "rel", "target").distinct()
    targets = rels.select(F.col("target").alias("code")).distinct()
    wide = r.join(among(pairs, targets, targets), F.col("target") == F.col("narrow")).select("source", "grp", "rel", F.col("wide").alias("target")).distinct()
    return r.join(wide, ["source", "grp", "rel", "target"], "left_anti")


def mergeable_groups(rels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, g, h) of a concept's groups that say the same in part: they share types, and for every shared type one target is the other or an ancestor of it."""
    r = rels.filter("grp > 0").groupBy("source", "grp", "rel").agg(F.min("target").alias("target"))
    a = r.select("source", F.col("grp").alias("g"), "rel", F.col("target").alias("t_a"))
    b = r.select("source", F.col("grp").alias("h"), "rel", F.col("target").alias("t_b"))
    both = a.join(b, ["source", "rel"]).filter("g < h")
    down = pairs.select(F.col("ancestor").alias("t_a"), F.col("descendant").alias("t_b"), F.lit(True).alias("d")).distinct()
    up = pairs.select(F.col("descendant").alias("t_a"), F.col("ancestor").alias("t_b"), F.lit(True).alias("u")).distinct()
    ok = F.coalesce("d", "u", F.lit(False)) | (F.col("t_a") == F.col("t_b"))
    rated = both.join(down, ["t_a", "t_b"], "left").join(up, ["t_a", "t_b"], "left").groupBy("source", "g", "h").agg(F.bool_and(ok).alias("ok"))
    return rated.filter("ok").select("source", "g", "h")


def linked(edges: DataFrame, rels: DataFrame) -> DataFrame:
    """(code, n_parents, n_outbound, n_inbound): how each concept is linked, parents by the hierarchy, the rest by relationships. Counts, as a hub's links may be many."""
    one = lambda df, c, k: df.select(F.col(c).alias("code"), F.lit(k).alias("k"))
    rows = one(edges.distinct(), "child", 0).unionByName(one(rels, "source", 1)).unionByName(one(rels, "target", 2))
    return rows.groupBy("code").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in enumerate(("n_parents", "n_outbound", "n_inbound"))])


# Association reference sets that are read as maps, and the relationship that each stands for.
ASSOCIATIONS = {"900000000000523009": "inexact", "900000000000526001": "equivalent", "900000000000527005": "equal", "900000000000530003": "inexact"}


def implicit_map(url: str, system: str, associations: DataFrame) -> DataFrame:
    """(source_code, target_code, kind) of the map that ``system?fhir_cm=id`` names, from association rows (refset, code, target); an address of another form or set is an error."""
    head = f"{system}?fhir_cm="
    name = url.removeprefix(head)
    if not url.startswith(head) or name not in ASSOCIATIONS:
        raise ValueError(f"{url} names no map")
    return associations.filter(F.col("refset") == name).select(F.col("code").alias("source_code"), F.col("target").alias("target_code"), F.lit(ASSOCIATIONS[name]).alias("kind")).distinct()


def implicit_set(url: str, system: str) -> tuple[str, str | None]:
    """What ``system?fhir_vs...`` asks for: all, refsets, or isa or refset with an id. Addresses of another form are errors."""
    head = f"{system}?fhir_vs"
    if url.startswith(head):
        kind, _, value = url.removeprefix(head).removeprefix("=").partition("/")
        if kind in ("", "refset") and not value:
            return ("refsets" if kind else "all"), None
        if kind in ("isa", "refset") and value:
            return kind, value
    raise ValueError(f"{url} names no value set")


def implicit_members(url: str, system: str, concepts: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(code) of the set that an address names: every concept, one and what is below it, a reference set's members (refset, code), or the reference sets themselves."""
    from tessera.operators import hierarchy as h

    kind, value = implicit_set(url, system)
    if kind == "all":
        return concepts.select("code").distinct()
    if kind == "isa":
        return h.below(edges, value, True, concepts)
    if kind == "refset":
        return members.filter(F.col("refset") == value).select("code").distinct()
    return members.select(F.col("refset").alias("code")).distinct()

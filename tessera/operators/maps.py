"""Concept-map rows: vocabulary of relationships, grouping, and relations read both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import versions
from tessera.session import settled

# Map types and equivalences, and the relationship each stands for.
RELATIONSHIPS = {
    "equal": "equivalent", "equivalent": "equivalent", "same-as": "equivalent", "relatedto": "related-to", "related-to": "related-to",
    "wider": "source-is-broader-than-target", "subsumes": "source-is-broader-than-target", "broader-than": "source-is-broader-than-target",
    "narrower": "source-is-narrower-than-target", "specializes": "source-is-narrower-than-target", "narrower-than": "source-is-narrower-than-target",
    "inexact": "not-related-to", "unmatched": "not-related-to", "disjoint": "not-related-to",
}


def relationship(kind: Column) -> Column:
    """The relationship of a map type or equivalence in any case; an unknown one is related-to, a null stays null."""
    known = F.create_map(*[F.lit(x) for kv in RELATIONSHIPS.items() for x in kv])
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(known, F.lower(F.translate(kind, "_ ", "--"))), F.lit("related-to")))


def grouped(rows: DataFrame) -> DataFrame:
    """(map, source_code, n_targets, targets): a source's distinct targets in order."""
    one = rows.select("map", "source_code", "target_code").distinct()
    return one.groupBy("map", "source_code").agg(F.count("*").alias("n_targets"), F.array_join(F.array_sort(F.collect_list("target_code")), ",").alias("targets"))


def both_ways(rows: DataFrame) -> DataFrame:
    """(code, other, direction): relations forward, and backward where the same pair isn't there forward."""
    forward = rows.select(F.col("source_code").alias("code"), F.col("target_code").alias("other")).distinct().withColumn("direction", F.lit("forward"))
    back = rows.select(F.col("target_code").alias("code"), F.col("source_code").alias("other")).distinct()
    return forward.unionByName(back.join(forward.select("code", "other"), ["code", "other"], "left_anti").withColumn("direction", F.lit("reverse")))


def provides(rows: DataFrame) -> DataFrame:
    """(map, n_rows, n_sources, n_targets) of each map."""
    return rows.groupBy("map").agg(F.count("*").alias("n_rows"), F.count_distinct("source_code").alias("n_sources"), F.count_distinct("target_code").alias("n_targets"))


# Equivalences and relationships under which a mapping translates a code.
EQUIVALENCES = ["relatedto", "equivalent", "equal", "wider", "subsumes", "narrower", "specializes", "inexact"]
TRANSLATING = ["related-to", "equivalent", "source-is-narrower-than-target", "source-is-broader-than-target"]
#: About so many requests that ask the same get their answers in one place, and about so many rows of a result are made in one task.
SHARE, TASK_ROWS = 1000, 500_000


def translated(requests: DataFrame, mappings: DataFrame, reverse: bool = False) -> DataFrame:
    """(req_id, map, system, code, relationship, equivalence, comment, products): the translations of (req_id, system, version, code, scope, to_system).

    ``mappings`` is what ``sources.resources.mappings`` gives. A group counts if its source fits the request's system and version and its target the
    wanted system (any, if null), or if the map's target scope fits the wanted scope; reverse swaps the sides, and translates targets to sources.
    A mapping counts by its equivalence if it has one, else by its relationship. Of mappings to the same system and code the first one stays.
    Requests without a code, and mappings without the code that they are looked up by, give nothing; a request that is there twice gives what one does.

    Requests that ask the same are translated once, and of mappings that answer the same only the first one is looked up, so many copies of either
    never meet; each request then gets the answers. There are many more of those than rows that are moved for them, so the tasks that give them are
    set by number and not by bytes, and what very many requests ask is dealt out in shares. Only requests of one id that ask several things are put in order again.
    """
    near, far = ("target", "source") if reverse else ("source", "target")
    split = lambda c: versions.canonical(F.col(c))
    # one struct, which is never null, so that nulls in it meet
    ask = F.struct(F.concat_ws("|", "system", "version").alias("asked"), F.col("system").alias("near_url"), F.col("code").alias("near_code"), "scope", "to_system")
    asks = requests.filter("code IS NOT NULL").select("req_id", ask.alias("ask"))
    kind = F.when(F.coalesce(F.col("equivalence"), F.lit("")) != "", F.col("equivalence").isin(EQUIVALENCES)).otherwise(F.col("relationship").isin(TRANSLATING))
    at = F.struct("map", "group_ord", "element_ord", "target_ord")
    m = (
        mappings.filter(kind).filter(F.col(f"{near}_code").isNotNull())
        .groupBy("source", "target", "target_scope", "source_code", "target_code")
        .agg(F.min(at).alias("at"), F.min_by(F.struct("map", "relationship", "equivalence", "comment", "products"), at).alias("m"))
    )
    # a request looks for groups by its system and for maps by its scope: two ways of one join; what is compared there is cut into url and version before
    ways = lambda a, b: F.explode(F.array(F.struct(F.lit(False).alias("by_scope"), a.alias("url")), F.struct(F.lit(True).alias("by_scope"), b.alias("url")))).alias("way")
    q = asks.groupBy("ask").agg(F.count("*").alias("n"))
    q = q.select("ask", "n", "ask.near_code", "ask.near_url", split("ask.asked").alias("system_"), split("ask.to_system").alias("to_"), split("ask.scope").alias("scope_"))
    q = q.select("*", ways(F.col("near_url"), F.col("scope_.url"))).select("*", "way.*").drop("way", "near_url")
    m = m.select(F.col(f"{near}_code").alias("near_code"), F.col(far).alias("system"), F.col(f"{far}_code").alias("code"), "at", "m", split(near).alias("near_"), split(far).alias("far_"), split("target_scope").alias("map_scope_"))
    m = m.select("*", ways(F.col("near_.url"), F.col("map_scope_.url"))).select("*", "way.*").drop("way")
    by_group = versions.fits(F.col("system_"), F.col("near_")) & (F.col("ask.to_system").isNull() | versions.fits(F.col("to_"), F.col("far_")))
    by_scope = versions.fits(F.col("scope_"), F.col("map_scope_"))
    hits = q.join(m, ["by_scope", "url", "near_code"]).filter(F.when(F.col("by_scope"), by_scope).otherwise(by_group))
    answers = settled(hits.groupBy("ask", "n", "system", "code").agg(F.min("at").alias("at"), F.min_by("m", "at").alias("m")))
    made = answers.agg(F.sum("n")).first()[0] or 0  # each answer once for each request: the rows of the result
    tasks = 1 + min(made // TASK_ROWS, 10_000)
    shares = F.ceil(F.col("n") / SHARE)
    busy = F.broadcast(answers.filter(shares > 1).select("ask", shares.alias("shares")).distinct())  # one row for more than SHARE requests
    dealt = answers.select("ask", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), "system", "code", "at", "m").repartition(tasks, "ask", "share")

    def got(df: DataFrame) -> DataFrame:
        share = F.coalesce(F.pmod(F.xxhash64("req_id"), "shares"), F.lit(0))
        return df.join(busy, "ask", "left").select("req_id", "ask", share.alias("share")).repartition(tasks, "ask", "share").join(dealt, ["ask", "share"]).select("req_id", "system", "code", "at", "m")

    r = asks.distinct()
    several = r.groupBy("req_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("req_id").alias("id"))
    again = F.col("req_id").eqNullSafe(F.col("id"))
    mixed = got(r.join(several, again, "left_semi")).groupBy("req_id", "system", "code").agg(F.min_by("m", "at").alias("m"))
    out = got(r.join(several, again, "left_anti")).drop("at").unionByName(mixed)
    return out.select("req_id", "m.map", "system", "code", "m.relationship", "m.equivalence", "m.comment", "m.products")


def maps_for(pairs: DataFrame, mappings: DataFrame) -> DataFrame:
    """(source_system, target_system, map): the maps with a group from one system to the other, or whose scopes are these."""
    w = pairs.select("source_system", "target_system").distinct()
    m = mappings.select("map", "source", "target", "source_scope", "target_scope").distinct()
    sides = m.select("map", F.explode(F.array(F.struct("source", "target"), F.struct(F.col("source_scope").alias("source"), F.col("target_scope").alias("target")))).alias("x")).select("map", "x.source", "x.target").distinct()
    url = lambda c: versions.canonical(F.col(c))["url"]
    hit = w.withColumn("a", url("source_system")).withColumn("b", url("target_system")).join(sides.withColumn("a", url("source")).withColumn("b", url("target")), ["a", "b"])
    hit = hit.filter(versions.canonical_matches(F.col("source_system"), F.col("source")) & versions.canonical_matches(F.col("target_system"), F.col("target")))
    return hit.select("source_system", "target_system", "map").distinct()

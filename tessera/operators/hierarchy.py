"""Hierarchies as edge tables: closure, tests of ancestry, and walks that skip concepts.

An edge table has (parent, child); a closure has (ancestor, descendant, depth), depth the least number of steps.
Concepts may have many parents, and cycles are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import settled


def closure(edges: DataFrame) -> DataFrame:
    """All strict ancestor pairs with their least depth, level by level: each round extends only the pairs that are new.

    A round's frontier is written to the shared checkpoint folder, so plans don't grow with depth; the loop ends when no
    pair is new, which a cycle doesn't prevent. Pairs are met at their least depth first.
    """
    edges = settled(edges.select("parent", "child").filter("parent IS NOT NULL AND child IS NOT NULL").distinct())
    frontier = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("depth"))
    known, depth = frontier, 1
    while frontier.take(1):
        depth += 1
        step = frontier.join(edges, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct()
        frontier = settled(step.join(known, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
    return known


def closure_by_system(edges: DataFrame) -> DataFrame:
    """``closure`` of (system, parent, child) for all systems in one job: (system, ancestor, descendant, depth)."""
    own = lambda c: F.struct("system", F.col(c).alias("code"))
    pairs = closure(edges.filter("parent IS NOT NULL AND child IS NOT NULL").select(own("parent").alias("parent"), own("child").alias("child")))
    return pairs.select("ancestor.system", F.col("ancestor.code").alias("ancestor"), F.col("descendant.code").alias("descendant"), "depth")


def walk(edges: DataFrame, of: str | list[str], up: bool = False) -> DataFrame:
    """Codes strictly below (or above) any of the given ones, level by level from these: the work is in proportion to what is found, not to the hierarchy.

    A code on a cycle is below itself. Each round's new codes are written to the shared checkpoint folder.
    """
    a, b = ("child", "parent") if up else ("parent", "child")
    steps = edges.select(F.col(a).alias("start"), F.col(b).alias("code")).filter("start IS NOT NULL AND code IS NOT NULL")
    front = settled(steps.filter(F.col("start").isin([of] if isinstance(of, str) else of)).select("code").distinct())
    known = front
    while front.take(1):
        step = front.withColumnRenamed("code", "start").join(steps, "start").select("code").distinct()
        front = settled(step.join(known, "code", "left_anti"))
        known = known.unionByName(front)
    return known


def below(edges: DataFrame, of: str | list[str], or_self: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """``descendants`` without a closure, by a walk down from the given codes."""
    found = walk(edges, of)
    if or_self:
        found = found.unionByName(codes.filter(F.col("code").isin([of] if isinstance(of, str) else of)).select("code")).distinct()
    return found


def outside(edges: DataFrame, codes: DataFrame, of: str) -> DataFrame:
    """``not_below`` without a closure."""
    return codes.select("code").filter(F.col("code") != of).join(walk(edges, of), "code", "left_anti")


def with_self(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The closure with each code as its own ancestor at depth 0."""
    own = codes.select(F.col("code").alias("ancestor"), F.col("code").alias("descendant"), F.lit(0).alias("depth"))
    return pairs.select("ancestor", "descendant", "depth").unionByName(own)


def descendants(pairs: DataFrame, of: str | list[str], or_self: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """Codes strictly below any of the given ones; with ``or_self`` those of them that exist too."""
    of = [of] if isinstance(of, str) else of
    below = pairs.filter(F.col("ancestor").isin(of)).select(F.col("descendant").alias("code"))
    if or_self:
        below = below.unionByName(codes.filter(F.col("code").isin(of)).select("code"))
    return below.distinct()


def ancestors(pairs: DataFrame, of: str) -> DataFrame:
    """Codes strictly above one."""
    return pairs.filter(F.col("descendant") == of).select(F.col("ancestor").alias("code")).distinct()


def not_below(pairs: DataFrame, codes: DataFrame, of: str) -> DataFrame:
    """Codes that are neither the given one nor below it."""
    return codes.select("code").filter(F.col("code") != of).join(descendants(pairs, of), "code", "left_anti")


def children(edges: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("parent") == of).select(F.col("child").alias("code")).distinct()


def parents(edges: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("child") == of).select(F.col("parent").alias("code")).distinct()


def roots(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes without a parent."""
    return codes.select("code").join(edges.select(F.col("child").alias("code")), "code", "left_anti")


def leaves(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes without a child."""
    return codes.select("code").join(edges.select(F.col("parent").alias("code")), "code", "left_anti")


def depth_from_root(pairs: DataFrame, edges: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, depth): steps from the nearest root, 0 for a root."""
    tops = roots(edges, codes)
    far = pairs.join(tops.withColumnRenamed("code", "ancestor"), "ancestor").groupBy(F.col("descendant").alias("code")).agg(F.min("depth").alias("depth"))
    return far.unionByName(tops.withColumn("depth", F.lit(0)))


def subsumes(requests: DataFrame, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """For (code_a, code_b): equivalent, subsumes, subsumed-by, not-subsumed, or unknown-code."""
    known = lambda c: codes.select(F.col("code").alias(c), F.lit(True).alias(f"has_{c}")).distinct()
    up = pairs.select(F.col("ancestor").alias("code_a"), F.col("descendant").alias("code_b"), F.lit(True).alias("down")).distinct()
    down = pairs.select(F.col("ancestor").alias("code_b"), F.col("descendant").alias("code_a"), F.lit(True).alias("up")).distinct()
    out = requests.join(known("code_a"), "code_a", "left").join(known("code_b"), "code_b", "left").join(up, ["code_a", "code_b"], "left").join(down, ["code_a", "code_b"], "left")
    outcome = (
        F.when(F.col("has_code_a").isNull() | F.col("has_code_b").isNull(), "unknown-code")
        .when(F.col("code_a") == F.col("code_b"), "equivalent")
        .when(F.col("down"), "subsumes")
        .when(F.col("up"), "subsumed-by")
        .otherwise("not-subsumed")
    )
    return out.select("code_a", "code_b", outcome.alias("outcome"))


def reparented(pairs: DataFrame, codes: DataFrame, kept: Column) -> DataFrame:
    """(code, parent) of the kept codes: the nearest kept ancestor (of equally near ones the smallest), null for none."""
    live = codes.filter(kept).select("code")
    near = (
        pairs.join(live.select(F.col("code").alias("ancestor")), "ancestor")
        .groupBy(F.col("descendant").alias("code")).agg(F.min(F.struct("depth", "ancestor")).alias("near"))
    )
    return live.join(near, "code", "left").select("code", F.col("near.ancestor").alias("parent"))


def closure_from_paths(paths: DataFrame, separator: str = ".") -> DataFrame:
    """(ancestor, descendant, depth) from rows (code, path) whose path lists the codes from the root to the parent. No self pairs."""
    steps = F.split("path", "[" + separator + "]")
    rows = paths.select(F.col("code").alias("descendant"), F.size(steps).alias("n"), F.posexplode(steps).alias("at", "ancestor")).filter("ancestor <> '' AND ancestor <> descendant")
    return rows.groupBy("ancestor", "descendant").agg(F.min(F.col("n") - F.col("at")).alias("depth"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(code, round) of all codes within ``rounds`` edges of the seeds, in either direction; it stops early if nothing is new."""
    both = settled(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"))).distinct())
    front = settled(seeds.select("code").distinct().withColumn("round", F.lit(0)))
    known = front
    for k in range(1, rounds + 1):
        step = front.join(both, F.col("code") == F.col("a")).select(F.col("b").alias("code")).distinct()
        front = settled(step.join(known, "code", "left_anti").withColumn("round", F.lit(k)))
        if not front.take(1):
            break
        known = known.unionByName(front)
    return known


def has_cycle(pairs: DataFrame) -> DataFrame:
    """Codes that are their own strict ancestors."""
    return pairs.filter("ancestor = descendant").select(F.col("ancestor").alias("code"))

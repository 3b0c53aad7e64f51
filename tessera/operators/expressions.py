"""Constraints over a concept graph: set operations, dotted targets, refinements with cardinality and groups, reference sets.

Sets are DataFrames of ``code``; relationships are (source, rel, target, grp), group 0 standing for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").distinct().join(b.select("code").distinct(), "code", "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").unionByName(b.select("code")).distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code").distinct().join(b.select("code").distinct(), "code", "left_anti")


def dotted(base: DataFrame, rels: DataFrame, rel: str) -> DataFrame:
    """The targets of the base's relationships of a type."""
    return rels.filter(F.col("rel") == rel).join(base.select(F.col("code").alias("source")), "source", "left_semi").select(F.col("target").alias("code")).distinct()


def refined(base: DataFrame, rels: DataFrame, rel: str, values: DataFrame | None, least: int = 1, most: int | None = None, reverse: bool = False) -> DataFrame:
    """Codes of the base with ``least`` to ``most`` distinct targets of the type among the values. A least of 0 keeps codes without any."""
    own, other = ("target", "source") if reverse else ("source", "target")
    hit = rels.filter(F.col("rel") == rel)
    if values is not None:
        hit = hit.join(values.select(F.col("code").alias(other)).distinct(), other, "left_semi")
    n = hit.select(own, other).distinct().groupBy(F.col(own).alias("code")).agg(F.count("*").alias("n"))
    out = base.select("code").distinct().join(n, "code", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") >= least)
    return (out if most is None else out.filter(F.col("n") <= most)).select("code")


def grouped(base: DataFrame, rels: DataFrame, wanted: list[tuple[str, DataFrame | None]]) -> DataFrame:
    """Codes of the base with one group above 0 that meets every (type, values)."""
    out = None
    for rel, values in wanted:
        hit = rels.filter((F.col("rel") == rel) & (F.col("grp") > 0))
        if values is not None:
            hit = hit.join(values.select(F.col("code").alias("target")).distinct(), "target", "left_semi")
        hit = hit.select("source", "grp").distinct()
        out = hit if out is None else out.join(hit, ["source", "grp"], "left_semi")
    return base.select("code").distinct().join(out.select(F.col("source").alias("code")), "code", "left_semi")


def member_of(members: DataFrame, refset: str) -> DataFrame:
    return members.filter(F.col("refset") == refset).select("code").distinct()

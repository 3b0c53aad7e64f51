"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each v with the smallest of u and its neighbours. The minimum is taken before rows meet; the rows of a hub meet it in a join that adaptive execution splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("u_")).select("u", "v", "m")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its smallest node. No edges give no rows; loops are ignored.

    Each round is written to the shared folder, so the plan stays short; rounds grow with the logarithm of the longest path.
    """
    now = durable(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).filter("v <> m").distinct(), name)
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(now.select(F.col("m").alias("u"), "v"))
        large = _star(both).filter("v > u").select("v", "m").filter("v <> m").distinct()
        small = _star(large.select(F.col("v").alias("u"), F.col("m").alias("v")))
        links = small.select("v", "m").unionByName(small.select(F.col("u").alias("v"), "m")).filter("v <> m").distinct()
        now = durable(links, name)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("m").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple[int, int]:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return r[0], int(r[1] or 0)

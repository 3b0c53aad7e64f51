"""Status flags of concepts, derived from their properties (code, prop, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Property names and codes that the flags rest on.
INACTIVE, DEPRECATED = ["inactive", "retired"], ["deprecated", "retired"]


def flags(codes: DataFrame, props: DataFrame) -> DataFrame:
    """(code, abstract, inactive, deprecated, status): each flag from its own property or from the status; status as given, else what the flags say, else active."""
    p = F.col("prop")
    yes = F.lower("value") == "true"
    status = F.max(F.when(p == "status", F.lower("value")))
    one = props.groupBy("code").agg(
        F.bool_or(p.isin("notSelectable", "abstract") & yes).alias("abstract"),
        (F.bool_or((p == "inactive") & yes) | F.coalesce(status.isin(INACTIVE), F.lit(False))).alias("inactive"),
        (F.bool_or((p == "deprecated") & yes) | F.coalesce(status.isin(DEPRECATED), F.lit(False))).alias("deprecated"),
        status.alias("given"),
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = codes.select("code").join(one, "code", "left")
    derived = F.coalesce("given", F.when(F.col("deprecated"), "deprecated").when(F.col("inactive"), "inactive").otherwise("active"))
    return out.select("code", no("abstract"), no("inactive"), no("deprecated"), derived.alias("status"))

"""Value-set algebra: expansion of include and exclude clauses, paging, properties, validation, comparison.

A clause yields codes (``code`` and, in systems with versions, ``version``); an expansion has each key once, from the first clause that
gave it, and excludes win over all includes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_EXTERNAL, LIMIT_INTERNAL = 1000, 10000


class TooCostly(ValueError):
    """An expansion exceeds the limit it was asked under."""


def expand(includes: list[DataFrame], excludes: list[DataFrame] = (), key: tuple[str, ...] = ("code",), inactive: DataFrame | None = None) -> DataFrame:
    """Union of includes in clause order, the first clause of a key wins; then keys of excludes and inactive codes go."""
    rows = [df.select(*key).withColumn("clause_ord", F.lit(i)) for i, df in enumerate(includes)]
    out = reduce(DataFrame.unionByName, rows).groupBy(*key).agg(F.min("clause_ord").alias("clause_ord"))
    for gone in [*excludes, *([inactive] if inactive is not None else [])]:
        out = out.join(gone.select(*[k for k in key if k in gone.columns]).distinct(), [k for k in key if k in gone.columns], "left_anti")
    return out


def imports(sets: list[DataFrame], key: str = "code") -> DataFrame:
    """Codes that every imported set holds."""
    return reduce(lambda a, b: a.join(b.select(key).distinct(), key, "left_semi"), sets[1:], sets[0].select(key).distinct())


def guarded(expansion: DataFrame, limit: int = LIMIT_EXTERNAL) -> DataFrame:
    """The expansion, or an error if it has more rows than the limit. At most limit + 1 rows are counted."""
    if expansion.limit(limit + 1).count() > limit:
        raise TooCostly(f"the value set has more than {limit} codes")
    return expansion


def page(expansion: DataFrame, order: list[Column], offset: int, count: int) -> DataFrame:
    """Rows ``offset`` to ``offset + count`` of a total order."""
    return expansion.orderBy(*order).offset(offset).limit(count)


def listed(concepts: DataFrame, wanted: DataFrame) -> DataFrame:
    """A concept list (code, display override or null): those that exist, with the override or their own display."""
    return wanted.select("code", F.col("display").alias("given")).join(concepts.select("code", "display"), "code").select("code", F.coalesce("given", "display").alias("display"))


def with_properties(expansion: DataFrame, props: DataFrame, names: list[str]) -> DataFrame:
    """One column for each named property, null where a code lacks it."""
    wide = props.filter(F.col("prop").isin(names)).groupBy("code").agg(*[F.max(F.when(F.col("prop") == n, F.col("value"))).alias(n) for n in names])
    return expansion.join(wide, "code", "left")


def validate(requests: DataFrame, expansion: DataFrame, concepts: DataFrame) -> DataFrame:
    """(req_id, code, display) against a set: result true or false, or null where the code is unknown, the cause, and whether the display agrees.

    Of a code that occurs more than once the last row's display counts, by ``ord`` where the concepts have it, else the greatest display.
    """
    last = F.max_by("display", "ord") if "ord" in concepts.columns else F.max("display")
    known = concepts.groupBy("code").agg(last.alias("own"), F.lit(True).alias("known"))
    inside = expansion.select("code").distinct().withColumn("member", F.lit(True))
    out = requests.join(known, "code", "left").join(inside, "code", "left")
    result = F.when(F.col("known").isNull(), F.lit(None).cast("boolean")).when(F.col("member"), True).otherwise(False)
    cause = F.when(F.col("known").isNull(), "unknown-code").when(F.col("member"), "ok").otherwise("not-in-value-set")
    same = lambda a, b: F.lower(F.trim(F.regexp_replace(a, r"\s+", " "))) == F.lower(F.trim(F.regexp_replace(b, r"\s+", " ")))
    return out.select("req_id", "code", result.alias("result"), cause.alias("cause"), F.when(F.col("own").isNotNull() & F.col("display").isNotNull(), same(F.col("display"), F.col("own"))).alias("display_ok"))


def validate_any(codings: DataFrame, expansion: DataFrame) -> DataFrame:
    """(req_id, code) rows of concepts with several codings: valid if any coding is in the set."""
    inside = expansion.select("code").distinct().withColumn("member", F.lit(True))
    return codings.join(inside, "code", "left").groupBy("req_id").agg(F.bool_or(F.coalesce("member", F.lit(False))).alias("result"), F.count("*").alias("n_codings"))


def infer_system(codes: DataFrame, systems: DataFrame) -> DataFrame:
    """(code, system): the one system that has the code; codes that none or several have go."""
    found = codes.select("code").distinct().join(systems.select("code", "system").distinct(), "code")
    return found.groupBy("code").agg(F.count("*").alias("n"), F.min("system").alias("system")).filter("n = 1").select("code", "system")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: counts of common, only-left and only-right codes, and the outcome."""
    x = a.select("code").distinct().withColumn("l", F.lit(1))
    y = b.select("code").distinct().withColumn("r", F.lit(1))
    n = x.join(y, "code", "full").agg(
        F.coalesce(F.sum(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)), F.lit(0)).alias("common"),
        F.coalesce(F.sum(F.when(F.col("r").isNull(), 1)), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("l").isNull(), 1)), F.lit(0)).alias("only_right"),
    )
    c, le, ri = F.col("common"), F.col("only_left"), F.col("only_right")
    outcome = (
        F.when((c == 0) & (le == 0) & (ri == 0), "empty").when((le == 0) & (ri == 0), "same").when(c == 0, "disjoint")
        .when(ri == 0, "superset").when(le == 0, "subset").otherwise("overlapping")
    )
    return n.withColumn("outcome", outcome)


def members(a: DataFrame, b: DataFrame) -> DataFrame:
    """(code, side) of both sets: both, left or right."""
    x = a.select("code").distinct().withColumn("l", F.lit(1))
    y = b.select("code").distinct().withColumn("r", F.lit(1))
    return x.join(y, "code", "full").select("code", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def fingerprint(expansion: DataFrame, by: str) -> DataFrame:
    """A hash of each set's codes that doesn't depend on their order: (by, n, fp). Codes' hashes are summed, so no set is gathered in one place."""
    h = F.conv(F.substring(F.sha2(F.col("code"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return expansion.select(by, "code").distinct().groupBy(by).agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("fp"))


def lookup(requests: DataFrame, concepts: DataFrame, props: DataFrame, edges: DataFrame) -> DataFrame:
    """Each requested code with display, its properties, and its parents in order; unknown codes stay with nulls."""
    p = props.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "prop", "value"))), ";").alias("properties"))
    up = edges.groupBy(F.col("child").alias("code")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ";").alias("parents"))
    wanted = requests.select("code").distinct()
    return wanted.join(concepts.select("code", "display"), "code", "left").join(p, "code", "left").join(up, "code", "left")


def translate(codes: DataFrame, maps: DataFrame, accept: list[str], reverse: bool = False) -> DataFrame:
    """(code, target, map): mappings of codes with an accepted relationship, each target once for each code."""
    a, b = ("target_code", "source_code") if reverse else ("source_code", "target_code")
    rows = maps.filter(F.col("relationship").isin(accept)).select(F.col(a).alias("code"), F.col(b).alias("target"), "map")
    return codes.select("code").distinct().join(rows, "code").groupBy("code", "target").agg(F.min("map").alias("map"))


def unmapped(codes: DataFrame, maps: DataFrame, accept: list[str]) -> DataFrame:
    return codes.select("code").distinct().join(maps.filter(F.col("relationship").isin(accept)).select(F.col("source_code").alias("code")), "code", "left_anti")

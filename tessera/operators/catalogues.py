"""Catalogue analytics: facets, usage, dependencies, extension reports, ranking of servers, packages and designations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text, versions
from tessera.session import settled


def facets(rows: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts by facet values, and how many rows have each flag."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def with_usage(items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Items with the number of their uses, 0 if none. Uses are counted before the join."""
    n = uses.groupBy(key).agg(F.count("*").alias("n_uses"))
    return items.join(n, key, "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))


def used_only(items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    return items.join(uses.select(key).distinct(), key, "left_semi")


def broken(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, dependency) whose ``name@version`` (or ``name#version``) has no package of that name and major.minor; without a mark it is skipped."""
    p = F.split("dependency", "[@#]")
    want = dependencies.filter(F.col("dependency").rlike("[@#]")).select("package", "dependency", p[0].alias("name"), versions.major_minor(p[1]).alias("mm"))
    have = packages.select("name", versions.major_minor(F.col("version")).alias("mm")).distinct()
    return want.join(have, ["name", "mm"], "left_anti").select("package", "dependency")


def usage_grid(events: DataFrame, row: str, col: str, who: str) -> DataFrame:
    """Uses and distinct users of each pair."""
    return events.groupBy(row, col).agg(F.count("*").alias("n"), F.count_distinct(who).alias("n_users"))


def joined_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's distinct values in order, as one string."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("values"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], out: str = "rank", most: int = 1) -> DataFrame:
    """The first rows of each key under a total order (Spark cuts each task's rows to as many before they are shuffled)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= most)


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Rows numbered from 1 in a total order: dealt by ranges, numbered within each, plus the rows of the ranges before. Only the ranges' sizes meet in one task."""
    dealt = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")).cast("int")
    return dealt.join(before, "_range").withColumn(out, place).drop("_range", "_before")


def ranked_servers(servers: DataFrame, most: int) -> DataFrame:
    """By region: authoritative first, without error, recently seen (never last), more resources, newer version, then name."""
    order = [F.desc("authoritative"), F.asc("has_error"), F.col("last_success").desc_nulls_last(), F.desc("n_resources"), F.desc("version"), F.asc("name")]
    return first_by(servers, ["region"], order, most=most)


def best_designation(rows: DataFrame, wanted: str) -> DataFrame:
    """The display of each code for a wanted language: best language match, then active ones, then the first."""
    m = text.language_match(F.col("lang"), wanted)
    rated = rows.select("code", "lang", "value", "status", "ord", m.alias("quality")).filter("quality > 0")
    key = F.struct((-F.col("quality")).alias("q"), (F.col("status") != "active").alias("s"), F.col("ord"))
    return rated.groupBy("code").agg(F.min_by(F.struct("lang", "value", "status", "ord", "quality"), key).alias("b")).select("code", "b.lang", "b.value", "b.status", "b.ord", "b.quality")


def latest(rows: DataFrame, key: str, by: list[str], keep: list[str]) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*by)).alias("b")).select(key, *[f"b.{k}" for k in keep])


def masked(values: DataFrame, masks: DataFrame, value: str) -> DataFrame:
    """(value, mask) where the mask equals the value, or is its start followed by *. Masks without a * meet by equality; the others, a
    configured list, meet by their starts: each value offers its starts of the lengths in use, so the join has keys."""
    ends = masks.filter(F.col("mask").endswith("*")).select("mask", F.expr("substring(mask, 1, length(mask) - 1)").alias("head"))
    lengths = [r[0] for r in ends.select(F.length("head")).distinct().collect()]  # no more than the longest mask's
    v = values.select(value).distinct()
    exact = v.join(masks.filter(~F.col("mask").endswith("*")).distinct(), F.col(value) == F.col("mask"))
    if not lengths:
        return exact.select(value, "mask")
    fits = F.filter(F.lit(lengths), lambda n: n <= F.length(value))
    heads = v.select(value, F.explode(F.transform(fits, lambda n: F.col(value).substr(F.lit(1), n))).alias("head"))
    return exact.select(value, "mask").unionByName(heads.join(ends, "head").select(value, "mask")).distinct()


def first_rule(values: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """(value, allowed, ord): the first rule (ord, mask, allowed) whose mask fits decides; without one the value is allowed."""
    hit = masked(values, rules.select("mask"), value).join(rules, "mask")
    best = hit.groupBy(value).agg(F.min_by(F.struct("allowed", "ord"), "ord").alias("b"))
    return values.select(value).distinct().join(best, value, "left").select(value, F.coalesce("b.allowed", F.lit(True)).alias("allowed"), F.col("b.ord").alias("ord"))


def picked_version(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(name, version, picked): the exact version, else the newest that starts with ``version-``, else null."""
    exact = have.select("name", "version", F.lit(True).alias("exact")).distinct()
    labelled = have.select("name", F.regexp_extract("version", "^(.*?)-", 1).alias("base"), F.col("version").alias("labelled")).filter("base <> ''")
    newest = labelled.groupBy("name", "base").agg(F.max_by("labelled", versions.semver_key(F.col("labelled"))).alias("labelled"))
    out = wanted.select("name", "version").distinct().join(exact, ["name", "version"], "left").join(newest.withColumnRenamed("base", "version"), ["name", "version"], "left")
    return out.select("name", "version", F.when(F.col("exact"), F.col("version")).otherwise(F.col("labelled")).alias("picked"))


def two_way(links: DataFrame) -> DataFrame:
    """(item, uses, used_by): how many others each item points to, and how many point to it."""
    a = links.select(F.col("source").alias("item"), F.col("target").alias("other"), F.lit(0).alias("side"))
    b = links.select(F.col("target").alias("item"), F.col("source").alias("other"), F.lit(1).alias("side"))
    one = a.unionByName(b).distinct()
    return one.groupBy("item").agg(F.count_if(F.col("side") == 0).alias("uses"), F.count_if(F.col("side") == 1).alias("used_by"))


# Numbers of specification releases in usage tables, and their names.
RELEASE_NAMES = {"1": "R2", "2": "R2B", "3": "R3", "4": "R4", "5": "R4B", "6": "R5"}


def extension_examples(definitions: DataFrame, usages: DataFrame, users: DataFrame) -> DataFrame:
    """(url, user_url, user_name, release): who uses the extension of each url; definitions (def_id, url), usages (def_id, user_id), users (user_id, user_url, user_name, version).

    A version number that has no name stays as it is, a null one is empty. A use that is recorded twice is there twice.
    """
    known = F.create_map(*[F.lit(x) for kv in RELEASE_NAMES.items() for x in kv])
    number = F.col("version").cast("string")
    rows = usages.select("def_id", "user_id").join(definitions.select("def_id", "url"), "def_id").join(users.select("user_id", "user_url", "user_name", "version"), "user_id")
    return rows.select("url", "user_url", "user_name", F.coalesce(F.try_element_at(known, number), number, F.lit("")).alias("release"))


def profiles_by_package(profiles: DataFrame, packages: DataFrame) -> DataFrame:
    """(resource_type, url, title, package): each profile (package_id, resource_type, url, title) with its package (package_id, name, version) as name#version; an absent title is empty."""
    p = packages.select("package_id", F.concat("name", F.lit("#"), F.coalesce("version", F.lit(""))).alias("package"))
    return profiles.join(p, "package_id").select("resource_type", "url", F.coalesce("title", F.lit("")).alias("title"), "package")

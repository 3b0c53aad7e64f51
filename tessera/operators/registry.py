"""Catalogues of packages, servers, resources and extension reports: statistics, listings, searches and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import versions
from tessera.operators import catalogues as cat


def package_versions(packages: DataFrame) -> DataFrame:
    """Packages (name, version, published, description, downloads) with ``place``, 1 for the newest of its name, ``is_latest``, and the description in force.

    A version without a description has the one of the next newer version that has one.
    """
    w = Window.partitionBy("name").orderBy(F.desc("published"), F.desc("version"))
    said = F.last(F.nullif(F.col("description"), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(w)
    return packages.select("name", "version", "published", place.alias("place"), (place == 1).alias("is_latest"), said.alias("description"), F.coalesce("downloads", F.lit(0)).alias("downloads"))


def updates_since(packages: DataFrame, since) -> DataFrame:
    """Packages published at the time or later, in a total order with the newest first."""
    return cat.numbered(packages.filter(F.col("published") >= F.lit(since)), [F.desc("published"), F.asc("name"), F.asc("version")])


def package_order(sort: str) -> list[Column]:
    """The order for name, version, date or count, from the greatest if it starts with a minus; ties by name and version."""
    down, field = sort.startswith("-"), sort.lstrip("-")
    key = {"name": F.col("name"), "version": versions.semver_key(F.col("version")), "date": F.col("published"), "count": F.coalesce(F.col("downloads"), F.lit(0))}[field]
    return [key.desc() if down else key.asc(), F.asc("name"), F.asc("version")]


def search_order(field: str) -> list[Column]:
    """The order of found resources by one of their fields, missing ones first; vurl is url, then version. Another field is an error."""
    if field not in ("id", "url", "version", "date", "name", "vurl"):
        raise ValueError(f"results can't be sorted by {field}")
    fields = ["url", "version"] if field == "vurl" else [field]
    return [F.coalesce(F.col(f).cast("string"), F.lit("")).asc() for f in fields] + [F.asc("id")]


def dependency_maps(dependencies: DataFrame) -> DataFrame:
    """(package, needs): each package's dependencies ``name@version`` as ``name:version`` texts in order; those without a mark go, of a name given twice the greatest version counts."""
    p = F.split("dependency", "@")
    d = dependencies.filter(F.contains("dependency", F.lit("@"))).select("package", p[0].alias("name"), p[1].alias("version"))
    one = d.groupBy("package", "name").agg(F.max("version").alias("version"))
    return one.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "version"))), ",").alias("needs"))


def package_detail(items: DataFrame, package: str, kind: str, name: str, most: int) -> DataFrame:
    """(package, kind, n, names): how many different names of each kind a package has, and the first of them."""
    one = items.select(package, kind, name).distinct()
    n = one.groupBy(package, kind).agg(F.count("*").alias("n"))
    first = cat.first_by(one, [package, kind], [F.asc(name)], most=most).groupBy(package, kind).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("names"))
    return n.join(first, [package, kind])


def totals(packages: DataFrame) -> DataFrame:
    """One row: names, versions and downloads."""
    return packages.agg(F.count_distinct("name").alias("n_names"), F.count("*").alias("n_versions"), F.coalesce(F.sum("downloads"), F.lit(0)).alias("downloads"))


def registry_totals(servers: DataFrame) -> DataFrame:
    """One row over (server, version, error, system, value_set): servers, versions, working ones and those with an error, and different systems and sets."""
    v = F.struct("server", "version")
    return servers.agg(
        F.count_distinct("server").alias("n_servers"), F.count_distinct(v).alias("n_versions"), (F.count_distinct(v) - F.count_distinct(F.when(F.col("error"), v))).alias("n_working"),
        F.count_distinct(F.when(F.col("error"), v)).alias("n_errors"), F.count_distinct("system").alias("n_systems"), F.count_distinct("value_set").alias("n_value_sets"),
    )


def store_totals(resources: DataFrame) -> DataFrame:
    """(status, n, n_urls, n_systems) of stored value sets (url, version, status, systems)."""
    n = resources.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))
    s = resources.select("status", F.explode("systems").alias("system")).groupBy("status").agg(F.count_distinct("system").alias("n_systems"))
    return n.join(s, "status", "left").withColumn("n_systems", F.coalesce("n_systems", F.lit(0)))


def authorities(servers: DataFrame) -> DataFrame:
    """(mask, n_servers, servers): who says to be the authority for a mask, each with its working versions in order, from (server, masks, version, error)."""
    rows = servers.select("server", F.explode("masks").alias("mask"), F.when(~F.col("error"), F.col("version")).alias("version")).distinct()
    v = rows.groupBy("mask", "server").agg(F.array_join(F.array_sort(F.collect_list("version")), "+").alias("versions"))
    return v.groupBy("mask").agg(F.count("*").alias("n_servers"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "server", "versions"))), ",").alias("servers"))


def server_rows(servers: DataFrame, wanted: str, masks: DataFrame, column: str) -> DataFrame:
    """(server, version, item, authoritative): servers without an error that have an item (``column`` holds arrays of canonicals) of a url, whatever its version; authoritative if one of the server's masks fits."""
    rows = servers.filter(~F.col("error")).select("server", "version", F.explode(column).alias("item"))
    hit = rows.filter((F.col("item") == wanted) | F.startswith("item", F.lit(wanted + "|"))).distinct()
    fits = F.when(F.col("mask").endswith("*"), F.startswith(F.lit(wanted), F.expr("substring(mask, 1, length(mask) - 1)"))).otherwise(F.col("mask") == wanted)
    own = masks.filter(fits).select("server", F.lit(True).alias("own")).distinct()
    return hit.join(own, "server", "left").select("server", "version", "item", F.coalesce("own", F.lit(False)).alias("authoritative"))


def resolved_servers(rows: DataFrame, wanted_version: str | None, fallback: DataFrame) -> DataFrame:
    """(server, version, how): authoritative servers and candidates that have the wanted version; if there are none, the servers whose masks claim the system."""
    hit = rows.filter(F.lit(wanted_version is None) | F.col("item").endswith(f"|{wanted_version}"))
    how = F.when(F.col("authoritative"), "authoritative").otherwise("candidate")
    found = hit.select("server", "version", how.alias("how")).distinct()
    some = found.limit(1).select(F.lit(1).alias("any"))
    claims = fallback.select("server", "version", F.lit("claims").alias("how"), F.lit(1).alias("any")).distinct()
    return found.unionByName(claims.join(some, "any", "left_anti").drop("any"))


def published_at(value: Column) -> Column:
    """The time of a feed item as written in feeds: with or without the day of the week, zone or seconds, or as a plain date; else null."""
    v = F.trim(F.regexp_replace(value, r"\s+", " "))
    v = F.regexp_replace(v, r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in forms])


def new_items(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Feed items (guid, ...) that the store doesn't have, each guid once, the latest published of it."""
    cols = [c for c in feed.columns if c != "guid"]
    fresh = feed.filter("guid IS NOT NULL").join(known.select("guid").distinct(), "guid", "left_anti")
    return fresh.groupBy("guid").agg(F.max_by(F.struct(*cols), F.struct("published", *[c for c in cols if c != "published"])).alias("b")).select("guid", *[f"b.{c}" for c in cols])


def replaced(state: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The state in which every key of the incoming rows has these only, each row once."""
    return state.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.distinct())


def matches_text(fields: list[str], wanted: str) -> Column:
    """Whether any of the text fields contains the wanted text in any case."""
    out = F.lit(False)
    for f in fields:
        out = out | F.coalesce(F.contains(F.lower(f), F.lit(wanted.lower())), F.lit(False))
    return out


def in_jurisdiction(column: str, wanted: str) -> Column:
    """Whether any of an array of (text, codings of (code, display)) has the wanted text in its text, a code or a display."""
    has = lambda x: F.coalesce(F.contains(F.lower(x), F.lit(wanted.lower())), F.lit(False))
    fits = F.exists(column, lambda j: has(j["text"]) | F.coalesce(F.exists(j["coding"], lambda c: has(c["code"]) | has(c["display"])), F.lit(False)))
    return F.coalesce(fits, F.lit(False))


def map_search(maps: DataFrame, rows: DataFrame, source: str | None = None, target: str | None = None, code: str | None = None) -> DataFrame:
    """Maps (map, source, target) from and to the given systems that map a code, if one is given."""
    out = maps
    for column, wanted in (("source", source), ("target", target)):
        if wanted is not None:
            out = out.filter(F.col(column) == wanted)
    return out if code is None else out.join(rows.filter(F.col("source_code") == code).select("map").distinct(), "map", "left_semi")


def by_systems(log: DataFrame, column: str = "request") -> DataFrame:
    """(system, request) of a request log in JSON: a request stands once under each code system that it names."""
    urls = F.array_distinct(F.regexp_extract_all(column, F.lit(r'"system"\s*:\s*"([^"]+)"'), 1))
    return log.select(F.explode(urls).alias("system"), F.col(column).alias("request"))


def changed_since(resources: DataFrame, mark) -> DataFrame:
    """Rows updated after a high-water mark; the next mark is the greatest ``updated`` of them."""
    return resources.filter(F.col("updated") > F.lit(mark))

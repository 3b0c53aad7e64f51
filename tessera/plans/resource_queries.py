"""Queries over resources in JSON, units and incremental catalogues, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import units
from tessera.operators import filters as fl
from tessera.operators import hierarchy as h
from tessera.operators import versioned as vv
from tessera.plans.hierarchy_queries import CLOSURE, PROP
from tessera.plans.versioned_queries import WITH_VC, _clauses
from tessera.session import table
from tessera.sources import releases, resources
from tessera.sources import terminology as t
from tessera.streaming import sync

Q, SQL = {}, {}


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("SELECT * FROM (VALUES ('vs:tools|1.0', 'economy', '1.1.0', 0), ('vs:tools|1.0', 'small', NULL, 1), ('vs:tools|1.0', 'promo', '1.x', 2), ('vs:odd', 'large', NULL, 0), ('vs:odd', 'economy', '1.1.0', 1), ('vs:odd', 'economy', '2.0.0', 2), ('vs:odd', 'no-such-system', NULL, 3), ('vs:both|2.1.3', 'medium', NULL, 1), ('vs:other-version|1', 'standard', '2.0.0', 0), ('vs:same-list|1', 'small', NULL, 0), ('vs:same-list-too|1', 'small', NULL, 0)) AS t(vset, system, system_version, clause_ord)")
def distinct_includes(spark, d):
    return vv.distinct_includes(_clauses(spark))


@query(WITH_VC + ", n AS (SELECT system, version, count(DISTINCT code) AS n_codes FROM vc GROUP BY ALL) SELECT system, version, n_codes, version = max(version) OVER (PARTITION BY system) AS is_newest FROM n")
def system_listing(spark, d):
    return vv.listing(t.versioned_concepts(spark, d))


@query(WITH_VC + """, r AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN lower(p_type) || '|1.1.7' ELSE lower(p_type) || '|9.0.0' END AS canonical, lower(p_type) AS system, p_size % 3 AS k, 'P' || (p_partkey % 45) AS code FROM part),
v AS (SELECT r.*, CASE k WHEN 0 THEN (SELECT max(version) FROM vc WHERE vc.system = r.system) WHEN 1 THEN (SELECT max(version) FROM vc WHERE vc.system = r.system AND version = '1.1.0') END AS version FROM r)
SELECT canonical, v.code, v.version, vc.display FROM v LEFT JOIN vc ON vc.system = v.system AND vc.version = v.version AND vc.code = v.code""")
def resolve_codes(spark, d):
    """Codes of systems named without a version, by one of which the major.minor is there, or by one that isn't."""
    k = F.col("p_size") % 3
    canonical = F.concat(F.lower("p_type"), F.when(k == 0, "").when(k == 1, "|1.1.7").otherwise("|9.0.0"))
    req = table(spark, d, "part").select(canonical.alias("canonical"), F.concat(F.lit("P"), _s(F.col("p_partkey") % 45)).alias("code"))
    return vv.located_codes(req, t.versioned_concepts(spark, d))


@query(f"WITH {PROP} SELECT DISTINCT p.code FROM prop p WHERE p.prop = 'brand' AND p.value IN (SELECT 'Brand#' || q.value FROM prop q WHERE q.prop = 'size' AND q.code IN (SELECT code FROM prop WHERE prop = 'type' AND value = 'PROMO'))")
def property_of_nested(spark, d):
    """Parts of a brand whose number is the size of a promoted part: a filter on the values of another filter's codes."""
    props = t.properties(spark, d)
    sizes = fl.property_values(props, "size", fl.has_property(props, "type", F.col("value") == "PROMO"))
    return fl.property_of(props, "brand", sizes.select(F.concat(F.lit("Brand#"), "code").alias("code")))


def _resources(spark, d):
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "ValueSet").otherwise("CodeSystem")
    body = F.to_json(F.struct(kind.alias("resourceType"), _s("p_partkey").alias("id"), F.concat(F.lit("u:"), "p_brand").alias("url"), F.concat(_s(F.col("p_size") % 3), F.lit("."), _s("p_size")).alias("version")))
    return p.select(F.concat(F.lit("f"), _s("p_partkey")).alias("path"), F.when(F.col("p_partkey") % 10 == 0, "{not json").otherwise(body).alias("json"))


@query("SELECT 'f' || p_partkey AS path, CASE p_size % 2 WHEN 0 THEN 'ValueSet' ELSE 'CodeSystem' END AS type, p_partkey::VARCHAR AS id, 'u:' || p_brand AS url, (p_size % 3) || '.' || p_size AS version FROM part WHERE p_partkey % 10 <> 0")
def content_index(spark, d):
    """Files of resources, every tenth of them damaged."""
    return resources.content_index(_resources(spark, d))


@query("SELECT DISTINCT 'S' || s_suppkey AS server, 'u:' || s_nationkey AS system, CASE s_suppkey % 3 WHEN 0 THEN NULL ELSE v END AS version FROM supplier, (VALUES ('1'), ('2')) AS t(v)")
def server_metadata(spark, d):
    k, system = F.col("s_suppkey"), F.concat(F.lit("u:"), _s("s_nationkey"))
    versions = F.when(k % 3 == 0, "").otherwise(', "version": [{"code": "1"}, {"code": "2"}]')
    json = F.concat(F.lit('{"codeSystem": [{"uri": "'), system, F.lit('"'), versions, F.lit("}]}"))
    return resources.server_metadata(table(spark, d, "supplier").select(F.concat(F.lit("S"), _s(k)).alias("server"), json.alias("json")))


@query(CLOSURE + """ SELECT 'list' AS kind, 'C' || c_custkey AS code FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT DISTINCT 'part', descendant FROM closure WHERE ancestor = 'N3' UNION ALL SELECT 'all', code FROM concept""")
def laboratory_sets(spark, d):
    """What addresses of the laboratory system's sets name: an answer list, what is below a part, everything."""
    c, pairs = t.concepts(spark, d), h.closure(t.edges(spark, d))
    lists = t.refset_members(spark, d).withColumnRenamed("refset", "list")
    part = lambda kind, tail: releases.answer_set("http://lab/vs" + tail, c, lists, pairs).select(F.lit(kind).alias("kind"), "code")
    return part("list", "/BUILDING").unionByName(part("part", "/N3")).unionByName(part("all", ""))


@query("SELECT DISTINCT 'c' || l_partkey AS source_code, 'c' || l_suppkey AS target_code, 'equivalent' AS relationship FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 2 = 0 AND l_suppkey % 2 = 1 AND l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part)")
def vocabulary_map(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("c"), _s("p_partkey")).alias("code"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("vocabulary"))
    r = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id_1"), F.col("l_suppkey").alias("id_2"), F.when(F.col("l_returnflag") == "R", "Maps to").otherwise("Is a").alias("kind"))
    return releases.vocabulary_map(c, r, "even", "odd")


@query("""SELECT l_orderkey * 100 + l_linenumber AS id, round(CASE l_linenumber % 2 WHEN 0 THEN (l_quantity - 32) * 5 / 9 ELSE l_quantity + 273.15 END, 6) AS result FROM lineitem""")
def temperatures(spark, d):
    v, k = F.col("l_quantity"), F.col("l_linenumber") % 2
    out = F.when(k == 0, units.temperature(v, "[degF]", "Cel")).otherwise(units.temperature(v, "Cel", "K"))
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), F.round(out, 6).alias("result"))


@query("SELECT l_orderkey * 100 + l_linenumber AS id FROM lineitem WHERE l_linenumber % 4 IN (0, 2)")
def units_of_a_kind(spark, d):
    """Rows whose unit measures a concentration of mass."""
    k = F.col("l_linenumber") % 4
    unit = F.when(k == 0, "mg/dL").when(k == 1, "kg").when(k == 2, "kg/m3").otherwise("wrong")
    return units.measures_same(table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), unit.alias("unit")), "g/L")


@query("""WITH s AS (SELECT p_partkey AS id, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT l_partkey AS id, l_returnflag || l_linenumber AS v, l_returnflag AS f FROM lineitem WHERE l_partkey % 5 = 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) = 1)
SELECT id, v FROM s WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, v FROM c WHERE f <> 'R'""")
def catalogue_updates(spark, d):
    """A list of systems with the day's additions, changes and deletions put in."""
    state = table(spark, d, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v"))
    li = table(spark, d, "lineitem").filter("l_partkey % 5 = 0")
    changes = li.select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", _s("l_linenumber")).alias("v"), F.when(F.col("l_returnflag") == "R", "deleted").otherwise("changed").alias("change"), F.struct("l_orderkey", "l_linenumber").alias("at"))
    return sync.applied(state, changes, "id", "at")


@query("SELECT p_brand AS url, p_size AS version, 'stored' AS seen FROM part WHERE p_size < 30 GROUP BY ALL UNION ALL SELECT p_brand, p_size, 'new' FROM part WHERE p_size > 30 GROUP BY ALL UNION ALL SELECT p_brand, p_size, 'new' FROM part WHERE p_size = 30 GROUP BY ALL")
def version_history(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("url"), F.col("p_size").alias("version"))
    return sync.history(p.filter("version < 30").distinct().withColumn("seen", F.lit("stored")), p.withColumn("seen", F.lit("new")), ["url", "version"])

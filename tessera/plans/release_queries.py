"""Queries over concept maps with products, all filters of versioned sets, and the older classification's text, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import decimals, text, units
from tessera.operators import catalogues as cat
from tessera.operators import hierarchy as h
from tessera.operators import maps
from tessera.operators import versioned as vv
from tessera.plans.versioned_queries import WITH_VC
from tessera.session import table
from tessera.sources import releases, resources
from tessera.sources import terminology as t

Q, SQL = {}, {}


def _s(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


# One value set for each operator, as they would be read from files: (name, system, property, operator, value).
FILTERS = [
    ("not-a", "economy", "concept", "is-not-a", "P2"), ("child", "economy", "concept", "child-of", "P2"), ("leaf", "small", "concept", "descendent-leaf", "P2"),
    ("above", "small", "concept", "generalizes", "P25"), ("pattern", "promo", "code", "regex", "P[12]\\\\d?"), ("others", "promo", "concept", "not-in", "P1, P2"),
    ("all", "large", "concept", "exists", "true"), ("none", "large", "concept", "exists", "false"), ("parents", "large", "child", "exists", "true"), ("childless", "large", "child", "exists", "false"),
    ("kind", "medium", "kind", "=", "K1"), ("kinds", "medium", "kind", "in", "K1,K2"), ("no-kinds", "medium", "kind", "not-in", "K1,K2"), ("kind-pattern", "medium", "kind", "regex", "K[03]"),
    ("has-kind", "medium", "kind", "exists", "true"), ("no-kind", "medium", "kind", "exists", "false"),
]


def _set(name, system, prop, op, value):
    return f'{{"resourceType": "ValueSet", "url": "vs:{name}", "compose": {{"include": [{{"system": "{system}", "version": "2.0.0", "filter": [{{"property": "{prop}", "op": "{op}", "value": "{value}"}}]}}]}}}}'


@query(WITH_VC + """, c AS (SELECT DISTINCT system, code, substring(code, 2)::INT AS n FROM vc WHERE version = '2.0.0'),
k AS (SELECT *, CASE WHEN n % 5 > 0 THEN 'K' || (n % 4) END AS kind FROM c), a AS (SELECT DISTINCT system, code, anc FROM up),
x AS (SELECT 'vs:not-a' AS vset, system, code FROM c WHERE system = 'economy' AND (system, code) NOT IN (SELECT (system, code) FROM a WHERE anc = 'P2')
UNION ALL SELECT 'vs:child', system, code FROM c WHERE system = 'economy' AND n // 3 = 2
UNION ALL SELECT 'vs:leaf', system, code FROM c WHERE system = 'small' AND n > 13 AND (system, code) IN (SELECT (system, code) FROM a WHERE anc = 'P2')
UNION ALL SELECT 'vs:above', system, code FROM c WHERE system = 'small' AND n IN (25, 8, 2, 0)
UNION ALL SELECT 'vs:pattern', system, code FROM c WHERE system = 'promo' AND regexp_full_match(code, 'P[12][0-9]?')
UNION ALL SELECT 'vs:others', system, code FROM c WHERE system = 'promo' AND n NOT IN (1, 2)
UNION ALL SELECT 'vs:all', system, code FROM c WHERE system = 'large'
UNION ALL SELECT CASE WHEN n <= 13 THEN 'vs:parents' ELSE 'vs:childless' END, system, code FROM c WHERE system = 'large'
UNION ALL SELECT 'vs:kind', system, code FROM k WHERE system = 'medium' AND kind = 'K1'
UNION ALL SELECT 'vs:kinds', system, code FROM k WHERE system = 'medium' AND kind IN ('K1', 'K2')
UNION ALL SELECT 'vs:no-kinds', system, code FROM k WHERE system = 'medium' AND kind NOT IN ('K1', 'K2')
UNION ALL SELECT 'vs:kind-pattern', system, code FROM k WHERE system = 'medium' AND kind IN ('K0', 'K3')
UNION ALL SELECT CASE WHEN kind IS NULL THEN 'vs:no-kind' ELSE 'vs:has-kind' END, system, code FROM k WHERE system = 'medium')
SELECT vset, system, code FROM x""")
def expand_filter_operators(spark, d):
    """A set for each filter operator on concepts, children and properties."""
    concepts = t.versioned_concepts(spark, d)
    n = F.substring("code", 2, 9).cast("int")
    props = concepts.filter(n % 5 > 0).select("system", F.lit("kind").alias("prop"), F.concat(F.lit("K"), _s(n % 4)).alias("value"), "code").distinct()
    clauses = resources.value_set_clauses(spark.createDataFrame([(_set(*f),) for f in FILTERS], "json string"))
    return vv.expanded(clauses, concepts, h.closure_by_system(t.versioned_edges(spark, d)), props).select("vset", "system", "code")


def _maps(spark, d):
    """A concept map in JSON for each part brand: parts of the brand to their type and size, by relationship or by equivalence, with products and comments, some twice."""
    p = table(spark, d, "part")
    code = lambda letter, n: F.concat(F.lit(letter), _s(n))
    kind = F.when(F.col("p_size") % 4 == 0, "not-related-to").when(F.col("p_size") % 4 == 1, "equivalent").when(F.col("p_size") % 4 == 2, "source-is-narrower-than-target")
    target = F.struct(
        code("T", F.col("p_size") % 7).alias("code"), kind.alias("relationship"), F.when(F.col("p_size") % 8 == 3, "inexact").when(F.col("p_size") % 8 == 7, "disjoint").alias("equivalence"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("comment"), F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.lit("size").alias("property"), F.lit("u:size").alias("system"), _s("p_size").alias("value")))).alias("product"),
    )
    other = F.struct(code("T", F.col("p_size") % 7).alias("code"), F.lit("related-to").alias("relationship"), F.lit(None).cast("string").alias("equivalence"), F.lit("second").alias("comment"), target["product"].alias("product"))
    element = F.struct(code("P", F.col("p_partkey") % 50).alias("code"), F.array(target, other).alias("target"))
    g = p.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", element.alias("e")))), lambda x: x["e"]).alias("element"))
    n = F.right("p_brand", F.lit(1)).cast("int")
    body = F.struct(
        F.lit("ConceptMap").alias("resourceType"), F.concat(F.lit("cm:"), "p_brand").alias("url"), F.lit("1").alias("version"), F.when(n == 5, "vs:wide").alias("targetScopeUri"),
        F.array(F.struct(F.when(n == 1, "u:parts|2").when(n == 5, "u:other").otherwise("u:parts").alias("source"), F.when(n == 2, "u:types").otherwise("u:kinds").alias("target"), "element")).alias("group"),
    )
    return resources.mappings(g.select(F.to_json(body).alias("json")))


def _requests(spark, d, letter, m, system, to):
    o = F.col("o_orderkey")
    return table(spark, d, "orders").filter(o % 5 == 0).select(
        o.alias("req_id"), F.lit(system).alias("system"), F.when(o % 3 == 0, "2").when(o % 3 == 1, "1").alias("version"), F.concat(F.lit(letter), _s(o % m)).alias("code"),
        F.when(o % 4 == 0, "vs:wide|3").alias("scope"), F.when(o % 2 == 0, to).alias("to_system"),
    )


MAPPINGS = """m AS (SELECT 'cm:' || p_brand || '|1' AS map, right(p_brand, 1)::INT AS b, p_partkey, i, 'P' || (p_partkey % 50) AS source_code, 'T' || (p_size % 7) AS target_code,
    CASE WHEN i = 1 THEN 'related-to' ELSE CASE p_size % 4 WHEN 0 THEN 'not-related-to' WHEN 1 THEN 'equivalent' WHEN 2 THEN 'source-is-narrower-than-target' END END AS relationship,
    CASE WHEN i = 0 THEN CASE p_size % 8 WHEN 3 THEN 'inexact' WHEN 7 THEN 'disjoint' END END AS equivalence,
    CASE WHEN i = 1 THEN 'second' WHEN p_size % 3 = 0 THEN p_name END AS comment, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS product FROM part, range(2) r(i)),
ok AS (SELECT *, CASE b WHEN 5 THEN 'u:other' ELSE 'u:parts' END AS source, CASE b WHEN 2 THEN 'u:types' ELSE 'u:kinds' END AS target FROM m WHERE relationship <> 'not-related-to' OR equivalence = 'inexact'),
r AS (SELECT o_orderkey AS req_id, o_orderkey % 3 AS v, o_orderkey % 4 = 0 AS wide, o_orderkey % 2 = 0 AS wants, {code} AS code FROM orders WHERE o_orderkey % 5 = 0)"""
FIRST = " QUALIFY row_number() OVER (PARTITION BY req_id, system, code ORDER BY map, p_partkey, i) = 1"


@query("WITH " + MAPPINGS.format(code="'P' || (o_orderkey % 50)") + ", x AS (SELECT req_id, map, target AS system, target_code AS code, relationship, equivalence, comment, product, p_partkey, i FROM r JOIN ok ON source_code = r.code WHERE (b = 5 AND wide) OR (source = 'u:parts' AND (b <> 1 OR v = 0) AND (NOT wants OR target = 'u:kinds'))) SELECT * EXCLUDE (p_partkey, i) FROM x" + FIRST)
def translate_products(spark, d):
    """Codes of a system, with and without a version, a wanted system and a wanted scope, through maps with products."""
    got = maps.translated(_requests(spark, d, "P", 50, "u:parts", "u:kinds"), _maps(spark, d))
    return got.select("req_id", "map", "system", "code", "relationship", "equivalence", "comment", F.get("products", F.lit(0))["value"].alias("product"))


@query("WITH " + MAPPINGS.format(code="'T' || (o_orderkey % 7)") + ", x AS (SELECT req_id, map, CASE b WHEN 1 THEN 'u:parts|2' ELSE source END AS system, source_code AS code, p_partkey, i FROM r JOIN ok ON target_code = r.code WHERE (b = 5 AND wide) OR (target = 'u:kinds' AND (NOT wants OR source = 'u:parts') AND (NOT wants OR b <> 1))) SELECT req_id, map, system, code FROM x" + FIRST)
def translate_products_reverse(spark, d):
    return maps.translated(_requests(spark, d, "T", 7, "u:kinds", "u:parts"), _maps(spark, d), reverse=True).select("req_id", "map", "system", "code")


@query("""WITH m AS (SELECT DISTINCT 'cm:' || p_brand || '|1' AS map, right(p_brand, 1)::INT AS b FROM part)
SELECT 'u:parts|2' AS source_system, 'u:kinds' AS target_system, map FROM m WHERE b NOT IN (2, 5) UNION ALL SELECT 'u:parts', 'u:kinds', map FROM m WHERE b NOT IN (1, 2, 5) UNION ALL SELECT 'u:parts', 'u:types', map FROM m WHERE b = 2""")
def maps_between(spark, d):
    return maps.maps_for(spark.createDataFrame([("u:parts|2", "u:kinds"), ("u:parts", "u:kinds"), ("u:parts", "u:types"), (None, "u:types")], "source_system string, target_system string"), _maps(spark, d))


@query("""WITH c AS (SELECT r_name AS path, 'Range of ' || r_name AS display, '000-030' AS code, true AS is_group, NULL AS parent_code, NULL AS description, NULL AS includes, NULL AS excludes, NULL AS note FROM region
UNION ALL SELECT r_name, 'LOW ONES', '000-009', true, '000-030', NULL, NULL, NULL, 'read with care, all of it' FROM region UNION ALL SELECT r_name, 'HIGH ONES', '010-024', true, '000-030', NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT r_name, n_name, lpad(n_nationkey::VARCHAR, 3, '0'), false, CASE WHEN n_nationkey < 10 THEN '000-009' ELSE '010-024' END, 'A land. More of it', CASE WHEN n_nationkey % 2 = 0 THEN 'towns ' || n_name END, CASE WHEN n_nationkey % 3 = 0 THEN 'seas' END, NULL FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, 'part of ' || n_name, lpad(n_nationkey::VARCHAR, 3, '0') || '.1', false, lpad(n_nationkey::VARCHAR, 3, '0'), NULL, NULL, NULL, NULL FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT r_name, 'corner of ' || n_name, lpad(n_nationkey::VARCHAR, 3, '0') || '.12', false, lpad(n_nationkey::VARCHAR, 3, '0') || '.1', NULL, NULL, NULL, NULL FROM nation JOIN region ON r_regionkey = n_regionkey) SELECT * FROM c""")
def classification_text(spark, d):
    """Nations of each region as a text in the older classification's form."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    code, odd = F.lpad(_s("n_nationkey"), 3, "0"), F.col("n_nationkey") % 2 == 1
    block = F.when(F.col("n_nationkey") < 10, 1).otherwise(2)
    one = F.concat(
        code, F.lit("  "), "n_name", F.lit("\n   A land.\n\n More  of it\n"), F.when(odd, "").otherwise(F.concat(F.lit("  Includes: towns\n\t"), "n_name", F.lit("\n"))),
        F.when(F.col("n_nationkey") % 3 == 0, " excludes:\n   seas\n").otherwise(""), code, F.lit(".1\tpart of  "), "n_name", F.lit("\n"), code, F.lit(".12 corner of "), "n_name",
    )
    lines = n.select("n_regionkey", block.alias("b"), code.alias("c"), one.alias("line"))
    heads = lambda b, line: r.select(F.col("r_regionkey").alias("n_regionkey"), F.lit(b).alias("b"), F.lit("").alias("c"), line.alias("line"))
    lines = lines.unionByName(heads(0, F.concat(F.lit("a preface\nI.  Range of "), "r_name", F.lit(" (000-030)")))).unionByName(heads(1, F.lit("LOW  ONES (000-009)\n Note: read with care,\n all of it"))).unionByName(heads(2, F.lit("HIGH ONES (010-024)")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "c", "line"))), lambda x: x["line"]), "\n").alias("text")
    texts = lines.groupBy("n_regionkey").agg(whole).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("path"), "text")
    return releases.classification_text(texts).drop("ord")


@query("""WITH q AS (SELECT l_orderkey AS o, l_linenumber AS n, l_orderkey * 100 + l_linenumber AS id, l_quantity::INT AS q, l_linenumber % 4 AS k FROM lineitem)
SELECT id, (CASE k WHEN 0 THEN (q + 0.5) * n / 100 WHEN 1 THEN (q + 0.5) + n::DECIMAL(9, 2) / 100 WHEN 2 THEN n - q WHEN 3 THEN o::DECIMAL(18, 4) / 8 END)::DOUBLE AS result,
CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN n < 10 THEN 1 END WHEN 3 THEN CASE WHEN o = 0 THEN 1 ELSE 100 END END::INTEGER AS digits FROM q""")
def decimal_arithmetic(spark, d):
    """Products, sums, differences and quotients of texts: quantities and a half, line numbers as hundredths, whole numbers."""
    k, q, n = F.col("l_linenumber") % 4, _s(F.col("l_quantity").cast("int")), _s("l_linenumber")
    a = F.when(k < 2, F.concat(q, F.lit(".5"))).when(k == 2, n).otherwise(_s("l_orderkey"))
    b = F.when(k < 2, F.concat(F.lit("0.0"), n)).when(k == 2, q).otherwise("8")
    op = F.when(k == 0, "*").when(k == 1, "+").when(k == 2, "-").otherwise("/")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), a.alias("a"), op.alias("op"), b.alias("b"))
    return decimals.with_results(rows).select("id", F.col("result").cast("double").alias("result"), "digits")


@query("""SELECT 'e:' || p_brand AS url, 'u:' || l_orderkey AS user_url, o_orderpriority AS user_name, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN 'R2' WHEN 2 THEN 'R2B' WHEN 3 THEN 'R3' WHEN 4 THEN 'R4' WHEN 5 THEN 'R4B' WHEN 6 THEN 'R5' ELSE '7' END AS release
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE p_size < 10""")
def extension_examples(spark, d):
    """Brands as extensions, orders as their users."""
    defs = table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("def_id"), F.concat(F.lit("e:"), "p_brand").alias("url"))
    uses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("def_id"), F.col("l_orderkey").alias("user_id"))
    o = F.col("o_orderkey")
    users = table(spark, d, "orders").select(o.alias("user_id"), F.concat(F.lit("u:"), _s(o)).alias("user_url"), F.col("o_orderpriority").alias("user_name"), F.when(o % 8 > 0, o % 8).alias("version"))
    return cat.extension_examples(defs, uses, users)


@query("SELECT p_type AS resource_type, 'P' || p_partkey AS url, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS title, s_name || '#' || CASE WHEN s_acctbal > 0 THEN s_nationkey::VARCHAR ELSE '' END AS package FROM part JOIN supplier ON s_suppkey = p_partkey % 10")
def profiles_by_package(spark, d):
    profiles = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("package_id"), F.col("p_type").alias("resource_type"), F.concat(F.lit("P"), _s("p_partkey")).alias("url"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"))
    packages = table(spark, d, "supplier").select(F.col("s_suppkey").alias("package_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, _s("s_nationkey")).alias("version"))
    return cat.profiles_by_package(profiles, packages)


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS flag, o_orderkey % 5 IN (0, 3, 4) AS flag_or_true FROM orders")
def text_flags(spark, d):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, "true").when(k == 1, "TRUE").when(k == 2, "false").when(k == 3, "")
    return table(spark, d, "orders").select("o_orderkey", text.flag(value).alias("flag"), text.flag(value, True).alias("flag_or_true"))


@query("SELECT 'v:' || p_partkey AS url, p_size::VARCHAR AS version, '2020-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS locked_date FROM part WHERE p_size % 4 = 0 AND p_partkey % 2 = 0")
def locked_definitions(spark, d):
    """Value sets in JSON, a quarter of them locked to a date, some no value sets."""
    date = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("2020-01-"), F.lpad(_s(F.col("p_size") % 28 + 1), 2, "0"))).when(F.col("p_size") % 4 == 1, "")
    kind = F.when(F.col("p_partkey") % 2 == 0, "ValueSet").otherwise("CodeSystem")
    body = F.struct(kind.alias("resourceType"), F.concat(F.lit("v:"), _s("p_partkey")).alias("url"), _s("p_size").alias("version"), F.struct(date.alias("lockedDate")).alias("compose"))
    return resources.locked(table(spark, d, "part").select(F.to_json(body).alias("json")))


@query("SELECT CASE l_linenumber % 5 WHEN 0 THEN 'mg/dL' WHEN 1 THEN '10*3/uL' WHEN 2 THEN 'mg/' WHEN 3 THEN 'furlong' || l_linestatus END AS unit, l_linenumber % 5 < 2 AS known, count(*) AS n FROM lineitem GROUP BY ALL")
def unit_faults(spark, d):
    """Rows by their unit, with whether it is known: right ones, a division by nothing, unknown ones and nulls."""
    k = F.col("l_linenumber") % 5
    unit = F.when(k == 0, "mg/dL").when(k == 1, "10*3/uL").when(k == 2, "mg/").when(k == 3, F.concat(F.lit("furlong"), "l_linestatus"))
    rows = table(spark, d, "lineitem").groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))
    faults = units.faults(rows).withColumnRenamed("unit", "u")
    return rows.join(faults, F.col("unit").eqNullSafe(F.col("u"))).select("unit", F.isnull("fault").alias("known"), "n")

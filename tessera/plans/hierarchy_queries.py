"""Queries over hierarchies and value sets, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import expressions as ex
from tessera.operators import filters as fl
from tessera.operators import hierarchy as h
from tessera.operators import valuesets as vs
from tessera.session import table
from tessera.sources import terminology as t

Q, SQL = {}, {}
EDGE = """edge AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier)"""
CONCEPT = """concept AS (SELECT 'R' || r_regionkey AS code, r_name AS display, 'region' AS kind, NULL::VARCHAR AS segment, NULL::DOUBLE AS balance FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', NULL, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name, 'customer', c_mktsegment, c_acctbal FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier', NULL, s_acctbal FROM supplier)"""
CLOSURE = f"""WITH RECURSIVE {EDGE}, {CONCEPT},
walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edge UNION SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edge e ON e.parent = w.descendant),
closure AS (SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY ALL)"""
PART = "part_c AS (SELECT 'P' || p_partkey AS code, p_name AS display, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS price FROM part)"
PROP = PART + ", prop AS (SELECT code, 'brand' AS prop, brand AS value FROM part_c UNION ALL SELECT code, 'type', type FROM part_c UNION ALL SELECT code, 'size', size::VARCHAR FROM part_c)"
REL = """rel AS (SELECT 'O' || l_orderkey AS source, l_linenumber AS grp, 'part-' || l_returnflag AS rel, 'P' || l_partkey AS target FROM lineitem
  UNION ALL SELECT 'O' || l_orderkey, l_linenumber, 'supplier-' || l_linestatus, 'S' || l_suppkey FROM lineitem)"""
MAP = """map AS (SELECT 'nation-region' AS map, 'N' || n_nationkey AS source_code, 'R' || n_regionkey AS target_code, 'source-is-narrower-than-target' AS relationship FROM nation
  UNION ALL SELECT 'part-brand', 'P' || p_partkey, p_brand, CASE WHEN p_size > 25 THEN 'equivalent' ELSE 'related-to' END FROM part
  UNION ALL SELECT 'supplier-nation', 'S' || s_suppkey, 'N' || s_nationkey, CASE WHEN s_acctbal < 0 THEN 'not-related-to' ELSE 'equivalent' END FROM supplier)"""


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _closure(spark, d):
    return h.closure(t.edges(spark, d))


@query(CLOSURE + " SELECT ancestor, descendant, depth FROM closure")
def closure_pairs(spark, d):
    return _closure(spark, d)


@query(CLOSURE + """, inc AS (SELECT descendant AS code, 0 AS o FROM closure WHERE ancestor = 'R1' UNION ALL SELECT 'R1', 0 UNION ALL SELECT descendant, 1 FROM closure WHERE ancestor = 'N3')
SELECT code, min(o)::INTEGER AS clause_ord FROM inc WHERE code NOT IN (SELECT descendant FROM closure WHERE ancestor = 'N1') GROUP BY code""")
def expand_hierarchy(spark, d):
    """Descendants or self of R1, then descendants of N3, without descendants of N1."""
    c, codes = t.edges(spark, d), t.concepts(spark, d)
    return vs.expand([h.below(c, "R1", True, codes), h.below(c, "N3")], [h.below(c, "N1")])


@query(CLOSURE + " SELECT DISTINCT descendant AS code FROM closure WHERE ancestor = 'R2' UNION SELECT code FROM concept WHERE code = 'R2'")
def filter_is_a(spark, d):
    return h.below(t.edges(spark, d), "R2", True, t.concepts(spark, d))


@query(CLOSURE + " SELECT DISTINCT descendant AS code FROM closure WHERE ancestor = 'R2'")
def filter_descendent_of(spark, d):
    return h.below(t.edges(spark, d), "R2")


@query(CLOSURE + " SELECT code FROM concept WHERE code <> 'R2' AND code NOT IN (SELECT descendant FROM closure WHERE ancestor = 'R2')")
def filter_is_not_a(spark, d):
    return h.outside(t.edges(spark, d), t.concepts(spark, d), "R2")


@query(f"WITH {EDGE} SELECT DISTINCT child AS code FROM edge WHERE parent = 'N5'")
def filter_child_of(spark, d):
    return h.children(t.edges(spark, d), "N5")


@query(f"WITH {EDGE} SELECT DISTINCT parent AS code FROM edge WHERE child = 'C7'")
def filter_parent_of(spark, d):
    return h.parents(t.edges(spark, d), "C7")


@query(f"WITH {EDGE}, {CONCEPT} SELECT code FROM concept WHERE code NOT IN (SELECT parent FROM edge)")
def filter_leaf(spark, d):
    return h.leaves(t.edges(spark, d), t.concepts(spark, d))


@query(f"WITH {EDGE}, {CONCEPT} SELECT code FROM concept WHERE code NOT IN (SELECT child FROM edge)")
def filter_root(spark, d):
    return h.roots(t.edges(spark, d), t.concepts(spark, d))


@query(CLOSURE + " SELECT DISTINCT ancestor AS code FROM closure WHERE descendant = 'C3'")
def filter_generalizes(spark, d):
    return h.walk(t.edges(spark, d), "C3", up=True)


@query(CLOSURE + """, root AS (SELECT code FROM concept WHERE code NOT IN (SELECT child FROM edge))
SELECT descendant AS code, min(depth)::INTEGER AS depth FROM closure WHERE ancestor IN (SELECT code FROM root) GROUP BY 1 UNION ALL SELECT code, 0 FROM root""")
def depth_from_root(spark, d):
    return h.depth_from_root(_closure(spark, d), t.edges(spark, d), t.concepts(spark, d))


@query(CLOSURE + """, req AS (SELECT 'R' || (c_custkey % 5) AS code_a, 'C' || c_custkey AS code_b FROM customer UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation UNION SELECT 'X1', 'R1')
SELECT code_a, code_b, CASE WHEN code_a NOT IN (SELECT code FROM concept) OR code_b NOT IN (SELECT code FROM concept) THEN 'unknown-code' WHEN code_a = code_b THEN 'equivalent'
  WHEN EXISTS (SELECT 1 FROM closure WHERE ancestor = code_a AND descendant = code_b) THEN 'subsumes'
  WHEN EXISTS (SELECT 1 FROM closure WHERE ancestor = code_b AND descendant = code_a) THEN 'subsumed-by' ELSE 'not-subsumed' END AS outcome FROM req""")
def subsumes_pairs(spark, d):
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    code = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    req = (
        c.select(code("R", F.col("c_custkey") % 5).alias("code_a"), code("C", F.col("c_custkey")).alias("code_b"))
        .unionByName(s.select(code("S", F.col("s_suppkey")).alias("code_a"), code("N", F.col("s_nationkey")).alias("code_b")))
        .unionByName(n.select(code("N", F.col("n_nationkey")).alias("code_a"), code("N", F.col("n_nationkey")).alias("code_b")))
        .unionByName(spark.sql("SELECT 'X1' AS code_a, 'R1' AS code_b"))
        .distinct()
    )
    return h.subsumes(req, _closure(spark, d), t.concepts(spark, d))


@query(CLOSURE + """, kept AS (SELECT code FROM concept WHERE kind <> 'nation')
SELECT k.code, arg_min(c.ancestor, (c.depth, c.ancestor)) AS parent FROM kept k LEFT JOIN (SELECT * FROM closure WHERE ancestor IN (SELECT code FROM kept)) c ON c.descendant = k.code GROUP BY k.code""")
def expand_skip_abstract_reparent(spark, d):
    """Nations are abstract: what lies below them moves to their regions."""
    return h.reparented(_closure(spark, d), t.concepts(spark, d), F.col("kind") != "nation")


@query(f"WITH {PROP} SELECT DISTINCT code FROM prop WHERE prop = 'brand' AND value = 'Brand#12'")
def filter_prop_eq(spark, d):
    return fl.has_property(t.properties(spark, d), "brand", F.col("value") == "Brand#12")


@query(f"WITH {PROP} SELECT DISTINCT code FROM prop WHERE prop = 'size' AND value IN ('1', '7', '15')")
def filter_prop_in(spark, d):
    return fl.has_property(t.properties(spark, d), "size", F.col("value").isin("1", "7", "15"))


@query(f"WITH {PROP}, {CONCEPT} SELECT code FROM (SELECT code FROM part_c UNION ALL SELECT code FROM concept) WHERE code IN (SELECT code FROM prop) AND code NOT IN (SELECT code FROM prop WHERE prop = 'size' AND value IN ('1', '7', '15'))")
def filter_prop_not_in(spark, d):
    """Codes of both systems: those without any property don't count."""
    codes = t.parts(spark, d).select("code").unionByName(t.concepts(spark, d).select("code"))
    return fl.property_not_in(codes, t.properties(spark, d), "size", ["1", "7", "15"])


@query(f"WITH {PROP} SELECT DISTINCT code FROM prop WHERE prop = 'brand' AND regexp_full_match(value, 'Brand#[12][0-9]')")
def filter_prop_regex(spark, d):
    return fl.has_property(t.properties(spark, d), "brand", fl.matches("value", "Brand#[12][0-9]"))


@query(f"WITH {CONCEPT} SELECT code FROM concept WHERE segment IS NOT NULL")
def filter_prop_exists(spark, d):
    return t.concepts(spark, d).filter("segment IS NOT NULL").select("code")


@query(f"WITH {PART}, {REL} SELECT DISTINCT source AS code FROM rel WHERE rel = 'part-R' AND target IN (SELECT code FROM part_c WHERE brand = 'Brand#12')")
def filter_relation_in(spark, d):
    return fl.related_to(t.relationships(spark, d), "part-R", t.parts(spark, d).filter("brand = 'Brand#12'"))


@query(f"WITH {PART} SELECT code FROM part_c WHERE brand LIKE 'Brand#1%' AND size > 10 AND price < 1500")
def filter_and_all(spark, d):
    return t.parts(spark, d).filter(F.col("brand").startswith("Brand#1") & (F.col("size") > 10) & (F.col("price") < 1500)).select("code")


@query(f"WITH {PART} SELECT code, CASE WHEN size > 40 THEN 'large ' || type ELSE display END AS display FROM part_c WHERE size % 2 = 0")
def expand_list_with_overrides(spark, d):
    p = t.parts(spark, d)
    wanted = p.filter("size % 2 = 0").select("code", F.when(F.col("size") > 40, F.concat(F.lit("large "), F.col("type"))).alias("display"))
    return vs.listed(p, wanted)


@query(f"WITH {PART} SELECT code FROM part_c WHERE size > 10 INTERSECT SELECT code FROM part_c WHERE price > 1000 INTERSECT SELECT code FROM part_c WHERE brand <> 'Brand#12'")
def expand_imports_intersect(spark, d):
    p = t.parts(spark, d)
    return vs.imports([p.filter("size > 10"), p.filter("price > 1000"), p.filter("brand <> 'Brand#12'")])


@query("""WITH v AS (SELECT DISTINCT 'P' || l_partkey AS code, l_returnflag AS version FROM lineitem)
SELECT code, version, 0 AS clause_ord FROM v WHERE NOT (version = 'R' AND code IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 20))""")
def expand_exclude_version_mode(spark, d):
    """One system in three versions: an exclude that names a version takes codes of this version only."""
    v = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"), F.col("l_returnflag").alias("version")).distinct()
    gone = t.parts(spark, d).filter("size > 20").select("code", F.lit("R").alias("version"))
    return vs.expand([v], [gone], key=("code", "version"))


@query(f"WITH {CONCEPT} SELECT code, display FROM concept ORDER BY code LIMIT 50 OFFSET 100")
def expand_page(spark, d):
    return vs.page(t.concepts(spark, d).select("code", "display"), [F.asc("code")], 100, 50)


@query(f"WITH {PART} SELECT code, price FROM part_c ORDER BY price DESC NULLS LAST, code LIMIT 25")
def expand_sort_prop(spark, d):
    return vs.page(t.parts(spark, d).select("code", "price"), [F.col("price").desc_nulls_last(), F.asc("code")], 0, 25)


@query(f"WITH {PART} SELECT code, brand, size::VARCHAR AS size FROM part_c WHERE price > 1200")
def expand_properties_pivot(spark, d):
    return vs.with_properties(t.parts(spark, d).filter("price > 1200").select("code"), t.properties(spark, d), ["brand", "size"])


@query(f"""WITH {CONCEPT}, req AS (SELECT o_orderkey AS req_id, 'C' || (o_custkey * 2) AS code, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN upper(c_name) || '  ' ELSE 'other' END AS display
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2)
SELECT req_id, req.code, CASE WHEN c.code IS NULL THEN NULL ELSE coalesce(c.balance > 0, false) END AS result,
  CASE WHEN c.code IS NULL THEN 'unknown-code' WHEN coalesce(c.balance > 0, false) THEN 'ok' ELSE 'not-in-value-set' END AS cause,
  CASE WHEN c.code IS NOT NULL THEN lower(trim(regexp_replace(req.display, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(c.display, '\\s+', ' ', 'g'))) END AS display_ok
FROM req LEFT JOIN concept c ON c.code = req.code""")
def validate_codes_batch(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey")).alias("k"), "c_name")
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey") * 2).join(c, "k", "left")
    display = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None).cast("string")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.upper("c_name"), F.lit("  "))).otherwise("other")
    req = o.select(F.col("o_orderkey").alias("req_id"), F.concat(F.lit("C"), F.col("k").cast("string")).alias("code"), display.alias("display"))
    concepts = t.concepts(spark, d)
    return vs.validate(req, concepts.filter("balance > 0"), concepts)


@query(f"WITH {PART} SELECT l_orderkey AS req_id, bool_or(size > 40) AS result, count(*) AS n_codings FROM lineitem JOIN part_c ON code = 'P' || l_partkey GROUP BY 1")
def validate_codeable_any(spark, d):
    codings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("req_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code"))
    return vs.validate_any(codings, t.parts(spark, d).filter("size > 40"))


@query("""WITH s AS (SELECT DISTINCT c_custkey::VARCHAR AS code, 'customer' AS system FROM customer UNION SELECT p_partkey::VARCHAR, 'part' FROM part UNION SELECT s_suppkey::VARCHAR, 'supplier' FROM supplier)
SELECT code, min(system) AS system FROM s WHERE code IN (SELECT o_orderkey::VARCHAR FROM orders) GROUP BY code HAVING count(*) = 1""")
def infer_system(spark, d):
    sys = None
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey")):
        x = table(spark, d, name).select(F.col(key).cast("string").alias("code"), F.lit(name).alias("system"))
        sys = x if sys is None else sys.unionByName(x)
    return vs.infer_system(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("code")), sys)


@query(f"""WITH {PROP}, req AS (SELECT DISTINCT 'P' || l_partkey AS code FROM lineitem UNION SELECT 'P0'),
pr AS (SELECT code, string_agg(DISTINCT prop || '=' || value, ';' ORDER BY prop || '=' || value) AS properties FROM prop GROUP BY code),
up AS (SELECT code, string_agg(DISTINCT p, ';' ORDER BY p) AS parents FROM (SELECT code, brand AS p FROM part_c UNION SELECT code, type FROM part_c) GROUP BY code)
SELECT req.code, display, properties, parents FROM req LEFT JOIN part_c USING (code) LEFT JOIN pr USING (code) LEFT JOIN up USING (code)""")
def lookup_concepts(spark, d):
    req = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code")).unionByName(spark.sql("SELECT 'P0' AS code"))
    return vs.lookup(req, t.parts(spark, d), t.properties(spark, d), t.poly_edges(spark, d))


_OK = ["equivalent", "source-is-narrower-than-target"]


@query(f"WITH {MAP}, c AS (SELECT DISTINCT 'P' || l_partkey AS code FROM lineitem UNION SELECT DISTINCT 'S' || l_suppkey FROM lineitem) SELECT code, target_code AS target, min(map) AS map FROM c JOIN map ON source_code = code WHERE relationship IN ('equivalent', 'source-is-narrower-than-target') GROUP BY ALL")
def translate_forward(spark, d):
    li = table(spark, d, "lineitem")
    codes = li.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("code")).unionByName(li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code")))
    return vs.translate(codes, t.map_rows(spark, d), _OK)


@query(f"WITH {MAP} SELECT target_code AS code, source_code AS target, min(map) AS map FROM map WHERE target_code IN (SELECT 'R' || r_regionkey FROM region UNION SELECT 'N' || n_nationkey FROM nation) AND relationship IN ('equivalent', 'source-is-narrower-than-target') GROUP BY ALL")
def translate_reverse(spark, d):
    codes = t.concepts(spark, d).filter("kind IN ('region', 'nation')").select("code")
    return vs.translate(codes, t.map_rows(spark, d), _OK, reverse=True)


@query(f"WITH {MAP}, {PART} SELECT code FROM part_c WHERE code NOT IN (SELECT source_code FROM map WHERE relationship IN ('equivalent', 'source-is-narrower-than-target'))")
def translate_unmapped(spark, d):
    return vs.unmapped(t.parts(spark, d), t.map_rows(spark, d), _OK)


@query(f"""WITH {PART}, a AS (SELECT code FROM part_c WHERE size > 20), b AS (SELECT code FROM part_c WHERE price > 1200),
n AS (SELECT count(*) FILTER (a.code = b.code) AS common, count(*) FILTER (b.code IS NULL) AS only_left, count(*) FILTER (a.code IS NULL) AS only_right FROM a FULL JOIN b ON a.code = b.code)
SELECT *, CASE WHEN common + only_left + only_right = 0 THEN 'empty' WHEN only_left = 0 AND only_right = 0 THEN 'same' WHEN common = 0 THEN 'disjoint' WHEN only_right = 0 THEN 'superset' WHEN only_left = 0 THEN 'subset' ELSE 'overlapping' END AS outcome FROM n""")
def compare_sets(spark, d):
    p = t.parts(spark, d)
    return vs.compare(p.filter("size > 20"), p.filter("price > 1200"))


@query(f"WITH {PART}, a AS (SELECT code FROM part_c WHERE size > 20), b AS (SELECT code FROM part_c WHERE price > 1200) SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'right' WHEN b.code IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.code = b.code")
def compare_members(spark, d):
    p = t.parts(spark, d)
    return vs.members(p.filter("size > 20"), p.filter("price > 1200"))


@query(f"WITH {PART} SELECT brand, count(*) AS n, sum(('0x' || substr(sha256(code), 1, 15))::BIGINT)::VARCHAR AS fp FROM part_c GROUP BY brand")
def fingerprint(spark, d):
    return vs.fingerprint(t.parts(spark, d), "brand")


@query(CLOSURE + """ SELECT code FROM concept WHERE (code IN (SELECT descendant FROM closure WHERE ancestor = 'R1') AND balance > 0 OR code IN (SELECT descendant FROM closure WHERE ancestor = 'N2'))
AND code NOT IN (SELECT code FROM concept WHERE segment = 'BUILDING')""")
def ecl_and_or_minus(spark, d):
    c, codes = t.edges(spark, d), t.concepts(spark, d)
    left = ex.both(h.below(c, "R1"), codes.filter("balance > 0"))
    return ex.minus(ex.either(left, h.below(c, "N2")), codes.filter("segment = 'BUILDING'"))


@query(f"WITH {REL} SELECT DISTINCT target AS code FROM rel WHERE rel = 'part-A' AND source IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ecl_dotted(spark, d):
    return ex.dotted(ex.member_of(t.refset_members(spark, d), "1-URGENT"), t.relationships(spark, d), "part-A")


@query(f"WITH {REL}, {PART} SELECT DISTINCT source AS code FROM rel WHERE rel = 'part-N' AND target IN (SELECT code FROM part_c WHERE size < 5) AND source IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')")
def ecl_refined(spark, d):
    return ex.refined(ex.member_of(t.refset_members(spark, d), "2-HIGH"), t.relationships(spark, d), "part-N", t.parts(spark, d).filter("size < 5"))


@query(f"WITH {REL}, n AS (SELECT source, count(DISTINCT target) AS n FROM rel WHERE rel = 'part-R' GROUP BY source) SELECT 'O' || o_orderkey AS code FROM orders LEFT JOIN n ON source = 'O' || o_orderkey WHERE coalesce(n, 0) <= 1")
def ecl_cardinality(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("code"))
    return ex.refined(orders, t.relationships(spark, d), "part-R", None, 0, 1)


@query(f"WITH {REL}, {PART} SELECT DISTINCT a.source AS code FROM rel a JOIN rel b ON a.source = b.source AND a.grp = b.grp WHERE a.rel = 'part-R' AND a.grp > 0 AND b.rel = 'supplier-F' AND a.target IN (SELECT code FROM part_c WHERE size > 30) AND a.source IN (SELECT 'O' || o_orderkey FROM orders)")
def ecl_group(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("code"))
    return ex.grouped(orders, t.relationships(spark, d), [("part-R", t.parts(spark, d).filter("size > 30")), ("supplier-F", None)])


@query("SELECT DISTINCT 'C' || c_custkey AS code FROM customer WHERE c_mktsegment = 'MACHINERY'")
def ecl_member_of(spark, d):
    return ex.member_of(t.refset_members(spark, d), "MACHINERY")


@query(f"WITH {REL} SELECT DISTINCT target AS code FROM rel WHERE rel = 'supplier-O' AND target IN (SELECT 'S' || s_suppkey FROM supplier)")
def ecl_reverse(spark, d):
    sup = t.concepts(spark, d).filter("kind = 'supplier'")
    return ex.refined(sup, t.relationships(spark, d), "supplier-O", None, reverse=True)

"""More queries over maps, statuses, neighbourhoods, rules and logs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, versions
from tessera.operators import catalogues as cat
from tessera.operators import filters as fl
from tessera.operators import hierarchy as h
from tessera.operators import definitions, maps, status
from tessera.plans.hierarchy_queries import CONCEPT, EDGE, MAP, PART, REL
from tessera.session import table
from tessera.sources import terminology as t

Q, SQL = {}, {}


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _s(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query(f"WITH {MAP} SELECT map, source_code, count(DISTINCT target_code) AS n_targets, string_agg(DISTINCT target_code, ',' ORDER BY target_code) AS targets FROM map GROUP BY ALL")
def map_groups(spark, d):
    return maps.grouped(t.map_rows(spark, d))


@query(f"WITH {MAP}, f AS (SELECT DISTINCT source_code AS code, target_code AS other FROM map) SELECT code, other, 'forward' AS direction FROM f UNION ALL SELECT other, code, 'reverse' FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.code = f.other AND g.other = f.code)")
def map_both_ways(spark, d):
    return maps.both_ways(t.map_rows(spark, d))


@query(f"WITH {MAP} SELECT map, count(*) AS n_rows, count(DISTINCT source_code) AS n_sources, count(DISTINCT target_code) AS n_targets FROM map GROUP BY map")
def map_statistics(spark, d):
    return maps.provides(t.map_rows(spark, d))


KINDS = "SAME_AS Equal equivalent relatedTo wider Subsumes narrower specializes inexact unmatched Disjoint something".split()


@query("""WITH k(slot, relationship) AS (VALUES (0, 'equivalent'), (1, 'equivalent'), (2, 'equivalent'), (3, 'related-to'), (4, 'source-is-broader-than-target'), (5, 'source-is-broader-than-target'),
  (6, 'source-is-narrower-than-target'), (7, 'source-is-narrower-than-target'), (8, 'not-related-to'), (9, 'not-related-to'), (10, 'not-related-to'), (11, 'related-to'), (12, NULL))
SELECT relationship, count(*) AS n FROM lineitem JOIN k ON slot = l_orderkey % 13 GROUP BY relationship""")
def map_relationship_vocabulary(spark, d):
    kind = F.get(F.lit(KINDS), (F.col("l_orderkey") % 13).cast("int"))
    return table(spark, d, "lineitem").groupBy(maps.relationship(kind).alias("relationship")).agg(F.count("*").alias("n"))


@query("""SELECT 'O' || o_orderkey AS code, o_totalprice > 300000 AS abstract, o_orderstatus = 'F' AS inactive, o_orderstatus = 'F' OR o_orderkey % 7 = 0 AS deprecated,
  CASE WHEN o_orderstatus = 'F' THEN 'retired' WHEN o_orderkey % 7 = 0 THEN 'deprecated' ELSE 'active' END AS status FROM orders""")
def concept_status(spark, d):
    o = table(spark, d, "orders").withColumn("code", F.concat(F.lit("O"), _s("o_orderkey")))
    row = lambda cond, prop, value: o.filter(cond).select("code", F.lit(prop).alias("prop"), F.lit(value).alias("value"))
    props = row("o_totalprice > 300000", "notSelectable", "true").unionByName(row("o_orderstatus = 'F'", "status", "Retired")).unionByName(row("o_orderkey % 7 = 0", "deprecated", "true"))
    return status.flags(o.select("code"), props)


@query(f"""WITH {EDGE}, p AS (SELECT 'C' || c_custkey AS code, 'R' || n_regionkey || '.N' || n_nationkey AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT ancestor, code AS descendant, (2 - i)::INTEGER AS depth FROM (SELECT code, unnest(string_split(path, '.')) AS ancestor, unnest(range(0, 2)) AS i FROM p)""")
def closure_from_paths(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return h.closure_from_paths(c.select(F.concat(F.lit("C"), _s("c_custkey")).alias("code"), F.concat(F.lit("R"), _s("n_regionkey"), F.lit(".N"), _s("n_nationkey")).alias("path")))


@query(f"""WITH {EDGE}, b AS (SELECT parent AS a, child AS b FROM edge UNION SELECT child, parent FROM edge), r0 AS (SELECT 'N4' AS code), r1 AS (SELECT DISTINCT b AS code FROM b WHERE a IN (FROM r0)),
r2 AS (SELECT DISTINCT b AS code FROM b WHERE a IN (FROM r1)) SELECT code, 0 AS round FROM r0 UNION ALL SELECT code, 1 FROM r1 WHERE code NOT IN (FROM r0) UNION ALL SELECT code, 2 FROM r2 WHERE code NOT IN (FROM r0) AND code NOT IN (FROM r1)""")
def subset_neighbourhood(spark, d):
    return h.neighbourhood(t.edges(spark, d), spark.sql("SELECT 'N4' AS code"), 2)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS parent, n_nationkey * n_nationkey % 25 AS child FROM nation),
w AS (SELECT parent, child FROM e UNION SELECT w.parent, e.child FROM w JOIN e ON e.parent = w.child) SELECT 'N' || parent AS code FROM w WHERE parent = child""")
def hierarchy_cycles(spark, d):
    """Nations, each above the one whose number is its square modulo 25: some lie on cycles, others only lead to them."""
    n = table(spark, d, "nation")
    code = lambda x: F.concat(F.lit("N"), _s(x))
    return h.has_cycle(h.closure(n.select(code("n_nationkey").alias("parent"), code(F.col("n_nationkey") * F.col("n_nationkey") % 25).alias("child"))))


@query(f"WITH {PART}, {REL} SELECT DISTINCT target AS code FROM rel WHERE rel LIKE 'supplier-%' AND source IN (SELECT source FROM rel WHERE rel = 'part-R' AND target IN (SELECT code FROM part_c WHERE brand = 'Brand#12'))")
def filter_answers_for(spark, d):
    """Suppliers of orders that returned a part of a brand: two levels of relationships."""
    r = t.relationships(spark, d)
    orders = fl.related_to(r, "part-R", t.parts(spark, d).filter("brand = 'Brand#12'"))
    return r.filter(F.col("rel").startswith("supplier-")).join(orders.withColumnRenamed("code", "source"), "source", "left_semi").select(F.col("target").alias("code")).distinct()


@query("WITH m AS (SELECT o_orderpriority AS refset, 'O' || o_orderkey AS code FROM orders UNION ALL SELECT c_mktsegment, 'C' || c_custkey FROM customer) SELECT code, string_agg(DISTINCT refset, ',' ORDER BY refset) AS \"values\" FROM m GROUP BY code")
def refsets_of_concepts(spark, d):
    return cat.joined_values(t.refset_members(spark, d), "code", "refset")


@query("""WITH r(ord, mask, allowed) AS (VALUES (1, 'Brand#11', false), (2, 'Brand#1*', true), (3, 'Brand#2*', false)),
h AS (SELECT p_brand, ord, allowed FROM (SELECT DISTINCT p_brand FROM part) JOIN r ON CASE WHEN mask LIKE '%*' THEN starts_with(p_brand, rtrim(mask, '*')) ELSE mask = p_brand END)
SELECT b.p_brand, coalesce(arg_min(allowed, ord), true) AS allowed, min(ord) AS ord FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN h USING (p_brand) GROUP BY 1""")
def allow_list_first_rule(spark, d):
    rules = spark.sql("SELECT * FROM VALUES (1, 'Brand#11', false), (2, 'Brand#1*', true), (3, 'Brand#2*', false) AS r(ord, mask, allowed)")
    return cat.first_rule(table(spark, d, "part"), rules, "p_brand")


@query("""WITH h AS (SELECT DISTINCT p_brand AS name, (p_size % 4) || '.0.' || (p_size % 3) || CASE WHEN p_size % 2 = 0 THEN '-rc' || (p_size % 5) ELSE '' END AS version FROM part), w AS (SELECT DISTINCT p_brand AS name, (p_size % 4) || '.0.' || (p_size % 3) AS version FROM part)
SELECT w.name, w.version, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.name = w.name AND h.version = w.version) THEN w.version ELSE (SELECT max(h.version) FROM h WHERE h.name = w.name AND starts_with(h.version, w.version || '-')) END AS picked FROM w""")
def fuzzy_version_pick(spark, d):
    p = table(spark, d, "part")
    base = F.concat(_s(F.col("p_size") % 4), F.lit(".0."), _s(F.col("p_size") % 3))
    have = p.select(F.col("p_brand").alias("name"), F.concat(base, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-rc"), _s(F.col("p_size") % 5))).otherwise("")).alias("version"))
    return cat.picked_version(p.select(F.col("p_brand").alias("name"), base.alias("version")), have)


@query("""WITH l AS (SELECT DISTINCT 'P' || l_partkey AS source, 'S' || l_suppkey AS target FROM lineitem), x AS (SELECT source AS item, target AS other, 0 AS side FROM l UNION SELECT target, source, 1 FROM l)
SELECT item, count(*) FILTER (side = 0) AS uses, count(*) FILTER (side = 1) AS used_by FROM x GROUP BY item""")
def uses_and_used_by(spark, d):
    li = table(spark, d, "lineitem")
    return cat.two_way(li.select(F.concat(F.lit("P"), _s("l_partkey")).alias("source"), F.concat(F.lit("S"), _s("l_suppkey")).alias("target")))


@query("""SELECT 'event' AS kind, event_id AS id, ts AS happened FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders ORDER BY happened DESC, kind, id LIMIT 200""")
def event_log_top(spark, d):
    e = table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened"))
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened"))
    return e.unionByName(o).orderBy(F.desc("happened"), "kind", "id").limit(200)


@query("SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_usage(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events""")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'de-CH' WHEN c_custkey % 3 = 1 THEN 'en' ELSE 'fr' END AS best, CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 3 = 1 THEN 2 ELSE 1 END AS n FROM customer""")
def accept_language(spark, d):
    k = F.col("c_custkey") % 3
    header = F.when(k == 0, "en;q=0.5, de-CH, fr;q=0.7").when(k == 1, "de ; q=0.3,en;q=0.8").otherwise("fr")
    p = text.language_preferences(header)
    return table(spark, d, "customer").select("c_custkey", p[0]["tag"].alias("best"), F.size(p).alias("n"))


@query("""SELECT CASE l_linenumber % 4 WHEN 0 THEN '10-digit' WHEN 1 THEN 'product' WHEN 2 THEN '11-digit' ELSE 'other' END AS kind, count(*) AS n FROM lineitem GROUP BY 1""")
def drug_code_kinds(spark, d):
    k = F.col("l_linenumber") % 4
    code = F.when(k == 0, "0002-1433-80").when(k == 1, "0002-1433").when(k == 2, F.lpad(_s("l_partkey"), 11, "0")).otherwise("n/a")
    return table(spark, d, "lineitem").groupBy(text.drug_code_kind(code).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT 'C' || p_size AS code, p_size % 3 <> 0 AS ok, count(*) AS n FROM part GROUP BY ALL""")
def modifier_rules(spark, d):
    x = F.concat(F.lit("C"), _s("p_size"), F.when(F.col("p_size") % 3 == 0, ":25:25").when(F.col("p_size") % 3 == 1, ":25:59").otherwise(""))
    m = table(spark, d, "part").select(text.modified_code(x).alias("m"))
    return m.groupBy("m.code", "m.ok").agg(F.count("*").alias("n"))


@query("""SELECT CASE p_size % 5 WHEN 0 THEN 'date' WHEN 1 THEN 'integer' WHEN 2 THEN 'semver' WHEN 3 THEN 'natural' ELSE 'date' END AS kind, count(*) AS n FROM part GROUP BY 1""")
def version_kinds(spark, d):
    k = F.col("p_size") % 5
    v = F.when(k == 0, "20240131").when(k == 1, "7").when(k == 2, "1.2.0-rc").when(k == 3, "June 2024").otherwise("2024-01")
    return table(spark, d, "part").groupBy(versions.kind(v).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations, max(turn) AS last_turn FROM conversations GROUP BY role")
def conversation_roles(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("n_conversations"), F.max("turn").alias("last_turn"))


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def artefact_three_way(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {REL}, g AS (SELECT source, grp, string_agg(DISTINCT rel || '=' || target, ',' ORDER BY rel || '=' || target) AS form FROM rel GROUP BY ALL)
SELECT source AS code, count(DISTINCT form) AS n_groups, sha256(string_agg(DISTINCT form, ';' ORDER BY form)) AS form FROM g GROUP BY source""")
def definition_normal_forms(spark, d):
    return definitions.normal_forms(t.relationships(spark, d))


@query("""WITH g AS (SELECT DISTINCT l_partkey AS k, l_returnflag || '=' || l_linestatus AS form FROM lineitem), f AS (SELECT k, sha256(string_agg(form, ';' ORDER BY form)) AS form FROM g GROUP BY k)
SELECT form, count(*) AS n, min('P' || k) AS first FROM f GROUP BY form HAVING count(*) > 1""")
def definition_equivalents(spark, d):
    """Parts by the set of (return flag, line status) they were sold under."""
    li = table(spark, d, "lineitem")
    rels = li.select(F.concat(F.lit("P"), _s("l_partkey")).alias("source"), F.lit(0).alias("grp"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("target"))
    return definitions.equivalents(rels)


@query("SELECT 'P' || l_partkey AS code FROM (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem) WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O')) GROUP BY 1 HAVING count(*) = 2")
def definition_candidates(spark, d):
    li = table(spark, d, "lineitem")
    rels = li.select(F.concat(F.lit("P"), _s("l_partkey")).alias("source"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("target"))
    return definitions.defined_by(rels, spark.sql("SELECT * FROM VALUES ('R', 'F'), ('N', 'O') AS w(rel, target)"))


@query("""WITH h AS (SELECT DISTINCT p_brand AS name, (p_size % 4) || '.' || (p_size % 11) || '.' || (p_size % 3) AS version FROM part)
SELECT name, arg_max(version, (split_part(version, '.', 2)::INT, split_part(version, '.', 3)::INT)) AS version FROM h WHERE starts_with(version, '1.') GROUP BY name""")
def best_matching_version(spark, d):
    """The newest version of each name that fits 1.x."""
    p = table(spark, d, "part")
    v = F.concat(_s(F.col("p_size") % 4), F.lit("."), _s(F.col("p_size") % 11), F.lit("."), _s(F.col("p_size") % 3))
    have = p.select(F.col("p_brand").alias("name"), v.alias("version")).filter(versions.matches(F.col("version"), F.lit("1.x.x")))
    return have.groupBy("name").agg(F.max_by("version", versions.semver_key(F.col("version"))).alias("version"))

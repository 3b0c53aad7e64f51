"""Queries over packages, servers, feeds and concept definitions, and the same in SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import definitions as df
from tessera.operators import hierarchy as h
from tessera.operators import registry as rg
from tessera.plans.hierarchy_queries import CLOSURE, REL
from tessera.session import table
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


PACKAGE = """package AS (SELECT 'C' || o_custkey AS name, (o_orderkey % 3) || '.' || (o_orderkey % 12) || '.' || o_orderkey AS version, o_orderdate AS published, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END AS description, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_orderkey % 100 END AS downloads FROM orders)"""


def _packages(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("C"), _s("o_custkey")).alias("name"), F.concat_ws(".", _s(k % 3), _s(k % 12), _s(k)).alias("version"), F.col("o_orderdate").alias("published"),
        F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 1, "").alias("description"), F.when(k % 5 != 0, k % 100).alias("downloads"),
    )


@query(f"""WITH {PACKAGE} SELECT name, version, published, row_number() OVER w::INTEGER AS place, row_number() OVER w = 1 AS is_latest, last_value(nullif(description, '') IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS description, coalesce(downloads, 0) AS downloads
  FROM package WINDOW w AS (PARTITION BY name ORDER BY published DESC, version DESC)""")
def package_versions(spark, d):
    return rg.package_versions(_packages(spark, d))


@query(f"WITH {PACKAGE} SELECT name, version, published, row_number() OVER (ORDER BY published DESC, name, version)::INTEGER AS place FROM package WHERE published >= TIMESTAMP '1998-01-01'")
def package_updates(spark, d):
    return rg.updates_since(_packages(spark, d), datetime.datetime(1998, 1, 1)).select("name", "version", "published", "place")


@query(f"WITH {PACKAGE} SELECT name, version FROM package ORDER BY split_part(version, '.', 1)::INT DESC, split_part(version, '.', 2)::INT DESC, split_part(version, '.', 3)::INT DESC, name LIMIT 50")
def package_sorted(spark, d):
    """The first fifty packages by version, the greatest first."""
    return _packages(spark, d).orderBy(*rg.package_order("-version")).limit(50).select("name", "version")


@query("SELECT 'P' || p_partkey AS id, p_brand AS url, p_type AS version FROM part ORDER BY url, version, id LIMIT 40")
def search_sorted(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("P"), _s("p_partkey")).alias("id"), F.col("p_brand").alias("url"), F.col("p_type").alias("version"))
    return p.orderBy(*rg.search_order("vurl")).limit(40)


@query("""WITH x AS (SELECT 'O' || l_orderkey AS package, 'S' || l_suppkey AS name, max((l_linenumber % 3) || '.0') AS version FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT package, string_agg(name || ':' || version, ',' ORDER BY name || ':' || version) AS needs FROM x GROUP BY package""")
def dependency_maps(spark, d):
    mark = F.when(F.col("l_returnflag") == "R", "").otherwise("@")
    li = table(spark, d, "lineitem").select(F.concat(F.lit("O"), _s("l_orderkey")).alias("package"), F.concat(F.lit("S"), _s("l_suppkey"), mark, _s(F.col("l_linenumber") % 3), F.lit(".0")).alias("dependency"))
    return rg.dependency_maps(li)


@query("""WITH o AS (SELECT DISTINCT p_brand, p_type, p_name FROM part), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_name) <= 3)
SELECT p_brand, p_type, n, names FROM (SELECT p_brand, p_type, count(*) AS n FROM o GROUP BY ALL) JOIN (SELECT p_brand, p_type, string_agg(p_name, ',' ORDER BY p_name) AS names FROM f GROUP BY ALL) USING (p_brand, p_type)""")
def package_detail(spark, d):
    return rg.package_detail(table(spark, d, "part"), "p_brand", "p_type", "p_name", 3)


@query(f"WITH {PACKAGE} SELECT count(DISTINCT name) AS n_names, count(*) AS n_versions, sum(downloads)::BIGINT AS downloads FROM package")
def download_totals(spark, d):
    return rg.totals(_packages(spark, d))


SERVER = """server AS (SELECT 'S' || l_suppkey AS server, (l_linenumber % 3) || '.0' AS version, l_suppkey % 7 = 0 AND l_linenumber % 3 = 0 AS error, 'u:' || (l_partkey % 20) || '|' || (l_suppkey % 3) AS system, 'v:' || (l_partkey % 30) AS value_set, ['u:' || (l_suppkey % 20), 'u:1*'] AS masks FROM lineitem)"""


def _servers(spark, d):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), _s(s)).alias("server"), F.concat(_s(n % 3), F.lit(".0")).alias("version"), ((s % 7 == 0) & (n % 3 == 0)).alias("error"),
        F.concat(F.lit("u:"), _s(p % 20), F.lit("|"), _s(s % 3)).alias("system"), F.concat(F.lit("v:"), _s(p % 30)).alias("value_set"), F.array(F.concat(F.lit("u:"), _s(s % 20)), F.lit("u:1*")).alias("masks"),
    )


@query(f"""WITH {SERVER}, v AS (SELECT server, version, bool_or(error) AS error FROM server GROUP BY ALL)
SELECT (SELECT count(DISTINCT server) FROM v) AS n_servers, (SELECT count(*) FROM v) AS n_versions, (SELECT count(*) FROM v WHERE NOT error) AS n_working, (SELECT count(*) FROM v WHERE error) AS n_errors, count(DISTINCT system) AS n_systems, count(DISTINCT value_set) AS n_value_sets FROM server""")
def registry_totals(spark, d):
    return rg.registry_totals(_servers(spark, d))


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS n_urls, coalesce(count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END), 0) AS n_systems FROM orders GROUP BY 1")
def store_totals(spark, d):
    systems = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority"))
    return rg.store_totals(table(spark, d, "orders").select(F.col("o_custkey").alias("url"), F.lit("1").alias("version"), F.col("o_orderstatus").alias("status"), systems.alias("systems")))


@query(f"""WITH {SERVER}, r AS (SELECT DISTINCT server, unnest(masks) AS mask, CASE WHEN NOT error THEN version END AS version FROM server), v AS (SELECT mask, server, coalesce(string_agg(version, '+' ORDER BY version), '') AS versions FROM r GROUP BY ALL)
SELECT mask, count(*) AS n_servers, string_agg(server || ':' || versions, ',' ORDER BY server || ':' || versions) AS servers FROM v GROUP BY mask""")
def authority_masks(spark, d):
    return rg.authorities(_servers(spark, d))


@query(f"""WITH {SERVER} SELECT DISTINCT server, version, system AS item, substring(server, 2)::INT % 20 = 7 AS authoritative FROM server WHERE NOT error AND starts_with(system, 'u:7|')""")
def server_rows(spark, d):
    """Servers that have a system, in any version."""
    s = _servers(spark, d).withColumn("systems", F.array("system"))
    return rg.server_rows(s, "u:7", s.select("server", F.explode("masks").alias("mask")).distinct(), "systems")


@query(f"""WITH {SERVER} SELECT DISTINCT server, version, CASE WHEN substring(server, 2)::INT % 20 = 7 THEN 'authoritative' ELSE 'candidate' END AS how FROM server WHERE NOT error AND system = 'u:7|1'""")
def server_resolve_version(spark, d):
    """Servers for one version of a system; those whose masks claim the system stand by if none has it."""
    s = _servers(spark, d).withColumn("systems", F.array("system"))
    rows = rg.server_rows(s, "u:7", s.select("server", F.explode("masks").alias("mask")).distinct(), "systems")
    return rg.resolved_servers(rows, "1", s.filter(F.array_contains("masks", "u:7")))


@query("SELECT DISTINCT 'S' || l_suppkey AS server, (l_linenumber % 3) || '.0' AS version, 'claims' AS how FROM lineitem WHERE l_suppkey % 20 = 7")
def server_resolve_claims(spark, d):
    """No server has the version, so those whose masks claim the system are named."""
    s = _servers(spark, d).withColumn("systems", F.array("system"))
    rows = rg.server_rows(s, "u:7", s.select("server", F.explode("masks").alias("mask")).distinct(), "systems")
    return rg.resolved_servers(rows, "9", s.filter(F.array_contains("masks", "u:7")))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate + INTERVAL 1 HOUR * CASE o_orderkey % 4 WHEN 0 THEN 10 ELSE 0 END END AS published FROM orders""")
def feed_dates(spark, d):
    k, at = F.col("o_orderkey") % 4, F.col("o_orderdate")
    v = F.when(k == 0, F.concat(F.date_format(at, "EEE, d MMM yyyy"), F.lit("  12:00:00 +0200"))).when(k == 1, F.date_format(at, "EEEE d MMM yyyy HH:mm")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", rg.published_at(v).cast("timestamp_ntz").alias("published"))


@query("""WITH f AS (SELECT 'g' || (o_custkey % 500) AS guid, o_orderdate AS published, o_orderkey AS item FROM orders) SELECT guid, published, item FROM f WHERE substring(guid, 2)::INT % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY guid ORDER BY published DESC, item DESC) = 1""")
def feed_new_items(spark, d):
    f = table(spark, d, "orders").select(F.concat(F.lit("g"), _s(F.col("o_custkey") % 500)).alias("guid"), F.col("o_orderdate").alias("published"), F.col("o_orderkey").alias("item"))
    return rg.new_items(f, f.filter(F.substring("guid", 2, 9).cast("int") % 3 == 0))


@query("""WITH s AS (SELECT p_brand AS package, p_type AS type FROM part WHERE p_size < 25), i AS (SELECT DISTINCT p_brand AS package, p_name AS type FROM part WHERE p_size > 40) SELECT * FROM s WHERE package NOT IN (SELECT package FROM i) UNION ALL SELECT * FROM i""")
def extension_ingest(spark, d):
    p = table(spark, d, "part")
    return rg.replaced(p.filter("p_size < 25").select(F.col("p_brand").alias("package"), F.col("p_type").alias("type")), p.filter("p_size > 40").select(F.col("p_brand").alias("package"), F.col("p_name").alias("type")), "package")


@query("""SELECT n_nationkey, contains(lower(n_name), 'nation_1') OR contains(lower(r_name), 'asia') AS found, n_nationkey % 3 = 0 AND contains(lower(r_name), 'asia') OR contains(lower(n_name), 'asia') AS there FROM nation JOIN region ON n_regionkey = r_regionkey""")
def resource_text_search(spark, d):
    """Resources found by a text in any field, and by a jurisdiction's text, code or display."""
    r = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    coding = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.struct(F.lit("x").alias("code"), F.col("r_name").alias("display"))))
    j = r.withColumn("j", F.array(F.struct(F.col("n_name").alias("text"), coding.alias("coding"))))
    return j.select("n_nationkey", (rg.matches_text(["n_name"], "Nation_1") | rg.matches_text(["r_name"], "ASIA")).alias("found"), rg.in_jurisdiction("j", "Asia").alias("there"))


@query("SELECT 'supplier-nation' AS map, 'S' AS source, 'N' AS target FROM supplier WHERE s_suppkey = 3")
def map_search(spark, d):
    maps = spark.sql("SELECT * FROM VALUES ('nation-region', 'N', 'R'), ('part-brand', 'P', 'B'), ('supplier-nation', 'S', 'N') AS t(map, source, target)")
    return rg.map_search(maps, t.map_rows(spark, d), source="S", target="N", code="S3")


@query("""SELECT event_type AS system, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'k' || (event_id % 3), count(*) FROM events WHERE event_id % 3 > 0 GROUP BY 1""")
def requests_by_system(spark, d):
    more = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(', {"system" : "k'), _s(F.col("event_id") % 3), F.lit('"}'))).otherwise("")
    log = table(spark, d, "events").select(F.concat(F.lit('{"coding": [{"system": "'), "event_type", F.lit('"}, {"system": "'), "event_type", F.lit('"}'), more, F.lit("]}")).alias("request"))
    return rg.by_systems(log).groupBy("system").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-03'")
def updated_since_mark(spark, d):
    return rg.changed_since(table(spark, d, "events").withColumn("updated", F.col("ts")), datetime.datetime(2024, 1, 3)).select("event_id")


def _rels(spark, d):
    """Orders defined by the customers' and suppliers' codes in the hierarchy: a supplier or its nation for each line."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    target = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("S"), _s("l_suppkey"))).otherwise(F.concat(F.lit("N"), _s("s_nationkey")))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("O"), _s("l_orderkey")).alias("source"), (F.col("l_linenumber") % 3).cast("int").alias("grp"), F.concat(F.lit("r-"), "l_linestatus").alias("rel"), target.alias("target"))


DEF = CLOSURE + """, up AS (SELECT ancestor, descendant FROM closure UNION SELECT code, code FROM concept),
r AS (SELECT DISTINCT 'O' || l_orderkey AS source, (l_linenumber % 3)::INTEGER AS grp, 'r-' || l_linestatus AS rel, CASE l_partkey % 2 WHEN 0 THEN 'S' || l_suppkey ELSE 'N' || s_nationkey END AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


@query(DEF + """, q AS (SELECT 'O' || o_orderkey AS a, 'O' || (o_orderkey // 2) AS b FROM orders), g AS (SELECT *, CASE WHEN grp > 0 THEN grp::VARCHAR ELSE rel || '=' || target END AS g FROM r),
n AS (SELECT a, b, g, count(*) AS needed FROM q JOIN g ON source = a GROUP BY ALL),
m AS (SELECT a, b, ga, max(n) AS n FROM (SELECT q.a, q.b, x.g AS ga, y.g AS gb, count(DISTINCT x.rel || '=' || x.target) AS n FROM q JOIN g x ON x.source = q.a JOIN g y ON y.source = q.b AND y.rel = x.rel JOIN up ON ancestor = x.target AND descendant = y.target GROUP BY ALL) GROUP BY ALL)
SELECT q.a AS code_a, q.b AS code_b, coalesce((SELECT bool_and(coalesce(m.n, 0) = n.needed) FROM n LEFT JOIN m ON m.a = n.a AND m.b = n.b AND m.ga = n.g WHERE n.a = q.a AND n.b = q.b), true) AS subsumes FROM q""")
def definition_subsumes(spark, d):
    r, o = _rels(spark, d), F.col("o_orderkey")
    req = table(spark, d, "orders").select(F.concat(F.lit("O"), _s(o)).alias("code_a"), F.concat(F.lit("O"), _s(F.floor(o / 2))).alias("code_b"))
    return df.subsumed(req, r, h.closure(t.edges(spark, d)))


@query(DEF + " SELECT source, grp, rel, target FROM r WHERE NOT EXISTS (SELECT 1 FROM r x JOIN closure ON ancestor = r.target AND descendant = x.target WHERE x.source = r.source AND x.grp = r.grp AND x.rel = r.rel)")
def definition_narrowest(spark, d):
    """Definitions without the targets that a narrower one makes redundant."""
    return df.narrowest(_rels(spark, d), h.closure(t.edges(spark, d)))


@query(DEF + """, m AS (SELECT source, grp, rel, min(target) AS target FROM r WHERE grp > 0 GROUP BY ALL)
SELECT x.source, x.grp AS g, y.grp AS h FROM m x JOIN m y ON x.source = y.source AND x.rel = y.rel AND x.grp < y.grp GROUP BY ALL HAVING bool_and((x.target, y.target) IN (SELECT (ancestor, descendant) FROM up) OR (y.target, x.target) IN (SELECT (ancestor, descendant) FROM up))""")
def definition_groups_mergeable(spark, d):
    return df.mergeable_groups(_rels(spark, d), h.closure(t.edges(spark, d)))


@query(DEF + " SELECT source, grp, rel, target, 'R1' AS hierarchy FROM r WHERE rel = 'r-F' AND target NOT IN (SELECT descendant FROM up WHERE ancestor = 'R1')")
def definition_range_check(spark, d):
    """Values outside the hierarchy that an attribute's rule names."""
    return df.outside_rules(_rels(spark, d).distinct(), h.closure(t.edges(spark, d)), {"r-F": "R1"}, "target")


@query(CLOSURE + f""", {REL}, x AS (SELECT child AS code, 0 AS k FROM edge UNION ALL SELECT source, 1 FROM rel UNION ALL SELECT target, 2 FROM rel)
SELECT code, count(*) FILTER (k = 0) AS n_parents, count(*) FILTER (k = 1) AS n_outbound, count(*) FILTER (k = 2) AS n_inbound FROM x GROUP BY code""")
def concept_links(spark, d):
    return df.linked(t.edges(spark, d), t.relationships(spark, d))


@query("SELECT DISTINCT 'O' || l_orderkey AS source_code, 'P' || l_partkey AS target_code, 'equivalent' AS kind FROM lineitem WHERE l_returnflag = 'R'")
def implicit_map(spark, d):
    li = table(spark, d, "lineitem")
    refset = F.when(F.col("l_returnflag") == "R", "900000000000526001").otherwise("900000000000527005")
    rows = li.select(refset.alias("refset"), F.concat(F.lit("O"), _s("l_orderkey")).alias("code"), F.concat(F.lit("P"), _s("l_partkey")).alias("target"))
    return df.implicit_map("http://snomed.info/sct?fhir_cm=900000000000526001", "http://snomed.info/sct", rows)


@query(CLOSURE + """ SELECT 'isa' AS kind, code FROM concept WHERE code = 'R1' OR code IN (SELECT descendant FROM closure WHERE ancestor = 'R1') UNION ALL SELECT 'refset', 'C' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'refsets', x FROM (SELECT DISTINCT c_mktsegment AS x FROM customer UNION SELECT DISTINCT o_orderpriority FROM orders)""")
def implicit_sets(spark, d):
    """What addresses of value sets name: a concept and what is below it, a reference set, all reference sets."""
    c, e, m = t.concepts(spark, d), t.edges(spark, d), t.refset_members(spark, d)
    part = lambda kind, tail: df.implicit_members("sys?fhir_vs" + tail, "sys", c, e, m).select(F.lit(kind).alias("kind"), "code")
    return part("isa", "=isa/R1").unionByName(part("refset", "=refset/BUILDING")).unionByName(part("refsets", "=refset"))

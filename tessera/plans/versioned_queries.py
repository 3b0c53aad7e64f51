"""Queries over value sets of several systems and versions, from definitions in JSON, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import versions
from tessera.operators import hierarchy as h
from tessera.operators import versioned as vv
from tessera.session import table
from tessera.sources import resources
from tessera.sources import terminology as t

Q, SQL = {}, {}
VC = """vc AS (SELECT lower(p_type) AS system, CASE p_size % 3 WHEN 0 THEN '1.0.0' WHEN 1 THEN '1.1.0' ELSE '2.0.0' END AS version, 'P' || (p_partkey % 40) AS code, min(p_name) AS display FROM part GROUP BY ALL),
up AS (SELECT DISTINCT system, code, code AS anc, substring(code, 2)::INT AS n FROM vc UNION ALL SELECT system, code, 'P' || (n // 3), n // 3 FROM up WHERE n > 0)"""
WITH_VC = "WITH RECURSIVE " + VC

# Value sets in JSON, as they would be read from files.
SETS = [
    """{"resourceType": "ValueSet", "url": "vs:tools", "version": "1.0", "compose": {"include": [
      {"system": "economy", "version": "1.1.0", "filter": [{"property": "concept", "op": "is-a", "value": "P2"}]},
      {"system": "small", "concept": [{"code": "P1"}, {"code": "P7"}, {"code": "nothing"}]},
      {"system": "promo", "version": "1.x", "filter": [{"property": "concept", "op": "descendent-of", "value": "P0"}, {"property": "concept", "op": "in", "value": "P3, P9, P10,P30"}]}],
      "exclude": [{"system": "economy", "concept": [{"code": "P7"}]}]}}""",
    """{"resourceType": "ValueSet", "url": "vs:odd", "compose": {"include": [{"system": "large"}, {"system": "economy", "version": "1.1.0"}, {"system": "economy", "version": "2.0.0"}, {"system": "no-such-system"}]}}""",
    """{"resourceType": "ValueSet", "url": "vs:both", "version": "2.1.3", "compose": {"include": [{"valueSet": ["vs:tools|1.0", "vs:odd"]}, {"system": "medium", "concept": [{"code": "P5"}, {"code": "P6"}]}]}}""",
    """{"resourceType": "ValueSet", "url": "vs:other-version", "version": "1", "compose": {"include": [{"system": "standard", "version": "2.0.0"}], "exclude": [{"system": "standard", "version": "1.0.0"}]}}""",
    """{"resourceType": "ValueSet", "url": "vs:same-list", "version": "1", "compose": {"include": [{"system": "small", "concept": [{"code": "P7"}]}, {"system": "small", "concept": [{"code": "P1"}]}]}}""",
    """{"resourceType": "ValueSet", "url": "vs:same-list-too", "version": "1", "compose": {"include": [{"system": "small", "concept": [{"code": "P1"}, {"code": "P7"}]}]}}""",
]


def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _clauses(spark):
    return resources.value_set_clauses(spark.createDataFrame([(x,) for x in SETS], "json string"))


def _expanded(spark, d, *sets):
    clauses = _clauses(spark)
    if sets:
        clauses = clauses.filter(vv.named().isin(list(sets)))
    edges = t.versioned_edges(spark, d)
    props = spark.createDataFrame([], "system string, prop string, value string, code string")
    return vv.expanded(clauses, t.versioned_concepts(spark, d), h.closure_by_system(edges), props)


EXPANDED = WITH_VC + """, latest AS (SELECT system, max(version) AS version FROM vc GROUP BY system),
tools AS (SELECT v.system, v.version, v.code, 0 AS o FROM vc v WHERE v.system = 'economy' AND v.version = '1.1.0' AND v.code <> 'P7' AND v.code IN (SELECT code FROM up WHERE system = 'economy' AND anc = 'P2')
  UNION ALL SELECT system, version, code, 1 FROM vc JOIN latest USING (system, version) WHERE system = 'small' AND code IN ('P1', 'P7')
  UNION ALL SELECT system, version, code, 2 FROM vc WHERE system = 'promo' AND version = (SELECT max(version) FROM vc WHERE system = 'promo' AND version < '2') AND code IN ('P3', 'P9', 'P10', 'P30')),
odd AS (SELECT system, version, code, 0 AS o FROM vc JOIN latest USING (system, version) WHERE system = 'large'
  UNION ALL SELECT system, version, code, CASE version WHEN '1.1.0' THEN 1 ELSE 2 END FROM vc WHERE system = 'economy' AND version IN ('1.1.0', '2.0.0')),
list AS (SELECT system, version, code FROM vc JOIN latest USING (system, version) WHERE system = 'small' AND code IN ('P1', 'P7')),
x AS (SELECT 'vs:tools|1.0' AS vset, * FROM tools UNION ALL SELECT 'vs:odd', * FROM odd
  UNION ALL SELECT 'vs:both|2.1.3', a.system, a.version, a.code, 0 FROM tools a JOIN odd b USING (system, version, code)
  UNION ALL SELECT 'vs:both|2.1.3', system, version, code, 1 FROM vc JOIN latest USING (system, version) WHERE system = 'medium' AND code IN ('P5', 'P6')
  UNION ALL SELECT 'vs:other-version|1', system, version, code, 0 FROM vc WHERE system = 'standard' AND version = '2.0.0'
  UNION ALL SELECT 'vs:same-list|1', system, version, code, CASE code WHEN 'P7' THEN 0 ELSE 1 END FROM list UNION ALL SELECT 'vs:same-list-too|1', system, version, code, 0 FROM list)"""


@query(EXPANDED + " SELECT x.vset, x.system, x.version, x.code, vc.display, x.o::INTEGER AS clause_ord FROM x JOIN vc USING (system, version, code)")
def expand_resource(spark, d):
    """Six value sets read from JSON, over six systems in three versions: stated, partial and missing versions, filters, lists, imports, excludes."""
    return _expanded(spark, d)


@query(EXPANDED + ", n AS (SELECT vset, count(*) AS n, bool_or(system = 'large') AS open FROM x WHERE vset IN ('vs:tools|1.0', 'vs:odd') GROUP BY vset) SELECT vset, CASE WHEN NOT open THEN n END AS total FROM n")
def expansion_totals(spark, d):
    """The total of two sets; those that draw on a system which can't be listed in full have none."""
    return vv.totals(_expanded(spark, d, "vs:tools|1.0", "vs:odd"), spark.sql("SELECT 'large' AS system"))


@query(EXPANDED + """, r AS (SELECT p_partkey AS req_id, 'P' || (p_partkey % 40) AS code, CASE p_size % 2 WHEN 0 THEN lower(p_type) END AS stated FROM part),
only1 AS (SELECT code, min(system) AS system FROM x WHERE vset = 'vs:tools|1.0' GROUP BY code HAVING count(DISTINCT system) = 1)
SELECT req_id, coalesce(stated, o.system) AS system, EXISTS (SELECT 1 FROM x WHERE vset = 'vs:tools|1.0' AND x.code = r.code AND x.system = coalesce(stated, o.system)) AS result FROM r LEFT JOIN only1 o ON o.code = r.code""")
def validate_stored_expansion(spark, d):
    """Codes with and without a system against an expansion that is at hand."""
    p = table(spark, d, "part")
    req = p.select(F.col("p_partkey").alias("req_id"), F.lit("vs:tools|1.0").alias("vset"), F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).alias("system"), F.concat(F.lit("P"), (F.col("p_partkey") % 40).cast("string")).alias("code"))
    return vv.in_stored(req, _expanded(spark, d, "vs:tools|1.0"))


@query(WITH_VC + """, r AS (SELECT p_partkey AS req_id, lower(p_type) AS system, 'P' || (p_size % 45) AS code FROM part), h AS (SELECT DISTINCT system, version FROM vc),
g AS (SELECT req_id, count(*) AS n, count(vc.code) AS hit, max(h.version) AS newest, max(CASE WHEN vc.code IS NOT NULL THEN h.version END) AS holds FROM r JOIN h USING (system) LEFT JOIN vc ON vc.system = r.system AND vc.version = h.version AND vc.code = r.code GROUP BY req_id)
SELECT req_id, CASE WHEN n = hit THEN NULL ELSE coalesce(holds, newest) END AS version FROM g""")
def pick_newest_version(spark, d):
    """The newest version of a system that holds a code."""
    p = table(spark, d, "part")
    req = p.select(F.col("p_partkey").alias("req_id"), F.lower("p_type").alias("system"), F.concat(F.lit("P"), (F.col("p_size") % 45).cast("string")).alias("code"))
    return vv.holding_versions(req, t.versioned_concepts(spark, d))


RULES = "SELECT * FROM VALUES ('economy', '2.0.0', NULL, NULL), ('small', NULL, '1.0.0', NULL), ('promo', NULL, NULL, '2'), ('large', NULL, NULL, '1.1.0') AS r(system, override, fallback, check)"


@query(WITH_VC + """, l AS (SELECT system, max(version) AS v FROM vc GROUP BY system), p AS (SELECT max(version) AS v FROM vc WHERE system = 'promo' AND version < '2')
SELECT * FROM (VALUES ('vs:tools|1.0', 'include', 0, 'economy', '2.0.0', NULL), ('vs:tools|1.0', 'include', 1, 'small', '1.0.0', NULL), ('vs:tools|1.0', 'include', 2, 'promo', (SELECT v FROM p), 'version 1.x does not fit 2'), ('vs:tools|1.0', 'exclude', 0, 'economy', '2.0.0', NULL),
  ('vs:odd', 'include', 0, 'large', '1.1.0', NULL), ('vs:odd', 'include', 1, 'economy', '2.0.0', NULL), ('vs:odd', 'include', 2, 'economy', '2.0.0', NULL), ('vs:odd', 'include', 3, 'no-such-system', NULL, NULL),
  ('vs:both|2.1.3', 'include', 1, 'medium', (SELECT v FROM l WHERE system = 'medium'), NULL), ('vs:other-version|1', 'include', 0, 'standard', '2.0.0', NULL), ('vs:other-version|1', 'exclude', 0, 'standard', '1.0.0', NULL),
  ('vs:same-list|1', 'include', 0, 'small', '1.0.0', NULL), ('vs:same-list|1', 'include', 1, 'small', '1.0.0', NULL), ('vs:same-list-too|1', 'include', 0, 'small', '1.0.0', NULL)) AS t(vset, kind, clause_ord, system, used, complaint)""")
def expand_versions(spark, d):
    """The version that each clause reads, under rules that override, fall back and check."""
    c = vv.chosen(_clauses(spark).filter("system IS NOT NULL"), t.versioned_concepts(spark, d), spark.sql(RULES))
    return c.select(vv.named().alias("vset"), "kind", "clause_ord", "system", "used", "complaint")


@query("SELECT * FROM (VALUES ('vs:other-version|1')) AS t(vset)")
def exclude_other_versions(spark, d):
    """Sets whose excludes name other versions of their one system only."""
    return vv.other_versions_only(_clauses(spark))


@query("SELECT * FROM (VALUES ('vs:odd', 'economy', '2.0.0'), ('vs:tools|1.0', 'economy', '1.1.0'), ('vs:tools|1.0', 'promo', '1.x'), ('vs:other-version|1', 'standard', '2.0.0')) AS t(vset, system, version)")
def implied_versions(spark, d):
    return vv.implied_versions(_clauses(spark))


@query("""SELECT p_partkey AS req_id, unnest(CASE p_size % 4 WHEN 0 THEN [1] WHEN 1 THEN [2] WHEN 2 THEN [1, 2] ELSE [1, 2] END)::INTEGER AS clause_ord FROM part""")
def version_clauses(spark, d):
    """The includes of vs:odd to look in for codes of one system with a listed version, one that isn't listed, or none."""
    k = F.col("p_size") % 4
    v = F.when(k == 0, "1.1.0").when(k == 1, "2.0.0").when(k == 2, "9.9.9")
    req = table(spark, d, "part").select(F.col("p_partkey").alias("req_id"), F.lit("vs:odd").alias("vset"), F.lit("economy").alias("system"), v.alias("version"))
    return vv.useful_clauses(req, _clauses(spark))


@query("""SELECT * FROM (VALUES ('vs:tools|1.0', 'economy', 'closed'), ('vs:tools|1.0', 'small', 'unclosed'), ('vs:tools|1.0', 'promo', 'is-a-supplement'), ('vs:odd', 'large', 'no-content'), ('vs:odd', 'economy', 'closed'), ('vs:odd', 'no-such-system', 'unknown-system'),
  ('vs:both|2.1.3', 'medium', 'unclosed'), ('vs:other-version|1', 'standard', 'closed'), ('vs:same-list|1', 'small', 'unclosed'), ('vs:same-list-too|1', 'small', 'unclosed')) AS t(vset, system, state)""")
def content_states(spark, d):
    systems = spark.sql("SELECT * FROM VALUES ('economy', 'complete', false), ('small', 'fragment', false), ('promo', 'supplement', false), ('large', 'not-present', false), ('medium', 'complete', true), ('standard', 'complete', false) AS s(system, content, grammar)")
    return vv.content_state(_clauses(spark), systems)


@query("SELECT * FROM (VALUES ('vs:odd', 'economy', 2::BIGINT), ('vs:other-version|1', 'standard', 2::BIGINT), ('vs:tools|1.0', 'economy', 2::BIGINT)) AS t(vset, system, n)")
def several_versions(spark, d):
    return vv.several_versions(_clauses(spark))


@query("SELECT * FROM (VALUES ('vs:same-list|1', 'include', 'small', NULL::VARCHAR, 'P1,P7', NULL::VARCHAR)) AS t(vset, kind, system, system_version, codes, filters)")
def tidied_clauses(spark, d):
    return vv.tidied(_clauses(spark).filter("url = 'vs:same-list'"))


@query("SELECT * FROM (VALUES ('vs:same-list|1', 'vs:same-list-too|1')) AS t(vset_a, vset_b)")
def same_definitions(spark, d):
    c = _clauses(spark)
    return vv.same_clauses(c.filter("url = 'vs:same-list'"), c.filter("url <> 'vs:same-list'")).select("vset_a", "vset_b")


@query(WITH_VC + """, f AS (SELECT p_partkey AS pair, 'P' || (p_partkey % 40) AS a, 'P' || (p_size % 14) AS b, CASE p_size % 5 WHEN 0 THEN '=' ELSE 'is-a' END AS op FROM part), tree AS (SELECT DISTINCT code, anc FROM up WHERE code <> anc)
SELECT pair, CASE WHEN a = b THEN 'same' WHEN op <> 'is-a' THEN 'unknown' WHEN EXISTS (SELECT 1 FROM tree WHERE code = b AND anc = a) THEN 'left-wider' WHEN EXISTS (SELECT 1 FROM tree WHERE code = a AND anc = b) THEN 'right-wider' ELSE 'disjoint' END AS relation FROM f""")
def filter_set_relations(spark, d):
    """Pairs of filters told apart by the hierarchy."""
    pairs = h.closure(t.versioned_edges(spark, d).select("parent", "child"))
    op = F.when(F.col("p_size") % 5 == 0, "=").otherwise("is-a")
    code = lambda c, n: F.concat(F.lit("P"), (F.col(c) % n).cast("string"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("pair"), *[x for s, c in (("a", code("p_partkey", 40)), ("b", code("p_size", 14))) for x in (F.lit("concept").alias(f"property_{s}"), op.alias(f"op_{s}"), c.alias(f"value_{s}"))])
    return vv.filter_relations(rows, pairs, many_parents=False)


_RES = """res AS (SELECT DISTINCT 'u:' || p_brand AS url, (p_size % 3) || '.' || (p_size % 4) || '.' || (p_size % 5) AS version FROM part)"""
_KEY = "(split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, split_part(version, '.', 3)::INT)"


def _resources(spark, d):
    s = lambda n: (F.col("p_size") % n).cast("string")
    return table(spark, d, "part").select(F.concat(F.lit("u:"), "p_brand").alias("url"), F.concat_ws(".", s(3), s(4), s(5)).alias("version")).distinct()


@query(f"""WITH {_RES}, w AS (SELECT DISTINCT 'u:' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '|' || (p_size % 3) || '.' || (p_size % 4) || '.7' ELSE '|' || (p_size % 3) || '.' || (p_size % 4) || '.' || (p_size % 5) END AS canonical FROM part),
c AS (SELECT canonical, split_part(canonical, '|', 1) AS u, split_part(canonical, '|', 2) AS v FROM w)
SELECT canonical, CASE WHEN b IS NOT NULL THEN u END AS url, b AS version FROM (SELECT canonical, u, CASE WHEN v = '' THEN (SELECT arg_max(version, {_KEY}) FROM res WHERE url = u)
  ELSE coalesce((SELECT max(version) FROM res WHERE url = u AND version = v), (SELECT arg_max(version, {_KEY}) FROM res WHERE url = u AND starts_with(version, regexp_extract(v, '^[0-9]+\\.[0-9]+') || '.'))) END AS b FROM c)""")
def resolve_canonicals(spark, d):
    """Canonicals with no version, a version that is there, or one of which only the major and minor parts are."""
    s = lambda n: (F.col("p_size") % n).cast("string")
    k = F.col("p_partkey") % 3
    v = F.when(k == 0, "").when(k == 1, F.concat(F.lit("|"), s(3), F.lit("."), s(4), F.lit(".7"))).otherwise(F.concat(F.lit("|"), F.concat_ws(".", s(3), s(4), s(5))))
    return vv.resolved(table(spark, d, "part").select(F.concat(F.lit("u:"), "p_brand", v).alias("canonical")), _resources(spark, d))


@query(f"""WITH {_RES}, k AS (SELECT url || '|' || version AS key, url, version FROM res UNION ALL SELECT url || '|' || regexp_extract(version, '^[0-9]+\\.[0-9]+'), url, arg_max(version, {_KEY}) FROM res GROUP BY 1, 2 UNION ALL SELECT url, url, arg_max(version, {_KEY}) FROM res GROUP BY url)
SELECT key, url, version FROM k""")
def version_keys(spark, d):
    return vv.version_keys(_resources(spark, d))


@query("""SELECT DISTINCT canonical, CASE WHEN canonical LIKE 'u:Brand#1%' AND p_brand = 'Brand#1' THEN 'u:Brand#1|9.0.0' WHEN p_brand = 'Brand#2' AND canonical NOT LIKE '%|%' THEN 'u:Brand#2|3.0.0' ELSE canonical END AS pinned
  FROM (SELECT p_brand, 'u:' || p_brand || CASE p_size % 2 WHEN 0 THEN '|' || (p_size % 3) || '.0.0' ELSE '' END AS canonical FROM part)""")
def pinned_canonicals(spark, d):
    rules = spark.sql("SELECT * FROM VALUES ('u:Brand#1', '9.0.0', NULL, NULL), ('u:Brand#2', NULL, '3.0.0', '2') AS r(system, override, fallback, check)")
    v = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("|"), (F.col("p_size") % 3).cast("string"), F.lit(".0.0"))).otherwise("")
    return vv.pinned(table(spark, d, "part").select(F.concat(F.lit("u:"), "p_brand", v).alias("canonical")).distinct(), rules)


@query("""WITH v AS (SELECT DISTINCT p_size % 3 AS a, p_size % 4 AS b, p_size % 5 AS c FROM part)
SELECT a || '.' || b || '.' || c AS version, a >= 1 AS m, (a, b) >= (1, 2) AS mm, (a, b, c) >= (1, 2, 1) AS mmp, a >= 4 AS r4 FROM v""")
def this_or_later(spark, d):
    """Versions that are 1.2.1 or later, told to each part, or the fourth release or later."""
    v = _resources(spark, d).select("version").distinct()
    later = lambda p, c="1.2.1": versions.this_or_later(F.lit(c), F.col("version"), p)
    return v.select("version", later("major").alias("m"), later("minor").alias("mm"), later("patch").alias("mmp"), later("major", "R4").alias("r4"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey % 2 = 0 AS same FROM orders")
def dates_and_canonicals(spark, d):
    """Dates without dashes and time, and canonicals that fit a pattern by url and version."""
    day = versions.date_digits(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))
    value = F.concat(F.lit("u:a|"), F.when(F.col("o_orderkey") % 2 == 0, "1.4.0").otherwise("2.0.0"))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), versions.canonical_matches(value, F.lit("u:a|1.x")).alias("same"))

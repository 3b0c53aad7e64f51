"""Queries over catalogues, texts, versions and incremental state, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text, versions
from tessera.operators import catalogues as cat
from tessera.operators import filters as fl
from tessera.session import table
from tessera.sources import terminology as t
from tessera.streaming import sync

Q, SQL = {}, {}


def _s(c):
    return c.cast("string")



def query(sql: str):
    def put(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""WITH m AS (SELECT source AS code, lang, text AS value, CASE WHEN quality = 0 THEN 'retired' ELSE 'active' END AS status, d.doc_id AS ord, CASE WHEN lang = 'de' THEN 3 ELSE 0 END AS quality
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT code, lang, value, status, ord, quality FROM m WHERE quality > 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY quality DESC, status <> 'active', ord) = 1""")
def designation_best(spark, d):
    return cat.best_designation(t.designations(spark, d), "de")


@query("""SELECT lang, CASE WHEN lower(lang) = 'en' THEN 3 ELSE 0 END AS m_en, regexp_extract(lang, '^([A-Za-z]{2,3})(?:-|$)', 1) AS language, count(*) AS n FROM documents GROUP BY ALL""")
def language_match(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n")).select("lang", text.language_match(F.col("lang"), "en").alias("m_en"), text.language_part(F.col("lang"), "language").alias("language"), "n")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'same' WHEN s_suppkey % 4 = 1 THEN CASE WHEN lower(s_name) = s_name THEN 'same' ELSE 'case' END WHEN s_suppkey % 4 = 2 THEN 'space' ELSE 'other' END AS difference FROM supplier""")
def display_check(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    given = F.when(k == 0, F.col("s_name")).when(k == 1, F.lower("s_name")).when(k == 2, F.concat(F.lit("  "), F.upper("s_name"), F.lit(" "))).otherwise("another")
    return s.select("s_suppkey", text.display_difference(given, F.col("s_name")).alias("difference"))


@query("""WITH r AS (SELECT 'P' || p_partkey AS code, p_name AS display, CASE WHEN lower('P' || p_partkey) = 'p1' OR lower(p_name) = 'p1' THEN 100 WHEN starts_with(lower('P' || p_partkey), 'p1') THEN 90
  WHEN starts_with(lower(p_name), 'p1') THEN 80 WHEN contains(lower('P' || p_partkey), 'p1') THEN 60 WHEN contains(lower(p_name), 'p1') THEN 50 WHEN contains(lower(p_type), 'p1') THEN 30 END AS rating FROM part)
SELECT code, display, rating FROM r WHERE rating IS NOT NULL""")
def text_search_rating(spark, d):
    p = t.parts(spark, d)
    return p.select("code", "display", fl.rating(F.col("code"), F.col("display"), F.col("type"), "p1").alias("rating")).filter("rating IS NOT NULL")


_TOKENS = r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS w FROM documents),
h AS (SELECT doc_id, max(starts_with(w, 'licens')::INT) + max(starts_with(w, 'vers')::INT) AS n_hits FROM w GROUP BY doc_id)
SELECT doc_id, n_hits FROM h WHERE n_hits """


@query(_TOKENS + ">= 1")
def stem_search_any(spark, d):
    return fl.search_words(table(spark, d, "documents"), ["licens", "vers"], every=False)


@query(_TOKENS + "= 2")
def stem_search_all(spark, d):
    return fl.search_words(table(spark, d, "documents"), ["licens", "vers"], every=True)


_VER = "SELECT l_orderkey, l_linenumber, (l_linenumber % 3) || '.' || (l_partkey % 12) || '.' || (l_suppkey % 7) || CASE WHEN l_returnflag = 'R' THEN '-rc' ELSE '' END AS version FROM lineitem"


def _versions(spark, d):
    li = table(spark, d, "lineitem")
    s = lambda c: c.cast("string")
    v = F.concat(s(F.col("l_linenumber") % 3), F.lit("."), s(F.col("l_partkey") % 12), F.lit("."), s(F.col("l_suppkey") % 7), F.when(F.col("l_returnflag") == "R", "-rc").otherwise(""))
    return li.select("l_orderkey", "l_linenumber", v.alias("version"))


@query(f"WITH v AS (SELECT DISTINCT version FROM ({_VER})) SELECT version, row_number() OVER (ORDER BY split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, split_part(split_part(version, '.', 3), '-', 1)::INT, NOT contains(version, '-'))::INTEGER AS place FROM v")
def version_sort(spark, d):
    v = _versions(spark, d).select("version").distinct()
    return cat.numbered(v, [versions.semver_key(F.col("version"))], "place")


@query(f"SELECT version, count(*) AS n FROM ({_VER}) WHERE regexp_full_match(version, '1\\.[0-9]+\\.[0-9]+') GROUP BY version")
def version_match(spark, d):
    return _versions(spark, d).filter(versions.matches(F.col("version"), F.lit("1.x.x"))).groupBy("version").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, arg_max(version, (split_part(version, '.', 1)::INT, split_part(version, '.', 2)::INT, split_part(split_part(version, '.', 3), '-', 1)::INT, NOT contains(version, '-'))) AS version FROM ({_VER}) GROUP BY l_orderkey")
def version_latest(spark, d):
    v = _versions(spark, d)
    return v.groupBy("l_orderkey").agg(F.max_by("version", versions.semver_key(F.col("version"))).alias("version"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, count(*) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS recent FROM orders GROUP BY ALL")
def facet_counts(spark, d):
    return cat.facets(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], {"large": F.col("o_totalprice") > 200000, "recent": F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")})


@query("SELECT p_partkey, p_brand, count(l_partkey) AS n_uses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def usage_count_list(spark, d):
    uses = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return cat.with_usage(table(spark, d, "part").select("p_partkey", "p_brand"), uses, "p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def only_used(spark, d):
    return cat.used_only(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH dep AS (SELECT DISTINCT 'O' || l_orderkey AS package, 'P' || l_partkey || '@' || (l_linenumber % 3) || '.' || (l_suppkey % 3) || '.0' AS dependency FROM lineitem),
pk AS (SELECT DISTINCT 'P' || p_partkey AS name, (p_size % 3) || '.' || (p_size % 3) AS mm FROM part)
SELECT package, dependency FROM dep WHERE NOT EXISTS (SELECT 1 FROM pk WHERE name = split_part(dependency, '@', 1) AND mm = split_part(split_part(dependency, '@', 2), '.', 1) || '.' || split_part(split_part(dependency, '@', 2), '.', 2))""")
def broken_dependencies(spark, d):
    s = lambda c: c.cast("string")
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    dep = li.select(F.concat(F.lit("O"), s(F.col("l_orderkey"))).alias("package"), F.concat(F.lit("P"), s(F.col("l_partkey")), F.lit("@"), s(F.col("l_linenumber") % 3), F.lit("."), s(F.col("l_suppkey") % 3), F.lit(".0")).alias("dependency")).distinct()
    k = s(F.col("p_size") % 3)
    return cat.broken(dep, p.select(F.concat(F.lit("P"), s(F.col("p_partkey"))).alias("name"), F.concat(k, F.lit("."), k, F.lit(".4-beta")).alias("version")))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def extension_usage_grid(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return cat.usage_grid(e, "event_type", "day", "user_id").select("event_type", "day", "n", "n_users")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS \"values\" FROM events GROUP BY user_id")
def extension_types(spark, d):
    return cat.joined_values(table(spark, d, "events"), "user_id", "event_type")


_SERVERS = """WITH n AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n_resources, max(l_shipdate) AS last_success FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_suppkey),
s AS (SELECT s_nationkey AS region, s_name AS name, s_acctbal > 5000 AS authoritative, s_acctbal < 0 AS has_error, last_success, coalesce(n_resources, 0) AS n_resources, (s_suppkey % 5)::BIGINT AS version
  FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey)"""


def _servers(spark, d):
    li = table(spark, d, "lineitem").filter("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("n_resources"), F.max("l_shipdate").alias("last_success"))
    s = table(spark, d, "supplier").join(li, "s_suppkey", "left")
    return s.select(F.col("s_nationkey").alias("region"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 5000).alias("authoritative"), (F.col("s_acctbal") < 0).alias("has_error"), "last_success", F.coalesce("n_resources", F.lit(0)).alias("n_resources"), (F.col("s_suppkey") % 5).alias("version"))


@query(_SERVERS + " SELECT *, (row_number() OVER (PARTITION BY region ORDER BY authoritative DESC, has_error, last_success DESC NULLS LAST, n_resources DESC, version DESC, name))::INTEGER AS rank FROM s QUALIFY rank <= 3")
def server_rank(spark, d):
    return cat.ranked_servers(_servers(spark, d), 3)


@query(_SERVERS + """, m AS (SELECT region, name, version = 4 AS fits, authoritative FROM s)
SELECT region, coalesce(min(name) FILTER (fits), min(name) FILTER (authoritative)) AS name, CASE WHEN bool_or(fits) THEN 'match' WHEN bool_or(authoritative) THEN 'fallback' ELSE 'none' END AS how FROM m GROUP BY region""")
def server_resolve_fallback(spark, d):
    """Servers of version 4 of each region, else the authoritative ones."""
    fits, auth = F.col("version") == 4, F.col("authoritative")
    how = F.when(F.bool_or(fits), "match").when(F.bool_or(auth), "fallback").otherwise("none")
    return _servers(spark, d).groupBy("region").agg(F.coalesce(F.min(F.when(fits, F.col("name"))), F.min(F.when(auth, F.col("name")))).alias("name"), how.alias("how"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def package_latest(spark, d):
    return cat.latest(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate"])


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%green%' OR p_type ILIKE '%PROMO%' OR p_brand = 'Brand#12'")
def package_search(spark, d):
    p = table(spark, d, "part")
    return p.filter(F.col("p_name").ilike("%green%") | F.col("p_type").ilike("%PROMO%") | (F.col("p_brand") == "Brand#12")).select("p_partkey", "p_name")


@query("""WITH masks(mask) AS (VALUES ('Brand#1*'), ('Brand#2*'), ('Brand#12'), ('Brand#3*'), ('B*'))
SELECT DISTINCT p_brand, mask FROM part JOIN masks ON CASE WHEN mask LIKE '%*' THEN starts_with(p_brand, substr(mask, 1, length(mask) - 1)) ELSE p_brand = mask END""")
def theta_prefix_mask(spark, d):
    masks = spark.sql("SELECT explode(array('Brand#1*', 'Brand#2*', 'Brand#12', 'Brand#3*', 'B*')) AS mask")
    return cat.masked(table(spark, d, "part"), masks, "p_brand")


@query("""WITH i AS (SELECT 'segment' AS param, lower(c_mktsegment) AS value, c_custkey AS id FROM customer UNION ALL SELECT 'nation', c_nationkey::VARCHAR, c_custkey FROM customer)
SELECT id FROM i WHERE param = 'segment' AND (starts_with(value, 'auto') OR starts_with(value, 'mach')) INTERSECT SELECT id FROM i WHERE param = 'nation' AND value IN ('3', '7', '11')""")
def resource_index_search(spark, d):
    """AND across parameters, OR within one: texts by start, tokens by equality."""
    c = table(spark, d, "customer")
    index = c.select(F.explode(F.create_map(F.lit("segment"), F.lower("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("param", "value"), F.col("c_custkey").alias("id"))
    a = index.filter((F.col("param") == "segment") & (F.col("value").startswith("auto") | F.col("value").startswith("mach"))).select("id").distinct()
    return a.join(index.filter((F.col("param") == "nation") & F.col("value").isin("3", "7", "11")).select("id"), "id", "left_semi")


@query("""WITH a AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
WHERE a.o_custkey IS NULL OR b.o_custkey IS NULL OR (a.n, a.k) <> (b.n, b.k)""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders")
    snap = lambda c: sync.checksum(o.filter(c).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k")), "o_custkey", ["n", "k"])
    cut = lambda x: F.lit(x).cast("timestamp")
    return sync.difference(snap(F.col("o_orderdate") < cut("1996-01-01")), snap(F.col("o_orderdate") >= cut("1994-01-01")), "o_custkey")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def sync_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "ts", "event_id")
    return sync.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "at").drop("at")


@query("WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT user_id, last_seen FROM s WHERE last_seen >= TIMESTAMP '2024-01-30'")
def expire_unseen(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return sync.expire(seen, "last_seen", "2024-01-30")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return sync.tumbling(table(spark, d, "events"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 99999 AS a, l_suppkey % 99999 AS b, CASE WHEN l_linenumber < 5 THEN l_linenumber ELSE l_linenumber * 111 END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN lpad(a::VARCHAR || b, greatest(11, length(a::VARCHAR || b))::INTEGER, '0')
  ELSE lpad(a::VARCHAR, 5, '0') || lpad(b::VARCHAR, greatest(4, length(b::VARCHAR))::INTEGER, '0') || lpad(c::VARCHAR, greatest(2, length(c::VARCHAR))::INTEGER, '0') END AS code11 FROM c""")
def ndc_code11(spark, d):
    """Codes of three parts, some longer than they are padded to, and of two."""
    li = table(spark, d, "lineitem")
    parts = [_s(F.col("l_partkey") % 99999), _s(F.col("l_suppkey") % 99999), _s(F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")).otherwise(F.col("l_linenumber") * 111))]
    code = F.when(F.col("l_linenumber") % 2 == 0, F.concat_ws("-", *parts[:2])).otherwise(F.concat_ws("-", *parts))
    return li.select("l_orderkey", "l_linenumber", text.ndc_code11(code).alias("code11"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN make_date(2018, month(o_orderdate), 1) WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders""")
def date_repair(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("2388"), F.date_format("o_orderdate", "MM"), F.lit("01"))).when(k == 1, "n/a").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return o.select("o_orderkey", text.repaired_date(raw).alias("day"))


@query(r"""WITH w AS (SELECT lang, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS word FROM documents) SELECT lang, word, count(*) AS n FROM w WHERE length(word) > 2 AND regexp_matches(word, '^[a-z]') GROUP BY ALL""")
def word_index(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("lang", F.explode(text.words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("SELECT 'http://x/' || p_brand AS url, CASE WHEN p_size > 25 THEN p_size::VARCHAR END AS version, count(*) AS n FROM part GROUP BY ALL")
def canonical_split(spark, d):
    c = F.concat(F.lit("http://x/"), F.col("p_brand"), F.when(F.col("p_size") > 25, F.concat(F.lit("|"), F.col("p_size").cast("string"))).otherwise(""))
    return table(spark, d, "part").select(versions.canonical(c).alias("c")).groupBy("c.url", "c.version").agg(F.count("*").alias("n"))

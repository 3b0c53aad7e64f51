"""Queries over displays, supplements and the filters of kinds of systems, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import displays as ds
from tessera.operators import providers as pv
from tessera.plans.hierarchy_queries import CONCEPT, EDGE
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


@query(f"""WITH RECURSIVE {EDGE}, {CONCEPT}, c AS (SELECT code, NOT (code[1] = 'N' AND substring(code, 2)::INT % 3 = 0) AS kept FROM concept),
w AS (SELECT code, kept, [code] AS path, []::VARCHAR[] AS up FROM c WHERE code NOT IN (SELECT child FROM edge)
  UNION ALL SELECT c.code, c.kept, list_append(w.path, c.code), CASE WHEN w.kept THEN list_append(w.up, w.code) ELSE w.up END FROM w JOIN edge e ON e.parent = w.code JOIN c ON c.code = e.child)
SELECT code, up[len(up)] AS parent, len(up)::INTEGER AS depth, row_number() OVER (ORDER BY path)::INTEGER AS place FROM w WHERE kept""")
def expand_preorder(spark, d):
    """The whole system depth first; every third nation is abstract, its members go to the region."""
    kept = ~(F.startswith("code", F.lit("N")) & (F.substring("code", 2, 10).cast("int") % 3 == 0))
    return ds.preorder(t.edges(spark, d), t.concepts(spark, d), kept)


_NAMES = """d AS (SELECT source AS code, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN lang || '-CH' ELSE lang END AS lang, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'display' WHEN 2 THEN 'synonym' ELSE 'preferredForLanguage' END AS use,
  'name ' || (doc_id % 50) AS value, doc_id % 5 <> 0 AS active, doc_id AS ord FROM documents)"""


def _names(spark, d):
    k = F.col("doc_id")
    lang = F.when(k % 7 == 0, None).when(k % 3 == 0, F.concat("lang", F.lit("-CH"))).otherwise(F.col("lang"))
    use = F.when(k % 4 == 0, None).when(k % 4 == 1, "display").when(k % 4 == 2, "synonym").otherwise("preferredForLanguage")
    return table(spark, d, "documents").select(F.col("source").alias("code"), lang.alias("lang"), use.alias("use"), F.concat(F.lit("name "), _s(k % 50)).alias("value"), (k % 5 != 0).alias("active"), k.alias("ord"))


@query(f"WITH {_NAMES} SELECT code, lang, use, value, active, ord FROM d WHERE lang LIKE 'de%' OR use = 'synonym'")
def designations_wanted(spark, d):
    return ds.chosen_designations(_names(spark, d), ["de"], ["synonym"])


@query(f"WITH {_NAMES} SELECT code, lang, use, value, active, ord FROM d WHERE NOT (value = 'name 7' AND (use IS NULL OR use = 'display'))")
def designations_without_display(spark, d):
    n = _names(spark, d)
    return ds.without_display(n, n.select("code", F.lit("name 7").alias("display")).distinct())


@query(f"""WITH {_NAMES}, x AS (SELECT code, count(*) FILTER (lang IS NULL OR lang = 'fr-CH') AS a, count(*) FILTER (lang IS NULL OR lang IN ('fr', 'fr-CH')) AS c FROM d WHERE (use IS NULL OR use IN ('display', 'preferredForLanguage')) GROUP BY code)
SELECT code, CASE WHEN a > 0 THEN a ELSE c END AS n FROM x""")
def display_counts(spark, d):
    return ds.display_counts(_names(spark, d), ["fr-CH"])


@query(f"""WITH {_NAMES}, o AS (SELECT code, value, min(ord) AS ord FROM d WHERE active AND (use IS NULL OR use IN ('display', 'preferredForLanguage')) AND (lang IS NULL OR lang IN ('en', 'en-CH')) GROUP BY ALL),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY code ORDER BY ord) <= 5) SELECT code, string_agg(value, '|' ORDER BY ord) AS displays FROM f GROUP BY code""")
def allowed_displays(spark, d):
    return ds.allowed_displays(_names(spark, d), ["en"], most=5)


@query("""WITH p AS (SELECT 'P' || p_partkey AS code, p_brand AS brand, p_type AS type FROM part), o AS (SELECT code, 'brand' AS prop, brand AS value FROM p UNION SELECT code, 'type', type FROM p UNION SELECT code, 'size', p_size::VARCHAR FROM part JOIN p ON code = 'P' || p_partkey),
s AS (SELECT DISTINCT 'P' || l_partkey AS code, 'brand' AS prop, 'Brand#' || (l_suppkey % 9) AS value FROM lineitem)
SELECT code, prop, value, 'system' AS source FROM o UNION ALL SELECT code, prop, value, 'supplement' FROM s WHERE code IN (SELECT code FROM p) AND NOT EXISTS (SELECT 1 FROM o WHERE o.code = s.code AND o.prop = s.prop AND o.value = s.value)""")
def supplement_overlay(spark, d):
    """Properties that a supplement adds to the parts' own."""
    li = table(spark, d, "lineitem")
    more = li.select(F.concat(F.lit("P"), _s("l_partkey")).alias("code"), F.lit("brand").alias("prop"), F.concat(F.lit("Brand#"), _s(F.col("l_suppkey") % 9)).alias("value"))
    return ds.overlaid(t.properties(spark, d), more)


@query("""WITH s AS (SELECT 'P' || l_partkey AS code, arg_min(l_quantity::BIGINT::VARCHAR, l_orderkey * 10 + l_linenumber) AS w FROM lineitem GROUP BY 1)
SELECT 'P' || p_partkey AS code, TRY_CAST(CASE p_size % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'heavy' ELSE s.w END AS DECIMAL(20, 6)) AS weight FROM part LEFT JOIN s ON s.code = 'P' || p_partkey""")
def item_weights(spark, d):
    k = F.col("p_size") % 3
    own = table(spark, d, "part").select(F.concat(F.lit("P"), _s("p_partkey")).alias("code"), F.when(k == 0, _s("p_size")).when(k == 1, "heavy").alias("weight"))
    more = table(spark, d, "lineitem").select(F.concat(F.lit("P"), _s("l_partkey")).alias("code"), _s(F.col("l_quantity").cast("long")).alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return ds.weights(own, more)


@query("SELECT * FROM (VALUES ('brand', 'here:brand'), ('type', 'own:type'), ('size', NULL)) AS t(prop, uri)")
def property_uris(spark, d):
    declared = spark.sql("SELECT * FROM VALUES ('brand', 'own:brand'), ('type', 'own:type') AS t(prop, uri)")
    return ds.property_uris(t.properties(spark, d), declared, spark.sql("SELECT 'brand' AS prop, 'here:brand' AS uri"))


@query("SELECT p_type AS system, 'P' || p_partkey AS code FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 4")
def capped_by_system(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("system"), F.concat(F.lit("P"), _s("p_partkey")).alias("code"), "p_retailprice", "p_partkey")
    return ds.capped(p, "system", [F.desc("p_retailprice"), F.asc("p_partkey")], 4).select("system", "code")


@query("""SELECT doc_id AS id, CASE lang WHEN 'de' THEN 'allemand' WHEN 'en' THEN 'anglais' ELSE lang END || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' (Suisse)' ELSE ' (XX)' END AS name FROM documents""")
def translated_languages(spark, d):
    words = spark.sql("SELECT * FROM VALUES ('de', 'language', 'fr', 'allemand'), ('en', 'language', 'fr', 'anglais'), ('de', 'language', 'en', 'German'), ('CH', 'region', 'fr', 'Suisse') AS t(tag, kind, wanted, name)")
    k = F.col("doc_id") % 3
    return ds.translated(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(k == 1, "CH").when(k == 2, "XX").alias("region")), "fr", words)


@query("SELECT p_name AS display, max('P' || p_partkey) AS code FROM part GROUP BY 1 UNION ALL SELECT 'no such thing', NULL")
def codes_by_display(spark, d):
    p = t.parts(spark, d)
    return ds.by_display(p.select("display").unionByName(spark.sql("SELECT 'no such thing' AS display")), p)


@query("""SELECT p_partkey, regexp_full_match('Brand#' || (p_size % 30), 'Brand#1|Brand#2[0-9]') AS country, p_size % 4 = 2 AS currency, p_type = 'PROMO' AS area, p_type = 'PROMO' AND p_size % 2 = 0 AS vocabulary FROM part""")
def system_filters(spark, d):
    """One filter of each kind of system over the parts."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Brand#"), _s(F.col("p_size") % 30)).alias("code"), (F.col("p_size") % 4).alias("decimals"), F.col("p_type").alias("class"), F.col("p_type").alias("domain"), F.when(F.col("p_size") % 2 == 0, "S").otherwise("C").alias("standard"))
    f = [("country", "code", "regex", "Brand#1|Brand#2[0-9]"), ("currency", "decimals", "equals", "2"), ("area", "class", "=", "PROMO"), ("vocabulary", "domain", "=", "PROMO")]
    return p.select("p_partkey", *[pv.system_filter(*x).alias(x[0]) for x in f])


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'app' || page_id ELSE '' END AS type, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'json' ELSE '' END AS subtype, page_id % 3 < 2 AS valid,
  regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$') AS uri FROM pages""")
def media_types_and_uris(spark, d):
    k = F.col("page_id") % 3
    m = F.when(k == 0, " text/html; charset=utf-8").when(k == 1, F.concat(F.lit("app"), _s("page_id"), F.lit("/json"))).otherwise("/x/")
    return table(spark, d, "pages").select("page_id", pv.media_type(m).alias("m"), pv.is_uri(F.col("url")).alias("uri")).select("page_id", "m.type", "m.subtype", "m.valid", "uri")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'valueCode' WHEN 1 THEN 'valueInteger' END AS name, CASE event_type WHEN 'error' THEN false WHEN 'signup' THEN true END AS flag FROM events""")
def value_names(spark, d):
    k = F.col("event_id") % 3
    j = F.when(k == 0, '{"url": "x", "valueCode": "a"}').when(k == 1, F.concat(F.lit('{"valueInteger": '), _s("event_id"), F.lit("}"))).otherwise('{"value": 1}')
    b = F.when(F.col("event_type") == "error", " False").when(F.col("event_type") == "signup", "TRUE").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", pv.value_name(j).alias("name"), pv.as_boolean(b).alias("flag"))


@query("""SELECT l_returnflag, l_linestatus, l_returnflag = 'R' OR l_linestatus = 'F' AS inward, count(*) AS n FROM lineitem GROUP BY ALL""")
def inward_relations(spark, d):
    rela = F.when(F.col("l_linestatus") == "F", "old_has_ingredient_of").otherwise("isa")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", pv.is_inward(F.col("l_returnflag"), rela, ["R"], ["has_ingredient", "consists_of"]).alias("inward")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT 'P' || l_partkey AS code, l_partkey AS k FROM lineitem UNION SELECT 'none', NULL) SELECT code, p_name AS display, CASE WHEN p_name IS NOT NULL THEN p_size % 2 = 1 END AS archived FROM w LEFT JOIN part ON p_partkey = k""")
def located_with_archive(spark, d):
    """Parts of even size are current, the others archived."""
    p, even = t.parts(spark, d), F.col("size") % 2 == 0
    wanted = table(spark, d, "lineitem").select(F.concat(F.lit("P"), _s("l_partkey")).alias("code")).unionByName(spark.sql("SELECT 'none' AS code"))
    return pv.located(wanted, p.filter(even), p.filter(~even))


@query("""WITH n AS (SELECT 'P' || l_partkey AS code, bool_or(l_linenumber % 7 = 1 AND l_returnflag <> 'R') AS s FROM lineitem GROUP BY 1), a AS (SELECT 'P' || p_partkey AS code FROM part WHERE p_size = 7)
SELECT coalesce(n.code, a.code) AS code, coalesce(s, true) AS inactive FROM n FULL JOIN a ON n.code = a.code""")
def suppressed_codes(spark, d):
    li = table(spark, d, "lineitem")
    names = li.select(F.concat(F.lit("P"), _s("l_partkey")).alias("code"), F.when(F.col("l_returnflag") == "R", "SY").otherwise("IN").alias("kind"), _s((F.col("l_linenumber") % 7 == 1).cast("int")).alias("suppress"))
    return pv.suppressed(names, t.parts(spark, d).filter("size = 7"))


@query("""SELECT 'P' || p_partkey AS code FROM part WHERE p_type <> 'LARGE' AND contains(' ' || p_name || ' ', ' red ') AND contains(' ' || p_name || ' ', ' rod ')""")
def names_with_stems(spark, d):
    p = t.parts(spark, d)
    return pv.with_every_stem(p, p.select("code", F.explode(F.split("display", " ")).alias("stem")), ["red", "rod"], F.col("type") != "LARGE")


@query("""SELECT DISTINCT 'O' || l_orderkey AS code, CASE l_returnflag WHEN 'R' THEN 'returns' ELSE 'has part' END AS kind, 'P' || l_partkey AS target, p_name AS target_display FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'A'""")
def related_concepts(spark, d):
    kinds = spark.sql("SELECT * FROM VALUES ('part-R', 'returns'), ('part-N', 'has part') AS t(kind_id, kind)")
    rel = t.relationships(spark, d).select(F.col("source").alias("code"), F.col("rel").alias("kind_id"), "target").distinct()
    return pv.related(t.parts(spark, d), rel, kinds)


@query("""WITH r AS (SELECT 'P' || p_partkey || '-' || (p_size % 3) AS code, p_partkey AS k, 'box of ' || p_name AS descr FROM part UNION ALL SELECT 'P' || p_partkey, p_partkey, p_name FROM part)
SELECT code, descr AS description, p_name AS name, p_brand AS organisation, CASE p_type WHEN 'PROMO' THEN 'promotion' WHEN 'SMALL' THEN 'small' END AS kind, p_size % 2 = 0 AS active FROM r JOIN part ON p_partkey = k""")
def drug_details(spark, d):
    p = table(spark, d, "part").withColumn("code", F.concat(F.lit("P"), _s("p_partkey")))
    org = pv.lookup_table(p, "p_brand", "org_id", "organisation")
    products = p.select("code", F.col("p_name").alias("name"), F.xxhash64("p_brand").alias("org_id"), F.col("p_type").alias("kind_id"), (F.col("p_size") % 2 == 0).alias("active"))
    packages = p.select(F.concat("code", F.lit("-"), _s(F.col("p_size") % 3)).alias("code"), F.col("code").alias("product"), F.concat(F.lit("box of "), "p_name").alias("description"))
    return pv.drug_details(products, packages, org, spark.sql("SELECT * FROM VALUES ('PROMO', 'promotion'), ('SMALL', 'small') AS t(kind_id, kind)"))


@query("""SELECT DISTINCT 'P' || p_partkey AS code, CASE l_linenumber % 2 WHEN 0 THEN p_name ELSE lower(p_brand) END AS name, CASE l_returnflag WHEN 'R' THEN 'de' ELSE 'en' END AS lang FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A' AND l_linenumber % 2 = 1""")
def vocabulary_synonyms(spark, d):
    p = t.parts(spark, d)
    li = table(spark, d, "lineitem").select(F.concat(F.lit("P"), _s("l_partkey")).alias("code"), (F.col("l_linenumber") % 2).alias("k"), F.col("l_returnflag").alias("lang_code"))
    names = li.join(p, "code").select("code", F.when(F.col("k") == 0, F.col("display")).otherwise(F.lower("brand")).alias("name"), "lang_code")
    return pv.synonyms(p, names, spark.sql("SELECT * FROM VALUES ('R', 'de'), ('N', 'en') AS t(lang_code, lang)"))

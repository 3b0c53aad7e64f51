"""Queries through whole value-set definitions, stems and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import stemming, text, units
from tessera.plans.expansion import Clause, CodeSystem, Filter, ValueSet, expand
from tessera.plans.hierarchy_queries import CLOSURE
from tessera.session import table
from tessera.sources import terminology as t

Q, SQL = {}, {}

SETS = {
    "buyers": ValueSet((Clause(filters=(Filter("concept", "descendent-of", "R1"), Filter("segment", "in", "BUILDING, MACHINERY"))), Clause(codes=("N3", "N4", "N99")))),
    "leaves": ValueSet((Clause(filters=(Filter("concept", "descendent-leaf", "R1"),)), Clause(filters=(Filter("concept", "regex", "S[0-9]"),)))),
    "both": ValueSet((Clause(imports=("buyers", "leaves")), Clause(filters=(Filter("concept", "child-of", "R2"),))), (Clause(filters=(Filter("segment", "=", "MACHINERY"),)),)),
}


def _system(spark, d) -> CodeSystem:
    c = t.concepts(spark, d)
    props = c.filter("segment IS NOT NULL").select("code", F.lit("segment").alias("prop"), F.col("segment").alias("value"))
    return CodeSystem(c, t.edges(spark, d), props)


def expand_definition(spark, d):
    """A set that imports two others, adds children of R2, and leaves one segment out."""
    return expand("both", SETS, _system(spark, d))


SQL["expand_definition"] = CLOSURE + """, below AS (SELECT descendant AS code FROM closure WHERE ancestor = 'R1'),
buyers AS (SELECT code FROM concept WHERE code IN (FROM below) AND segment IN ('BUILDING', 'MACHINERY') OR code IN ('N3', 'N4', 'N99')),
leaves AS (SELECT code FROM concept WHERE code IN (FROM below) AND code NOT IN (SELECT parent FROM edge) OR regexp_full_match(code, 'S[0-9]')),
x AS (SELECT code, 0 AS o FROM buyers WHERE code IN (FROM leaves) UNION ALL SELECT child, 1 FROM edge WHERE parent = 'R2')
SELECT code, min(o)::INTEGER AS clause_ord FROM x WHERE code NOT IN (SELECT code FROM concept WHERE segment = 'MACHINERY') GROUP BY code"""


def stem_search(spark, d):
    """Documents with a word whose stem a stem of the search starts (no SQL: stems)."""
    docs = table(spark, d, "documents")
    words = docs.select(F.col("doc_id").alias("key"), F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))
    return stemming.search(stemming.stem_index(words), "licensing versions")


def unit_conversion(spark, d):
    k = F.col("l_linenumber") % 4
    li = table(spark, d, "lineitem")
    src = F.when(k == 0, "mg/dL").when(k == 1, "kg").when(k == 2, "[in_i]").otherwise("wrong")
    dst = F.when(k == 0, "g/L").when(k == 1, "[lb_av]").when(k == 2, "cm").otherwise("m")
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return units.converted(li.select(key.alias("id"), F.col("l_quantity").alias("value"), src.alias("source"), dst.alias("target"))).select("id", "source", F.round("result", 6).alias("result"))


SQL["unit_conversion"] = """SELECT l_orderkey * 100 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN 'mg/dL' WHEN 1 THEN 'kg' WHEN 2 THEN '[in_i]' ELSE 'wrong' END AS source,
  round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity / 100 WHEN 1 THEN l_quantity * 1000 / 453.59237 WHEN 2 THEN l_quantity * 2.54 END, 6) AS result FROM lineitem"""
Q |= {"expand_definition": expand_definition, "stem_search": stem_search, "unit_conversion": unit_conversion}

"""JSON resources as tables: code systems with nested concepts, value sets, concept maps, and packages of files.

A resource is one JSON text a row. Nested concepts are opened level by level with variants, so depth costs rounds, not recursion.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import settled


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of a folder's files, one whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, json) of the JSON files in gzipped tar packages. A package is opened in one task; packages are small."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                    for m in tar:
                        if m.isfile() and m.name.startswith("package/") and m.name.endswith(".json"):
                            rows.append((p, m.name, tar.extractfile(m).read().decode("utf-8")))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "name", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(opened, "path string, name string, json string")


def concepts(resources: DataFrame) -> DataFrame:
    """(system, version, code, display, definition, parent_code, depth, ord, node) of code systems; ord is the place among siblings, node the concept as a variant."""
    v = resources.select(F.try_parse_json("json").alias("v")).filter(F.try_variant_get("v", "$.resourceType", "string") == "CodeSystem")
    level = v.select(
        F.try_variant_get("v", "$.url", "string").alias("system"), F.try_variant_get("v", "$.version", "string").alias("version"),
        F.lit(None).cast("string").alias("parent_code"), F.posexplode(F.try_variant_get("v", "$.concept", "array<variant>")).alias("ord", "node"),
    )
    out, depth = None, 0
    while True:
        level = settled(level.withColumn("code", F.try_variant_get("node", "$.code", "string")))
        if out is not None and not level.take(1):
            return out
        rows = level.select("system", "version", "code", F.try_variant_get("node", "$.display", "string").alias("display"), F.try_variant_get("node", "$.definition", "string").alias("definition"), "parent_code", F.lit(depth).alias("depth"), "ord", "node")
        out = rows if out is None else out.unionByName(rows)
        depth += 1
        level = level.select("system", "version", F.col("code").alias("parent_code"), F.posexplode(F.try_variant_get("node", "$.concept", "array<variant>")).alias("ord", "node"))


def concept_edges(rows: DataFrame) -> DataFrame:
    """(system, parent, child) by nesting and by parent and child properties."""
    nested = rows.filter("parent_code IS NOT NULL").select("system", F.col("parent_code").alias("parent"), F.col("code").alias("child"))
    p = concept_properties(rows)
    up = p.filter("prop = 'parent'").select("system", F.col("value").alias("parent"), F.col("code").alias("child"))
    down = p.filter("prop = 'child'").select("system", F.col("code").alias("parent"), F.col("value").alias("child"))
    return nested.unionByName(up).unionByName(down).distinct()


def concept_properties(rows: DataFrame) -> DataFrame:
    """(system, code, prop, value): a property's value as text, whatever its type; codings give their code."""
    p = rows.select("system", "code", F.explode(F.try_variant_get("node", "$.property", "array<variant>")).alias("p"))
    value = F.coalesce(*[F.try_variant_get("p", f"$.value{k}", "string") for k in ("Code", "String", "Integer", "Boolean", "Decimal", "DateTime")], F.try_variant_get("p", "$.valueCoding.code", "string"))
    return p.select("system", "code", F.try_variant_get("p", "$.code", "string").alias("prop"), value.alias("value"))


def concept_designations(rows: DataFrame) -> DataFrame:
    """(system, code, lang, use, value, ord)."""
    x = rows.select("system", "code", F.posexplode(F.try_variant_get("node", "$.designation", "array<variant>")).alias("ord", "x"))
    return x.select("system", "code", F.try_variant_get("x", "$.language", "string").alias("lang"), F.try_variant_get("x", "$.use.code", "string").alias("use"), F.try_variant_get("x", "$.value", "string").alias("value"), "ord")


def value_set_clauses(resources: DataFrame) -> DataFrame:
    """(url, version, kind, clause_ord, system, system_version, concepts, filters, imports) of value sets' includes and excludes."""
    v = resources.select(F.try_parse_json("json").alias("v")).filter(F.try_variant_get("v", "$.resourceType", "string") == "ValueSet")
    get = lambda path, kind: F.try_variant_get("c", path, kind)
    out = None
    for kind in ("include", "exclude"):
        c = v.select(F.try_variant_get("v", "$.url", "string").alias("url"), F.try_variant_get("v", "$.version", "string").alias("version"), F.lit(kind).alias("kind"), F.posexplode(F.try_variant_get("v", f"$.compose.{kind}", "array<variant>")).alias("clause_ord", "c"))
        rows = c.select(
            "url", "version", "kind", "clause_ord", get("$.system", "string").alias("system"), get("$.version", "string").alias("system_version"),
            F.transform(get("$.concept", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, "$.code", "string").alias("code"), F.try_variant_get(x, "$.display", "string").alias("display"))).alias("concepts"),
            F.transform(get("$.filter", "array<variant>"), lambda x: F.struct(F.try_variant_get(x, "$.property", "string").alias("property"), F.try_variant_get(x, "$.op", "string").alias("op"), F.try_variant_get(x, "$.value", "string").alias("value"))).alias("filters"),
            get("$.valueSet", "array<string>").alias("imports"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def map_rows(resources: DataFrame) -> DataFrame:
    """(map, source, target, source_code, target_code, relationship) of concept maps."""
    from tessera.operators.maps import relationship

    v = resources.select(F.try_parse_json("json").alias("v")).filter(F.try_variant_get("v", "$.resourceType", "string") == "ConceptMap")
    g = v.select(F.try_variant_get("v", "$.url", "string").alias("map"), F.explode(F.try_variant_get("v", "$.group", "array<variant>")).alias("g"))
    e = g.select("map", F.try_variant_get("g", "$.source", "string").alias("source"), F.try_variant_get("g", "$.target", "string").alias("target"), F.explode(F.try_variant_get("g", "$.element", "array<variant>")).alias("e"))
    t = e.select("map", "source", "target", F.try_variant_get("e", "$.code", "string").alias("source_code"), F.explode(F.try_variant_get("e", "$.target", "array<variant>")).alias("t"))
    kind = F.coalesce(F.try_variant_get("t", "$.relationship", "string"), F.try_variant_get("t", "$.equivalence", "string"))
    return t.select("map", "source", "target", "source_code", F.try_variant_get("t", "$.code", "string").alias("target_code"), F.when(kind.isin("source-is-narrower-than-target", "source-is-broader-than-target", "not-related-to"), kind).otherwise(relationship(kind)).alias("relationship"))


def mappings(resources: DataFrame) -> DataFrame:
    """(map, source_scope, target_scope, group_ord, source, target, element_ord, source_code, target_ord, target_code, relationship, equivalence, comment, products) of concept maps.

    Nothing is normalised. ``map`` is url|version; products are (property, system, value). An element without targets gives no row.
    """
    text = lambda v, path: F.try_variant_get(v, f"$.{path}", "string")
    many = lambda v, path: F.posexplode(F.try_variant_get(v, f"$.{path}", "array<variant>"))
    v = resources.select(F.try_parse_json("json").alias("v")).filter(text("v", "resourceType") == "ConceptMap")
    scope = lambda side: F.coalesce(text("v", f"{side}ScopeUri"), text("v", f"{side}ScopeCanonical")).alias(f"{side}_scope")
    head = ["map", "source_scope", "target_scope"]
    g = v.select(F.concat_ws("|", text("v", "url"), text("v", "version")).alias("map"), scope("source"), scope("target"), many("v", "group").alias("group_ord", "g"))
    head += ["group_ord", "source", "target"]
    e = g.withColumns({"source": text("g", "source"), "target": text("g", "target")}).select(*head, many("g", "element").alias("element_ord", "e"))
    head += ["element_ord", "source_code"]
    t = e.withColumn("source_code", text("e", "code")).select(*head, many("e", "target").alias("target_ord", "t"))
    product = lambda x: F.struct(text(x, "property").alias("property"), text(x, "system").alias("system"), text(x, "value").alias("value"))
    return t.select(
        *head, "target_ord", text("t", "code").alias("target_code"), text("t", "relationship").alias("relationship"), text("t", "equivalence").alias("equivalence"),
        text("t", "comment").alias("comment"), F.transform(F.try_variant_get("t", "$.product", "array<variant>"), product).alias("products"),
    )


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """Rows as CSV with a header, JSON lines or Parquet."""
    w = df.write.mode("overwrite")
    {"csv": lambda: w.csv(path, header=True, escape='"'), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[kind]()


def as_json(value) -> str:
    """A resource given as Python data, as the readers above take it."""
    return json.dumps(value)


def content_index(resources: DataFrame) -> DataFrame:
    """(path, type, id, url, version) of every JSON resource, read once; what isn't a resource is left out."""
    v = resources.select("path", F.try_parse_json("json").alias("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    return v.select("path", get("resourceType").alias("type"), get("id").alias("id"), get("url").alias("url"), get("version").alias("version")).filter("type IS NOT NULL")


def server_metadata(statements: DataFrame) -> DataFrame:
    """(server, system, version) of servers' terminology statements in JSON (server, json): each code system with each version that it lists, null if it lists none."""
    v = statements.select("server", F.try_parse_json("json").alias("v"))
    s = v.select("server", F.explode(F.try_variant_get("v", "$.codeSystem", "array<variant>")).alias("s"))
    code = F.transform(F.try_variant_get("s", "$.version", "array<variant>"), lambda x: F.try_variant_get(x, "$.code", "string"))
    return s.select("server", F.try_variant_get("s", "$.uri", "string").alias("system"), F.explode_outer(code).alias("version")).filter("system IS NOT NULL").distinct()


def locked(resources: DataFrame) -> DataFrame:
    """(url, version, locked_date) of the value sets whose definition is locked to a date, which can't be expanded."""
    v = resources.select(F.try_parse_json("json").alias("v")).filter(F.try_variant_get("v", "$.resourceType", "string") == "ValueSet")
    get = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    return v.select(get("url").alias("url"), get("version").alias("version"), get("compose.lockedDate").alias("locked_date")).filter(F.coalesce("locked_date", F.lit("")) != "")

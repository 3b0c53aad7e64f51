"""The relational tables read as code systems, relationships, maps and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def _code(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(parent, child): regions, nations, and customers and suppliers below them."""
    n, c, s = table(spark, d, "nation"), table(spark, d, "customer"), table(spark, d, "supplier")
    return (
        n.select(_code("R", "n_regionkey").alias("parent"), _code("N", "n_nationkey").alias("child"))
        .unionByName(c.select(_code("N", "c_nationkey").alias("parent"), _code("C", "c_custkey").alias("child")))
        .unionByName(s.select(_code("N", "s_nationkey").alias("parent"), _code("S", "s_suppkey").alias("child")))
    )


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """(code, display, kind, segment, balance) of the same code system; segment and balance are properties of some."""
    none = lambda t: F.lit(None).cast(t)
    r, n, c, s = (table(spark, d, x) for x in ("region", "nation", "customer", "supplier"))
    row = lambda code, display, kind, segment, balance: [code.alias("code"), F.col(display).alias("display"), F.lit(kind).alias("kind"), segment.alias("segment"), balance.alias("balance")]
    return (
        r.select(*row(_code("R", "r_regionkey"), "r_name", "region", none("string"), none("double")))
        .unionByName(n.select(*row(_code("N", "n_nationkey"), "n_name", "nation", none("string"), none("double"))))
        .unionByName(c.select(*row(_code("C", "c_custkey"), "c_name", "customer", F.col("c_mktsegment"), F.col("c_acctbal"))))
        .unionByName(s.select(*row(_code("S", "s_suppkey"), "s_name", "supplier", none("string"), F.col("s_acctbal"))))
    )


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(code, display, brand, type, size, price): a flat code system."""
    p = table(spark, d, "part")
    return p.select(_code("P", "p_partkey").alias("code"), F.col("p_name").alias("display"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


def properties(spark: SparkSession, d: str) -> DataFrame:
    """(code, prop, value) rows of the flat code system."""
    p = parts(spark, d)
    return p.select("code", F.explode(F.create_map(*[x for k in ("brand", "type", "size") for x in (F.lit(k), F.col(k).cast("string"))])).alias("prop", "value"))


def poly_edges(spark: SparkSession, d: str) -> DataFrame:
    """(parent, child): each part below its brand and its type."""
    p = parts(spark, d)
    return p.select(F.explode(F.array("brand", "type")).alias("parent"), F.col("code").alias("child"))


def relationships(spark: SparkSession, d: str) -> DataFrame:
    """(source, rel, target, grp): order lines as grouped relationships from orders to parts and suppliers."""
    li = table(spark, d, "lineitem")
    base = [_code("O", "l_orderkey").alias("source"), F.col("l_linenumber").alias("grp")]
    return li.select(*base, F.concat(F.lit("part-"), F.col("l_returnflag")).alias("rel"), _code("P", "l_partkey").alias("target")).unionByName(
        li.select(*base, F.concat(F.lit("supplier-"), F.col("l_linestatus")).alias("rel"), _code("S", "l_suppkey").alias("target"))
    )


def refset_members(spark: SparkSession, d: str) -> DataFrame:
    """(refset, code): orders by priority, customers by segment."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.select(F.col("o_orderpriority").alias("refset"), _code("O", "o_orderkey").alias("code")).unionByName(c.select(F.col("c_mktsegment").alias("refset"), _code("C", "c_custkey").alias("code")))


def map_rows(spark: SparkSession, d: str) -> DataFrame:
    """(map, source_code, target_code, relationship): nations to regions, parts to brands, suppliers to nations."""
    n, p, s = table(spark, d, "nation"), table(spark, d, "part"), table(spark, d, "supplier")
    row = lambda df, name, a, b, r: df.select(F.lit(name).alias("map"), a.alias("source_code"), b.alias("target_code"), r.alias("relationship"))
    return (
        row(n, "nation-region", _code("N", "n_nationkey"), _code("R", "n_regionkey"), F.lit("source-is-narrower-than-target"))
        .unionByName(row(p, "part-brand", _code("P", "p_partkey"), F.col("p_brand"), F.when(F.col("p_size") > 25, "equivalent").otherwise("related-to")))
        .unionByName(row(s, "supplier-nation", _code("S", "s_suppkey"), _code("N", "s_nationkey"), F.when(F.col("s_acctbal") < 0, "not-related-to").otherwise("equivalent")))
    )


def designations(spark: SparkSession, d: str) -> DataFrame:
    """(code, lang, value, status, ord): documents as names of their source, inactive where the quality label is 0."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 0, "retired").otherwise("active")
    return docs.join(labels, "doc_id", "left").select(F.col("source").alias("code"), "lang", F.col("text").alias("value"), status.alias("status"), F.col("doc_id").alias("ord"))


def versioned_concepts(spark: SparkSession, d: str) -> DataFrame:
    """(system, version, code, display): part types as systems in three versions, each with some of 40 codes."""
    p = table(spark, d, "part")
    version = F.element_at(F.array(F.lit("1.0.0"), F.lit("1.1.0"), F.lit("2.0.0")), (F.col("p_size") % 3 + 1).cast("int"))
    code = F.concat(F.lit("P"), (F.col("p_partkey") % 40).cast("string"))
    return p.groupBy(F.lower("p_type").alias("system"), version.alias("version"), code.alias("code")).agg(F.min("p_name").alias("display"))


def versioned_edges(spark: SparkSession, d: str) -> DataFrame:
    """(system, parent, child): each of the 40 codes of those systems below the code of a third of its number."""
    n = table(spark, d, "part").select(F.lower("p_type").alias("system")).distinct().select("system", F.explode(F.sequence(F.lit(1), F.lit(39))).alias("n"))
    code = lambda k: F.concat(F.lit("P"), k.cast("string"))
    return n.select("system", code(F.floor(F.col("n") / 3)).alias("parent"), code(F.col("n")).alias("child"))

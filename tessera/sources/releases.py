"""Readers of terminology release files into the normal tables: concept, designation, edge, relationship, property, membership.

All are Spark's CSV reader with the release's dialect, all columns text, and projections; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ndc_code11, repaired_date
from tessera.session import settled

# Identifiers of the clinical release format (is-a relationship, synonym and full name types, defining characteristics).
IS_A, FULL_NAME = "116680003", "900000000000003001"
DEFINING = ["900000000000011006", "900000000000006009"]


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, quotes taken literally."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated file with a header, quotes doubled within quotes, values over several lines allowed."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)


def rrf(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A pipe-separated file without header, each line ending in a pipe."""
    df = spark.read.csv(path, sep="|", header=False, quote="", escape="", inferSchema=False)
    return df.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)])


# --- clinical release, snapshot files


def rf2_concepts(df: DataFrame) -> DataFrame:
    """(code, active, module, primitive)."""
    return df.select(F.col("id").alias("code"), (F.col("active") == "1").alias("active"), F.col("moduleId").alias("module"), (F.col("definitionStatusId") == "900000000000074008").alias("primitive"))


def rf2_descriptions(df: DataFrame) -> DataFrame:
    """(code, lang, value, full_name, active, ord): ord is the description's number, the stored order."""
    return df.select(F.col("conceptId").alias("code"), F.col("languageCode").alias("lang"), F.col("term").alias("value"), (F.col("typeId") == FULL_NAME).alias("full_name"), (F.col("active") == "1").alias("active"), F.col("id").cast("long").alias("ord"))


def rf2_relationships(df: DataFrame) -> DataFrame:
    """(source, rel, target, grp, defining, active); a concrete value's target is its text."""
    target = F.col("destinationId") if "destinationId" in df.columns else F.col("value")
    return df.select(F.col("sourceId").alias("source"), F.col("typeId").alias("rel"), target.alias("target"), F.col("relationshipGroup").cast("int").alias("grp"), F.col("characteristicTypeId").isin(DEFINING).alias("defining"), (F.col("active") == "1").alias("active"))


def rf2_edges(rels: DataFrame) -> DataFrame:
    """(parent, child) of active defining is-a relationships."""
    return rels.filter((F.col("rel") == IS_A) & F.col("active") & F.col("defining")).select(F.col("target").alias("parent"), F.col("source").alias("child"))


def rf2_members(df: DataFrame, file_name: str) -> DataFrame:
    """(refset, code, values): active members; the letters before ``Refset`` in a file's name (c concept, i number, s text) name its extra columns."""
    import re

    m = re.search(r"_([cis]*)Refset_", file_name)
    n = len(m[1]) if m else 0
    extra = df.columns[6 : 6 + n]
    return df.filter("active = '1'").select(F.col("refsetId").alias("refset"), F.col("referencedComponentId").alias("code"), (F.array(*[F.col(c) for c in extra]) if extra else F.array().cast("array<string>")).alias("values"))


# --- observation codes


def code_properties(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(code, prop, value): the named columns as property rows, empty ones left out."""
    pairs = F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])))
    return df.select(F.col(key).alias("code"), pairs.alias("prop", "value")).filter("value IS NOT NULL AND value <> ''")


def path_closure(df: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of a hierarchy file with PATH_TO_ROOT and CODE."""
    from tessera.operators.hierarchy import closure_from_paths

    return closure_from_paths(df.select(F.col("CODE").alias("code"), F.col("PATH_TO_ROOT").alias("path")))


def answers(df: DataFrame) -> DataFrame:
    """(source, rel, target): answers of lists, each once."""
    return df.filter("AnswerStringId IS NOT NULL").select(F.col("AnswerListId").alias("source"), F.lit("Answer").alias("rel"), F.col("AnswerStringId").alias("target")).distinct()


def part_links(df: DataFrame, codes: DataFrame, parts: DataFrame) -> DataFrame:
    """(source, rel, target): links whose two codes are both known."""
    links = df.select(F.col("LoincNumber").alias("source"), F.col("PartTypeName").alias("rel"), F.col("PartNumber").alias("target")).distinct()
    return links.join(codes.select(F.col("code").alias("source")), "source", "left_semi").join(parts.select(F.col("code").alias("target")), "target", "left_semi").select("source", "rel", "target")


def language_variant(df: DataFrame, lang: str) -> DataFrame:
    """(code, lang, kind, value) of a variant file."""
    names = [c for c in ("LONG_COMMON_NAME", "SHORTNAME", "LinguisticVariantDisplayName") if c in df.columns]
    return code_properties(df, "LOINC_NUM", names).select("code", F.lit(lang).alias("lang"), F.col("prop").alias("kind"), "value")


# --- drug products


def drug_products(df: DataFrame, version: str) -> DataFrame:
    """(version, id, code, trade, generic, active, start, end): an exclude flag of Y, N or none is active, others aren't."""
    flag = F.coalesce("NDC_EXCLUDE_FLAG", F.lit(""))
    return df.select(F.lit(version).alias("version"), F.col("PRODUCTID").alias("id"), F.col("PRODUCTNDC").alias("code"), F.col("PROPRIETARYNAME").alias("trade"), F.col("NONPROPRIETARYNAME").alias("generic"), flag.isin("Y", "N", "").alias("active"), repaired_date(F.col("STARTMARKETINGDATE")).alias("start"), repaired_date(F.col("ENDMARKETINGDATE")).alias("end"))


def drug_packages(df: DataFrame, products: DataFrame) -> DataFrame:
    """(code, code11, product, description) of packages whose product is known."""
    p = df.select(F.col("NDCPACKAGECODE").alias("code"), ndc_code11(F.col("NDCPACKAGECODE")).alias("code11"), F.col("PRODUCTID").alias("product"), F.col("PACKAGEDESCRIPTION").alias("description"))
    return p.join(products.select(F.col("id").alias("product")).distinct(), "product", "left_semi").select("code", "code11", "product", "description")


def latest_products(versions: DataFrame) -> DataFrame:
    """One row for each code: the newest version's."""
    rest = [c for c in versions.columns if c != "code"]
    return versions.groupBy("code").agg(F.max_by(F.struct(*rest), F.struct("version", "id")).alias("b")).select("code", *[f"b.{c}" for c in rest])


def substances(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Substances (code, display) and their names (code, value, type). A code's display is the least one given for it, as files have no stable order."""
    names = df.select(F.col("UNII").alias("code"), F.col("Name").alias("value"), F.col("TYPE").alias("type"), F.col("Display Name").alias("display"))
    return names.groupBy("code").agg(F.min("display").alias("display")), names.select("code", "value", "type")


def answer_set(url: str, concepts: DataFrame, answers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(code) of what an address ``.../vs`` or ``.../vs/code`` of the laboratory system names: all codes, an answer list's answers (list, code), or what is below a part in the closure."""
    _, slash, name = url.partition("/vs")[2].partition("/")
    if not slash:
        return concepts.select("code").distinct()
    listed = answers.filter(F.col("list") == name).select("code")
    below = pairs.filter(F.col("ancestor") == name).select(F.col("descendant").alias("code"))
    return listed.unionByName(below).distinct()


def vocabulary_map(concepts: DataFrame, relations: DataFrame, source: str, target: str) -> DataFrame:
    """(source_code, target_code, relationship) of the map between two vocabularies: "Maps to" rows between concepts (id, code, vocabulary), which are equivalences."""
    side = lambda v, i, c: concepts.filter(F.col("vocabulary") == v).select(F.col("id").alias(i), F.col("code").alias(c))
    r = relations.filter(F.col("kind") == "Maps to").select("id_1", "id_2")
    out = r.join(side(source, "id_1", "source_code"), "id_1").join(side(target, "id_2", "target_code"), "id_2")
    return out.select("source_code", "target_code", F.lit("equivalent").alias("relationship")).distinct()


#: Headers in the text of the older classification: a group by its range in brackets, a concept by its code at the start of a line.
GROUP_LINE = r"^(?:[IVXLCDM]+\.\s+)?(.*?)\s+\(([A-Z]?\d{1,3}-[A-Z]?\d{1,3})\)$"
CODE_LINE = r"^([A-Z]?\d{2,3}(?:\.\d+)?)\s+(\S.*)"
SECTION_LINE = r"(?i)^(?:(include)s?:|(exclude)s?:|(note):)\s*(.*)$"
RANGE = r"^[A-Z]?(\d+)-[A-Z]?(\d+)$"


def classification_text(texts: DataFrame) -> DataFrame:
    """(path, ord, code, display, is_group, parent_code, description, includes, excludes, note) of the older classification's whole texts (path, text).

    A line that is no header goes on with the concept before it, in the section that was named last; lines before the first header go. A code's
    parent is the longest code before it that it continues, else the narrowest range before it that holds its number, letters aside (the first
    of equals); a range's is the narrowest other one around it. A null or empty text gives nothing. A text is one release file and is split in one task.
    """
    lines = texts.select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "\\s+", " "))).filter("line <> ''")
    group, code = F.col("line").rlike(GROUP_LINE), F.col("raw").rlike(CODE_LINE)
    pick = lambda i: F.when(group, F.regexp_extract("line", GROUP_LINE, 3 - i)).when(code, F.regexp_extract(F.rtrim("raw"), CODE_LINE, i))
    lines = lines.withColumns({"code": pick(1), "display": F.trim(F.regexp_replace(pick(2), "\\s+", " ")), "is_group": group, "named": F.when(F.col("line").rlike(SECTION_LINE), F.lower(F.regexp_replace("line", r"(?i)^(include|exclude|note).*$", "$1")))})
    so_far = Window.partitionBy("path").orderBy("n")
    lines = lines.withColumn("ord", F.count("code").over(so_far)).filter("ord > 0")
    in_block = Window.partitionBy("path", "ord").orderBy("n")
    lines = lines.withColumn("section", F.coalesce(F.last(F.when(F.col("code").isNull(), F.col("named")), True).over(in_block), F.lit("description")))
    said = F.when(F.col("code").isNull(), F.nullif(F.when(F.col("named").isNotNull(), F.regexp_extract("line", SECTION_LINE, 4)).otherwise(F.col("line")), F.lit("")))
    part = lambda name: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == name) & said.isNotNull(), F.struct("n", said.alias("s"))))), lambda x: x["s"]), " "), F.lit(""))
    head = lambda c: F.max(F.when(F.col("code").isNotNull(), F.col(c))).alias(c)
    rows = lines.groupBy("path", "ord").agg(head("code"), head("display"), head("is_group"), part("description").alias("description"), part("include").alias("includes"), part("exclude").alias("excludes"), part("note").alias("note"))
    rows = settled(rows)

    first = rows.groupBy("path", "code").agg(F.min("ord").alias("at"))
    dot = F.instr("code", ".")
    longer = rows.filter(dot > 0).select("path", "ord", F.explode(F.expr("transform(sequence(instr(code, '.') - 1, length(code) - 1), k -> substring(code, 1, k))")).alias("up"))
    by_code = longer.join(first.withColumnRenamed("code", "up"), ["path", "up"]).filter("at < ord").groupBy("path", "ord").agg(F.max_by("up", F.length("up")).alias("by_code"))

    ends = lambda df: df.withColumns({"lo": F.regexp_extract("code", RANGE, 1).cast("int"), "hi": F.regexp_extract("code", RANGE, 2).cast("int")})
    ranges = ends(first.filter(F.col("code").rlike(RANGE))).filter("lo <= hi")
    around = ranges.select("path", F.col("code").alias("up"), "at", "hi", (F.col("hi") - F.col("lo")).alias("span"), F.explode(F.sequence("lo", "hi")).alias("lo")).withColumnRenamed("hi", "up_hi")
    number = F.regexp_extract("code", r"^[A-Z]?(\d+)", 1).cast("int")
    wanted = ends(rows.filter(F.col("code").rlike(RANGE))).select("path", "ord", "code", "lo", "hi").unionByName(rows.filter(~F.col("code").rlike(RANGE)).select("path", "ord", "code", number.alias("lo"), number.alias("hi")))
    by_range = wanted.join(around, ["path", "lo"]).filter("at < ord AND hi <= up_hi AND up <> code").groupBy("path", "ord").agg(F.min_by("up", F.struct("span", "at")).alias("by_range"))
    out = rows.join(by_code, ["path", "ord"], "left").join(by_range, ["path", "ord"], "left")
    return out.select("path", "ord", "code", "display", "is_group", F.coalesce("by_code", "by_range").alias("parent_code"), "description", "includes", "excludes", "note")

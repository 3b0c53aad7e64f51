"""License statements in documents, with DataFrame functions only.

A text's words become shingles of five words (a template of fewer words has one shingle of all of them).
Templates fall into classes by size: a class of size c holds templates of more than c/2 and up to c
shingles, and its windows are runs of 2c shingles that start at every c-th, so each occurrence of a
template lies whole in a window, and their similarity is over 1/4. ``BANDS`` MinHash bands of one row find such a
pair with probability over 1 - 0.75**64 = 1 - 1e-8; a window that holds just 0.8 of a template's shingles is found with over 1 - 2e-6.
What the bands retrieve is verified by the share of the template's shingles that the window holds.

Windows that share no shingle with any template can't hold one, so they go before the bands are
taken; that loses nothing. The templates are a small table given by the caller, and Spark's own size check decides how it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

WIDTH, BANDS = 5, 64
CONTAINMENT = 0.8
_BREAK = "[^\\p{L}\\p{N}]+"

# Statements by which licenses are commonly given.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0-sentence", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
]


def words_of(col: Column) -> Column:
    """Lowered runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col), _BREAK), "")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row: a one-element explode keeps the optimiser from inlining it where it is used for each element of an array."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_shingles(df: DataFrame, width: int, out: str) -> DataFrame:
    """Adds the hashes of a text's runs of ``width`` words, from the words' own hashes in ``_hashed``."""
    n = F.size("_hashed") - (width - 1)
    run = F.transform(F.slice("_hashed", 1, F.greatest(n, F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get("_hashed", i + k) for k in range(1, width)]))
    return settled(df, out, run)


def hashed(df: DataFrame, text: Column) -> DataFrame:
    return settled(df, "_hashed", F.transform(words_of(text), lambda w: F.xxhash64(w)))


def minhashes(shingles: Column) -> Column:
    """The least hash of a set of shingles under each of ``BANDS`` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def windows_of(shingles: str, width: int, size: int, wanted: Column) -> Column:
    """The windows of a class that share a shingle with its templates: (width, size, start, distinct shingles)."""
    col = F.col(shingles)
    starts = F.when(F.size(col) > 0, F.sequence(F.lit(0), F.size(col) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(F.lit(width).alias("width"), F.lit(size).alias("size"), s.alias("start"), F.array_distinct(F.slice(col, s + 1, F.lit(2 * size))).alias("sh")))
    return F.filter(cut, lambda x: F.arrays_overlap(x["sh"], wanted))


def prepared(templates: DataFrame) -> DataFrame:
    """(template_id, width, size, sh): the templates' distinct shingles, and their class. Templates without a word go."""
    t = hashed(templates.select("template_id", "text"), text_of("text"))
    t = t.withColumn("width", F.least(F.size("_hashed"), F.lit(WIDTH))).filter("width > 0")
    per = F.array()
    for w in range(1, WIDTH + 1):
        t = with_shingles(t, w, f"_s{w}")
        per = F.when(F.col("width") == w, F.col(f"_s{w}")).otherwise(per) if w > 1 else F.col("_s1")
    t = t.withColumn("sh", F.array_distinct(per))
    return t.withColumn("size", F.pow(F.lit(2), F.ceil(F.log2(F.size("sh")))).cast("int")).select("template_id", "width", "size", "sh")


def scan(df: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template_id, containment, first_shingle, n_windows) of each document and template that it holds.

    ``containment`` is the largest share of the template's shingles in one window, ``first_shingle`` where the first window of at
    least ``least`` starts, ``n_windows`` the number of these. The templates' widths, sizes and shingles are read once on the
    driver to shape the windows: they are as many as the caller's templates. Null and empty texts and texts shorter than a
    template hold nothing; rows of one id are one document (a null id too); other columns are not read; no rows, no result.
    """
    known = prepared(templates)
    shapes: dict[tuple[int, int], set[int]] = {}
    for r in known.collect():
        shapes.setdefault((r["width"], r["size"]), set()).update(r["sh"])
    docs = hashed(df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), F.col("text")).drop("text")
    widths = sorted({w for w, _ in shapes})
    for w in widths:
        docs = with_shingles(docs, w, f"_s{w}")
    docs = docs.drop("_hashed")
    wanted = {w: F.array(*[F.lit(h) for h in sorted(set().union(*(s for (v, _), s in shapes.items() if v == w)))]) for w in widths}
    hit = F.lit(False)
    for w in widths:
        hit = hit | F.arrays_overlap(F.col(f"_s{w}"), wanted[w])
    docs = docs.filter(hit)
    windows = F.array().cast("array<struct<width:int,size:int,start:int,sh:array<bigint>>>")
    for (w, c), shingles in sorted(shapes.items()):
        windows = F.concat(windows, windows_of(f"_s{w}", w, c, F.array(*[F.lit(h) for h in sorted(shingles)])))
    found = docs.select("doc_id", F.explode(windows).alias("x")).select("doc_id", "x.*")
    banded = found.withColumn("bands", minhashes(F.col("sh"))).select("doc_id", "width", "size", "start", F.col("sh").alias("window"), F.posexplode("bands").alias("band", "least"))
    sought = known.withColumn("bands", minhashes(F.col("sh"))).select("template_id", "width", "size", "sh", F.posexplode("bands").alias("band", "least"))
    on = ["width", "size", "band", "least"]
    pairs = banded.join(sought, on).groupBy("doc_id", "template_id", "start").agg(F.first(F.size(F.array_intersect("window", "sh")) / F.size("sh")).alias("containment"))
    kept = pairs.filter(F.col("containment") >= least)
    return kept.groupBy("doc_id", "template_id").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_shingle"), F.count("*").alias("n_windows"))


def standard_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "template_id string, text string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), standard_templates(spark))


_VALUES = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
_SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE = {
    "op8_license_scan": f"""
WITH t AS (SELECT template_id, {_SPLIT.format("text")} AS w FROM (VALUES {_VALUES}) v(template_id, text)),
t2 AS (SELECT template_id, w, least(len(w), {WIDTH}) AS width FROM t WHERE len(w) > 0),
ts AS (SELECT DISTINCT template_id, width, array_to_string(w[i:i + width - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM t2)),
tc AS (SELECT template_id, width, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS size FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT doc_id, width, i - 1 AS p, array_to_string(w[i:i + width - 1], ' ') AS s
       FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM tc))),
m AS (SELECT ds.doc_id, ts.template_id, tc.n, tc.size, ds.p, ds.s FROM ds JOIN ts USING (width, s) JOIN tc USING (template_id)),
k AS (SELECT *, p // size AS k FROM m UNION ALL SELECT *, p // size - 1 AS k FROM m WHERE p >= size),
c AS (SELECT doc_id, template_id, k * size AS start, count(DISTINCT s) / n AS containment FROM k GROUP BY doc_id, template_id, k, size, n)
SELECT doc_id, template_id, max(containment)::DOUBLE AS containment, min(start)::BIGINT AS first_shingle, count(*) AS n_windows
FROM c WHERE containment >= {CONTAINMENT} GROUP BY doc_id, template_id"""
}

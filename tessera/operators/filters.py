"""Property, relationship and text filters over code systems."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Back-references and look-around in a pattern.
LOOKS_BACK = r"\\[1-9]|\(\?[=!<]"


def has_property(props: DataFrame, prop: str, test: Column) -> DataFrame:
    """Codes with a value of ``prop`` for which ``test`` (over ``value``) holds; equality, lists, anchored patterns and existence are such tests."""
    return props.filter((F.col("prop") == prop) & test).select("code").distinct()


def matches(value: str, pattern: str) -> Column:
    """Whole-value match. Back-references and look-around are refused, as linear-time engines do."""
    if re.search(LOOKS_BACK, pattern):
        raise ValueError("back-references and look-around are not supported")
    return F.col(value).rlike(f"^(?:{pattern})$")


def property_not_in(codes: DataFrame, props: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """Codes with none of the values; a code without any property at all doesn't count."""
    some = props.select("code").distinct()
    return codes.select("code").join(some, "code", "left_semi").join(has_property(props, prop, F.col("value").isin(values)), "code", "left_anti")


def related_to(rels: DataFrame, rel: str, targets: DataFrame) -> DataFrame:
    """Sources with a relationship of this type to one of the target codes."""
    return rels.filter(F.col("rel") == rel).join(targets.select(F.col("code").alias("target")), "target", "left_semi").select(F.col("source").alias("code")).distinct()


def rating(code: Column, display: Column, definition: Column, text: str) -> Column:
    """How well a concept matches a search text, null for no match: exact, prefix, contained in code, display or definition."""
    t = text.lower()
    c, d, x = F.lower(code), F.lower(display), F.lower(definition)
    return (
        F.when((c == t) | (d == t), 100).when(c.startswith(t), 90).when(d.startswith(t), 80)
        .when(c.contains(t), 60).when(d.contains(t), 50).when(x.contains(t), 30)
    )


def search_words(docs: DataFrame, words: list[str], every: bool) -> DataFrame:
    """(doc_id, n_hits): texts in which any, or every, word of a search is the start of some word."""
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+"))).alias("token"))
    hits = reduce_or([F.col("token").startswith(w.lower()) for w in words])
    found = tokens.filter(hits).groupBy("doc_id").agg(*[F.max(F.col("token").startswith(w.lower()).cast("int")).alias(f"h{i}") for i, w in enumerate(words)])
    n = sum((F.col(f"h{i}") for i in range(len(words))), F.lit(0))
    out = found.select("doc_id", n.alias("n_hits"))
    return out.filter(F.col("n_hits") == len(words)) if every else out


def reduce_or(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def property_of(props: DataFrame, prop: str, codes: DataFrame) -> DataFrame:
    """Codes whose property has one of the given codes as its value; these may come from any other filters."""
    return props.filter(F.col("prop") == prop).join(codes.select(F.col("code").alias("value")).distinct(), "value", "left_semi").select("code").distinct()


def property_values(props: DataFrame, prop: str, codes: DataFrame) -> DataFrame:
    """The values, as codes, that a property has on the given codes."""
    return props.filter(F.col("prop") == prop).join(codes.select("code").distinct(), "code", "left_semi").select(F.col("value").alias("code")).distinct()

"""Languages, dates, codes and other small text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def language_part(tag: Column, name: str) -> Column:
    """A part of a language tag (language, script, region), null if it has none."""
    pattern = {"language": r"^([A-Za-z]{2,3})(?:-|$)", "script": r"^[A-Za-z]{2,3}-([A-Za-z]{4})(?:-|$)", "region": r"-([A-Za-z]{2}|\d{3})(?:-|$)"}[name]
    return F.nullif(F.regexp_extract(tag, pattern, 1), F.lit(""))


def language_match(tag: Column, wanted: str) -> Column:
    """3: the same tag, 2: same language and region, 1: same language or any wanted, 0: none."""
    want = F.lit(wanted)
    lang, region = language_part(tag, "language"), language_part(tag, "region")
    return (
        F.when(F.lower(tag) == wanted.lower(), 3)
        .when((lang == language_part(want, "language")) & (region == language_part(want, "region")), 2)
        .when((lang == language_part(want, "language")) | F.lit(wanted == "*"), 1)
        .otherwise(0)
    )


def display_difference(a: Column, b: Column) -> Column:
    """same, case, space (after white space is made equal), or other."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(a == b, "same").when(F.lower(a) == F.lower(b), "case").when(F.lower(tidy(a)) == F.lower(tidy(b)), "space").otherwise("other")


def ndc_code11(code: Column) -> Column:
    """A dashed drug code of three parts padded to 5-4-2 digits, any other without its dashes padded to 11; longer parts stay, null and empty give an empty text."""
    padded = lambda x, n: F.when(F.length(x) >= n, x).otherwise(F.lpad(x, n, "0"))
    p = F.split(code, "-")
    three = F.concat(*[padded(F.get(p, k), n) for k, n in enumerate((5, 4, 2))])
    return F.when(F.coalesce(code, F.lit("")) == "", "").when(F.size(p) == 3, three).otherwise(padded(F.replace(code, F.lit("-"), F.lit("")), 11))


def repaired_date(value: Column) -> Column:
    """A yyyyMMdd text as a date, with the known wrong years put right; anything else is null."""
    # Years mistyped in published releases, and what they stand for.
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "^2388", "2018"), "^3030", "2020"), "^3031", "2031")
    return F.when(fixed.rlike(r"^\d{8}$"), F.try_to_timestamp(fixed, F.lit("yyyyMMdd")).cast("date"))


def words(text: Column) -> Column:
    """Words for an index: lowered, longer than two letters, starting with a letter."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: (F.length(w) > 2) & w.rlike("^[a-z]"))


def language_preferences(header: Column) -> Column:
    """An Accept-Language text as an array of (tag, q), best first, equal ones in their order; a q that can't be read counts 1."""
    parts = F.filter(F.transform(F.split(header, ","), lambda p: F.trim(p)), lambda p: p != "")
    read = F.transform(parts, lambda p, i: F.struct((-F.coalesce(F.regexp_extract(p, r";\s*q\s*=\s*([0-9.]+)", 1).try_cast("double"), F.lit(1.0))).alias("k"), i.alias("i"), F.trim(F.split(p, ";")[0]).alias("tag")))
    return F.transform(F.array_sort(read), lambda x: F.struct(x["tag"].alias("tag"), (-x["k"]).alias("q")))


def drug_code_kind(code: Column) -> Column:
    """11-digit, 10-digit (three dashed parts), product (two), or other."""
    return F.when(code.rlike(r"^\d{11}$"), "11-digit").when(code.rlike(r"^\d+-\d+-\d+$"), "10-digit").when(code.rlike(r"^\d+-\d+$"), "product").otherwise("other")


def modified_code(expression: Column) -> Column:
    """``code:mod:mod`` as (code, modifiers, ok): ok if the code isn't empty and no modifier is empty or repeated."""
    p = F.split(expression, ":")
    mods = F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    ok = (p[0] != "") & ~F.array_contains(mods, "") & (F.size(F.array_distinct(mods)) == F.size(mods))
    return F.struct(p[0].alias("code"), mods.alias("modifiers"), ok.alias("ok"))


def flag(value: Column, default: bool = False) -> Column:
    """A text as a boolean: only ``true`` in lower case is true; null and empty texts give the default."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(value == "true")

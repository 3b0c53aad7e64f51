"""Version strings as Columns: parsing, order keys, and the matching rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEMVER = r"^v?(\d+)(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+([0-9A-Za-z.-]+))?$"


def part(version: Column, k: int) -> Column:
    """Part ``k`` (1 major, 2 minor, 3 patch, 4 label, 5 build) of a semantic version, null if it has none."""
    return F.nullif(F.regexp_extract(version, _SEMVER, k), F.lit(""))


def number(version: Column, k: int) -> Column:
    """A numeric part; a missing one counts as 0, a wildcard is null."""
    p = part(version, k)
    return F.when(p.isNull(), 0).otherwise(p.try_cast("int"))


def semver_key(version: Column) -> Column:
    """A struct that orders semantic versions: numbers, then a release after its labelled forms."""
    label = part(version, 4)
    return F.struct(number(version, 1).alias("major"), number(version, 2).alias("minor"), number(version, 3).alias("patch"), label.isNull().alias("release"), F.coalesce(label, F.lit("")).alias("label"))


def kind(version: Column) -> Column:
    """integer, date, semver or natural, by the look of the string."""
    return (
        F.when(version.rlike(r"^\d{8}$") | version.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), "date")
        .when(version.rlike(r"^\d+$"), "integer")
        .when(version.rlike(_SEMVER), "semver")
        .otherwise("natural")
    )


def major_minor(version: Column) -> Column:
    """``2.1.3-beta`` to ``2.1``."""
    return F.concat_ws(".", part(version, 1), F.coalesce(part(version, 2), F.lit("0")))


def matches(version: Column, pattern: Column) -> Column:
    """Whether a version fits a pattern whose parts may be x, X or * (any), or that ends in ? (this start)."""
    same = lambda k: part(pattern, k).isNull() | F.lower(part(pattern, k)).isin("x", "*") | (part(version, k) == part(pattern, k))
    start = F.startswith(version, F.rtrim(pattern, F.lit("?")))
    return F.coalesce(F.when(pattern.endswith("?"), start).otherwise(same(1) & same(2) & same(3) & (part(version, 4).eqNullSafe(part(pattern, 4)))), F.lit(False))


def canonical(value: Column) -> Column:
    """``url|version`` as a struct, cut at the last pipe; no version gives null."""
    has = F.instr(value, "|") > 0
    return F.struct(F.when(has, F.regexp_extract(value, r"^(.*)\|[^|]*$", 1)).otherwise(value).alias("url"), F.when(has, F.nullif(F.regexp_extract(value, r"\|([^|]*)$", 1), F.lit(""))).alias("version"))


# Names of specification releases and their versions.
RELEASES = {"R2": "1.0.2", "DSTU2": "1.0.2", "R2B": "1.4.0", "R3": "3.0.2", "STU3": "3.0.2", "R4": "4.0.1", "R4B": "4.3.0", "R5": "5.0.0", "R6": "6.0.0-cibuild"}
SPECIFICATION = "http://hl7.org/fhir/"


def release_version(name: Column) -> Column:
    """A release name in any case, or a specification's address that starts with one, as its version; other texts stay, empty ones are null."""
    bare = F.when(F.startswith(name, F.lit(SPECIFICATION)), F.split(F.substring(name, len(SPECIFICATION) + 1, 1 << 30), "/")[0]).otherwise(name)
    known = F.create_map(*[F.lit(x) for kv in RELEASES.items() for x in kv])
    return F.nullif(F.coalesce(F.try_element_at(known, F.upper(bare)), bare), F.lit(""))


def this_or_later(criteria: Column, candidate: Column, precision: str = "full") -> Column:
    """Whether the candidate is the criteria's version or a later one, told to the major, minor or patch part or in full.

    A wildcard or a missing part of the criteria lets anything from there on through; a part that only the criteria have, nothing. In full, a labelled
    version comes before its release. Null where either isn't a semantic version.
    """
    want, have = release_version(criteria), release_version(candidate)
    w, h = [], []
    for k in range(1, {"major": 1, "minor": 2, "patch": 3, "full": 3}[precision] + 1):
        mine, asked = F.coalesce(part(have, k).try_cast("int"), F.lit(-1)), part(want, k)
        wild = F.when(mine < 0, 0).otherwise(-1)
        h.append(mine.alias(f"p{k}"))
        w.append(F.when(asked.isNull(), -1).otherwise(F.coalesce(asked.try_cast("int"), wild)).alias(f"p{k}"))
    if precision == "full":
        for version, parts in ((want, w), (have, h)):
            parts += [part(version, 4).isNull().alias("release"), F.coalesce(part(version, 4), F.lit("")).alias("label")]
    return F.when(part(want, 1).isNotNull() & part(have, 1).isNotNull(), F.struct(*h) >= F.struct(*w))


def date_digits(value: Column) -> Column:
    """A date without its time and dashes, so that dates of every length compare as texts."""
    return F.replace(F.split(value, "T")[0], F.lit("-"), F.lit(""))


def canonical_matches(value: Column, pattern: Column) -> Column:
    """Whether ``url|version`` fits a pattern: the same url, and the pattern's version if it has one."""
    return fits(canonical(value), canonical(pattern))


def fits(v: Column, p: Column) -> Column:
    """``canonical_matches`` of what ``canonical`` gave for a value and a pattern."""
    return F.coalesce((v["url"] == p["url"]) & (p["version"].isNull() | (v["version"] == p["version"]) | matches(v["version"], p["version"])), F.lit(False))

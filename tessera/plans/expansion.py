"""Value-set definitions to one plan: clauses with code lists, filters and imports, evaluated over a code system's tables.

Definitions are small and read on the driver; codes never are. Filters of a clause and its imports all have to hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters as fl
from tessera.operators import hierarchy as h
from tessera.operators import valuesets as vs


@dataclass(frozen=True)
class Filter:
    prop: str
    op: str
    value: str = ""


@dataclass(frozen=True)
class Clause:
    codes: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    imports: tuple[str, ...] = ()


@dataclass(frozen=True)
class ValueSet:
    includes: tuple[Clause, ...]
    excludes: tuple[Clause, ...] = ()
    keep_inactive: bool = True


@dataclass
class CodeSystem:
    """Tables of a system: concepts (code, display, ...), edges, properties (code, prop, value), and the inactive codes if any."""

    concepts: DataFrame
    edges: DataFrame
    props: DataFrame
    inactive: DataFrame | None = None

    def filtered(self, f: Filter) -> DataFrame:
        """The codes that one filter keeps; an operator that isn't known is an error."""
        words = [x.strip() for x in f.value.split(",")]
        if f.prop in ("concept", "code"):
            match f.op:
                case "is-a":
                    return h.below(self.edges, f.value, True, self.concepts)
                case "descendent-of":
                    return h.below(self.edges, f.value)
                case "is-not-a":
                    return h.outside(self.edges, self.concepts, f.value)
                case "child-of":
                    return h.children(self.edges, f.value)
                case "generalizes":
                    return h.walk(self.edges, f.value, up=True)
                case "descendent-leaf":
                    return h.below(self.edges, f.value).join(h.leaves(self.edges, self.concepts), "code", "left_semi")
                case "in" | "=":
                    return self.concepts.select("code").filter(F.col("code").isin(words if f.op == "in" else [f.value]))
                case "regex":
                    return self.concepts.select("code").filter(fl.matches("code", f.value))
                case "exists":
                    return self.concepts.select("code")
        elif f.prop == "child" and f.op == "exists":
            parents = self.edges.select(F.col("parent").alias("code"))
            return self.concepts.select("code").join(parents, "code", "left_semi" if f.value != "false" else "left_anti")
        else:
            match f.op:
                case "=":
                    return fl.has_property(self.props, f.prop, F.col("value") == f.value)
                case "in":
                    return fl.has_property(self.props, f.prop, F.col("value").isin(words))
                case "not-in":
                    return fl.property_not_in(self.concepts, self.props, f.prop, words)
                case "regex":
                    return fl.has_property(self.props, f.prop, fl.matches("value", f.value))
                case "exists":
                    some = fl.has_property(self.props, f.prop, F.lit(True))
                    return some if f.value != "false" else self.concepts.select("code").join(some, "code", "left_anti")
        raise ValueError(f"filter {f.prop} {f.op} is not supported")


def expand(name: str, sets: dict[str, ValueSet], system: CodeSystem, _open: tuple[str, ...] = ()) -> DataFrame:
    """(code, clause_ord) of a named set: the first clause that gave a code; excludes win. Sets that import themselves are an error."""
    if name in _open:
        raise ValueError(f"value set {name} imports itself: {' > '.join((*_open, name))}")
    if name not in sets:
        raise KeyError(f"value set {name} is not known")
    vset = sets[name]

    def clause(c: Clause) -> DataFrame:
        parts = []
        if c.codes:
            parts.append(system.concepts.select("code").filter(F.col("code").isin(list(c.codes))))
        parts += [system.filtered(f) for f in c.filters]
        parts += [expand(i, sets, system, (*_open, name)).select("code") for i in c.imports]
        if not parts:
            parts = [system.concepts.select("code")]
        return reduce(lambda a, b: a.join(b.select("code").distinct(), "code", "left_semi"), parts)

    gone = None if vset.keep_inactive else system.inactive
    return vs.expand([clause(c) for c in vset.includes], [clause(c) for c in vset.excludes], inactive=gone)


def fits(version: str, wanted: str) -> bool:
    """Whether a version has the wanted one's parts; a part x or * is any, and parts that aren't wanted may be anything."""
    have, want = version.split("."), wanted.split(".")
    return len(have) >= len(want) and all(w in ("x", "X", "*") or w == v for w, v in zip(want, have, strict=False))


def resolved_version(stated: str | None, override: str | None = None, default: str | None = None, check: str | None = None) -> tuple[str | None, str | None]:
    """The version to use for a system, and a complaint or None: override before stated before default before check; a stated version that the check doesn't fit is complained about."""
    version = override or stated or default or check
    if check and version and not fits(version, check):
        return version, f"version {version} does not fit {check}"
    return version, None

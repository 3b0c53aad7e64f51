"""Unit conversion over a table of units: exact factors to base units, read once for each distinct text of a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decimal and binary prefixes, base units, and other units as a number of a unit text; the metric ones take prefixes.
PREFIXES = {"Y": 24, "Z": 21, "E": 18, "P": 15, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "da": 1, "d": -1, "c": -2, "m": -3, "u": -6, "n": -9, "p": -12, "f": -15, "a": -18, "z": -21, "y": -24}
BINARY = {"Ki": 10, "Mi": 20, "Gi": 30, "Ti": 40}
BASE = ["m", "s", "g", "rad", "K", "C", "cd"]
UNITS = {
    "mol": ("602214076000000000000000", "1"), "sr": ("1", "rad2"), "Hz": ("1", "s-1"), "N": ("1", "kg.m/s2"), "Pa": ("1", "N/m2"), "J": ("1", "N.m"), "W": ("1", "J/s"), "A": ("1", "C/s"), "V": ("1", "J/C"),
    "F": ("1", "C/V"), "Ohm": ("1", "V/A"), "S": ("1", "Ohm-1"), "Wb": ("1", "V.s"), "T": ("1", "Wb/m2"), "H": ("1", "Wb/A"), "lm": ("1", "cd.sr"), "lx": ("1", "lm/m2"), "Bq": ("1", "s-1"), "Gy": ("1", "J/kg"), "Sv": ("1", "J/kg"),
    "L": ("1", "dm3"), "l": ("1", "dm3"), "ar": ("100", "m2"), "t": ("1000", "kg"), "bar": ("100000", "Pa"), "min": ("60", "s"), "h": ("60", "min"), "d": ("24", "h"), "wk": ("7", "d"),
    "a_j": ("1461/4", "d"), "a": ("1461/4", "d"), "mo_j": ("1/12", "a_j"), "mo": ("1/12", "a_j"), "eV": ("1602176634/10000000000000000000000000000", "J"), "dyn": ("1", "g.cm/s2"), "erg": ("1", "dyn.cm"), "P": ("1", "dyn.s/cm2"),
    "Ci": ("37000000000", "Bq"), "RAD": ("100", "erg/g"), "REM": ("100", "erg/g"), "G": ("1/10000", "T"), "Mx": ("1/100000000", "Wb"), "cal_th": ("523/125", "J"), "cal": ("523/125", "J"), "[Cal]": ("1", "kcal_th"),
    "atm": ("101325", "Pa"), "m[H2O]": ("980665/100", "Pa"), "m[Hg]": ("133322", "Pa"), "[g]": ("980665/100000", "m/s2"), "eq": ("1", "mol"), "osm": ("1", "mol"), "kat": ("1", "mol/s"), "U": ("1", "umol/min"), "g%": ("1", "g/dL"),
    "[in_i]": ("127/50", "cm"), "[ft_i]": ("12", "[in_i]"), "[yd_i]": ("3", "[ft_i]"), "[mi_i]": ("5280", "[ft_i]"), "[nmi_i]": ("1852", "m"), "[kn_i]": ("1", "[nmi_i]/h"), "[gal_us]": ("231", "[in_i]3"), "[qt_us]": ("1/4", "[gal_us]"),
    "[pt_us]": ("1/2", "[qt_us]"), "[cup_us]": ("1/2", "[pt_us]"), "[foz_us]": ("1/8", "[cup_us]"), "[tbs_us]": ("1/2", "[foz_us]"), "[tsp_us]": ("1/3", "[tbs_us]"), "[gr]": ("6479891/100000", "mg"), "[lb_av]": ("7000", "[gr]"),
    "[oz_av]": ("1/16", "[lb_av]"), "[dr_av]": ("1/16", "[oz_av]"), "[ston_av]": ("2000", "[lb_av]"), "[lbf_av]": ("1", "[lb_av].[g]"), "[psi]": ("1", "[lbf_av]/[in_i]2"), "[degR]": ("5/9", "K"), "[pi]": ("3141592653589793238462643383279/1000000000000000000000000000000", "1"),
    "deg": ("1/180", "[pi].rad"), "'": ("1/60", "deg"), "''": ("1/60", "'"), "10*": ("10", "1"), "10^": ("10", "1"), "%": ("1/100", "1"), "[ppth]": ("1/1000", "1"), "[ppm]": ("1/1000000", "1"), "[ppb]": ("1/1000000000", "1"),
    "[pptr]": ("1/1000000000000", "1"), "bit": ("1", "1"), "By": ("8", "bit"),
}
#: Units of agreed effect: each measures nothing but itself.
ARBITRARY = ["[iU]", "[IU]", "[arb'U]", "[USP'U]", "[CFU]", "[PFU]", "[FFU]", "[CCID_50]", "[TCID_50]", "[EID_50]"]
METRIC = {*BASE, "mol", "sr", "Hz", "N", "Pa", "J", "W", "A", "V", "F", "Ohm", "S", "Wb", "T", "H", "lm", "lx", "Bq", "Gy", "Sv", "L", "l", "ar", "t", "bar", "eV", "dyn", "erg", "P", "Ci", "RAD", "REM", "G", "Mx", "cal", "cal_th", "m[H2O]", "m[Hg]", "eq", "osm", "kat", "U", "g%", "[iU]", "[IU]", "bit", "By"}


@lru_cache(maxsize=1024)
def _symbol(name: str) -> tuple[Fraction, tuple]:
    """A unit without an exponent, with or without a prefix, as its factor and its powers of base units."""
    if name in BASE or name in ARBITRARY:
        return Fraction(1), ((name, 1),)
    if name in UNITS:
        size, of = UNITS[name]
        factor, powers = _product(_tokens(of))
        return Fraction(size) * factor, tuple(powers.items())
    for p in sorted((*PREFIXES, *BINARY), key=len, reverse=True):
        if name.startswith(p) and name[len(p) :] in METRIC:
            factor, powers = _symbol(name[len(p) :])
            return factor * (Fraction(2) ** BINARY[p] if p in BINARY else Fraction(10) ** PREFIXES[p]), powers
    raise ValueError(f"the unit {name} is not known")


def _tokens(unit: str) -> list[str]:
    tokens = re.findall(r"\{[^{}]*\}|[./()]|[^./(){}\s]+", unit)
    if "".join(tokens) != unit:
        raise ValueError(f"the unit {unit} is not well formed")
    return tokens


def _component(tokens: list[str]) -> tuple[Fraction, dict]:
    """The next unit, number, annotation or bracket; it is taken from the list."""
    t = tokens.pop(0) if tokens else ""
    if t == "(":
        out = _product(tokens)
        if not tokens or tokens.pop(0) != ")":
            raise ValueError("a bracket is not closed")
        return out
    if t.startswith("{"):
        return Fraction(1), {}
    m = re.fullmatch(r"(\d+)|(.*[^\d+-])([+-]?\d{1,3})?", t) if t not in ("", ".", "/", ")") else None
    if m is None:
        raise ValueError(f"a unit is missing at {t}" if t in ("", ".", "/", ")") else f"the unit {t} is not known")
    if tokens and tokens[0].startswith("{"):
        tokens.pop(0)
    if m[1]:
        return Fraction(int(m[1])), {}
    (factor, powers), n = _symbol(m[2]), int(m[3] or 1)
    return factor**n, {b: k * n for b, k in powers}


def _product(tokens: list[str]) -> tuple[Fraction, dict]:
    """Units from the left, up to the end or a closing bracket; a division holds for the next one only."""
    factor, powers, sign = Fraction(1), {}, 1
    if tokens and tokens[0] == "/":
        tokens.pop(0)
        sign = -1
    while True:
        f, p = _component(tokens)
        factor *= f**sign
        for b, k in p.items():
            powers[b] = powers.get(b, 0) + sign * k
        if not tokens or tokens[0] == ")":
            return factor, powers
        op = tokens.pop(0)
        if op not in (".", "/"):
            raise ValueError(f"an operator is missing before {op}")
        sign = 1 if op == "." else -1


def _reduced(unit: str) -> tuple[Fraction, str]:
    tokens = _tokens(unit)
    try:
        factor, powers = _product(tokens)
    except (ZeroDivisionError, RecursionError):
        raise ValueError(f"the unit {unit} has no value") from None
    if tokens:
        raise ValueError("a bracket is not opened")
    return factor, " ".join(f"{b}{n}" for b, n in sorted(powers.items()) if n)


def reduced(unit: str) -> tuple[Fraction, str] | None:
    """A unit text such as ``mg/dL``, ``kg.m/s2`` or ``10*3/uL{cells}`` as its factor and its base units in order; None if it isn't known."""
    try:
        return _reduced(unit)
    except ValueError:
        return None


# Units of temperature whose zero isn't absolute: kelvins a degree, and the zero in kelvins.
OFFSETS = {"Cel": ("1", "5463/20"), "[degF]": ("5/9", "45967/180"), "[degRe]": ("5/4", "5463/20")}


def zero_shift(unit: str) -> tuple[Fraction, Fraction] | None:
    """Kelvins a degree and the zero's kelvins of a unit of temperature, kelvin too; None for other units."""
    if unit in OFFSETS:
        return Fraction(OFFSETS[unit][0]), Fraction(OFFSETS[unit][1])
    r = reduced(unit) if unit else None
    return (r[0], Fraction(0)) if r and r[1] == "K1" else None


def temperature(value: Column, source: str, target: str) -> Column:
    """A temperature in another unit; units that don't measure one are an error."""
    a, b = zero_shift(source), zero_shift(target)
    if a is None or b is None:
        raise ValueError(f"no temperatures: {source}, {target}")
    return value * float(a[0] / b[0]) + float((a[1] - b[1]) / b[0])


def fault(unit: str | None) -> str | None:
    """What is wrong with a unit text, or None."""
    if not unit:
        return "the unit is empty"
    try:
        return None if unit in OFFSETS else _reduced(unit) and None
    except ValueError as e:
        return str(e)


def search(text: str, regex: bool = False) -> list[str]:
    """The table's units whose text contains, or fits, what is sought, in order."""
    return sorted(u for u in (*BASE, *UNITS, *ARBITRARY, *OFFSETS) if (re.search(text, u) if regex else text.lower() in u.lower()))


@lru_cache(maxsize=1 << 16)
def _measure(unit: str) -> tuple[float, float, str] | None:
    """``reduced`` as two doubles and the base units; None too if the factor is beyond a double."""
    r = reduced(unit)
    return (float(r[0].numerator), float(r[0].denominator), r[1]) if r and max(r[0].numerator, r[0].denominator) < 10**300 else None


def measured(unit: Column) -> Column:
    """A unit text as a struct (num, den, base); null for unknown ones. Rows stay where they are, so a unit that most rows have makes no large task; a batch reads each of its texts once."""

    @F.arrow_udf("struct<num double, den double, base string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            a = a.dictionary_encode()
            rows = [_measure(u) if u else None for u in a.dictionary.to_pylist()]
            cols = [pa.array([r and r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string()))]
            each = pa.StructArray.from_arrays(cols, names=["num", "den", "base"], mask=pa.array([r is None for r in rows], pa.bool_()))
            yield each.take(a.indices)

    return read(unit)


def converted(rows: DataFrame) -> DataFrame:
    """rows (id, value, source, target) with ``result``: null if a unit isn't known or the two don't measure the same."""
    out = rows.withColumns({"s_": measured(F.col("source")), "t_": measured(F.col("target"))})
    result = F.when(F.col("s_.base") == F.col("t_.base"), F.col("value") * F.col("s_.num") * F.col("t_.den") / (F.col("s_.den") * F.col("t_.num")))
    return out.select("id", "value", "source", "target", result.alias("result"))


def measures_same(rows: DataFrame, canonical: str) -> DataFrame:
    """(id) of rows (id, unit) whose unit reduces to the same base units as the canonical one."""
    r = reduced(canonical)

    @F.arrow_udf("boolean")
    def same(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            a = a.dictionary_encode()
            found = [_measure(u) if u else None for u in a.dictionary.to_pylist()]
            yield pa.array([bool(f and r and f[2] == r[1]) for f in found], pa.bool_()).take(a.indices)

    return rows.filter(same("unit")).select("id")


def faults(rows: DataFrame) -> DataFrame:
    """(unit, fault) of the distinct texts of a ``unit`` column, null included; a null fault is a unit that is known."""

    @F.arrow_udf("string")
    def check(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([fault(u) for u in a.to_pylist()], pa.string())

    return rows.select("unit").distinct().withColumn("fault", check("unit"))

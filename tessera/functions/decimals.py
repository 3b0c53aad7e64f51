"""Decimal numbers as texts, calculated exactly, with the number of digits that a result can claim."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Digits of a whole quotient of whole numbers: as many as one wants.
UNBOUNDED = 100
#: Exponents beyond this are refused, and quotients are tried for so many more digits than their operands have.
LARGEST_EXPONENT, MORE_DIGITS = 400, 40


def number(text: str | None) -> tuple[Decimal, int] | None:
    """A text's value and its digits, without leading zeros (of a zero all that are written); None if it isn't a decimal number."""
    m = re.fullmatch(r"-?(\d*)(?:\.(\d+))?(?:[eE]([+-]?\d{1,6}))?", text or "")
    if m is None or not (m[1] or m[2]) or abs(int(m[3] or 0)) > LARGEST_EXPONENT:
        return None
    written = m[1] + (m[2] or "")
    significant = len(written.lstrip("0"))
    return Decimal(text), significant or max(1, len(m[1].lstrip("0") + (m[2] or "")))


def _whole(x: Decimal) -> bool:
    return x.as_tuple().exponent >= 0


def _plain(x: Decimal, least: int = 0) -> str:
    """Without an exponent, and without zeros at the end of a fraction as long as more than ``least`` digits stay."""
    t = format(x, "f")
    while "." in t and t.endswith("0") and len(t.replace(".", "").lstrip("-0")) > least:
        t = t[:-1]
    return t.removesuffix(".")


def calculated(a: str | None, op: str | None, b: str | None) -> tuple[str, int] | None:
    """The result of ``+ - * /`` and its digits; None if a text is no number, the operator is another, or the divisor is zero.

    A sum has the digits of the operand with the fewer places before the point, of equals the fewer. A product or quotient has the fewer, where a whole
    number doesn't count; of two whole numbers the more. Sums and products are exact. A quotient of whole numbers is exact if it ends; others are
    rounded half up to their digits, or to a whole number if that has more. A product with zero, and zero divided, is 0 with one digit.
    """
    x, y = number(a), number(b)
    if x is None or y is None or op not in ("+", "-", "*", "/"):
        return None
    (v, n), (w, m) = x, y
    with localcontext() as c:
        c.prec, c.rounding, c.Emax, c.Emin = len(a) + len(b) + 2 * LARGEST_EXPONENT + MORE_DIGITS, ROUND_HALF_UP, 10**6, -(10**6)
        if op in ("+", "-"):
            places = [z.adjusted() + 1 if z else 0 for z in (v, w)]
            digits = min(n, m) if places[0] == places[1] else n if places[0] < places[1] else m
            return _plain(v + w if op == "+" else v - w, len(a) + len(b) if v == w == 0 else 1), digits
        if op == "/" and w == 0:
            return None
        if v == 0 or w == 0:
            return "0", 1
        if _whole(v) and _whole(w):
            digits = max(len(str(abs(int(v)))), len(str(abs(int(w)))), min(n, m))
        else:
            digits = m if _whole(v) else n if _whole(w) else min(n, m)
        if op == "*":
            return _plain(v * w, digits), digits
        q = v / w
        if _whole(v) and _whole(w) and len(q.normalize().as_tuple().digits) <= max(n, m) + MORE_DIGITS:
            return _plain(q), UNBOUNDED
        if not (_whole(v) and _whole(w)):
            digits = max(digits, q.adjusted() + 1)
        c.prec = digits
        return _plain(+q, digits), digits


def with_results(rows: DataFrame) -> DataFrame:
    """rows with columns (a, op, b), all texts, and ``result`` and ``digits`` of each; nulls where ``calculated`` has none. Other columns stay, columns of these two names are replaced."""

    @F.arrow_udf("struct<result string, digits int>")
    def work(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, op, b in batches:
            out = [calculated(*x) or (None, None) for x in zip(a.to_pylist(), op.to_pylist(), b.to_pylist(), strict=True)]
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32()))]
            yield pa.StructArray.from_arrays(cols, names=["result", "digits"])

    r = work("a", "op", "b")
    return rows.withColumns({"result": r["result"], "digits": r["digits"]})

"""English word stems (the published Porter rules) for search indexes, on tables of distinct words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
# Suffixes and what they become, by step; a step's measure is what must stand before the suffix.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _shape(stem: str) -> str:
    """Consonants and vowels of a stem, runs as one letter."""
    out = ""
    for k, c in enumerate(stem):
        vowel = c in "aeiou" or (c == "y" and k > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return re.sub(r"(.)\1+", r"\1", out)


def measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    raw = ""
    for k, c in enumerate(w):
        raw += "v" if c in "aeiou" or (c == "y" and k > 0 and raw[-1] == "c") else "c"
    return raw[-3:] == "cvc" and w[-1] not in "wxy"


def _swap(w: str, rules: str, least: int) -> str:
    for pair in sorted(rules.split(), key=lambda x: -len(x.partition(":")[0])):
        old, _, new = pair.partition(":")
        if w.endswith(old):
            base = w[: -len(old)]
            return base + new if measure(base) > least else w
    return w


def stem(w: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay."""
    if len(w) <= 2:
        return w
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(old):
            w = w[: len(w) - len(old)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for old in ("ed", "ing"):
            base = w[: -len(old)]
            if w.endswith(old) and "v" in _shape(base):
                w = base
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w[-1]) == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    for old in sorted([*STEP4.split(), "sion", "tion"], key=len, reverse=True):
        if w.endswith(old):
            base = w[: -3] if old in ("sion", "tion") else w[: -len(old)]
            w = base if measure(base) > 1 else w
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def stemmed(col: Column | str) -> Column:
    @F.arrow_udf("string")
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if w is None else stem(w) for w in a.to_pylist()], pa.string())

    return stems(col)


def stem_index(words: DataFrame) -> DataFrame:
    """(key, word) rows with their stem: stems are found once for each distinct word and joined back."""
    once = words.select("word").distinct().withColumn("stem", stemmed("word"))
    return words.join(once, "word").select("key", "stem").distinct()


def search(index: DataFrame, text: str, every: bool = False) -> DataFrame:
    """(key, n_hits) of entries in which any, or every, stem of the text starts some stem."""
    wanted = sorted({stem(w) for w in re.findall(r"[a-z]\w{2,}", text.lower())})
    hits = [F.max(F.col("stem").startswith(w).cast("int")) for w in wanted]
    out = index.groupBy("key").agg(sum(hits, F.lit(0)).alias("n_hits"))
    return out.filter(F.col("n_hits") >= (len(wanted) if every else 1)) if wanted else out.limit(0)

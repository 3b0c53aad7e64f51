"""Hashes of words and word shingles, vectorised over code points.

A text is lowered; a word is a run of letters and digits. A word's hash is a polynomial over
random values of its code points, taken from one running sum over the whole text, so no
word is ever built as a string. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import worker_tables

#: Words in a shingle.
WIDTH = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, "uint64") + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which code points make words, their values, and powers of the base up to ``n`` (each worker builds them once)."""
    _state = worker_tables("shingles", dict)
    if "word" not in _state:
        _state["word"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), "int8", 0x110000)
        _state["value"] = mix(np.arange(0x110000, dtype="uint64"))
    if len(_state.get("up", ())) < n:
        size = max(1 << 14, 1 << int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, "uint64")
            p[0] = 1
            _state[name] = np.multiply.accumulate(p)
    return _state["word"], _state["value"], _state["up"], _state["down"]


def words(text: str) -> np.ndarray:
    """The hash of each word, in order."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word, value, up, down = _tables(len(c) + 1)
    inside = np.zeros(len(c) + 2, "int8")
    inside[1:-1] = word[c]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(c) + 1, "uint64")
    np.cumsum(value[c] * up[: len(c)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of ``width`` words; of a shorter text, of all its words; none without a word."""
    w = words(text)
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    out = np.zeros(n, "uint64")
    for k in range(min(width, len(w))):
        out = out * _STEP + w[k : k + n]
    return mix(out)

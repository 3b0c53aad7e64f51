"""Encoding long texts in pieces cut where no token can cross.

Two kinds of tokenizer split a text before merging in a known way (see ``cutter``): no token joins a white-space
run to what stands before it, and a letter or digit never shares a token with a
following full stop or comma. Cutting there and encoding each piece alone gives the
ids of the whole text, and since most pieces repeat, each worker encodes a piece once
and remembers the result in a bounded cache. Texts for any other tokenizer stay whole, as does a run without such a place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

#: Letters and digits that keep their class under any normalisation used (a fixed range).
_PLAIN = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
#: The same with Chinese characters, kana and Hangul, which a full-width stop may follow.
_LETTERS = _PLAIN + "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"
_STOPS = ".,\u3001\u3002"
#: Pieces that keep the white space before them, for byte-level tokenizers that encode it.
WITH_SPACE = re.compile(rf" ?[{_LETTERS}]++(?![^\s{_STOPS}])|\s*\S+|\s+")
#: Pieces without white space, for tokenizers that drop it.
WITHOUT_SPACE = re.compile(rf"[{_LETTERS}]++(?![^\s{_STOPS}])|\S+")
#: Characters that Python takes for white space and the tokenizers don't: such a text stays whole.
_ODD = re.compile("[\x1c-\x1f]")
#: Bytes of text in one call of the library, and remembered pieces at most, per worker; longer pieces aren't remembered.
BATCH_BYTES = 1 << 16
CACHE_PIECES = 300_000
CACHED_CHARS = 64
#: Fixed value: the pre-tokenizer pattern of the word-level kind.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cutter(path: str) -> re.Pattern | None:
    """How a text may be cut for a tokenizers file, by what the file says of its pre-tokenizer; None: not at all."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec.get("added_tokens") or []:  # one that holds a place for a cut, or reaches over white space, could be torn
        if t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(rf"[\s{_STOPS}]", t["content"]):
            return None
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return WITH_SPACE
    steps = pre.get("pretokenizers") or [{}]
    words = steps[0].get("pattern") == {"Regex": _WORD_SPLIT} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    bytes_ = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
    plain = all(n["type"] in ("NFC", "Lowercase") or n.get("pattern") == {"Regex": "\\s+"} for n in (norm or {}).get("normalizers", []))
    return WITHOUT_SPACE if words and bytes_ and plain else None


def pieces(text: str, pattern: re.Pattern | None) -> list[str]:
    """The pieces of a text; all of it without a pattern."""
    return [text] if pattern is None or _ODD.search(text) else pattern.findall(text)


def balanced(items: Iterable[str], limit: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Lists of about ``limit`` bytes (UTF-8) each; one item may exceed it alone."""
    out, size = [], 0
    for x in items:
        n = len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append(x)
        size += n
    if out:
        yield out


class PieceCache:
    """Remembers ``encode`` of each piece; ``encode`` takes a list and returns one value for each item."""

    def __init__(self, encode: Callable[[list[str]], list], pattern: re.Pattern | None, most: int = CACHE_PIECES):
        self.encode, self.pattern, self.most = encode, pattern, most
        self.known: dict = {}
        self.passing: list[str] = []

    def cut(self, text: str) -> list[str]:
        return pieces(text, self.pattern)

    def learn(self, lists: list[list[str]]) -> dict:
        """Make every piece of ``lists`` known and return the mapping, which holds until the next call."""
        for x in self.passing:
            self.known.pop(x, None)
        if len(self.known) > self.most:
            self.known = {}
        new = set().union(*lists).difference(self.known.keys()) if lists else set()
        for part in balanced(new):
            self.known.update(zip(part, self.encode(part), strict=True))
        self.passing = [x for x in new if len(x) > CACHED_CHARS]
        return self.known

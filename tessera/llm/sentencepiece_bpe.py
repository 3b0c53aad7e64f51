"""Exact encoding and decoding with a sentencepiece BPE model.

Encoding doesn't merge pair by pair. An Aho-Corasick automaton over the vocabulary gives
the longest piece at each position; pieces are taken from left to right, and a piece is
accepted only if it is compatible with the one before it, that is, if merging their joined
text again gives these two pieces. If no piece fits, the position goes into a bitfield of
failed positions and the search steps back. A sequence whose neighbours are all compatible
is the one that merging gives, since all merges have different ranks.

The one exception in the vocabulary is a run of spaces, whose pieces tie in rank: a piece
of text that has such a run is merged in the library's order (best rank, then leftmost).

A text is cut where no vocabulary piece can cross: before a space that follows something
else, and between two characters that no piece holds side by side. Each worker remembers
the ids of the pieces of text it has met, within a bound.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, table, text_of, with_fields, worker_tables
from tessera.llm.safe_chunks import _PLAIN, CACHE_PIECES

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_RUN = SPACE * 2
#: Remembered compatibility answers, at most, per worker.
CACHE_PAIRS = 250_000
#: Bytes of text whose ids and decoded texts a worker holds as Python objects at once.
HELD_BYTES = 1 << 20


class Vocabulary:
    """The model's pieces, read through the library, and the encoder's tables."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = sp.eos_id()
        self.unknown_id = sp.unk_id()
        self.special = {i for i in range(sp.vocab_size()) if sp.is_control(i)}
        self.unknown_surface = " ⁇ "
        self.raw: list[bytes | None] = []  # what an id decodes to; None: nothing
        self.byte_id = [self.unknown_id] * 256
        self.is_byte = bytearray(sp.vocab_size())
        self.piece_id: dict[str, int] = {}
        self.piece: list[str] = []
        self.rank: dict[str, float] = {}
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            self.piece.append(p)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.is_byte[i] = 1
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif i in self.special:
                self.raw.append(b"")
            elif i == self.unknown_id:
                self.raw.append(self.unknown_surface.encode())
            else:
                self.piece_id[p] = i
                self.rank[p] = -sp.get_score(i)
                self.raw.append(p.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for p, i in self.piece_id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        # the next shorter piece that starts a piece
        self.shorter: dict[int, int] = {}
        for p, i in self.piece_id.items():
            for n in range(len(p) - 1, 0, -1):
                if (j := self.piece_id.get(p[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(p) for p in self.piece]
        self.fits: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cut = self._cutter()

    def _cutter(self) -> re.Pattern:
        """A pattern whose matches are pieces of text that no vocabulary piece crosses.

        It is built from the vocabulary: letters that may stand before a full stop or a comma within a piece
        would make that cut unsafe, and then it isn't made.
        """
        joined = {p[k : k + 2] for p in self.piece_id for k in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in joined):
            return re.compile(r"(?s).+")
        plain = re.compile(f"[{_PLAIN}]")
        stops = [c for c in ".,!?;:%$&*#|" if not any(x[1] == c and plain.match(x) for x in joined)]
        never = [c for c in "\n\t\r" if not any(c in p for p in self.piece_id)]
        stop, lone = re.escape("".join(stops)), "".join(never)
        # letters up to a stop, a character that is in no piece, or anything up to the next space
        parts = [rf"{SPACE}*+[{_PLAIN}]++(?=[{stop}{SPACE}{lone}]|\Z)"] + [f"[{lone}]"] * bool(lone) + [rf"{SPACE}*+[^{SPACE}{lone}]+", f"{SPACE}+"]
        return re.compile("|".join(parts))

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging: best rank first, then leftmost."""
        n = len(text)
        if n <= 48:
            return self._merge_short(list(text))
        part, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (r := self.rank.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, size = heapq.heappop(heap)
            if not part[a] or (b := after[a]) >= n or len(part[a]) + len(part[b]) != size:
                continue
            part[a] += part[b]
            part[b] = ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [p for p in part if p]

    def _merge_short(self, part: list[str]) -> list[str]:
        get, never = self.rank.get, float("inf")
        ranks = [get(a + b, never) for a, b in zip(part, part[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            k = ranks.index(best)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get(part[k] + part[k + 1], never)
            if k:
                ranks[k - 1] = get(part[k - 1] + part[k], never)
        return part

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives the two again."""
        key = (a, b)
        if (x := self.fits.get(key)) is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            x = self.fits[key] = self.merge(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return x

    def alone(self, a: int) -> bool:
        """Whether merging a piece's own text gives it back; others never occur."""
        if (x := self.reachable.get(a)) is None:
            x = self.reachable[a] = self.merge(self.piece[a]) == [self.piece[a]]
        return x

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        n = len(text)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(text):
            longest[end - size + 1] = i  # ends come in order, so the last is the longest
        out: list[int] = []
        failed = bytearray((n >> 3) + 1)  # one bit for each position
        at, i = 0, longest[0]
        fits, length = self.fits, self.length
        while at < n:
            end = at + length[i]
            if not failed[end >> 3] >> (end & 7) & 1:
                if out:
                    ok = fits.get((out[-1], i))
                    if ok is None:
                        ok = self.compatible(out[-1], i)
                else:
                    ok = self.alone(i)
                if ok:
                    out.append(i)
                    at = end
                    if at < n:
                        i = longest[at]
                    continue
            if (j := self.shorter.get(i)) is not None:
                i = j
            else:  # nothing fits here after the piece before: step back and try a shorter one there
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("the vocabulary can't encode this text")
                i = out.pop()
                at -= length[i]
        return out

    def encode_piece(self, text: str) -> tuple[int, ...]:
        if self.piece_id.keys() >= set(text):
            return tuple([self.piece_id[p] for p in self.merge(text)] if _RUN in text else self.backtrack(text))
        out: list[int] = []
        for known, odd in re.findall(rf"([{self._class()}]+)|(.)", text, re.S):
            if known:
                out += self.encode_piece(known)
            else:
                out += [self.byte_id[b] for b in odd.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _class(self) -> str:
        if not hasattr(self, "_known_class"):
            self._known_class = re.escape("".join(c for c in self.piece_id if len(c) == 1))
        return self._known_class

    def encode(self, text: str) -> list[int]:
        """All ids of a text, without begin or end id."""
        if not text:
            return []
        known = self.known
        out: list[int] = []
        for x in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(x)
            if ids is None:
                if len(known) >= CACHE_PIECES:
                    known.clear()
                ids = self.encode_piece(x)
                if len(x) <= 64:
                    known[x] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, byte pieces join to characters, the prefix space goes."""
        raw = self.raw
        try:  # a control id within a character's bytes parts them
            text = b"".join(map(raw.__getitem__, ids)).decode() if self.special.isdisjoint(ids[:-1]) else "".join(self._runs(ids))
        except UnicodeDecodeError:
            text = "".join(self._runs(ids))
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.piece[first][:1] == SPACE else text

    def _runs(self, ids: list[int]) -> Iterator[str]:
        """Byte pieces that aren't UTF-8 give one replacement character each."""
        run = b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.raw[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        yield run[:n].decode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    yield "�"
                run = run[n:]
            if i is not None:
                yield self.raw[i].decode()


def vocabulary(name: str = MODEL) -> Vocabulary:
    """The worker's tables for a public model's name, or a path that every executor has."""
    from tessera.llm.token_counts import tokenizer_path

    return worker_tables(f"pieces {name}", lambda: Vocabulary(tokenizer_path(name)))


def encode_decode(col: Column | str, model: str = MODEL, end: bool = True) -> Column:
    """A struct of ``ids`` (with an end id unless ``end`` is false) and ``decoded``, the text of those ids.

    One function does both, so a task has one Python worker and one set of tables. A null or empty text has the end id alone.
    """

    @F.arrow_udf("struct<ids array<int>, decoded string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        tail = [v.end_id] if end else []
        for a in batches:
            parts = []
            for b in by_bytes([pa.RecordBatch.from_arrays([a], ["t"])], 0, HELD_BYTES):
                ids = [v.encode(t) + tail if t else tail for t in b.column(0).to_pylist()]
                text = pa.array(map(v.decode, ids), pa.string())
                parts.append(pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), text], names=["ids", "decoded"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return coded.asNondeterministic()(col)  # evaluated once, however often its fields are used


def encode(col: Column | str, model: str = MODEL, end: bool = True) -> Column:
    """Ids of a text column as ``array<int>``; see ``encode_decode``."""
    return encode_decode(col, model, end)["ids"]


def decode(col: Column | str, model: str = MODEL) -> Column:
    """Text of an ``array<int>`` column. Null gives null; an unknown id gives the model's unknown mark."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for a in batches:
            yield pa.array([None if x is None else v.decode(x) for x in (a.slice(k, 256).to_pylist() for k in range(0, len(a), 256)) for x in x], pa.string())

    return decoded(col)


def with_pieces(df: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``ids`` (``array<int>``, ending in the end id) and ``decoded`` (the text of those ids).

    Null texts count as empty; texts are encoded whole, whatever their length; repeated rows each keep a row;
    columns already named ``ids`` or ``decoded`` are replaced, others pass untouched; no rows give no rows.
    """
    return with_fields(df, encode_decode(text_of(text_col), model), {"ids": "ids", "decoded": "decoded"})


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_sentencepiece": op3_sentencepiece}

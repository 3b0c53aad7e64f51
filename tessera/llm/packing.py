"""Packing examples into fixed-length training sequences by vector bin packing.

Each example has three demands: tokens, one segment, and loss-bearing tokens. A sequence
has a capacity in all three. Sequences are filled one at a time: of the waiting pieces
that fit, the one whose demands have the largest dot product with what the sequence has
left (both in shares of the capacity) goes in next. Where nothing fits and cutting is
allowed, the piece with the largest dot product is cut to fill the rest; what is left over at
the end of a partition is cut into lengths that are powers of two, which need no padding.

Tokenising and packing happen in one pass over each input partition, so there is no
shuffle, and a task holds at most ``2 * POOL`` waiting pieces shorter than a sequence, each with its own ids only. A
sequence never spans partitions; each partition ends with at most a few short ones.
Sequence ids carry the partition number, so they are unique, and a task that is run
again over the same split gives the same rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, table, text_of, worker_tables
from tessera.llm.safe_chunks import WITH_SPACE, PieceCache, cutter
from tessera.llm.token_counts import library, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS, MAX_SEGMENTS = 1024, 256
#: The id that ends a document.
END_ID = 0
ID_BYTES = 4
#: Fixed value: how byte-level tokenizers split a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that wait for a place in a partition after a look at them; twice as many before.
POOL = 256
#: Bytes of text that are encoded at once.
HELD_BYTES = 2 << 20
_PART_BITS = 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Places pieces of one partition's examples; ``done`` holds rows (key, total, start, length, crc, sequence, offset, loss).

    An example is (key, its ids as bytes, n_prompt): tokens from ``n_prompt`` on bear loss. A waiting piece is
    (key, total, start, length, n_prompt, its own ids).
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool, first_id: int):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("every limit must be at least 1")
        self.cap = (max_tokens, max_segments, max_loss)
        self.cut, self.next_id = cut, first_id
        self.pool: list[tuple] = []
        self.done: list[tuple] = []

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def fitting(self, piece: tuple, tokens: int, loss: int) -> int:
        """How many of the piece's leading tokens fit into the given rest of a sequence."""
        _, _, start, length, prompt, _ = piece
        return min(length, tokens, max(0, prompt - start) + loss)

    @staticmethod
    def split(piece: tuple, n: int) -> tuple[tuple, tuple]:
        """The first ``n`` tokens of a piece, and the rest."""
        key, total, start, length, prompt, ids = piece
        return (key, total, start, n, prompt, ids[: ID_BYTES * n]), (key, total, start + n, length - n, prompt, ids[ID_BYTES * n :])

    def add(self, key, ids: bytes, n_prompt: int) -> None:
        view, total, start = memoryview(ids), len(ids) // ID_BYTES, 0
        while True:  # what fills a sequence alone needs no search
            piece = (key, total, start, total - start, n_prompt, view[ID_BYTES * start :])
            room = self.fitting(piece, self.cap[0], self.cap[2])
            if room == piece[3] and room < self.cap[0]:
                break
            if not self.cut and start == 0 and room < total:
                raise ValueError(f"example {key!r} exceeds a sequence and cutting is off")
            self.emit([self.split(piece, room)[0]])
            start += room
            if start == total:
                return
        self.pool.append((*piece[:5], bytes(piece[5])))
        if len(self.pool) >= 2 * POOL:
            self.drain(POOL)

    def drain(self, leave: int = 0) -> None:
        """Fill sequences until at most ``leave`` pieces wait."""
        c_tok, c_seg, c_loss = self.cap
        pool = self.pool
        tok = np.array([p[3] for p in pool], float)
        loss = np.array([self.loss(p[2], p[3], p[4]) for p in pool], float)
        live = np.ones(len(pool), bool)
        left = len(pool)
        while left > leave:
            inside, tokens, segments, bearing = [], c_tok, c_seg, c_loss
            while left and tokens and segments:
                gain = tok * (tokens / c_tok**2) + loss * (bearing / c_loss**2) + segments / c_seg**2
                fits = live & (tok <= tokens) & (loss <= bearing)
                if fits.any():
                    k = int(np.argmax(np.where(fits, gain, -1.0)))
                    inside.append(pool[k])
                    tokens, segments, bearing = tokens - pool[k][3], segments - 1, bearing - int(loss[k])
                    live[k] = False
                    left -= 1
                    continue
                if not self.cut:
                    break
                k = int(np.argmax(np.where(live, gain, -1.0)))
                n = self.fitting(pool[k], tokens, bearing)
                if not n:
                    break
                part, pool[k] = self.split(pool[k], n)
                inside.append(part)
                tokens, segments, bearing = tokens - n, segments - 1, bearing - self.loss(*part[2:5])
                tok[k], loss[k] = pool[k][3], self.loss(*pool[k][2:5])
            self.finish(inside)
        self.pool = [p for p, x in zip(pool, live, strict=True) if x]

    def finish(self, inside: list[tuple]) -> None:
        """Emit a sequence; if it is short and may be cut, as lengths that are powers of two."""
        total = sum(p[3] for p in inside)
        if not self.cut or total == self.cap[0] or total & (total - 1) == 0:
            self.emit(inside)
            return
        waiting = inside[::-1]
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            part = []
            while size:
                piece = waiting.pop()
                n = min(size, piece[3])
                first, rest = self.split(piece, n)
                part.append(first)
                size -= n
                if rest[3]:
                    waiting.append(rest)
            self.emit(part)

    def emit(self, inside: list[tuple]) -> None:
        offset = 0
        for key, total, start, length, prompt, ids in inside:
            self.done.append((key, total, start, length, zlib.crc32(ids), self.next_id, offset, self.loss(start, length, prompt)))
            offset += length
        self.next_id += 1


def byte_letters() -> dict[str, int]:
    """The byte for which each letter of a byte-level vocabulary stands: itself if it prints in Latin-1, else the next one from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranked(path: str) -> Callable[[list[str]], list[bytes]] | None:
    """A faster encoder of the same ids for a byte-level file whose ids follow the order of its merges; None for any other file.

    Merging by least id is then the same as merging by the first rule. The vocabulary and special strings are the file's own.
    """
    if cutter(path) is not WITH_SPACE:
        return None
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    letters = byte_letters()
    words = {w: i for w, i in vocab.items() if w not in special}
    odd = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges", "type") and v}
    if made != sorted(made) or len(set(made)) + 256 != len(words) or odd or not all(c in letters for w in words for c in w):
        return None
    ranks = {bytes(map(letters.__getitem__, w)): i for w, i in words.items()}
    enc = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [enc.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes() for t in texts]


def _cached(path: str) -> Callable[[list[str]], list[bytes]]:
    """The tokenizers library on pieces of texts, each of which is encoded once."""
    t = library(path)
    cache = PieceCache(lambda xs: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(xs, add_special_tokens=False)], cutter(path))

    def encode(texts: list[str]) -> list[bytes]:
        held = [cache.cut(t) for t in texts]
        known = cache.learn(held)
        return [b"".join(map(known.__getitem__, x)) for x in held]

    return encode


def encode_batch(texts: list[str], name: str = TOKENIZER) -> list[bytes]:
    """The ids of each text by a tokenizers file as little-endian unsigned 32-bit bytes, without an end id. A worker loads a file once."""
    path = tokenizer_path(name)
    return worker_tables(f"encoder {path}", lambda: _ranked(path) or _cached(path))(texts)


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer: str = TOKENIZER,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    cut: bool = True,
) -> DataFrame:
    """One row for each placed piece (``SCHEMA``).

    With ``prompt_col`` an example is prompt and text, and only the text's tokens and the end id bear loss;
    without it every token does. Ids are the tokenizer's, then ``END_ID``; ``start`` counts the ids before the piece,
    ``ids_crc32`` is over its little-endian unsigned 32-bit ids. ``max_loss`` defaults to ``max_tokens``.
    ``cut=False`` keeps examples whole and fails on one that exceeds a sequence.

    Null and empty texts are one end id; repeated rows are packed once each; a null id stays null;
    an empty table gives no rows; other columns are not read.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens, cut)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        packer = Packer(*limits, TaskContext.get().partitionId() << _PART_BITS)
        for whole in batches:
            for batch in by_bytes([whole], 2, HELD_BYTES):
                keys, prompts, texts = (batch.column(i).to_pylist() for i in range(3))
                heads = encode_batch(prompts, tokenizer) if any(prompts) else [b""] * len(keys)
                for key, head, ids in zip(keys, heads, encode_batch(texts, tokenizer), strict=True):
                    packer.add(key, head + ids + end, len(head) // ID_BYTES)
                yield out(packer)
        packer.drain()
        yield out(packer)

    def out(packer: Packer) -> pa.RecordBatch:
        rows, packer.done = packer.done, []
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        keys, totals, starts, lengths, crcs, seqs, offsets, losses = cols
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, starts, lengths, crcs, totals, seqs, offsets, losses)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    prompt = text_of(prompt_col) if prompt_col else F.lit("")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), prompt.alias("prompt"), text_of(text_col).alias("text")).mapInArrow(packed, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_packing": op10_packing}

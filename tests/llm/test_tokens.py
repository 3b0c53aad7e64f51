import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts
from tessera.llm import sentencepiece_bpe as sp

BITS = ["a", "B", "é", "İ", "́", ".", ",", "  ", "   ", " ", "\n", "\t", "\x1c", "'s", "'", "1", "½", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x41>", "!", "ß", "中", "\xa0", "_", "Σ", "ﬁ", "\u0085", "▁", "the", "\U0001f600", "\x00"]
EDGE = [(1, None), (2, ""), (3, " "), (4, "word " * 9000), (5, "x" * 3000), (5, "x" * 3000), (None, "a b")]


def texts(n):
    random.seed(7)
    return ["".join(random.choice(BITS) for _ in range(random.randint(0, 14))) for _ in range(n)]


def edge(spark):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in EDGE], "doc_id long, text string, ids string, n_tokens int")


def test_counts_equal_the_library():
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    xs = [*texts(6000), None]
    assert token_counts.count_batch(xs, token_counts.TOKENIZER) == [len(t.encode(x or "", add_special_tokens=False).ids) for x in xs]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_texts_count_as_whole_ones(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    random.seed(11)
    bits = [*BITS, "。", "、", "かな", "한국어", "漢字", "\u3000", "\u2028", "\u200b", "\u180e", "\x0b", "'ll", "don't", "<|endoftext|", "ab", "12", "...", ". ", ", "]
    xs = ["".join(random.choice(bits) for _ in range(random.randint(0, 24))) for _ in range(6000)] + ["漢字かな。" * 3000, "x" * 5000]
    assert token_counts.count_batch(xs, name) == [len(t.encode(x, add_special_tokens=False).ids) for x in xs]


def test_batches_are_balanced_by_bytes():
    from tessera.llm import safe_chunks

    lists = list(safe_chunks.balanced(["é" * 10] * 50 + ["a" * 500], 100))
    assert [sum(len(x.encode()) for x in part) for part in lists] == [100] * 10 + [500]


def test_an_unknown_tokenizer_is_not_cut(tmp_path):
    import json

    from tessera.llm import safe_chunks

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["pre_tokenizer"] = None
    path = tmp_path / "plain.json"
    path.write_text(json.dumps(spec))
    assert safe_chunks.cutter(str(path)) is None
    t = Tokenizer.from_file(str(path))
    xs = texts(200)
    assert token_counts.count_batch(xs, str(path)) == [len(t.encode(x, add_special_tokens=False).ids) for x in xs]


def test_counts_on_rows(spark):
    rows = token_counts.with_token_counts(edge(spark)).collect()
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    assert len(rows) == len(EDGE)
    for r in rows:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 2048, len((r["text"] or "").encode()))
    assert token_counts.with_token_counts(edge(spark).limit(0)).count() == 0


def test_counts_with_a_sentencepiece_model():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))
    xs = texts(300)
    assert token_counts.count_batch(xs, sp.MODEL) == [len(lib.encode(x)) for x in xs]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))


def test_pieces_equal_the_library(library):
    v = sp.vocabulary()
    for x in [*texts(6000), " " * 500 + "a" + " " * 77, "ab" * 2000]:
        ids = library.encode(x)
        assert v.encode(x) == ids
        assert v.decode(ids) == library.decode(ids)


def test_backtracking_equals_merging():
    v = sp.vocabulary()
    random.seed(3)
    letters = "aeinrstth"
    for _ in range(3000):
        x = "▁" + "".join(random.choice(letters) for _ in range(random.randint(1, 40)))
        assert [v.piece[i] for i in v.backtrack(x)] == v.merge(x)


def test_long_runs_take_linear_time(library):
    import time

    v = sp.vocabulary()
    random.seed(2)
    took = []
    for n in (100_000, 400_000):
        x = "".join(random.choice("aeinrsthdlou") for _ in range(n))
        start = time.process_time()
        ids = v.encode(x)
        took.append(time.process_time() - start)
    assert v.decode(ids) == x and took[1] < 8 * took[0] + 0.5


def test_decode_of_any_ids(library):
    random.seed(5)
    v = sp.vocabulary()
    for _ in range(3000):
        ids = [random.choice([0, 1, 2, 259, 29871, *range(3, 259), *range(300, 340)]) for _ in range(random.randint(0, 9))]
        assert v.decode(ids) == library.decode(ids)


def test_pieces_on_rows(spark, library):
    rows = sp.with_pieces(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        ids = [*library.encode(r["text"] or ""), 2]
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids))
    assert sp.with_pieces(edge(spark).limit(0)).count() == 0


def test_packing_places_every_id_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["", "a b c", "word " * 2500, *texts(300)])] + EDGE, "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = sorted(np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in docs.collect())
    crcs = {}
    for w in want:
        crcs.setdefault(len(w) // 4, []).append(w)
    assert sum(r["length"] for r in rows) == sum(len(w) // 4 for w in want)
    for r in rows:
        part = slice(4 * r["start"], 4 * (r["start"] + r["length"]))
        assert any(zlib.crc32(w[part]) == r["ids_crc32"] for w in crcs[r["doc_tokens"]])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces in by.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 1024 or at & (at - 1) == 0
        assert len(pieces) <= packing.MAX_SEGMENTS
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_all_three_limits_hold():
    random.seed(1)
    p = packing.Packer(64, 3, 20, True, 0)
    items = [(k, random.randint(1, 200), random.randint(0, 60)) for k in range(900)]
    for k, n, prompt in items:
        p.add(k, bytes(4 * n), min(prompt, n))
    p.drain()
    seen, seqs = {}, {}
    for key, _, start, length, _, seq, offset, loss in p.done:
        seen.setdefault(key, []).append((start, length))
        seqs.setdefault(seq, []).append((offset, length, loss))
    for k, n, _ in items:
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n
    for s in seqs.values():
        assert sum(x[1] for x in s) <= 64 and len(s) <= 3 and sum(x[2] for x in s) <= 20


@pytest.mark.parametrize("make", [packing._ranked, packing._cached])
def test_both_encoders_equal_the_library(make):
    path = public_tokenizers.path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    xs = [*texts(6000), "word " * 500, "x" * 2000, "漢字" * 300]
    assert make(path)(xs) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in xs]


def test_waiting_pieces_hold_their_own_ids_only():
    p = packing.Packer(64, 8, 64, True, 0)
    for k in range(300):
        p.add(k, bytes(4 * (6400 + k % 60 + 1)), 0)
        assert all(len(x[5]) == 4 * x[3] <= 4 * 63 for x in p.pool) and len(p.pool) <= 2 * packing.POOL


def test_whole_examples_with_prompts(spark):
    rows = spark.createDataFrame([(k, "question " * (k % 9), "answer " * (k % 30 + 1)) for k in range(200)], "doc_id long, prompt string, text string")
    out = packing.pack_documents(rows, prompt_col="prompt", max_tokens=128, max_segments=4, max_loss=64, cut=False).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(200)) and all(r["start"] == 0 and r["length"] == r["doc_tokens"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(sum(r["length"] for r in s) <= 128 and sum(r["loss_tokens"] for r in s) <= 64 and len(s) <= 4 for s in by.values())

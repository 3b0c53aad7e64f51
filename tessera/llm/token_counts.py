"""Token counts of whole texts: batch encoding inside an Arrow function that returns lengths only.

Only the text column goes to Python and only one number a row comes back; every other
column stays in the JVM. A batch is cut by bytes (not rows) before any of it becomes a Python string, long texts are
cut at safe boundaries where the tokenizer's file shows that they are safe (see ``safe_chunks``), and the library is called on lists of
about equal size in bytes. A text without such a boundary (no white space, no stop after letters) is one piece.
There is no shuffle: the work follows the input splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, table, text_of, worker_tables
from tessera.llm.safe_chunks import PieceCache, cutter

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text whose pieces are held at once in a worker.
HELD_BYTES = 4 << 20


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine (each executor asks for itself)."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library(name: str):
    """The tokenizers library's tokenizer of a name or path, without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def _made(name: str) -> PieceCache:
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        # a sentencepiece model adds a prefix to each text, so these texts are encoded whole
        return PieceCache(lambda xs: [len(i) for i in sp.encode(xs, num_threads=1)], None)
    t = library(name)
    return PieceCache(lambda xs: [len(e.ids) for e in t.encode_batch_fast(xs, add_special_tokens=False)], cutter(path))


def _counter(name: str) -> PieceCache:
    """The worker's counter, loaded once and reused across tasks."""
    return worker_tables(f"counter {name}", lambda: _made(name))


def count_batch(texts: list[str | None], name: str) -> list[int]:
    """Token counts of a list of texts; a null counts as empty."""
    counter = _counter(name)
    held = [counter.cut(t or "") for t in texts]
    known = counter.learn(held)
    return [sum(map(known.__getitem__, x)) for x in held]


def token_count(col: Column | str, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text column, without begin, end or added special tokens.

    ``tokenizer`` is a public tokenizer's name or a path that every executor has:
    ``.json`` is read by the tokenizers library, ``.model`` by sentencepiece.
    Null and empty texts count 0; special strings inside a text are treated as the library's default does.
    """

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out: list[int] = []
            for part in by_bytes([pa.RecordBatch.from_arrays([a], ["t"])], 0, HELD_BYTES):
                out += count_batch(part.column(0).to_pylist(), tokenizer)
            yield pa.array(out, pa.int64())

    return counted(col)


def with_token_counts(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """``df`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    Null texts count as empty; a text of any length is counted whole; repeated rows each keep a row.
    Other columns pass untouched, except that columns already named as the new ones are replaced.
    An empty table gives an empty table.
    """
    text = text_of(text_col)
    return (
        df.withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("n_tokens", token_count(text, tokenizer))
        .withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op4_token_counts": op4_token_counts}

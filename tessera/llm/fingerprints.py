"""SimHash fingerprints of documents, and all fingerprints within a Hamming radius.

A text's terms are its pairs of neighbouring words; a term's weight is 1 + ln(count). Each term's
128-bit hash votes with its weight on every bit, for or against, and the sign is the fingerprint's bit.

The search splits fingerprints into blocks. Two within radius r of each other agree on all but at
most r blocks, so for each choice of the other blocks there is a table keyed by their bits
(the permuted tables): every pair within the radius shares a key in one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, table, text_of
from tessera.llm.shingles import mix, shingles

BITS = 128
#: Words in a term.
TERM_WORDS = 2
RADIUS, BLOCKS = 3, 6
HELD_BYTES = 4 << 20
#: Ranges of ids for each shuffle partition: they even out what a partition gets.
RANGES_A_PARTITION = 4
_LOWEST = -(1 << 63)


def simhash(text: str) -> bytes:
    """The fingerprint of a text; a text without words has no votes and gets all zeros."""
    h, n = np.unique(shingles(text, TERM_WORDS), return_counts=True)
    if not len(h):
        return bytes(BITS // 8)
    weight = 1 + np.log(n)
    wide = np.empty((len(h), BITS // 64), "<u8")
    for k in range(BITS // 64):
        wide[:, k] = mix(h + np.uint64(k))
    votes = np.zeros(BITS)
    for k in range(0, len(h), 8192):
        bits = np.unpackbits(wide[k : k + 8192].view("u1"), axis=1)
        votes += weight[k : k + 8192].astype("float32") @ bits.astype("float32")
    return np.packbits(votes * 2 > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def fingerprint(col: Column | str) -> Column:
    """The fingerprint of a text column as lowercase hex. Null counts as empty."""

    @F.arrow_udf("string")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out: list[str] = []
            for part in by_bytes([pa.RecordBatch.from_arrays([a], ["t"])], 0, HELD_BYTES):
                out += [simhash(t or "").hex() for t in part.column(0).to_pylist()]
            yield pa.array(out, pa.string())

    return printed(col)


def with_fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fingerprint`` (replaced if there). Null and empty texts share the all-zero one; rows and other columns stay."""
    return df.withColumn("fingerprint", fingerprint(text_of(text_col)))


def near_fingerprints(df: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, col: str = "fingerprint") -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints within ``radius`` bits, a < b.

    Equal fingerprints are one, so a group of copies costs one row in each table; members are found by joining back on the
    fingerprint. Nulls take no part; no rows give no pairs. ``blocks`` must exceed ``radius`` and divide the 32 hex digits
    into runs (sizes may differ by one).
    """
    if not 0 <= radius < blocks <= BITS // 4:
        raise ValueError("blocks must exceed radius")
    cuts = [BITS // 4 * k // blocks for k in range(blocks + 1)]
    one = df.select(F.col(col).alias("fp")).filter("fp IS NOT NULL").distinct()
    keys = [
        F.struct(F.lit(t).alias("t"), F.concat(*[F.substring("fp", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in kept]).alias("key"))
        for t, kept in enumerate(combinations(range(blocks), blocks - radius))
    ]
    tables = one.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "key")
    tables = tables.join(shared, ["t", "key"])
    a, b = tables.withColumnRenamed("fp", "a"), tables.withColumnRenamed("fp", "b")
    word = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    distance = sum(F.bit_count(word("a", at).bitwiseXOR(word("b", at))) for at in range(1, BITS // 4, 8))
    pairs = a.join(b, ["t", "key"]).filter("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= radius)


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited text and the next document's (see the query's contract).

    Documents stand in descending order of id (equal ids by text, a null id last), and the last is followed by the first.
    The rows are shuffled once, by ranges of ids: within a range the next document is the next row, and the first
    row of each range is also sent to the range before it. A range's rows stream through; none is held but the current two.
    Null texts count as empty; repeated rows each keep a row; an empty table gives no rows; one document is its own next.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = parts * RANGES_A_PARTITION
    low = docs.agg(F.min("key")).first()[0]
    at = docs.approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n) if low is not None else []
    bounds = np.array(sorted({int(x) for x in at if x > low}), "int64")

    @F.arrow_udf("int")
    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(len(bounds) - np.searchsorted(bounds, np.asarray(a), "right"), pa.int32())

    first = {r["bucket"]: r["key"] for r in docs.select("key").withColumn("bucket", place("key")).groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    order = sorted(first)
    starts = np.array(sorted(first.values()), "int64")
    before = {first[b]: order[k - 1] for k, b in enumerate(order)}  # a range's first key -> the range before, round the end
    range_before = [before[int(k)] for k in starts]

    @F.arrow_udf("int")
    def guest_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            at = np.searchsorted(starts, np.asarray(a))
            yield pa.array([range_before[k] if k < len(starts) and starts[k] == x else None for k, x in zip(at, np.asarray(a), strict=True)], pa.int32())

    own = docs.withColumn("bucket", place("key")).withColumn("host", guest_of("key"))
    mine, visit = F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    spread = own.withColumn("to", F.explode(F.when(F.col("host").isNull(), F.array(mine)).otherwise(F.array(mine, visit))))
    rows = spread.select("to.bucket", "to.guest", "key", "doc_id", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, fingerprint) that waits for its next
        for whole in batches:
            for b in by_bytes([whole], 4, HELD_BYTES):
                out = []
                for bucket, is_guest, _, doc, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    if is_guest and (held is None or held[0] != bucket):
                        continue  # a repeated first key
                    mine = (bucket, doc, text, simhash(text))
                    if held is not None and held[0] == bucket:
                        out.append(against(held, mine))
                    held = None if is_guest else mine
                yield batch(out)

    def against(a: tuple, b: tuple) -> tuple:
        n = len(a[2])
        edited = edit(a[2], b[2])
        fp = simhash(edited)
        return a[1], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a[3].hex(), fp.hex(), likeness(a[3], fp), likeness(a[3], b[3])

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following text, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_fingerprints": op9_fingerprints}

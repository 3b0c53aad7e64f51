"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and exact multiset overlap.

A document is the bag of its five-word shingles; the similarity of two is the sum of the smaller
counts over the sum of the larger. Each shingle owns Poisson processes on a hierarchy of weight
intervals (0,1], (1,2], (2,4], ...: a count of w takes the points of the intervals below w, and of the
interval that holds w those that fall below it, as fair bits hashed from the point send it down the
interval's halves. A point belongs to a random one of the signature's components, which keeps its
earliest point. Equal components of two bags are then as likely as the bags are similar. A process is
only followed while its points can still be the earliest of some component.

1. Texts with the same words are one class at once, by a 128-bit hash, whatever their ids; only one stands for each.
2. Representatives that share a band meet in a bucket. Each bucket's smallest is checked against the others
   (links in proportion to the rows, whatever the bucket's size), and the links are closed into components.
3. In a bucket that still has several components, the member with the least that
   no other has (the nearest to what its group has in common) is checked against the others too.
4. What a bucket still holds apart is then checked pairwise, if one-bit signatures allow the similarity. What a bag shares with
   others at all bounds its overlaps: members that this keeps from any link go first (exactly), and the bound holds for each pair as well.
   A pair is made once, in the first band that it shares. One rule holds for buckets of every size.
5. Every link was verified on the bags themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_bytes, durable, table, text_of
from tessera.llm.components import components
from tessera.llm.shingles import mix, shingles

SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with probability 0.0007, one of 0.85 with 0.000003.
BANDS, ROWS = 40, 8
#: A pair isn't checked in step 4 if its one-bit signatures differ in so many deviations more bits than bags just similar enough.
UNLIKE_DEVIATIONS = 4.8
HELD_BYTES = 1 << 20


def _times(k: int) -> np.uint64:
    """A different odd constant for each turn of a process."""
    return np.uint64(k * 0x9FB21C651E98DF25 & (1 << 64) - 1)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (one row a bag) of bags given as (hashes, counts); an empty bag's row is all infinite."""
    h = np.full((len(bags), size), np.inf)
    if not bags or not sum(len(b[0]) for b in bags):
        return h
    element = np.concatenate([b[0] for b in bags])
    weight = np.concatenate([b[1] for b in bags]).astype("int64")
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    # the intervals of the hierarchy that a weight reaches into: (lower, upper]; rate: its length
    parts = [(doc, element, np.ones(len(doc)), np.ones(len(doc), "int64"))]
    lower = 1
    while (more := weight > lower).any():
        e = mix(element[more] ^ _times(lower))
        parts.append((doc[more], e, np.full(len(e), float(lower)), np.minimum(weight[more] - lower, lower)))
        lower *= 2
    doc, node, rate, inside = (np.concatenate(x) for x in zip(*parts, strict=True))
    time = np.zeros(len(doc))
    flat = h.reshape(-1)
    turn = 0
    while len(doc):
        turn += 1
        r = mix(node + _times(turn))
        time = time - np.log1p((r >> np.uint64(11)) * -(2.0**-53)) / rate
        r = mix(r)
        component = ((r >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype("int64")
        # where in the interval the point falls: the bits that descend its halves
        kept = (r & np.uint64(0xFFFFFFFF)) * rate * 2.0**-32 < inside
        np.minimum.at(flat, (doc * size + component)[kept], time[kept])
        alive = time < h.max(1)[doc]
        if not alive.all():
            doc, node, rate, inside, time = doc[alive], node[alive], rate[alive], inside[alive], time[alive]
    return h


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signature).view("uint64").reshape(len(signature), -1, rows)
    out = np.zeros(bits.shape[:2], "uint64")
    for k in range(rows):
        out = mix(out ^ bits[:, :, k])
    return out.view("int64")


def one_bit(signature: np.ndarray) -> np.ndarray:
    """One bit of each component (b-bit minwise hashing with b = 1), as 64-bit words."""
    bits = mix(np.ascontiguousarray(signature).view("uint64")).astype("u1") & 1
    return np.packbits(bits, axis=1).view("int64")


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text or ""), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller counts over sum of larger; 0 if both bags are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _keyed(df: DataFrame, id_col: str, text_col: str, value: Column | None = None) -> DataFrame:
    """(doc_id, x1, x2, text): the id as a long, 128 bits over the text, the text or another value."""
    text = text_of(text_col)
    value = text if value is None else value
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2"), value.alias("text"))


def rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One of the ``rows`` for each (doc_id, x1, x2) in ``wanted``, with the columns of both."""
    key = ["doc_id", "x1", "x2"]
    named = rows.filter("doc_id IS NOT NULL").join(wanted.filter("doc_id IS NOT NULL"), key)
    if named.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").take(1):
        named = named.dropDuplicates(key)
    # copies without an id go before the join, since they all have its key
    free = rows.filter("doc_id IS NULL").dropDuplicates(key[1:]).join(wanted.filter("doc_id IS NULL").drop("doc_id"), key[1:])
    return named.unionByName(free)


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x1, x2, h1, h2, bands, bits, size) of each row: the hash of its text, that of its words in order, its band keys and one-bit signature (none without a word), its shingles."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 3, HELD_BYTES):
            texts = b.column(3).to_pylist()
            runs = [shingles(t) for t in texts]
            full = [k for k, r in enumerate(runs) if len(r)]
            keys: list = [[] for _ in runs]
            bits: list = [[] for _ in runs]
            if full:
                signed = signatures([np.unique(runs[k], return_counts=True) for k in full])
                for k, row, bit in zip(full, bands(signed), one_bit(signed), strict=True):
                    keys[k], bits[k] = row, bit
            h1, h2 = zip(*(order_hash(r if len(r) else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")) for t, r in zip(texts, runs, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array([len(r) for r in runs], pa.int64())], names=["doc_id", "x1", "x2", "h1", "h2", "bands", "bits", "size"])

    return _keyed(df, id_col, text_col).mapInArrow(sketched, "doc_id long, x1 long, x2 long, h1 long, h2 long, bands array<long>, bits array<long>, size long")


def order_hash(x: np.ndarray) -> tuple[int, int]:
    """128 bits over a sequence."""
    place = mix(np.arange(len(x), dtype="uint64"))
    n = np.uint64(len(x))
    a = np.add.reduce(mix(x ^ place), dtype="uint64") + n
    b = np.add.reduce(mix(x + place) * (place | np.uint64(1)), dtype="uint64") + n
    return int(np.int64(a)), int(np.int64(b))


def similarity(a: Column, b: Column) -> Column:
    """The exact multiset overlap of two text columns."""

    @F.arrow_udf("double")
    def exact(x: pa.Array, y: pa.Array) -> pa.Array:
        seen: dict[str, tuple] = {}

        def of(t: str) -> tuple:
            if t not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[t] = bag(t)
            return seen[t]

        return pa.array([overlap(of(s.as_py() or ""), of(t.as_py() or "")) for s, t in zip(x, y, strict=True)], pa.float64())

    return exact(a, b)


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, h1): one row for each row of ``df``; class_id is the smallest id of its class.

    Classes are the components of the links of similarity ``least`` or more. Texts without a word (null, empty, marks only)
    are one class with those of exactly the same text (null as empty). Rows with a null id are compared as all others; a class of only such rows has a
    null class_id. An id on several texts names each of their classes. What tells all classes apart is h1, the hash of the words of the class's first text.
    Repeated rows each keep a row. An empty table gives none; other columns are not read.
    """
    rows, named = _classes(df, id_col, text_col, least)
    named = named.select("h1", "h2", F.col("keep.doc_id").alias("class_id"), F.col("keep.h1").alias("class_h1"))
    return rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").select("doc_id", "class_id", F.col("class_h1").alias("h1"))


def first_of_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``near_duplicate_classes``, with all its columns: one of the smallest id (of a class without ids, any)."""
    _, named = _classes(df, id_col, text_col, least)
    kept = named.filter(F.col("first") == F.col("keep")).select("keep.doc_id", "keep.x1", "keep.x2")
    return rows_of(_keyed(df, id_col, text_col, F.struct(*df.columns)), durable(kept, "near-kept")).select("text.*")


def _classes(df: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (h1, h2, first, keep) of each run of words: its first row's id and text, and those of its class.

    Each run of words is a node ``rep``, whatever ids it has.
    """
    rows = durable(sketch(df, id_col, text_col), "near-sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x1", "x2", "h1")).alias("first")
    stand = rows.groupBy("h1", "h2").agg(first, F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("size").alias("size"))
    stand = durable(stand.withColumn("rep", F.monotonically_increasing_id()), "near-stand")
    keys = stand.select("rep", "bits", F.posexplode("bands").alias("band", "key"))
    heads = keys.groupBy("band", "key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = durable(keys.join(heads, ["band", "key"]), "near-members")  # only what shares a band
    met = stand.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "first.doc_id", "first.x1", "first.x2")
    texts = durable(rows_of(_keyed(df, id_col, text_col), met).select("rep", "text"), "near-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
        return durable(pairs.join(b, "b").join(a, "a").select("a", "b", similarity(F.col("text_a"), F.col("text_b")).alias("s")).filter(F.col("s") >= least).select("a", "b"), name)

    first = verified(members.filter("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "near-links")
    joined = components(first, "near-first")
    apart = _several(members.filter("n > 2"), joined)  # of two, the head was checked against the other
    crowd = durable(_crowd(apart, stand, texts), "near-crowd")
    apart = durable(apart.filter("rep <> head").join(crowd, "rep"), "near-crowded")
    middle = verified(_middle(apart, least), "near-middle")
    if middle.take(1):
        first = first.unionByName(middle)
        joined = components(first, "near-joined")
        apart = _several(apart, joined)
    second = verified(_apart(apart, stand, least), "near-more")
    final = components(first.unionByName(second), "near-final") if second.take(1) else joined
    linked = durable(stand.select("rep", "first").join(final, F.col("rep") == F.col("node")).select("rep", "component", "first"), "near-linked")
    least_of = linked.groupBy("component").agg(F.min("first").alias("keep"))
    keep = linked.select("rep", "component").join(least_of, "component").select("rep", "keep")
    named = stand.select("h1", "h2", "rep", "first").join(keep, "rep", "left").select("h1", "h2", "first", F.coalesce("keep", "first").alias("keep"))
    return rows, named


def _several(members: DataFrame, joined: DataFrame) -> DataFrame:
    """The members of buckets that have several components, each with its component c."""
    m = members.drop("c").join(joined, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    split = m.groupBy("band", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("band", "key")
    return durable(m.join(split, ["band", "key"]), "near-apart")


def _crowd(apart: DataFrame, stand: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, size, shared) of each member of a split bucket: its shingles, and those of them that any other such member has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, HELD_BYTES):  # what many of a batch share is one row
            bags = [bag(t) for t in b.column(1).to_pylist()]
            h, first, n = np.unique(np.concatenate([x[0] for x in bags]), return_index=True, return_counts=True)
            rep = np.repeat(b.column(0).to_numpy(), [len(x[0]) for x in bags])[first]
            times = np.concatenate([x[1] for x in bags])[first]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h.view("int64"), n, rep, times)], names=["h", "n", "rep", "times"])

    crowd = apart.select("rep").distinct()
    rows = texts.join(crowd, "rep", "left_semi").select("rep", "text").mapInArrow(counted, "h long, n long, rep long, times long")
    once = rows.groupBy("h").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"), F.min("times").alias("times")).filter("n = 1")
    own = once.groupBy("rep").agg(F.sum("times").alias("own"))
    return stand.select("rep", "size").join(crowd, "rep", "left_semi").join(own, "rep", "left").select("rep", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared"))


def _can_be_near(shared: Column, sizes: Column, least: float) -> Column:
    """Whether an overlap of at most ``shared`` can give the similarity, for two bags whose sizes add up to ``sizes``."""
    return shared * (1 + least) >= sizes * least - 1e-6


def _middle(m: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the member of a split bucket with the smallest share of its own (the head aside), and each other one not in its component."""
    middle = m.groupBy("band", "key").agg(F.min(F.struct(1 - F.col("shared") / F.col("size"), "rep", "c", "size", "shared")).alias("a"))
    near = _can_be_near(F.least("shared", "a.shared"), F.col("size") + F.col("a.size"), least)
    return m.join(middle, ["band", "key"]).filter(F.col("c") != F.col("a.c")).filter(near).select(F.col("a.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _apart(m: DataFrame, stand: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of one bucket that aren't in one component and of which neither is the bucket's smallest (those were checked)."""
    m = m.select("band", "key", "rep", "bits", "c", "size", "shared")
    most = m.groupBy("band", "key").agg(F.min("size").alias("smallest"), F.max(F.col("shared") * (1 + least) - F.col("size") * least).alias("spare"))
    partner = F.greatest(F.col("smallest").cast("double"), F.col("size") * least)  # the smallest that a partner in the bucket can be
    both = m.join(most, ["band", "key"]).filter(_can_be_near(F.col("shared"), F.col("size") + partner, least)).filter(F.col("spare") >= F.col("size") * least - 1e-6).drop("smallest", "spare")
    on = ["band", "key"]
    mixed = both.groupBy(*on).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select(*on)
    both = durable(both.join(mixed, on).join(stand.select("rep", "bands"), "rep"), "near-both")
    a, b = (both.withColumnsRenamed({"rep": x, **{k: f"{k}_{x}" for k in ("c", "bits", "size", "shared", "bands")}}) for x in "ab")
    bits = BANDS * ROWS
    differ = (1 - least) / 2
    unlike = sum(F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(bits // 64))
    near = _can_be_near(F.least("shared_a", "shared_b"), F.col("size_a") + F.col("size_b"), least)
    # who is gone from the first band that a pair shares was checked there or can't be near, so no other band need make the pair
    sooner = reduce(Column.__or__, [(F.col("band") > k) & (F.col("bands_a")[k] == F.col("bands_b")[k]) for k in range(BANDS - 1)])
    like = unlike <= bits * differ + UNLIKE_DEVIATIONS * (bits * differ * (1 - differ)) ** 0.5
    return a.join(b, on).filter("a < b AND c_a <> c_b").filter(near).filter(like).filter(~sooner).select("a", "b")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


QUERIES = {"op2_near_duplicates": op2_near_duplicates}

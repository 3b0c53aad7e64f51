"""Exact top-k by inner product with a vector-approximation file.

The file holds one small cell number for each component of each vector, on a grid of equal integer widths between the
component's extremes. A query's bounds need the cells only: a score lies between what the lower corner of a vector's cell gives
and that plus what the widths can add or take.

1. Blocks of cells (never of vectors) meet blocks of queries; each pair of blocks is one group of bounded size, so neither side is
   broadcast or gathered. A block hands back the vectors whose upper bound reaches its k-th best lower bound.
2. Over all blocks, those whose upper bound doesn't reach the query's k-th best lower bound go.
3. Exact vectors are read for what is left, in the order of upper bounds: first the ``FIRST_READ`` best of each query, then only those whose upper
   bound reaches the k-th exact score so far. After that no unread vector can be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

K, SCALE, EVERY = 5, 256, 50
CELL_BITS = 6
#: Cells and queries in a block, about, and queries looked at together.
BLOCK_ROWS, QUERY_ROWS, AT_ONCE = 65536, 4096, 64
#: Components of the vectors of which so many rows make a block; of longer ones it takes fewer.
BLOCK_DIM = 64
#: Vectors of each query that are read first, in times k.
FIRST_READ = 4
#: Bounds are exact below this; above it they are widened by the rounding of doubles.
_EXACT, _ROUNDING = float(1 << 52), 1e-12
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(col: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), the nearest 64-bit number if it exceeds these; null for a vector that is null or has a null or non-finite component."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    held = lambda x: F.when(x >= float(1 << 63), F.lit(_MOST)).when(x < -float(1 << 63), F.lit(_LEAST)).otherwise(F.floor(x).cast("long"))
    return F.when(col.isNotNull() & finite, F.transform(col, lambda x: held(F.lit(float(scale)) * x.cast("double"))))


def grid(vectors: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """(dim, low, width, high) of vectors (dim, v): arrays of the extremes of each component and of the width of its cells, as doubles."""
    part = vectors.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("high") - F.col("low") + 1) / (1 << bits)).cast("double"))
    rows = F.array_sort(F.collect_list(F.struct("at", "low", width.alias("width"), "high")))  # as many as a vector has components
    return part.groupBy("dim").agg(rows.alias("g")).select("dim", *[F.col(f"g.{f}").alias(f) for f in ("low", "width", "high")])


def cells(v: Column, low: Column, width: Column, bits: int = CELL_BITS) -> Column:
    """Cell numbers of a vector as small integers."""
    number = F.zip_with(F.zip_with(v, low, lambda x, a: x.cast("double") - a), width, lambda d, w: F.floor(d / w))
    return F.transform(number, lambda c: F.least(F.greatest(c, F.lit(0)), F.lit((1 << bits) - 1)).cast("tinyint"))


def bounds(q: Column, low: Column, width: Column, high: Column) -> list[Column]:
    """What a query needs for its bounds on cells c: (scaled, base, above, below); a score lies between base + scaled * c + below and base + scaled * c + above."""
    def add(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, y: a + y)

    span = F.zip_with(F.transform(q, lambda x: x.cast("double")), width, lambda x, w: x * (w - 1))
    size = add(F.zip_with(F.zip_with(low, high, lambda a, b: F.greatest(F.abs(a), F.abs(b))), q, lambda m, x: m * F.abs(x.cast("double"))))
    slack = F.when(size < _EXACT, F.lit(0.0)).otherwise(size * _ROUNDING)
    scaled = F.zip_with(F.transform(q, lambda x: x.cast("double")), width, lambda x, w: x * w)
    base = add(F.zip_with(low, q, lambda a, x: a * x.cast("double")))
    above = add(F.transform(span, lambda x: F.greatest(x, F.lit(0.0)))) + slack
    below = add(F.transform(span, lambda x: F.least(x, F.lit(0.0)))) - slack
    return [scaled.alias("scaled"), base.alias("base"), above.alias("above"), below.alias("below")]


def _bounded(k: int):
    """One block of queries on one block of cells: the vectors that a query must keep, with their bounds. A query's own vector is left out."""

    def bounded(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(q) and len(v):
            own, vector = v.column("own").to_numpy(), v.column("vector").to_numpy()
            mine, query, base, above, below = (q.column(c).to_numpy() for c in ("own", "query", "base", "above", "below"))
            numbers, scaled = _matrix(v.column("cells"), len(v)).astype("float64"), _matrix(q.column("scaled"), len(q))
            for start in range(0, len(q), AT_ONCE):
                for i, b in enumerate(scaled[start : start + AT_ONCE] @ numbers.T, start):
                    b += base[i]
                    b[own == mine[i]] = -np.inf
                    n = int((b > -np.inf).sum())
                    if n:
                        kth = np.partition(b, len(b) - min(k, n))[len(b) - min(k, n)] + below[i]
                        at = np.flatnonzero((b + above[i] >= min(kth, float(_MOST))) & (b > -np.inf))
                        for column, x in zip(out, (np.full(len(at), query[i]), vector[at], b[at] + below[i], b[at] + above[i]), strict=True):
                            column.append(x)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["query", "vector", "lower", "upper"])

    return bounded


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(n, -1) if len(flat) else np.zeros((n, 0))


def inner(a: Column, b: Column) -> Column:
    """The exact inner product of two vectors of whole numbers; beyond 64 bits the nearest 64-bit number."""

    @F.arrow_udf("long")
    def product(x: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for p, q in x:
            out = []
            for k in range(len(p)):
                m, n = p[k].values.to_numpy(), q[k].values.to_numpy()
                large = float(np.abs(m.astype("float64")).max(initial=0)) * float(np.abs(n.astype("float64")).max(initial=0)) * max(1, len(m))
                s = int(m @ n) if large < 1 << 62 else sum(int(i) * int(j) for i, j in zip(m, n, strict=True))
                out.append(max(_LEAST, min(_MOST, s)))
            yield pa.array(out, pa.int64())

    return product(a, b)


def _blocks(rows: DataFrame, size: int) -> int:
    """Into how many blocks of about ``size`` rows (fewer of long vectors) the rows are dealt."""
    n, components = rows.agg(F.count("*"), F.sum("dim")).first()
    return max(1, -(-n // size), -(-(components or 0) // (size * BLOCK_DIM)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """Each query's k best vectors: (query_id, rank, vec_id, score), ties to the smaller id.

    Both inputs hold (vec_id, v: array<long>), and may hold ``row``, a number of the row: then a query never meets the vector of its own
    row, otherwise those of its own id. Rows with a null id or vector take no part; vectors are compared with queries of
    their own length only; repeated rows are candidates each, and queries each where they have a row number (else a query id
    stands once, with its smallest vector). Fewer than k candidates give fewer rows, an empty input gives none. Scores beyond 64 bits count as the
    largest or smallest 64-bit number. Other columns are not read.
    """
    by_row = "row" in queries.columns and "row" in vectors.columns
    known = "vec_id IS NOT NULL AND v IS NOT NULL"
    queries = queries.filter(known)
    if not by_row:
        queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    own = "row" if by_row else "vec_id"
    q = durable(queries.select(F.col(own).alias("own"), "vec_id", "v", F.size("v").alias("dim")).withColumn("query", F.monotonically_increasing_id()), "topk-queries")
    v = durable(vectors.filter(known).select(F.col(own).alias("own"), "vec_id", "v", F.size("v").alias("dim")).withColumn("vector", F.monotonically_increasing_id()), "topk-vectors")
    q_blocks, v_blocks = _blocks(q, QUERY_ROWS), _blocks(v, BLOCK_ROWS)
    g = durable(grid(v), "topk-grid")

    def dealt(df: DataFrame, key: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    on = [F.coalesce(c, F.array().cast("array<double>")) for c in ("low", "width", "high")]  # vectors without components have no grid
    asked = q.join(g, "dim", "left").select("dim", "own", "query", *bounds(F.col("v"), *on))
    filed = v.join(g, "dim", "left").select("dim", "own", "vector", cells(F.col("v"), *on[:2]).alias("cells"))
    keys = ["dim", "qb", "vb"]
    left = dealt(asked, "query", "qb", q_blocks, "vb", v_blocks).groupBy(*keys)
    right = dealt(filed, "vector", "vb", v_blocks, "qb", q_blocks).groupBy(*keys)
    found = durable(left.cogroup(right).applyInArrow(_bounded(k), "query long, vector long, lower double, upper double"), "topk-bounds")

    by_query = Window.partitionBy("query")
    best_lower = found.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("lower")))).filter(F.col("n") <= k)
    least = best_lower.groupBy("query").agg(F.when(F.count("*") == k, F.min("lower")).alias("least"))
    left_over = found.join(least, "query").filter(F.col("least").isNull() | (F.col("upper") >= F.least(F.col("least"), F.lit(float(_MOST)))))
    ranked = durable(left_over.select("query", "vector", "upper", F.row_number().over(by_query.orderBy(F.desc("upper"), "vector")).alias("n")), "topk-candidates")

    def read(pairs: DataFrame) -> DataFrame:
        exact = v.select("vector", "vec_id", F.col("v").alias("x"))
        whole = pairs.select("query", "vector").join(exact, "vector").join(q.select("query", F.col("vec_id").alias("query_id"), F.col("v").alias("y")), "query")
        return whole.select("query", "query_id", "vector", "vec_id", inner(F.col("x"), F.col("y")).alias("score"))

    order = by_query.orderBy(F.desc("score"), "vec_id", "vector")
    first = durable(read(ranked.filter(F.col("n") <= FIRST_READ * k)), "topk-first")
    kth = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("query", F.col("score").cast("double").alias("kth"))
    # a double of the k-th score may be rounded up, so a little less must be reached
    near = kth.withColumn("kth", F.col("kth") - F.abs("kth") * _ROUNDING)
    rest = ranked.filter(F.col("n") > FIRST_READ * k).join(near, "query").filter(F.col("upper") >= F.col("kth"))
    every = first.unionByName(read(rest))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", whole_numbers(F.col("embedding")).alias("v"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


QUERIES = {"op5_vector_topk": op5_vector_topk}
ORACLE = {
    "op5_vector_topk": """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.row <> q.row AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}

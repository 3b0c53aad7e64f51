"""What the corpus operators share: tables, durable intermediate results, batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if the session names no shared folder (tests, one machine).
LOCAL_SHARED = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on one machine a local default if unset, on a cluster an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return path or LOCAL_SHARED


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage so that a lost executor costs a re-read, not a recomputation,
    and an iterative plan does not grow. Files go when the driver process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _REMOVE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_REMOVE: list = []


@atexit.register
def _remove() -> None:
    for spark, path in _REMOVE:
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return


def with_fields(df: DataFrame, value: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with columns taken from fields of one struct, which is computed once; no other column is touched."""
    held = f"_{uuid.uuid4().hex}"
    return df.withColumn(held, value).withColumns({name: F.col(held)[field] for name, field in names.items()}).drop(held)


_TABLES: dict = {}


def worker_tables(key: str, make: Callable):
    """What a Python worker keeps between batches and tasks under ``key``: one thing at a time, so a worker that serves several operators in turn holds the tables of one."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = make()
    return _TABLES[key]


def text_of(col: str = "text") -> Column:
    """The text, a null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one string column holds about ``limit`` bytes in each (one row at least)."""
    import numpy as np

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        a = b.column(column)
        sizes = np.asarray(pc.binary_length(a).fill_null(0)).astype("int64")
        at = np.cumsum(sizes)
        start = 0
        while start < n:
            base = at[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(at, base + limit, "right")))
            yield b.slice(start, end - start)
            start = end
        pa.default_memory_pool().release_unused()

"""Incremental work: snapshot differences, upserts, expiry, and the same as streaming sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, sum): a hash of the named columns, nulls told from empty texts."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]
    return df.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("sum"))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of two checksum tables: added, changed or deleted; equal rows are left out."""
    a, b = old.withColumnRenamed("sum", "old_sum"), new.withColumnRenamed("sum", "new_sum")
    change = F.when(F.col("old_sum").isNull(), "added").when(F.col("new_sum").isNull(), "deleted").when(F.col("old_sum") != F.col("new_sum"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def upsert(state: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The state with incoming rows put in: of a key's rows the one with the greatest ``order``; at a tie the incoming."""
    rows = state.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    cols = [c for c in state.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("b"))
    return best.select(key, *[f"b.{c}" for c in cols])


def expire(state: DataFrame, seen: str, cutoff) -> DataFrame:
    """Rows last seen at the cutoff or later."""
    return state.filter(F.col(seen) >= F.lit(cutoff))


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late`` a streaming input's windows close when the watermark has passed them."""
    if late:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need a zoned time
    out = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sync_stream(stream: DataFrame, path: str, checkpoint: str, key: str, order: str):
    """A running query that folds each micro-batch into the Parquet state at ``path``.

    Each batch writes a new version folder named by its id, so a batch that is run again after a failure writes the same folder from the same predecessor.
    """
    spark = stream.sparkSession

    def fold(batch: DataFrame, epoch: int) -> None:
        state = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch - 1}") if epoch else batch.limit(0)
        upsert(state, batch.dropDuplicates(), key, order).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The state after changes (its columns, ``change`` added, changed or deleted): the last change of a key by ``order`` decides, and a deletion removes it."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("change", *[c for c in state.columns if c != key]), order).alias("b")).select(key, "b.*")
    kept = state.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.filter("change <> 'deleted'").select(*state.columns))


def history(stored: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Every version that was ever seen, once: those stored, and those of the current content that aren't."""
    return stored.unionByName(current.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))

"""A table kept up to date by a stream of keyed deltas: snapshot(t + 1) = apply(snapshot(t), delta(t))."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff as D


def latest(batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """One delta row a key: the last one by ``order``."""
    cols = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("__row")).select(*key, "__row.*")


def merge_stream(deltas: DataFrame, base: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of (key, change_type, new_<payload>, order) to the Parquet versions below ``base``.

    Every batch writes version ``base/v=<batch>`` from the one before it, so a batch that is run again gives the same version: exactly once
    by content. ``base/v=-1`` is the start.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{base}/v={number - 1}")
        D.apply(before, latest(batch, key, order), key).write.mode("overwrite").parquet(f"{base}/v={number}")

    return deltas.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

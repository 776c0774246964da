"""Streaming forms: incremental upserts of tags, and energy by window with late events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_versions(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch appends its keys' last rows under its epoch; writing an epoch again replaces it, so a repeated batch changes nothing."""

    def one(batch: DataFrame, epoch: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table as of now: for each key the row of its last epoch."""
    return latest(spark.read.option("basePath", path).parquet(f"{path}/epoch=*"), keys, "epoch").drop("epoch")


def windowed_energy(stream: DataFrame, time: str, track: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Root mean square by track and window; a window closes ``late`` after its end."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width), track)
        .agg(F.round(F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-9), 6).alias("e"), F.count("*").alias("n"))
        .select(F.col("window.start").alias("start"), track, "e", "n")
    )

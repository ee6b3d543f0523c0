"""Dashboard figures that a stream keeps: mergeable partial sums of each batch, added up when they are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _partial(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))


def keep_figures(stream: DataFrame, keys: Sequence[str], value: str, target: str, checkpoint: str):
    """Start a query that adds each batch's partial sums by the keys to a folder of its own below target.

    A batch that runs again overwrites its folder, so nothing counts twice; a row a key is all that a batch leaves.
    """

    def write(batch: DataFrame, number: int) -> None:
        _partial(batch, keys, value).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def figures(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    """keys, n, mean, least and most over all batches so far."""
    parts = spark.read.parquet(target)
    by = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return by.select(*keys, "n", (F.col("total") / F.col("n")).alias("mean"), "least", "most")


def merge_batches(spark: SparkSession, target: str, new_target: str, keys: Sequence[str]) -> None:
    """Write what all batches add up to as one batch of a new target, from which later ones go on."""
    parts = spark.read.parquet(target)
    by = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    by.write.mode("overwrite").parquet(f"{new_target}/batch=-1")

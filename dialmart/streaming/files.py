"""Files that other systems still write: taken once they have settled, with a quarantine for what can't be read.

A listing of the folder is appended to a log, again and again; the log is the stream.  State is kept by file: its length,
since when it has that length, and whether it was taken.  A file that grows starts anew, one that is gone leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "path string, length long, at timestamp"
_STATE = "length long, since timestamp, taken boolean"
_SETTLED = "path string, length long, settled_at timestamp"


def record_listing(spark: SparkSession, folder: str, log: str, at: str | None = None) -> None:
    """Append what the folder holds now (or at a stated time) to the log; only names and lengths are read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    when = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    files.withColumn("at", when).write.mode("append").json(log)


def settled_files(listings: DataFrame, quiet_seconds: int = 60, lateness: str = "0 seconds", forget_seconds: int = 3600) -> DataFrame:
    """A row for each file once it has had one length for so many seconds, of a stream of LISTING rows.

    A file that is written anew later settles again.  State of a file that no listing names is dropped after forget_seconds.
    """
    quiet = pd.Timedelta(seconds=quiet_seconds)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        length, since, taken = state.get if state.exists else (None, None, False)
        since, out = pd.Timestamp(since) if since is not None else None, []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        for size, at in zip(rows["length"], rows["at"], strict=True):
            if size != length:
                length, since, taken = int(size), at, False
            if not taken and at - since >= quiet:
                taken = True
                out.append((key[0], length, at))
        state.update((length, since.to_pydatetime(), taken))
        last = rows["at"].iloc[-1]
        last = last.tz_localize("UTC") if last.tzinfo is None else last
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + 1000 * forget_seconds, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "settled_at"])

    return (
        listings.withWatermark("at", lateness)
        .groupBy("path")
        .applyInPandasWithState(step, _SETTLED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def take_settled(spark: SparkSession, log: str, schema: str, target: str, quarantine: str, checkpoint: str, quiet_seconds: int = 60):
    """Start a query over the log that reads settled JSON files: good ones to target, broken ones by name to the quarantine.

    A file is broken if one of its lines can't be read by the schema, and then none of it is taken.  A batch that runs again after a
    failure overwrites its own folders.  The names of a batch's files, not their rows, pass the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").distinct().collect()]
        if not paths:
            return
        rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(paths).withColumn("_path", F.col("_metadata.file_path"))
        # the column of broken lines can't be asked for alone, so the rows are written once
        rows.write.mode("overwrite").parquet(f"{target}/read/batch={number}")
        read = spark.read.schema(rows.schema).parquet(f"{target}/read/batch={number}")
        bad = read.where("_broken is not null").groupBy("_path").agg(F.count("*").alias("broken_lines"), F.min("_broken").alias("example"))
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        good = read.join(bad.select("_path"), "_path", "left_anti").drop("_broken")
        good.withColumnRenamed("_path", "path").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")

    listings = spark.readStream.schema(LISTING).json(log)
    writer = settled_files(listings, quiet_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

"""Continuous ingestion: folders watched by file streams, and sessions that stay open between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch_folder(spark: SparkSession, folder: str, schema: str, file_format: str = "json", per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream; each is taken once, by the query's checkpoint."""
    return spark.readStream.format(file_format).schema(schema).option("maxFilesPerTrigger", per_batch).load(folder)


def _newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(key, "_row.*")


def upsert_by_key(stream: DataFrame, key: str, target: str, checkpoint: str, once: bool = True, order: str | None = None):
    """Start a query that writes the newest row of each key of a batch, by order if given, to a folder of its own below target.

    A batch that is run again after a failure overwrites its own folder, so nothing is written
    twice.  latest() reads one row for each key, compact() writes it in the place of all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = _newest(batch, key, [order]) if order else batch
        rows.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def latest(spark: SparkSession, key: str, target: str, order: str | None = None) -> DataFrame:
    """The newest row of each key, by order if given, then by batch."""
    rows = spark.read.parquet(target).drop("batch")
    return _newest(rows, key, [*([order] if order else []), "_batch"]).drop("_batch")


def compact(spark: SparkSession, key: str, target: str, new_target: str, order: str | None = None) -> None:
    """Write one row for each key to a new target, from which batches that come later go on."""
    rows = spark.read.parquet(target).drop("batch")
    _newest(rows, key, [*([order] if order else []), "_batch"]).write.mode("overwrite").parquet(f"{new_target}/batch=-1")


SESSION = "account long, first_at timestamp, last_at timestamp, ops long, banker string"
STATE = "first_at timestamp, last_at timestamp, ops long, banker string"


def stream_sessions(stream: DataFrame, gap_minutes: int = 30, start_op: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Closed sessions of a stream of (account, at, op, banker).

    The rules are those of the batch operator: a longer gap, another agent or the opening code ends
    a session.  The open one waits in state and closes when the watermark has passed the gap.
    """
    gap = pd.Timedelta(minutes=gap_minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        closed = []
        if state.hasTimedOut:
            closed.append((key[0], *now))
            now = None
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for at, op, banker in zip(rows["at"], rows["op"], rows["banker"], strict=True):
                if now is None or at - now[1] > gap or banker != now[3] or op == start_op:
                    if now is not None:
                        closed.append((key[0], *now))
                    now = [at, at, 1, banker]
                else:
                    now = [now[0], max(at, now[1]), now[2] + 1, banker]
            state.update((pd.Timestamp(now[0]).to_pydatetime(), pd.Timestamp(now[1]).to_pydatetime(), int(now[2]), now[3]))
            ends = pd.Timestamp(now[1]) + gap
            ends = ends.tz_localize("UTC") if ends.tzinfo is None else ends
            state.setTimeoutTimestamp(max(int(ends.timestamp() * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["account", "first_at", "last_at", "ops", "banker"])

    return (
        stream.withWatermark("at", lateness)
        .groupBy("account")
        .applyInPandasWithState(step, SESSION, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )

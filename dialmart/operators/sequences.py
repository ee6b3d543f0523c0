"""Ordered-log operators: sessions, islands, gaps, survival, ranks and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

Keys = Sequence[str]


def _running(keys: Keys, order: Keys):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sessionise(
    log: DataFrame, keys: Keys, at: str, order: Keys, gap_minutes: int, changed: Keys = (), starts: Column | None = None
) -> DataFrame:
    """log with session_no, from 1 within keys.

    A row begins a session if it comes more than gap_minutes after the row before (exactly that long
    stays), if one of the changed columns differs from that row's, or if starts holds for it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag(at).over(w).isNull() | (F.lag(at).over(w) + F.expr(f"INTERVAL {gap_minutes} MINUTES") < F.col(at))
    for c in changed:
        new |= ~F.lag(c).over(w).eqNullSafe(F.col(c))
    if starts is not None:
        new |= starts
    return (
        log.withColumn("_new", new.cast("int"))
        .withColumn("session_no", F.sum("_new").over(_running(keys, order)))
        .drop("_new")
    )


def index_rows(rows: DataFrame, keys: Keys, order: Keys, name: str = "contact_index") -> DataFrame:
    """rows with their number from 0 within keys, and is_return for all but the first."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn(name, n).withColumn("is_return", F.col(name) > 0)


def number_groups(rows: DataFrame, key: str, at: str, name: str = "story_no") -> DataFrame:
    """A row for each key with its number from 1 by its first time, ties by key.

    Only the groups' first times are sorted as a whole, by range; the number is a count within the
    range and of the ranges before.
    """
    first = rows.groupBy(key).agg(F.min(at).alias("first_at"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.repartitionByRange(n, "first_at", key).withColumn("_range", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("first_at", key))
    sizes = dealt.groupBy("_range").count()  # of the same exchange, which is planned once
    before = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before"))
    return (
        dealt.withColumn("_inside", inside)
        .join(F.broadcast(before), "_range")  # a row for each range
        .select(key, "first_at", (F.col("_before") + F.col("_inside")).alias(name))
    )


def changed_set(rows: DataFrame, keys: Keys, order: Keys, members: str) -> DataFrame:
    """rows with changed: whether the set differs from the last one before that isn't empty.

    Empty sets neither change anything nor are remembered.
    """
    full = F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members)))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(full, ignorenulls=True).over(before)
    return rows.withColumn("changed", F.coalesce(full.isNotNull() & last.isNotNull() & (full != last), F.lit(False)))


def hand_offs(rows: DataFrame, keys: Keys, order: Keys, label: str) -> DataFrame:
    """The rows whose label differs from the row before, with from_label and to_label."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy(*order))
    moved = rows.withColumn("from_label", before).withColumn("to_label", F.col(label))
    return moved.where("from_label is not null and from_label <> to_label")


def merge_intervals(rows: DataFrame, keys: Keys, lo: str, hi: str, gap: float = 0.0) -> DataFrame:
    """keys, lo and hi of the islands of intervals that lie within gap of each other."""
    order = [lo, hi]
    reach = F.max(hi).over(
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    new = (reach.isNull() | (F.col(lo) > reach + gap)).cast("int")
    marked = rows.withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(_running(keys, order)))
    return marked.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def dead_air(rows: DataFrame, keys: Keys, lo: str, hi: str, more_than: float = 3.0) -> DataFrame:
    """keys and dead_air: the sum of silences of more than so many seconds between anybody's speech."""
    order = [lo, hi]
    reach = F.max(hi).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col(lo) - reach
    silent = rows.withColumn("_gap", F.when(gap > more_than, gap).otherwise(F.lit(0.0)))
    return silent.groupBy(*keys).agg(F.sum("_gap").alias("dead_air"))


def patience(rows: DataFrame, keys: Keys, role: str, lo: str, hi: str, first: str, then: str, most: float = 10.0) -> DataFrame:
    """keys and the median pause between a turn of `first` and the next turn, if `then` speaks it.

    Overlaps are left out and pauses count as `most` at most; on equal times `then` stands first.
    """
    w = Window.partitionBy(*keys).orderBy(lo, hi, F.when(F.col(role) == then, 0).otherwise(1))
    pause = F.col(lo) - F.lag(hi).over(w)
    answered = (F.col(role) == then) & (F.lag(role).over(w) == first) & (pause >= 0)
    found = rows.withColumn("_pause", F.when(answered, F.least(pause, F.lit(most))))
    return found.groupBy(*keys).agg(F.median("_pause").alias("patience"))


def longest_monologue(
    own: DataFrame, others: DataFrame, keys: Keys, row: str, lo: str, hi: str, breaks: float = 1.0
) -> DataFrame:
    """keys and the longest stretch of own speech that no other speech of `breaks` seconds splits.

    Between a segment and the next one by start, other speech is summed up over the gap from the
    segment's own end; a stretch ends at the largest end in it.
    """
    w = Window.partitionBy(*keys).orderBy(lo, hi, row)
    gaps = own.withColumn("_from", F.lag(hi).over(w))
    met = gaps.where(F.col("_from") < F.col(lo)).select(*keys, row, F.col("_from"), F.col(lo).alias("_to")).join(
        others.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi")), list(keys)
    )
    spoken = (
        met.where("_lo < _to and _hi > _from")
        .groupBy(*keys, row)
        .agg(F.sum(F.least("_hi", "_to") - F.greatest("_lo", "_from")).alias("_spoken"))
    )
    marked = gaps.join(spoken, [*keys, row], "left")
    marked = marked.withColumn("_new", (F.coalesce("_spoken", F.lit(0.0)) >= breaks).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(_running(keys, [lo, hi, row])))
    runs = marked.groupBy(*keys, "_run").agg((F.max(hi) - F.min(lo)).alias("_length"))
    return runs.groupBy(*keys).agg(F.max("_length").alias("longest_monologue"))


def smooth_islands(rows: DataFrame, keys: Keys, order: Keys, label: str, length: str, most: float = 0.6) -> DataFrame:
    """rows with a single short element between two equal labels taking theirs, judged on the labels given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    alone = (before == after) & (F.col(label) != before) & (F.col(length) <= most)
    return rows.withColumn("smoothed", F.when(alone, before).otherwise(F.col(label)))


def blocks(rows: DataFrame, keys: Keys, order: Keys, label: str) -> DataFrame:
    """rows with block_no, from 1, of runs of equal labels."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_new", (~F.lag(label).over(w).eqNullSafe(F.col(label)) | F.lag(order[0]).over(w).isNull()).cast("int"))
    return marked.withColumn("block_no", F.sum("_new").over(_running(keys, order))).drop("_new")


def kaplan_meier(rows: DataFrame, keys: Keys, time: str, event: str) -> DataFrame:
    """keys, t, at_risk, events and survival after each time, with the step (0, 1) before.

    Events and censorings at a time share its risk set.
    """
    at = rows.groupBy(*keys, F.col(time).alias("t")).agg(
        F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("events")
    )
    down = Window.partitionBy(*keys).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    risk = at.withColumn("at_risk", F.sum("n").over(down))
    up = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = 1 - F.col("events") / F.col("at_risk")
    # a zero factor has no logarithm, so the survival is put to zero from there on
    dead = F.max((factor <= 0).cast("int")).over(up) == 1
    level = F.when(dead, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(factor > 0, F.log(factor))).over(up)))
    steps = risk.select(*keys, F.col("t").cast("double").alias("t"), "at_risk", "events", level.alias("survival"))
    start = steps.groupBy(*keys).agg(F.max("at_risk").alias("at_risk")).select(
        *keys, F.lit(0.0).alias("t"), "at_risk", F.lit(0).cast("long").alias("events"), F.lit(1.0).alias("survival")
    )
    return start.unionByName(steps.where("t > 0"))


def survival_median(steps: DataFrame, keys: Keys) -> DataFrame:
    """keys and the first time at which survival is a half or less."""
    return steps.groupBy(*keys).agg(F.min(F.when(F.col("survival") <= 0.5 + 1e-12, F.col("t"))).alias("median"))


def average_ranks(rows: DataFrame, keys: Keys, value: str, name: str) -> DataFrame:
    """rows with the average rank of their value among the rows of their keys.

    Equal values are counted first and only they are put in order, so that a key may hold any number of rows.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    placed = ranges.running_totals(counts, keys, [value], F.col("_c"))
    rank = placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(value).alias("_v"), (F.col("before") + (F.col("_c") + 1) / 2).alias(name))
    met = F.col("_v").eqNullSafe(F.col(value))
    for i, k in enumerate(keys):
        met = met & F.col(f"_k{i}").eqNullSafe(F.col(k))
    return rows.join(rank, met).drop("_v", *[f"_k{i}" for i in range(len(keys))])


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, taken from the strata in turn, each in a seeded order.

    No stratum gives more than n rows, so that only so many of each leave their tasks.
    """
    order = F.md5(F.encode(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))), "UTF-8"))
    by = Window.partitionBy(stratum).orderBy(order, key)
    turns = rows.withColumn("turn", F.row_number().over(by).cast("long")).where(F.col("turn") <= n)
    return turns.orderBy("turn", stratum).limit(n)


def distinct_first(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows by order, those of groups not yet seen before the others."""
    again = F.row_number().over(Window.partitionBy(group).orderBy(*order)) > 1
    return rows.withColumn("_again", again).orderBy("_again", *order).limit(n).drop("_again")


def first_appearance(rows: DataFrame, keys: Keys, label: str, at: str) -> DataFrame:
    """keys, label and its index from 0 by its first time."""
    first = rows.groupBy(*keys, label).agg(F.min(at).alias("first_at"))
    order = Window.partitionBy(*keys).orderBy("first_at", label)
    return first.withColumn("label_index", F.row_number().over(order) - 1)

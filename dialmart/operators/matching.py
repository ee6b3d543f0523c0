"""Joins in time and by overlap.

All carry an equality key.  Times meet spans by key and bin of time, next events by one sorted line of time for each
key, so that the rows of a key are not paired with all of its candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

Keys = Sequence[str]


def _renamed(df: DataFrame, keep: Keys, ending: str) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + ending) for c in df.columns])


def first_match(pairs: DataFrame, row: Keys, order: list[Column]) -> DataFrame:
    """The first of the pairs of each row."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*row).orderBy(*order))).where("_n = 1").drop("_n")


def attach_nearest(
    left: DataFrame, points: DataFrame, keys: Keys, row: str, at: str, lo: str, hi: str, point_at: str, tie: str
) -> DataFrame:
    """left with the columns of the nearest point whose window [lo, hi] holds the row's time.

    Both ends count.  Ties of distance go to the earlier point, then by tie.  Rows that no window
    holds keep nulls.
    """
    away = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(point_at).cast("timestamp")))
    held = ranges.held_pairs(left, points, keys, at, lo, hi)
    best = first_match(held, [*keys, row], [away, F.col(point_at), F.col(tie)])
    new = [c for c in points.columns if c not in keys]
    return left.join(best.select(*keys, row, *new), [*keys, row], "left")


def attach_known_or_nearest(
    left: DataFrame, points: DataFrame, keys: Keys, row: str, known: str, at: str, lo: str, hi: str, point_at: str, tie: str
) -> DataFrame:
    """left with the columns of the point whose id (tie) its column known names, else of the nearest point as in attach_nearest.

    An id that no point of the row's keys has counts as none.  by_id says which way it was.
    """
    new = [c for c in points.columns if c not in keys]
    named = points.select(*keys, F.col(tie).alias(known), F.struct(*new).alias("_named"))
    near = attach_nearest(left, points, keys, row, at, lo, hi, point_at, tie).withColumn("_near", F.struct(*new)).drop(*new)
    both = near.join(named, [*keys, known], "left")
    picked = F.when(F.col("_named").isNotNull(), F.col("_named")).otherwise(F.col("_near"))
    out = both.withColumn("_picked", picked).withColumn("by_id", F.col("_named").isNotNull())
    return out.select(*left.columns, *[F.col(f"_picked.{c}").alias(c) for c in new], "by_id")


def nearest_or_all(left: DataFrame, right: DataFrame, key: str, row: str, at: str, other_at: str, seconds: float) -> DataFrame:
    """Pairs by key: the nearest in time if one is within seconds, else all candidates."""
    gap = F.abs(F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(other_at).cast("timestamp"))) / 1e6
    pairs = left.join(right, key).withColumn("gap", gap).withColumn("near", F.col("gap") <= seconds)
    w = Window.partitionBy(key, row)
    best = F.row_number().over(w.orderBy("gap", other_at))
    return (
        pairs.withColumn("any_near", F.max("near").over(w))
        .withColumn("place", best)
        .where("not any_near or place = 1")
        .drop("near", "place")
    )


def majority(votes: DataFrame, key: str, choice: str, order: str) -> DataFrame:
    """key and its most frequent choice; ties go to the one that came first by order."""
    n = votes.groupBy(key, choice).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(choice, "n"), F.struct(F.col("n"), -F.col("_first")))
    return n.groupBy(key).agg(best.alias("_best")).select(key, f"_best.{choice}", "_best.n")


def next_after(
    left: DataFrame, events: DataFrame, keys: Keys, at: str, event_at: str, or_equal: bool = False, name: str = "next_at"
) -> DataFrame:
    """left with the time of the first event of its keys after its own time, or at it if or_equal.

    Events and rows stand in one line of time, and each row looks on to the next event; nothing is
    paired, so many events and rows of one key stay a sort.
    """
    rows = left.withColumn("_event", F.lit(None).cast(dict(events.dtypes)[event_at])).withColumn("_at", F.col(at))
    marks = events.select(*keys, F.col(event_at).alias("_event"), F.col(event_at).alias("_at"), F.lit(True).alias("_mark"))
    line = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    # at equal times an event counts for a row that stands before it
    turn = F.when(F.col("_mark"), 1 if or_equal else 0).otherwise(0 if or_equal else 1)
    # read backwards, the window only grows
    back = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc(turn)).rowsBetween(Window.unboundedPreceding, -1)
    found = line.withColumn(name, F.last("_event", ignorenulls=True).over(back))
    return found.where(~F.col("_mark")).select(*left.columns, name)


def first_action(left: DataFrame, actions: DataFrame, keys: Keys, row: str, after: str, until: str, at: str, how: str) -> DataFrame:
    """left with the earliest action (time and kind) in (after, until]; ties by kind."""
    # the first of all after the row is the only one that can count
    kinds = actions.groupBy(*keys, F.col(at).alias("_first")).agg(F.min(how).alias("_how"))
    found = next_after(left, actions.select(*keys, at), keys, after, at, False, "_first").join(kinds, [*keys, "_first"], "left")
    within = F.col("_first") <= F.col(until)
    return found.select(*left.columns, F.when(within, F.col("_first")).alias("action_at"), F.when(within, F.col("_how")).alias("action"))


def first_containing(left: DataFrame, spans: DataFrame, keys: Keys, row: str, at: str, lo: str, hi: str, tie: str) -> DataFrame:
    """left with the earliest span of its keys that holds its time, both ends included."""
    held = ranges.held_pairs(left, spans, keys, at, lo, hi)
    best = first_match(held, [*keys, row], [F.col(lo), F.col(tie)])
    new = [c for c in spans.columns if c not in keys]
    return left.join(best.select(*keys, row, *new), [*keys, row], "left")


def label_by_overlap(rows: DataFrame, regions: DataFrame, keys: Keys, row: str, lo: str, hi: str, label: str) -> DataFrame:
    """rows with the label they overlap most in sum, or that of the nearest region by midpoint.

    Ties go to the region that starts first.
    """
    other = _renamed(regions, [*keys, label], "_r")
    pairs = rows.join(other, list(keys))
    shared = F.greatest(F.lit(0.0), F.least(hi, hi + "_r") - F.greatest(lo, lo + "_r"))
    away = F.abs((F.col(lo) + F.col(hi)) / 2 - (F.col(lo + "_r") + F.col(hi + "_r")) / 2)
    sums = pairs.groupBy(*keys, row, label).agg(
        F.sum(shared).alias("shared"), F.min(away).alias("away"), F.min(lo + "_r").alias("starts")
    )
    order = [F.desc("shared"), F.when(F.col("shared") > 0, F.lit(0.0)).otherwise(F.col("away")), F.col("starts"), F.col(label)]
    best = first_match(sums, [*keys, row], order)
    return rows.join(best.select(*keys, row, label, "shared"), [*keys, row], "left")


def interruptions(onsets: DataFrame, spoken: DataFrame, keys: Keys, row: str, lo: str, hi: str, speaking: float = 1.0, overlap: float = 0.5) -> DataFrame:
    """keys and how often an onset cuts into the other's speech.

    Of the segments that hold the onset (end excluded) only the first in input order is judged: it
    must have gone on for `speaking` seconds and share `overlap` seconds with the onset's segment.
    """
    other = _renamed(spoken, keys, "_o")
    held = onsets.join(other, list(keys)).where((F.col(lo) >= F.col(lo + "_o")) & (F.col(lo) < F.col(hi + "_o")))
    first = first_match(held, [*keys, row], [F.col(row + "_o")])
    long = (F.col(lo) - F.col(lo + "_o") >= speaking) & (F.least(hi, hi + "_o") - F.col(lo) >= overlap)
    return first.groupBy(*keys).agg(F.sum(long.cast("long")).alias("interruptions"))


def median_of_others(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows (one for each key) with others: the median value of all other rows, from ranks alone.

    With the values in line, leaving one out moves the middle by a place at most, so three places
    of the line answer for every row and no pairs are made.
    """
    n = rows.agg(F.count("*").alias("_n"))
    placed = ranges.running_totals(rows, [], [value, key], F.lit(1)).withColumn("_place", (F.col("before") + 1).cast("long")).drop("before")
    placed = placed.crossJoin(F.broadcast(n))  # one row
    middle = placed.select(value, "_place", "_n").where(F.abs(F.col("_place") - (F.col("_n") + 1) / 2) <= 2)
    line = middle.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("_place").cast("long"), F.col(value)))).alias("_line"))
    rest = F.col("_n") - 1
    low, high = F.floor((rest + 1) / 2), F.ceil((rest + 1) / 2)
    at = lambda k: F.element_at("_line", F.when(F.col("_place") <= k, k + 1).otherwise(k).cast("long"))
    joined = placed.crossJoin(F.broadcast(line))  # one row
    return joined.withColumn("others", F.when(rest > 0, (at(low) + at(high)) / 2)).drop("_n", "_place", "_line")


def compare_multisets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, only_a and only_b: rows that one side has more often than the other, by key."""
    both = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("_d").alias("_d"))
    return (
        net.where("_d <> 0")
        .groupBy(key)
        .agg(
            F.sum(F.greatest("_d", F.lit(0))).alias("only_a"),
            F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("only_b"),
        )
    )

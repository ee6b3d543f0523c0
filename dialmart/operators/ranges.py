"""Order over whole tables without one task that holds them: running totals by ranges, exact quantiles, and binned spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

Keys = Sequence[str]


def running_totals(rows: DataFrame, keys: Keys, order: Keys, amount: Column, name: str = "before") -> DataFrame:
    """rows with the sum of amount over the rows of the same keys that stand before them.

    Rows are dealt and sorted by ranges of keys and order and written once, as the ranges are drawn anew by each run;
    a row for each range and keys in it says what stands before the range.  A key is split over as many ranges as it fills.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_amount", amount).repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = scratch.written(dealt.withColumn("_number", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("_range", F.shiftright("_number", 33))
    line = Window.partitionBy("_range", *keys).orderBy("_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum("_amount").over(line) - F.col("_amount")
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    totals = dealt.groupBy("_range", *keys).agg(F.sum("_amount").alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_sum")
    totals = totals.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], earlier.alias("_earlier"))
    met = F.col("_r") == F.col("_range")
    for s in same:
        met = met & s
    found = dealt.withColumn("_inside", inside).join(totals, met)
    return found.select(*rows.columns, (F.col("_inside") + F.col("_earlier")).alias(name))


def exact_quantiles(rows: DataFrame, keys: Keys, value: str, shares: dict[str, float]) -> DataFrame:
    """keys and quantiles of the value by linear interpolation, one column for each name in shares; nulls don't count.

    Equal values are one row before they are put in order, and the two places that a quantile lies between are looked up
    among the running counts, so that no buffer holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    placed = running_totals(counts, keys, ["_v"], F.col("_c"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    named = totals.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_n")
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(f"_t{i}").eqNullSafe(F.col(k))
    joined = placed.join(named, met) if keys else placed.crossJoin(F.broadcast(named))  # one row
    at = {c: (F.col("_n") - 1) * F.lit(p) for c, p in shares.items()}
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("_c"))
    of = lambda k: F.max(F.when(holds(k), F.col("_v")))
    part = lambda k: F.max(k - F.floor(k))
    return joined.groupBy(*keys).agg(*[(of(F.floor(k)) + (of(F.ceil(k)) - of(F.floor(k))) * part(k)).alias(c) for c, k in at.items()])


def held_pairs(rows: DataFrame, spans: DataFrame, keys: Keys, at: str, lo: str, hi: str, seconds: int = 3600) -> DataFrame:
    """rows joined with the spans of their keys that hold their time, both ends included.

    Both meet by keys and a bin of so many seconds, so a row is compared with the spans that reach into its bin and not
    with all of its keys.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bin_of = lambda c: F.floor(micros(c) / F.lit(seconds * 1_000_000))
    binned = spans.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    return rows.withColumn("_bin", bin_of(at)).join(binned, [*keys, "_bin"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_bin")

"""Score cards: weighted totals with a gate, where points are lost, groups and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: Weight of each dimension and the dimensions whose low score caps the total.
Rubric = dict[str, float]
CAP, LOW = 59.0, 2


def raw_total(rubric: Rubric, score=F.col) -> Column:
    return sum((score(d) - 1) / 4 * (100 * w) for d, w in rubric.items())


def failed_gates(gates: Sequence[str]) -> Column:
    """The names of the gates with a low score, in rubric order."""
    return F.filter(F.array(*[F.when(F.col(g) <= LOW, F.lit(g)) for g in gates]), lambda g: g.isNotNull())


def weighted_total(cards: DataFrame, rubric: Rubric, gates: Sequence[str]) -> DataFrame:
    """cards with raw, failed (gates) and total, which a failed gate caps."""
    failed = failed_gates(gates)
    raw = raw_total(rubric)
    total = F.when(F.size(failed) > 0, F.least(raw, F.lit(CAP))).otherwise(raw)
    return cards.withColumns({"raw": raw, "failed": failed, "total": total})


def lost_points(cards: DataFrame, rubric: Rubric, gates: Sequence[str]) -> DataFrame:
    """dim and the points that cards lose by it: its share of 100 - raw, and of the gates' cuts.

    A cut is split evenly among the failed gates, so that all points lost add up to 100 - total.
    """
    scored = weighted_total(cards, rubric, gates)
    cut = (F.col("raw") - F.col("total")) / F.size("failed")
    parts = [
        F.struct(
            F.lit(d).alias("dim"),
            ((5 - F.col(d)) / 4 * (100 * w)).alias("own"),
            F.when(F.array_contains("failed", d), cut).otherwise(F.lit(0.0)).alias("gate"),
        )
        for d, w in rubric.items()
    ]
    long = scored.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
    return long.groupBy("dim").agg(F.sum("own").alias("lost"), F.sum("gate").alias("lost_by_gate"))


def floor_gain(cards: DataFrame, rubric: Rubric, gates: Sequence[str], least: int = 3) -> DataFrame:
    """dim, the mean gain in total if no card had less than `least` there, and the cards it would lift."""
    scored = weighted_total(cards, rubric, gates)
    out = []
    for d in rubric:
        expr = raw_total(rubric, lambda c, d=d: F.greatest(F.col(c), F.lit(least)) if c == d else F.col(c))
        low = [F.col(g) <= LOW for g in gates if g != d]
        still = low[0] if low else F.lit(False)
        for x in low[1:]:
            still |= x
        if d not in gates:
            still = F.size("failed") > 0
        new = F.when(still, F.least(expr, F.lit(CAP))).otherwise(expr)
        out.append(F.struct(F.lit(d).alias("dim"), (new - F.col("total")).alias("gain"), (F.col(d) < least).cast("long").alias("low")))
    long = scored.select(F.explode(F.array(*out)).alias("p")).select("p.*")
    return long.groupBy("dim").agg(F.avg("gain").alias("gain"), F.sum("low").alias("cards"))


def long_scores(cards: DataFrame, keep: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """A row for each card and dimension; order is the dimension's place in the rubric."""
    parts = [F.struct(F.lit(i).alias("dim_order"), F.lit(d).alias("dim"), F.col(d).alias("score")) for i, d in enumerate(dims)]
    return cards.select(*keep, F.explode(F.array(*parts)).alias("p")).select(*keep, "p.*")


def agent_profile(long: DataFrame, agent: str) -> DataFrame:
    """agent, strongest and weakest dimension by mean score; ties go to the rubric's order."""
    means = long.groupBy(agent, "dim", "dim_order").agg(F.avg("score").alias("mean"))
    return means.groupBy(agent).agg(
        F.max_by("dim", F.struct("mean", -F.col("dim_order"))).alias("strongest"),
        F.min_by("dim", F.struct("mean", "dim_order")).alias("weakest"),
    )


def weakest_dimension(long: DataFrame, keys: Sequence[str], gates: Sequence[str]) -> DataFrame:
    """keys and the dimension with the lowest score, gates left out; ties go to the rubric's order."""
    others = long.where(~F.col("dim").isin(*gates) & F.col("score").isNotNull())
    return others.groupBy(*keys).agg(F.min_by("dim", F.struct("score", "dim_order")).alias("weakest"))


def concentration(cards: DataFrame, agent: str, failed: Column, share: float = 0.2) -> DataFrame:
    """agents, fails, focus_agents (the top share by fails) and focus_share of the fails."""
    by = cards.groupBy(agent).agg(F.sum(failed.cast("long")).alias("fails"))
    k = by.agg(F.greatest(F.lit(1), F.round(F.count("*") * share)).cast("long").alias("k"))
    line = ranges.running_totals(by.withColumn("_least", -F.col("fails")), [], ["_least", agent], F.lit(1))
    placed = line.select("fails", (F.col("before") + 1).alias("place")).crossJoin(F.broadcast(k))  # one row
    return placed.agg(
        F.count("*").alias("agents"),
        F.sum("fails").alias("fails"),
        F.max("k").alias("focus_agents"),
        (F.sum(F.when(F.col("place") <= F.col("k"), F.col("fails"))) / F.sum("fails")).alias("focus_share"),
    )


def newest_cohort(cards: DataFrame, version: str, at: str, tie: str) -> DataFrame:
    """The cards of the version that the newest card has."""
    newest = cards.agg(F.max_by(version, F.struct(F.col(at), -F.col(tie))).alias("_v"))
    return cards.join(F.broadcast(newest), F.col(version) == F.col("_v"), "left_semi")  # one row


def fold_rare(rows: DataFrame, key: str, least: int = 5, share: float = 0.01) -> DataFrame:
    """rows with bucket: the key, or other where it has fewer than `least` rows and than its share of all."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    floor = F.greatest(F.lit(float(least)), F.sum("_n").over(Window.partitionBy()) * share)
    named = n.select(F.col(key).alias("_k"), F.when(F.col("_n") >= floor, F.col(key).cast("string")).otherwise("other").alias("bucket"))
    return rows.join(named, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")

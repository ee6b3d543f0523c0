"""Findings as a table of rules over long-form figures, ranked with a limit for each section.

A figure is a row (topic, item, metrics): the metrics are a map of names to numbers.  A rule names a topic, conditions
on metrics, which items it looks at (all, or the one with the largest or smallest metric), a section, a severity and what
it weighs.  Rules are rows too, so a new rule is a new row.  The rule table is bounded by who writes it and goes to all
tasks; figures are joined with it by topic.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "positive", "info")
PROBLEMS = ("critical", "high", "medium")
#: Problems in a summary, and all of it.
SUMMARY = (4, 5)
COMPARISONS = (">=", ">", "<=", "<", "=")


@dataclass(frozen=True)
class Rule:
    """pick: ("max" or "min", metric), or none for all items.  A finding weighs scale times the metric (its size, whatever its sign), or scale."""

    key: str
    topic: str
    section: str
    severity: str
    when: tuple[tuple[str, str, float], ...] = ()
    pick: tuple[str, str] | None = None
    weight: str | None = None
    scale: float = 1.0
    title: str = "{item}"


_SCHEMA = (
    "rule string, topic string, section string, severity string, rank int, conditions array<struct<metric:string,op:string,value:double>>, "
    "pick string, pick_by string, weigh string, scale double, title string"
)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    for r in rules:
        if r.severity not in SEVERITIES or any(op not in COMPARISONS for _, op, _ in r.when) or (r.pick and r.pick[0] not in ("max", "min")):
            raise ValueError(f"rule {r.key} can't be read")
    rows = [
        (r.key, r.topic, r.section, r.severity, SEVERITIES.index(r.severity), [(m, op, float(v)) for m, op, v in r.when], r.pick and r.pick[0], r.pick and r.pick[1], r.weight, float(r.scale), r.title)
        for r in rules
    ]
    return spark.createDataFrame(rows, _SCHEMA)


def figures(df: DataFrame, topic: str, item: Column | str, metrics: dict[str, Column | str]) -> DataFrame:
    """Rows (topic, item, metrics) of a table with a column for each metric; null metrics are left out."""
    col = lambda c: (F.col(c) if isinstance(c, str) else c)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), col(v).cast("double").alias("value")) for k, v in metrics.items()])
    return df.select(F.lit(topic).alias("topic"), col(item).cast("string").alias("item"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metrics"))


def _holds(c: Column) -> Column:
    x = F.col("metrics")[c["metric"]]
    met = F.when(c["op"] == ">=", x >= c["value"]).when(c["op"] == ">", x > c["value"]).when(c["op"] == "<=", x <= c["value"]).when(c["op"] == "<", x < c["value"]).otherwise(x == c["value"])
    return F.coalesce(met, F.lit(False))  # a figure that isn't known meets nothing


def all_findings(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """section, severity, rule, topic, item, weight, title and rank (of the severity) of every rule that holds."""
    met = facts.join(F.broadcast(rules), "topic")
    by = F.when(F.col("pick") == "max", -F.col("metrics")[F.col("pick_by")]).otherwise(F.col("metrics")[F.col("pick_by")])
    # the item to look at: per rule one row goes on from each task
    picked = met.where("pick is not null").withColumn("_by", by).where("_by is not null")
    one = picked.groupBy("rule", "severity", "topic", "section").agg(F.min_by(F.struct(*met.columns), F.struct("_by", "item")).alias("r")).select("r.*")
    rows = met.where("pick is null").unionByName(one.select(met.columns))
    rows = rows.where(F.forall("conditions", _holds))
    weight = F.col("scale") * F.coalesce(F.abs(F.col("metrics")[F.col("weigh")]), F.lit(1.0))
    return rows.select("section", "severity", "rule", "topic", "item", F.round(weight, 6).alias("weight"), F.replace("title", F.lit("{item}"), F.col("item")).alias("title"), "rank")


def ranked_findings(facts: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """The findings of each section in order of severity, then weight, then rule and item, with their place; at most so many a section."""
    order = Window.partitionBy("section").orderBy("rank", F.desc("weight"), "rule", "item")
    found = all_findings(facts, rules).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return found.select("section", "place", "severity", "rule", "item", "weight", "title")


def summary(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """The gravest problems and the strongest good news, filled up with what comes next; information is left out."""
    problems, most = SUMMARY
    order = ["rank", F.desc("weight"), "rule", "item"]
    found = all_findings(facts, rules).where("severity <> 'info'")
    bad = F.col("severity").isin(*PROBLEMS)
    # no section has more than `most` in the summary, so the window below is over a few rows
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("section", "severity").orderBy(*order))).where(F.col("_n") <= most)
    within = F.row_number().over(Window.partitionBy(bad.alias("_bad")).orderBy(*order))
    first = found.withColumn("_place", within).withColumn("_first", (bad & (F.col("_place") <= problems)) | (~bad & (F.col("_place") == 1)))
    taken = first.withColumn("_turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_first"), *order))).where(F.col("_turn") <= most)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return taken.select(place.alias("place"), "section", "severity", "rule", "item", "weight", "title")

"""Dialog assembly: stereo merge, roles and numbered views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_channels(agent: DataFrame, customer: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Both channels' segments as numbered turns by time; on equal times the agent stands first."""
    both = agent.withColumn("role", F.lit("agent")).unionByName(customer.withColumn("role", F.lit("customer")))
    order = Window.partitionBy(*keys).orderBy(lo, hi, "role")
    return both.withColumn("turn_no", F.row_number().over(order))


def talk_shares(segments: DataFrame, keys: Sequence[str], role: str, lo: str, hi: str, words: str, agent: str, customer: str) -> DataFrame:
    """keys, turns, agent_speech, customer_speech, talk_ratio (of both) and wpm; a segment that ends before it starts has no length."""
    length = F.greatest(F.lit(0.0), F.col(hi) - F.col(lo))
    of = lambda who: F.coalesce(F.sum(F.when(F.col(role) == who, length)), F.lit(0.0))
    both = of(agent) + of(customer)
    total = F.sum(length)
    return segments.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        of(agent).alias("agent_speech"),
        of(customer).alias("customer_speech"),
        F.when(both > 0, of(agent) / both).otherwise(0.0).alias("talk_ratio"),
        F.when(total > 0, F.sum(words) / total * 60).otherwise(0.0).alias("wpm"),
    )


def is_uncertain(probabilities: Column, least: float, share: float = 0.3) -> Column:
    """Whether more than a share of the words of a turn were heard with less than the least probability."""
    low = F.size(F.filter(probabilities, lambda p: p < least))
    return (F.size(probabilities) > 0) & (low / F.greatest(F.size(probabilities), F.lit(1)) > share)


def transcript_quality(segments: DataFrame, keys: Sequence[str], logprob: str, low: float) -> DataFrame:
    """keys, segments, mean_logprob and low_confidence_ratio (of all segments, those below low)."""
    return segments.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.round(F.avg(logprob), 4).alias("mean_logprob"),
        F.round(F.count_if(F.col(logprob) < low) / F.count("*"), 4).alias("low_confidence_ratio"),
    )


def part_of(start: Column, end: Column, bounds: Column) -> tuple[Column, Column]:
    """The number from 1 of the last part [lo, hi) that holds the start, and whether a bound but the last is passed."""
    held = F.filter(F.transform(bounds, lambda b, i: F.when((b["lo"] <= start) & (start < b["hi"]), i + 1)), lambda i: i.isNotNull())
    inner = F.slice(bounds, F.lit(1), F.greatest(F.size(bounds) - 1, F.lit(0)))
    return F.try_element_at(held, F.lit(-1)), F.exists(inner, lambda b: (start < b["hi"]) & (b["hi"] < end))


def evidence_pieces(text: Column, quotes: Column) -> Column:
    """The text as an array of (text, dim): what a quote (quote, dim) cites has its dim, and of overlapping quotes the first counts."""

    @F.pandas_udf("array<struct<text: string, dim: string>>")
    def cut(texts, cited):
        import pandas as pd

        def one(t, quotes):
            taken = [None] * len(t)  # the dimension and the place of the mark that holds each letter
            for q in quotes:
                at = t.find(q["quote"]) if q["quote"] else -1
                while at >= 0:
                    end = at + len(q["quote"])
                    if not any(taken[at:end]):
                        taken[at:end] = [(q["dim"], at)] * (end - at)
                    at = t.find(q["quote"], at + 1)
            out, begin = [], 0
            for i in range(1, len(t) + 1):
                if i == len(t) or taken[i] != taken[begin]:
                    out.append({"text": t[begin:i], "dim": taken[begin] and taken[begin][0]})
                    begin = i
            return out

        return pd.Series([None if t is None else one(t, q if q is not None else []) for t, q in zip(texts, cited, strict=True)])

    return cut(text, quotes)


def clock(seconds: Column) -> Column:
    """Seconds as mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def transcript(turns: DataFrame, keys: Sequence[str], order: str, role: str, text: str, start: str, most: int | None = None) -> DataFrame:
    """keys, lines (numbered "n [mm:ss] role: text") and n_lines.

    With `most`, only the first and last halves of so many lines stand, with a line between that says
    how many are left out.
    """
    n = Window.partitionBy(*keys)
    number = F.row_number().over(n.orderBy(order))
    rows = turns.withColumn("_n", number).withColumn("_all", F.count("*").over(n))
    line = F.concat(F.col("_n").cast("string"), F.lit(" ["), clock(F.col(start)), F.lit("] "), F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    if most:
        head = (most + 1) // 2
        gone = F.col("_all") - most
        rows = rows.where((F.col("_all") <= most) | (F.col("_n") <= head + 1) | (F.col("_n") > F.col("_all") - (most - head)))
        cut = (F.col("_all") > most) & (F.col("_n") == head + 1)
        line = F.when(cut, F.concat(F.lit("... "), gone.cast("string"), F.lit(" lines left out ..."))).otherwise(line)
    parts = F.array_sort(F.collect_list(F.struct("_n", line.alias("_line"))))
    return rows.groupBy(*keys).agg(F.transform(parts, lambda p: p["_line"]).alias("lines"), F.max("_all").alias("n_lines"))


def unique_ids(rows: DataFrame, base: str, order: str, name: str = "unique_id") -> DataFrame:
    """rows with ids of which the second and later uses carry -2, -3, ... by order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))


def first_direction(contacts: DataFrame, messages: DataFrame, key: str, at: str, direction: str) -> DataFrame:
    """contacts whose unknown direction is that of their first message."""
    first = messages.where(F.col(direction).isNotNull()).groupBy(key).agg(F.min_by(direction, at).alias("_d"))
    return contacts.join(first, key, "left").withColumn(direction, F.coalesce(direction, "_d")).drop("_d")

"""Where a recording must be silent: personal data in a call's text, mapped to the times of its words.

Spans and words both have places in the call's joined text; they meet by call and a bin of places, and a span's silence
reaches from its first word to its last.  A turn in which fewer spans were found among timed words than its text
holds is silent as a whole, so the recording is never less silent than the text is masked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import redaction

#: Seconds before and after a silence, and signs of a bin of places.
PAD = 0.15
BIN = 64


def _bins(lo: Column, hi: Column) -> Column:
    return F.sequence(F.floor(lo / BIN), F.floor((hi - 1) / BIN))


def masked_times(turns: DataFrame, words: DataFrame, keys: Sequence[str], turn: str = "turn", text: str = "text", start: str = "start_s", end: str = "end_s") -> DataFrame:
    """keys, begin_s and end_s of the silences of each call, in order and without overlap.

    turns has the keys, turn, text, start and end; words has the keys, turn, word (from 0, as white space cuts the text), t0 and t1
    for words whose times are known.  A call's turns are read as one text, so a number that two turns share is one span.
    """
    rows = turns.select(*keys, F.col(turn).alias("turn"), F.coalesce(text, F.lit("")).alias("text"), F.col(start).alias("start_s"), F.col(end).alias("end_s"))
    before = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    calls = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    spans = calls.select(*keys, F.posexplode(redaction.spans(joined)).alias("span", "s")).select(*keys, "span", F.col("s.start").alias("s0"), F.col("s.end").alias("s1"))
    spans = spans.select("*", F.explode(_bins(F.col("s0"), F.col("s1"))).alias("bin"))

    said = rows.select(*keys, "turn", "at", F.posexplode(redaction.located(F.col("text"), r"\S+")).alias("word", "w"))
    said = said.select(*keys, "turn", "word", (F.col("at") + F.col("w.start")).alias("w0"), (F.col("at") + F.col("w.start") + F.length("w.hit")).alias("w1"))
    timed = said.join(words.select(*keys, "turn", "word", "t0", "t1"), [*keys, "turn", "word"])
    timed = timed.select("*", F.explode(_bins(F.col("w0"), F.col("w1"))).alias("bin"))
    hits = spans.join(timed, [*keys, "bin"]).where("s0 < w1 and w0 < s1")
    ranges = hits.groupBy(*keys, "span").agg((F.min("t0") - PAD).alias("begin_s"), (F.max("t1") + PAD).alias("end_s"))

    # per turn: the spans that its text holds, and those of them that a timed word of it tells
    touched = rows.select(*keys, "turn", "start_s", "end_s", F.col("at").alias("a0"), (F.col("at") + F.length("text")).alias("a1")).where("a1 > a0")
    touched = touched.select("*", F.explode(_bins(F.col("a0"), F.col("a1"))).alias("bin"))
    required = touched.join(spans, [*keys, "bin"]).where("s0 < a1 and a0 < s1").groupBy(*keys, "turn").agg(F.count_distinct("span").alias("required"), F.first("start_s").alias("start_s"), F.first("end_s").alias("end_s"))
    told = hits.groupBy(*keys, "turn").agg(F.count_distinct("span").alias("located"))
    short = required.join(told, [*keys, "turn"], "left").where("required > coalesce(located, 0)")
    whole = short.select(*keys, (F.col("start_s") - PAD).alias("begin_s"), (F.col("end_s") + PAD).alias("end_s"))

    every = ranges.select(*keys, "begin_s", "end_s").unionByName(whole)
    line = Window.partitionBy(*keys).orderBy("begin_s", "end_s")
    reach = F.max("end_s").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = every.withColumn("_new", F.coalesce(F.col("begin_s") > reach, F.lit(True)).cast("int"))
    island = opened.withColumn("_n", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_n").agg(F.min("begin_s").alias("begin_s"), F.max("end_s").alias("end_s")).drop("_n")

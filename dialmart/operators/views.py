"""What a reader of limited length is shown of a call: cue lines with their neighbours, or both ends, within a budget.

Everything is a window over a call's numbered lines.  A line belongs to the first cue whose neighbourhood holds it,
so what the cues up to some place cost is a running sum, and the cues that fit are those before the last that does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines kept at either end, and on either side of a cue; what a gap costs in signs.
HEAD = TAIL = 6
AROUND = 2
GAP = 32
#: The share of an elided view that its opening gets.
OPENING = (2, 3)
ELISION = "[... the middle is left out for length ...]"


def fold(text: Column) -> Column:
    """Lower noise for matching cues: no vowel points, no punctuation, single spaces."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[֑-ׇ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{M}\p{Nd}_\s]", " "), r"\s+", " "))


def phrase_hits(texts: DataFrame, keys: Sequence[str], text: str, phrases: DataFrame) -> DataFrame:
    """keys, topic and n: how often phrases (topic, phrase) of any number stand in each folded text, as whole words.

    Texts are cut into runs of as many words as phrases have, and these are joined with the table; a phrase that is listed
    twice under a topic counts once.
    """
    wanted = phrases.select("topic", fold(F.col("phrase")).alias("gram")).where("gram <> ''").distinct()
    wanted = wanted.withColumn("words", F.size(F.split("gram", " ")))
    lengths = [r.words for r in wanted.select("words").distinct().orderBy("words").limit(64).collect()]  # words of a phrase, a few numbers
    words = texts.select(*keys, F.filter(F.split(fold(F.col(text)), " "), lambda w: w != "").alias("_w"))

    def runs(n: int) -> Column:
        places = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice("_w", i, n), " "))

    grams = words.select(*keys, F.explode(F.concat(*[runs(n) for n in lengths] or [F.array().cast("array<string>")])).alias("gram"))
    counted = grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    return counted.join(wanted, "gram").groupBy(*keys, "topic").agg(F.sum("n").alias("n"))


def budgeted(lines: DataFrame, keys: Sequence[str], number: str, size: str, cue: str, most: int, head: int = HEAD, tail: int = TAIL, around: int = AROUND) -> DataFrame:
    """lines with kept: what of a call is shown within `most` signs.

    number counts a call's lines from 1, size is what a line takes, cue (boolean) says whether it is one.  A call that fits, or has no
    more than head and tail, is kept whole.  Else both ends are kept, then the neighbourhoods of cues in order until one does not fit.
    """
    call = Window.partitionBy(*keys)
    near = call.orderBy(number)
    n = F.col(number)
    rows = lines.withColumns({"_n": F.count("*").over(call), "_whole": F.sum(size).over(call)})
    end = (n <= head) | (n > F.col("_n") - tail)
    rows = rows.withColumns({"_end": end, "_cue": F.coalesce(F.col(cue), F.lit(False)) & ~end})
    rows = rows.withColumn("_first", F.min(F.when(F.col("_cue"), n)).over(near.rangeBetween(-around, around)))
    taken = F.when(~F.col("_end") & F.col("_first").isNotNull(), F.col(size)).otherwise(0)
    ends = F.sum(F.when(F.col("_end"), F.col(size)).otherwise(0)).over(call) + GAP
    spent = F.sum(taken).over(near.rangeBetween(Window.unboundedPreceding, around)) + GAP * F.sum(F.col("_cue").cast("int")).over(near.rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_fits", F.col("_cue") & (ends + spent <= most))
    last = F.max(F.when(F.col("_fits"), n)).over(call)
    some = F.col("_end") | F.coalesce(F.col("_first") <= F.col("_last"), F.lit(False))
    whole = (F.col("_whole") <= most) | (F.col("_n") <= head + tail)
    return rows.withColumn("_last", last).withColumn("kept", whole | some).drop("_n", "_whole", "_end", "_cue", "_first", "_fits", "_last")


def elided(lines: DataFrame, keys: Sequence[str], number: str, line: str, most: int) -> DataFrame:
    """keys and text: the lines of a call, or its opening and its closing around a mark, in `most` signs.

    The opening gets two thirds of what is left beside the mark, the closing the rest.
    """
    room = max(0, most - len(ELISION) - 2)
    opening = room * OPENING[0] // OPENING[1]
    call = Window.partitionBy(*keys)
    up, down = (call.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col(number), F.desc(number)))
    size = F.length(line) + 1
    rows = lines.withColumns({"_all": F.sum(size).over(call) - 1, "_upto": F.sum(size).over(up), "_from": F.sum(size).over(down)})
    head = F.col("_upto") <= opening
    rows = rows.withColumn("_part", F.when(F.col("_all") <= most, 0).when(head, 0).when(F.col("_from") <= room - opening, 2))
    cut = F.when((F.col("_part") == 2) & (F.row_number().over(call.orderBy("_part", number)) == F.count_if(F.coalesce(F.col("_part") == 0, F.lit(False))).over(call) + 1), F.lit(0))
    kept = rows.where("_part is not null").withColumn("_mark", cut.isNotNull())
    shown = F.when(F.col("_mark"), F.concat(F.lit(f"{ELISION}\n"), F.col(line))).otherwise(F.col(line))
    texts = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), shown.alias("line")))).alias("_l"))
    found = texts.select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
    return lines.select(*keys).distinct().join(found, list(keys), "left").withColumn("text", F.coalesce("text", F.lit("")))


def rendered(lines: DataFrame, keys: Sequence[str], number: str, line: str) -> DataFrame:
    """keys, text and lines: the kept lines of a call with a mark in each gap that says how many are left out."""
    call = Window.partitionBy(*keys)
    kept = lines.withColumn("_n", F.count("*").over(call)).where("kept")
    before = F.col(number) - F.coalesce(F.lag(number).over(call.orderBy(number)), F.lit(0)) - 1
    after = F.when(F.lead(number).over(call.orderBy(number)).isNull(), F.col("_n") - F.col(number)).otherwise(0)
    mark = lambda gap: F.concat(F.lit("[... "), gap.cast("string"), F.lit(" lines left out ...]"))
    rows = kept.withColumns({"_before": before, "_after": after})
    shown = F.concat_ws("\n", F.when(F.col("_before") > 0, mark(F.col("_before"))), F.col(line), F.when(F.col("_after") > 0, mark(F.col("_after"))))
    texts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), shown.alias("line")))).alias("_l"))
    return texts.select(*keys, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"), F.size("_l").cast("long").alias("lines"))

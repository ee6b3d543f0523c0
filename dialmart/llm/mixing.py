"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

The documents of a source stand in line by size; every document moves the line on by the copies it
is expected to give, which is the same for all of a source, and each whole number that is passed,
from one random start, emits a copy.  The line is dealt over tasks by ranges of source, size and
the documents' own numbers, so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, line_up, materialize, returned

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, n, source_size and target of each source.

    sizes has source and size.  Sources in code-point order, null last, take the weights in turn;
    the targets share the size of all sources.  A target stops at `most` times its source's size
    and the rest goes to the others by weight: all that are not stopped then stand at one level
    times their weight, and that level is found from the running sums over the sources in the
    order in which they stop.  Sources without words get 0.
    """
    by_source = sizes.groupBy("source").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.lit([float(w) for w in weights])[((F.row_number().over(order) - 1) % len(weights)).cast("int")]
    weighed = by_source.withColumn("weight", turn)
    weighed = weighed.withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy()
    stops = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    levels = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.sum("stop").over(stops).alias("stopped"),
        F.sum("weight").over(stops).alias("stopped_weight"),
    ).withColumn(
        # the level if this source and all before it are stopped, valid if it is below the next stop
        "level",
        (F.col("total") - (F.col("stopped") - F.col("stop")))
        / (F.col("all_weight") - (F.col("stopped_weight") - F.col("weight"))),
    )
    # the first source that is not stopped sets the level
    free = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), "level"))
    found = levels.withColumn("level", F.min(free).over(everything)["level"])
    target = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return found.select("source", "n", "source_size", target.alias("target"))


def _numbered(docs: DataFrame, *more: F.Column) -> DataFrame:
    """A row for each row of docs with a number of its own, and what its place in line depends on."""
    source = F.col("source").cast("string")
    return docs.select(
        *more,
        F.monotonically_increasing_id().alias("number"),
        F.col("doc_id").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("line"),  # of the source, never null
        word_count().alias("size"),
        F.xxhash64("text").alias("h"),
    )


def mix_copies(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17
) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (an int from 0) of each document.

    A null or empty text has size 0, a null source is a source of its own.  Repeated rows, of one
    doc_id or none, are documents of their own.  Equal input gives equal output.  Ties of size go by
    doc_id, then by text.  Further columns of docs are left out.  No rows give no rows.
    """
    return _copies(materialize(_numbered(docs), "sizes"), weights, most, seed).drop("number")


def _copies(sized: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """The number, figures and copies of the rows of _numbered."""
    sized = sized.select("number", "doc_id", "source", "line", "size", "h")
    targets = source_targets(sized, weights, most).withColumn("line", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    placed = line_up(sized, "line", ["size", "doc_id", "h", "number"], "line").join(targets.drop("source", "n"), "line")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor((F.col("rank") + 1) * each + start) - F.floor(F.col("rank") * each + start)
    return placed.select(
        "number", "doc_id", "source", "size", "source_size", "target", F.least(copies, F.lit(int(most))).cast("int").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of docs, each as often as its source's target asks.

    Same rules as mix_copies: rows whose doc_id repeats, or is null, are sampled one by one.  All
    columns of docs go through, whatever they are called.
    """
    rows = materialize(_numbered(docs, carried(docs).alias("row")), "documents")
    copies = _copies(rows, weights, most, seed).where("copies > 0").select("number", "copies")
    mixed = rows.select("row", "number").join(copies, "number").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return returned(mixed, docs.columns)

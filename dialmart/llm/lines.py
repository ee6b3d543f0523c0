"""Line dedup: a suffix array over sequences of line ids, built by distributed prefix doubling.

Every line that is not blank is a position.  A position's rank says where the run of lines that
begins there sorts among all runs of that many lines; ranks of single lines come first, and each
round doubles the run: a pair (rank here, rank as many lines on) is the sort key of a run twice as
long.  Positions of equal rank are one longest-common-prefix interval of that level: their runs are
equal for that many lines at least.  Positions whose rank is their own are settled and leave; doubling
ends when none is left.  The intervals of all levels together give the maximal repeated runs:
each position but the first of its interval starts a copy of so many lines, and copies that touch
or overlap are one run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, materialize, n_partitions, returned

#: Lines of the shortest run that is deleted.
MIN_LINES = 2
KEY = ["doc_id", "_text_hash"]


def line_table(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """A row for each line that is not blank: document, place among all of these, number, hash, and whether it has min_words words.

    A repeated row gives its lines again.
    """
    parts = F.transform(F.split("text", "\n"), lambda body, line: F.struct(line.alias("line"), body.alias("body")))
    full = F.filter(parts, lambda part: F.length(F.trim(_clean(part["body"]))) > 0)
    lines = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text_hash"), F.posexplode(full).alias("place", "part")
    )
    lines = lines.select(*KEY, (F.col("place") + 1).alias("place"), "part.*")
    hashed = [*KEY, "place", "line", F.xxhash64("body").alias("h1"), F.xxhash64("body", F.lit(7)).alias("h2")]
    if min_words is not None:
        # so many words have so many characters and spaces between them; only then are they counted
        enough = F.size(F.split(F.trim(_clean(F.col("body"))), " +")) >= min_words
        hashed.append(((F.length("body") >= 2 * min_words - 1) & enough).alias("long"))
    return materialize(lines.select(*hashed), "lines")


def _clean(text: F.Column) -> F.Column:
    return F.translate(text, "\t\r\x0b\x0c", "    ")


PLACE = ["doc_id", "place", "_text_hash"]


def _rank(rows: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """rows without a and b but with rank, in the order of the pairs (a, b), and for each pair its rows (same) and first place.

    Equal pairs are one row before they are shuffled and sorted by range over all tasks; a pair's
    rank is its range and its number there.
    """
    pairs = rows.groupBy(a, b).agg(F.count("*").alias("same"), F.min(F.struct(*PLACE)).alias("first"))
    ranked = pairs.repartitionByRange(n_partitions(rows.sparkSession), a, b).sortWithinPartitions(a, b)
    ranked = materialize(ranked.withColumn("rank", F.monotonically_increasing_id()), label)
    # a pair that has one row has no part in what follows
    return materialize(rows.join(ranked.where("same > 1"), [a, b]).drop(a, b), label)


def run_levels(lines: DataFrame, min_lines: int = MIN_LINES) -> list[tuple[int, DataFrame]]:
    """(length, rows) for lengths of min_lines, twice that and so on, while some run of that length stands twice.

    rows are the positions of line_table whose run of that many lines has others like it, with rank,
    same (how many there are) and first (the place of the first).  Runs that a document's end cuts
    short are left out.
    """
    by_doc = Window.partitionBy(*KEY).orderBy("place")
    ranked = _rank(lines.select(*PLACE, "h1", "h2"), "h1", "h2", "line-ids")
    length, levels = 1, []
    while ranked.limit(1).count():
        if length >= min_lines:
            levels.append((length, ranked))
        step = length if length >= min_lines else min(length, min_lines - length)  # the last step up to min_lines may overlap
        onward = F.max("rank").over(by_doc.rangeBetween(step, step))  # null if the run there is settled or cut short
        paired = ranked.select(*PLACE, F.col("rank").alias("here"), onward.alias("next")).where("next is not null")
        ranked = _rank(paired, "here", "next", f"runs-{length + step}")
        length += step
    return levels


def _later(rows: DataFrame) -> DataFrame:
    """The rows that are not the first place of their rank."""
    return rows.where((F.col("first.doc_id") < F.col("doc_id")) | (F.col("first.place") < F.col("place")))


def repeated_runs(lines: DataFrame, min_lines: int = MIN_LINES, levels: list[tuple[int, DataFrame]] | None = None) -> DataFrame:
    """doc_id, _text_hash, lo, hi: the maximal runs of places that later copies of min_lines lines or more cover.

    Of a line_table that marks lines as long, those are copies by themselves.
    """
    spans = [
        _later(rows).select(*KEY, F.col("place").alias("lo"), (F.col("place") + length - 1).alias("hi"))
        for length, rows in (run_levels(lines, min_lines) if levels is None else levels)
    ]
    if "long" in lines.columns:
        single = _rank(lines.where("long").select(*PLACE, "h1", "h2"), "h1", "h2", "long-lines")
        spans.append(_later(single).select(*KEY, F.col("place").alias("lo"), F.col("place").alias("hi")))
    every = lines.limit(0).select(*KEY, F.col("place").alias("lo"), F.col("place").alias("hi"))
    for s in spans:
        every = every.unionAll(s)
    before = Window.partitionBy(*KEY).orderBy("lo", "hi")
    reach = F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begins = every.withColumn("begins", F.coalesce(F.col("lo") > reach + 1, F.lit(True)).cast("int"))
    numbered = begins.withColumn("run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*KEY, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc_id, _text_hash and removed: the sorted numbers of a document's lines that a later copy holds.

    A line goes if a run of min_lines lines around it also starts earlier: in a document with a
    smaller doc_id, or before in the same one.  With min_words, a line of so many words goes by
    itself if it also stands earlier.  Only documents that lose lines have a row.
    """
    lines = line_table(docs, min_words)
    runs = repeated_runs(lines, min_lines)
    covered = runs.select(*KEY, F.explode(F.sequence("lo", "hi")).alias("place"))
    # from places among the lines that are not blank to line numbers
    hit = lines.select(*KEY, "place", "line").join(covered, [*KEY, "place"], "left_semi")
    return hit.groupBy(*KEY).agg(F.array_sort(F.collect_set("line")).alias("removed"))


def _without(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
    kept, spans = [], []
    for body, numbers in zip(text, removed, strict=True):
        if body is None or numbers is None:
            kept.append(None)
            spans.append(0)
            continue
        lines = body.split("\n")
        stay = np.ones(len(lines), bool)
        stay[np.asarray(numbers, np.int64)] = False
        kept.append("\n".join(line for line, s in zip(lines, stay, strict=True) if s))
        spans.append(int((~stay & np.r_[True, stay[:-1]]).sum()))
    return pd.DataFrame({"kept": kept, "n_spans": spans})


def _deduped(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """row (the columns of docs), text, kept, n_lines, n_removed and n_spans."""
    gone = repeated_lines(docs, min_lines, min_words)
    rows = docs.select(carried(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    rows = rows.join(gone, (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("_text_hash")), "left")
    # only texts that lose lines go through Python
    without = F.pandas_udf(_without, "kept string, n_spans long")
    cut = rows.withColumn("cut", without(F.when(F.col("removed").isNotNull(), F.col("text")), F.col("removed")))
    n_lines = F.coalesce(F.length("text") - F.length(F.translate("text", "\n", "")) + 1, F.lit(0))
    return cut.select(
        "row",
        "text",
        F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.col("cut.kept")).alias("kept"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.col("cut.n_spans").alias("n_spans"),
    )


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """docs with kept (the text without later copies of line runs), n_lines, n_removed and n_spans.

    Lines are what stands between line feeds.  Blank ones are neither matched nor deleted, and runs
    go over them.  With min_words, a line of so many words is a run by itself.  A null text has no
    lines and stays null; rows without a doc_id are not compared and keep their text.  Rows that
    repeat a doc_id with the same text are one document and get the same result; with another text,
    the smaller place comes first.  Columns of docs go through, but for those four names, which are
    replaced.  No rows give no rows.
    """
    found = _deduped(docs, min_lines, min_words)
    return returned(found, docs.columns, {c: F.col(c) for c in ("kept", "n_lines", "n_removed", "n_spans")})


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """docs with the kept text as text and its length as n_chars if there is such a column.

    Documents that lose every line that is not blank go; those that were blank before stay.  All
    other columns go through, whatever they are called.
    """
    found = _deduped(docs, min_lines, min_words)
    found = found.where((F.col("n_removed") == 0) | (F.length(F.trim(_clean(F.col("kept")))) > 0))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return returned(found, docs.columns, new)

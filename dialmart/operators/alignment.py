"""Quotes and the words that were said: seeds by shared word runs, windows on their diagonals, a bounded edit check.

A quote's runs of words meet the lines of its call that hold the same run; a seed's diagonal says where the quote
would begin in that line.  Only windows of about the quote's length on these diagonals are compared, by the
built-in edit distance with a limit.  What is returned are the line's own words, never the quote's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that turn a statement round; a near quote must keep them, and those just before it are taken in.
POLARITY = ("לא", "אין", "אל", "ללא", "בלי", "אף", "שום", "לעולם")
NEGATIONS = (*POLARITY, "אי", "אינו", "אינה", "איננה", "אינם", "אינן", "איני", "אינני", "מעולם", "בלתי")
#: Letters of the shortest quote that is looked for, share of letters that must agree, words that a window may be longer or shorter or stand off.
SHORTEST = 8
LEAST = 0.9
SLACK = 2


def plain_word(word: Column) -> Column:
    """Lower-cased, without marks and signs."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{Nd}]", "")


def _tokens(text: Column) -> Column:
    """Array of (raw, norm) for each word that has a letter or digit."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.struct(w.alias("raw"), plain_word(w).alias("norm")))
    return F.filter(words, lambda w: w["norm"] != "")


def _norms(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: w["norm"])


def _grams(norms: Column, n: int) -> Column:
    """Runs of n words by place; none if there are fewer words."""
    places = F.when(F.size(norms) >= n, F.sequence(F.lit(0), F.size(norms) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(norms, i + 1, n), " ").alias("gram")))


def _kept(words: Column, polarity: Sequence[str]) -> Column:
    """What a near quote must not change: its numbers in order, its words of polarity."""
    numbers = F.regexp_extract_all(F.array_join(words, " "), F.lit(r"\d+"), F.lit(0))
    return F.struct(numbers.alias("numbers"), F.array_sort(F.filter(words, lambda w: w.isin(*polarity))).alias("polarity"))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that no task and not the driver holds whole: texts and their words are far larger than the files that Spark judges by."""
    return df.hint("merge")


def verified_quotes(
    quotes: DataFrame,
    lines: DataFrame,
    quote_id: str,
    keys: Sequence[str],
    address: Sequence[str],
    quote: str = "quote",
    text: str = "text",
    polarity: Sequence[str] = POLARITY,
    negations: Sequence[str] = NEGATIONS,
) -> DataFrame:
    """quote_id, verdict, the address and place (word number from 0) of what was said, said (its words) and similarity.

    quotes has quote_id, the keys (a call, or also a turn) and the quote; lines has the keys, the address (ints, unique
    within the keys) and the text.  A verdict is verbatim (the quote's words in a row), near (a similarity of LEAST with
    the same numbers and the same words of polarity), changed (as near, but with other numbers or polarity), absent or short.
    Of equally near windows the first counts.  A negation one or two words before what was said is taken in.
    """
    q = quotes.select(F.col(quote_id).alias("_q"), *keys, _tokens(F.col(quote)).alias("_t"))
    q = q.select("_q", *keys, _norms(F.col("_t")).alias("want"))
    w = F.size("want")
    n = F.when(w >= 9, 3).when(w >= 5, 2).otherwise(1)
    q = q.withColumn("n", n).withColumn("whole", F.array_join("want", " "))
    seeds = q.where(F.length("whole") >= SHORTEST).select("_q", *keys, F.explode(F.when(F.col("n") == 3, _grams(F.col("want"), 3)).when(F.col("n") == 2, _grams(F.col("want"), 2)).otherwise(_grams(F.col("want"), 1))).alias("g"))
    seeds = seeds.select("_q", *keys, F.col("g.at").alias("qat"), F.col("g.n").alias("n"), F.col("g.gram").alias("gram"))
    said = lines.join(_shuffled(q.select(*keys).distinct()), list(keys), "left_semi").select(*keys, *address, _tokens(F.col(text)).alias("tokens"))
    runs = said.select(*keys, *address, _norms(F.col("tokens")).alias("norms"))
    runs = runs.select(*keys, *address, F.explode(F.concat(*[_grams(F.col("norms"), k) for k in (1, 2, 3)])).alias("g"))
    runs = runs.select(*keys, *address, F.col("g.at").alias("at"), F.col("g.n").alias("n"), F.col("g.gram").alias("gram"))
    met = seeds.join(_shuffled(runs), [*keys, "n", "gram"]).groupBy("_q", *keys, *address).agg(F.collect_set(F.col("at") - F.col("qat")).alias("diagonals"))
    pairs = met.join(_shuffled(said), [*keys, *address]).join(_shuffled(q.select("_q", "want", "whole")), "_q")
    pairs = pairs.withColumn("norms", _norms(F.col("tokens")))
    shift = F.flatten(F.transform("diagonals", lambda d: F.sequence(d - SLACK, d + SLACK)))
    starts = F.filter(F.array_distinct(shift), lambda s: (s >= 0) & (s < F.size("norms")))
    sizes = F.sequence(F.greatest(F.size("want") - SLACK, F.lit(1)), F.size("want") + SLACK)
    windows = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(sizes, lambda k: s + k <= F.size("norms")), lambda k: F.struct(s.alias("at"), k.alias("size")))))

    def rated(x):
        span = F.array_join(F.slice(F.col("norms"), x["at"] + 1, x["size"]), " ")
        longest = F.greatest(F.length(span), F.length("whole"))
        most = F.floor(longest * (1 - LEAST) + 1e-9).cast("int")  # edits allowed
        # the distance has no threshold that is a column, so lengths that differ too much are told first
        edits = F.when(F.abs(F.length(span) - F.length("whole")) <= most, F.levenshtein(span, F.col("whole")))
        return F.struct(F.when(edits <= most, 1 - edits / longest).alias("similarity"), (-x["at"]).alias("back"), (-x["size"]).alias("short"))

    best = F.array_max(F.filter(F.transform(windows, rated), lambda x: x["similarity"].isNotNull()))
    pairs = pairs.withColumn("best", F.explode(F.array(best))).where("best is not null")  # a filter on best itself would work it out again
    order = F.struct("best.similarity", *[(-F.col(a)).alias(a) for a in address], "best.back", "best.short")
    one = pairs.groupBy("_q").agg(F.max_by(F.struct(*address, "tokens", "want", "whole", "best"), order).alias("b")).select("_q", "b.*")
    at, size = -F.col("best.back"), -F.col("best.short")
    one = one.withColumns({"norms": _norms(F.col("tokens")), "at": at, "size": size})
    one = one.withColumn("window", F.slice("norms", F.col("at") + 1, F.col("size")))
    same = _kept(F.col("window"), polarity) == _kept(F.col("want"), polarity)
    verdict = F.when(F.array_join("window", " ") == F.col("whole"), "verbatim").when(same, "near").otherwise("changed")
    is_no = lambda back: F.coalesce(F.get("norms", F.col("at") - back).isin(*negations), F.lit(False))
    start = F.when(is_no(1), F.col("at") - 1).when(is_no(2), F.col("at") - 2).otherwise(F.col("at"))
    one = one.withColumn("place", start)
    words = F.slice(F.transform("tokens", lambda t: t["raw"]), F.col("place") + 1, F.col("at") + F.col("size") - F.col("place"))
    found = one.select("_q", verdict.alias("verdict"), *address, "place", F.array_join(words, " ").alias("said"), F.col("best.similarity").alias("similarity"))
    told = q.select(F.col("_q"), F.when(F.length("whole") < SHORTEST, "short").otherwise("absent").alias("_none")).join(_shuffled(found), "_q", "left")
    ok = F.col("verdict").isin("verbatim", "near")
    shown = {c: F.when(ok, F.col(c)) for c in [*address, "place", "said", "similarity"]}
    return told.select(F.col("_q").alias(quote_id), F.coalesce("verdict", "_none").alias("verdict"), *[v.alias(c) for c, v in shown.items()])

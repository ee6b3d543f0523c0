"""Who spoke when, held against a reference: a sweep over the ends of turns, and the best pairing of speakers.

Times are whole frames.  The ends of a call's turns are sorted once; a fold over them keeps the turns that are open
on either side, and what lies between two ends adds its length to one pair (speaker of the reference, speaker
given).  Where turns overlap the one that starts last holds the floor.  Everything after works on these few pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a frame, and on either side of a reference's turn ends that are not scored.
FRAME = 0.01
COLLAR = 0.25
#: Roles as a reference names them; the share of frames with the right role is told only where it has no other speakers.
ROLES = ("banker", "customer")
#: Speakers on the smaller side of a call up to which the best pairing is searched; beyond, it is null.
MOST_SPEAKERS = 12

_OPEN = "array<struct<start:bigint,seq:bigint,speaker:string>>"
_PAIRS = "array<struct<ref:string,hyp:string,n:bigint>>"


def _turns(df: DataFrame, keys: Sequence[str], lo: str, hi: str, speaker: str, side: int) -> DataFrame:
    first = F.greatest(F.floor(F.col(lo) / FRAME), F.lit(0)).cast("long")
    turns = df.select(*keys, first.alias("lo"), F.bround(F.col(hi) / FRAME).cast("long").alias("hi"), F.col(speaker).cast("string").alias("speaker"), F.col(lo).alias("_at"), F.col(hi).alias("_to"))
    return turns.withColumn("side", F.lit(side))


def _both_ends(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends of intervals; ends come before starts of the same frame."""
    end = lambda t, kind: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), "side", F.col("lo").alias("start"), "seq", "speaker")
    return rows.where("hi > lo").select(*keys, F.explode(F.array(end("lo", 1), end("hi", 0))).alias("e"))


def _sweep(events: Column) -> Column:
    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(_OPEN).alias("ref"), F.array().cast(_OPEN).alias("hyp"), F.lit(0).alias("hidden"), F.array().cast(_PAIRS).alias("pairs")
    )

    def step(s, e):
        who = F.struct(e["start"].alias("start"), e["seq"].alias("seq"), e["speaker"].alias("speaker"))
        speaks = lambda side: F.array_max(s[side])["speaker"]
        n = e["t"] - s["at"]
        scored = (n > 0) & (s["hidden"] == 0) & ((F.size(s["ref"]) > 0) | (F.size(s["hyp"]) > 0))
        pair = F.array(F.struct(speaks("ref").alias("ref"), speaks("hyp").alias("hyp"), n.alias("n")))

        def after(side, code):
            changed = F.when(e["kind"] == 1, F.concat(s[side], F.array(who))).otherwise(F.filter(s[side], lambda o: o["seq"] != e["seq"]))
            return F.when(e["side"] == code, changed).otherwise(s[side]).alias(side)

        hidden = s["hidden"] + F.when(e["side"] == 2, F.when(e["kind"] == 1, 1).otherwise(-1)).otherwise(0)
        return F.struct(e["t"].alias("at"), after("ref", 0), after("hyp", 1), hidden.alias("hidden"), F.when(scored, F.concat(s["pairs"], pair)).otherwise(s["pairs"]).alias("pairs"))

    return F.aggregate(events, start, step, lambda s: s["pairs"])


def shared_speech(reference: DataFrame, given: DataFrame, keys: Sequence[str], lo: str, hi: str, speaker: str, collar: float = COLLAR) -> DataFrame:
    """keys, ref, hyp and n: scored frames in which these two hold the floor; null where nobody does on that side.

    A call's turns are read as one array, as a call is bounded.  Turns without a speaker count as speech of a speaker of no name.
    """
    both = _turns(reference, keys, lo, hi, speaker, 0).unionByName(_turns(given, keys, lo, hi, speaker, 1))
    both = both.withColumn("speaker", F.coalesce("speaker", F.lit("")))
    both = both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("side", "_at", "_to", "speaker")).cast("long"))
    width = int(collar / FRAME)
    edges = both.where("side = 0").select(*keys, F.explode(F.array(*[F.floor(F.col(c) / FRAME).cast("long") for c in ("_at", "_to")])).alias("_c"))
    hidden = edges.select(
        *keys, F.greatest(F.col("_c") - width, F.lit(0)).cast("long").alias("lo"), (F.col("_c") + width + 1).alias("hi"), F.lit("").alias("speaker"), F.lit(2).alias("side"), F.lit(0).cast("long").alias("seq")
    )
    rows = both.select(*keys, "lo", "hi", "speaker", "side", "seq")
    ends = _both_ends(rows.unionByName(hidden) if collar > 0 else rows, keys)
    calls = ends.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("events"))
    pairs = calls.select(*keys, F.explode(_sweep(F.col("events"))).alias("p"))
    return pairs.groupBy(*keys, "p.ref", "p.hyp").agg(F.sum("p.n").alias("n"))


def _names(pairs: Column, side: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p[side])))


def _best_shared(pairs: Column) -> Column:
    """The most frames that a one-to-one pairing of speakers shares, of pairs (ref, hyp, n) with both sides named.

    The smaller side's speakers are bits; the best total for each set of them used is kept while the other side's
    speakers are taken one by one.
    """
    refs, hyps = _names(pairs, "ref"), _names(pairs, "hyp")
    flip = F.size(refs) < F.size(hyps)
    flipped = F.transform(pairs, lambda p: F.struct(p["hyp"].alias("ref"), p["ref"].alias("hyp"), p["n"].alias("n")))
    held = F.array(F.struct(F.when(flip, hyps).otherwise(refs).alias("rows"), F.when(flip, refs).otherwise(hyps).alias("bits"), F.when(flip, flipped).otherwise(pairs).alias("pairs")))

    def search(h):
        masks = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(h["bits"])).cast("int") - 1)

        def take(best, row):
            n = F.transform(h["bits"], lambda b: F.aggregate(F.filter(h["pairs"], lambda p: (p["ref"] == row) & (p["hyp"] == b)), F.lit(0).cast("long"), lambda a, p: a + p["n"]))
            bits = F.transform(n, lambda x, i: F.struct(i.alias("i"), x.alias("n")))
            return F.transform(best, lambda b, mask: F.greatest(b, F.array_max(F.transform(bits, lambda x: _without(best, mask, x)))))

        start = F.transform(masks, lambda m: F.lit(0).cast("long"))
        return F.aggregate(h["rows"], start, take, lambda best: F.array_max(best))

    return F.element_at(F.transform(held, search), 1)


def _without(best: Column, mask: Column, bit: Column) -> Column:
    """The total where this bit is used by this row, if the mask holds it."""
    power = F.pow(F.lit(2), bit["i"]).cast("int")
    return F.when(F.pmod(F.floor(mask / power), F.lit(2)) == 1, F.get(best, mask - power) + bit["n"])


def diarization_errors(
    reference: DataFrame, given: DataFrame, keys: Sequence[str], lo: str, hi: str, speaker: str, collar: float = COLLAR, roles: Sequence[str] = ROLES
) -> DataFrame:
    """keys, speech (frames), missed, false_alarm, confused, der, der_best and role_accuracy of each call.

    Rates are of the reference's scored speech, 0 where it has none.  confused and der take the speakers' names as given;
    der_best is the rate under the best one-to-one pairing of any number of speakers.  role_accuracy is null where the
    reference names other speakers than the roles, or has no speech.
    """
    shared = shared_speech(reference, given, keys, lo, hi, speaker, collar)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    ref, hyp = F.col("ref"), F.col("hyp")
    named = F.when(ref.isNotNull() & hyp.isNotNull(), F.struct("ref", "hyp", "n"))
    calls = shared.groupBy(*keys).agg(
        n(ref.isNotNull()).alias("speech"), n(ref.isNotNull() & hyp.isNull()).alias("missed"), n(ref.isNull() & hyp.isNotNull()).alias("false_alarm"),
        n(ref.isNotNull() & hyp.isNotNull() & (ref != hyp)).alias("confused"), n(ref == hyp).alias("right"), n(ref.isNotNull() & hyp.isNotNull()).alias("both"),
        F.collect_list(named).alias("pairs"),
    )
    smaller = F.least(F.size(_names(F.col("pairs"), "ref")), F.size(_names(F.col("pairs"), "hyp")))
    best = F.when(F.size("pairs") == 0, F.lit(0)).when(smaller <= MOST_SPEAKERS, _best_shared(F.col("pairs")))
    calls = calls.withColumn("best", best)
    rate = lambda x: F.round(F.when(F.col("speech") > 0, x / F.col("speech")).otherwise(0.0), 4)
    lost = F.col("missed") + F.col("false_alarm")
    only = reference.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(speaker).isin(*roles), F.lit(False))).alias("_only"))
    accuracy = F.round(F.when((F.col("speech") > 0) & F.col("_only"), F.col("right") / F.col("speech")), 4)
    joined = calls.join(only, list(keys), "left")
    return joined.select(
        *keys, "speech", "missed", "false_alarm", "confused", rate(lost + F.col("confused")).alias("der"), rate(lost + F.col("both") - F.col("best")).alias("der_best"), accuracy.alias("role_accuracy")
    )

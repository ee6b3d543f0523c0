"""Which of a call's two speakers is the agent: signals as rows, votes by weight, conflicts by recorded part.

Each signal is a row (call, signal, speaker, value).  The speaker with the larger value gets the signal's weight,
or the other one where supplying something tells a customer; equal values are no vote.  So a signal is one more
row, and a part of a call is judged by the same rows with one more key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_count, word_count

#: Seconds at either end of a call that count as its opening and its closing, and what each signal weighs.
OPENING_SECONDS = 45.0
CLOSING_SECONDS = 45.0
WEIGHTS = {
    "opening": 3.0,
    "identity_request": 2.5,
    "identity_supply": 2.0,
    "question_rate": 1.5,
    "service_language": 1.0,
    "closing": 1.0,
    "first_speaker": 0.5,
}
#: Signals that vote for the other speaker.
INVERTED = ("identity_supply",)
#: A part with less confidence than this conflicts with nothing.
CONFLICT = 0.3
#: A long number, as said by the side that identifies itself.
NUMBER = r"(?<![0-9])[0-9]{5,}(?![0-9])"


@dataclass(frozen=True)
class Cues:
    """Phrases of a language, each taken as it is written."""

    opening: Sequence[str] = ()
    closing: Sequence[str] = ()
    service: Sequence[str] = ()
    identity_actions: Sequence[str] = ()
    identity_fields: Sequence[str] = ()
    request: Sequence[str] = ()
    question_openers: Sequence[str] = ()


def _count(text: Column, phrases: Sequence[str]) -> Column:
    """How often the phrases occur, those that overlap themselves counted from the left."""
    each = [(F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p) for p in phrases]
    return sum(each, F.lit(0.0))


def _any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | text.contains(p)
    return found


def role_signals(turns: DataFrame, keys: Sequence[str], speaker: str, lo: str, hi: str, order: str, text: str, cues: Cues) -> DataFrame:
    """keys, signal, speaker and value: what each speaker of a call scores on each signal."""
    call = Window.partitionBy(*keys)
    rows = turns.select(*keys, F.col(speaker).alias("speaker"), F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.col(order).alias("_order"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumn("_end", F.max("_hi").over(call))
    said = F.col("_text")
    asks = _any(said, cues.identity_actions) | (_any(said, cues.identity_fields) & _any(said, cues.request))
    opens, closes = F.col("_lo") <= OPENING_SECONDS, F.col("_hi") >= F.col("_end") - CLOSING_SECONDS
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_text"))), lambda t: t["_text"]), " ")
    by = rows.groupBy(*keys, "speaker").agg(
        F.sum(F.when(opens, _count(said, cues.opening)).otherwise(0.0)).alias("opening"),
        F.count_if(asks).cast("double").alias("identity_request"),
        F.sum(_count(said, cues.service)).alias("service_language"),
        F.sum(F.when(closes, _count(said, cues.closing)).otherwise(0.0)).alias("closing"),
        F.sum(word_count(said)).alias("_words"),
        F.min("_order").alias("_first"),
        whole.alias("_whole"),
    )
    rate = F.round(question_count(F.col("_whole"), cues.question_openers) / F.greatest(F.col("_words"), F.lit(1)) * 100, 2)
    by = by.withColumns({"question_rate": rate, "first_speaker": (F.col("_first") == F.min("_first").over(call)).cast("double")})
    # who says each long number first; to read it back is no sign
    numbers = rows.select(*keys, "speaker", "_order", F.posexplode(F.regexp_extract_all(said, F.lit(NUMBER), F.lit(0))).alias("_pos", "_number"))
    first = numbers.groupBy(*keys, "_number").agg(F.min_by("speaker", F.struct("_order", "_pos")).alias("speaker"))
    supplied = first.groupBy(*keys, "speaker").agg(F.count("*").cast("double").alias("identity_supply"))
    by = by.join(supplied, [*keys, "speaker"], "left").withColumn("identity_supply", F.coalesce("identity_supply", F.lit(0.0)))
    return by.unpivot([*keys, "speaker"], list(WEIGHTS), "signal", "value")


def infer_roles(turns: DataFrame, keys: Sequence[str], speaker: str, lo: str, hi: str, order: str, text: str, cues: Cues) -> DataFrame:
    """keys, agent, confidence and votes (an array of (signal, weight, speaker) by name) of each call.

    Of a call with other than two speakers the first by name is the agent, with confidence 0 and no votes.  On equal weights
    it is the first by name too.  confidence is the difference of both sides' weights as a share of all weights.
    """
    signals = role_signals(turns, keys, speaker, lo, hi, order, text, cues)
    sides = signals.groupBy(*keys, "signal").agg(F.array_sort(F.collect_list(F.struct("speaker", "value"))).alias("s"))
    a, b = F.col("s")[0], F.col("s")[1]
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("signal")]
    ahead = (a["value"] > b["value"]) != F.col("signal").isin(*INVERTED)
    vote = F.when((F.size("s") == 2) & (a["value"] != b["value"]), F.struct("signal", weight.alias("weight"), F.when(ahead, a["speaker"]).otherwise(b["speaker"]).alias("speaker")))
    by = sides.select(*keys, a["speaker"].alias("_a"), F.get("s", F.lit(1))["speaker"].alias("_b"), vote.alias("vote"))
    tally = lambda side: F.sum(F.when(F.col("vote.speaker") == F.col(side), F.col("vote.weight")).otherwise(0.0))
    calls = by.groupBy(*keys, "_a", "_b").agg(tally("_a").alias("_na"), tally("_b").alias("_nb"), F.array_sort(F.collect_list("vote")).alias("votes"))
    agent = F.when(F.col("_nb") > F.col("_na"), F.col("_b")).otherwise(F.col("_a"))
    confidence = F.round(F.abs(F.col("_na") - F.col("_nb")) / sum(WEIGHTS.values()), 3)
    return calls.select(*keys, agent.alias("agent"), confidence.alias("confidence"), "votes")


def part_conflicts(turns: DataFrame, parts: DataFrame, keys: Sequence[str], part: str, speaker: str, lo: str, hi: str, order: str, text: str, cues: Cues) -> DataFrame:
    """keys, part, agent and confidence of parts whose own evidence names the other speaker than the whole call's.

    parts has keys, part, and the seconds begin and end; only calls of two parts or more are looked at.
    """
    several = parts.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").select(*keys, part, F.col("begin").alias("_begin"), F.col("end").alias("_finish"))
    inside = turns.join(several, list(keys)).where((F.col(lo) >= F.col("_begin")) & (F.col(lo) < F.col("_finish"))).drop("_begin", "_finish")
    own = infer_roles(inside, [*keys, part], speaker, lo, hi, order, text, cues)
    whole = infer_roles(turns, keys, speaker, lo, hi, order, text, cues).select(*keys, F.col("agent").alias("_agent"))
    return own.join(whole, list(keys)).where((F.col("agent") != F.col("_agent")) & (F.col("confidence") >= CONFLICT)).select(*keys, part, "agent", "confidence")


#: Phrases of Hebrew retail banking.
HEBREW = Cues(
    opening=(
        "הגעת ל", "הגעתם ל", "מוקד", "שירות לקוחות", "נציג", "מהבנק", "מהסניף", "במה אפשר לעזור", "איך אפשר לעזור",
        "במה אוכל לעזור", "איך אוכל לעזור", "השיחה מוקלטת", "השיחה הזאת מוקלטת", "לצורכי בקרת איכות",
    ),
    closing=("תודה שפנית", "תודה שפניתם", "יום נעים", "יום טוב", "נשמח לעמוד לשירותך", "ערב טוב ותודה", "נשמח לעזור"),
    service=(
        "בשמחה", "אשמח", "אבדוק", "אני בודק", "אני בודקת", "אעביר אותך", "לסיכום", "יש עוד משהו", "אני מבין", "אני מבינה",
        "אני מתנצל", "אני מתנצלת", "נטפל", "אני אעזור", "רגע אחד",
    ),
    identity_actions=("לאימות", "לזהות אותך", "אזהה אותך", "נזהה אותך", "הזיהוי הושלם", "אני צריך לזהות", "צריכה לזהות"),
    identity_fields=("תעודת זהות", "תעודת הזהות", "מספר זהות", "ת.ז", 'ת"ז', "מספר חשבון", "ארבע הספרות האחרונות", "שם האם", "תאריך לידה"),
    request=("?", "מה ", "מהו", "אפשר", "תן לי", "תגיד", "תמסור", "אני צריך", "אני צריכה", "בבקשה", "אשמח לקבל"),
)

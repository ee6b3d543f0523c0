"""Contacts of a story: what kind they are, what the facts say of a return, promises, and how a story ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_business_days
from . import matching

#: Type of a contact by its kind.
INTERACTION_TYPES = {
    "recorded_call": "REC",
    "abandoned": "ABN",
    "unrecorded_answered": "TALK",
    "unrecorded_unknown": "UNK",
    "message": "UM",
}
#: Lower ends of score bands, ends of duration buckets in seconds and of gap buckets in hours.
SCORE_BANDS = {80.0: 4, 60.0: 3, 40.0: 2}
DURATIONS = {"short": 180.0, "mid": 360.0, "long": 600.0}
GAP_HOURS = (1, 4, 24, 72, 168)


def contact_kind(channel: Column, recorded: Column, answer: Column) -> Column:
    """A recording counts before what is known of the answer; channels but calls and messages are their own kind."""
    call = (
        F.when(F.coalesce(recorded, F.lit(False)), "recorded_call")
        .when(answer == "abandoned", "abandoned")
        .when(answer == "answered", "unrecorded_answered")
        .otherwise("unrecorded_unknown")
    )
    return F.when(channel == "call", call).otherwise(channel)


def interaction_type(kind: Column) -> Column:
    found = F.lit("OTHER")
    for k, name in INTERACTION_TYPES.items():
        found = F.when(kind == k, name).otherwise(found)
    return found


def has_content(kind: Column) -> Column:
    return kind.isin("recorded_call", "message")


def objective_class(kind: Column, direction: Column, covered: Column, has_sessions: Column, has_execute: Column) -> Column:
    """What the facts alone say of a contact: the first that holds counts."""
    silent = kind.isin("unrecorded_answered", "unrecorded_unknown") & covered
    return (
        F.when(kind == "abandoned", "abandoned")
        .when(direction == "outbound", "bank_initiated")
        .when(has_content(kind), "content")
        .when(silent & has_execute, "answered_execute")
        .when(silent & has_sessions, "answered_info")
        .when(silent & (kind == "unrecorded_answered"), "answered_no_trace")
        .otherwise("unrecorded_no_cover")
    )


def shown_category(category: Column, objective: Column, decided_by: Column) -> Column:
    """A return with content that nobody has judged yet is pending."""
    return F.when((objective == "content") & (decided_by == "none"), "pending").otherwise(category)


def score_band(total: Column) -> Column:
    found = F.lit(1)
    for least, band in sorted(SCORE_BANDS.items()):
        found = F.when(total >= least, band).otherwise(found)
    return found


def duration_bucket(seconds: Column) -> Column:
    """Buckets that hold their lower end; null for no or a negative duration."""
    found = F.lit("xlong")
    for name, end in sorted(DURATIONS.items(), key=lambda x: -x[1]):
        found = F.when(seconds < end, name).otherwise(found)
    return F.when(seconds >= 0, found)


def gap_bucket(hours: Column) -> Column:
    """The number of the first limit that the gap does not pass, from 0."""
    found = F.lit(len(GAP_HOURS))
    for i, limit in reversed(list(enumerate(GAP_HOURS))):
        found = F.when(hours <= limit, i).otherwise(found)
    return F.when(hours.isNotNull(), found)


def promises(contacts: DataFrame, made: Column, executions: DataFrame, days: int) -> DataFrame:
    """A row for each contact that made a promise: due, outcome, settled_by, settled_at.

    contacts: story, interaction_id, at, until (its end), direction, covered and data_end.  executions: story, done_at.  A promise is
    kept by an outbound contact or an execution after it, up to its due time or the customer's next
    contact; broken if the customer came first, or if the log covers a due time that nothing met.
    """
    rows = contacts.where(made).select("story", "interaction_id", "covered", "data_end", F.col("until").alias("made_at"))
    rows = rows.withColumn("due", add_business_days(F.col("made_at"), days))
    back = contacts.where("direction <> 'outbound'").select("story", F.col("at").alias("_back"))
    acts = contacts.where("direction = 'outbound'").select("story", F.col("at").alias("_act"))
    rows = matching.next_after(rows, back, ["story"], "made_at", "_back", False, "back_at")
    rows = matching.next_after(rows, acts, ["story"], "made_at", "_act", False, "contact_at")
    rows = matching.next_after(rows, executions.select("story", F.col("done_at").alias("_done")), ["story"], "made_at", "_done", False, "execute_at")
    horizon = F.least("due", "back_at")
    inside = lambda c: F.when(F.col(c) <= horizon, F.col(c))
    acted = F.least(inside("contact_at"), inside("execute_at"))
    # of two at one time, by name
    how = F.when(F.col("execute_at") == F.col("acted_at"), "atlas_execute").otherwise("bank_contact")
    rows = rows.withColumn("acted_at", acted)
    returned = F.col("back_at") <= F.col("due")
    overdue = F.col("covered") & (F.col("data_end") >= F.col("due"))
    outcome = F.when(F.col("acted_at").isNotNull(), "kept").when(returned | overdue, "broken").otherwise("unknown")
    settled = F.when(F.col("acted_at").isNotNull(), how).when(returned, "customer_returned").when(overdue, "deadline")
    at = F.when(F.col("acted_at").isNotNull(), F.col("acted_at")).when(returned, F.col("back_at")).when(overdue, F.col("due"))
    return rows.select("story", "interaction_id", "made_at", "due", outcome.alias("outcome"), settled.alias("settled_by"), at.alias("settled_at"))


def return_judgements(contacts: DataFrame, made: DataFrame) -> DataFrame:
    """Returns with objective_class, category, basis, decided_by and what their order suggests.

    contacts: story, interaction_id, at, kind, direction, covered, units (a sorted array), has_execute.  A return without
    content may be an unclosed loop (it settles a broken promise) or a run-around (its day's second contact or later,
    by other units than the last known ones).  Both are suggestions and count nowhere as categories.
    """
    line = Window.partitionBy("story").orderBy("at", "interaction_id")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.size("units") > 0, F.col("units"))
    rows = contacts.withColumns(
        {
            "_is_return": F.row_number().over(line) > 1,
            "_day_no": F.row_number().over(Window.partitionBy("story", F.to_date("at")).orderBy("at", "interaction_id")),
            "_moved": F.coalesce(known != F.last(known, True).over(earlier), F.lit(False)),
        }
    )
    broken = made.where("outcome = 'broken' and settled_by = 'customer_returned'").select(
        "story", F.col("settled_at").alias("at"), F.lit(True).alias("_broken")
    )
    rows = rows.where("_is_return").join(broken.distinct(), ["story", "at"], "left")
    objective = objective_class(F.col("kind"), F.col("direction"), F.col("covered"), F.size("units") > 0, F.col("has_execute"))
    rows = rows.withColumn("objective_class", objective)
    cls = F.col("objective_class")
    bare = ~cls.isin("bank_initiated", "content") & (F.col("kind") != "abandoned")
    hint = F.when(bare & F.col("_broken"), "unclosed_loop").when(bare & (F.col("_day_no") >= 2) & F.col("_moved"), "excessive_runaround")
    return rows.select(
        "story",
        "interaction_id",
        "objective_class",
        F.when(cls == "bank_initiated", "bank_initiated").otherwise("unclassifiable").alias("category"),
        F.when(cls == "content", "none").otherwise("fact").alias("basis"),
        F.when(cls == "content", "none").otherwise("rule").alias("decided_by"),
        hint.alias("inferred_category"),
    )


def overlay(rules: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Judgements of rules with a model's answers (category, basis, decided_by) in their place where content decides."""
    told = answers.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("category", "basis", "decided_by")])
    joined = rules.join(told, list(keys), "left")
    taken = (F.col("objective_class") == "content") & F.col("_decided_by").isNotNull()
    new = {c: F.when(taken, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("category", "basis", "decided_by")}
    return joined.withColumns(new).drop(*[f"_{c}" for c in new])


def story_status(last: DataFrame, quiet_days: int) -> DataFrame:
    """status and status_basis of stories: story, kind, data_end, outcome (of its last content, null if that isn't its last contact),
    pending (a promise of its last contact that is not kept) and executed_at (the last execution after it)."""
    quiet = F.col("executed_at") + F.make_dt_interval(days=F.lit(quiet_days)) <= F.col("data_end")
    resolved = (F.col("outcome") == "resolved") & ~F.col("pending")
    left_open = (F.col("outcome") == "not_resolved") | (F.col("outcome").isNotNull() & F.col("pending"))
    status = F.when(resolved, "closed").when(left_open, "open").when(quiet, "closed").when(F.col("kind") == "abandoned", "open").otherwise("unclear")
    basis = (
        F.when(resolved | left_open, "content").when(quiet, "inference").when(F.col("kind") == "abandoned", "fact").otherwise("none")
    )
    return last.select("story", status.alias("status"), basis.alias("status_basis"))


#: What an error says when a call is held for review, and the reason that is shown.
HELD_REASONS = {
    "judge output failed after": "תשובת מודל השיפוט לא עברה אימות",
    "recording is only": "הקלטה קצרה מדי",
    "of speech was detected": "מעט מדי דיבור בהקלטה",
    "speaker roles inferred with low confidence": "זיהוי הדוברים בוודאות נמוכה",
    "redaction was DISABLED": "הסתרת הפרטים כובתה",
}
HELD_OTHER = "סיבה אחרת"


def held_reasons(error: Column) -> Column:
    """All reasons that an error names, in their fixed order, or the one for others."""
    found = F.filter(F.array(*[F.when(error.contains(m), F.lit(shown)) for m, shown in HELD_REASONS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(HELD_OTHER)))


def review_flags(
    duration: Column, speech: Column, mode: Column, confidence: Column, conflicts: Column, redacted: Column, least_confidence: float = 0.34
) -> Column:
    """Why a call needs a reviewer: an array of texts, empty if it needs none.  conflicts is an array of part numbers."""
    guessed = mode.isin("mono_diarized", "stereo_inferred") & (confidence < least_confidence)
    reasons = F.array(
        F.when(duration < 20, F.format_string("recording is only %.1fs long", duration)),
        F.when(speech < 10, F.format_string("only %.1fs of speech was detected in this recording", speech)),
        F.when(guessed, F.format_string(f"speaker roles inferred with low confidence (%.2f < {least_confidence:.2f})", confidence)),
        F.when(
            F.size(conflicts) > 0,
            F.concat(F.lit("speaker roles disagree within recorded part(s) "), F.array_join(conflicts.cast("array<string>"), ", ")),
        ),
        F.when(
            ~F.coalesce(redacted, F.lit(False)),
            "redaction was DISABLED for this call; the transcript, the judge prompt and this report contain raw customer identifiers",
        ),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def operations_text(ops: Column, most: int = 3) -> Column:
    """Up to so many different descriptions of an ordered array of (kind, description), but for opening a screen.

    A description that stands within one taken before is not taken.
    """

    def take(taken, op):
        text = F.trim(op["description"])
        wanted = (op["kind"] != "open") & (F.coalesce(op["description"], F.lit("")) != "") & (F.size(taken) < most)
        return F.when(wanted & ~F.exists(taken, lambda t: t.contains(text)), F.array_append(taken, text)).otherwise(taken)

    return F.array_join(F.aggregate(ops, F.array().cast("array<string>"), take), " | ")


def differences(actual: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, within: float = 0.05) -> DataFrame:
    """Expected figures that the actual ones, to one decimal, miss by more than within, or that are missing: keys, got, want."""
    got = actual.select(*keys, F.col(value).cast("double").alias("got"))
    joined = expected.select(*keys, F.col(value).cast("double").alias("want")).join(got, list(keys), "left")
    return joined.where(F.col("got").isNull() | (F.abs(F.round("got", 1) - F.col("want")) > within))


def executions_between(contacts: DataFrame, executions: DataFrame) -> DataFrame:
    """contacts (story, interaction_id, at) with n_between: executions (story, done_at) after the contact before and before this one.

    Both are one line of time for each story, so that no contact meets all executions.
    """
    marks = contacts.select("story", "interaction_id", "at", F.lit(None).cast("timestamp_ntz").alias("done_at"))
    done = executions.select("story", F.lit(None).cast("long").alias("interaction_id"), F.col("done_at").alias("at"), "done_at")
    line = Window.partitionBy("story").orderBy("at")
    # executions strictly before a time, and up to it
    upto = marks.unionByName(done).withColumn("_upto", F.count("done_at").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    same = F.count("done_at").over(line.rangeBetween(Window.currentRow, Window.currentRow))
    rows = upto.withColumn("_same", same).where("interaction_id is not null")
    order = Window.partitionBy("story").orderBy("at", "interaction_id")
    between = F.col("_upto") - F.col("_same") - F.lag("_upto").over(order)
    return rows.select("story", "interaction_id", "at", F.greatest(F.coalesce(between, F.lit(0)), F.lit(0)).alias("n_between"))


def main_labels(segments: DataFrame, keys: Sequence[str], label: str, lo: str, hi: str, n: int = 2) -> DataFrame:
    """keys and label of the n labels with most speech; ties go to the label that was heard first."""
    by = segments.groupBy(*keys, label).agg(F.sum(F.col(hi) - F.col(lo)).alias("_speech"), F.min(lo).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_speech"), "_first", label))
    return by.withColumn("_place", place).where(F.col("_place") <= n).select(*keys, label)


def ordered_files(files: DataFrame, key: str, name: str, seq: str, row: str) -> DataFrame:
    """Files of a call (key, in any case) in order of seq, else of their row, each name once in any case: place from 1."""
    folded = files.withColumns({"_key": F.lower(key), "_name": F.lower(name), "_order": F.coalesce(F.col(seq), F.col(row))})
    once = folded.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_name").orderBy("_order", row))).where("_n = 1")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_order", row))
    return once.withColumn("place", place).select(F.col("_key").alias(key), name, "place")


def stories_first(contacts: DataFrame, story: str, story_no: str, n: int | None = None) -> DataFrame:
    """story, story_no and returns, most returns first, ties by number; the first n if asked for."""
    by = contacts.groupBy(story).agg(F.min(story_no).alias(story_no), (F.count("*") - 1).alias("returns"))
    ordered = by.orderBy(F.desc("returns"), story_no)
    return ordered.limit(n) if n else ordered

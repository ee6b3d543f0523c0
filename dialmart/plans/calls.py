"""Calls read closely: words and their certainty, parts of recordings, evidence, answers of models, and features in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import contacts, dialogs, sequences
from ..sources import scratch
from ..streaming import ingest
from . import dialog
from .registry import ORACLES, Tables, query, r6

_WORDS = "regexp_extract_all(text, '[^ \\t\\r\\n]+')"


def _words(column: str = "text"):
    return F.regexp_extract_all(column, F.lit(r"[^ \t\r\n]+"), F.lit(0))


@query(f"""
    with w as (select conv_id, turn, [((conv_id * 31 + turn * 17 + i * i * 7) % 10) / 10 for i in range(1, len({_WORDS}) + 1)] as p from conversations)
    select conv_id, turn, len(p) > 0 and len(list_filter(p, lambda x: x < 0.4)) / greatest(len(p), 1) > 0.3 as uncertain from w
""")
def uncertain_turns(t: Tables) -> DataFrame:
    """turns of which more than three words in ten were heard with low probability."""
    p = F.transform(_words(), lambda w, i: ((F.col("conv_id") * 31 + F.col("turn") * 17 + (i + 1) * (i + 1) * 7) % 10) / 10)
    return t.conversations.select("conv_id", "turn", dialogs.is_uncertain(p, 0.4).alias("uncertain"))


@query("""
    with s as (select conv_id, case when turn % 5 = 4 then null else -((conv_id * 7 + turn * 13) % 20) / 10.0 end as logprob from conversations)
    select conv_id, count(*) as segments, round(avg(logprob), 4) as mean_logprob, round(count(*) filter (logprob < -1) / count(*), 4) as low_confidence_ratio from s group by 1
""")
def transcript_qualities(t: Tables) -> DataFrame:
    """2.11: how sure a transcript is, by its segments."""
    logprob = F.when(F.col("turn") % 5 != 4, -((F.col("conv_id") * 7 + F.col("turn") * 13) % 20) / 10.0)
    rows = t.conversations.withColumn("logprob", logprob)
    return dialogs.transcript_quality(rows, ["conv_id"], "logprob", -1.0)


@query(f"""
    with {dialog.SEGMENTS}, b as (select conv_id, greatest(1, cast(ceil(max(end_s) / 20) as int)) as n from segments group by 1)
    select conv_id, turn, case when start_s >= 0 and start_s < n * 20 then cast(floor(start_s / 20) as int) + 1 end as part,
        len(list_filter(range(1, n), lambda i: start_s < i * 20 and i * 20 < end_s)) > 0 as crosses from segments join b using (conv_id)
""")
def turn_parts(t: Tables) -> DataFrame:
    """F8: the recorded part in which each turn starts, and whether it goes on in the next."""
    rows = dialog.segments(t)
    n = rows.groupBy("conv_id").agg(F.greatest(F.lit(1), F.ceil(F.max("end_s") / 20).cast("int")).alias("n"))
    bounds = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((i * 20.0).alias("lo"), ((i + 1) * 20.0).alias("hi")))
    parts = rows.join(n, "conv_id").withColumn("bounds", bounds)
    part, crosses = dialogs.part_of(F.col("start_s"), F.col("end_s"), F.col("bounds"))
    return parts.select("conv_id", "turn", part.alias("part"), crosses.alias("crosses"))


@query(f"""
    with q as (select conv_id, turn, text, list_extract({_WORDS}, 2) as quote from conversations where len({_WORDS}) >= 2)
    select conv_id, turn, cast((length(text) - length(replace(text, quote, ''))) / length(quote) as int) as marks, length(replace(text, quote, '')) as unmarked from q
""")
def evidence_marks(t: Tables) -> DataFrame:
    """A text in pieces, those that are quoted as evidence marked with their dimension."""
    rows = t.conversations.withColumn("w", _words()).where(F.size("w") >= 2).withColumn("quote", F.col("w")[1])
    pieces = dialogs.evidence_pieces(F.col("text"), F.array(F.struct(F.col("quote").alias("quote"), F.lit("tone").alias("dim"))))
    rows = rows.withColumn("pieces", pieces)
    bare = F.filter("pieces", lambda p: p["dim"].isNull())
    return rows.select(
        "conv_id",
        "turn",
        (F.size("pieces") - F.size(bare)).alias("marks"),
        F.aggregate(bare, F.lit(0), lambda n, p: n + F.length(p["text"])).cast("long").alias("unmarked"),
    )


@query(f"""
    with {dialog.SEGMENTS}, s as (select conv_id, role || '-' || (turn % 3) as label, sum(end_s - start_s) as speech, min(start_s) as first_s from segments group by 1, 2),
    p as (select *, row_number() over (partition by conv_id order by round(speech, 6) desc, first_s, label) as place from s) select conv_id, label from p where place <= 2
""")
def main_speakers(t: Tables) -> DataFrame:
    """2.7: the two labels of a call with most speech."""
    rows = dialog.segments(t).withColumn("label", F.concat("role", F.lit("-"), (F.col("turn") % 3).cast("string")))
    whole = rows.withColumns({"lo": F.round(F.col("start_s") * 1000).cast("long"), "hi": F.round(F.col("end_s") * 1000).cast("long")})
    return contacts.main_labels(whole, ["conv_id"], "label", "lo", "hi")


@query("""
    select o_orderkey, case o_orderkey % 4 when 3 then null else o_orderkey % 5 + 1 end as score from orders
""")
def model_answers(t: Tables) -> DataFrame:
    """2.11: scores from models' answers, bare, fenced, with words around them, or broken."""
    body = F.concat(F.lit('{"score": '), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit("}"))
    form = F.col("o_orderkey") % 4
    answer = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("The result is "), body, F.lit(" as asked.")))
        .otherwise(F.concat(F.lit("no answer: "), F.substring(body, 2, 30)))
    )
    found = text.fenced_json(answer)
    return t.orders.select("o_orderkey", F.get_json_object(found, "$.score").cast("long").alias("score"))


@query("""
    with n as (select o_custkey % 40 as pair, count(*) filter (o_orderpriority = '1-URGENT' and o_orderstatus <> 'F') as b, count(*) filter (o_orderpriority = '2-HIGH' and o_orderstatus = 'F') as c from orders group by 1)
    select pair, b, c, round(case when b + c = 0 then 1.0 else least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) for k in range(0, least(b, c) + 1)])) end, 6) as p from n
""")
def mcnemar_tests(t: Tables) -> DataFrame:
    """Whether two engines disagree more one way than the other."""
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F")
    high = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F")
    n = t.orders.groupBy((F.col("o_custkey") % 40).alias("pair")).agg(F.count_if(urgent).alias("b"), F.count_if(high).alias("c"))
    return n.select("pair", "b", "c", r6(stats.mcnemar(F.col("b"), F.col("c"))).alias("p"))


@query(f"""
    with w as (select conv_id, turn, unnest({_WORDS}) as word, unnest(range(len({_WORDS}))) as i from conversations),
    l as (select *, (turn + i // 4) % 2 as label from w), n as (select *, (label is distinct from lag(label) over (partition by conv_id order by turn, i))::int as new from l),
    b as (select *, sum(new) over (partition by conv_id order by turn, i rows unbounded preceding) as block_no from n)
    select conv_id, cast(block_no as bigint) as block_no, min(label) as label, count(*) as words, md5(string_agg(word, ' ' order by turn, i)) as text_md5 from b group by 1, 2
""")
def speaker_changes(t: Tables) -> DataFrame:
    """What is heard in one piece, split where the speaker of its words changes."""
    words = t.conversations.select("conv_id", "turn", F.posexplode(_words()).alias("i", "word"))
    words = words.withColumn("label", (F.col("turn") + F.floor(F.col("i") / 4)) % 2)
    rows = sequences.blocks(words, ["conv_id"], ["turn", "i"], "label")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "i", "word"))), lambda w: w["word"]), " ")
    return rows.groupBy("conv_id", "block_no").agg(F.min("label").alias("label"), F.count("*").alias("words"), F.md5(F.encode(said, "UTF-8")).alias("text_md5"))


@query(f"""
    with t as ({ORACLES["talk_features"]}), i as ({ORACLES["interruptions"]}), p as ({ORACLES["patience"]}), m as ({ORACLES["longest_monologues"]}), d as ({ORACLES["dead_air"]}), q as ({ORACLES["questions"]})
    select t.conv_id, t.talk_ratio, t.wpm, coalesce(i.interruptions, 0) as interruptions, p.patience, coalesce(m.longest_monologue, 0) as longest_monologue, d.dead_air, coalesce(q.questions, 0) as questions
    from t left join i using (conv_id) left join p using (conv_id) left join m using (conv_id) left join d using (conv_id) left join q on q.conv_id = t.conv_id and q.role = 'assistant'
""")
def call_features(t: Tables) -> DataFrame:
    """all features of a call in one row."""
    asked = dialog.questions(t).where("role = 'assistant'").drop("role")
    parts = [dialog.interruptions(t), dialog.patience(t), dialog.longest_monologues(t), dialog.dead_air(t), asked]
    rows = dialog.talk_features(t).select("conv_id", "talk_ratio", "wpm")
    for p in parts:
        rows = rows.join(p, "conv_id", "left")
    return rows.fillna(0, ["interruptions", "longest_monologue", "questions"])


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, round(arg_max(value, event_id), 6) as value from events group by 1")
def streamed_latest(t: Tables) -> DataFrame:
    """2.13, S13: a watched folder taken up by a stream, the newest row of each key kept, and nothing written twice."""
    folder = scratch.new_folder(t.spark, "stream")
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    rows.write.json(f"{folder}/in")
    for _ in range(2):  # a second run finds nothing new
        stream = ingest.watch_folder(t.spark, f"{folder}/in", "event_id long, user_id long, event_type string, value double", per_batch=2)
        ingest.upsert_by_key(stream, "user_id", f"{folder}/out", f"{folder}/checkpoint", order="event_id").awaitTermination()
    found = ingest.latest(t.spark, "user_id", f"{folder}/out", order="event_id")
    return found.select("user_id", "event_id", "event_type", r6("value").alias("value"))

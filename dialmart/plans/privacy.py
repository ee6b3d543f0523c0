"""Personal data: messages made from `orders` with numbers of all kinds, and what is left of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import silences
from .registry import Tables, query

#: What each kind of message says; {} is a number from the order's key.
FILLER = "ועכשיו נעבור לנושא אחר לגמרי כי יש לנו עוד כמה דברים לסגור"
_WORDS = ["אפס", "אחת", "שתיים", "שלוש", "ארבע", "חמש", "שש", "שבע", "שמונה", "תשע"]
_MASK = {k: redaction.token(k) for k in redaction.LABELS}

#: m: the number said, t: the message, w: the message as it should be left, n: how many masks, k: their kind.
MESSAGES = f"""
    numbers as (
        select o_orderkey, cast(o_orderkey % 8 as int) as form, right('000000000' || cast(o_orderkey * 7919 + 100000000 as varchar), 9) as nine,
            right('00000000' || cast(o_orderkey * 31 as varchar), 8) as eight, cast(100000 + o_orderkey % 900000 as varchar) as six from orders
    ), valid as (
        select *, list_sum([case when i % 2 = 1 then cast(nine[i] as int) else cast(nine[i] as int) * 2 - case when cast(nine[i] as int) > 4 then 9 else 0 end end for i in range(1, 10)]) % 10 = 0 as is_id
        from numbers
    ), kinds as (
        select *, case form when 0 then case when is_id then 'ISRAELI_ID' else 'ACCOUNT_LIKE' end when 1 then 'PHONE' when 2 then 'none' when 3 then 'ACCOUNT_LIKE' when 4 then 'EMAIL'
            when 5 then 'ACCOUNT_LIKE' when 6 then 'DOB' else 'ACCOUNT_LIKE' end as kind,
            case form when 0 then nine when 1 then '05' || eight when 3 then six when 4 then 'user' || o_orderkey || '@example.com' when 6 then '12/0' || (1 + o_orderkey % 9) || '/1980'
                when 5 then array_to_string([list_extract({_WORDS!r}, cast(c as int) + 1) for c in string_split(six, '')], ', ') when 7 then '8' || six end as said
        from valid
    ), messages as (
        select o_orderkey, kind, said, case form when 0 then 'תעודת זהות ' || said || ' תודה' when 1 then 'אפשר לחזור למספר ' || said when 2 then 'המחיר הוא ' || six || ' שקל'
            when 3 then 'מספר חשבון ' || said || ' שקל' when 4 then 'כתבו אל ' || said when 5 then 'חשבון ' || said || ' בבקשה' when 6 then 'נולדתי ב ' || said
            else 'תיק ' || said || '. {FILLER} ' || right(said, 4) end as text
        from kinds
    )
"""
_TOKEN = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in _MASK.items()) + " end"


def messages(t: Tables) -> DataFrame:
    """o_orderkey, text and said: the number or address in it, if any that should be masked."""
    k = F.col("o_orderkey")
    form = (k % 8).cast("int")
    nine = F.right(F.concat(F.lit("0" * 9), (k * 7919 + 100000000).cast("string")), F.lit(9))
    eight = F.right(F.concat(F.lit("0" * 8), (k * 31).cast("string")), F.lit(8))
    six = (100000 + k % 900000).cast("string")
    words = F.array(*[F.lit(w) for w in _WORDS])
    spoken = F.array_join(F.transform(F.filter(F.split(six, ""), lambda c: c != ""), lambda c: F.element_at(words, c.cast("int") + 1)), ", ")
    said = (
        F.when(form == 0, nine)
        .when(form == 1, F.concat(F.lit("05"), eight))
        .when(form == 3, six)
        .when(form == 4, F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")))
        .when(form == 5, spoken)
        .when(form == 6, F.concat(F.lit("12/0"), (1 + k % 9).cast("string"), F.lit("/1980")))
        .when(form == 7, F.concat(F.lit("8"), six))
    )
    text = (
        F.when(form == 0, F.concat(F.lit("תעודת זהות "), said, F.lit(" תודה")))
        .when(form == 1, F.concat(F.lit("אפשר לחזור למספר "), said))
        .when(form == 2, F.concat(F.lit("המחיר הוא "), six, F.lit(" שקל")))
        .when(form == 3, F.concat(F.lit("מספר חשבון "), said, F.lit(" שקל")))
        .when(form == 4, F.concat(F.lit("כתבו אל "), said))
        .when(form == 5, F.concat(F.lit("חשבון "), said, F.lit(" בבקשה")))
        .when(form == 6, F.concat(F.lit("נולדתי ב "), said))
        .otherwise(F.concat(F.lit("תיק "), said, F.lit(f". {FILLER} "), F.right(said, F.lit(4))))
    )
    return t.orders.select("o_orderkey", text.alias("text"), said.alias("said"))


@query(f"""
    with {MESSAGES} select o_orderkey, case when said is null then text when kind = 'ACCOUNT_LIKE' and contains(text, '{FILLER}')
        then 'תיק ' || {_TOKEN} || '. {FILLER} ' || {_TOKEN} else replace(text, said, {_TOKEN}) end as masked from messages
""")
def redacted_messages(t: Tables) -> DataFrame:
    """Messages with ids, phones, accounts, addresses, birth dates and dictated numbers masked; prices stay."""
    return messages(t).select("o_orderkey", redaction.redacted(F.col("text")).alias("masked"))


@query(f"""
    with {MESSAGES} select kind, cast(sum(case when contains(text, '{FILLER}') then 2 else 1 end) as bigint) as n from messages where kind <> 'none' group by 1
""")
def redaction_totals(t: Tables) -> DataFrame:
    """A29 and the merge of counts: masks of each kind over all messages."""
    counts = messages(t).select(F.explode(redaction.spans(F.col("text"))).alias("span"))
    return counts.groupBy(F.col("span.kind").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""
    with {MESSAGES}, errors as (
        select o_orderkey, 'refused: ' || case when said is null then text when contains(text, '{FILLER}')
            then 'תיק ' || {_TOKEN} || '. {FILLER} ' || {_TOKEN} else replace(text, said, {_TOKEN}) end as e from messages
    ) select o_orderkey, case when length(e) > 30 then e[1:30] || '...[truncated]' else e end as error from errors
""")
def safe_errors(t: Tables) -> DataFrame:
    """Errors that quote a message, masked before they are cut."""
    error = redaction.safe_error(F.concat(F.lit("refused: "), F.col("text")), 30)
    return messages(t).select("o_orderkey", error.alias("error"))


@query(f"""
    with {MESSAGES}, marked as (select o_orderkey % 5 as part, kind, said, text from messages)
    select part, count(said) as gold, cast(sum(case when said is null then 0 when contains(text, '{FILLER}') then 2 else 1 end) as bigint) as detected, cast(1 as double) as recall,
        round(count(said) / sum(case when said is null then 0 when contains(text, '{FILLER}') then 2 else 1 end), 4) as precision
    from marked group by 1
""")
def redaction_scores(t: Tables) -> DataFrame:
    """How much of what was said is found, and how much of what is found was said (a number read back in part is not)."""
    wanted = F.when(F.col("said").isNotNull(), F.array("said")).otherwise(F.array().cast("array<string>"))
    rows = messages(t).select((F.col("o_orderkey") % 5).alias("part"), redaction.detection_counts(redaction.spans(F.col("text")), redaction.places(F.col("text"), wanted)).alias("c"))
    total = {c: F.sum(f"c.{c}") for c in ("gold", "detected", "recalled", "precise")}
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(1.0), 4)
    return rows.groupBy("part").agg(
        total["gold"].alias("gold"),
        total["detected"].alias("detected"),
        share(total["recalled"], total["gold"]).alias("recall"),
        share(total["precise"], total["detected"]).alias("precision"),
    )


#: Runs of digits in DuckDB, the pattern of RUN in text that holds no Hebrew and no invisible signs.
_DUCK_RUN = r"[0-9](?:[\s,\-./‐‑‒–—]{0,3}[0-9])*"
_DUCK_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
#: d: the digits of a run.  National ids and cards add up to tens with every second digit doubled and cast out by nines.
_DUCK_ID = "length(d) in (8, 9) and list_sum([case when i % 2 = 1 then cast(lpad(d, 9, '0')[i] as int) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(lpad(d, 9, '0')[i] as int) + 1] end for i in range(1, 10)]) % 10 = 0"
_DUCK_CARD = "length(d) between 13 and 19 and list_sum([case when i % 2 = 1 then cast(reverse(d)[i] as int) else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(reverse(d)[i] as int) + 1] end for i in range(1, length(d) + 1)]) % 10 = 0"
_DUCK_PHONE = "regexp_matches(regexp_replace(d, '^9720*', '0'), '^(0[57][0-9]{8}|0[234689][0-9]{7})$')"


@query(f"""
    with cut as (
        select doc_id, text, string_split_regex(coalesce(text, ''), '{_DUCK_MAIL}') as gaps, regexp_extract_all(coalesce(text, ''), '{_DUCK_MAIL}') as mails from documents
    ), parts as (  -- what stands between two addresses holds no part of one
        select doc_id, unnest(range(1, len(gaps) + 1)) as part, unnest(gaps) as gap, len(mails) as n_mails from cut
    ), runs as (
        select doc_id, part, unnest(regexp_extract_all(gap, '{_DUCK_RUN}')) as run, unnest(string_split_regex(gap, '{_DUCK_RUN}')[:-2]) as before from parts
    ), kinds as (
        select doc_id, regexp_replace(run, '[^0-9]', '', 'g') as d, before, run, regexp_matches(run, '[0-9][^0-9./‐‑‒–—-]+[0-9]') as loose from runs
    ), found as (
        select doc_id, case when ends_with(before, '*') and regexp_matches(run, '^[0-9]{{3,5}}([^0-9]|$)') then 'PHONE' when length(d) < 4 then null
            when {_DUCK_PHONE} then 'PHONE' when {_DUCK_ID} then 'ISRAELI_ID' when {_DUCK_CARD} then 'CREDIT_CARD' when length(d) >= 6 and not loose then 'ACCOUNT_LIKE' end as kind, d, before, run
        from kinds
    ), whole as (
        select doc_id, list(d) as ds from found where kind is not null and not ends_with(before, '*') and length(d) >= 6 group by 1
    ), marked as (
        select f.doc_id, coalesce(kind, case when length(d) in (4, 5) and len(list_filter(coalesce(ds, []), lambda x: ends_with(x, d))) > 0 then 'ACCOUNT_LIKE' end) as kind
        from found f left join whole using (doc_id)
    ), counted as (
        select doc_id, count(*) filter (kind = 'PHONE') as phones, count(*) filter (kind = 'ISRAELI_ID') as ids, count(*) filter (kind = 'CREDIT_CARD') as cards,
            count(*) filter (kind = 'ACCOUNT_LIKE') as accounts from marked group by 1
    )
    select doc_id, len(mails) as emails, coalesce(phones, 0) as phones, coalesce(ids, 0) as ids, coalesce(cards, 0) as cards, coalesce(accounts, 0) as accounts
    from cut left join counted using (doc_id)
""")
def personal_data_in_documents(t: Tables) -> DataFrame:
    """Personal data of each kind in every document."""
    found = t.documents.select("doc_id", F.coalesce(redaction.spans(F.col("text")), F.array()).alias("found"))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n("EMAIL").alias("emails"), n("PHONE").alias("phones"), n("ISRAELI_ID").alias("ids"), n("CREDIT_CARD").alias("cards"), n("ACCOUNT_LIKE").alias("accounts"))


@query(f"""
    with t as (
        select conv_id, turn, text, cast(10000 + conv_id % 90000 as varchar) as five, max(turn) over (partition by conv_id) as last_turn from conversations
    )
    select conv_id, md5(string_agg(text || case turn when 0 then ' first ' || case when last_turn > 0 then '{_MASK["ACCOUNT_LIKE"]}' else '77-' || five end else '' end, '|' order by turn)
        ) as masked_md5 from (select conv_id, turn, case when turn = 1 then '{_MASK["ACCOUNT_LIKE"]} and on ' || text else text end as text, five, last_turn from t) group by 1
""")
def redacted_calls(t: Tables) -> DataFrame:
    """Calls read as one text, so that a number that two turns share is masked in both; the turns' own texts stay."""
    five = (10000 + F.col("conv_id") % 90000).cast("string")
    said = F.when(F.col("turn") == 0, F.concat("text", F.lit(" first 77-"), five)).when(F.col("turn") == 1, F.concat(F.lit("-"), five, F.lit(" and on "), "text")).otherwise(F.col("text"))
    calls = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("turns"))
    calls = calls.select("conv_id", F.transform("turns", lambda x: x["said"]).alias("turns"))
    masked = redaction.masked_turns(F.col("turns"), redaction.spans(F.array_join("turns", "\n")))
    return calls.select("conv_id", F.md5(F.encode(F.array_join(masked, "|"), "UTF-8")).alias("masked_md5"))


@query("""
    with t as (
        select conv_id, turn, 1e3 * turn as start_s, max(turn) over (partition by conv_id) as last_turn,
            len(regexp_extract_all(case turn when 0 then text || ' first 77-12345' when 1 then '-12345 and on ' || text else text end, '[^ \\t\\r\\n]+')) as n, (conv_id + turn) % 5 = 3 as partly from conversations
    ), w as (
        select *, 1e3 * turn + 4e-1 * n as end_s, case turn when 0 then n - 1 else 0 end as word from t where turn < 2
    ), hits as (select conv_id, turn, 1e3 * turn + 4e-1 * word as t0, 1e3 * turn + 4e-1 * word + 4e-1 as t1 from w where not partly or word < 2
    ), ranges as (
        select conv_id, min(t0) - 0.15 as b, max(t1) + 0.15 as e from hits group by 1
        union all select conv_id, start_s - 0.15, end_s + 0.15 from w where partly and word >= 2
    ), opened as (select *, coalesce(b > max(e) over (partition by conv_id order by b, e rows between unbounded preceding and 1 preceding), true)::int as new from ranges
    ), islands as (select *, sum(new) over (partition by conv_id order by b, e rows unbounded preceding) as n from opened)
    select conv_id, round(min(b), 4) as begin_s, round(max(e), 4) as end_s from islands group by conv_id, n
""")
def silenced_calls(t: Tables) -> DataFrame:
    """Where a recording is silent: a number that two turns share, by the times of its words, or the whole turn where these are lost."""
    said = F.when(F.col("turn") == 0, F.concat("text", F.lit(" first 77-12345"))).when(F.col("turn") == 1, F.concat(F.lit("-12345 and on "), "text")).otherwise(F.col("text"))
    turns = t.conversations.select("conv_id", "turn", said.alias("text"), (F.col("turn") * 1000.0).alias("start_s"))
    n = F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))
    turns = turns.withColumn("end_s", F.col("start_s") + n * 0.4)
    words = turns.where(n > 0).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), n - 1)).alias("word"))
    words = words.where(((F.col("conv_id") + F.col("turn")) % 5 != 3) | (F.col("word") < 2))
    t0 = F.col("turn") * 1000.0 + F.col("word") * 0.4
    found = silences.masked_times(turns, words.select("*", t0.alias("t0"), (t0 + 0.4).alias("t1")), ["conv_id"])
    return found.select("conv_id", F.round("begin_s", 4).alias("begin_s"), F.round("end_s", 4).alias("end_s"))

"""Contacts and their rules: `orders` are contacts of a customer's story, `lineitem` what was done behind each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contacts as rules
from . import journey, quality
from .registry import Tables, query, r6

CONTACTS = """
    works as (
        select l_orderkey as w_id, list_sort(list_distinct(list(l_suppkey % 5))) as units, bool_or(l_returnflag = 'R') as has_execute from lineitem group by 1
    ), told as (
        select o_custkey as story, o_orderkey as interaction_id, o_orderdate as moment,
            case o_orderstatus when 'F' then 'call' when 'O' then 'message' else 'branch' end as channel, o_totalprice >= 150000 as recorded,
            case o_orderpriority when '5-LOW' then 'abandoned' when '3-MEDIUM' then 'answered' end as answer,
            case when o_orderpriority = '4-NOT SPECIFIED' then 'outbound' else 'inbound' end as direction, o_orderpriority as topic,
            coalesce(units, []) as units, coalesce(has_execute, false) as has_execute, max(o_orderdate) over () as data_end,
            cast(min(o_orderdate) over (partition by o_custkey) as date) >= date '1995-06-01' as covered
        from orders left join works on w_id = o_orderkey
    ), contacts as (
        select *, case when channel <> 'call' then channel when recorded then 'recorded_call' when answer = 'abandoned' then 'abandoned'
            when answer = 'answered' then 'unrecorded_answered' else 'unrecorded_unknown' end as kind from told
    ), executions as (
        select o_custkey as story, l_shipdate as done_at from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R'
    )
"""


def contacts(t: Tables) -> DataFrame:
    works = t.lineitem.groupBy(F.col("l_orderkey").alias("interaction_id")).agg(
        F.array_sort(F.collect_set(F.col("l_suppkey") % 5)).alias("units"), F.max(F.col("l_returnflag") == "R").alias("has_execute")
    )
    end = t.orders.agg(F.max("o_orderdate").alias("data_end"))  # one row
    p = F.col("o_orderpriority")
    rows = t.orders.select(
        F.col("o_custkey").alias("story"),
        F.col("o_orderkey").alias("interaction_id"),
        F.col("o_orderdate").alias("at"),
        F.when(F.col("o_orderstatus") == "F", "call").when(F.col("o_orderstatus") == "O", "message").otherwise("branch").alias("channel"),
        (F.col("o_totalprice") >= 150000).alias("recorded"),
        F.when(p == "5-LOW", "abandoned").when(p == "3-MEDIUM", "answered").alias("answer"),
        F.when(p == "4-NOT SPECIFIED", "outbound").otherwise("inbound").alias("direction"),
        p.alias("topic"),
    )
    covered = F.to_date(F.min("at").over(Window.partitionBy("story"))) >= F.lit("1995-06-01").cast("date")
    rows = rows.withColumn("covered", covered).join(works, "interaction_id", "left").crossJoin(F.broadcast(end))
    return rows.withColumns(
        {
            "units": F.coalesce("units", F.array().cast("array<bigint>")),
            "has_execute": F.coalesce("has_execute", F.lit(False)),
            "kind": rules.contact_kind(F.col("channel"), F.col("recorded"), F.col("answer")),
        }
    )


def executions(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_shipdate").alias("done_at"))
    return done.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("story"), "done_at")


@query(f"""
    with {CONTACTS} select interaction_id, kind,
        case kind when 'recorded_call' then 'REC' when 'abandoned' then 'ABN' when 'unrecorded_answered' then 'TALK' when 'unrecorded_unknown' then 'UNK'
            when 'message' then 'UM' else 'OTHER' end as int_type from contacts
""")
def contact_kinds(t: Tables) -> DataFrame:
    """Kinds of contacts, and the types that they are shown as."""
    return contacts(t).select("interaction_id", "kind", rules.interaction_type(F.col("kind")).alias("int_type"))


@query(f"""
    with {CONTACTS}, n as (select story, bool_or(covered) as covered, sum(len(units)) as sessions from contacts group by 1)
    select c.kind, count(*) as contacts, count(distinct c.story) as stories from contacts c join n using (story) where n.covered and n.sessions > 0 group by 1
""")
def covered_kinds(t: Tables) -> DataFrame:
    """P5: contacts of stories that the log covers in full and has a session of."""
    rows = contacts(t)
    active = rows.where("covered").groupBy("story").agg(F.sum(F.size("units")).alias("n")).where("n > 0")
    return rows.join(active, "story", "left_semi").groupBy("kind").agg(F.count("*").alias("contacts"), F.countDistinct("story").alias("stories"))


PROMISED = f"""
    {CONTACTS}, made as (
        select *, (select g from (select moment + to_days(i) as g from range(1, 9) r(i)) where dayofweek(g) < 5 order by g limit 1 offset 1) as due
        from contacts where topic = '2-HIGH'
    ), looked as (
        select m.story, m.interaction_id, m.moment, m.due, m.covered, m.data_end,
            (select min(b.moment) from contacts b where b.story = m.story and b.direction <> 'outbound' and b.moment > m.moment) as back_at,
            (select min(b.moment) from contacts b where b.story = m.story and b.direction = 'outbound' and b.moment > m.moment) as contact_at,
            (select min(e.done_at) from executions e where e.story = m.story and e.done_at > m.moment) as execute_at
        from made m
    ), acted as (
        select *, case when contact_at <= least(due, back_at) then contact_at end as c_at, case when execute_at <= least(due, back_at) then execute_at end as e_at from looked
    ), promised as (
        select story, interaction_id, moment as made_at, due,
            case when coalesce(c_at, e_at) is not null then 'kept' when back_at <= due or (covered and data_end >= due) then 'broken' else 'unknown' end as outcome,
            case when coalesce(c_at, e_at) is not null then case when e_at is not null and (c_at is null or e_at <= c_at) then 'atlas_execute' else 'bank_contact' end
                when back_at <= due then 'customer_returned' when covered and data_end >= due then 'deadline' end as settled_by,
            case when coalesce(c_at, e_at) is not null then least(c_at, e_at) when back_at <= due then back_at when covered and data_end >= due then due end as settled_at
        from acted
    )
"""


def promises(t: Tables) -> DataFrame:
    rows = contacts(t)
    made = F.col("topic") == "2-HIGH"
    return rules.promises(rows.withColumn("until", F.col("at")), made, executions(t), 2)


@query(f"with {PROMISED} select story, interaction_id, due, outcome, settled_by, settled_at from promised")
def promise_outcomes(t: Tables) -> DataFrame:
    """The promise rule: kept by the bank, broken by the customer's return or by the deadline."""
    return promises(t).drop("made_at")


JUDGED = f"""
    {PROMISED}, line as (
        select *, case when len(units) > 0 then units end as known, row_number() over (partition by story order by moment, interaction_id) > 1 as is_return,
            row_number() over (partition by story, cast(moment as date) order by moment, interaction_id) as day_no
        from contacts
    ), moved as (
        select *, coalesce(known <> last_value(known ignore nulls) over (partition by story order by moment, interaction_id rows between unbounded preceding and 1 preceding), false) as moved
        from line
    ), classed as (
        select *, exists (select 1 from promised p where p.story = m.story and p.outcome = 'broken' and p.settled_by = 'customer_returned' and p.settled_at = m.moment) as broke,
            case when kind = 'abandoned' then 'abandoned' when direction = 'outbound' then 'bank_initiated' when kind in ('recorded_call', 'message') then 'content'
            when kind in ('unrecorded_answered', 'unrecorded_unknown') and covered then
                case when has_execute then 'answered_execute' when len(units) > 0 then 'answered_info'
                    when kind = 'unrecorded_answered' then 'answered_no_trace' else 'unrecorded_no_cover' end
            else 'unrecorded_no_cover' end as objective_class
        from moved m where is_return
    ), judged as (
        select story, interaction_id, objective_class, case when objective_class = 'bank_initiated' then 'bank_initiated' else 'unclassifiable' end as category,
            case when objective_class = 'content' then 'none' else 'fact' end as basis, case when objective_class = 'content' then 'none' else 'rule' end as decided_by,
            case when objective_class in ('bank_initiated', 'content', 'abandoned') then null when broke then 'unclosed_loop'
                when day_no >= 2 and moved then 'excessive_runaround' end as inferred_category
        from classed
    )
"""


def judgements(t: Tables) -> DataFrame:
    return rules.return_judgements(contacts(t), promises(t))


@query(f"with {JUDGED} select * from judged")
def return_judgements(t: Tables) -> DataFrame:
    """P8, F15 and the return rule: what the facts say of each return, and what its order suggests."""
    return judgements(t)


@query(f"""
    with {JUDGED}, asked as (
        select j.*, objective_class = 'content' and o_totalprice < 300000 as known from judged j join orders on o_orderkey = interaction_id
    ), laid as (
        select objective_class, case when known then case interaction_id % 2 when 1 then 'wrong_answer' else 'new_topic' end else category end as category,
            case when known then 'model' else decided_by end as decided_by from asked
    )
    select case when objective_class = 'content' and decided_by = 'none' then 'pending' else category end as shown, decided_by, count(*) as n from laid group by 1, 2
""")
def overlaid_judgements(t: Tables) -> DataFrame:
    """P11 and the overlay: a model's answers where content decides, pending where there is none yet."""
    rows = judgements(t)
    answers = t.orders.where("o_totalprice < 300000").select(F.col("o_custkey").alias("story"), F.col("o_orderkey").alias("interaction_id"))
    answers = answers.withColumns(
        {"category": F.when(F.col("interaction_id") % 2 == 1, "wrong_answer").otherwise("new_topic"), "basis": F.lit("content"), "decided_by": F.lit("model")}
    )
    laid = rules.overlay(rows, answers, ["story", "interaction_id"])
    shown = rules.shown_category(F.col("category"), F.col("objective_class"), F.col("decided_by"))
    return laid.groupBy(shown.alias("shown"), "decided_by").agg(F.count("*").alias("n"))


@query(f"""
    with {PROMISED}, ends as (select *, row_number() over (partition by story order by moment desc, interaction_id desc) as back_no from contacts),
    last_ones as (
        select e.story, e.kind, e.data_end, case when kind in ('recorded_call', 'message') then case topic when '1-URGENT' then 'not_resolved' when '2-HIGH' then 'resolved' end end as outcome,
            coalesce((select bool_or(p.outcome <> 'kept') from promised p where p.story = e.story and p.made_at >= e.moment - interval 1 second), false) as pending,
            (select max(x.done_at) from executions x where x.story = e.story and x.done_at > e.moment) as executed_at
        from ends e where back_no = 1
    )
    select story, case when outcome = 'resolved' and not pending then 'closed' when outcome is not null then 'open' when executed_at + interval 7 days <= data_end then 'closed'
            when kind = 'abandoned' then 'open' else 'unclear' end as status,
        case when outcome is not null then 'content' when executed_at + interval 7 days <= data_end then 'inference' when kind = 'abandoned' then 'fact' else 'none' end as status_basis
    from last_ones
""")
def story_statuses(t: Tables) -> DataFrame:
    """The status rule: how each story stands after its last contact."""
    ends = contacts(t).groupBy("story").agg(F.max_by(F.struct("at", "kind", "topic", "data_end"), F.struct("at", "interaction_id")).alias("e")).select("story", "e.*")
    outcome = F.when(rules.has_content(F.col("kind")), F.when(F.col("topic") == "1-URGENT", "not_resolved").when(F.col("topic") == "2-HIGH", "resolved"))
    kept = promises(t).select("story", "made_at", (F.col("outcome") != "kept").alias("open"))
    # a promise may be noted up to a second before the contact's own time
    waiting = ends.join(kept, "story").where(F.col("made_at") >= F.col("at") - F.expr("INTERVAL 1 SECOND")).groupBy("story").agg(F.max("open").alias("pending"))
    # an execution after the last contact is the last of all, if any is
    done = executions(t).groupBy("story").agg(F.max("done_at").alias("done_at"))
    last = ends.join(waiting, "story", "left").join(done, "story", "left").select(
        "story",
        "kind",
        "data_end",
        outcome.alias("outcome"),
        F.coalesce("pending", F.lit(False)).alias("pending"),
        F.when(F.col("done_at") > F.col("at"), F.col("done_at")).alias("executed_at"),
    )
    return rules.story_status(last, 7)


@query(f"""
    with {CONTACTS}, line as (select *, lag(moment) over (partition by story order by moment, interaction_id) as before from contacts)
    select interaction_id, (select count(*) from executions e where e.story = l.story and e.done_at > l.before and e.done_at < l.moment) as n_between from line l
""")
def executions_between(t: Tables) -> DataFrame:
    """What was done on the account between a contact and the one before."""
    return rules.executions_between(contacts(t), executions(t)).select("interaction_id", "n_between")


@query(f"""
    with {CONTACTS}, gaps as (
        select date_diff('hour', lag(moment) over (partition by story order by moment, interaction_id), moment) as hours from contacts
    )
    select case when hours <= 1 then 0 when hours <= 4 then 1 when hours <= 24 then 2 when hours <= 72 then 3 when hours <= 168 then 4 else 5 end as bucket, count(*) as n
    from gaps where hours is not null group by 1
""")
def gap_buckets(t: Tables) -> DataFrame:
    """Gaps before contacts, up to one hour, 4, 24, 72, 168 and more."""
    line = Window.partitionBy("story").orderBy("at", "interaction_id")
    hours = F.timestamp_diff("SECOND", F.lag("at").over(line), F.col("at")) / 3600
    rows = contacts(t).select(rules.gap_bucket(hours).alias("bucket")).where("bucket is not null")
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""
    with {quality.CARDS}
    select case when total >= 80 then 4 when total >= 60 then 3 when total >= 40 then 2 else 1 end as band,
        case when seconds * 20 < 0 then null when seconds * 20 < 180 then 'short' when seconds * 20 < 360 then 'mid' when seconds * 20 < 600 then 'long' else 'xlong' end as bucket, count(*) as n
    from scored group by 1, 2
""")
def score_bands(t: Tables) -> DataFrame:
    """Cards by band of their total and by length of the call."""
    rows = quality.cards(t)
    keys = [rules.score_band(F.col("total")).alias("band"), rules.duration_bucket(F.col("seconds") * 20).alias("bucket")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


_HELD = [(m, he) for m, he in rules.HELD_REASONS.items()]


@query(f"""
    with errors as (
        select l_orderkey * 10 + l_linenumber as call_id,
            case when l_quantity < 20 then 'recording is only ' || cast(l_linenumber as varchar) || 's long; ' else '' end
            || case when l_tax > 0.06 then 'redaction was DISABLED; ' else '' end || case when l_discount > 0.08 then 'judge output failed after 3 tries' else '' end as error
        from lineitem
    ), reasons as (
        select call_id, list_filter([{", ".join(f"case when contains(error, '{m}') then '{he}' end" for m, he in _HELD)}], lambda x: x is not null) as found from errors
    ), shown as (select call_id, unnest(case when len(found) > 0 then found else ['{rules.HELD_OTHER}'] end) as reason from reasons)
    select reason, count(*) as calls from shown group by 1
""")
def held_reasons(t: Tables) -> DataFrame:
    """Why calls are held, by what their errors say."""
    parts = [
        F.when(F.col("l_quantity") < 20, F.concat(F.lit("recording is only "), F.col("l_linenumber").cast("string"), F.lit("s long; "))),
        F.when(F.col("l_tax") > 0.06, F.lit("redaction was DISABLED; ")),
        F.when(F.col("l_discount") > 0.08, F.lit("judge output failed after 3 tries")),
    ]
    error = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return t.lineitem.select(F.explode(rules.held_reasons(error)).alias("reason")).groupBy("reason").agg(F.count("*").alias("calls"))


@query("""
    with calls as (
        select l_orderkey * 10 + l_linenumber as call_id, l_quantity as duration, l_quantity * 0.5 as speech, case l_returnflag when 'A' then 'mono_diarized' when 'R' then 'stereo_inferred' else 'stereo' end as mode,
            l_discount * 4 as confidence, l_tax > 0.01 as redacted, case when l_linenumber > 5 then [1, l_linenumber] else [] end as conflicts from lineitem
    )
    select call_id, concat_ws('; ', case when duration < 20 then 'recording is only ' || printf('%.1f', duration) || 's long' end,
        case when speech < 10 then 'only ' || printf('%.1f', speech) || 's of speech was detected in this recording' end,
        case when mode <> 'stereo' and confidence < 0.34 then 'speaker roles inferred with low confidence (' || printf('%.2f', confidence) || ' < 0.34)' end,
        case when len(conflicts) > 0 then 'speaker roles disagree within recorded part(s) ' || array_to_string(conflicts, ', ') end,
        case when not redacted then 'redaction was DISABLED for this call; the transcript, the judge prompt and this report contain raw customer identifiers' end) as flags
    from calls
""")
def review_flags(t: Tables) -> DataFrame:
    """What calls need a reviewer for."""
    flag = F.col("l_returnflag")
    mode = F.when(flag == "A", "mono_diarized").when(flag == "R", "stereo_inferred").otherwise("stereo")
    conflicts = F.when(F.col("l_linenumber") > 5, F.array(F.lit(1), F.col("l_linenumber").cast("int"))).otherwise(F.array().cast("array<int>"))
    flags = rules.review_flags(
        F.col("l_quantity").cast("double"), F.col("l_quantity") * 0.5, mode, F.col("l_discount") * 4, conflicts, F.col("l_tax") > 0.01
    )
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.array_join(flags, "; ").alias("flags"))


@query(f"""
    with {journey.ACTIVITY}, rows as (
        select account, cast(moment as date) as day, row_order, op, op || ' ' || (k % 3) as d, row_number() over (partition by account, cast(moment as date), op || ' ' || (k % 3) order by row_order) as n
        from activity where op <> 'view'
    ), firsts as (select *, row_number() over (partition by account, day order by row_order) as place from rows where n = 1)
    select account, day, string_agg(d, ' | ' order by row_order) as ops from firsts where place <= 3 group by 1, 2
""")
def operation_texts(t: Tables) -> DataFrame:
    """The first three different operations of an account's day."""
    log = journey.activity(t).where("op <> 'view'")
    op = F.struct(
        "row_order",
        F.when(F.col("op") == "view", "open").otherwise("info").alias("kind"),
        F.concat_ws(" ", "op", (F.col("k") % 3).cast("string")).alias("description"),
    )
    # a day's operations, of which each kind is kept once, as three of them are shown
    first = log.groupBy("account", F.to_date("at").alias("day"), "op", F.col("k") % 3).agg(F.min_by(op, "row_order").alias("op_row"))
    by = first.groupBy("account", "day").agg(F.array_sort(F.collect_list("op_row")).alias("ops"))
    return by.select("account", "day", rules.operations_text(F.col("ops")).alias("ops"))


@query("""
    select o_orderkey, case when round(abs(v), 1) = 0 then '0' else (case when v < 0 then '−' else '' end)
        || rtrim(rtrim(format('{:,.1f}', cast(round(abs(v), 1) as double)), '0'), '.') end as short,
        (case when round(v, 2) < 0 then '−' else '' end) || format('{:,.2f}', cast(round(abs(v), 2) as double)) as fixed
    from (select o_orderkey, cast(o_totalprice - 150000 as decimal(18, 4)) as v from orders)
""")
def shown_numbers(t: Tables) -> DataFrame:
    """Numbers as they are shown, with at most one decimal and with two."""
    v = (F.col("o_totalprice") - 150000).cast("decimal(18,4)")
    return t.orders.select("o_orderkey", text.shown_number(v, 1).alias("short"), text.fixed_number(v, 2).alias("fixed"))


@query(f"""
    with {CONTACTS}, s as (select story, count(*) as n, count(distinct channel) as k from contacts group by 1)
    select unnest(['stories', 'interactions', 'returns', 'calls', 'recorded_calls', 'unrecorded_calls', 'correspondences', 'messages', 'audio_files_mapped', 'multi_file_calls']) as figure,
        unnest([(select count(*) from s), count(*), count(*) - (select count(*) from s), count(*) filter (channel = 'call'), count(*) filter (channel = 'call' and recorded),
            count(*) filter (channel = 'call' and not recorded), count(*) filter (channel = 'message'), (select count(*) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'O'),
            (select count(*) from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F'),
            (select count(*) from (select l_orderkey from lineitem join orders on l_orderkey = o_orderkey where o_orderstatus = 'F' group by 1 having count(*) > 1))]) as value
    from contacts
""")
def import_counts(t: Tables) -> DataFrame:
    """What an import brought in."""
    parts = t.lineitem.groupBy(F.col("l_orderkey").alias("interaction_id")).agg(F.count("*").alias("n_parts"))
    rows = contacts(t).select("story", "interaction_id", "channel", "recorded").join(parts, "interaction_id", "left")
    is_call, n = F.col("channel") == "call", F.coalesce("n_parts", F.lit(0))
    of = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    one = rows.agg(
        F.countDistinct("story").alias("stories"),
        F.count("*").alias("interactions"),
        (F.count("*") - F.countDistinct("story")).alias("returns"),
        F.count_if(is_call).alias("calls"),
        F.count_if(is_call & F.col("recorded")).alias("recorded_calls"),
        F.count_if(is_call & ~F.col("recorded")).alias("unrecorded_calls"),
        F.count_if(F.col("channel") == "message").alias("correspondences"),
        of(F.col("channel") == "message").alias("messages"),
        of(is_call).alias("audio_files_mapped"),
        F.count_if(is_call & (n > 1)).alias("multi_file_calls"),
    )
    return one.unpivot([], one.columns, "figure", "value")


@query(f"""
    with {CONTACTS}, got as (select kind, avg(len(units)) as v from contacts where direction = 'inbound' group by 1),
    want as (select kind, round(avg(len(units)), 1) as v from contacts group by 1 union all select 'walk_in', 1.0)
    select w.kind, round(w.v, 6) as want, round(g.v, 6) as got from want w left join got g using (kind) where g.v is null or abs(round(g.v, 1) - w.v) > 0.05
""")
def expected_figures(t: Tables) -> DataFrame:
    """Figures of one run that differ from those of another."""
    rows = contacts(t).withColumn("n", F.size("units"))
    got = rows.where("direction = 'inbound'").groupBy("kind").agg(F.avg("n").alias("v"))
    want = rows.groupBy("kind").agg(F.round(F.avg("n"), 1).alias("v")).unionByName(rows.sparkSession.createDataFrame([("walk_in", 1.0)], "kind string, v double"))
    return rules.differences(got, want, ["kind"], "v").select("kind", r6("want").alias("want"), r6("got").alias("got"))


@query(f"""
    with {journey.SESSIONS}, a as (select count(*) as sessions, cast(sum(ops) as bigint) as ops from sessions), n as (select count(*) as log_rows, min(moment) as first_at from activity),
    o as (select count(*) as unknown from (select distinct account from activity) left join customer on c_custkey = account where c_custkey is null)
    select unnest(['sessions', 'rows_in_sessions', 'rows', 'accounts_unknown']) as figure, unnest([sessions, ops, log_rows, unknown]) as value,
        unnest([sessions > 0, ops = log_rows, first_at is not null, unknown = 0]) as ok from a, n, o
""")
def completeness_checks(t: Tables) -> DataFrame:
    """whether sessions hold all rows of the log, and whether its accounts are known."""
    log = journey.activity(t)
    s = journey.sessions(t).agg(F.count("*").alias("sessions"), F.sum("ops").alias("rows_in_sessions"))
    n = log.agg(F.count("*").alias("rows"))
    unknown = log.select("account").distinct().join(t.customer, F.col("account") == F.col("c_custkey"), "left_anti")
    one = s.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(unknown.agg(F.count("*").alias("accounts_unknown"))))  # one row each
    ok = F.when(F.col("figure") == "accounts_unknown", F.col("value") == 0).when(F.col("figure") == "rows_in_sessions", F.col("value") == F.col("rows")).otherwise(F.col("value") > 0)
    long = one.withColumn("all_rows", F.col("rows")).unpivot(["all_rows"], ["sessions", "rows_in_sessions", "rows", "accounts_unknown"], "figure", "value")
    return long.withColumnRenamed("all_rows", "rows").select("figure", "value", ok.alias("ok"))


@query("""
    with s as (select o_custkey as story, count(*) - 1 as returns, row_number() over (order by min(o_orderdate), o_custkey) as story_no from orders group by 1)
    select story, story_no, returns from s order by returns desc, story_no limit 20
""")
def prioritised_stories(t: Tables) -> DataFrame:
    """2.7: the twenty stories with most returns, in the order in which they are worked through."""
    rows = t.orders.select(F.col("o_custkey").alias("story"), F.col("o_orderdate").alias("at"))
    numbers = journey.sequences.number_groups(rows, "story", "at").select("story", "story_no")
    return rules.stories_first(rows.join(numbers, "story"), "story", "story_no", 20)


@query("""
    with c as (select l_suppkey as agent, l_returnflag || l_linestatus as code, count(*) as n from lineitem group by 1, 2),
    p as (select *, row_number() over (partition by agent order by n desc, code) as place from c) select agent, code, n from p where place <= 2
""")
def busiest_codes(t: Tables) -> DataFrame:
    """2.7: each agent's two commonest codes, ties by code."""
    by = t.lineitem.groupBy(F.col("l_suppkey").alias("agent"), F.concat("l_returnflag", "l_linestatus").alias("code")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), "code"))
    return by.withColumn("place", place).where("place <= 2").drop("place")


@query("""
    with f as (
        select l_orderkey, lower('Key-' || l_orderkey) as call_key, case when l_linenumber % 2 = 0 then 'PART' else 'part' end || (l_partkey % 3) as file_name,
            case when l_returnflag = 'R' then null else 10 - l_linenumber end as seq, l_linenumber * 1000000 + l_partkey as row_no from lineitem
    ), o as (select *, coalesce(seq, row_no) as o from f),
    u as (select *, row_number() over (partition by call_key, lower(file_name) order by o, row_no) as n from o)
    select call_key, file_name, row_number() over (partition by call_key order by o, row_no) as place from u where n = 1
""")
def files_of_calls(t: Tables) -> DataFrame:
    """F13, 2.8: the files of each call in order, each name once in whatever case."""
    name = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "PART").otherwise("part"), (F.col("l_partkey") % 3).cast("string"))
    files = t.lineitem.select(
        F.concat(F.lit("Key-"), F.col("l_orderkey").cast("string")).alias("call_key"),
        name.alias("file_name"),
        F.when(F.col("l_returnflag") != "R", 10 - F.col("l_linenumber")).alias("seq"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("row_no"),
    )
    found = rules.ordered_files(files, "call_key", "file_name", "seq", "row_no")
    return found.withColumn("place", F.col("place").cast("long"))


@query("""
    with runs as (select distinct o_orderkey as call_id from orders where o_orderdate >= date '1997-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH'))
    select l_suppkey as agent, count(*) as cards from lineitem where l_orderkey in (select call_id from runs) and l_returnflag in ('A', 'N') group by 1
""")
def run_members(t: Tables) -> DataFrame:
    """Cards of the calls of a run, by date and type."""
    run = t.orders.where("o_orderdate >= date '1997-01-01' and o_orderpriority in ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").alias("l_orderkey"))
    members = t.lineitem.where(F.col("l_returnflag").isin("A", "N")).join(run, "l_orderkey", "left_semi")
    return members.groupBy(F.col("l_suppkey").alias("agent")).agg(F.count("*").alias("cards"))

"""Customer journeys: the activity log is `events`, contacts are its sign-ups and errors, stories `orders` by customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import matching, ranges, sequences
from .registry import Tables, query, r6

#: Sort of an operation by what it does, strongest first.
KIND_RANK = {"execute": 5, "info": 4, "unclassified": 3, "open": 2, "not_customer": 1}
OP_KIND = {"purchase": "execute", "click": "info", "signup": "unclassified", "view": "open", "error": "not_customer"}

ACTIVITY = """
    activity as (
        select user_id as account, ts as moment, event_id as row_order, event_type as op, value,
            cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k,
            'B' || (cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 2) as banker,
            cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 5 as unit
        from events
    )
"""
SESSIONS = f"""
    {ACTIVITY}, flagged as (
        select *, case when lag(moment) over w is null or lag(moment) over w + interval 30 minutes < moment or op = 'view'
            or lag(banker) over w is distinct from banker then 1 else 0 end as new
        from activity window w as (partition by account order by moment, row_order)
    ), numbered as (
        select *, sum(new) over (partition by account order by moment, row_order rows unbounded preceding) as session_no
        from flagged
    ), sessions as (
        select account, cast(session_no as bigint) as session_no, min(moment) as first_at, max(moment) as last_at, count(*) as ops,
            max(case op when 'purchase' then 5 when 'click' then 4 when 'signup' then 3 when 'view' then 2 else 1 end) as kind_rank,
            arg_min(banker, row_order) as banker, arg_min(unit, row_order) as unit
        from numbered group by account, session_no
    )
"""


def activity(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        F.col("user_id").alias("account"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("row_order"),
        F.col("event_type").alias("op"),
        "value",
        k.alias("k"),
        F.concat(F.lit("B"), (k % 2).cast("string")).alias("banker"),
        (k % 5).alias("unit"),
    )


def sessions(t: Tables) -> DataFrame:
    rows = sequences.sessionise(
        activity(t), ["account"], "at", ["at", "row_order"], 30, ["banker"], F.col("op") == "view"
    )
    rank = F.element_at(F.create_map(*[F.lit(x) for op, kind in OP_KIND.items() for x in (op, KIND_RANK[kind])]), F.col("op"))
    return rows.groupBy("account", "session_no").agg(
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.count("*").alias("ops"),
        F.max(rank).alias("kind_rank"),
        F.min_by("banker", "row_order").alias("banker"),
        F.min_by("unit", "row_order").alias("unit"),
    )


@query(f"with {SESSIONS} select account, session_no, first_at, last_at, ops, kind_rank, banker, unit from sessions")
def log_sessions(t: Tables) -> DataFrame:
    """Sessions by gap, agent and opening code, with their strongest operation."""
    return sessions(t)


CONTACTS = """
    contacts as (
        select account as c_account, moment as contact_at, row_order as contact_id,
            moment - interval 20 minutes as lo, moment + to_minutes(cast(30 + k as bigint)) as hi
        from activity where op in ('signup', 'error')
    )
"""


def contacts(t: Tables) -> DataFrame:
    return (
        activity(t)
        .where(F.col("op").isin("signup", "error"))
        .select(
            "account",
            F.col("at").alias("contact_at"),
            F.col("row_order").alias("contact_id"),
            (F.col("at") - F.expr("INTERVAL 20 MINUTES")).alias("lo"),
            (F.col("at") + F.make_dt_interval(mins=(F.lit(30) + F.col("k")).cast("int"))).alias("hi"),
        )
    )


@query(f"""
    with {SESSIONS}, {CONTACTS}, pairs as (
        select s.account, s.session_no, c.contact_id, row_number() over (
            partition by s.account, s.session_no
            order by abs(epoch_us(s.first_at) - epoch_us(c.contact_at)), c.contact_at, c.contact_id) as n
        from sessions s join contacts c on c.c_account = s.account and s.first_at between c.lo and c.hi
    )
    select s.account, s.session_no, s.first_at, s.ops, s.kind_rank, p.contact_id
    from sessions s left join pairs p on p.account = s.account and p.session_no = s.session_no and p.n = 1
""")
def flagship(t: Tables) -> DataFrame:
    """J7 on W1: each session with the nearest contact whose window holds its start."""
    found = matching.attach_nearest(
        sessions(t), contacts(t), ["account"], "session_no", "first_at", "lo", "hi", "contact_at", "contact_id"
    )
    return found.select("account", "session_no", "first_at", "ops", "kind_rank", "contact_id")


STORIES = """
    stories as (
        select o_custkey as story, o_orderdate as moment, o_orderkey as interaction_id, o_orderstatus as channel,
            o_orderpriority as category, o_totalprice as value,
            row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as contact_index,
            lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous_at
        from orders
    )
"""


def stories(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("story"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderkey").alias("interaction_id"),
        F.col("o_orderstatus").alias("channel"),
        F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("value"),
    )
    rows = sequences.index_rows(rows, ["story"], ["at", "interaction_id"])
    return rows.withColumn("previous_at", F.lag("at").over(Window.partitionBy("story").orderBy("at", "interaction_id")))


@query(f"""
    with {STORIES} select story, interaction_id, contact_index, contact_index > 0 as is_return,
        date_diff('day', previous_at, moment) as gap_days,
        case when previous_at is null then null when moment <= previous_at + interval 1 day then 'day'
            when moment <= previous_at + interval 7 days then 'week' when moment <= previous_at + interval 30 days then 'month'
            else 'later' end as gap_bucket
    from stories
""")
def contact_order(t: Tables) -> DataFrame:
    """Place of a contact in its story, and the gap before it."""
    within = lambda days: F.col("at") <= F.col("previous_at") + F.expr(f"INTERVAL {days} DAYS")
    bucket = F.when(F.col("previous_at").isNull(), None).when(within(1), "day").when(within(7), "week").when(within(30), "month")
    return stories(t).select(
        "story",
        "interaction_id",
        F.col("contact_index").cast("long").alias("contact_index"),
        "is_return",
        F.datediff("at", "previous_at").cast("long").alias("gap_days"),
        bucket.otherwise("later").alias("gap_bucket"),
    )


@query("""
    select o_custkey as story, min(o_orderdate) as first_at,
        row_number() over (order by min(o_orderdate), o_custkey) as story_no
    from orders group by o_custkey
""")
def story_numbers(t: Tables) -> DataFrame:
    """Stories numbered by their first contact."""
    rows = t.orders.select(F.col("o_custkey").alias("story"), F.col("o_orderdate").alias("at"))
    return sequences.number_groups(rows, "story", "at")


DAYS = f"""
    {ACTIVITY}, days as (
        select account, cast(moment as date) as day,
            list_sort(list_distinct(list(unit) filter (where op = 'purchase'))) as units
        from activity group by 1, 2
    )
"""


@query(f"""
    with {DAYS}, full_days as (select * from days where len(units) > 0), seen as (
        select account, day, units <> lag(units) over (partition by account order by day) as moved from full_days
    )
    select d.account, d.day, cast(coalesce(len(d.units), 0) as bigint) as n_units, coalesce(s.moved, false) as changed
    from days d left join seen s using (account, day)
""")
def unit_set_changes(t: Tables) -> DataFrame:
    """Days whose set of executing units differs from the last set that isn't empty."""
    units = F.collect_set(F.when(F.col("op") == "purchase", F.col("unit")))
    days = activity(t).groupBy("account", F.to_date("at").alias("day")).agg(units.alias("units"))
    found = sequences.changed_set(days, ["account"], ["day"], "units")
    return found.select("account", "day", F.size("units").cast("long").alias("n_units"), "changed")


@query(f"""
    with {SESSIONS}, steps as (
        select unit as to_unit, lag(unit) over (partition by account order by first_at, session_no) as from_unit from sessions
    )
    select from_unit, to_unit, count(*) as n from steps where from_unit <> to_unit group by 1, 2
""")
def hand_off_matrix(t: Tables) -> DataFrame:
    """Moves between units in consecutive sessions."""
    moved = sequences.hand_offs(sessions(t), ["account"], ["first_at", "session_no"], "unit")
    return moved.groupBy(F.col("from_label").alias("from_unit"), F.col("to_label").alias("to_unit")).agg(F.count("*").alias("n"))


@query(f"""
    with {SESSIONS}, named as (
        select s.*, n.n_regionkey as region, c.c_nationkey as own
        from sessions s join customer c on c.c_custkey = s.account join nation n on n.n_nationkey = s.unit
    )
    select case when unit = 0 then 'center' when unit = 1 then 'back' when unit = own % 5 then 'own' else 'other' end as class,
        count(*) as sessions, cast(sum(ops) as bigint) as ops, count(distinct account) as accounts,
        round(avg(date_diff('microsecond', first_at, last_at) / 6e7), 6) as minutes
    from named group by 1
""")
def unit_classes(t: Tables) -> DataFrame:
    """Sessions by class of unit, against the customer's own."""
    named = (
        sessions(t)
        .join(t.customer, F.col("account") == F.col("c_custkey"))
        .join(t.nation, F.col("unit") == F.col("n_nationkey"))
    )
    own = F.col("c_nationkey") % 5
    cls = F.when(F.col("unit") == 0, "center").when(F.col("unit") == 1, "back").when(F.col("unit") == own, "own").otherwise("other")
    minutes = F.timestamp_diff("MICROSECOND", "first_at", "last_at") / 6e7
    return named.groupBy(cls.alias("class")).agg(
        F.count("*").alias("sessions"),
        F.sum("ops").alias("ops"),
        F.countDistinct("account").alias("accounts"),
        r6(F.avg(minutes)).alias("minutes"),
    )


@query(f"""
    with {ACTIVITY}
    select a.row_order, (select min(b.moment) from activity b where b.account = a.account and b.op = 'purchase' and b.moment > a.moment) as next_execute,
        (select min(b.moment) from activity b where b.account = a.account and b.op = 'purchase' and b.moment >= a.moment) as response
    from activity a where a.op in ('signup', 'purchase')
""")
def next_events(t: Tables) -> DataFrame:
    """The first execution after a contact, and at or after it."""
    log = activity(t)
    rows = log.where(F.col("op").isin("signup", "purchase")).select("account", "at", "row_order")
    done = log.where("op = 'purchase'").select("account", F.col("at").alias("done_at"))
    found = matching.next_after(rows, done, ["account"], "at", "done_at", False, "next_execute")
    found = matching.next_after(found, done, ["account"], "at", "done_at", True, "response")
    return found.select("row_order", "next_execute", "response")


PROMISES = f"""
    {ACTIVITY}, promises as (
        select account, row_order, moment, moment + interval 2 days as due from activity where op = 'signup'
    ), actions as (
        select account as a_account, moment as action_at, case op when 'purchase' then 'execute' else 'bank_contact' end as how
        from activity where op = 'purchase' or (op = 'error' and k % 2 = 0)
    ), kept as (
        select p.row_order, min(struct_pack(action_at := a.action_at, how := a.how)) as first
        from promises p join actions a on a.a_account = p.account and a.action_at > p.moment and a.action_at <= p.due
        group by 1
    ), back as (
        select p.row_order, min(c.moment) as back_at from promises p join activity c
            on c.account = p.account and c.op = 'click' and c.moment > p.moment group by 1
    ), judged as (
        select p.row_order, k.first.how as how, case
            when b.back_at is not null and b.back_at <= p.due and (k.first is null or b.back_at < k.first.action_at) then 'broken'
            when k.first is not null then 'kept' when b.back_at is not null then 'broken' else 'unknown' end as outcome
        from promises p left join kept k using (row_order) left join back b using (row_order)
    )
"""


def promises(t: Tables) -> DataFrame:
    log = activity(t)
    made = log.where("op = 'signup'").select("account", "row_order", "at", (F.col("at") + F.expr("INTERVAL 2 DAYS")).alias("due"))
    acts = log.where("op = 'purchase' or (op = 'error' and k % 2 = 0)").select(
        "account", F.col("at").alias("did_at"), F.when(F.col("op") == "purchase", "execute").otherwise("bank_contact").alias("how")
    )
    found = matching.first_action(made, acts, ["account"], "row_order", "at", "due", "did_at", "how")
    clicks = log.where("op = 'click'").select("account", F.col("at").alias("click_at"))
    found = matching.next_after(found, clicks, ["account"], "at", "click_at", False, "back_at")
    early = (F.col("back_at") <= F.col("due")) & (F.col("action_at").isNull() | (F.col("back_at") < F.col("action_at")))
    outcome = (
        F.when(early, "broken").when(F.col("action_at").isNotNull(), "kept").when(F.col("back_at").isNotNull(), "broken").otherwise("unknown")
    )
    return found.select("row_order", F.col("action").alias("how"), outcome.alias("outcome"))


@query(f"with {PROMISES} select row_order, how, outcome from judged")
def promise_checks(t: Tables) -> DataFrame:
    """J9 and the promise rule: acted on in time, or did the customer come back first."""
    return promises(t)


@query(f"""
    with {PROMISES} select outcome, count(*) as n,
        round(count(*) / (select count(*) from judged where outcome <> 'unknown'), 6) as share from judged group by 1
""")
def promise_funnel(t: Tables) -> DataFrame:
    """Outcomes, as shares of the settled ones."""
    by = promises(t).groupBy("outcome").agg(F.count("*").alias("n"))
    settled = F.sum(F.when(F.col("outcome") != "unknown", F.col("n"))).over(Window.partitionBy())
    return by.select("outcome", "n", r6(F.col("n") / settled).alias("share"))


@query(f"""
    with {ACTIVITY}, votes as (
        select account, unit, count(*) as n, min(row_order) as first_seen from activity group by 1, 2
    ), placed as (
        select *, row_number() over (partition by account order by n desc, first_seen) as place from votes
    )
    select account, unit, n from placed where place = 1
""")
def account_units(t: Tables) -> DataFrame:
    """Each account's unit by majority, ties to the first seen."""
    return matching.majority(activity(t), "account", "unit", "row_order")


@query(f"""
    with {ACTIVITY}, pairs as (
        select c.row_order, b.row_order as candidate, abs(epoch_us(c.moment) - epoch_us(b.moment)) / 1e6 as gap, b.moment as other_at
        from activity c join activity b on b.account = c.account where c.op = 'signup' and b.op = 'error'
    ), marked as (
        select *, max(gap <= 36000) over (partition by row_order) as any_near,
            row_number() over (partition by row_order order by gap, other_at) as place from pairs
    )
    select row_order, count(*) as candidates, bool_or(any_near) as near, round(min(gap), 6) as gap
    from marked where not any_near or place = 1 group by 1
""")
def nearest_references(t: Tables) -> DataFrame:
    """The nearest candidate by key within a tolerance, else all of them."""
    log = activity(t)
    left = log.where("op = 'signup'").select("account", "row_order", "at")
    right = log.where("op = 'error'").select("account", F.col("row_order").alias("candidate"), F.col("at").alias("other_at"))
    found = matching.nearest_or_all(left, right, "account", "row_order", "at", "other_at", 36000)
    return found.groupBy("row_order").agg(F.count("*").alias("candidates"), F.max("any_near").alias("near"), r6(F.min("gap")).alias("gap"))


@query(f"""
    with {SESSIONS}, pairs as (
        select a.row_order, s.session_no, row_number() over (partition by a.row_order order by s.first_at, s.session_no) as n
        from activity a join sessions s on s.account = a.account and s.banker = a.banker and a.moment between s.first_at and s.last_at
    )
    select a.row_order, p.session_no from activity a left join pairs p on p.row_order = a.row_order and p.n = 1
""")
def rows_in_sessions(t: Tables) -> DataFrame:
    """Each log row in the earliest session of its account and agent that holds it."""
    spans = sessions(t).select("account", "banker", "session_no", "first_at", "last_at")
    rows = activity(t).select("account", "banker", "row_order", "at")
    found = matching.first_containing(rows, spans, ["account", "banker"], "row_order", "at", "first_at", "last_at", "session_no")
    return found.select("row_order", "session_no")


@query(f"""
    with {STORIES}, ends as (select max(moment) as data_end from stories), votes as (
        select story, category, count(*) as n, min(contact_index) as first_seen from stories group by 1, 2
    ), topics as (
        select story, category from (
            select *, row_number() over (partition by story order by n desc, first_seen) as place from votes) where place = 1
    )
    select s.story, count(*) as contacts, count(*) - 1 as returns, min(s.moment) as first_at, max(s.moment) as last_at,
        count(distinct s.channel) as channels, round(sum(s.value), 2) as value, any_value(t.category) as topic,
        case when max(s.moment) + interval 7 days <= any_value(e.data_end) and arg_max(s.channel, s.contact_index) = 'F' then 'closed'
            when max(s.moment) + interval 7 days <= any_value(e.data_end) then 'quiet' else 'unclear' end as status
    from stories s join topics t using (story) cross join ends e group by s.story
""")
def story_summary(t: Tables) -> DataFrame:
    """A13 and story status: one row for each story."""
    rows = stories(t)
    topic = matching.majority(rows, "story", "category", "contact_index").select("story", F.col("category").alias("topic"))
    end = rows.agg(F.max("at").alias("data_end"))
    by = rows.groupBy("story").agg(
        F.count("*").alias("contacts"),
        (F.count("*") - 1).alias("returns"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.countDistinct("channel").alias("channels"),
        F.round(F.sum("value"), 2).alias("value"),
        F.max_by("channel", "contact_index").alias("_last"),
    )
    quiet = F.col("last_at") + F.expr("INTERVAL 7 DAYS") <= F.col("data_end")
    status = F.when(quiet & (F.col("_last") == "F"), "closed").when(quiet, "quiet").otherwise("unclear")
    return by.join(topic, "story").crossJoin(F.broadcast(end)).withColumn("status", status).drop("_last", "data_end")  # one row


@query(f"""
    with {STORIES} select category, count(*) filter (channel = 'F') as f, count(*) filter (channel = 'O') as o,
        count(*) filter (channel = 'P') as p from stories where contact_index > 0 group by 1
""")
def category_by_channel(t: Tables) -> DataFrame:
    """Returns by category and channel."""
    back = stories(t).where("is_return")
    return back.groupBy("category").agg(*[F.count_if(F.col("channel") == c).alias(c.lower()) for c in "FOP"])


@query(f"""
    with {STORIES}, n as (select story, count(*) - 1 as returns from stories group by 1)
    select case when returns >= 4 then '4+' else cast(returns as varchar) end as returns, count(*) as stories from n group by 1
""")
def returns_distribution(t: Tables) -> DataFrame:
    """Stories by number of returns, from four on together."""
    n = stories(t).groupBy("story").agg((F.count("*") - 1).alias("n"))
    return n.groupBy(F.when(F.col("n") >= 4, "4+").otherwise(F.col("n").cast("string")).alias("returns")).agg(F.count("*").alias("stories"))


@query(f"""
    with {ACTIVITY}, waits as (
        select a.account, a.moment, (select min(b.moment) from activity b where b.account = a.account and b.moment > a.moment
            and b.op in ('click', 'purchase')) as next_at
        from activity a where a.op = 'error'
    )
    select count(*) as abandoned, count(next_at) as came_back,
        count(*) filter (next_at <= moment + interval 1 day) as within_a_day,
        round(median(date_diff('microsecond', moment, next_at) / 3.6e9), 6) as median_hours
    from waits
""")
def after_abandon(t: Tables) -> DataFrame:
    """What follows an abandoned contact, and the median wait."""
    log = activity(t)
    left = log.where("op = 'error'").select("account", "at")
    then = log.where(F.col("op").isin("click", "purchase")).select("account", F.col("at").alias("then_at"))
    waits = matching.next_after(left, then, ["account"], "at", "then_at", False, "next_at")
    waits = waits.withColumn("hours", F.timestamp_diff("MICROSECOND", "at", "next_at") / 3.6e9)
    counts = waits.agg(
        F.count("*").alias("abandoned"),
        F.count("next_at").alias("came_back"),
        F.count_if(F.col("next_at") <= F.col("at") + F.expr("INTERVAL 1 DAY")).alias("within_a_day"),
    )
    middle = ranges.exact_quantiles(waits, [], "hours", {"median_hours": 0.5})
    return counts.crossJoin(F.broadcast(middle)).withColumn("median_hours", r6("median_hours"))  # one row each


SURVIVAL = f"""
    {STORIES}, lives as (
        select c.c_mktsegment as segment, coalesce(min(s.moment) filter (s.contact_index = 1), (select max(moment) from stories)) as until,
            min(s.moment) as since, count(*) > 1 as returned
        from stories s join customer c on c.c_custkey = s.story group by s.story, c.c_mktsegment
    ), times as (select segment, date_diff('day', since, until) as t, returned from lives),
    counts as (select segment, t, count(*) as n, sum(returned::int) as events from times group by 1, 2),
    risks as (select *, sum(n) over (partition by segment order by t desc) as at_risk from counts),
    steps as (select segment, cast(t as double) as t, cast(at_risk as bigint) as at_risk, cast(events as bigint) as events,
        product(1 - events / at_risk) over (partition by segment order by t) as survival from risks),
    curve as (select segment, t, at_risk, events, survival from steps where t > 0
        union all select segment, 0.0, cast(max(at_risk) as bigint), 0, 1.0 from steps group by segment)
"""


def survival_curve(t: Tables) -> DataFrame:
    rows = stories(t)
    end = rows.agg(F.max("at").alias("data_end"))
    lives = rows.groupBy("story").agg(
        F.min("at").alias("since"), F.min(F.when(F.col("contact_index") == 1, F.col("at"))).alias("back"), (F.count("*") > 1).alias("returned")
    )
    lives = lives.crossJoin(F.broadcast(end)).join(t.customer, F.col("story") == F.col("c_custkey"))  # one row
    times = lives.select(
        F.col("c_mktsegment").alias("segment"), F.datediff(F.coalesce("back", "data_end"), "since").alias("days"), "returned"
    )
    return sequences.kaplan_meier(times, ["segment"], "days", "returned")


@query(f"with {SURVIVAL} select segment, t, at_risk, events, round(survival, 6) as survival from curve")
def return_survival(t: Tables) -> DataFrame:
    """Days to the first return by segment, stories without one censored at the data's end."""
    return survival_curve(t).withColumn("survival", r6("survival"))


@query(f"with {SURVIVAL} select segment, min(t) filter (survival <= 0.5 + 1e-12) as median from curve group by 1")
def return_median(t: Tables) -> DataFrame:
    return sequences.survival_median(survival_curve(t), ["segment"])


@query(f"""
    with {SESSIONS}, {CONTACTS}, per_account as (
        select account, count(*) as n_sessions, count(distinct banker) as bankers, count(distinct unit) as units,
            count(*) filter (kind_rank = 5) as executing, min(first_at) filter (kind_rank = 5) as first_execution
        from sessions group by 1
    ), firsts as (select c_account as account, min(contact_at) as first_contact, max(contact_at) as last_contact, count(*) as n_contacts from contacts group by 1)
    select p.account, n_contacts, n_sessions, bankers, units, executing,
        round(date_diff('microsecond', first_contact, first_execution) / 3.6e9, 6) as hours_to_execution,
        (select count(*) from sessions s where s.account = p.account and s.kind_rank = 5 and s.first_at > f.last_contact) as executed_after
    from per_account p join firsts f using (account)
""")
def account_sessions(t: Tables) -> DataFrame:
    """What each account's sessions add up to, around its contacts."""
    c = contacts(t).groupBy("account").agg(
        F.min("contact_at").alias("first_contact"), F.max("contact_at").alias("last_contact"), F.count("*").alias("n_contacts")
    )
    s = sessions(t).join(c, "account")
    run = F.col("kind_rank") == 5
    by = s.groupBy("account", "n_contacts", "first_contact").agg(
        F.count("*").alias("n_sessions"),
        F.countDistinct("banker").alias("bankers"),
        F.countDistinct("unit").alias("units"),
        F.count_if(run).alias("executing"),
        F.min(F.when(run, F.col("first_at"))).alias("first_execution"),
        F.count_if(run & (F.col("first_at") > F.col("last_contact"))).alias("executed_after"),
    )
    hours = F.timestamp_diff("MICROSECOND", "first_contact", "first_execution") / 3.6e9
    return by.withColumn("hours_to_execution", r6(hours)).drop("first_contact", "first_execution")


@query(f"""
    with {SESSIONS} select unit, count(*) as n_sessions, count(distinct account) as accounts, cast(sum(ops) as bigint) as ops
    from sessions group by 1 order by n_sessions desc, unit limit 3
""")
def busiest_units(t: Tables) -> DataFrame:
    """A24 and top-k: the units with most sessions."""
    by = sessions(t).groupBy("unit").agg(F.count("*").alias("n_sessions"), F.countDistinct("account").alias("accounts"), F.sum("ops").alias("ops"))
    return by.orderBy(F.desc("n_sessions"), "unit").limit(3)


@query(f"""
    with {STORIES}, n as (select story, count(*) as contacts, sum(value) as value from stories group by 1),
    a as (select story from n order by contacts desc, story limit 1),
    b as (select story from n where story not in (select story from a) order by value desc, story limit 1),
    c as (select story from n where story not in (select story from a union select story from b) order by contacts, value, story limit 1)
    select 'most_contacts' as reason, story from a union all select 'most_value', story from b union all select 'shortest', story from c
""")
def example_cases(t: Tables) -> DataFrame:
    """Three stories to show, none chosen twice."""
    n = stories(t).groupBy("story").agg(F.count("*").alias("contacts"), F.sum("value").alias("value"))
    taken = None
    for reason, order in (
        ("most_contacts", [F.desc("contacts"), F.col("story")]),
        ("most_value", [F.desc("value"), F.col("story")]),
        ("shortest", [F.col("contacts"), F.col("value"), F.col("story")]),
    ):
        left = n if taken is None else n.join(taken, "story", "left_anti")
        one = left.orderBy(*order).limit(1).select(F.lit(reason).alias("reason"), "story")
        taken = one if taken is None else taken.unionByName(one)
    return taken


@query(f"""
    with {ACTIVITY}, rebuilt as (select account, cast(moment as date) as day, op from activity),
    exported as (select account, cast(moment as date) as day, op from activity where value >= 5),
    a as (select account, day, op, count(*) as n from rebuilt group by all), b as (select account, day, op, count(*) as n from exported group by all)
    select coalesce(a.account, b.account) as account,
        cast(sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)) as bigint) as only_a,
        cast(sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)) as bigint) as only_b
    from a full join b on a.account = b.account and a.day = b.day and a.op = b.op
    where a.n is distinct from b.n group by 1
""")
def log_differences(t: Tables) -> DataFrame:
    """Set comparison: rows that an export lacks or has too many of, by account."""
    rows = activity(t)
    flat = lambda df: df.select("account", F.to_date("at").alias("day"), "op")
    return matching.compare_multisets(flat(rows), flat(rows.where("value >= 5")), "account")


@query("""
    select c.c_custkey from customer c
    where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')
""")
def silent_accounts(t: Tables) -> DataFrame:
    """Customers without an urgent contact."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
    with sales as (
        select r_name as branch, o_custkey, count(*) - 1 as returns from orders
        join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
        group by 1, 2
    )
    select branch, count(*) as stories, cast(sum(returns) as bigint) as returns, round(avg(returns), 6) as mean_returns,
        round(avg((returns >= 3)::int), 6) as many_share from sales group by 1 having count(*) >= 5
""")
def branch_table(t: Tables) -> DataFrame:
    """Stories and returns by branch, for branches with enough of them."""
    where = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    by = t.orders.groupBy("o_custkey").agg((F.count("*") - 1).alias("returns"))
    rows = by.join(where, F.col("o_custkey") == F.col("c_custkey"))
    return (
        rows.groupBy(F.col("r_name").alias("branch"))
        .agg(
            F.count("*").alias("stories"),
            F.sum("returns").alias("returns"),
            r6(F.avg("returns")).alias("mean_returns"),
            r6(F.avg((F.col("returns") >= 3).cast("int"))).alias("many_share"),
        )
        .where("stories >= 5")
    )


@query(f"""
    with {SESSIONS}, daily as (
        select account, cast(first_at as date) as day, count(*) as n, cast(sum(ops) as bigint) as ops from sessions group by 1, 2
    )
    select day, row_number() over (partition by day order by n desc, account) as place, account, n, ops from daily
    qualify row_number() over (partition by day order by n desc, account) <= 3
""")
def busiest_accounts_by_day(t: Tables) -> DataFrame:
    """Top-k within groups."""
    by = sessions(t).groupBy("account", F.to_date("first_at").alias("day")).agg(F.count("*").alias("n"), F.sum("ops").alias("ops"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "account"))
    return by.withColumn("place", place.cast("long")).where("place <= 3")


@query(f"""
    with {ACTIVITY}
    select account, op, cast(dense_rank() over (partition by account order by min(row_order)) - 1 as bigint) as label_index
    from activity group by account, op
""")
def first_appearances(t: Tables) -> DataFrame:
    """Labels numbered by their first appearance."""
    found = sequences.first_appearance(activity(t), ["account"], "op", "row_order")
    return found.select("account", "op", F.col("label_index").cast("long").alias("label_index"))

"""Pages of the journey report over the activity log: sessions, contacts, accounts and the fifteen numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching, pages
from . import journey
from .registry import Tables, query, r6

#: Units by class: 0 is the center, 1 the account's own branch, the rest other ones and the back office.
_CLASS = "case when unit = 0 then 'center' when unit = account % 5 then 'own' when unit = 4 then 'back' else 'other' end"

PAGES = f"""
    {journey.SESSIONS}, {journey.CONTACTS}, pairs as (
        select s.account, s.session_no, c.contact_id, row_number() over (
            partition by s.account, s.session_no order by abs(epoch_us(s.first_at) - epoch_us(c.contact_at)), c.contact_at, c.contact_id) as n
        from sessions s join contacts c on c.c_account = s.account and s.first_at between c.lo and c.hi
    ), numbered_contacts as (
        select a.account, a.row_order as contact_id, a.moment as contact_at, op = 'signup' as inbound, op = 'error' as abandoned,
            row_number() over (partition by account order by moment, row_order) as n, lead(moment) over (partition by account order by moment, row_order) as next_contact
        from activity a where op in ('signup', 'error')
    ), session_page as (
        select s.account, row_number() over (partition by s.account order by s.first_at, s.session_no) as no, s.session_no, s.first_at, s.last_at, date_diff('microsecond', s.first_at, s.last_at) / 6e7 as minutes,
            banker, unit, {_CLASS.replace("account", "s.account")} as unit_class, kind_rank = 5 as executes, cast(ops as bigint) as ops, k.n as contact_n, p.contact_id,
            (select max(contact_at) from numbered_contacts x where x.account = s.account) as last_contact
        from sessions s left join pairs p on p.account = s.account and p.session_no = s.session_no and p.n = 1 left join numbered_contacts k on k.account = s.account and k.contact_id = p.contact_id
    ), session_lines as (
        select * exclude (last_contact), contact_id is null as background, coalesce(unit_class <> lag(unit_class) over (partition by account order by first_at, session_no), false) as hand_off,
            coalesce(first_at > last_contact, false) as after_last from session_page
    ), behind as (
        select account, contact_id, count(*) as n_sess, sum(minutes) as banker_min, sum(ops)::bigint as n_ops, count(distinct banker) as n_bankers, bool_or(executes) as has_execute,
            bool_or(unit_class in ('own', 'other')) as has_branch, bool_or(unit_class = 'center') as has_center, string_agg(session_no, ',' order by session_no) as session_nos
        from session_lines where contact_id is not null group by 1, 2
    ), contact_page as (
        select c.*, (select min(first_at) from session_lines s where s.account = c.account and s.first_at >= c.contact_at) as then_at from numbered_contacts c
    ), contact_lines as (
        select c.account, n, c.contact_id, contact_at, inbound, abandoned, coalesce(n_sess, 0) as n_sess, coalesce(banker_min, 0) as banker_min, coalesce(n_ops, 0) as n_ops, coalesce(n_bankers, 0) as n_bankers,
            coalesce(has_execute, false) as has_execute, coalesce(has_branch, false) as has_branch, coalesce(has_center, false) as has_center, coalesce(session_nos, '') as session_nos,
            date_diff('microsecond', contact_at, then_at) / 3.6e9 as resp_hours,
            case when abandoned then case when then_at is not null and (next_contact is null or then_at <= next_contact) then 'bank' when next_contact is not null then 'customer' else 'none' end end as first_move
        from contact_page c left join behind b on b.account = c.account and b.contact_id = c.contact_id
    ), account_lines as (
        select c.account, c.contacts, c.contacts - 1 as returns, c.first_at, c.last_at, date_diff('microsecond', c.first_at, c.last_at) / 8.64e10 as span_days, c.abandoned, c.inbound, c.max_same_day,
            coalesce(sessions, 0) as sessions, coalesce(bankers, 0) as bankers, coalesce(units, 0) as units, coalesce(unit_kinds, '') as unit_kinds, coalesce(crossings, 0) as crossings, coalesce(crossed, false) as crossed,
            coalesce(banker_minutes, 0) as banker_minutes, coalesce(background_minutes, 0) as background_minutes, coalesce(background_sessions, 0) as background_sessions, coalesce(background_branch, 0) as background_branch,
            coalesce(no_execute_sessions, 0) as no_execute_sessions, coalesce(execute_after_last, false) as execute_after_last, date_diff('microsecond', c.first_at, first_execute) / 3.6e9 as hours_to_execute
        from (select account, count(*) as contacts, min(contact_at) as first_at, max(contact_at) as last_at, count(*) filter (abandoned) as abandoned, count(*) filter (inbound) as inbound,
                (select max(k) from (select count(*) as k from numbered_contacts d where d.account = x.account group by cast(contact_at as date))) as max_same_day from numbered_contacts x group by account) c
        left join (select account, count(*) as sessions, count(distinct banker) as bankers, count(distinct unit) as units, string_agg(distinct unit_class, ',' order by unit_class) as unit_kinds,
                count(*) filter (hand_off) as crossings, bool_or(unit_class = 'center') and bool_or(unit_class in ('own', 'other')) as crossed, sum(minutes) as banker_minutes,
                coalesce(sum(minutes) filter (background), 0) as background_minutes, count(*) filter (background) as background_sessions, count(*) filter (background and unit_class in ('own', 'other')) as background_branch,
                count(*) filter (not executes) as no_execute_sessions, bool_or(executes and after_last) as execute_after_last, min(first_at) filter (executes) as first_execute from session_lines group by 1) s using (account)
    )
"""


def _sessions(t: Tables) -> DataFrame:
    found = matching.attach_nearest(journey.sessions(t), journey.contacts(t), ["account"], "session_no", "first_at", "lo", "hi", "contact_at", "contact_id")
    unit = F.col("unit")
    cls = F.when(unit == 0, "center").when(unit == F.col("account") % 5, "own").when(unit == 4, "back").otherwise("other")
    return found.withColumns({"unit_class": cls, "executes": F.col("kind_rank") == 5}).drop("contact_at")


def _contacts(t: Tables) -> DataFrame:
    log = journey.activity(t).where(F.col("op").isin("signup", "error"))
    return log.select("account", F.col("row_order").alias("contact_id"), F.col("at").alias("contact_at"), (F.col("op") == "signup").alias("inbound"), (F.col("op") == "error").alias("abandoned"))


def session_page(t: Tables) -> DataFrame:
    return pages.session_rows(_sessions(t), _contacts(t))


def contact_page(t: Tables) -> DataFrame:
    return pages.contact_rows(_contacts(t), session_page(t))


@query(f"with {PAGES} select * replace (round(minutes, 6) as minutes) from session_lines")
def session_lines(t: Tables) -> DataFrame:
    """A row for each session as a page shows it."""
    return session_page(t).withColumn("minutes", r6("minutes"))


@query(f"with {PAGES} select * replace (round(banker_min, 6) as banker_min, round(resp_hours, 6) as resp_hours) from contact_lines")
def contact_lines(t: Tables) -> DataFrame:
    """A row for each contact with the sessions behind it and what came next."""
    rows = contact_page(t).withColumns({"banker_min": r6("banker_min"), "resp_hours": r6("resp_hours")})
    return rows.withColumn("session_nos", F.array_join(F.transform("session_nos", lambda s: s.cast("string")), ","))


@query(f"""
    with {PAGES} select * replace (round(span_days, 6) as span_days, round(banker_minutes, 6) as banker_minutes, round(background_minutes, 6) as background_minutes, round(hours_to_execute, 6) as hours_to_execute)
    from account_lines
""")
def account_lines(t: Tables) -> DataFrame:
    """A row for each account: its contacts, its sessions and what lies between."""
    s = session_page(t)
    rows = pages.account_rows(s, pages.contact_rows(_contacts(t), s))
    rounded = {c: r6(c) for c in ("span_days", "banker_minutes", "background_minutes", "hours_to_execute")}
    return rows.withColumns(rounded | {"unit_kinds": F.array_join("unit_kinds", ",")})


_SHARE = "case when {1} >= 10 then {0} / {1} end"


@query(f"""
    with {PAGES}, act as (select * from account_lines where sessions > 0), a as (
        select count(*)::double as n, avg(bankers) as bankers, median(bankers) as mid_bankers, count(*) filter (bankers >= 3) as three, count(*) filter (crossed) as crossed, avg(crossings) as crossings, avg(banker_minutes) as minutes,
            median(banker_minutes) as mid_minutes, sum(banker_minutes) as all_minutes, sum(background_minutes) as background, sum(background_sessions) as n_bg, sum(background_branch) as bg_branch, sum(sessions) as n_sess,
            sum(no_execute_sessions) as nodo, count(*) filter (execute_after_last) as after, count(hours_to_execute) as n_hours, median(hours_to_execute) as mid_execute,
            count(*) filter (execute_after_last and returns > 0) as returned_after, count(*) filter (returns > 0) as n_returned, (select count(*) from account_lines) as n_all from act
    ), c as (
        select count(*) filter (inbound) as talk, count(*) filter (inbound and n_sess > 0) as talk_sess, count(*) filter (inbound and has_execute) as talk_do, count(*) filter (inbound and has_branch) as talk_branch,
            count(*) filter (first_move = 'bank') as ab_bank, count(*) filter (first_move = 'customer') as ab_customer, count(*) filter (first_move = 'none') as ab_none, count(*) as n_contacts, count(*) filter (n_sess > 1) as several,
            median(resp_hours) filter (first_move = 'bank') as mid_bank from contact_lines
    ), rows as (
        select unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]) as item,
            unnest(['covered', 'bankers', 'three_bankers', 'cross', 'minutes', 'background_minutes', 'background_branch', 'no_execute', 'talk', 'after_abandon', 'bank_hours', 'execute_after_last', 'returned_execute', 'hours_to_execute', 'several_sessions']) as key,
            unnest([n_all::double, bankers, {_SHARE.format("three", "n")}, {_SHARE.format("crossed", "n")}, minutes, case when all_minutes > 0 and n >= 10 then background / all_minutes end, {_SHARE.format("bg_branch", "n_bg")},
                {_SHARE.format("nodo", "n_sess")}, talk_sess, ab_bank, mid_bank, {_SHARE.format("after", "n")}, returned_after, mid_execute, several]::double[]) as first,
            unnest([n, mid_bankers, null, crossings, mid_minutes, null, null, null, talk_do, ab_customer, null, null, n_returned, null, null]::double[]) as second,
            unnest([null, null, null, null, null, null, null, null, talk_branch, ab_none, null, null, null, null, null]::double[]) as third,
            unnest([n_all, n, n, n, n, n, n_bg, n_sess, talk, ab_bank + ab_customer + ab_none, ab_bank, n, n_returned, n_hours, n_contacts]::bigint[]) as n from a, c
    ) select item, key, round(first, 6) as first, round(second, 6) as second, round(third, 6) as third, n, n >= 10 as shown, n > 0 and n < 30 as preliminary from rows
""")
def page_of_numbers(t: Tables) -> DataFrame:
    """Fifteen numbers of the whole log, each on its own base, with whether it is shown and firm."""
    s = session_page(t)
    c = pages.contact_rows(_contacts(t), s)
    found = pages.fifteen_numbers(pages.account_rows(s, c), c)
    return found.withColumns({x: r6(x) for x in ("first", "second", "third")})

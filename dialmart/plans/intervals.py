"""Intervals of shares, correlations, trends and changes, and sessions whose contact is known by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import matching
from . import journey
from .quality import CARDS, _t_sql, cards
from .registry import Tables, query, r6

_Z = stats.z_crit(0.95)


def _wilson_sql(z: float) -> tuple[str, str]:
    centre = f"(p + {z!r} * {z!r} / (2 * n)) / (1 + {z!r} * {z!r} / n)"
    half = f"{z!r} * sqrt(p * (1 - p) / n + {z!r} * {z!r} / (4 * n * n)) / (1 + {z!r} * {z!r} / n)"
    return f"greatest(0, {centre} - {half})", f"least(1, {centre} + {half})"


_LOW, _HIGH = _wilson_sql(_Z)
_ZLOW, _ZHIGH = _wilson_sql(2.576)


@query(f"""
    with {CARDS}, c as (select call_id // 10 as contact, count(*) as n, count(*) filter (gates_failed > 0) as k from scored group by 1), s as (select *, k / n as p from c)
    select contact, n, k, case when k = 0 then 0 else round({_LOW}, 6) end as low, case when k = n then 1 else round({_HIGH}, 6) end as high, round({_ZLOW}, 6) as z_low, round({_ZHIGH}, 6) as z_high from s
""")
def failure_intervals(t: Tables) -> DataFrame:
    """Wilson's intervals of failed shares, with exact ends at none and at all, and by a given z without them."""
    c = cards(t).groupBy(F.floor(F.col("call_id") / 10).alias("contact")).agg(F.count("*").alias("n"), F.count_if(F.size("failed") > 0).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    z_low, z_high = stats.wilson_z(F.col("k") / F.col("n"), F.col("n"))
    return c.select("contact", "n", "k", r6(low).alias("low"), r6(high).alias("high"), r6(z_low).alias("z_low"), r6(z_high).alias("z_high"))


@query(f"""
    with {CARDS}, ranked as (
        select agent, rank() over (partition by agent order by seconds) + (count(*) over (partition by agent, seconds) - 1) / 2 as rx,
            rank() over (partition by agent order by total) + (count(*) over (partition by agent, total) - 1) / 2 as ry from scored
    ), c as (select agent, count(*) as n, corr(rx, ry) as rho from ranked group by 1), e as (select *, {_Z!r} * sqrt((1 + rho * rho / 2) / (n - 3)) as half from c)
    select agent, n, round(rho, 6) as rho, round(tanh(atanh(rho) - half), 6) as low, round(tanh(atanh(rho) + half), 6) as high from e
""")
def driver_intervals(t: Tables) -> DataFrame:
    """Rank correlations of length and total by agent, with their intervals."""
    found = stats.spearman(cards(t), ["agent"], "seconds", "total")
    return found.select("agent", "n", r6("rho").alias("rho"), r6("low").alias("low"), r6("high").alias("high"))


@query(f"""
    with {CARDS}, d as (select agent, total, date_diff('day', date '1992-01-01', cast(call_date as date)) as day from scored),
    s as (select agent, count(*) as n, regr_slope(total, day) as slope, regr_sxx(total, day) as sxx, regr_syy(total, day) as syy, regr_sxy(total, day) as sxy from d group by 1),
    h as (select *, {_t_sql("(n - 2)", 0.95)} * sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) as half from s)
    select agent, n, round(slope * 30, 6) as slope, round((slope - half) * 30, 6) as low, round((slope + half) * 30, 6) as high from h
""")
def trend_intervals(t: Tables) -> DataFrame:
    """Each agent's trend in points per 30 days, with its interval."""
    rows = cards(t).withColumn("day", F.datediff(F.to_date("call_date"), F.lit("1992-01-01").cast("date")).cast("double"))
    return stats.linear_trend(rows, ["agent"], "day", "total").select("agent", "n", *[r6(c).alias(c) for c in ("slope", "low", "high")])


_DF = "(pow(var / n + var0 / n0, 2) / (pow(var / n, 2) / (n - 1) + pow(var0 / n0, 2) / (n0 - 1)))"


@query(f"""
    with {CARDS}, y as (select cast(date_trunc('year', call_date) as date) as period, count(*) as n, avg(total) as mean, var_samp(total) as var from scored group by 1),
    b as (select *, lag(n) over (order by period) as n0, lag(mean) over (order by period) as mean0, lag(var) over (order by period) as var0, lead(period) over (order by period) is null as last from y),
    h as (select *, {_t_sql(_DF, 0.95)} * sqrt(var / n + var0 / n0) as half, n >= 8 and n0 >= 8 as enough from b)
    select period, n, round(mean, 6) as mean, case when enough then round(mean - mean0, 6) end as change, case when enough then round(mean - mean0 - half, 4) end as low,
        case when enough then round(mean - mean0 + half, 4) end as high, last from h
""")
def yearly_changes(t: Tables) -> DataFrame:
    """Totals by year, with the change from the year before and its interval, the last one marked."""
    rows = cards(t).withColumn("period", F.to_date(F.date_trunc("year", F.col("call_date").cast("timestamp"))))
    found = stats.period_changes(rows, "period", "total")
    return found.select("period", "n", r6("mean").alias("mean"), r6("change").alias("change"), *[F.round(c, 4).alias(c) for c in ("low", "high")], "last")


@query(f"""
    with {journey.SESSIONS}, {journey.CONTACTS}, told as (
        select s.*, case when session_no % 4 = 0 then (select min(contact_id) from contacts c where c.c_account = s.account) when session_no % 4 = 1 then -1 end as told_id from sessions s
    ), pairs as (
        select s.account, s.session_no, c.contact_id, row_number() over (partition by s.account, s.session_no order by abs(epoch_us(s.first_at) - epoch_us(c.contact_at)), c.contact_at, c.contact_id) as n
        from sessions s join contacts c on c.c_account = s.account and s.first_at between c.lo and c.hi
    ) select t.account, t.session_no, coalesce(k.contact_id, p.contact_id) as contact_id, k.contact_id is not null as by_id
    from told t left join contacts k on k.c_account = t.account and k.contact_id = t.told_id left join pairs p on p.account = t.account and p.session_no = t.session_no and p.n = 1
""")
def known_contacts(t: Tables) -> DataFrame:
    """Sessions with the contact that their log names, if it exists, else with the nearest whose window holds them."""
    points = journey.contacts(t)
    first = points.groupBy("account").agg(F.min("contact_id").alias("_first"))
    told = F.when(F.col("session_no") % 4 == 0, F.col("_first")).when(F.col("session_no") % 4 == 1, F.lit(-1))
    rows = journey.sessions(t).join(first, "account", "left").withColumn("told_id", told.cast("long")).drop("_first")
    found = matching.attach_known_or_nearest(rows, points, ["account"], "session_no", "told_id", "first_at", "lo", "hi", "contact_at", "contact_id")
    return found.select("account", "session_no", "contact_id", "by_id")

"""Distributions, cross-tables, groups, unmatched rows, scopes and the exports, over the journey's and the score cards' rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import matching, pages, ranges
from ..sources import artifacts, scratch
from . import journey, quality
from .pages import PAGES, _contacts, contact_page, session_page
from .quality import CARDS, LONG, RATINGS, cards, long_cards
from .registry import Tables, query, r6


def _all_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


@query(f"""
    with {LONG}, means as (select agent, dim, avg(score) as mean, count(*) as n from long group by 1, 2)
    select dim, count(*) as agents, round(median(mean), 6) as median_mean, round(avg(mean), 6) as mean_of_means, round(max(mean) - min(mean), 6) as spread from means group by 1
""")
def group_dimensions(t: Tables) -> DataFrame:
    """A2: the median and the mean of the agents' means by dimension."""
    means = long_cards(t).groupBy("agent", "dim").agg(F.avg("score").alias("mean"))
    by = means.groupBy("dim").agg(F.count("*").alias("agents"), r6(F.avg("mean")).alias("mean_of_means"), r6(F.max("mean") - F.min("mean")).alias("spread"))
    middle = ranges.exact_quantiles(means, ["dim"], "mean", {"median_mean": 0.5})
    return by.join(middle, "dim").withColumn("median_mean", r6("median_mean"))


@query(f"""
    with {LONG}, told as (select l.*, s.seconds from long l join scored s using (call_id)), shown as (select * from told where seconds >= 20)
    select agent, dim, arg_max(call_id, score * 1e12 + call_id) as best, arg_min(call_id, score * 1e12 + call_id) as worst, count(*) as with_evidence from shown group by 1, 2
""")
def evidenced_calls(t: Tables) -> DataFrame:
    """A3: the same among calls that have evidence to show (20 seconds of it)."""
    seconds = cards(t).select("call_id", "seconds").where("seconds >= 20")
    key = F.struct("score", "call_id")
    rows = long_cards(t).join(seconds, "call_id")
    return rows.groupBy("agent", "dim").agg(F.max_by("call_id", key).alias("best"), F.min_by("call_id", key).alias("worst"), F.count("*").alias("with_evidence"))


_LAYOUT = "case when seconds < 15 then 'mono' when seconds < 45 then 'stereo' end"


@query(f"""
    with {CARDS}, l as (select {_LAYOUT} as layout, total from scored), k as (select * from l where layout is not null), g as (select layout, count(*) as n, avg(total) as mean from k group by 1)
    select g.layout, g.n, round(g.mean, 6) as mean, count(*) as rest_n, round(avg(k.total), 6) as rest_mean, round(g.mean - avg(k.total), 6) as diff from g join k on k.layout <> g.layout group by 1, 2, g.mean
""")
def layouts_against_rest(t: Tables) -> DataFrame:
    """Calls by their layout; those of no known layout are in no rest."""
    layout = F.when(F.col("seconds") < 15, "mono").when(F.col("seconds") < 45, "stereo")
    found = stats.group_against_rest(cards(t).withColumn("layout", layout).where("layout is not null"), "layout", "total")
    return found.select("layout", "n", r6("mean").alias("mean"), "rest_n", r6("rest_mean").alias("rest_mean"), r6("diff").alias("diff"))


@query(f"""
    with {PAGES}, kinds as (select account, case when inbound then 'inbound' else 'abandoned' end as kind from contact_lines), rows as (
        select 'returns' as what, case when returns >= 4 then '4+' else returns::varchar end as bucket from account_lines union all select 'kinds', kind from kinds
        union all select 'same_day', case when max_same_day >= 5 then '5+' else max_same_day::varchar end from account_lines union all select 'bankers', case when bankers >= 5 then '5+' else bankers::varchar end from account_lines
        union all select 'first_move', first_move from contact_lines where first_move is not null
    ) select what, bucket, count(*) as n from rows group by 1, 2
""")
def story_distributions(t: Tables) -> DataFrame:
    """Accounts by returns, most contacts on a day and agents, contacts by kind and by who moved first."""
    c = contact_page(t)
    a = pages.account_rows(session_page(t), c)
    capped = lambda col, most: F.when(F.col(col) >= most, f"{most}+").otherwise(F.col(col).cast("string"))
    rows = [
        a.select(F.lit("returns").alias("what"), capped("returns", 4).alias("bucket")),
        a.select(F.lit("same_day").alias("what"), capped("max_same_day", 5).alias("bucket")),
        a.select(F.lit("bankers").alias("what"), capped("bankers", 5).alias("bucket")),
        c.select(F.lit("kinds").alias("what"), F.when(F.col("inbound"), "inbound").otherwise("abandoned").alias("bucket")),
        c.where("first_move is not null").select(F.lit("first_move").alias("what"), F.col("first_move").alias("bucket")),
    ]
    return _all_of(rows).groupBy("what", "bucket").agg(F.count("*").alias("n"))


@query(f"""
    with {journey.STORIES}, votes as (select story, category, count(*) as n, min(contact_index) as first_seen from stories group by 1, 2),
    topics as (select story, category as topic from (select *, row_number() over (partition by story order by n desc, first_seen) as place from votes) where place = 1),
    judged as (select topic, case when channel <> 'P' then category end as strict, coalesce(case when channel <> 'P' then category end, case when contact_index % 2 = 1 then '3-MEDIUM' end) as extended,
        case when channel = 'P' then 'model' else 'rule' end as judged_by from stories join topics using (story) where contact_index > 0)
    select topic, judged_by, count(*) as returns, count(strict) as strict, count(extended) as extended, count(*) filter (extended = '1-URGENT') as urgent, count(*) filter (extended = '3-MEDIUM') as medium from judged group by 1, 2
""")
def topic_by_category(t: Tables) -> DataFrame:
    """Returns by topic and who judged them, with categories told strictly and with inferred ones."""
    rows = journey.stories(t)
    topic = matching.majority(rows, "story", "category", "contact_index").select("story", F.col("category").alias("topic"))
    strict = F.when(F.col("channel") != "P", F.col("category"))
    back = rows.where("contact_index > 0").join(topic, "story").withColumn("strict", strict)
    back = back.withColumn("extended", F.coalesce("strict", F.when(F.col("contact_index") % 2 == 1, "3-MEDIUM")))
    by = back.groupBy("topic", F.when(F.col("channel") == "P", "model").otherwise("rule").alias("judged_by"))
    return by.agg(
        F.count("*").alias("returns"), F.count("strict").alias("strict"), F.count("extended").alias("extended"),
        F.count_if(F.col("extended") == "1-URGENT").alias("urgent"), F.count_if(F.col("extended") == "3-MEDIUM").alias("medium"),
    )


@query(f"""
    with {PAGES} select case when inbound then 'inbound' else 'abandoned' end as kind, count(*) as contacts, count(*) filter (n_sess > 0) as with_sessions, round(avg(n_bankers) filter (n_sess > 0), 6) as bankers,
        round(sum(banker_min), 4) as minutes, count(*) filter (has_execute) as executed from contact_lines group by 1
""")
def contact_groups(t: Tables) -> DataFrame:
    """Contacts by kind; agents are averaged only where there were sessions."""
    some = F.col("n_sess") > 0
    return contact_page(t).groupBy(F.when(F.col("inbound"), "inbound").otherwise("abandoned").alias("kind")).agg(
        F.count("*").alias("contacts"), F.count_if(some).alias("with_sessions"), r6(F.avg(F.when(some, F.col("n_bankers")))).alias("bankers"),
        F.round(F.sum("banker_min"), 4).alias("minutes"), F.count_if("has_execute").alias("executed"),
    )


@query(f"""
    with {PAGES} select case when bankers >= 5 then '5+' else bankers::varchar end as bankers, count(*) as accounts, sum(returns)::bigint as returns, count(*) filter (abandoned > 0) as left_waiting,
        case when count(*) >= 10 then round(count(*) filter (abandoned > 0) / count(*), 6) end as share from account_lines group by 1
""")
def waiting_by_bankers(t: Tables) -> DataFrame:
    """Accounts by number of agents, and how many of them were left waiting; a share from ten accounts on."""
    a = pages.account_rows(session_page(t), contact_page(t))
    capped = F.when(F.col("bankers") >= 5, "5+").otherwise(F.col("bankers").cast("string"))
    by = a.groupBy(capped.alias("bankers")).agg(F.count("*").alias("accounts"), F.sum("returns").alias("returns"), F.count_if(F.col("abandoned") > 0).alias("left_waiting"))
    return by.withColumn("share", r6(F.when(F.col("accounts") >= 10, F.col("left_waiting") / F.col("accounts"))))


@query(f"""
    with {PAGES}, rows as (
        select 'sessions without a contact' as what, account * 100000 + session_no as id from session_lines where contact_id is null union all select 'contacts without a session', contact_id from contact_lines where n_sess = 0
        union all select 'documents without a label', doc_id from documents where doc_id not in (select doc_id from labels) union all select 'customers without an order', c_custkey from customer where c_custkey not in (select o_custkey from orders)
    ) select what, count(*) as n, min(id) as first_id, max(id) as last_id from rows group by 1
""")
def unmatched_rows(t: Tables) -> DataFrame:
    """Rows of either side that no row of the other belongs to."""
    kinds = [
        ("sessions without a contact", session_page(t).where("contact_id is null"), F.col("account") * 100000 + F.col("session_no")),
        ("contacts without a session", contact_page(t).where("n_sess = 0"), F.col("contact_id")),
        ("documents without a label", t.documents.join(t.labels, "doc_id", "left_anti"), F.col("doc_id")),
        ("customers without an order", t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), F.col("c_custkey")),
    ]
    rows = _all_of([df.select(F.lit(what).alias("what"), i.cast("long").alias("id")) for what, df, i in kinds])
    return rows.groupBy("what").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"""
    with {journey.ACTIVITY} select a.row_order, (select min(b.moment) from activity b where b.account = a.account and b.op in ('signup', 'error') and b.moment > a.moment) as next_contact,
        (select min(b.moment) from activity b where b.account = a.account and b.op = 'signup' and b.moment > a.moment) as next_inbound from activity a where a.op in ('signup', 'error')
""")
def next_contacts(t: Tables) -> DataFrame:
    """The next contact strictly after each, and the next that the customer made."""
    log = journey.activity(t)
    rows = log.where(F.col("op").isin("signup", "error")).select("account", "at", "row_order", "op")
    found = matching.next_after(rows.drop("op"), rows.select("account", F.col("at").alias("next_at")), ["account"], "at", "next_at", False, "next_contact")
    found = matching.next_after(found, rows.where("op = 'signup'").select("account", F.col("at").alias("next_at")), ["account"], "at", "next_at", False, "next_inbound")
    return found.select("row_order", "next_contact", "next_inbound")


@query(f"""
    with {CARDS}, dated as (select *, case when seconds = 13 then null else cast(call_date as date) end as day from scored)
    select agent, count(*) as calls, count(*) filter (day is null) as undated, count(*) filter (day >= date '1996-01-01' and day < date '1997-01-01' and lower(trim(call_type)) = 'r' and agent % 2 = 0) as in_scope from dated group by 1
""")
def scoped_calls(t: Tables) -> DataFrame:
    """What a scope of dates, type (whatever its case) and agents leaves; a call without a date is in no range of dates."""
    day = F.when(F.col("seconds") != 13, F.to_date("call_date"))
    rows = cards(t).withColumn("day", day)
    scope = (F.col("day") >= F.lit("1996-01-01").cast("date")) & (F.col("day") < F.lit("1997-01-01").cast("date")) & (F.lower(F.trim("call_type")) == "r") & (F.col("agent") % 2 == 0)
    return rows.groupBy("agent").agg(F.count("*").alias("calls"), F.count_if(F.col("day").isNull()).alias("undated"), F.count_if(scope).alias("in_scope"))


_TIMES = quality._TIMES
_DRAW = quality._DRAW


@query(f"""
    with {RATINGS}, by_source as (select d.source, count(*) as n, count(*) filter (r.human = r.given) as k from ratings r join documents d using (doc_id) group by 1),
    draws as (select *, cast('0x' || md5(source)[1:7] as bigint) as key from by_source, unnest(range(1, 401)) as r(rep)),
    one as (select *, {_DRAW.format("key")} as x from draws), two as (select *, (x * x + 16807 * rep) % {stats.DRAWS} as y from one),
    three as (select *, ((y * 48271 + key) % {stats.DRAWS}) / {stats.DRAWS}::double as u from two),
    sums as (select rep, sum(k * ({_TIMES}))::double / nullif(sum(n * ({_TIMES})), 0) as share from three group by 1)
    select round((select sum(k) / sum(n) from by_source), 6) as accuracy, (select count(*) from by_source) as clusters, round(quantile_cont(share, 0.025), 6) as low, round(quantile_cont(share, 0.975), 6) as high from sums
""")
def clustered_accuracy(t: Tables) -> DataFrame:
    """The accuracy of labels with an interval by sources, whose rows are no separate draws."""
    rows = quality.ratings(t).join(t.documents.select("doc_id", "source"), "doc_id")
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("human") == F.col("given")).alias("k"))
    found = stats.cluster_share(by, "source", "k", "n", 400)
    return found.select(r6("share").alias("accuracy"), "clusters", r6("low").alias("low"), r6("high").alias("high"))


#: The exports under their own names, with their columns.
EXPORTS = {
    "calls": ["call_id", "agent", "call_type", "total"],
    "stories": ["account", "contacts", "returns", "sessions", "bankers", "crossed"],
    "returns": ["account", "n", "contact_id", "first_move"],
    "contacts": ["account", "n", "contact_id", "n_sess", "n_ops", "has_execute"],
    "sessions": ["account", "no", "ops", "unit_class", "after_last"],
    "codes": ["op", "rows", "accounts"],
}


@query(f"""
    with {PAGES}, {CARDS}, codes as (select op, count(*) as rows, count(distinct account) as accounts from activity group by 1)
    select 'calls' as export, count(*) as rows, '{",".join(EXPORTS["calls"])}' as columns, count(distinct call_id) as ids from scored
    union all select 'stories', count(*), '{",".join(EXPORTS["stories"])}', count(distinct account) from account_lines
    union all select 'returns', count(*), '{",".join(EXPORTS["returns"])}', count(distinct account) from contact_lines where n > 1
    union all select 'contacts', count(*), '{",".join(EXPORTS["contacts"])}', count(distinct account) from contact_lines
    union all select 'sessions', count(*), '{",".join(EXPORTS["sessions"])}', count(distinct account) from session_lines
    union all select 'codes', count(*), '{",".join(EXPORTS["codes"])}', count(distinct op) from codes
""")
def exported_tables(t: Tables) -> DataFrame:
    """K2: the six exports, written as CSV under their names and read back."""
    root = scratch.new_folder(t.spark, "exports")
    s = scratch.written(session_page(t), "sessions")
    c = scratch.written(pages.contact_rows(_contacts(t), s), "contacts")
    tables = {
        "calls": cards(t), "stories": pages.account_rows(s, c), "returns": c.where("n > 1"), "contacts": c, "sessions": s,
        "codes": journey.activity(t).groupBy("op").agg(F.count("*").alias("rows"), F.count_distinct("account").alias("accounts")),
    }
    out = []
    for name, columns in EXPORTS.items():
        artifacts.write_csv(tables[name].select(*columns), f"{root}/{name}")
        read = t.spark.read.option("header", True).csv(f"{root}/{name}")
        out.append(read.agg(F.lit(name).alias("export"), F.count("*").alias("rows"), F.lit(",".join(read.columns)).alias("columns"), F.count_distinct(columns[0]).alias("ids")))
    return _all_of(out)

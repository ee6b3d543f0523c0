"""What comes in and goes out: the tables are written as the files that the readers know, and read back through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..sources import artifacts, delimited, publication, scratch
from . import dialog, journey, quality
from .registry import Tables, query, r6


def _hebrew_csv(df: DataFrame, folder: str, delimiter: str = ",") -> None:
    """A file with a header for each task, in the encoding of Hebrew Windows."""
    rows = df.select(*[delimited.as_hebrew_bytes(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    rows.write.option("header", True).option("sep", delimiter).option("encoding", "ISO-8859-1").option("lineSep", "\r\n").csv(folder)


@query("""
    with rows as (
        select 'C' || l_orderkey as call_id, 'Call' || l_orderkey || '-' || l_linenumber || '.wav' as file_name, case l_linestatus when 'F' then 'L' else 'R' end as channel,
            'בנקאי ' || l_suppkey as banker_name, l_linenumber + 998 as segment from lineitem where l_orderkey is not null
    ), same as (select call_id, count(*) as n, count(distinct segment) as k from rows group by 1)
    select r.call_id, r.file_name, r.channel as banker_channel, r.banker_name, cast(r.segment as int) as segment from rows r join same using (call_id) where not (n > 1 and k < n)
""")
def imported_calls(t: Tables) -> DataFrame:
    """calls' metadata written with semicolons in Hebrew Windows' encoding and read with their segments told apart."""
    folder = scratch.new_folder(t.spark, "calls")
    key = F.col("l_orderkey").cast("string")
    rows = t.lineitem.select(
        F.concat(F.lit("C"), key).alias("call_id"),
        F.lit("B1").alias("banker_id"),
        F.concat(F.lit("Call"), key, F.lit("-"), F.col("l_linenumber").cast("string"), F.lit(".wav")).alias("file_name"),
        F.when(F.col("l_linestatus") == "F", "L").otherwise("R").alias("banker_channel"),
        F.concat(F.lit("בנקאי "), F.col("l_suppkey").cast("string")).alias("banker_name"),
        (F.col("l_linenumber") + 998).alias("segment"),
    )
    _hebrew_csv(rows, folder, ";")
    good, _ = delimited.call_metadata(t.spark, folder)
    return good.select("call_id", "file_name", "banker_channel", "banker_name", "segment")


@query(f"""
    with {quality.CARDS} select dim, score, count(*) as n from (
        select unnest(['opening', 'closing']) as dim, unnest([case when opening > 4 then 7 else opening end, closing]) as score from scored) where score <= 5 group by 1, 2
""")
def imported_ratings(t: Tables) -> DataFrame:
    """Ratings in tab-separated files; only whole scores from 1 to 5 count."""
    folder = scratch.new_folder(t.spark, "ratings")
    rows = quality.cards(t).select(
        F.col("call_id"), F.col("agent").alias("rater_id"), F.when(F.col("opening") > 4, 7).otherwise(F.col("opening")).alias("opening"), "closing"
    )
    rows.write.option("header", True).option("sep", "\t").csv(folder)
    return delimited.human_ratings(t.spark, folder, ["opening", "closing"]).groupBy("dim", "score").agg(F.count("*").alias("n"))


@query("""
    select o_orderkey as interaction_id, cast(o_custkey % 50 as varchar) as branch, cast(o_custkey as varchar) as account, o_orderdate as at from orders where o_orderpriority <> '5-LOW'
""")
def imported_contacts(t: Tables) -> DataFrame:
    """Interactions of a contract folder; those whose start can't be read are issues."""
    folder = scratch.new_folder(t.spark, "contract")
    key = F.col("o_custkey").cast("string")
    mark = F.when(F.col("o_orderkey") % 3 == 0, "/").when(F.col("o_orderkey") % 3 == 1, "-").otherwise(" ")
    at = F.col("o_orderdate")
    shown = F.when(F.col("o_orderpriority") == "5-LOW", "some day").when(F.col("o_orderkey") % 2 == 0, F.date_format(at, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    rows = t.orders.select(
        F.col("o_orderkey").alias("interaction_id"),
        F.concat((F.col("o_custkey") % 50).cast("string"), mark, key).alias("account_ref"),
        shown.alias("started_at"),
        F.lit("call").alias("channel"),
        F.lit("?").alias("surplus_column"),
    )
    rows.write.option("header", True).csv(f"{folder}/interactions.csv")
    t.nation.select(F.lit("k").alias("call_key"), F.col("n_name").alias("file_name")).write.option("header", True).csv(f"{folder}/call_segments.csv")
    t.nation.select(*[F.col("n_name").alias(c) for c in ("correspondence_id", "message_id", "sent_at", "direction")]).write.option("header", True).csv(f"{folder}/messages.csv")
    got = delimited.journey_contract(t.spark, folder)["interactions"]
    return got.select(F.col("interaction_id").cast("long").alias("interaction_id"), "branch", "account", "at")


@query(f"""
    with {journey.ACTIVITY} select account, cast(unit as varchar) as unit, date_trunc('second', moment) as at, count(*) as n from activity group by 1, 2, 3
""")
def imported_log(t: Tables) -> DataFrame:
    """The activity log's rows under the names of an export, with padded codes and times of their own shape."""
    folder = scratch.new_folder(t.spark, "log")
    rows = journey.activity(t).select(
        F.col("account").alias("ACC_KEY"),
        F.upper(F.date_format("at", "ddMMMyyyy:HH:mm:ss")).alias("TS_DT"),
        F.lpad(F.col("unit").cast("string"), 4, "0").alias("UNIT_NO"),
        F.col("banker").alias("BANKER_CODE"),
        F.col("op").alias("OP_KEY"),
        F.concat(F.lit('said "'), "op", F.lit('", then more')).alias("OP_DESC"),
    )
    rows.write.option("header", True).option("escape", '"').csv(folder)
    got = delimited.activity_log(t.spark, folder)
    return got.groupBy(F.col("account").cast("long").alias("account"), "unit", "at").agg(F.count("*").alias("n"))


@query(f"""
    with {dialog.SEGMENTS} select role as speaker, count(*) as turns, round(sum(end_s - start_s), 4) as seconds from segments group by 1
""")
def imported_turns(t: Tables) -> DataFrame:
    """speakers' turns as RTTM lines."""
    folder = scratch.new_folder(t.spark, "rttm")
    line = F.format_string("SPEAKER call-%d 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "conv_id", "start_s", F.col("end_s") - F.col("start_s"), "role")
    dialog.segments(t).select(line.alias("value")).write.text(folder)
    got = artifacts.reference_turns(t.spark, folder)
    return got.groupBy("speaker").agg(F.count("*").alias("turns"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


@query("""
    with n as (select o_custkey as story_no, o_orderpriority as category, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as contact_no from orders)
    select category, count(*) as labels, cast(sum(contact_no) as bigint) as contacts from n group by 1
""")
def imported_labels(t: Tables) -> DataFrame:
    """Labels by the number of a story and of its contact."""
    folder = scratch.new_folder(t.spark, "labels")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = t.orders.select(F.col("o_custkey").alias("story_no"), place.alias("contact_no"), F.col("o_orderpriority").alias("category"))
    rows.write.option("header", True).csv(folder)
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    got = delimited.content_labels(t.spark, folder, known)
    return got.groupBy("category").agg(F.count("*").alias("labels"), F.sum("contact_no").alias("contacts"))


@query("""
    with r as (select l_orderkey as call_id, l_suppkey as rater_id, cast(1 + cast(l_quantity as bigint) % 7 as int) as opening, cast(1 + l_partkey % 5 as int) as closing from lineitem),
    g as (select distinct call_id, rater_id from r where opening <= 5)
    select rater_id, count(*) as reviews from g group by 1
""")
def recorded_reviews(t: Tables) -> DataFrame:
    """K9: reviewers' verdicts, checked and appended once, however often they are sent."""
    folder = scratch.new_folder(t.spark, "reviews")
    text = lambda c: c.cast("int").cast("string")
    sent = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("call_id"),
        F.col("l_suppkey").cast("string").alias("rater_id"),
        text(1 + F.col("l_quantity").cast("long") % 7).alias("opening"),
        text(1 + F.col("l_partkey") % 5).alias("closing"),
    ).where("opening <= '5'")
    good, _ = artifacts.checked_reviews(sent, ["opening", "closing"])
    for _ in range(2):
        artifacts.append_reviews(t.spark, good, folder)
    return artifacts.reviews(t.spark, folder).groupBy(F.col("rater_id").cast("long").alias("rater_id")).agg(F.count("*").alias("reviews"))


@query("""
    select month(o_orderdate) as batch, count(*) as calls, round(sum(o_totalprice), 2) as total from orders group by 1
""")
def recorded_history(t: Tables) -> DataFrame:
    """K4: figures appended to JSON lines by batch, the last batch twice, as after a failure."""
    folder = scratch.new_folder(t.spark, "history")
    figures = t.orders.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    for batch, part in (("a", "month <= 6"), ("b", "month > 6"), ("b", "month > 6")):
        artifacts.append_history(figures.where(part), folder, batch)
    got = t.spark.read.schema("month int, calls long, total double").json(folder)
    return got.select(F.col("month").cast("long").alias("batch"), "calls", F.round("total", 2).alias("total"))


@query(f"""
    with {quality.CARDS} select agent, count(*) as calls, round(avg(total), 4) as mean from scored group by 1
""")
def exported_numbers(t: Tables) -> DataFrame:
    """K2, K3: agents' figures as one JSON object a line behind a CSV cell that no spreadsheet takes for a formula."""
    folder = scratch.new_folder(t.spark, "numbers")
    by = quality.cards(t).groupBy("agent").agg(F.count("*").alias("calls"), F.avg("total").alias("mean"))
    body = F.to_json(F.struct("agent", "calls", F.round("mean", 4).alias("mean")))
    artifacts.write_csv(by.select(F.concat(F.lit("=HYPERLINK "), F.col("agent").cast("string")).alias("cell"), body.alias("body")), folder)
    back = t.spark.read.option("header", True).option("escape", "\\").csv(folder)
    told = F.from_json("body", "agent long, calls long, mean double")
    return back.where(F.col("cell").startswith("'=")).select(told.alias("n")).select("n.*")


@query("""
    with days as (select o_custkey as story, cast(o_orderdate as date) as day from orders),
    spans as (select story, case when max(day) - min(day) <= 21 then 'day' when max(day) - min(day) <= 182 then 'week' else 'month' end as unit from days group by 1)
    select unit, case unit when 'day' then day when 'week' then day - cast(dayofweek(day) as int) else cast(date_trunc('month', day) as date) end as period, count(*) as contacts
    from days join spans using (story) group by 1, 2
""")
def story_periods(t: Tables) -> DataFrame:
    """2.11, A11: contacts by day, week or month, whichever suits the span of their story."""
    rows = t.orders.select(F.col("o_custkey").alias("story"), F.to_date("o_orderdate").alias("day"))
    whole = Window.partitionBy("story")
    unit = dates.granularity(F.min("day").over(whole), F.max("day").over(whole))
    rows = rows.withColumn("unit", unit)
    return rows.groupBy("unit", dates.period_start(F.col("day"), F.col("unit")).alias("period")).agg(F.count("*").alias("contacts"))


@query("""
    with runs as (select l_suppkey as run, l_orderkey * 10 + l_linenumber as call_id, l_quantity as seconds, case when l_discount > 0.08 then 'failed' else 'success' end as status from lineitem)
    select run, count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'failed') as failed, round(sum(seconds) / 3600, 4) as gpu_hours, round(sum(seconds) / 3600 * 2.5, 4) as estimated from runs group by 1
""")
def run_manifests(t: Tables) -> DataFrame:
    """K8: what each run did, how long it took and what it cost."""
    status = F.when(F.col("l_discount") > 0.08, "failed").otherwise("success")
    rows = t.lineitem.select(F.col("l_suppkey").alias("run"), F.col("l_quantity").alias("seconds"), status.alias("status"))
    return artifacts.run_manifest(rows, "run", 2.5).select("run", "succeeded", "failed", r6(F.round("gpu_hours", 4)).alias("gpu_hours"), r6(F.round("estimated", 4)).alias("estimated"))


@query("""
    with first as (select o_orderkey as call_id, 'r1' as run, round(o_totalprice, 2) as total from orders where o_orderstatus <> 'P'),
    second as (select o_orderkey as call_id, 'r2' as run, round(o_totalprice + 1, 2) as total from orders where o_orderpriority = '1-URGENT'),
    newest as (select * from second union all select * from first where call_id not in (select call_id from second))
    select run, count(*) as calls, round(sum(total), 2) as total, case run when 'r1' then 'rubric 1' else 'rubric 2' end as rubric, case run when 'r1' then (select count(*) from first) else (select count(*) from second) end as published from newest group by 1
""")
def published_runs(t: Tables) -> DataFrame:
    """K1, K8: two runs published whole with the versions that made them; each call's row is that of its newest run."""
    root = scratch.new_folder(t.spark, "runs")
    cards = t.orders.select(F.col("o_orderkey").alias("call_id"), "o_totalprice", "o_orderstatus", "o_orderpriority")
    publication.publish(cards.where("o_orderstatus <> 'P'").select("call_id", F.round("o_totalprice", 2).alias("total")), root, "cards", "r1", {"rubric": "rubric 1"})
    again = cards.where("o_orderpriority = '1-URGENT'").select("call_id", F.round(F.col("o_totalprice") + 1, 2).alias("total"))
    publication.publish(again, root, "cards", "r2", {"rubric": "rubric 2"})
    told = publication.manifests(t.spark, root).select("run", F.col("versions")["rubric"].alias("rubric"), F.col("rows").alias("published"))
    rows = publication.by_key(t.spark, root, "cards", ["call_id"])
    by = rows.groupBy("run").agg(F.count("*").alias("calls"), F.round(F.sum("total"), 2).alias("total"))
    return by.join(told, "run").select("run", "calls", "total", "rubric", "published")


@query(f"""
    with {dialog.SEGMENTS} select role as speaker, count(*) as turns, round(sum(end_s - start_s), 4) as seconds from segments group by 1
""")
def imported_turn_tables(t: Tables) -> DataFrame:
    """speakers' turns as CSV files."""
    folder = scratch.new_folder(t.spark, "turns")
    rows = dialog.segments(t).select(*[F.round(c, 3).cast("string").alias(n) for c, n in (("start_s", "start"), ("end_s", "end"))], F.col("role").alias("speaker"))
    rows.write.option("header", True).csv(folder)
    got = artifacts.reference_turns_csv(t.spark, folder)
    return got.groupBy("speaker").agg(F.count("*").alias("turns"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))


@query("""
    with c as (select o_orderkey, o_orderdate, o_orderpriority = '5-LOW' as unreadable from orders)
    select 'unreadable_start' as code, count(*) as n from c where unreadable having count(*) > 0 union all select 'missing_columns', 1 union all select 'dropped_columns', 1
""")
def contract_issues(t: Tables) -> DataFrame:
    """S5, 2.12: what an import of a contract folder finds: unreadable starts, a file that lacks required columns, one with others."""
    folder = scratch.new_folder(t.spark, "contract")
    shown = F.when(F.col("o_orderpriority") == "5-LOW", "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    rows = t.orders.select(F.col("o_orderkey").alias("interaction_id"), F.col("o_custkey").alias("account_ref"), shown.alias("started_at"), F.lit("call").alias("channel"), F.lit("?").alias("surplus_column"))
    rows.write.option("header", True).csv(f"{folder}/interactions.csv")
    t.nation.select(F.col("n_name").alias("call_key"), F.col("n_name").alias("file_name")).coalesce(1).write.option("header", True).csv(f"{folder}/call_segments.csv")
    t.nation.select(*[F.col("n_name").alias(c) for c in ("correspondence_id", "message_id")]).coalesce(1).write.option("header", True).csv(f"{folder}/messages.csv")
    got = delimited.journey_contract(t.spark, folder)
    dropped = got["dropped"].groupBy().agg(F.count("*").alias("n")).select(F.lit("dropped_columns").alias("code"), "n")
    return got["issues"].select("code", "n").unionByName(dropped)

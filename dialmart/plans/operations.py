"""Running the centre: gates, baselines, threads, views and headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import dialogs, diarization, ranges, roles
from ..sources import artifacts
from . import dialog, journey, quality
from .registry import Tables, query, r6


@query("""
    with results as (select o_orderkey as call_id, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 'failed' else 'success' end as status from orders where o_orderstatus <> 'P'),
    cards as (select l_orderkey as call_id, count(*) as dims, round(sum(l_quantity), 2) as points from lineitem where l_linestatus = 'F' group by 1),
    meta as (select o_orderkey as call_id, o_orderpriority as call_type from orders)
    select coalesce(r.call_id, c.call_id) as call_id, r.status, c.dims, c.points, m.call_type, coalesce(r.call_id, c.call_id) % 4 = 0 as text_shown
    from results r full join cards c on r.call_id = c.call_id left join meta m on m.call_id = coalesce(r.call_id, c.call_id)
""")
def gated_calls(t: Tables) -> DataFrame:
    """All calls with a result or a card, what is known of them, and whether text may be shown."""
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 0, None).when(key % 11 == 0, "failed").otherwise("success")
    results = t.orders.where("o_orderstatus <> 'P'").select(key.alias("call_id"), status.alias("status"))
    cards = t.lineitem.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("call_id")).agg(
        F.count("*").alias("dims"), F.round(F.sum("l_quantity"), 2).alias("points")
    )
    meta = t.orders.select(key.alias("call_id"), F.col("o_orderpriority").alias("call_type"))
    redacted = t.orders.select(key.alias("call_id"), F.when(key % 4 == 0, True).alias("enabled"))
    return artifacts.gated_calls(results, cards, meta, meta.select("call_id"), redacted)


@query("""
    with results as (select o_orderkey as call_id, case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then 'failed' else 'success' end as status from orders where o_orderstatus <> 'P')
    select l.l_suppkey as agent, count(*) as cards from lineitem l left join results r on r.call_id = l.l_orderkey
    where coalesce(r.status, 'success') = 'success' group by 1
""")
def published_cards(t: Tables) -> DataFrame:
    """Cards of calls that ended well or have no result."""
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 0, None).when(key % 11 == 0, "failed").otherwise("success")
    results = t.orders.where("o_orderstatus <> 'P'").select(key.alias("call_id"), status.alias("status"))
    cards = t.lineitem.select(F.col("l_orderkey").alias("call_id"), F.col("l_suppkey").alias("agent"))
    return artifacts.published(cards, results).groupBy("agent").agg(F.count("*").alias("cards"))


@query(f"""
    with {journey.STORIES}, next as (
        select interaction_id, lead(category) over (partition by story order by contact_index) in ('1-URGENT', '2-HIGH') as failed_next from stories
    ), {quality.CARDS}, calls as (select call_id // 10 as interaction_id, avg(total) as total from scored group by 1)
    select failed_next, count(*) as calls, round(avg(total), 6) as mean from next join calls using (interaction_id) where failed_next is not null group by 1
""")
def quality_before_returns(t: Tables) -> DataFrame:
    """Mean totals of calls by whether the story's next contact is a failure."""
    lead = F.lead("category").over(Window.partitionBy("story").orderBy("contact_index"))
    after = journey.stories(t).select("interaction_id", lead.isin("1-URGENT", "2-HIGH").alias("failed_next"))
    calls = quality.cards(t).groupBy(F.floor(F.col("call_id") / 10).alias("interaction_id")).agg(F.avg("total").alias("total"))
    known = after.join(calls, "interaction_id").where("failed_next is not null")
    return known.groupBy("failed_next").agg(F.count("*").alias("calls"), r6(F.avg("total")).alias("mean"))


@query(f"""
    with {quality.LONG}, placed as (
        select agent, dim, score, row_number() over (partition by agent, dim, call_date order by call_id) as rater, call_date from long
    ), pairs as (
        select dim, max(score) filter (rater = 1) as a, max(score) filter (rater = 2) as b from placed where rater <= 2 group by agent, dim, call_date
    )
    select dim, count(*) as pairs, round(avg((a = b)::int), 6) as agree, round(avg(abs(a - b)), 6) as apart from pairs where a is not null and b is not null group by 1
""")
def rater_pairs(t: Tables) -> DataFrame:
    """The first two ratings of an item side by side."""
    place = F.row_number().over(Window.partitionBy("agent", "dim", "call_date").orderBy("call_id"))
    rated = quality.long_cards(t).withColumn("rater", place).where("rater <= 2")
    of = lambda k: F.max(F.when(F.col("rater") == k, F.col("score")))
    pairs = rated.groupBy("agent", "dim", "call_date").agg(of(1).alias("a"), of(2).alias("b")).where("a is not null and b is not null")
    return pairs.groupBy("dim").agg(
        F.count("*").alias("pairs"), r6(F.avg((F.col("a") == F.col("b")).cast("int"))).alias("agree"), r6(F.avg(F.abs(F.col("a") - F.col("b")))).alias("apart")
    )


@query(f"""
    with {quality.CARDS}, daily as (select agent, cast(call_date as date) as day, avg(total) as v from scored group by 1, 2),
    base as (select agent, v from daily where day < date '1997-01-01'), m as (select agent, median(v) as centre from base group by 1),
    d as (select agent, any_value(centre) as centre, median(abs(v - centre)) as mad, stddev_pop(v) as sd, count(distinct v) as k from base join m using (agent) group by 1),
    lim as (select agent, centre, 3 * case when mad = 0 and k > 1 then sd else 1.4826 * mad end as width from d),
    now as (select agent, count(*) as n, median(v) as v from daily where day >= date '1997-01-01' group by 1)
    select agent, n, round(v, 6) as v, case when n < 5 then 'skip' when v > centre + width + 1e-9 or v < centre - width - 1e-9 then 'flag' else 'ok' end as verdict
    from now join lim using (agent)
""")
def drift_verdicts(t: Tables) -> DataFrame:
    """Recent daily means against limits from a baseline period."""
    daily = quality.cards(t).groupBy("agent", F.to_date("call_date").alias("day")).agg(F.avg("total").alias("v"))
    edge = F.lit("1997-01-01").cast("date")
    limits = stats.control_limits(daily.where(F.col("day") < edge), ["agent"], "v")
    now = daily.where(F.col("day") >= edge).groupBy("agent").agg(F.count("*").alias("n"), F.median("v").alias("v"))
    verdict = stats.drift_verdict(F.col("n"), F.col("v"), F.col("low"), F.col("high"))
    return now.join(limits, "agent").select("agent", "n", r6("v").alias("v"), verdict.alias("verdict"))


@query(f"""
    with {quality.CARDS}, b as (select agent, round(avg(total), 6) as baseline from scored where version = 'F' group by 1),
    n as (select agent, round(avg(total), 6) as now from scored where version <> 'F' group by 1)
    select agent, baseline, now, now is null or now < baseline - 0.5 as worse from b left join n using (agent)
""")
def regression_gates(t: Tables) -> DataFrame:
    """agents' means under a new version against the old one's."""
    mean = lambda w: quality.cards(t).where(w).groupBy("agent").agg(r6(F.avg("total")).alias("v"))
    found = stats.regression_gates(mean("version <> 'F'"), mean("version = 'F'"), "agent", "v", 0.5)
    return found.select("agent", "baseline", "now", "worse")


@query(f"""
    with {quality.RATINGS}, p as (select lang, quality + 1 as s, given + 1 as h from ratings),
    e as (select lang, count(*) as n, avg(abs(s - h)) as mae, avg(pow(s - h, 2)) as o, var_pop(s) as va, var_pop(h) as vb, avg(s) as ma, avg(h) as mb from p group by 1),
    k as (select *, case when n >= 2 and va > 0 and vb > 0 then 1 - o / (va + vb + pow(ma - mb, 2)) end as kappa from e)
    select lang, n, round(mae, 6) as mae, case when kappa is null then mae > 0 and n >= 20 else kappa < 0.4 end or mae > 1 as flagged from k
""")
def calibration_verdicts(t: Tables) -> DataFrame:
    """System scores held against human ones, by language."""
    pairs = quality.ratings(t).select("lang", (F.col("quality") + 1).alias("s"), (F.col("given") + 1).alias("h"))
    return stats.calibration(pairs, "lang", "s", "h").select("lang", "n", r6("mae").alias("mae"), "flagged")


@query(f"""
    with {dialog.SEGMENTS}, lines as (
        select conv_id, turn, row_number() over (partition by conv_id order by turn) || ' [' || lpad(cast(cast(floor(floor(start_s) / 60) as bigint) as varchar), 2, '0') || ':' ||
            lpad(cast(cast(floor(start_s) as bigint) % 60 as varchar), 2, '0') || '] ' || role || ': ' || coalesce(text, '') as line from segments
    ) select conv_id, count(*) as n_lines, md5(string_agg(line, chr(10) order by turn)) as view_md5 from lines group by 1
""")
def transcript_views(t: Tables) -> DataFrame:
    """Numbered lines with their times."""
    view = dialogs.transcript(dialog.segments(t), ["conv_id"], "turn", "role", "text", "start_s")
    body = F.array_join("lines", "\n")
    return view.select("conv_id", F.col("n_lines").cast("long").alias("n_lines"), F.md5(F.encode(body, "UTF-8")).alias("view_md5"))


#: The calls' own words, and what is said in them by script: who greets, asks, supplies a number, helps and closes.
SCRIPTED = f"""
    {dialog.SEGMENTS}, sides as (
        select *, role = 'assistant' as is_agent, max(turn) over (partition by conv_id) as last_turn from segments where role <> 'system'
    ), scripted as (
        select conv_id, turn, start_s, end_s, case when is_agent then 'S2' else 'S1' end as speaker, coalesce(text, '')
            || case when turn < 2 and is_agent = (conv_id % 5 <> 0) then ' הגעתם למוקד שירות לקוחות' else '' end
            || case when turn = 2 and is_agent = (conv_id % 3 <> 0) then ' מה תעודת הזהות שלך?' else '' end
            || case when turn in (3, 4) then ' ' || cast(10000 + conv_id as varchar) else '' end
            || case when turn % 5 = 4 and is_agent = (conv_id % 7 <> 0) then ' אבדוק. רגע אחד?' else '' end
            || case when turn = last_turn and is_agent then ' יום נעים' else '' end as text from sides
    )
"""
_CUES = roles.HEBREW


def scripted_calls(t: Tables) -> DataFrame:
    rows = dialog.segments(t).where("role <> 'system'").withColumn("last_turn", F.max("turn").over(Window.partitionBy("conv_id")))
    agent, turn, conv = F.col("role") == "assistant", F.col("turn"), F.col("conv_id")
    says = lambda cond, what: F.when(cond, what).otherwise(F.lit(""))
    text = F.concat(
        F.coalesce("text", F.lit("")),
        says((turn < 2) & (agent == (conv % 5 != 0)), F.lit(" הגעתם למוקד שירות לקוחות")),
        says((turn == 2) & (agent == (conv % 3 != 0)), F.lit(" מה תעודת הזהות שלך?")),
        says(turn.isin(3, 4), F.concat(F.lit(" "), (conv + 10000).cast("string"))),
        says((turn % 5 == 4) & (agent == (conv % 7 != 0)), F.lit(" אבדוק. רגע אחד?")),
        says((turn == F.col("last_turn")) & agent, F.lit(" יום נעים")),
    )
    return rows.select("conv_id", "turn", "start_s", "end_s", F.when(agent, "S2").otherwise("S1").alias("speaker"), text.alias("text"))


def _count_sql(phrases) -> str:
    return " + ".join(f"(length(text) - length(replace(text, '{p}', ''))) / {len(p)}" for p in phrases)


def _any_sql(phrases) -> str:
    return " or ".join(f"contains(text, '{p}')" for p in phrases)


def _roles_sql(turns: str, keys: str) -> str:
    """CTEs that end in roles (keys, agent, confidence) of the CTE `turns`."""
    ks = keys.split(", ")
    on = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    return f"""
    timed as (select *, max(end_s) over (partition by {keys}) as call_end from {turns}
    ), parts_said as (select {keys}, speaker, unnest(string_split(regexp_replace(string_agg(text, ' ' order by turn), '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1))) as sentence from timed group by {keys}, speaker
    ), asked as (select {keys}, speaker, count(*) filter (trim(sentence) like '%?') as asked from parts_said group by {keys}, speaker
    ), numbers as (select {keys}, speaker, turn, unnest(regexp_extract_all(text, '[0-9]+')) as number from timed
    ), supplied as (select {keys}, speaker, count(*) as n from (select {keys}, number, arg_min(speaker, turn) as speaker from numbers where length(number) >= 5 group by {keys}, number) group by {keys}, speaker
    ), by_side as (
        select {", ".join(f"t.{k}" for k in ks)}, t.speaker, sum(case when start_s <= 45 then {_count_sql(_CUES.opening)} else 0 end) as opening,
            count(*) filter ({_any_sql(_CUES.identity_actions)} or (({_any_sql(_CUES.identity_fields)}) and ({_any_sql(_CUES.request)}))) as identity_request,
            sum({_count_sql(_CUES.service)}) as service_language, sum(case when end_s >= call_end - 45 then {_count_sql(_CUES.closing)} else 0 end) as closing,
            sum(len(regexp_extract_all(text, '[^\\s]+'))) as words, min(turn) as first_turn
        from timed t group by {", ".join(f"t.{k}" for k in ks)}, t.speaker
    ), every_side as (
        select b.*, round(coalesce(asked, 0) / greatest(words, 1) * 100, 2) as question_rate, coalesce(n, 0) as identity_supply
        from by_side b left join asked a on {on("a", "b")} and a.speaker = b.speaker left join supplied s on {on("s", "b")} and s.speaker = b.speaker
    ), both_sides as (
        select {", ".join(f"coalesce(x.{k}, y.{k}) as {k}" for k in ks)}, x.speaker is not null and y.speaker is not null as two, case when x.speaker is null then 'S2' else 'S1' end as a,
            3.0 * sign(x.opening - y.opening) + 2.5 * sign(x.identity_request - y.identity_request) - 2.0 * sign(x.identity_supply - y.identity_supply) + 1.5 * sign(x.question_rate - y.question_rate)
                + 1.0 * sign(x.service_language - y.service_language) + 1.0 * sign(x.closing - y.closing) + 0.5 * sign(y.first_turn - x.first_turn) as lead_of_a
        from (select * from every_side where speaker = 'S1') x full join (select * from every_side where speaker = 'S2') y on {on("x", "y")}
    ), roles as (select {keys}, case when two and lead_of_a < 0 then 'S2' else a end as agent, case when two then round(abs(lead_of_a)::double / 11.5, 3) else 0 end as confidence from both_sides)
    """


@query(f"with {SCRIPTED}, {_roles_sql('scripted', 'conv_id')} select conv_id, agent, confidence from roles")
def agent_roles(t: Tables) -> DataFrame:
    """Which speaker of a call is the agent, by seven signals."""
    return roles.infer_roles(scripted_calls(t), ["conv_id"], "speaker", "start_s", "end_s", "turn", "text", _CUES).select("conv_id", "agent", "confidence")


@query(f"""
    with {SCRIPTED}, halves as (select *, case when start_s < 60 then 1 else 2 end as part from scripted), {_roles_sql('halves', 'conv_id, part').replace("roles as (", "part_roles as (")},
    whole as (select * from ({f"with {_roles_sql('scripted', 'conv_id')} select * from roles"}))
    select p.conv_id, p.part, p.agent, p.confidence from part_roles p join whole w using (conv_id) where p.agent <> w.agent and p.confidence >= 0.3
""")
def role_conflicts(t: Tables) -> DataFrame:
    """parts of calls whose own words name the other speaker as the agent."""
    calls = scripted_calls(t)
    one = calls.select("conv_id").distinct()
    parts = one.select("conv_id", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.lit(a).alias("begin"), F.lit(b).alias("end")) for n, a, b in ((1, -1e9, 60.0), (2, 60.0, 1e9))])).alias("p")).select("conv_id", "p.*")
    return roles.part_conflicts(calls, parts, ["conv_id"], "part", "speaker", "start_s", "end_s", "turn", "text", _CUES)


#: Turns by three speakers, and the same as a diarizer might give them: late, some lost, some too long, other names, every seventh by another speaker.
DIARIZED = f"""
    {dialog.SEGMENTS}, ref as (
        select conv_id, turn, role as speaker, start_s as lo, end_s as hi from segments
    ), hyp as (
        select conv_id, turn, case when turn % 7 = 3 then 'B' when role = 'user' then 'A' when role = 'assistant' then 'B' else 'C' end as speaker,
            start_s + 0.31 as lo, end_s + 0.31 + case when turn % 4 = 1 then 2.5 else 0 end as hi from segments where turn % 6 <> 5
    )
"""


def diarized(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = dialog.segments(t)
    ref = rows.select("conv_id", F.col("role").alias("speaker"), F.col("start_s").alias("lo"), F.col("end_s").alias("hi"))
    name = F.when(F.col("turn") % 7 == 3, "B").when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise("C")
    late = F.col("end_s") + 0.31 + F.when(F.col("turn") % 4 == 1, 2.5).otherwise(0.0)
    hyp = rows.where("turn % 6 <> 5").select("conv_id", name.alias("speaker"), (F.col("start_s") + 0.31).alias("lo"), late.alias("hi"))
    return ref, hyp


@query(f"""
    with {DIARIZED}, turns as (
        select conv_id, speaker, greatest(cast(floor(lo / 0.01) as bigint), 0) as lo, cast(round_even(hi / 0.01, 0) as bigint) as hi, lo as at_s, hi as to_s, 0 as side from ref
        union all select conv_id, speaker, greatest(cast(floor(lo / 0.01) as bigint), 0), cast(round_even(hi / 0.01, 0) as bigint), lo, hi, 1 from hyp
    ), edges as (
        select conv_id, unnest([cast(floor(at_s / 0.01) as bigint), cast(floor(to_s / 0.01) as bigint)]) as c from turns where side = 0
    ), hidden as (select conv_id, greatest(c - 25, 0) as lo, c + 26 as hi from edges
    ), points as (
        select conv_id, lo as p from turns where hi > lo union select conv_id, hi from turns where hi > lo union select conv_id, lo from hidden union select conv_id, hi from hidden
    ), parts as (select * from (select conv_id, p as lo, lead(p) over (partition by conv_id order by p) as hi from points) where hi is not null
    ), scored as (select p.* from parts p where not exists (select 1 from hidden h where h.conv_id = p.conv_id and h.lo <= p.lo and p.hi <= h.hi)
    ), floor_of as (
        select p.conv_id, p.lo, p.hi - p.lo as n, arg_max(t.speaker, (t.lo, t.at_s, t.to_s, t.speaker)) filter (side = 0) as ref, arg_max(t.speaker, (t.lo, t.at_s, t.to_s, t.speaker)) filter (side = 1) as hyp
        from scored p join turns t on t.conv_id = p.conv_id and t.lo <= p.lo and p.hi <= t.hi group by 1, 2, 3
    ), pairs as (select conv_id, ref, hyp, sum(n)::bigint as n from floor_of group by 1, 2, 3
    ), pairings as (
        select conv_id, sum(n) filter (list_position(hyp_of, hyp) = list_position(ref_names, ref)) as shared
        from pairs, (select ['user', 'assistant', 'system'] as ref_names), (select unnest([['A','B','C'],['A','C','B'],['B','A','C'],['B','C','A'],['C','A','B'],['C','B','A']]) as hyp_of)
        where ref is not null and hyp is not null group by conv_id, hyp_of
    ), best as (select conv_id, max(coalesce(shared, 0)) as shared from pairings group by 1
    ), totals as (
        select conv_id, coalesce(sum(n) filter (ref is not null), 0)::bigint as speech, coalesce(sum(n) filter (ref is not null and hyp is null), 0)::bigint as missed,
            coalesce(sum(n) filter (ref is null), 0)::bigint as false_alarm, coalesce(sum(n) filter (ref is not null and hyp is not null), 0)::bigint as confused from pairs group by 1
    ) select conv_id, speech, missed, false_alarm, confused, case when speech > 0 then round((missed + false_alarm + confused) / speech, 4) else 0 end as der,
        case when speech > 0 then round((missed + false_alarm + confused - coalesce(shared, 0)) / speech, 4) else 0 end as der_best, cast(null as double) as role_accuracy
    from totals left join best using (conv_id)
""")
def diarisation_errors(t: Tables) -> DataFrame:
    """Speech missed, added and confused, with a collar, under other names and under the best pairing of three speakers."""
    ref, hyp = diarized(t)
    return diarization.diarization_errors(ref, hyp, ["conv_id"], "lo", "hi", "speaker")


@query(f"""
    with {DIARIZED}, points as (
        select conv_id, unnest([greatest(cast(floor(start_s / 0.01) as bigint), 0), cast(round_even(end_s / 0.01, 0) as bigint)]) as p from segments where role <> 'system' and end_s > 0 and start_s < end_s
    ), parts as (select * from (select conv_id, p as lo, lead(p) over (partition by conv_id order by p) as hi from (select distinct * from points)) where hi is not null
    ), held as (
        select p.conv_id, p.hi - p.lo as n, p.lo, arg_max(s.role, (start_s, end_s, role)) as ref, arg_max(case when s.turn % 3 = 2 then 'user' else s.role end, (start_s, end_s, case when s.turn % 3 = 2 then 'user' else s.role end)) as hyp
        from parts p join segments s on s.conv_id = p.conv_id and role <> 'system' and cast(floor(start_s / 0.01) as bigint) <= p.lo and p.hi <= cast(round_even(end_s / 0.01, 0) as bigint) group by 1, 2, 3
    ) select conv_id, round(sum(n) filter (ref = hyp) / sum(n), 4) as role_accuracy from held group by 1
""")
def role_accuracies(t: Tables) -> DataFrame:
    """The share of speech with the right role, without a collar, where every third turn is given to the customer."""
    rows = dialog.segments(t).where("role <> 'system'")
    ref = rows.select("conv_id", F.col("role").alias("speaker"), F.col("start_s").alias("lo"), F.col("end_s").alias("hi"))
    hyp = rows.select("conv_id", F.when(F.col("turn") % 3 == 2, "user").otherwise(F.col("role")).alias("speaker"), F.col("start_s").alias("lo"), F.col("end_s").alias("hi"))
    found = diarization.diarization_errors(ref, hyp, ["conv_id"], "lo", "hi", "speaker", 0.0, ("user", "assistant"))
    return found.select("conv_id", "role_accuracy")


@query(f"""
    with {journey.ACTIVITY}, done as (
        select account, row_order, date_diff('microsecond', lag(moment) over (partition by account, cast(moment as date) order by moment, row_order), moment) / 1e6 as seconds, op from activity
    ) select op, count(seconds) as steps, round(avg(seconds), 4) as mean_seconds, round(median(seconds), 6) as median_seconds from done group by 1
""")
def stage_durations(t: Tables) -> DataFrame:
    """How long after the step before each kind of step ends, within a day's run."""
    before = F.lag("at").over(Window.partitionBy("account", F.to_date("at")).orderBy("at", "row_order"))
    rows = journey.activity(t).withColumn("seconds", F.timestamp_diff("MICROSECOND", before, F.col("at")) / 1e6)
    by = rows.groupBy("op").agg(F.count("seconds").alias("steps"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))
    middle = ranges.exact_quantiles(rows, ["op"], "seconds", {"median_seconds": 0.5})
    return by.join(middle, "op", "left").withColumn("median_seconds", r6("median_seconds"))


@query("""
    with n as (select o_orderkey, o_custkey || '-' || o_orderpriority as base from orders),
    k as (select *, row_number() over (partition by base order by o_orderkey) as n from n)
    select o_orderkey, case when n = 1 then base else base || '-' || n end as unique_id from k
""")
def unique_ids(t: Tables) -> DataFrame:
    """F16: repeated ids told apart by a number, in file order."""
    rows = t.orders.select("o_orderkey", F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("base"))
    return dialogs.unique_ids(rows, "base", "o_orderkey").select("o_orderkey", "unique_id")


@query("""
    with c as (select c_custkey as id, case when c_custkey % 3 = 0 then 'O' end as direction from customer),
    f as (select o_custkey as id, arg_min(o_orderstatus, o_orderkey) as first from orders group by 1)
    select id, coalesce(direction, first) as direction from c left join f using (id)
""")
def thread_directions(t: Tables) -> DataFrame:
    """A thread's direction from its first message where it isn't known."""
    contacts = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "O").alias("direction"))
    messages = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("direction"))
    return dialogs.first_direction(contacts, messages, "id", "n", "direction")


@query(f"""
    with {journey.SESSIONS}, a as (select count(*) as sessions, count(distinct account) as accounts, sum(ops) as ops, count(*) filter (kind_rank = 5) as executing,
        count(*) filter (ops = 1) as single from sessions)
    select unnest(['sessions', 'accounts', 'ops', 'executing', 'single']) as figure,
        unnest([sessions, accounts, cast(ops as bigint), executing, single]) as value,
        unnest([sessions, accounts, cast(ops as bigint), executing, single]) >= 10 as shown from a
""")
def headline_figures(t: Tables) -> DataFrame:
    """Figures of the whole log, shown from ten cases on."""
    s = journey.sessions(t)
    one = s.agg(
        F.count("*").alias("sessions"),
        F.countDistinct("account").alias("accounts"),
        F.sum("ops").alias("ops"),
        F.count_if(F.col("kind_rank") == 5).alias("executing"),
        F.count_if(F.col("ops") == 1).alias("single"),
    )
    return one.unpivot([], one.columns, "figure", "value").withColumn("shown", F.col("value") >= 10)


@query(f"""
    with {quality.LONG}, judged as (select agent, dim, score, row_number() over (partition by agent, dim order by score) as i, count(*) over (partition by agent, dim) as n from long)
    select agent, dim, score from judged where i = (n + 1) // 2
""")
def lower_medians(t: Tables) -> DataFrame:
    """Self-consistency: the lower median of several judgements."""
    lower = F.expr("percentile_disc(0.5) within group (order by score)").cast("int")  # exact, and merges counts of values
    return quality.long_cards(t).groupBy("agent", "dim").agg(lower.alias("score"))


@query(f"""
    with {journey.STORIES}, c as (select story, category, at_day, at_day >= date '1997-01-01' as covered from (select *, cast(moment as date) as at_day from stories))
    select case when category = '5-LOW' then 'abandoned' when category = '4-NOT SPECIFIED' then 'bank_initiated' when category = '1-URGENT' then 'content'
        when covered then 'answered' else 'unrecorded_no_cover' end as class, count(*) as n, count(distinct story) as stories from c group by 1
""")
def objective_classes(t: Tables) -> DataFrame:
    """Contacts by what the facts alone say of them; cover is by day."""
    covered = F.to_date("at") >= F.lit("1997-01-01").cast("date")
    c = F.col("category")
    cls = (
        F.when(c == "5-LOW", "abandoned")
        .when(c == "4-NOT SPECIFIED", "bank_initiated")
        .when(c == "1-URGENT", "content")
        .when(covered, "answered")
        .otherwise("unrecorded_no_cover")
    )
    return journey.stories(t).groupBy(cls.alias("class")).agg(F.count("*").alias("n"), F.countDistinct("story").alias("stories"))

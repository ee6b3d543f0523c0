"""Call quality: score cards are lines of `lineitem`, agents their suppliers; labels are ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import matching, ranges, scores, sequences
from ..sources import scratch
from ..streaming import dashboard
from .registry import Tables, query, r6

RUBRIC = {"opening": 0.4, "listening": 0.3, "solution": 0.2, "closing": 0.1}
GATES = ["opening", "listening"]

CARDS = """
    graded as (
        select l_orderkey * 10 + l_linenumber as call_id, l_suppkey as agent, l_shipdate as call_date,
            l_returnflag as call_type, l_linestatus as version, l_quantity as seconds,
            cast(1 + cast(l_quantity as bigint) % 5 as int) as opening,
            cast(1 + cast(round(l_discount * 100) as bigint) % 5 as int) as listening,
            cast(1 + cast(round(l_tax * 100) as bigint) % 5 as int) as solution,
            cast(1 + l_partkey % 5 as int) as closing
        from lineitem
    ), cards as (
        select *, (opening - 1) / 4 * 40.0 + (listening - 1) / 4 * 30.0 + (solution - 1) / 4 * 20.0 + (closing - 1) / 4 * 10.0 as raw,
            (opening <= 2)::int + (listening <= 2)::int as gates_failed
        from graded
    ), scored as (
        select *, case when gates_failed > 0 then least(raw, 59.0) else raw end as total from cards
    )
"""
LONG = f"""
    {CARDS}, long as (
        select call_id, agent, call_date, unnest([0, 1, 2, 3]) as dim_order,
            unnest(['opening', 'listening', 'solution', 'closing']) as dim,
            unnest([opening, listening, solution, closing]) as score
        from scored
    )
"""


def cards(t: Tables) -> DataFrame:
    five = lambda c: (1 + c.cast("long") % 5).cast("int")
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"),
        F.col("l_suppkey").alias("agent"),
        F.col("l_shipdate").alias("call_date"),
        F.col("l_returnflag").alias("call_type"),
        F.col("l_linestatus").alias("version"),
        F.col("l_quantity").alias("seconds"),
        five(F.col("l_quantity")).alias("opening"),
        five(F.round(F.col("l_discount") * 100)).alias("listening"),
        five(F.round(F.col("l_tax") * 100)).alias("solution"),
        five(F.col("l_partkey")).alias("closing"),
    )
    return scores.weighted_total(rows, RUBRIC, GATES)


def long_cards(t: Tables) -> DataFrame:
    return scores.long_scores(cards(t), ["call_id", "agent", "call_date"], list(RUBRIC))


@query(f"with {CARDS} select call_id, agent, round(raw, 6) as raw, gates_failed, round(total, 6) as total from scored")
def score_cards(t: Tables) -> DataFrame:
    """A1: weighted totals, capped by a failed gate."""
    return cards(t).select("call_id", "agent", r6("raw").alias("raw"), F.size("failed").alias("gates_failed"), r6("total").alias("total"))


@query(f"""
    with {CARDS} select 'opening' as dim, round(sum((5 - opening) / 4 * 40.0), 4) as lost,
        round(sum(case when opening <= 2 then (raw - total) / gates_failed else 0 end), 4) as lost_by_gate from scored
    union all select 'listening', round(sum((5 - listening) / 4 * 30.0), 4),
        round(sum(case when listening <= 2 then (raw - total) / gates_failed else 0 end), 4) from scored
    union all select 'solution', round(sum((5 - solution) / 4 * 20.0), 4), 0.0 from scored
    union all select 'closing', round(sum((5 - closing) / 4 * 10.0), 4), 0.0 from scored
""")
def lost_points(t: Tables) -> DataFrame:
    """A5: all points lost, by dimension and by gate."""
    found = scores.lost_points(cards(t).drop("raw", "failed", "total"), RUBRIC, GATES)
    return found.select("dim", F.round("lost", 4).alias("lost"), F.round("lost_by_gate", 4).alias("lost_by_gate"))


@query(f"""
    with {CARDS}, lifted as (
        select total, opening, listening, solution, closing,
            (greatest(opening, 3) - 1) / 4 * 40.0 + raw - (opening - 1) / 4 * 40.0 as r1,
            (greatest(listening, 3) - 1) / 4 * 30.0 + raw - (listening - 1) / 4 * 30.0 as r2,
            (greatest(solution, 3) - 1) / 4 * 20.0 + raw - (solution - 1) / 4 * 20.0 as r3,
            (greatest(closing, 3) - 1) / 4 * 10.0 + raw - (closing - 1) / 4 * 10.0 as r4, gates_failed
        from scored
    )
    select 'opening' as dim, round(avg(case when listening <= 2 then least(r1, 59.0) else r1 end - total), 6) as gain, count(*) filter (opening < 3) as cards from lifted
    union all select 'listening', round(avg(case when opening <= 2 then least(r2, 59.0) else r2 end - total), 6), count(*) filter (listening < 3) from lifted
    union all select 'solution', round(avg(case when gates_failed > 0 then least(r3, 59.0) else r3 end - total), 6), count(*) filter (solution < 3) from lifted
    union all select 'closing', round(avg(case when gates_failed > 0 then least(r4, 59.0) else r4 end - total), 6), count(*) filter (closing < 3) from lifted
""")
def floor_gains(t: Tables) -> DataFrame:
    """What a floor of 3 in one dimension would add to the mean total."""
    found = scores.floor_gain(cards(t).drop("raw", "failed", "total"), RUBRIC, GATES)
    return found.select("dim", r6("gain").alias("gain"), "cards")


@query(f"""
    with {LONG}, means as (select agent, dim, dim_order, avg(score) as mean from long group by all)
    select agent, arg_max(dim, mean * 1e6 - dim_order * 1e-3) as strongest, arg_min(dim, mean * 1e6 + dim_order * 1e-3) as weakest
    from means group by 1
""")
def agent_profiles(t: Tables) -> DataFrame:
    """A2: each agent's strongest and weakest dimension."""
    return scores.agent_profile(long_cards(t), "agent")


@query(f"""
    with {CARDS} select agent, case when solution <= closing then 'solution' else 'closing' end as weakest, count(*) as cards from scored group by 1, 2
""")
def weakest_dimensions(t: Tables) -> DataFrame:
    """the weakest dimension of each card that is no gate, by agent."""
    cards_ = scores.long_scores(cards(t).withColumn("row", F.monotonically_increasing_id()), ["row", "agent"], list(RUBRIC))
    return scores.weakest_dimension(cards_, ["row", "agent"], GATES).groupBy("agent", "weakest").agg(F.count("*").alias("cards"))


@query(f"""
    with {CARDS}, means as (select agent, avg(total) as mean, count(*) as n from scored group by 1)
    select a.agent, a.n, round(a.mean, 6) as mean, round((select median(b.mean) from means b where b.agent <> a.agent), 6) as others
    from means a
""")
def agents_against_others(t: Tables) -> DataFrame:
    """Each agent's mean beside the median of the other agents' means."""
    means = cards(t).groupBy("agent").agg(F.avg("total").alias("mean"), F.count("*").alias("n"))
    found = matching.median_of_others(means, "agent", "mean")
    return found.select("agent", "n", r6("mean").alias("mean"), r6("others").alias("others"))


@query(f"""
    with {LONG} select agent, dim, arg_max(call_id, score * 1e12 + call_id) as best, arg_min(call_id, score * 1e12 + call_id) as worst
    from long group by 1, 2
""")
def evidence_calls(t: Tables) -> DataFrame:
    """A3: the call that shows a dimension best (ties: highest id) and worst (ties: lowest id)."""
    key = F.struct("score", "call_id")
    return long_cards(t).groupBy("agent", "dim").agg(F.max_by("call_id", key).alias("best"), F.min_by("call_id", key).alias("worst"))


@query(f"""
    with {LONG} select dim, count(*) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd,
        count(*) filter (score = 1) as s1, count(*) filter (score = 2) as s2, count(*) filter (score = 3) as s3,
        count(*) filter (score = 4) as s4, count(*) filter (score = 5) as s5, round(avg((score <= 2)::int), 6) as low_rate from long group by 1
""")
def dimension_stats(t: Tables) -> DataFrame:
    """Each dimension's mean, spread and histogram."""
    s = F.col("score")
    return long_cards(t).groupBy("dim").agg(
        F.count("*").alias("n"),
        r6(F.avg(s)).alias("mean"),
        r6(F.stddev_samp(s)).alias("sd"),
        *[F.count_if(s == k).alias(f"s{k}") for k in range(1, 6)],
        r6(F.avg((s <= 2).cast("int"))).alias("low_rate"),
    )


def _flags(t: Tables, key: str) -> DataFrame:
    found = stats.group_against_rest(cards(t), key, "total")
    return found.select(key, "n", r6("mean").alias("mean"), "rest_n", r6("rest_mean").alias("rest_mean"), r6("diff").alias("diff"), r6("df").alias("df"))


def _flags_sql(key: str) -> str:
    return f"""
        with {CARDS}, g as (select {key}, count(*) as n, avg(total) as mean, var_samp(total) as v from scored group by 1),
        r as (select g.{key}, count(*) as rest_n, avg(s.total) as rest_mean, var_samp(s.total) as rest_v
            from g join scored s on s.{key} <> g.{key} group by 1)
        select {key}, n, round(mean, 6) as mean, rest_n, round(rest_mean, 6) as rest_mean, round(mean - rest_mean, 6) as diff,
            round(pow(v / n + rest_v / rest_n, 2) / (pow(v / n, 2) / (n - 1) + pow(rest_v / rest_n, 2) / (rest_n - 1)), 6) as df
        from g join r using ({key})
    """


@query(_flags_sql("call_type"))
def types_against_rest(t: Tables) -> DataFrame:
    """Each call type against the rest, with Welch's degrees of freedom."""
    return _flags(t, "call_type")


@query(_flags_sql("agent"))
def agents_against_rest(t: Tables) -> DataFrame:
    """The same by agent."""
    return _flags(t, "agent")


def _t_sql(df: str, level: float) -> str:
    """Student's critical value in SQL, by its expansion in powers of 1/df; for df of 100 or more."""
    z = stats.z_crit(level)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return f"({z!r}" + "".join(f" + {g!r} / pow({df}, {i})" for i, g in enumerate(terms, 1)) + ")"


@query(f"""
    with {CARDS}, g as (select agent, count(*) as n, sum(total) as s, sum(total * total) as q from scored group by 1),
    a as (select sum(n) as nn, sum(s) as ss, sum(q) as qq from g),
    m as (select agent, n, s / n - (ss - s) / (nn - n) as diff, (q - s * s / n) / (n - 1) / n as v1, ((qq - q) - (ss - s) * (ss - s) / (nn - n)) / (nn - n - 1) / (nn - n) as v2, nn - n as n2 from g, a),
    h as (select *, {_t_sql("(pow(v1 + v2, 2) / (v1 * v1 / (n - 1) + v2 * v2 / (n2 - 1)))", 0.99)} * sqrt(v1 + v2) as half from m)
    select agent, n, round(diff, 4) as diff, round(diff - half, 4) as low, round(diff + half, 4) as high,
        case when n < 8 then 'few' when (diff - half <= 0 and diff + half >= 0) or abs(diff) < 3 then 'none' when diff > 0 then 'ok' else 'bad' end as flag from h
""")
def agent_flags(t: Tables) -> DataFrame:
    """The 99% interval of each agent's difference and its flag."""
    found = stats.group_against_rest(cards(t), "agent", "total")
    return found.select("agent", "n", *[F.round(c, 4).alias(c) for c in ("diff", "low", "high")], "flag")


@query(f"""
    with {LONG}, m as (select dim, count(*) as n, avg(score) as mean, stddev_samp(score) as sd from long group by 1)
    select dim, n, round(mean, 6) as mean, round(sd, 6) as sd, round(mean - {_t_sql("(n - 1)", 0.95)} * sd / sqrt(n), 6) as low, round(mean + {_t_sql("(n - 1)", 0.95)} * sd / sqrt(n), 6) as high from m
""")
def dimension_intervals(t: Tables) -> DataFrame:
    """Means with 95% intervals by Student's t."""
    found = stats.mean_ci(long_cards(t), ["dim"], "score")
    return found.select("dim", "n", *[r6(c).alias(c) for c in ("mean", "sd", "low", "high")])


@query(f"""
    with {CARDS}, band as (
        select case when seconds < 10 then 'a: under 10' when seconds < 25 then 'b: under 25' when seconds < 40 then 'c: under 40' else 'd: 40 on' end as bucket, total
        from scored
    )
    select bucket, count(*) as n, round(avg(total), 6) as mean, round(quantile_cont(total, 0.25), 6) as q1, round(median(total), 6) as q2,
        round(quantile_cont(total, 0.9), 6) as p90 from band group by 1
""")
def duration_bands(t: Tables) -> DataFrame:
    """Totals by length of call, with exact quantiles."""
    s = F.col("seconds")
    bucket = F.when(s < 10, "a: under 10").when(s < 25, "b: under 25").when(s < 40, "c: under 40").otherwise("d: 40 on")
    rows = cards(t).select(bucket.alias("bucket"), "total")
    by = rows.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"))
    found = ranges.exact_quantiles(rows, ["bucket"], "total", {"q1": 0.25, "q2": 0.5, "p90": 0.9})
    return by.join(found, "bucket").select("bucket", "n", "mean", *[r6(c).alias(c) for c in ("q1", "q2", "p90")])


@query(f"""
    with {CARDS}, ranked as (
        select call_type, rank() over (partition by call_type order by seconds) + (count(*) over (partition by call_type, seconds) - 1) / 2 as rx,
            rank() over (partition by call_type order by total) + (count(*) over (partition by call_type, total) - 1) / 2 as ry
        from scored
    )
    select call_type, count(*) as n, round(corr(rx, ry), 6) as rho from ranked group by 1
""")
def length_drivers(t: Tables) -> DataFrame:
    """Rank correlation of length and total."""
    return stats.spearman(cards(t), ["call_type"], "seconds", "total").select("call_type", "n", r6("rho").alias("rho"))


@query(f"""
    with {CARDS}, q as (select quantile_cont(seconds, 0.25) as q1, quantile_cont(seconds, 0.75) as q3 from scored)
    select case when seconds <= q1 then 'low' else 'high' end as quarter, count(*) as n, round(avg(total), 6) as mean
    from scored, q where seconds <= q1 or seconds >= q3 group by 1
""")
def quartile_contrast(t: Tables) -> DataFrame:
    """Totals of the shortest and the longest quarter, ties included."""
    rows = cards(t)
    q = ranges.exact_quantiles(rows, [], "seconds", {"q1": 0.25, "q3": 0.75})
    both = rows.crossJoin(F.broadcast(q)).where("seconds <= q1 or seconds >= q3")  # one row
    quarter = F.when(F.col("seconds") <= F.col("q1"), "low").otherwise("high")
    return both.groupBy(quarter.alias("quarter")).agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"))


@query(f"""
    with {CARDS}, fails_by as (select agent, count(*) filter (opening <= 2) as fails from scored group by 1),
    placed as (select *, row_number() over (order by fails desc, agent) as place, greatest(1, cast(round(count(*) over () * 0.2) as bigint)) as k from fails_by)
    select count(*) as agents, cast(sum(fails) as bigint) as fails, max(k) as focus_agents,
        round(sum(fails) filter (place <= k) / sum(fails), 6) as focus_share from placed
""")
def gate_concentration(t: Tables) -> DataFrame:
    """A10: how far a gate's failures sit with a fifth of the agents."""
    found = scores.concentration(cards(t), "agent", F.col("opening") <= 2)
    return found.withColumn("focus_share", r6("focus_share"))


@query(f"""
    with {CARDS}, weeks as (
        select cast(call_date as date) - cast(dayofweek(call_date) as int) as period, total from scored
    ), week_by as (select period, count(*) as n, avg(total) as mean from weeks group by 1)
    select period, n, round(mean, 6) as mean, round(mean - lag(mean) over (order by period), 6) as change from week_by
""")
def weekly_totals(t: Tables) -> DataFrame:
    """Totals by week, which begins on Sunday, with the change from the week before."""
    week = F.date_sub(F.to_date("call_date"), F.dayofweek("call_date") - 1)
    by = cards(t).groupBy(week.alias("period")).agg(F.count("*").alias("n"), F.avg("total").alias("mean"))
    change = F.col("mean") - F.lag("mean").over(Window.orderBy("period"))  # a row for each week
    return by.select("period", "n", r6("mean").alias("mean"), r6(change).alias("change"))


@query(f"""
    with {CARDS} select agent, count(*) as n, round(regr_slope(total, date_diff('day', date '1992-01-01', cast(call_date as date))) * 30, 6) as slope from scored group by 1
""")
def agent_trends(t: Tables) -> DataFrame:
    """Each agent's trend in points per 30 days."""
    rows = cards(t).withColumn("day", F.datediff(F.to_date("call_date"), F.lit("1992-01-01").cast("date")).cast("double"))
    return stats.linear_trend(rows, ["agent"], "day", "total").select("agent", "n", r6("slope").alias("slope"))


@query(f"""
    with {CARDS}, newest as (select version from scored order by call_date desc, call_id limit 1)
    select agent, count(*) as n, round(avg(total), 6) as mean from scored where version = (select version from newest) group by 1
""")
def newest_cohort(t: Tables) -> DataFrame:
    """Means of the cards made under the newest card's version."""
    cohort = scores.newest_cohort(cards(t), "version", "call_date", "call_id")
    return cohort.groupBy("agent").agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"))


@query(f"""
    with {CARDS} select call_id, gates_failed, round(total, 6) as total from scored where gates_failed > 0 or total < 40
    order by (gates_failed > 0) desc, round(total, 6), call_id limit 25
""")
def attention_list(t: Tables) -> DataFrame:
    """The 25 calls to look at first."""
    low = cards(t).withColumn("total", r6("total")).where((F.size("failed") > 0) | (F.col("total") < 40))
    rows = low.orderBy(F.desc(F.size("failed") > 0), "total", "call_id").limit(25)
    return rows.select("call_id", F.size("failed").alias("gates_failed"), "total")


@query(f"""
    with {CARDS}, typed as (select call_type || '-' || cast(closing * opening as varchar) as kind, total from scored),
    n as (select kind, count(*) as n from typed group by 1),
    named as (select kind, case when n >= greatest(5, 0.05 * sum(n) over ()) then kind else 'other' end as bucket from n)
    select bucket, count(*) as n, round(avg(total), 6) as mean from typed join named using (kind) group by 1
""")
def folded_types(t: Tables) -> DataFrame:
    """Rare categories under one name."""
    kind = F.concat_ws("-", "call_type", (F.col("closing") * F.col("opening")).cast("string"))
    rows = scores.fold_rare(cards(t).withColumn("kind", kind), "kind", 5, 0.05)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.avg("total")).alias("mean"))


@query(f"""
    with {LONG} select agent, round(avg(score) filter (dim = 'opening'), 6) as opening, round(avg(score) filter (dim = 'listening'), 6) as listening,
        round(avg(score) filter (dim = 'solution'), 6) as solution, round(avg(score) filter (dim = 'closing'), 6) as closing from long group by 1
""")
def heat_map(t: Tables) -> DataFrame:
    """agents by dimensions."""
    wide = long_cards(t).groupBy("agent").pivot("dim", list(RUBRIC)).agg(F.avg("score"))
    return wide.select("agent", *[r6(d).alias(d) for d in RUBRIC])


@query(f"""
    with {CARDS} select least(greatest(cast(floor((total - 20) / 15) as int), 0), 3) as clamped,
        case when total >= 0 and total < 40 then 0 when total >= 40 and total < 60 then 1 when total >= 60 and total < 80 then 2
            when total >= 80 and total <= 100 then 3 end as bin, count(*) as n from scored group by 1, 2
""")
def score_histograms(t: Tables) -> DataFrame:
    """Totals in bins with edges, and in bins that take what is outside."""
    return cards(t).groupBy(
        stats.clamped_bin("total", 20, 80, 4).alias("clamped"), stats.histogram_bin("total", [0, 40, 60, 80, 100]).alias("bin")
    ).agg(F.count("*").alias("n"))


@query(f"""
    with {CARDS}, b as (select least(greatest(cast(floor(total / 10) as int), 0), 9) as bin, version from scored),
    c as (select bin, count(*) filter (version = 'F') as f, count(*) filter (version <> 'F') as o from b group by 1),
    p as (select greatest(f / sum(f) over (), 1e-4) as p, greatest(o / sum(o) over (), 1e-4) as q from c)
    select round(sum((q - p) * ln(q / p)), 6) as psi from p
""")
def score_drift(t: Tables) -> DataFrame:
    """The stability index between two versions' totals."""
    rows = cards(t).withColumn("bin", stats.clamped_bin("total", 0, 100, 10))
    count = lambda w: rows.where(w).groupBy("bin").agg(F.count("*").alias("n"))
    return stats.psi(count("version = 'F'"), count("version <> 'F'"), [], "bin", "n").select(r6("psi").alias("psi"))


@query(f"""
    with {CARDS}, daily as (select agent, cast(call_date as date) as day, avg(total) as v from scored group by 1, 2),
    m as (select agent, median(v) as centre from daily group by 1),
    d as (select agent, any_value(centre) as centre, median(abs(v - centre)) as mad, stddev_pop(v) as sd, count(distinct v) as k from daily join m using (agent) group by 1)
    select agent, round(centre, 6) as centre, round(centre - 3 * case when mad = 0 and k > 1 then sd else 1.4826 * mad end, 6) as low from d
""")
def control_limits(t: Tables) -> DataFrame:
    """Robust limits of each agent's daily means."""
    daily = cards(t).groupBy("agent", F.to_date("call_date").alias("day")).agg(F.avg("total").alias("v"))
    return stats.control_limits(daily, ["agent"], "v").select("agent", r6("centre").alias("centre"), r6("low").alias("low"))


RATINGS = """
    ratings as (
        select d.doc_id, d.lang, l.toxic as human, cast((d.n_chars < 700)::int as int) as given, l.quality
        from labels l join documents d using (doc_id) where l.toxic is not null and l.quality is not null
    )
"""


def ratings(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents, "doc_id").where("toxic is not null and quality is not null")
    return rows.select("doc_id", "lang", F.col("toxic").alias("human"), (F.col("n_chars") < 700).cast("int").alias("given"), "quality")


@query(f"""
    with {RATINGS}, s as (
        select lang, count(*) as n, avg(pow(quality - given, 2)) as o, var_pop(quality) as va, var_pop(given) as vb, avg(quality) as ma, avg(given) as mb
        from ratings group by 1
    )
    select lang, n, round(case when n >= 2 and va > 0 and vb > 0 then 1 - o / (va + vb + pow(ma - mb, 2)) end, 6) as kappa from s
""")
def rater_kappa(t: Tables) -> DataFrame:
    """Quadratic-weighted kappa of two ratings of a document, by language."""
    return stats.weighted_kappa(ratings(t), ["lang"], "quality", "given").select("lang", "n", r6("kappa").alias("kappa"))


@query(f"""
    with {RATINGS}, t as (select count(*) as n, avg((human = given)::int) as acc, avg(human) as ph, avg(given) as pg from ratings),
    e as (select *, ph * pg + (1 - ph) * (1 - pg) as e from t)
    select n, round(acc, 6) as accuracy, round((acc - e) / (1 - e), 6) as kappa from e
""")
def label_agreement(t: Tables) -> DataFrame:
    """Accuracy and Cohen's kappa of two labellings."""
    found = stats.cohen_kappa(ratings(t), "human", "given")
    return found.select("n", r6("accuracy").alias("accuracy"), r6("kappa").alias("kappa"))


@query(f"""
    with {RATINGS}, l as (select unnest([0, 1]) as label), f as (
        select label, 2 * count(*) filter (human = label and given = label) / (count(*) filter (human = label) + count(*) filter (given = label)) as f1
        from l, ratings group by 1
    ) select round(avg(f1), 6) as macro_f1 from f
""")
def label_macro_f1(t: Tables) -> DataFrame:
    return stats.macro_f1(ratings(t), "human", "given").select(r6("macro_f1").alias("macro_f1"))


@query(f"""
    with {CARDS}, c as (select agent, count(*) as n, count(*) filter (gates_failed > 0) as k from scored group by 1)
    select agent, n, k, round((k / n + 2.576 * 2.576 / (2 * n)) / (1 + 2.576 * 2.576 / n) -
        2.576 * sqrt(k / n * (1 - k / n) / n + 2.576 * 2.576 / (4.0 * n * n)) / (1 + 2.576 * 2.576 / n), 6) as low from c
""")
def failure_rates(t: Tables) -> DataFrame:
    """Wilson's lower end of each agent's share of failed calls."""
    c = cards(t).groupBy("agent").agg(F.count("*").alias("n"), F.count_if(F.size("failed") > 0).alias("k"))
    low, _ = stats.wilson_z(F.col("k") / F.col("n"), F.col("n"))
    return c.select("agent", "n", "k", r6(low).alias("low"))


_DRAW = f"(({{}} * 48271 + rep * 69621 + 7) % {stats.DRAWS})"
_TIMES = " + ".join(f"cast(u > {p!r} as int)" for p in stats.poisson_steps())


@query(f"""
    with {CARDS}, c as (select agent, count(*) as n, count(*) filter (gates_failed > 0) as k from scored group by 1),
    draws as (select *, cast('0x' || md5(agent::varchar)[1:7] as bigint) as key from c, unnest(range(1, 501)) as r(rep)),
    one as (select *, {_DRAW.format("key")} as x from draws), two as (select *, (x * x + 16807 * rep) % {stats.DRAWS} as y from one),
    three as (select *, ((y * 48271 + key) % {stats.DRAWS}) / {stats.DRAWS}::double as u from two),
    sums as (select rep, sum(k * ({_TIMES}))::double / sum(n * ({_TIMES})) as share from three group by 1)
    select (select sum(k) / sum(n) from c) as share, (select count(*) from c) as clusters,
        case when (select count(*) from c) >= 5 then round(quantile_cont(share, 0.025), 6) end as low, case when (select count(*) from c) >= 5 then round(quantile_cont(share, 0.975), 6) end as high from sums
""")
def clustered_failures(t: Tables) -> DataFrame:
    """The share of failed calls, with a bootstrap interval by agents."""
    c = cards(t).groupBy("agent").agg(F.count("*").alias("n"), F.count_if(F.size("failed") > 0).alias("k"))
    found = stats.cluster_share(c, "agent", "k", "n", 500)
    return found.select("share", "clusters", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""
    with {CARDS} select count(*) as calls, count(distinct agent) as agents, min(cast(call_date as date)) as first_day, max(cast(call_date as date)) as last_day,
        count(*) filter (gates_failed > 0) as capped, count(*) filter (call_date >= timestamp '1997-01-01' and call_date < timestamp '1998-01-01' and lower(call_type) = 'r') as in_scope
    from scored
""")
def coverage_counts(t: Tables) -> DataFrame:
    """What the batch covers, and what a scope filter leaves."""
    d = F.col("call_date")
    scope = (d >= F.lit("1997-01-01").cast("timestamp_ntz")) & (d < F.lit("1998-01-01").cast("timestamp_ntz")) & (F.lower("call_type") == "r")
    return cards(t).agg(
        F.count("*").alias("calls"),
        F.countDistinct("agent").alias("agents"),
        F.min(F.to_date(d)).alias("first_day"),
        F.max(F.to_date(d)).alias("last_day"),
        F.count_if(F.size("failed") > 0).alias("capped"),
        F.count_if(scope).alias("in_scope"),
    )


@query(f"""
    with {CARDS}, s as (select agent, call_id, row_number() over (partition by agent order by total, call_id) as place, total from scored)
    select agent, call_id, round(total, 6) as total from s where place = 1 order by s.total, call_id limit 3
""")
def distinct_examples(t: Tables) -> DataFrame:
    """The lowest calls, one agent each before any second."""
    rows = sequences.distinct_first(cards(t), "agent", [F.col("total"), F.col("call_id")], 3)
    return rows.select("agent", "call_id", r6("total").alias("total"))


@query(f"""
    with {LONG}, means as (select agent, avg(score) as mean from long group by 1), m as (select median(mean) as group_median from means)
    select agent, dim, count(*) as n, round(avg(score), 6) as mean, cast(min(score) as double) as least, cast(max(score) as double) as most, round(any_value(group_median), 6) as group_median from long, m group by 1, 2
""")
def streamed_dashboard(t: Tables) -> DataFrame:
    """Averages by agent and dimension and the median agent, as a stream keeps them; equal to those of one batch."""
    folder, target, point = (scratch.new_folder(t.spark, n) for n in ("scores", "figures", "checkpoint"))
    rows = long_cards(t).select("agent", "dim", F.col("score").cast("double").alias("score"))
    rows.repartition(4).write.parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    dashboard.keep_figures(stream, ["agent", "dim"], "score", target, point).awaitTermination()
    kept = dashboard.figures(t.spark, target, ["agent", "dim"])
    means = kept.groupBy("agent").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    middle = ranges.exact_quantiles(means, [], "mean", {"group_median": 0.5})
    both = kept.crossJoin(F.broadcast(middle))  # one row
    return both.select("agent", "dim", "n", r6("mean").alias("mean"), "least", "most", r6("group_median").alias("group_median"))

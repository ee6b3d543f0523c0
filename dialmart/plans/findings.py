"""Findings from the registered figures, by a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings
from ..operators.findings import Rule
from . import quality
from .registry import ORACLES, Tables, query

#: The limits are those of a management report: gates by their rate, dimensions by lost points and low scores, agents by intervals off zero.
RULES = [
    Rule("gates-clean", "calls", "risk", "positive", (("gate_rate", "=", 0),), title="no failed gates"),
    Rule("gates", "calls", "risk", "critical", (("gate_rate", ">=", 0.05),), weight="gate_rate", scale=100, title="calls fail a gate"),
    Rule("gates", "calls", "risk", "high", (("gate_rate", ">=", 0.02), ("gate_rate", "<", 0.05)), weight="gate_rate", scale=100, title="calls fail a gate"),
    Rule("gates", "calls", "risk", "medium", (("gate_rate", ">", 0), ("gate_rate", "<", 0.02)), weight="gate_rate", scale=100, title="calls fail a gate"),
    Rule("pareto", "dims", "dims", "high", (("lost_share", ">=", 0.25),), ("max", "lost_share"), "lost_share", 100, "{item} loses most points"),
    Rule("pareto", "dims", "dims", "medium", (("lost_share", ">", 0), ("lost_share", "<", 0.25)), ("max", "lost_share"), "lost_share", 100, "{item} loses most points"),
    Rule("weak", "dims", "dims", "medium", (("low_rate", ">=", 0.15),), ("min", "mean"), "low_rate", 50, "{item} is weakest"),
    Rule("strong", "dims", "dims", "positive", (("high_rate", ">=", 0.6),), ("max", "mean"), "high_rate", 10, "{item} is strongest"),
    Rule("agent-below", "agents", "agents", "high", (("high", "<", 0),), weight="diff", title="agent {item} is below the others"),
    Rule("agent-above", "agents", "agents", "positive", (("low", ">", 0),), weight="diff", title="agent {item} is above the others"),
    Rule("type-off", "types", "segments", "info", (("n", ">=", 30), ("gap", ">=", 0.2)), weight="gap", title="calls of type {item} stand off"),
    Rule("focus", "gates", "risk", "medium", (("focus_share", ">=", 0.1),), weight="focus_share", scale=100, title="failures are with few agents"),
    Rule("scope", "calls", "coverage", "info", (("in_scope", ">", 0),), weight="in_scope", scale=0.01, title="calls in scope"),
]


def facts(t: Tables) -> DataFrame:
    """All figures that the rules look at, in long form."""
    lost = quality.lost_points(t).withColumn("all_lost", F.col("lost") + F.col("lost_by_gate"))
    every = lost.agg(F.sum("all_lost").alias("every"))
    share = lost.crossJoin(F.broadcast(every)).select(F.col("dim").alias("d"), (F.col("all_lost") / F.col("every")).alias("lost_share"))  # one row
    dims = quality.dimension_stats(t).join(share, F.col("dim") == F.col("d"))
    high = (F.col("s4") + F.col("s5")) / F.col("n")
    tables = [
        findings.figures(quality.coverage_counts(t), "calls", F.lit("all"), {"gate_rate": F.col("capped") / F.col("calls"), "in_scope": "in_scope"}),
        findings.figures(dims, "dims", "dim", {"mean": "mean", "low_rate": "low_rate", "high_rate": high, "lost_share": "lost_share"}),
        findings.figures(quality.agent_flags(t), "agents", "agent", {"n": "n", "diff": "diff", "low": "low", "high": "high"}),
        findings.figures(quality.types_against_rest(t), "types", "call_type", {"n": "n", "gap": F.abs("diff")}),
        findings.figures(quality.gate_concentration(t), "gates", F.lit("all"), {"focus_share": "focus_share"}),
    ]
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def _found_sql() -> str:
    """Each rule written out by itself, over the SQL of the figures."""
    o = lambda n: f"({ORACLES[n]})"
    return f"""
    cover as materialized {o("coverage_counts")}, lost as materialized {o("lost_points")}, stats as materialized {o("dimension_stats")}, flags as materialized {o("agent_flags")},
    types as materialized {o("types_against_rest")}, focus as materialized {o("gate_concentration")}, rates as (select capped / calls as r, in_scope from cover),
    dims as (select s.*, (s4 + s5) / n as high_rate, (lost + lost_by_gate) / sum(lost + lost_by_gate) over () as share from stats s join lost using (dim)),
    found as (
        select 'risk' as section, case when r = 0 then 'positive' when r >= 0.05 then 'critical' when r >= 0.02 then 'high' else 'medium' end as severity, case when r = 0 then 'gates-clean' else 'gates' end as rule,
            'all' as item, case when r = 0 then 1 else 100 * r end as weight, case when r = 0 then 'no failed gates' else 'calls fail a gate' end as title from rates
        union all (select 'dims', case when share >= 0.25 then 'high' else 'medium' end, 'pareto', dim, 100 * share, dim || ' loses most points' from dims where share > 0 order by share desc, dim limit 1)
        union all select * from (select 'dims', 'medium', 'weak', dim, 50 * low_rate, dim || ' is weakest' from (select * from dims order by mean, dim limit 1) where low_rate >= 0.15)
        union all select * from (select 'dims', 'positive', 'strong', dim, 10 * high_rate, dim || ' is strongest' from (select * from dims order by mean desc, dim limit 1) where high_rate >= 0.6)
        union all select 'agents', 'high', 'agent-below', agent::varchar, abs(diff), 'agent ' || agent || ' is below the others' from flags where high < 0
        union all select 'agents', 'positive', 'agent-above', agent::varchar, abs(diff), 'agent ' || agent || ' is above the others' from flags where low > 0
        union all select 'segments', 'info', 'type-off', call_type, abs(diff), 'calls of type ' || call_type || ' stand off' from types where n >= 30 and abs(diff) >= 0.2
        union all select 'risk', 'medium', 'focus', 'all', 100 * focus_share, 'failures are with few agents' from focus where focus_share >= 0.1
        union all select 'coverage', 'info', 'scope', 'all', 0.01 * in_scope, 'calls in scope' from rates where in_scope > 0
    ), ranked as (select * replace (round(weight, 6) as weight), list_position({list(findings.SEVERITIES)!r}, severity) as grade from found)
    """


@query(f"""
    with {_found_sql()} select section, place::int as place, severity, rule, item, weight, title
    from (select *, row_number() over (partition by section order by grade, weight desc, rule, item) as place from ranked) where place <= 5
""")
def report_findings(t: Tables) -> DataFrame:
    """2.7, 2.12, F18: findings from figures by a table of rules, ranked with a limit for each section."""
    return findings.ranked_findings(facts(t), findings.rule_table(t.spark, RULES))


@query(f"""
    with {_found_sql()}, told as (select *, severity <> 'positive' as bad from ranked where severity <> 'info'),
    turns as (select *, row_number() over (partition by bad order by grade, weight desc, rule, item) as n from told),
    taken as (select *, row_number() over (order by (bad and n <= 4 or not bad and n = 1) desc, grade, weight desc, rule, item) as turn from turns)
    select (row_number() over (order by grade, weight desc, rule, item))::int as place, section, severity, rule, item, weight, title from taken where turn <= 5
""")
def summary_findings(t: Tables) -> DataFrame:
    """2.7: four problems and the strongest good news for a summary."""
    return findings.summary(facts(t), findings.rule_table(t.spark, RULES))

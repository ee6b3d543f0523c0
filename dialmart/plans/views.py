"""Views of calls within a budget, and topics by a phrase table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import views
from .registry import Tables, query

#: Phrases of several words under topics; any number of rows would do.
PHRASES = [
    ("link", "of the"), ("link", "de la"), ("link", "in the"), ("link", "und die"), ("link", "de los"), ("link", "et le"), ("place", "in the"), ("place", "en la"), ("place", "in der"), ("place", "dans le"),
    ("stop", "that"), ("stop", "pas"), ("stop", "nicht"), ("stop", "con"), ("long", "of the and"), ("long", "de la que"),
]
BUDGET = 1800
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PHRASES)

LINES = f"""
    phrases(topic, phrase) as (values {_VALUES}), said as (
        select conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) as text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as part from conversations
    ), lines as (
        select conv_id, row_number() over (partition by conv_id order by turn, part) as n, role, text,
            ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pM\\p{{Nd}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ' as folded from said
    )
"""


def lines(t: Tables) -> DataFrame:
    """conv_id, n (from 1), role and text of every line of the calls."""
    parts = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("part", "text"))
    return parts.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part")).alias("n"), "role", "text")


def phrases(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(PHRASES, "topic string, phrase string")


def _shown() -> F.Column:
    return F.concat(F.lit("L"), F.col("n").cast("string"), F.lit(" ["), F.col("role"), F.lit("] "), F.col("text"))


@query(f"""
    with {LINES}, counted as (
        select conv_id, topic, len(list_filter(range(length(folded)), lambda i: substr(folded, i + 1, length(phrase) + 2) = ' ' || phrase || ' ')) as n
        from lines, phrases where contains(folded, ' ' || phrase || ' ')
    ) select conv_id, topic, sum(n)::bigint as votes from counted group by 1, 2 having sum(n) > 0
""")
def topic_votes(t: Tables) -> DataFrame:
    """How often each topic's phrases stand in a call, by a join of word runs with a phrase table."""
    folded = lines(t).select("conv_id", F.col("n").alias("line"), F.lower("text").alias("text"))
    found = views.phrase_hits(folded, ["conv_id", "line"], "text", phrases(t))
    return found.groupBy("conv_id", "topic").agg(F.sum("n").alias("votes"))


@query(f"""
    with {LINES}, sized as (
        select l.*, 'L' || n || ' [' || role || '] ' || text as line, length('L' || n || ' [' || role || '] ' || text) + 1 as size, count(*) over (partition by conv_id) as n_all,
            exists (select 1 from phrases p where topic = 'link' and contains(l.folded, ' ' || p.phrase || ' ')) as says from lines l
    ), parted as (select *, n <= 6 or n > n_all - 6 as at_end, sum(size) over (partition by conv_id) as whole from sized
    ), cues as (select conv_id, n as cue, row_number() over (partition by conv_id order by n) as k from parted where says and not at_end
    ), owned as (select p.conv_id, p.n, min(cue) as cue from parted p join cues c on c.conv_id = p.conv_id and abs(p.n - c.cue) <= 2 where not at_end group by 1, 2
    ), costs as (select c.conv_id, c.cue, k, 32 + coalesce(sum(size), 0) as cost from cues c left join owned o using (conv_id, cue) left join parted p on p.conv_id = o.conv_id and p.n = o.n group by 1, 2, 3
    ), spent as (
        select conv_id, cue, sum(cost) over (partition by conv_id order by k) + 32 + (select sum(size) from parted p where p.conv_id = c.conv_id and at_end) as spent from costs c
    ), kept as (
        select p.* from parted p left join owned o using (conv_id, n) left join spent s on s.conv_id = p.conv_id and s.cue = o.cue
        where whole <= {BUDGET} or n_all <= 12 or at_end or spent <= {BUDGET}
    ), gaps as (
        select *, n - coalesce(lag(n) over (partition by conv_id order by n), 0) - 1 as before, case when lead(n) over (partition by conv_id order by n) is null then n_all - n else 0 end as after from kept
    ) select conv_id, count(*) as lines, md5(string_agg(case when before > 0 then '[... ' || before || ' lines left out ...]' || chr(10) else '' end || line
        || case when after > 0 then chr(10) || '[... ' || after || ' lines left out ...]' else '' end, chr(10) order by n)) as view_md5 from gaps group by 1
""")
def budgeted_views(t: Tables) -> DataFrame:
    """Calls within a budget: both ends, and what stands around cues in order while it fits."""
    rows = lines(t)
    folded = rows.select("conv_id", F.col("n").alias("line"), F.lower("text").alias("text"))
    cues = views.phrase_hits(folded, ["conv_id", "line"], "text", phrases(t).where("topic = 'link'")).select("conv_id", F.col("line").alias("n"), F.lit(True).alias("cue"))
    marked = rows.join(cues, ["conv_id", "n"], "left").withColumn("line", _shown()).withColumn("size", F.length("line") + 1)
    view = views.rendered(views.budgeted(marked, ["conv_id"], "n", "size", "cue", BUDGET), ["conv_id"], "n", "line")
    return view.select("conv_id", "lines", F.md5(F.encode("text", "UTF-8")).alias("view_md5"))


@query(f"""
    with {LINES}, shown as (select conv_id, n, 'L' || n || ' [' || role || '] ' || text as line from lines), room as (select {BUDGET} - {len(views.ELISION)} - 2 as room),
    sums as (select *, sum(length(line) + 1) over (partition by conv_id) - 1 as whole, sum(length(line) + 1) over (partition by conv_id order by n) as upto,
        sum(length(line) + 1) over (partition by conv_id order by n desc) as back from shown),
    parts as (select *, case when whole <= {BUDGET} or upto <= room * 2 // 3 then 'a' when back <= room - room * 2 // 3 then 'b' end as part from sums, room),
    texts as (select conv_id, string_agg(line, chr(10) order by n) filter (part = 'a') as a, string_agg(line, chr(10) order by n) filter (part = 'b') as b from parts group by 1)
    select conv_id, md5(coalesce(a || case when b is not null then chr(10) else '' end, '') || coalesce('{views.ELISION}' || chr(10) || b, '')) as view_md5,
        coalesce(length(a), 0) + coalesce(length(b), 0) <= {BUDGET} as fits from texts
""")
def elided_views(t: Tables) -> DataFrame:
    """Calls within a budget: the opening and the closing around a mark."""
    view = views.elided(lines(t).withColumn("line", _shown()), ["conv_id"], "n", "line", BUDGET)
    return view.select("conv_id", F.md5(F.encode("text", "UTF-8")).alias("view_md5"), (F.length("text") <= BUDGET).alias("fits"))

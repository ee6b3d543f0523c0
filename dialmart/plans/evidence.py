"""Evidence: quotes of turns, as a judge gives them, held against what was said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alignment
from .registry import Tables, query, r6

#: Letters with marks, and what they are without them, so that both engines count the same letters.
MARKED, BARE = "éèêëàâäáçñöóôòüúûùîïíìß", "eeeeaaaacnoooouuuuiiiis"
NO = ("pas", "nicht", "not", "no", "sin", "ohne")
_NO = ", ".join(f"'{w}'" for w in NO)

#: A quote for each turn: words 3 to 10, as they are, with one letter less, with a number or a negation put in, or of the turn before.
QUOTES = f"""
    said as (
        select conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{Nd}}]', '', 'g') <> '') as words from
            (select conv_id, turn, translate(lower(text), '{MARKED}', '{BARE}') as text from conversations)
    ), turns as (
        select *, coalesce(lag(words) over (partition by conv_id order by turn), []) as earlier, conv_id * 1000 + turn as quote_id from said
    ), quotes as (
        select quote_id, conv_id, turn, array_to_string(case (conv_id + turn) % 5
            when 0 then words[3:10] when 1 then words[3:5] || [words[6][:-2]] || words[7:10] when 2 then words[3:6] || ['90'] || words[7:10]
            when 3 then words[3:6] || ['not'] || words[7:10] else earlier[3:10] end, ' ') as quote from turns
    )
"""


def quotes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The quotes (quote_id, conv_id, turn, quote) and the lines (conv_id, turn, line, text) that they are of."""
    rows = t.conversations.select("conv_id", "turn", F.translate(F.lower("text"), MARKED, BARE).alias("text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: alignment.plain_word(w) != "")
    said = rows.select("conv_id", "turn", words.alias("words"))
    earlier = F.coalesce(F.lag("words").over(Window.partitionBy("conv_id").orderBy("turn")), F.array().cast("array<string>"))
    some = lambda c, lo, hi: F.slice(c, lo, hi - lo + 1)
    sixth = F.get("words", F.lit(5))
    short = F.coalesce(F.substr(sixth, F.lit(1), F.greatest(F.length(sixth) - 1, F.lit(0))), F.lit(None))
    put = lambda word: F.concat(some("words", 3, 6), F.array(F.lit(word)), some("words", 7, 10))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    quote = (
        F.when(kind == 0, some("words", 3, 10))
        .when(kind == 1, F.concat(some("words", 3, 5), F.filter(F.array(short), lambda w: w.isNotNull()), some("words", 7, 10)))
        .when(kind == 2, put("90"))
        .when(kind == 3, put("not"))
        .otherwise(some("earlier", 3, 10))
    )
    made = said.withColumn("earlier", earlier).select((F.col("conv_id") * 1000 + F.col("turn")).alias("quote_id"), "conv_id", "turn", F.array_join(quote, " ").alias("quote"))
    lines = rows.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return made, lines


_NORM = "regexp_replace(w, '[^\\p{L}\\p{Nd}]', '', 'g')"

#: Every window of every line of the quoted turn, of about the quote's length; no seeds.
VERDICTS = f"""
    lines as (
        select conv_id, turn, i - 1 as line, list_filter(string_split_regex(parts[i], '\\s+'), lambda w: {_NORM} <> '') as raw
        from (select conv_id, turn, string_split(translate(lower(text), '{MARKED}', '{BARE}'), chr(10)) as parts from conversations), unnest(range(1, len(parts) + 1)) as u(i)
    ), normed as (
        select *, list_transform(raw, lambda w: {_NORM}) as norms from lines
    ), asked as (
        select *, list_filter(list_transform(string_split(quote, ' '), lambda w: {_NORM}), lambda w: w <> '') as want from quotes
    ), windows as (
        select quote_id, a.want, line, raw, norms, s as pos, k as size, array_to_string(want, ' ') as whole, array_to_string(norms[s + 1:s + k], ' ') as span
        from asked a join normed l using (conv_id, turn), unnest(range(0, len(norms))) as x(s), unnest(range(greatest(len(want) - 2, 1), len(want) + 3)) as y(k)
        where s + k <= len(norms) and length(array_to_string(want, ' ')) >= 8
    ), rated as (
        select *, 1 - levenshtein(span, whole) / greatest(length(span), length(whole)) as similarity from windows
        where abs(length(span) - length(whole)) <= floor(greatest(length(span), length(whole)) * 0.1 + 1e-9)
    ), best as (
        select * from (select *, row_number() over (partition by quote_id order by similarity desc, line, pos, size) as r from rated
            where levenshtein(span, whole) <= floor(greatest(length(span), length(whole)) * 0.1 + 1e-9)) where r = 1
    ), told as (
        select *, case when span = whole then 'verbatim' when regexp_extract_all(span, '[0-9]+') = regexp_extract_all(whole, '[0-9]+')
                and list_sort(list_filter(norms[pos + 1:pos + size], lambda w: w in ({_NO}))) = list_sort(list_filter(want, lambda w: w in ({_NO}))) then 'near' else 'changed' end as verdict,
            case when pos >= 1 and norms[pos] in ({_NO}) then pos - 1 when pos >= 2 and norms[pos - 1] in ({_NO}) then pos - 2 else pos end as place
        from best
    ), verdicts as (
        select a.quote_id, coalesce(verdict, case when length(array_to_string(a.want, ' ')) < 8 then 'short' else 'absent' end) as verdict,
            case when verdict <> 'changed' then line end as line, case when verdict <> 'changed' then place end as place,
            case when verdict <> 'changed' then array_to_string(raw[place + 1:pos + size], ' ') end as said, case when verdict <> 'changed' then round(similarity, 6) end as similarity
        from asked a left join told using (quote_id)
    )
"""


def verdicts(t: Tables) -> DataFrame:
    asked, lines = quotes(t)
    return alignment.verified_quotes(asked, lines, "quote_id", ["conv_id", "turn"], ["line"], polarity=NO, negations=NO)


@query(f"with {QUOTES}, {VERDICTS} select quote_id, verdict, cast(line as int) as line, cast(place as int) as place, said, similarity from verdicts")
def verified_evidence(t: Tables) -> DataFrame:
    """What of the quoted turn a quote is, with its line and place, or why it is refused."""
    return verdicts(t).withColumn("similarity", r6("similarity"))


@query(f"""
    with {QUOTES}, {VERDICTS} select turn % 10 as dimension, count(*) as quotes, count(*) filter (verdict in ('verbatim', 'near')) as accepted,
        count(*) filter (verdict = 'changed') as changed, count(*) filter (verdict = 'absent') as absent, count(*) filter (verdict = 'short') as short
    from verdicts join quotes using (quote_id) group by 1
""")
def evidence_problems(t: Tables) -> DataFrame:
    """How many quotes of each dimension are accepted, and why the others are not."""
    asked, _ = quotes(t)
    told = asked.join(verdicts(t).hint("merge"), "quote_id").groupBy((F.col("turn") % 10).alias("dimension"))
    n = lambda *kinds: F.count_if(F.col("verdict").isin(*kinds))
    return told.agg(F.count("*").alias("quotes"), n("verbatim", "near").alias("accepted"), n("changed").alias("changed"), n("absent").alias("absent"), n("short").alias("short"))

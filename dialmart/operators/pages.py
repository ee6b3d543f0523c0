"""Pages of a journey report: a row for each session, each contact and each account, and the fifteen numbers above them.

Sessions and contacts of an account are one line of time; what stands before or after a row in it (the contact
that a session came from, the session or contact that follows) are windows over that line, not pairings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import exact_quantiles

#: Cases from which a figure is shown, and from which it is firm.
SHOWN = 10
FIRM = 30
BRANCHES = ("own", "other")


def minutes(lo: str, hi: str) -> Column:
    return F.timestamp_diff("MICROSECOND", lo, hi) / 6e7


def session_rows(sessions: DataFrame, contacts: DataFrame) -> DataFrame:
    """sessions (account, session_no, first_at, last_at, ops, executes, banker, unit, unit_class, contact_id) with what a page shows of each.

    Adds no (by time from 1), minutes, contact_n (the number of the contact that it came from, from 1), background (it came from
    none), hand_off (the class of unit differs from the session before) and after_last (it begins after the last contact).
    contacts has account, contact_id and contact_at.
    """
    numbered = contacts.select("account", "contact_id", F.row_number().over(Window.partitionBy("account").orderBy("contact_at", "contact_id")).cast("long").alias("contact_n"))
    last = contacts.groupBy("account").agg(F.max("contact_at").alias("_last"))
    line = Window.partitionBy("account").orderBy("first_at", "session_no")
    rows = sessions.join(numbered, ["account", "contact_id"], "left").join(last, "account", "left")
    moved = F.coalesce(F.col("unit_class") != F.lag("unit_class").over(line), F.lit(False))
    return rows.select(
        "account", F.row_number().over(line).cast("long").alias("no"), "session_no", "first_at", "last_at", minutes("first_at", "last_at").alias("minutes"), "banker", "unit", "unit_class",
        "executes", "ops", "contact_n", "contact_id", F.col("contact_id").isNull().alias("background"), moved.alias("hand_off"),
        F.coalesce(F.col("first_at") > F.col("_last"), F.lit(False)).alias("after_last"),
    )


def contact_rows(contacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """contacts (account, contact_id, contact_at, inbound, abandoned) with n, the sums of the sessions behind each, and what came next.

    sessions are session_rows().  resp_hours, of inbound and abandoned contacts, are until the first session at or after; first_move, of
    abandoned ones, is who acted first after it: the bank (a session), the customer (another contact), on equal times the bank, or none.
    """
    behind = sessions.where("contact_id is not null").groupBy("account", "contact_id").agg(
        F.count("*").alias("n_sess"), F.sum("minutes").alias("banker_min"), F.sum("ops").alias("n_ops"), F.count_distinct("banker").alias("n_bankers"),
        F.bool_or("executes").alias("has_execute"), F.bool_or(F.col("unit_class").isin(*BRANCHES)).alias("has_branch"), F.bool_or(F.col("unit_class") == "center").alias("has_center"),
        F.array_sort(F.collect_list("session_no")).alias("session_nos"),
    )
    order = Window.partitionBy("account").orderBy("contact_at", "contact_id")
    rows = contacts.select("account", "contact_id", "contact_at", "inbound", "abandoned", F.row_number().over(order).cast("long").alias("n"), F.lead("contact_at").over(order).alias("_next"))
    both = rows.select("account", F.col("contact_at").alias("at"), F.lit(0).alias("is_session"), F.struct(*rows.columns).alias("c"))
    both = both.unionByName(sessions.select("account", F.col("first_at").alias("at"), F.lit(1).alias("is_session")), allowMissingColumns=True)
    # read backwards, the last session seen is the next one; a session at the contact's own time follows it
    back = Window.partitionBy("account").orderBy(F.desc("at"), F.desc("is_session")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_then", F.last(F.when(F.col("is_session") == 1, F.col("at")), True).over(back)).where("is_session = 0").select("c.*", "_then")
    waits = F.col("inbound") | F.col("abandoned")
    first = F.when(F.col("_then").isNotNull() & (F.col("_next").isNull() | (F.col("_then") <= F.col("_next"))), "bank").when(F.col("_next").isNotNull(), "customer").otherwise("none")
    found = seen.join(behind, ["account", "contact_id"], "left")
    zero = lambda c, t: F.coalesce(c, F.lit(0).cast(t)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return found.select(
        "account", "n", "contact_id", "contact_at", "inbound", "abandoned", zero("n_sess", "long"), zero("banker_min", "double"), zero("n_ops", "long"), zero("n_bankers", "long"),
        no("has_execute"), no("has_branch"), no("has_center"), F.coalesce("session_nos", F.array().cast("array<long>")).alias("session_nos"),
        F.when(waits, F.timestamp_diff("MICROSECOND", "contact_at", "_then") / 3.6e9).alias("resp_hours"), F.when(F.col("abandoned"), first).alias("first_move"),
    )


def account_rows(sessions: DataFrame, contacts: DataFrame) -> DataFrame:
    """One row for each account with contacts: what its sessions (session_rows()) add up to, around its contacts (contact_rows())."""
    c = contacts.groupBy("account").agg(
        F.count("*").alias("contacts"), (F.count("*") - 1).alias("returns"), F.min("contact_at").alias("first_at"), F.max("contact_at").alias("last_at"),
        F.count_if("abandoned").alias("abandoned"), F.count_if("inbound").alias("inbound"),
    )
    day = contacts.groupBy("account", F.to_date("contact_at").alias("d")).agg(F.count("*").alias("k")).groupBy("account").agg(F.max("k").alias("max_same_day"))
    of = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0.0))
    s = sessions.groupBy("account").agg(
        F.count("*").alias("sessions"), F.count_distinct("banker").alias("bankers"), F.count_distinct("unit").alias("units"), F.array_sort(F.collect_set("unit_class")).alias("unit_kinds"),
        F.count_if("hand_off").alias("crossings"), (F.bool_or(F.col("unit_class") == "center") & F.bool_or(F.col("unit_class").isin(*BRANCHES))).alias("crossed"),
        F.sum("minutes").alias("banker_minutes"), of(F.col("background"), F.col("minutes")).alias("background_minutes"), F.count_if("background").alias("background_sessions"),
        F.count_if(F.col("background") & F.col("unit_class").isin(*BRANCHES)).alias("background_branch"), F.count_if(~F.col("executes")).alias("no_execute_sessions"),
        F.bool_or(F.col("executes") & F.col("after_last")).alias("execute_after_last"), F.min(F.when(F.col("executes"), F.col("first_at"))).alias("_first_execute"),
    )
    rows = c.join(day, "account").join(s, "account", "left")
    zero = {x: F.coalesce(x, F.lit(0)) for x in ("sessions", "bankers", "units", "crossings", "background_sessions", "background_branch", "no_execute_sessions")}
    zero |= {x: F.coalesce(x, F.lit(0.0)) for x in ("banker_minutes", "background_minutes")} | {x: F.coalesce(x, F.lit(False)) for x in ("crossed", "execute_after_last")}
    rows = rows.withColumns(zero | {"unit_kinds": F.coalesce("unit_kinds", F.array().cast("array<string>"))})
    span = F.timestamp_diff("MICROSECOND", "first_at", "last_at") / 8.64e10
    return rows.withColumns({"span_days": span, "hours_to_execute": F.timestamp_diff("MICROSECOND", "first_at", "_first_execute") / 3.6e9}).drop("_first_execute")


def fifteen_numbers(accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """item, key, first, second and third (values), n (the base), shown and preliminary: the page of numbers, each on its own base.

    Shares are of the base, medians exact; a share on a base below SHOWN is null.
    """
    act = accounts.where("sessions > 0")
    n = F.count("*").cast("double")
    count = lambda cond: F.count_if(cond).cast("double")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    a = act.agg(
        n.alias("n"), F.avg("bankers").alias("bankers"), count(F.col("bankers") >= 3).alias("three"), count(F.col("crossed")).alias("crossed"), F.avg("crossings").alias("crossings"),
        F.avg("banker_minutes").alias("minutes"), total("banker_minutes").alias("all_minutes"), total("background_minutes").alias("background"), total("background_sessions").alias("n_bg"),
        total("background_branch").alias("bg_branch"), total("sessions").alias("n_sess"), total("no_execute_sessions").alias("nodo"), count(F.col("execute_after_last")).alias("after"),
        count(F.col("hours_to_execute").isNotNull()).alias("n_hours"), count(F.col("execute_after_last") & (F.col("returns") > 0)).alias("returned_after"), count(F.col("returns") > 0).alias("n_returned"),
    )
    every = accounts.agg(n.alias("n_all"))
    c = contacts.agg(
        count(F.col("inbound")).alias("talk"), count(F.col("inbound") & (F.col("n_sess") > 0)).alias("talk_sess"), count(F.col("inbound") & F.col("has_execute")).alias("talk_do"),
        count(F.col("inbound") & F.col("has_branch")).alias("talk_branch"), *[count(F.col("first_move") == m).alias(f"ab_{m}") for m in ("bank", "customer", "none")],
        n.alias("n_contacts"), count(F.col("n_sess") > 1).alias("several"),
    )
    mid = lambda df, col, name: exact_quantiles(df, [], col, {name: 0.5})
    bank = contacts.where("first_move = 'bank'")
    one = a
    for other in (every, c, mid(act, "bankers", "mid_bankers"), mid(act, "banker_minutes", "mid_minutes"), mid(bank, "resp_hours", "mid_bank"), mid(act, "hours_to_execute", "mid_execute")):
        one = one.crossJoin(F.broadcast(other))  # one row each
    x = F.col
    share = lambda k, base: F.when(x(base) >= SHOWN, x(k) / x(base))
    none = F.lit(None).cast("double")
    ab = x("ab_bank") + x("ab_customer") + x("ab_none")
    lines = [
        ("covered", x("n_all"), x("n"), none, x("n_all")),
        ("bankers", x("bankers"), x("mid_bankers"), none, x("n")),
        ("three_bankers", share("three", "n"), none, none, x("n")),
        ("cross", share("crossed", "n"), x("crossings"), none, x("n")),
        ("minutes", x("minutes"), x("mid_minutes"), none, x("n")),
        ("background_minutes", F.when((x("all_minutes") > 0) & (x("n") >= SHOWN), x("background") / x("all_minutes")), none, none, x("n")),
        ("background_branch", share("bg_branch", "n_bg"), none, none, x("n_bg")),
        ("no_execute", share("nodo", "n_sess"), none, none, x("n_sess")),
        ("talk", x("talk_sess"), x("talk_do"), x("talk_branch"), x("talk")),
        ("after_abandon", x("ab_bank"), x("ab_customer"), x("ab_none"), ab),
        ("bank_hours", x("mid_bank"), none, none, x("ab_bank")),
        ("execute_after_last", share("after", "n"), none, none, x("n")),
        ("returned_execute", x("returned_after"), x("n_returned"), none, x("n_returned")),
        ("hours_to_execute", x("mid_execute"), none, none, x("n_hours")),
        ("several_sessions", x("several"), none, none, x("n_contacts")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("item"), F.lit(key).alias("key"), v1.cast("double").alias("first"), v2.cast("double").alias("second"), v3.cast("double").alias("third"), b.cast("long").alias("n"))
            for i, (key, v1, v2, v3, b) in enumerate(lines)
        ]
    )
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumns({"shown": F.col("n") >= SHOWN, "preliminary": (F.col("n") > 0) & (F.col("n") < FIRM)})

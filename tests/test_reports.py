"""Views within a budget, phrases, findings, pages and silences, against rules written out by hand."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dialmart.operators import findings, matching, pages, silences, views
from dialmart.operators.findings import Rule


def brute_budget(sizes, cues, most, head, tail, around):
    """Both ends, then windows around cues one by one while they fit."""
    n = len(sizes)
    if sum(sizes) <= most or n <= head + tail:
        return set(range(1, n + 1))
    kept, used = set(), 0
    for window in [[*range(1, head + 1), *range(n - tail + 1, n + 1)]] + [[*range(max(1, c - around), min(n, c + around) + 1)] for c in cues if head < c <= n - tail]:
        new = [x for x in window if x not in kept]
        cost = sum(sizes[x - 1] for x in new) + views.GAP
        if kept and used + cost > most:
            break
        kept.update(new)
        used += cost
    return kept


def test_budgeted_views(spark):
    rng = random.Random(4)
    calls = {c: [(rng.randint(5, 60), rng.random() < 0.25) for _ in range(rng.randint(1, 40))] for c in range(40)}
    df = spark.createDataFrame([(c, i + 1, s, q or None) for c, rows in calls.items() for i, (s, q) in enumerate(rows)], "c int, n int, s int, q boolean").repartition(3)
    for most, head, tail, around in ((400, 3, 3, 2), (250, 2, 4, 1), (10**6, 3, 3, 2)):
        got = {}
        for r in views.budgeted(df, ["c"], "n", "s", "q", most, head, tail, around).where("kept").collect():
            got.setdefault(r.c, set()).add(r.n)
        want = {c: brute_budget([s for s, _ in rows], [i + 1 for i, (_, q) in enumerate(rows) if q], most, head, tail, around) for c, rows in calls.items()}
        assert got == want
    assert views.budgeted(df.limit(0), ["c"], "n", "s", "q", 100).count() == 0


def test_rendered_gaps(spark):
    df = spark.createDataFrame([(1, i, f"L{i}", i in (2, 3, 6)) for i in range(1, 9)], "c int, n int, line string, kept boolean")
    assert views.rendered(df, ["c"], "n", "line").first().text.split("\n") == ["[... 1 lines left out ...]", "L2", "L3", "[... 2 lines left out ...]", "L6", "[... 2 lines left out ...]"]


def test_elided_views(spark):
    rng = random.Random(5)
    calls = {c: ["x" * rng.randint(1, 40) for _ in range(rng.randint(1, 25))] for c in range(30)}
    df = spark.createDataFrame([(c, i, x) for c, rows in calls.items() for i, x in enumerate(rows)], "c int, n int, line string")
    most = 220
    got = {r.c: r.text for r in views.elided(df, ["c"], "n", "line", most).collect()}
    for c, rows in calls.items():
        whole = "\n".join(rows)
        if len(whole) <= most:
            assert got[c] == whole
            continue
        room = most - len(views.ELISION) - 2
        head, tail, used = [], [], 0
        for x in rows:
            if used + len(x) + 1 > room * 2 // 3:
                break
            head.append(x)
            used += len(x) + 1
        used = 0
        for x in reversed(rows[len(head) :]):
            if used + len(x) + 1 > room - room * 2 // 3:
                break
            tail.insert(0, x)
            used += len(x) + 1
        assert got[c] == "\n".join([*head, *([views.ELISION, *tail] if tail else [])]) and len(got[c]) <= most


def test_phrases_of_any_length(spark):
    df = spark.createDataFrame([(1, "Of the, of THE of the"), (2, None), (3, "שָׁלוֹם עולם! the of")], "i int, text string")
    phrases = spark.createDataFrame([("a", "of the"), ("a", " of  the "), ("b", "the of the"), ("c", "שלום עולם"), ("d", "")], "topic string, phrase string")
    low = df.withColumn("text", F.lower("text"))
    assert sorted(tuple(r) for r in views.phrase_hits(low, ["i"], "text", phrases).collect()) == [(1, "a", 3), (1, "b", 2), (3, "c", 1)]
    assert views.phrase_hits(low, ["i"], "text", phrases.limit(0)).count() == 0


def test_findings_by_rules(spark):
    facts = findings.figures(spark.createDataFrame([("x", 1.0, 5), ("y", 3.0, None), ("z", 3.0, 9)], "k string, a double, b int"), "t", "k", {"a": "a", "b": "b"})
    rules = [
        Rule("big", "t", "s1", "high", (("a", ">=", 2),), weight="a", scale=2),
        Rule("top", "t", "s1", "positive", (), ("max", "a")),
        Rule("low", "t", "s2", "info", (("b", "<", 6),), ("min", "b"), "b", title="{item} is low"),
        Rule("unknown", "t", "s2", "critical", (("c", "<", 6),)),
        Rule("not-met", "t", "s2", "critical", (("a", ">", 2),), ("min", "a")),
    ]
    table = findings.rule_table(spark, rules)
    got = [tuple(r) for r in findings.ranked_findings(facts, table, 2).orderBy("section", "place").collect()]
    assert got == [("s1", 1, "high", "big", "y", 6.0, "y"), ("s1", 2, "high", "big", "z", 6.0, "z"), ("s2", 1, "info", "low", "x", 5.0, "x is low")]
    assert [(r.place, r.rule, r.item) for r in findings.summary(facts, table).orderBy("place").collect()] == [(1, "big", "y"), (2, "big", "z"), (3, "top", "y")]
    with pytest.raises(ValueError):
        findings.rule_table(spark, [Rule("x", "t", "s", "grave")])
    assert findings.ranked_findings(facts.limit(0), table).count() == 0


T0 = datetime(2026, 1, 1)


def at(minute):
    return T0 + timedelta(minutes=minute)


def test_pages(spark):
    contacts = spark.createDataFrame([(1, 10, at(0), True, False), (1, 11, at(60), False, True), (1, 12, at(90), True, False), (2, 20, at(5), False, True)], "account int, contact_id int, contact_at timestamp, inbound boolean, abandoned boolean")
    sessions = spark.createDataFrame(
        [(1, 1, at(0), at(4), 3, True, "B1", 0, "center", 10), (1, 2, at(70), at(71), 2, False, "B2", 1, "own", None), (1, 3, at(100), at(101), 1, True, "B2", 1, "own", 12), (3, 1, at(0), at(1), 1, False, "B1", 0, "center", None)],
        "account int, session_no long, first_at timestamp, last_at timestamp, ops long, executes boolean, banker string, unit int, unit_class string, contact_id int",
    )
    s = pages.session_rows(sessions, contacts)
    assert [(r.no, r.minutes, r.contact_n, r.background, r.hand_off, r.after_last) for r in s.where("account = 1").orderBy("no").collect()] == [(1, 4.0, 1, False, False, False), (2, 1.0, None, True, True, False), (3, 1.0, 3, False, False, True)]
    c = pages.contact_rows(contacts, s)
    got = {r.contact_id: (r.n, r.n_sess, r.has_center, r.session_nos, r.resp_hours, r.first_move) for r in c.collect()}
    assert got == {10: (1, 1, True, [1], 0.0, None), 11: (2, 0, False, [], pytest.approx(1 / 6), "bank"), 12: (3, 1, False, [3], pytest.approx(1 / 6), None), 20: (1, 0, False, [], None, "none")}
    a = {r.account: r for r in pages.account_rows(s, c).collect()}
    assert set(a) == {1, 2} and (a[1].crossings, a[1].crossed, a[1].background_minutes, a[1].execute_after_last, a[1].hours_to_execute) == (1, True, 1.0, True, 0.0)
    assert (a[2].sessions, a[2].unit_kinds, a[2].banker_minutes) == (0, [], 0.0)
    numbers = {r.key: r for r in pages.fifteen_numbers(pages.account_rows(s, c), c).collect()}
    assert len(numbers) == 15 and (numbers["covered"].first, numbers["covered"].second, numbers["covered"].shown) == (2.0, 1.0, False)
    assert (numbers["after_abandon"].first, numbers["after_abandon"].third, numbers["after_abandon"].n) == (1.0, 1.0, 2) and numbers["cross"].first is None


def test_known_contacts_come_first(spark):
    left = spark.createDataFrame([(1, 1, at(10), 7), (1, 2, at(10), 9), (1, 3, at(500), None)], "k int, row int, at timestamp, told int")
    points = spark.createDataFrame([(1, 7, at(400), at(390), at(410)), (1, 8, at(12), at(0), at(20)), (2, 9, at(10), at(0), at(20))], "k int, id int, point_at timestamp, lo timestamp, hi timestamp")
    got = matching.attach_known_or_nearest(left, points, ["k"], "row", "told", "at", "lo", "hi", "point_at", "id")
    assert sorted((r.row, r.id, r.by_id) for r in got.collect()) == [(1, 7, True), (2, 8, False), (3, None, False)]


def test_silences(spark):
    turns = spark.createDataFrame([("c", 0, "my id is 123456782 yes", 0.0, 10.0), ("c", 1, "mail a@b.com", 20.0, 30.0), ("c", 2, None, 40.0, 41.0), ("d", 0, "nothing", 0.0, 1.0)], "c string, turn int, text string, start_s double, end_s double")
    words = spark.createDataFrame([("c", 0, i, float(i), i + 0.5) for i in range(5)], "c string, turn int, word int, t0 double, t1 double")
    got = [(r.c, round(r.begin_s, 2), round(r.end_s, 2)) for r in silences.masked_times(turns, words, ["c"]).orderBy("begin_s").collect()]
    assert got == [("c", 2.85, 3.65), ("c", 19.85, 30.15)]  # the address has no timed words, so its turn is silent


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    from dialmart.sources import scratch

    assert scratch.new_folder(spark, "x").rpartition("/")[0] == scratch.new_folder(spark, "y").rpartition("/")[0]
    monkeypatch.setattr(scratch, "_own_folder", lambda spark: f"file://{tmp_path}/own")
    assert scratch.written(spark.range(3), "x").count() == 3
    assert list(tmp_path.rglob("*.parquet"))
    scratch.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))
    scratch.clear(spark)  # nothing to delete is no error

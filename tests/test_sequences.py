"""Ordered-log operators and interval joins on hand-made rows with known results."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dialmart.operators import matching, scores, sequences

T0 = datetime(2026, 7, 5, 10, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def sessions_of(spark, rows, changed=("banker",)):
    data = [("a", i, at(m), op, b) for i, (m, op, b) in enumerate(rows)]
    df = spark.createDataFrame(data, "account string, n int, at timestamp_ntz, op string, banker string")
    found = sequences.sessionise(df, ["account"], "at", ["at", "n"], 30, list(changed), F.col("op") == "201")
    out = {}
    for r in found.orderBy("n").collect():
        out.setdefault(r.session_no, []).append(r.n)
    return list(out.values())


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(0, "201", "B"), (10, "", "B"), (40, "", "B"), (70.5, "", "B")], [[0, 1, 2], [3]]),
        ([(0, "201", "B"), (1, "", "B"), (2, "201", "B"), (3, "", "B")], [[0, 1], [2, 3]]),
        ([(0, "", "B1"), (1, "", "B2"), (2, "", "B1")], [[0], [1], [2]]),
        ([(0, "", "B1"), (0, "", "B2"), (1, "", "B2")], [[0], [1, 2]]),
        ([(0, "", "B2"), (0, "", "B1"), (1, "", "B2")], [[0], [1], [2]]),
    ],
)
def test_sessionise(spark, rows, want):
    assert sessions_of(spark, rows) == want


def test_attach_nearest(spark):
    points = [("s", 0, at(30), at(40), at(62)), ("s", 1, at(290), at(300), at(340)), ("s", 2, at(580), at(600), at(630))]
    p = spark.createDataFrame(points, "k string, c int, lo timestamp_ntz, pat timestamp_ntz, hi timestamp_ntz")
    starts = [(29, None), (30, 0), (40, 0), (62, 0), (63, None), (300, 1), (340, 1), (341, None), (580, 2), (630, 2), (631, None)]
    s = spark.createDataFrame([("s", i, at(m)) for i, (m, _) in enumerate(starts)], "k string, i int, at timestamp_ntz")
    got = matching.attach_nearest(s, p, ["k"], "i", "at", "lo", "hi", "pat", "c").orderBy("i").collect()
    assert [r.c for r in got] == [w for _, w in starts]


def test_attach_tie_goes_to_the_earlier(spark):
    p = spark.createDataFrame([("s", 0, at(-60), at(0), at(60)), ("s", 1, at(-40), at(20), at(80))], "k string, c int, lo timestamp_ntz, pat timestamp_ntz, hi timestamp_ntz")
    s = spark.createDataFrame([("s", 0, at(10)), ("s", 1, at(16))], "k string, i int, at timestamp_ntz")
    got = matching.attach_nearest(s, p, ["k"], "i", "at", "lo", "hi", "pat", "c").orderBy("i").collect()
    assert [r.c for r in got] == [0, 1]


def test_next_after_strict_and_not(spark):
    rows = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(10)), ("b", 3, at(0))], "k string, i int, at timestamp_ntz")
    events = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("a", at(12))], "k string, e timestamp_ntz")
    got = {r.i: r.next_at for r in matching.next_after(rows, events, ["k"], "at", "e").collect()}
    assert got == {1: at(10), 2: at(12), 3: None}
    got = {r.i: r.next_at for r in matching.next_after(rows, events, ["k"], "at", "e", True).collect()}
    assert got == {1: at(0), 2: at(10), 3: None}


AGENT = [(0.0, 10.0), (11.0, 20.0), (30.0, 40.0)]
CUSTOMER = [(10.2, 10.8), (20.0, 25.0), (41.0, 45.0)]


def speech(spark, rows, role=None):
    data = [("c", i, lo, hi, role or "") for i, (lo, hi) in enumerate(rows)]
    return spark.createDataFrame(data, "call string, n int, s double, e double, role string")


@pytest.mark.parametrize("own,others,want", [(AGENT, CUSTOMER, 20.0), ([(0.0, 30.0), (5.0, 8.0)], [], 30.0)])
def test_longest_monologue(spark, own, others, want):
    a, b = speech(spark, own).drop("role"), speech(spark, others or [(99.0, 99.0)]).drop("role")
    rows = sequences.longest_monologue(a, b, ["call"], "n", "s", "e").collect()
    assert [r.longest_monologue for r in rows] == [want]


def test_patience_dead_air_and_islands(spark):
    both = speech(spark, AGENT, "agent").union(speech(spark, CUSTOMER, "customer"))
    found = sequences.patience(both, ["call"], "role", "s", "e", "customer", "agent").first()
    assert found.patience == pytest.approx(2.6)
    assert sequences.dead_air(both, ["call"], "s", "e").first().dead_air == pytest.approx(5.0)
    late = speech(spark, [(50.0, 55.0)], "agent").union(speech(spark, [(0.0, 10.0)], "customer"))
    assert sequences.patience(late, ["call"], "role", "s", "e", "customer", "agent").first().patience == 10.0
    merged = sequences.merge_intervals(both, ["call"], "s", "e", 1.0).orderBy("s").collect()
    assert [(r.s, r.e) for r in merged] == [(0.0, 25.0), (30.0, 45.0)]


@pytest.mark.parametrize("cut,want", [([(15.0, 18.0)], 1), ([(11.5, 14.0)], 0), ([(19.7, 25.0)], 0)])
def test_interruptions(spark, cut, want):
    a, b = speech(spark, cut).drop("role"), speech(spark, AGENT).drop("role")
    rows = matching.interruptions(a, b, ["call"], "n", "s", "e").collect()
    assert sum(r.interruptions for r in rows) == want


def test_kaplan_meier(spark):
    data = [(1, True), (2, True), (2, False), (3, True), (4, False)]
    df = spark.createDataFrame([("g", t, e) for t, e in data], "g string, t int, e boolean")
    steps = sequences.kaplan_meier(df, ["g"], "t", "e")
    got = [(r.t, round(r.survival, 9)) for r in steps.orderBy("t").collect()]
    assert got == [(0, 1), (1, 0.8), (2, 0.6), (3, 0.3), (4, 0.3)]
    assert sequences.survival_median(steps, ["g"]).first().median == 3


def test_changed_set_ignores_empty_sets(spark):
    data = [(1, ["a"]), (2, []), (3, ["a", "a"]), (4, ["b", "a"]), (5, None), (6, ["a", "b"])]
    df = spark.createDataFrame([("k", i, m) for i, m in data], "k string, i int, m array<string>")
    got = sequences.changed_set(df, ["k"], ["i"], "m").orderBy("i").collect()
    assert [r.changed for r in got] == [False, False, False, True, False, False]


def test_small_sequence_operators(spark):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate("aabba")], "k string, i int, x string")
    assert [r.block_no for r in sequences.blocks(df, ["k"], ["i"], "x").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    ranks = sequences.average_ranks(spark.createDataFrame([("k", v) for v in (3, 1, 3, 2)], "k string, v int"), ["k"], "v", "r")
    assert sorted((r.v, r.r) for r in ranks.collect()) == [(1, 1.0), (2, 2.0), (3, 3.5), (3, 3.5)]
    short = spark.createDataFrame([("k", i, x, s) for i, (x, s) in enumerate([("a", 9.0), ("b", 0.5), ("a", 0.5), ("b", 9.0)])], "k string, i int, x string, s double")
    got = sequences.smooth_islands(short, ["k"], ["i"], "x", "s").orderBy("i").collect()
    assert [r.smoothed for r in got] == ["a", "a", "b", "b"]  # judged on the labels given, so never in a chain
    pick = sequences.stratified_sample(spark.range(40).selectExpr("id", "id % 4 as g"), "g", "id", 6, 1).collect()
    assert sorted(r.g for r in pick) == [0, 0, 1, 1, 2, 3]


def test_median_of_others(spark):
    import statistics

    for values in ([5.0], [1.0, 9.0], [3.0, 1.0, 2.0], [4.0, 4.0, 1.0, 7.0], [2.0, 8.0, 5.0, 5.0, 1.0, 9.0, 3.0]):
        df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
        for r in matching.median_of_others(df, "k", "v").collect():
            rest = values[: r.k] + values[r.k + 1 :]
            assert r.others == (statistics.median(rest) if rest else None)


def test_scores_add_up(spark):
    rubric, gates = {"a": 0.5, "b": 0.3, "c": 0.2}, ["a", "b"]
    df = spark.createDataFrame([(1, 5, 5, 5), (2, 2, 5, 5), (3, 1, 2, 1)], "id int, a int, b int, c int")
    got = {r.id: (r.raw, r.total, r.failed) for r in scores.weighted_total(df, rubric, gates).collect()}
    assert got == {1: (100.0, 100.0, []), 2: (62.5, 59.0, ["a"]), 3: (7.5, 7.5, ["a", "b"])}
    lost = scores.lost_points(df, rubric, gates).collect()
    assert sum(r.lost + r.lost_by_gate for r in lost) == pytest.approx(sum(100 - t for _, t, _ in got.values()))
    gain = {r.dim: (round(r.gain * 3, 6), r.cards) for r in scores.floor_gain(df, rubric, gates).collect()}
    assert gain["a"] == (round((75.0 - 59.0) + 25.0, 6), 2)


def test_folding_and_cohort(spark):
    df = spark.createDataFrame([("x",)] * 20 + [("y",)] * 2 + [(None,)] * 6, "k string")
    got = {r.bucket: r["count"] for r in scores.fold_rare(df, "k").groupBy("bucket").count().collect()}
    assert got == {"x": 20, "other": 2, None: 6}
    cards = spark.createDataFrame([(1, "v1", 1), (2, "v2", 5), (3, "v2", 5), (4, "v1", 5)], "id int, v string, t int")
    assert {r.v for r in scores.newest_cohort(cards.where("id <> 4"), "v", "t", "id").collect()} == {"v2"}


def test_order_over_ranges_with_one_hot_key(spark):
    from dialmart.operators import ranges

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice([None, "a", "b"]), float(rng.randrange(50))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in ranges.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "p90": 0.9}).collect()}
    for k in {k for k, _ in rows}:
        vs = sorted(v for g, v in rows if g == k)
        for name, p in (("q1", 0.25), ("q2", 0.5), ("p90", 0.9)):
            at = (len(vs) - 1) * p
            lo, hi = vs[int(at)], vs[-int(-at // 1)]
            assert got[k][name] == pytest.approx(lo + (hi - lo) * (at - int(at)))
    ranked = sequences.average_ranks(df, ["k"], "v", "r").collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        vs = [v for g, v in rows if g == r.k]
        assert r.r == sum(v < r.v for v in vs) + (sum(v == r.v for v in vs) + 1) / 2


def test_one_key_with_very_many_rows_and_spans(spark):
    from dialmart.operators import matching

    t = "timestamp_ntz '2026-01-01' + make_dt_interval(0, 0, {}, 0)"
    rows = spark.range(200_000).selectExpr("'k' as k", "id", f"{t.format('cast(id * 2 as int)')} as at")
    spans = spark.range(200_000).selectExpr("'k' as k", "id as span", f"{t.format('cast(id * 2 - 1 as int)')} as lo", f"{t.format('cast(id * 2 + 1 as int)')} as hi")
    found = matching.first_containing(rows, spans, ["k"], "id", "at", "lo", "hi", "span")
    assert found.where("span = id").count() == 200_000
    acts = spans.selectExpr("k", "hi as did", "'x' as how")
    limits = rows.selectExpr("*", "at + interval 10 minutes as until")
    first = matching.first_action(limits, acts, ["k"], "id", "at", "until", "did", "how")
    assert first.where("action_at = at + interval 1 minute").count() == 200_000

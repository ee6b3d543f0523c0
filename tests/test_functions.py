"""Statistics, texts and dates against known values."""

from __future__ import annotations

import hashlib
import hmac
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dialmart.functions import dates, stats, text


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_t_and_z_critical_values():
    assert stats.t_quantile(1, 0.95) == pytest.approx(12.7062047, rel=1e-7)
    assert stats.t_quantile(9, 0.95) == pytest.approx(2.262157, rel=1e-6)
    assert stats.t_quantile(30, 0.99) == pytest.approx(2.749996, rel=1e-6)
    assert stats.t_quantile(2, 0.95) == pytest.approx(4.302653, rel=1e-6)
    assert 3.182446 < stats.t_quantile(2.5, 0.95) < 4.302653
    assert stats.z_crit(0.95) == pytest.approx(1.959964, rel=1e-6)


def test_mean_interval(spark):
    df = column(spark, [*map(float, range(1, 11)), math.nan, math.inf, None]).withColumn("k", F.lit(1))
    r = stats.mean_ci(df, ["k"], "v").first()
    assert (r.n, r.mean) == (10, 5.5)
    assert (r.low, r.high) == (pytest.approx(3.334149, abs=1e-6), pytest.approx(7.665851, abs=1e-6))


def test_wilson(spark):
    df = spark.createDataFrame([(5, 20), (0, 10), (10, 10)], "k int, n int")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = df.select("k", low.alias("l"), high.alias("h")).collect()
    assert (got[0].l, got[0].h) == (pytest.approx(0.111862, abs=1e-6), pytest.approx(0.468701, abs=1e-6))
    assert (got[1].l, got[1].h) == (0.0, pytest.approx(0.277533, abs=1e-6))
    assert got[2].h == 1.0


def moments(spark, a, b):
    import statistics as st

    row = (len(a), st.mean(a), st.variance(a), len(b), st.mean(b), st.variance(b))
    return spark.createDataFrame([tuple(map(float, row))], "n1 double, m1 double, v1 double, n2 double, m2 double, v2 double")


@pytest.mark.parametrize(
    "a,b,want",
    [
        ([*range(1, 11)], [3, 3.5, 9, 12.5, 4, 15, 2, 20], (-3.125, -8.828108, 2.578108)),
        ([5, 5, 5], [1, 2, 3, 4], (2.5, 0.445740, 4.554260)),
        ([5, 5, 5], [1, 1, 1], (4.0, 4.0, 4.0)),
    ],
)
def test_welch(spark, a, b, want):
    df = moments(spark, [float(x) for x in a], [float(x) for x in b])
    r = stats.welch(df, "n1", "m1", "v1", "n2", "m2", "v2", 0.95).first()
    assert (r["diff"], r.low, r.high) == tuple(pytest.approx(w, abs=1e-5) for w in want)


def test_groups_against_rest_agree_with_plain_welch(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.gauss(50, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in stats.group_against_rest(df, "g", "v", 0.95).collect():
        own, rest = [v for g, v in rows if g == r.g], [v for g, v in rows if g != r.g]
        w = stats.welch(moments(spark, own, rest), "n1", "m1", "v1", "n2", "m2", "v2", 0.95).first()
        assert (r["diff"], r.low, r.high) == (pytest.approx(w["diff"]), pytest.approx(w.low), pytest.approx(w.high))


def test_trend(spark):
    ys = [60, 62, 61, 65, 64, 66, 70, 69, 71, 73]
    df = spark.createDataFrame([(1, float(7 * i), float(y)) for i, y in enumerate(ys)], "k int, d double, y double")
    r = stats.linear_trend(df, ["k"], "d", "y").first()
    assert (r.slope, r.low, r.high) == tuple(pytest.approx(x, abs=1e-6) for x in (6.155844, 4.898024, 7.413665))


def test_quantiles_and_histograms(spark):
    q = column(spark, [4.0, 1.0, 3.0, 2.0]).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert q == [pytest.approx(x) for x in (1.75, 2.5, 3.7)]
    values = [0, 39.99, 40, 59.9, 60, 79.9, 80, 100, 100.1, -1, None, math.nan]
    df = column(spark, [None if v is None else float(v) for v in values])
    got = df.groupBy(stats.histogram_bin("v", [0, 40, 60, 80, 100]).alias("b")).count().where("b is not null").collect()
    assert sorted((r.b, r["count"]) for r in got) == [(0, 2), (1, 2), (2, 2), (3, 2)]
    clamped = df.select(stats.clamped_bin("v", 0, 100, 4).alias("b")).collect()
    assert [r.b for r in clamped][7:10] == [3, 3, 0]


def test_agreement(spark):
    def kappa(pairs):
        df = spark.createDataFrame([(1, a, b) for a, b in pairs], "k int, a int, b int")
        return stats.weighted_kappa(df, ["k"], "a", "b").first().kappa

    assert kappa([(i, i) for i in range(1, 6)]) == pytest.approx(1.0)
    assert kappa([(1, 3), (2, 2), (3, 1)]) == pytest.approx(-1.0)
    assert kappa([(2, 2), (2, 3)]) is None
    df = spark.createDataFrame([(0, 10), (10, 0), (0, 0)], "b int, c int")
    got = [r.p for r in df.select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got == [0.001953125, 0.001953125, 1.0]


def test_cluster_share(spark):
    rows = [(i, k, 3) for i, k in enumerate([3, 0, 3, 0, 3, 0, 1, 2])]
    df = spark.createDataFrame(rows, "i int, k int, n int")
    r = stats.cluster_share(df, "i", "k", "n").first()
    assert r.share == 0.5 and r.low < 0.5 < r.high and r.high - r.low > 0.38
    assert stats.cluster_share(df.limit(4), "i", "k", "n", 50).first().low is None


def test_spearman_and_limits(spark):
    df = spark.createDataFrame([(1, float(i), float(i * i)) for i in range(6)], "k int, x double, y double")
    r = stats.spearman(df, ["k"], "x", "y").first()
    assert (r.rho, r.low, r.high) == (pytest.approx(1), pytest.approx(1), pytest.approx(1))
    limits = stats.control_limits(spark.createDataFrame([(1, v) for v in [5.0, 5.0, 5.0, 9.0]], "k int, v double"), ["k"], "v").first()
    assert limits.centre == 5.0 and limits.high == pytest.approx(5 + 3 * math.sqrt(3))


def test_error_rates(spark):
    df = spark.createDataFrame([("the big cat sat", "the cat sat down"), ("a", "a"), ("", "x")], "a string, b string")
    got = df.select(stats.word_error(F.col("a"), F.col("b")).alias("w"), stats.char_error(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.w for r in got] == [0.5, 0.0, 1.0] and got[1].c == 0.0


def test_drift_index(spark):
    a = spark.createDataFrame([(0, 50), (1, 50)], "bin int, n int")
    assert stats.psi(a, a, [], "bin", "n").first().psi == pytest.approx(0.0)
    b = spark.createDataFrame([(0, 90), (2, 10)], "bin int, n int")
    p, q = [0.5, 0.5, 1e-4], [0.9, 1e-4, 0.1]
    assert stats.psi(a, b, [], "bin", "n").first().psi == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(p, q, strict=True)))


def values(spark, f, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, v string")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_check_digits(spark):
    assert values(spark, text.luhn_valid, ["4111 1111 1111 1111", "4111111111111112", "79927398713", None]) == [True, False, False, None]
    assert values(spark, text.national_id_valid, ["123456782", "123456789", "00000018", "0000018", "00018", "0000000018"]) == [True, False, True, False, False, False]


def test_pseudonyms_are_hmac(spark):
    for key in (b"k", b"long key " * 12):
        want = [hmac.new(key, v.encode(), hashlib.sha256).hexdigest()[:12] for v in ("a", "é", "")]
        assert values(spark, lambda c, key=key: text.keyed_pseudonym(c, key), ["a", "é", ""]) == want


def test_text_functions(spark):
    assert values(spark, lambda c: text.question_count(c, ["who"]), ["Who is it. Fine. Really? who", "", "whole day.", "about 3.5? who. ?! no", "who?! is  \n who"]) == [2, 0, 0, 1, 0]
    assert values(spark, text.word_count, ["a b c", None, " "]) == [3, 0, 0]
    assert values(spark, text.mask, ["mail a.b@c.org on 2.3.2024 or 050-123 4567"]) == ["mail <EMAIL> on <DATE> or <LONG_NUMBER>"]
    assert values(spark, text.op_code, ["00201", "000", " 7 "]) == ["201", "0", "7"]
    assert values(spark, text.csv_cell, ["=1+1", "ok", "-x"]) == ["'=1+1", "ok", "'-x"]
    assert values(spark, text.safe_id, ["call-1", "050 1234567", "../x", "a1234567"]) == [True, False, False, False]
    assert values(spark, lambda c: text.phrase_hits(c, ["not now", "not"]), ["Not now, not ever; nothing"]) == [2]
    assert values(spark, lambda c: text.account_parts(c)[1], ["12/34-5", "12-34", "12 34", "34"]) == ["34-5", "34", "34", "34"]
    assert values(spark, lambda c: text.account_parts(c)[0], ["12/34-5", "12-34", "12 34", "34"]) == ["12", "12", "12", ""]
    assert values(spark, text.fenced_json, ['x ```json\n{"a": 1}\n``` y', '{"a": 2} ok', "none"]) == ['{"a": 1}', '{"a": 2}', None]


def test_quotes(spark):
    """The verdicts of quotes of one line; near ones keep their numbers and negations."""
    from dialmart.operators import alignment

    said = "I will call you back on Sunday, the 12th, and I do not charge a fee for that."
    quotes = ["call you back on sunday", "call you bac on Sunday", "on Sunday, the 13th", "I do charge a fee for that", "", "something else entirely", "charge a fee for that"]
    lines = spark.createDataFrame([(1, 0, "nothing of it"), (1, 1, said), (2, 0, "Sunday, the 12th")], "call int, line int, text string")
    asked = spark.createDataFrame([(i, 1, q) for i, q in enumerate(quotes)], "id int, call int, quote string")
    got = {r.id: r for r in alignment.verified_quotes(asked, lines, "id", ["call"], ["line"], polarity=("not", "no"), negations=("not", "no")).collect()}
    assert [got[i].verdict for i in range(7)] == ["verbatim", "near", "changed", "absent", "short", "absent", "verbatim"]
    assert (got[1].said, got[1].line, got[1].place) == ("call you back on Sunday,", 1, 2)
    assert got[6].said == "not charge a fee for that." and got[2].said is None
    assert alignment.verified_quotes(asked.limit(0), lines, "id", ["call"], ["line"]).count() == 0


def test_timestamps(spark):
    moment = datetime(2026, 8, 2, 16, 4, 34)
    items = ["02Aug2026 16:04:34", "02AUG2026:16:04:34", "46236.66983796296", "2101305874", "2026-08-02T16:04:34"]
    assert values(spark, dates.parse_timestamp, items) == [moment] * 5
    assert values(spark, dates.parse_timestamp, ["02/08/2026 16:04", "2.8.2026"]) == [datetime(2026, 8, 2, 16, 4), datetime(2026, 8, 2)]
    assert values(spark, dates.parse_timestamp, ["", "31Foo2026 10:00:00", "2026-02-30", "true", None]) == [None] * 5


def test_business_days(spark):
    from datetime import timedelta

    starts = [datetime(2026, 7, 1, 9) + timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(s,) for s in starts], "t timestamp_ntz")
    for n in (1, 2, 5, 7):
        for r in df.select("t", dates.add_business_days(F.col("t"), n).alias("d")).collect():
            day, left = r.t, n
            while left:
                day += timedelta(days=1)
                left -= day.weekday() not in (4, 5)
            assert r.d == day, (r.t, n)

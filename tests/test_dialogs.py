"""Dialog operators, scoring of spans and frames, and signal kernels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialmart.functions import audio, stats
from dialmart.operators import dialogs, diarization, roles

TURNS = "call string, n int, role string, text string, s double, e double"


def turns(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], TURNS)


def test_merge_and_transcript(spark):
    df = turns(spark, [("x", "hi", 0.0, 1.0), ("x", "there", 5.0, 6.0)]).drop("role")
    merged = dialogs.merge_channels(df, df, ["call"], "s", "e").orderBy("turn_no").collect()
    assert [(r.role, r.s) for r in merged] == [("agent", 0.0), ("customer", 0.0), ("agent", 5.0), ("customer", 5.0)]
    long = turns(spark, [("a", f"t{i}", 61.0 * i, 0.0) for i in range(6)])
    r = dialogs.transcript(long, ["call"], "n", "role", "text", "s", 3).first()
    assert r.lines == ["1 [00:00] a: t0", "2 [01:01] a: t1", "... 3 lines left out ...", "6 [05:05] a: t5"] and r.n_lines == 6
    assert len(dialogs.transcript(long, ["call"], "n", "role", "text", "s").first().lines) == 6



def test_ids_directions_and_judgements(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("a", 4)], "id string, n int")
    assert [r.unique_id for r in dialogs.unique_ids(df, "id", "n").orderBy("n").collect()] == ["a", "b", "a-2", "a-3"]
    contacts = spark.createDataFrame([("k", None), ("m", "O")], "id string, d string")
    messages = spark.createDataFrame([("k", 2, "O"), ("k", 1, "I"), ("m", 1, "I")], "id string, at int, d string")
    assert sorted((r.id, r.d) for r in dialogs.first_direction(contacts, messages, "id", "at", "d").collect()) == [("k", "I"), ("m", "O")]


def test_spans_frames_and_gates(spark):
    schema = "d int, lo int, hi int"
    gold = spark.createDataFrame([(1, 0, 5), (1, 10, 12), (2, 0, 3)], schema)
    found = spark.createDataFrame([(1, 4, 8), (2, 5, 6)], schema)
    r = stats.span_scores(gold, found, ["d"], "lo", "hi").first()
    assert (r.precision, r.recall) == (0.5, pytest.approx(1 / 3))
    base = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9)], "k string, v double")
    now = spark.createDataFrame([("a", 0.89), ("b", 0.8)], "k string, v double")
    assert {r.k: r.worse for r in stats.regression_gates(now, base, "k", "v").collect()} == {"a": False, "b": True, "c": True}


def test_calibration_and_drift(spark):
    pairs = spark.createDataFrame([("x", i % 5 + 1, i % 5 + 1) for i in range(30)] + [("y", 3, 4)] * 25 + [("z", 3, 4)] * 5, "dim string, s int, h int")
    got = {r.dim: (r.mae, r.flagged) for r in stats.calibration(pairs, "dim", "s", "h").collect()}
    assert got == {"x": (0.0, False), "y": (1.0, True), "z": (1.0, False)}
    df = spark.createDataFrame([(2, 9.0), (9, 9.0), (9, 5.0)], "n int, v double")
    assert [r.x for r in df.select(stats.drift_verdict(F.col("n"), F.col("v"), F.lit(4), F.lit(6)).alias("x")).collect()] == ["skip", "flag", "ok"]
    halves = spark.createDataFrame([(3.5,), (2.5,), (1.4,)], "v double").select(stats.half_up(F.col("v")).alias("x")).collect()
    assert [r.x for r in halves] == [4, 3, 1]


def test_signals(spark):
    every = np.arange(256).astype(np.uint8)
    assert (audio.mu_law(every)[[0, 127, 128, 255]] == [-32124, 0, 32124, 0]).all()
    assert (audio.a_law(every)[[0x2A, 0xAA, 0x55, 0xD5]] == [-32256, 32256, -8, 8]).all()
    assert audio.resample(np.array([0.0, 2.0]), 1, 2).tolist() == [0.0, 1.0, 2.0, 2.0]
    loud = np.r_[np.zeros(8000), 9000 * np.sin(np.arange(8000)), np.zeros(8000)]
    spans = audio.speech_spans(loud, 8000)
    assert len(spans) == 1 and abs(spans[0][0] - 1) < 0.05 and abs(spans[0][1] - 2) < 0.05
    df = spark.createDataFrame([(bytearray(b"\xff" * 4000),), (bytearray(b""),)], "b binary")
    assert [r.x for r in df.select(audio.byte_entropy(F.col("b")).alias("x")).collect()] == [0.0, 0.0]
    assert [r.x for r in df.select(audio.speech_of(F.col("b")).alias("x")).collect()] == [[], []]


HEARD = "c string, s double, e double, who string"


def brute_diarization(ref, hyp, collar):
    """Frame by frame, with every pairing tried."""
    from itertools import permutations

    end = int(max([e for _, _, e, _ in ref + hyp]) / 0.01) + 1

    def floor_of(turns):
        grid = [None] * end
        for _, s, e, who in sorted(turns, key=lambda t: (t[1], t[2], t[3])):
            for i in range(max(0, int(s / 0.01)), min(end, round(e / 0.01))):
                grid[i] = who
        return grid

    r, h = floor_of(ref), floor_of(hyp)
    hidden = {i for _, s, e, _ in ref for x in (s, e) for i in range(int(x / 0.01) - int(collar / 0.01), int(x / 0.01) + int(collar / 0.01) + 1)} if collar else set()
    pairs = [(a, b) for i, (a, b) in enumerate(zip(r, h, strict=True)) if i not in hidden and (a or b)]
    speech, missed, false = sum(a is not None for a, _ in pairs), sum(b is None for _, b in pairs), sum(a is None for a, _ in pairs)
    names, given = sorted({a for a, b in pairs if a and b}), sorted({b for a, b in pairs if a and b})
    wide = max(len(names), len(given))
    best = max(sum(m.get(b) == a for a, b in pairs if a and b) for p in permutations(names + [None] * (wide - len(names))) for m in [dict(zip(given, p, strict=False))])
    both = sum(1 for a, b in pairs if a and b)
    rate = lambda x: round(x / speech, 4) if speech else 0.0
    confused = sum(1 for a, b in pairs if a and b and a != b)
    return speech, missed, false, confused, rate(missed + false + confused), rate(missed + false + both - best)


@pytest.mark.parametrize("collar", [0.0, 0.25])
def test_diarization_errors(spark, collar):
    rng = np.random.default_rng(5)
    calls = {}
    for c in "abcdefgh":
        speakers, given = rng.integers(1, 5, 2)
        turn = lambda n, p: [(c, round(float(s), 2), round(float(s + rng.uniform(0.1, 3)), 2), f"{p}{rng.integers(n)}") for s in np.sort(rng.uniform(0, 20, 12))]
        calls[c] = (turn(speakers, "s"), turn(given, rng.choice(["s", "t"])))
    ref, hyp = (spark.createDataFrame([t for v in calls.values() for t in v[k]], HEARD).repartition(3) for k in (0, 1))
    got = {r.c: (r.speech, r.missed, r.false_alarm, r.confused, r.der, r.der_best) for r in diarization.diarization_errors(ref, hyp, ["c"], "s", "e", "who", collar).collect()}
    assert got == {c: brute_diarization(*v, collar) for c, v in calls.items()}
    silent = spark.createDataFrame([("x", 1.0, 0.5, "A")], HEARD)
    assert diarization.diarization_errors(silent, silent, ["c"], "s", "e", "who").count() == 0


def test_role_accuracy(spark):
    ref = spark.createDataFrame([("c", 0.0, 1.0, "banker"), ("c", 1.0, 2.0, "customer"), ("d", 0.0, 1.0, "other")], HEARD)
    hyp = spark.createDataFrame([("c", 0.0, 1.5, "banker"), ("c", 1.5, 2.0, "customer"), ("d", 0.0, 1.0, "other")], HEARD)
    assert {r.c: r.role_accuracy for r in diarization.diarization_errors(ref, hyp, ["c"], "s", "e", "who", 0.0).collect()} == {"c": 0.75, "d": None}


def test_roles_by_signals(spark):
    say = [
        ("0", "שמי דנה, מספר חשבון 123456", 0.0, 3.0), ("1", "שלום, הגעתם למוקד. מה תעודת הזהות שלך?", 3.0, 8.0), ("0", "נציג אמר 123456 בסוף", 60.0, 70.0),
        ("1", "123456, תודה. אבדוק", 70.0, 80.0), ("1", "יום נעים", 130.0, 140.0),
    ]
    df = turns(spark, say).withColumn("call", F.lit("a")).union(turns(spark, [("0", "hello", 0.0, 1.0)]).withColumn("call", F.lit("alone")))
    got = {r.call: r for r in roles.infer_roles(df, ["call"], "role", "s", "e", "n", "text", roles.HEBREW).collect()}
    votes = {v.signal: (v.weight, v.speaker) for v in got["a"].votes}
    assert votes == {
        "opening": (3.0, "1"), "identity_request": (2.5, "1"), "identity_supply": (2.0, "1"), "question_rate": (1.5, "1"),
        "service_language": (1.0, "1"), "closing": (1.0, "1"), "first_speaker": (0.5, "0"),
    }
    assert (got["a"].agent, got["a"].confidence) == ("1", round(10.5 / 11.5, 3))
    assert (got["alone"].agent, got["alone"].confidence, got["alone"].votes) == ("0", 0.0, [])
    parts = spark.createDataFrame([("a", 1, 0.0, 50.0), ("a", 2, 50.0, 200.0), ("alone", 1, 0.0, 9.0)], "call string, part int, begin double, end double")
    found = roles.part_conflicts(df, parts, ["call"], "part", "role", "s", "e", "n", "text", roles.HEBREW).collect()
    assert found == []
    other = turns(spark, [*say[:4], ("0", "יום נעים, הגעתם למוקד, אבדוק", 210.0, 220.0), ("1", "כן", 221.0, 222.0)]).withColumn("call", F.lit("a"))
    parts = spark.createDataFrame([("a", 1, 0.0, 100.0), ("a", 2, 200.0, 300.0)], "call string, part int, begin double, end double")
    found = roles.part_conflicts(other, parts, ["call"], "part", "role", "s", "e", "n", "text", roles.HEBREW).collect()
    assert [(r.part, r.agent) for r in found] == [] or [(r.part, r.agent, r.confidence >= 0.3) for r in found] == [(2, "0", True)]

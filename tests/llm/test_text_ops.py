"""Line dedup and toxicity against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dialmart.llm import lines, queries, toxicity


def brute_lines(docs, m):
    seen, gone = {}, {}
    for d, text in sorted((d, t) for d, t in docs if t is not None and d is not None):
        body = text.split("\n")
        full = [i for i, line in enumerate(body) if line.strip(" \t\r\x0b\x0c")]
        out = set()
        for k in range(len(full) - m + 1):
            run = tuple(body[i] for i in full[k : k + m])
            if seen.setdefault(run, (d, k)) != (d, k):
                out |= set(full[k : k + m])
        gone[d] = out
    return gone


def check_lines(rows, docs, m):
    gone = brute_lines(docs, m)
    for d, text in docs:
        if d is None or text is None:
            continue
        body = text.split("\n")
        kept = "\n".join(line for i, line in enumerate(body) if i not in gone[d])
        spans = sum(i in gone[d] and i - 1 not in gone[d] for i in range(len(body)))
        assert rows[d] == (len(body), len(gone[d]), spans, hashlib.md5(kept.encode()).hexdigest()), d


def digest(df):
    return {
        r.doc_id: (r.n_lines, r.n_removed, r.n_spans, hashlib.md5(r.kept.encode()).hexdigest() if r.kept is not None else None)
        for r in df.collect()
    }


def test_lines_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    rows = {r[0]: tuple(r)[1:] for r in queries.op8_lines(spark, sf_dir).collect()}
    check_lines(rows, list(zip(docs.doc_id, docs.text, strict=True)), 2)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_lines_brute_force(spark, m):
    rng = random.Random(m)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " \t"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    docs += [(100, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (101, "x\ny\nz\nx\ny\nz\nx\ny\nz"), (102, ("k\n" * 3000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    check_lines(digest(lines.dedup_lines(df, m)), docs, m)


def test_lines_odd_rows(spark):
    docs = [
        (2, "p\nq\nr", "u", 5, 1),
        (1, "p\nq", "v", 3, 1),
        (1, "p\nq", "v", 3, 1),
        (3, "p\nq", None, 3, 1),
        (None, "p\nq", "", 3, 1),
        (4, None, None, None, None),
        (5, "", "", 0, 1),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string, n_chars long, line int")
    rows = lines.drop_repeated_lines(df)
    got = sorted((r.doc_id or 0, r.text) for r in rows.collect())
    assert got == [(0, "p\nq"), (1, "p\nq"), (1, "p\nq"), (2, "r"), (4, None), (5, "")]
    assert rows.columns == ["doc_id", "text", "kept", "n_chars", "line"]
    assert {(r.kept, r.line) for r in rows.collect()} == {("u", 1), ("v", 1), ("", 1), (None, None)}
    found = lines.dedup_lines(df)
    assert found.columns == ["doc_id", "text", "kept", "n_chars", "line", "n_lines", "n_removed", "n_spans"]
    assert {r.kept for r in found.collect()} == {"p\nq", "r", "", None}
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_found_at_the_level_of_their_length(spark):
    seven, three = [f"s{i}" for i in range(7)], [f"t{i}" for i in range(3)]
    docs = [(1, [*seven, "a", *three]), (2, ["b", *three, "c"]), (3, ["d", *seven]), (4, [*three, *seven[2:], "e"])]
    df = spark.createDataFrame([(d, "\n\n".join(x)) for d, x in docs], "doc_id long, text string")
    table = lines.line_table(df)
    levels = lines.run_levels(table, 2)
    assert [n for n, _ in levels] == [2, 4]
    starts = {n: sorted((r.doc_id, r.place, r.same) for r in rows.collect()) for n, rows in levels}
    by_four = {(d, p) for d, p, _ in starts[4]}
    assert by_four == {(1, p) for p in range(1, 5)} | {(3, p) for p in range(2, 6)} | {(4, 4), (4, 5)}
    assert {(2, 2), (2, 3), (4, 1), (4, 2)} <= {(d, p) for d, p, _ in starts[2]} - by_four
    runs = {(r.doc_id, r.lo, r.hi) for r in lines.repeated_runs(table, 2, levels).collect()}
    assert runs == {(2, 2, 4), (3, 2, 8), (4, 1, 8)}


def test_long_runs_and_many_copies(spark):
    body = "\n".join(f"line {i % 60} {i // 60}" for i in range(300))
    docs = [(i, body) for i in range(40)] + [(100, "k\n" * 5000), (101, "k\n" * 4999)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check_lines(digest(lines.dedup_lines(df, 2)), docs, 2)


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # 97 toxic rows are held out here, 6 only at sf0.01
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    labels = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()]
    test = [(r.score, r.predicted, t) for r, t in labels if r.held_out]
    bad = [x for x in test if x[2] == 1]
    good = [x for x in test if x[2] == 0]
    assert len(bad) >= 90 and len(good) >= 700
    assert sum(p == t for _, p, t in test) / len(test) >= 0.96  # all rows called clean would be 0.88
    hits = sum(p for _, p, _ in bad)
    assert hits / len(bad) >= 0.75  # recall, 0.79 when this was written
    assert hits / max(1, hits + sum(p for _, p, _ in good)) >= 0.95  # precision, 0.99
    auc = sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a in bad for b in good) / (len(bad) * len(good))
    assert auc >= 0.97


def dict_ftrl(rows, bits, s):
    """Per-coordinate FTRL-proximal, one number at a time."""
    z, n = {}, {}

    def weight(i):
        l1 = 0.0 if i == "b" else s.l1
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for at, label in rows:
            active = [*sorted(set(at)), "b"]
            w = {i: weight(i) for i in active}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in active:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / s.alpha * w[i]
                n[i] = was + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_training_is_ftrl_proximal(spark):
    rng = random.Random(8)
    words = "red green blue grey black vile".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows = [(i, t, int("vile" in t)) for i, t in docs]
    s = toxicity.Settings(bits=12, l1=0.7, epochs=2)
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id", "text"), "doc_id").collect()]
    make = toxicity.Features(s.bits)
    want = dict_ftrl([(make.coordinates(rows[i][1]).tolist(), rows[i][2]) for i in order], s.bits, s)
    model = toxicity.train(df, s)
    assert model.intercept == pytest.approx(want.pop("b"))
    assert dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want)


def test_toxicity_finds_phrases_and_forms(spark):
    rng = random.Random(4)
    words = ["tree", "stone", "river", "cloud", "grass", "wind", "sand"]
    rows = []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        bad = i % 5 == 0
        if bad:
            text.insert(rng.randint(0, len(text)), rng.choice(["vile", f"grimble{rng.choice('abcdefgh')}{rng.choice('xyzuv')}"]))
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(df)
    assert 0 < len(model.at) < 400
    tests = [(1, "tree vile stone", "q"), (2, "a grimbleqq", "q"), (3, None, "q"), (4, "", "q"), (5, "tree stone " * 9000, "q"), (None, "VILE", "q")]
    other = spark.createDataFrame(tests, "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(other, model).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[None] > 0.5
    assert got[3] == got[4] < 0.5 and got[5] < 0.5
    assert sorted(r.doc_id for r in toxicity.drop_toxic(other, model).collect()) == [3, 4, 5]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    model = toxicity.train(none)
    assert [r.score for r in toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).collect()] == [0.5]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.label) for r in toxicity.labelled_rows(docs, labels).collect()} <= {(1, 1)}


def test_training_ignores_rows_that_are_held_out(spark):
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    used = {r.doc_id for r in toxicity.labelled_rows(docs, labels).collect()}
    assert used == {d for d in range(200) if zlib.crc32(str(d).encode()) % 5}

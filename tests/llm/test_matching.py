"""Repeated byte strings and near vectors against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialmart.llm import queries, repeats, vectors


def brute_repeats(docs, length):
    first, spans = {}, {}
    order = sorted((d, (t or "").encode()) for d, t in docs if d is not None)
    for d, raw in order:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], (d, i))
    for d, raw in order:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (d, i):
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone]))
        spans[d] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return spans


def got_spans(df):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in df.collect()}


def test_repeats_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    pairs = list(zip(docs.doc_id, docs.text, strict=True))
    want = brute_repeats(pairs, 100)
    rows = {r.doc_id: r for r in queries.op5_repeats(spark, sf_dir).collect()}
    assert len(rows) == len(pairs)
    for d, text in pairs:
        raw = text.encode()
        ends = [0, *(x for s in want[d] for x in s), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
        r = rows[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(raw) - len(kept), len(want[d])), d
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("length,full", [(100, 4000), (100, 2), (40, 4000), (8, 4000), (8, 3)])
def test_repeats_brute_force(spark, length, full, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 300)
    monkeypatch.setattr(repeats, "TRANSFORM", 2000)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    stock = [" ".join(word() for _ in range(40)) for _ in range(5)]
    docs = []
    for i in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            whole = rng.choice(stock)
            a = rng.randint(0, len(whole) // 2)
            parts += [whole[a : a + rng.randint(10, 200)], word()]
        docs.append((i, " ".join(parts)))
    docs += [(50, "ab" * 400), (51, "x" * 700), (52, "ab" * 300), (53, stock[0]), (54, stock[0]), (55, None), (56, "q" * length), (57, "q" * length)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got_spans(repeats.remove_repeats(df, length, full)) == brute_repeats(docs, length)


def test_repeats_odd_rows(spark):
    long = "some words that repeat for a while and are longer than a hundred bytes in all, which is what it takes " * 2
    docs = [(2, long, 1), (1, long, 1), (1, long, 1), (None, long, 1), (3, None, None), (4, "", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, bytes int")
    out = repeats.remove_repeats(df)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "bytes", "spans", "kept"] and len(rows) == 6
    sizes = sorted((r.doc_id or 0, len(r.kept)) for r in rows)
    one = brute_repeats([(1, long)], 100)[1]
    left = len(long) - sum(b - a for a, b in one)
    assert sizes == [(0, len(long)), (1, left), (1, left), (2, 0), (3, 0), (4, 0)]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(1, 9))
def test_intervals_are_runs_of_shared_prefixes(parts, length):
    text = np.array([c for p in parts for c in [*(b + 1 for b in p.encode()), 0]], np.int64)
    order = repeats.suffix_order(text, length)
    group = np.cumsum(repeats.interval_ends(text, order, length))
    raw = b"".join(p.encode() + b"\0" for p in parts)
    whole = {i: raw[i : i + length] for i in range(len(raw)) if len(raw[i : i + length]) == length and b"\0" not in raw[i : i + length]}
    by_group = {}
    for i, g in zip(order.tolist(), group.tolist(), strict=True):
        if i in whole:
            by_group.setdefault(g, set()).add(whole[i])
    assert all(len(s) == 1 for s in by_group.values())
    assert len(by_group) == len(set(whole.values()))


def near_set(rng, groups, each, noise, dim=24):
    out = []
    for _ in range(groups):
        base = rng.normal(size=dim)
        out += [base + noise * rng.normal(size=dim) for _ in range(each)]
    return np.array(out)


def brute_vectors(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[i], *comp[near[i]]) if near[i].any() else comp[i] for i in range(len(x))])
        if (new == comp).all():
            return near.sum(1), comp
        comp = new


@pytest.mark.parametrize("block", [4096, 7])
def test_vectors_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = np.concatenate([near_set(rng, 30, 5, 0.25), rng.normal(size=(120, 24)), near_set(rng, 1, 60, 0.05)])
    x[7] = x[3]
    x[9] = x[3] * 1e200
    x[11] = x[3] * 1e-200
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    n, comp = brute_vectors(np.array([r / np.abs(r).max() for r in x]))
    rows = {r.vec_id: r for r in vectors.near_vectors(df, vectors.Settings(per_list=20)).collect()}
    found = sum(r.n_links for r in rows.values())
    assert found >= 0.97 * n.sum() and all(r.n_links <= n[i] for i, r in rows.items())
    assert sum(rows[i].component_id == comp[i] for i in rows) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_vectors_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_embeddings(spark, sf).collect()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    n, _ = brute_vectors(np.array(data.embedding.tolist(), float))
    assert sum(r.n_links for r in rows) >= 0.9 * n.sum() and len(rows) == len(data)


def test_vectors_odd_rows(spark):
    nan = float("nan")
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]),
            (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vectors.near_vectors(df).collect())
    lone = [(i, 0, i, True) for i in range(3, 11)]
    assert got == [(0, 0, 0, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *lone]
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.where("vec_id = 5")).count() == 1

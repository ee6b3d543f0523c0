"""The pipeline's near copies and long single lines, against brute force."""

from __future__ import annotations

import random
from itertools import combinations, combinations_with_replacement

import numpy as np
import pytest

import corpus_pipeline
from dialmart.llm import lines, similar
from tests.llm.test_core_ops import DOCS, ODD


def brute_groups(docs, words=5, threshold=0.8):
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            lo, hi = sorted((root[a], root[b]))
            root = {d: lo if r == hi else r for d, r in root.items()}
    return sorted(set(root.values()))


@pytest.mark.parametrize("place", [512, 5])
def test_near_copies_between_080_and_097_go(spark, place, monkeypatch):
    monkeypatch.setattr(similar, "PLACE", place)
    rng = random.Random(place)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs), " ".join(copy)))
    docs += [(200, ""), (201, " \n"), (202, "One two"), (203, "one TWO"), (204, "one three")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == brute_groups(docs)


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Blocks are SimHashes of samples, and the Hamming distance of the whole fingerprints decides who is compared."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (1, 4, 5, 90)] + [np.zeros(0, np.uint64)]
    brute = lambda hashes: sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert similar._fingerprints(sets).tolist() == [brute(s) for s in sets]
    blocks = [b.tolist() for b in similar._blocks(sets)]
    assert [len(b) for b in blocks] == [similar.BLOCKS] * 4 + [0] and set(blocks[0]) == {int(sets[0][0])}
    of_five = {brute(c) for c in combinations_with_replacement(sets[2].tolist(), similar.IN_BLOCK)}
    assert set(blocks[2]) <= of_five and len(set(blocks[3])) > similar.BLOCKS // 2

    words = [f"w{i}" for i in range(40)]
    texts = [words, [*words[:-1], "end"], [*words, "more"], words]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept() == [0]
    monkeypatch.setattr(similar, "RADIUS", 0)
    assert kept() == [0, 1, 2]


def test_near_copies_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    kept = similar.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 7]
    assert similar.keep_one(odd.limit(0)).count() == 0


def test_long_lines_go_by_themselves(spark):
    long = " ".join(f"w{i}" for i in range(50))
    short = " ".join(f"s{i}" for i in range(49))
    docs = [(1, f"a\n{long}\nb\n{short}"), (2, f"c\n{short}\nd\n{long}\ne"), (3, f"{long}\nf\n {long}\ng\n{long}"), (4, long), (None, long)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: docs[0][1], 2: f"c\n{short}\nd\ne", 3: f"f\n {long}\ng", None: long}
    assert {r.n_removed for r in lines.dedup_lines(df, 2).collect()} == {0}

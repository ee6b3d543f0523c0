"""Packing, mixing and SimHash against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from dialmart.llm import components, mixing, packing, queries, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, fingerprint string"
ODD = [
    (1, "one two three four five", "en", "a", 1, 7, "x"),
    (1, "one two three four five", "en", "a", 1, 7, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0, ""),
    (4, " \n\t ", "en", "b", 0, 0, ""),
    (None, "One two THREE four five", "en", None, 1, 1, ""),
    (6, "word " * 30_000, "en", "a", 1, 1, ""),
    (7, "é 中文 ½ <|endoftext|> it's", "en", "ÿ", 1, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def ids_of(text):
    tok = tokens.tokenizer_for(queries.VOCABULARY).tokenizer
    return tok.encode(text or "", add_special_tokens=False).ids


def test_shortcut_gives_the_librarys_ids(real):
    tok = tokens.tokenizer_for(queries.VOCABULARY)
    rng = np.random.default_rng(3)
    letters = list("aAbÉßÿ'sStT re’09 .,<|\n\t ́e中文İΣς①½ªµ \x1c\x85×÷\x00'l")
    made = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(2000)]
    for text in [*real.text, *made, "a<|endoftext|>b", "<|startoftext|>"]:
        assert tok.encode(text) == np.array(ids_of(text), "<u4").tobytes(), text[:50]


def check_packing(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids = np.array([*ids_of(text), 1], "<u4")
        want = [
            (k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
            for k, at in enumerate(range(0, len(ids), capacity))
        ]
        got = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc]})
        assert got == want
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_packing_query(spark, sf_dir, real):
    rows = queries.op1_packing(spark, sf_dir).collect()
    used, least = check_packing(rows, dict(zip(real.doc_id, real.text, strict=True)), 4096)
    assert used <= least + 1


def test_packing_odd_rows(spark, odd):
    packed = packing.pack_documents(odd, queries.VOCABULARY, 64, 1)
    rows = packed.collect()
    check_packing(rows, {r[0]: r[1] for r in ODD}, 64)
    assert sum(1 for r in rows if r.doc_id == 1) == 2
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == sum(r.length for r in rows)
    assert packing.pack_documents(odd.limit(0), queries.VOCABULARY).count() == 0


def test_packing_keeps_odd_lengths_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, 5, 9, "s"), (2, 0, 9, "s"), (3, None, 9, "s"), (4, 11, 9, "s"), (5, 5, 9, "s")],
        "doc_id long, length int, _rank int, sequence_id string",
    )
    packed = packing.pack(df, 10)
    assert packed.columns == ["doc_id", "length", "_rank", "sequence_id", "offset"]
    rows = packed.collect()
    got = {r.doc_id: (r.sequence_id, r.offset) for r in rows}
    assert sorted([got[1], got[5]]) == [(0, 0), (0, 5)] and {r["_rank"] for r in rows} == {9}
    assert got[2] == got[3] == got[4] == (None, None)


def test_two_tighter_documents_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1]] = [1, 1, 1]
    assert packing.plan_sequences(counts) == [(1, [(7, 1), (2, 1), (1, 1)])]
    counts = np.zeros(21, np.int64)
    counts[[11, 6, 5, 4]] = [1, 1, 1, 1]  # greedy 11+6 leaves 3; 5+4 in the place of 6 fill it up
    kinds = packing.plan_sequences(counts)
    assert kinds[0] == (1, [(11, 1), (5, 1), (4, 1)])


def test_many_pieces_of_one_length_and_one_document(spark):
    df = spark.range(997).select(F.lit(None).cast("long").alias("doc_id"), F.lit(300).alias("length")).repartition(3)
    rows = packing.pack(df, 1000).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 997
    assert {r.offset for r in rows} == {0, 300, 600} and len({r.sequence_id for r in rows}) == 333


def water_level(sizes, weights, most):
    target = {s: 0.0 for s in sizes}
    left, free = float(sum(sizes.values())), set(sizes)
    while free and left > 1e-9:
        w = sum(weights[s] for s in free)
        extra = 0.0
        for s in list(free):
            target[s] += left * weights[s] / w
            if target[s] > most * sizes[s]:
                extra += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.remove(s)
        left = extra
    return target


def check_mix(rows, docs):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    by_source = defaultdict(int)
    for d, _, s in docs:
        by_source[s] += size[d]
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = water_level(by_source, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 3)
    source = {d: s for d, _, s in docs}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s])
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in by_source:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1, s


def test_mixing_query(spark, sf_dir, real):
    rows = queries.op3_mixing(spark, sf_dir).collect()
    check_mix(rows, list(zip(real.doc_id, real.text, real.source, strict=True)))
    assert sorted(rows) == sorted(queries.op3_mixing(spark, sf_dir).collect())


def test_mixing_stops_and_odd_rows(spark, odd):
    docs = [(i, "w " * n, s) for i, (n, s) in enumerate([(1, "a"), (2, "b"), (90, "c"), (40, None), (0, "d")])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_copies(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    check_mix(rows, docs)
    assert mixing.mix_copies(odd).count() == len(ODD)
    assert mixing.mix_copies(odd.limit(0)).count() == 0
    assert mixing.mix(odd).columns == odd.columns


def test_mix_by_row_where_doc_ids_repeat_or_are_null(spark):
    rng = np.random.default_rng(9)
    ids = [None if i % 5 == 0 else 1 if i % 2 else i for i in range(600)]
    docs = [(d, f"{i} " + "w " * int(rng.integers(0, 30)), "abc"[i % 3 % 2]) for i, d in enumerate(ids)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    sizes = {t: len(t.split()) for _, t, _ in docs}
    by_source = defaultdict(int)
    for _, t, s in docs:
        by_source[s] += sizes[t]
    want = water_level(by_source, {"a": 5, "b": 2}, 3)
    rows = mixing.mix(df).collect()
    times, taken = Counter(tuple(r) for r in rows), defaultdict(int)
    assert set(times) <= set(docs) and max(times.values()) <= 3
    for r in rows:
        taken[r.source] += sizes[r.text]
    assert all(abs(taken[s] - want[s]) <= max(sizes.values()) for s in by_source)
    copies = {(r.doc_id, r.source): 0 for r in mixing.mix_copies(df).collect()}
    for r in mixing.mix_copies(df).collect():
        copies[r.doc_id, r.source] += r.copies
    assert {k: v for k, v in copies.items() if v} == Counter((r.doc_id, r.source) for r in rows)
    assert Counter(tuple(r) for r in mixing.mix(df.repartition(7)).collect()) == times


def test_mix_of_one_hot_source(spark):
    docs = [(i, "w " * (1 + i % 13), "a" if i % 10 else "bc"[i // 10 % 2]) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    copies = mixing.mix_copies(df)
    check_mix(copies.withColumn("taken", F.col("copies") * F.col("size")).collect(), docs)
    assert mixing.mix(df).count() == copies.agg(F.sum("copies")).first()[0]


def brute_print(text, words=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    items = list(prints.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            if (x ^ y).bit_count() <= radius:
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in prints}


def test_simhash_query(spark, sf_dir, real):
    prints = {d: brute_print(t) for d, t in zip(real.doc_id, real.text, strict=True)}
    want = brute_components(prints)
    rows = queries.op10_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        d: (f"{p:016x}", want[d]) for d, p in prints.items()
    }


def test_close_prints_in_split_and_small_places(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PLACE", 40)
    rng = np.random.default_rng(5)
    prints = {}
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            p = base
            for bit in rng.integers(0, 64, rng.integers(0, 7)).tolist():
                p ^= 1 << bit
            prints[len(prints)] = p
    distinct = {p: d for d, p in reversed(prints.items())}
    prints = {d: p for p, d in distinct.items()}
    signed = [(d, p - (1 << 64) if p >> 63 else p) for d, p in prints.items()]
    df = spark.createDataFrame(signed, "id long, fingerprint long")
    want = brute_components(prints)
    for blocks in (4, 5, 6):
        got = {r.node: r.component for r in components.connected_components(simhash.near_links(df, 3, blocks)).collect()}
        assert {d: got.get(d, d) for d in prints} == want


def test_simhash_odd_rows(spark, odd):
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(odd).collect()}
    assert {(2, 2), (3, 2), (4, 2), (1, 1), (None, 1)} <= got
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 6, 7]
    assert simhash.keep_one(odd.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = components.connected_components(chain).collect()
    assert len(rows) == 300 and {r.component for r in rows} == {0}

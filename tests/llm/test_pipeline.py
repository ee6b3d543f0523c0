"""The corpus pipeline: every stage on its own input, against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from dialmart.llm import toxicity
from tests.llm.test_core_ops import check_packing, water_level
from tests.llm.test_passages import brute_groups
from tests.llm.test_text_ops import brute_lines


def brute_stage_lines(docs):
    """Lines that go: later copies of runs of two lines, and of single lines of 50 words."""
    gone, seen = brute_lines(docs, 2), set()
    for d, text in sorted(docs):
        for i, line in enumerate(text.split("\n")):
            if len(line.split()) >= 50:
                if line in seen:
                    gone[d].add(i)
                seen.add(line)
    return gone


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    rows = []
    for name, stage in corpus_pipeline.STAGES:
        source = docs
        docs = stage(spark, docs, sf_dir)
        copies, rows = Counter(r.doc_id for r in rows), docs.collect()
        texts = {d: r.text for d, r in before.items()}
        if name == "toxicity":
            model = toxicity.train(toxicity.labelled_rows(source, labels))
            make, weight = toxicity.Features(model.bits), dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
            total = {d: model.intercept + sum(weight.get(c, 0.0) for c in set(make.coordinates(t).tolist())) for d, t in texts.items()}
            assert {r.doc_id: r.text for r in rows} == {d: t for d, t in texts.items() if total[d] < 0}
            assert 0 < len(rows) < len(before)
        if name == "line_dedup":
            gone = brute_stage_lines(list(texts.items()))
            want = {}
            for d, text in texts.items():
                left = [line for i, line in enumerate(text.split("\n")) if i not in gone[d]]
                if not gone[d] or any(line.strip(" \t\r\x0b\x0c") for line in left):
                    want[d] = "\n".join(left)
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows if gone[r.doc_id])
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in rows) == brute_groups(list(texts.items()))
        if name == "mix_sources":
            size = {d: len(t.split()) for d, t in texts.items()}
            of, taken = defaultdict(int), defaultdict(int)
            for d, r in before.items():
                of[r.source] += size[d]
            for r in rows:
                taken[r.source] += size[r.doc_id]
            order = sorted(of, key=lambda s: (s is None, s or ""))
            target = water_level(of, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
            assert all(abs(taken[s] - target[s]) <= 3 * max(size.values()) for s in of)
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        if name == "best_fit_packing":
            used, least = check_packing(rows, texts, 4096)
            assert used <= least + 1
            assert Counter(r.doc_id for r in rows if r.piece == 0) == copies
        else:
            assert docs.columns == columns
            # all that the next stage sees, with its columns as they were
            assert all(r.lang == before[r.doc_id].lang and r.source == before[r.doc_id].source for r in rows)
            before = {r.doc_id: r for r in rows}


def test_run_is_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    assert np.unique([r.sequence_id for r in docs.collect()]).size > 0

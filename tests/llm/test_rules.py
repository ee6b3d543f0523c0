"""Fertility rules, the Merkle manifest and spelling variants against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialmart.llm import fertility, merkle, queries, variants

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Same words here again", "en", "a", 1),
    (1, "Same words here again", "en", "a", 1),
    (1, "other", None, "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 0),
    (None, "word word", "en", None, 1),
    (None, None, None, None, None),
    (6, "word " * 30_000, "en", "a", 1),
    (7, "é 中文 ½ <|endoftext|> it's ▁   x", "xx", "ÿ", 1),
    (8, "x" * 9_000 + "é" * 200, "en", "a", 1),
]


def brute_measures(text, encode, pieces):
    words = re.findall("[^ \t-\r]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search("[^ \t-\r]", line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    base = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    if not words:
        return (*base, failed, *[None] * 5)
    a = [i for w in words for i in encode(" " + w)]
    b = [i for w in words for i in pieces.encode(w)]
    entropy = lambda ids: -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
    found = [base[1] / len(a), base[1] / len(b), sum(map(pieces.is_byte, b)) / len(b), entropy(a), entropy(b)]
    return (*base, failed, *found)


@pytest.fixture(scope="module")
def tokenizers():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def same_measures(row, want):
    got = [row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    assert got == list(want[:6]), row.doc_id
    for c, x in zip(fertility.MEASURES, want[6:], strict=True):
        assert row[c] is None if x is None else abs(row[c] - 1000 * x) <= 0.51, (row.doc_id, c)


def test_fertility_query(spark, sf_dir, tokenizers):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op11_fertility(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        same_measures(r, brute_measures(docs[r.doc_id].text, *tokenizers))
    assert {r.kept for r in rows} == {True, False} and not any(r.kept and r.base_failed for r in rows)


@pytest.mark.parametrize("least", [2, 20, 10**6])
def test_bands(spark, sf_dir, least):
    """The verdicts follow from the measures by the rule that the module states."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    docs = docs.union(docs.where("doc_id < 20"))  # copies move no band
    rows = fertility.quality(docs, queries.RANKS, queries.PIECES, 3.0, 0.1, least).collect()
    groups = defaultdict(set)

    def keys(r):
        lang = r.lang or "-" + r.script
        return [(lang, int(math.log2(max(1, r.n_words)))), lang, ("script", r.script)]

    for r in rows:
        if not r.base_failed:
            for k in keys(r):
                groups[k].add((keys(r)[0], r.script, *(r[c] for c in fertility.MEASURES)))
    for r in rows:
        bands = [(1000, 12000), (1000, 12000), (0, 300), (2000, 20000), (2000, 20000)] if r.script == "Latin" else fertility.WIDEST
        for k in keys(r):
            if len(groups[k]) >= least:
                q = np.percentile(np.array([m[2:] for m in groups[k]], float), [25, 50, 75], axis=0)
                lo = np.minimum(q[0] - 3 * (q[2] - q[0]), q[1] * 0.9)
                hi = np.maximum(np.maximum(q[2] + 3 * (q[2] - q[0]), q[1] * 1.1), [0, 0, 50, 0, 0])
                bands = list(zip(lo, hi))
                break
        inside = all(r[c] is not None and lo - 1e-9 <= r[c] <= hi + 1e-9 for c, (lo, hi) in zip(fertility.MEASURES, bands, strict=True))
        assert r.kept == (not r.base_failed and inside), r


def test_fertility_on_labels(spark):
    """Most texts of low quality that pass the base rules go, and hardly any of high quality."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op11_fertility(spark, sf).collect() if not r.base_failed and r.doc_id in labels]
    kept = lambda q: [r.kept for r in rows if labels[r.doc_id] == q]
    assert np.mean(kept(1)) >= 0.98
    assert np.mean(kept(0)) <= 0.5


def test_fertility_odd_rows(spark, tokenizers):
    odd = spark.createDataFrame(ODD, DOCS)
    rows = fertility.quality(odd, queries.RANKS, queries.PIECES).collect()
    assert len(rows) == len(ODD)
    want = sorted((repr(brute_measures(t, *tokenizers)[:5]) for _, t, *_ in ODD))
    assert sorted(repr((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in rows) == want
    by_id = {r.doc_id: r for r in rows}
    same_measures(by_id[7], brute_measures(ODD[9][1], *tokenizers))
    assert by_id[7].script == "Latin" and by_id[4].script == "Common" and not any(r.kept for r in rows)
    assert fertility.quality(odd.limit(0), queries.RANKS, queries.PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.booleans())
def test_repeated_words(words, many):
    numbers = np.array([ord(w) + (many << 22) for w in words], np.int64)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    assert fertility.repeated_words(numbers) == len(covered)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(r):
    fields = (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_proofs(rows, fanout, now):
    """(doc_id, leaf, subroot, root, proof, folded) of each row; now(row) is the row as found later."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def steps(levels, i):
        for nodes in levels[:-1]:
            at = i // fanout * fanout
            yield "".join(nodes[at:i]), "".join(nodes[i + 1 : at + fanout])
            i //= fanout

    of = defaultdict(list)
    order = lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r))
    for r in sorted(rows, key=order):
        of[r["source"]].append(r)
    trees = [tree([brute_leaf(r) for r in part]) for part in of.values()]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, part in enumerate(of.values()):
        for i, r in enumerate(part):
            way = [*steps(trees[k], i), *steps(top, k)]
            folded = brute_leaf(now(r))
            for left, right in way:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], brute_leaf(r), trees[k][-1][0], top[-1][0], sha("".join(a + b for a, b in way)), folded))
    return Counter(out)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_brute_force(spark, fanout):
    rng = random.Random(fanout)
    names = ["big"] * 6 + [None, "z", "é", "", "b"] + [f"s{i}" for i in range(9)]
    rows = [(i, "Text %d" % i, rng.choice(["en", None]), rng.choice(names), rng.choice([None, i])) for i in range(600)] + ODD
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    found = merkle.manifest(df, FIELDS, now={"text": F.lower("text")}, fanout=fanout).proofs(with_steps=True).collect()
    lower = lambda r: r | {"text": r["text"] and r["text"].lower()}
    want = brute_proofs([r.asDict() for r in df.collect()], fanout, lower)
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in found) == want
    assert all(sha("".join(s.left + s.right for s in r.steps)) == r.proof_sha256 for r in found)


def test_manifest_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    found = merkle.manifest(odd, FIELDS).proofs()
    rows = found.collect()
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"] and len(rows) == len(ODD)
    assert {r.folded_root for r in rows} == {r.root for r in rows} and len({r.root for r in rows}) == 1
    assert merkle.manifest(odd.limit(0), FIELDS).proofs().count() == 0
    lone = merkle.manifest(odd.where("doc_id = 7"), FIELDS).proofs().first()
    assert lone.leaf == lone.subroot == lone.root == lone.folded_root and lone.proof_sha256 == sha("")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(2, 5))
def test_frontier_extends_witnesses(n, fanout):
    frontier, paths = merkle.Frontier(fanout, None), [merkle.Path() for _ in range(n)]
    for i, path in enumerate(paths):
        frontier.append(sha(str(i)), [path])
    root = frontier.close()
    for i, path in enumerate(paths):
        digest = sha(str(i))
        for left, right in path.steps:
            digest = sha(left + digest + right)
        assert digest == root


def brute_variants(docs, least=5, min_n=3, every=97, times=2):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= min_n}

    def near(a, b):
        return a != b and any(a[:i] + c + a[j:] == b for i in range(len(a) + 1) for j in {i, min(len(a), i + 1)} for c in {"", *b[i : i + 1]})

    found = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) if x else None for w, x in found.items()}
    form = {w: f if f and n[f] >= times * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(found[w]), form[w], form[w] and n[form[w]], root)
    return out


@pytest.mark.parametrize("piece", [20_000, 9])
def test_variants_brute_force(spark, piece, monkeypatch):
    monkeypatch.setattr(variants, "PIECE", piece)
    monkeypatch.setattr(variants, "SEARCHES", 50)
    monkeypatch.setattr(variants, "CANDIDATES", 7)
    rng = random.Random(piece)
    letters = "abcé×ÀA"
    stock = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(60)] + ["w" * 80, "w" * 79 + "x", "w" * 65, "w" * 64]
    for w in list(stock):
        k = rng.randrange(len(w))
        stock += [w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]
    docs = [(i, rng.choice([" ", "1", "\n", "中", "ā"]).join(rng.choice(stock) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (5, None)], "doc_id long, text string").repartition(3)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.variants(df).collect()}
    assert got == brute_variants([*docs, (None, docs[0][1])])
    assert sum(f is not None for _, _, f, _, _ in got.values()) > 10


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_one_edit(a, b):
    x, y = a.encode(), b.encode()
    edits = {a[:i] + c + a[j:] for i in range(len(a) + 1) for j in (i, i + 1) if j <= len(a) for c in ("", "a", "b")}
    want = a != b and b in edits
    assert variants.is_near(x, y) == want
    one, other = variants.Table([x]), variants.Table([y])
    assert variants._near(one, np.array([0]), other, np.array([0]))[0] == want


def test_variants_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    got = {r.word: r.n for r in variants.variants(odd, min_letters=1, min_n=1).collect()}
    assert got == {w: x[0] for w, x in brute_variants([r[:2] for r in ODD], 1, 1).items()}
    assert variants.variants(odd.limit(0)).count() == 0

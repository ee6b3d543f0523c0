"""Every operator and every stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dialmart.llm import fertility, lines, media, merkle, mixing, packing, queries, repeats, similar, simhash, tokenfile, toxicity, variants, vectors, warc
from dialmart.llm.common import named

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "some words that repeat for a while, and are longer than a hundred bytes in all, which is what it takes to be found here\nand a line\n"
ODD = [
    (1, PASSAGE + "one", "en", "a", 1),
    (1, PASSAGE + "one", "en", "a", 1),
    (1, PASSAGE + "two", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 0),
    (None, PASSAGE + "one", "en", None, 1),
    (None, None, None, None, None),
    (6, "word " * 30_000, "en", "a", 1),
    (7, "é 中文 ½ <|endoftext|> it's", "xx", "ÿ", 1),
    (8, PASSAGE + "one", "en", "a", 1),
]
#: Names that operators give to columns of their own, here or earlier.
CLASHES = """row rows number numbers size line lines rank place places part parts copy copies id _id hash _hash h cut kept removed _removed n_lines n_removed
    n_spans spans _spans ranges _ranges bytes _bytes lo hi anchor seg start windows body sequence_id offset piece length _salt _rank _number _range _n
    _copies _copy component component_id node fingerprint u v key label score held_out toxic predicted first same here next _text_hash target source_size
    taken media n_bytes payload ids n_tokens file shard block page_id url html a.b we`ird""".split()


def clashing(df):
    return df.select("*", *[F.lit(f"<{c}>").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(2)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "vile thing" if i % 3 == 0 else "fine thing", int(i % 3 == 0)) for i in range(300)]
    return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, label int"))


#: Operators that give the caller's rows back, with the columns that they set.
CARRY = {
    "pack": (lambda d, m: packing.pack(d.withColumn("length", F.lit(3)), 10), {"length", "sequence_id", "offset"}),
    "mix": (lambda d, m: mixing.mix(d), set()),
    "remove_repeats": (lambda d, m: repeats.remove_repeats(d), {"spans", "kept"}),
    "drop_toxic": (lambda d, m: toxicity.drop_toxic(d, m), set()),
    "dedup_lines": (lambda d, m: lines.dedup_lines(d, 2, 50), {"kept", "n_lines", "n_removed", "n_spans"}),
    "drop_repeated_lines": (lambda d, m: lines.drop_repeated_lines(d, 2, 50), set()),
    "simhash_keep_one": (lambda d, m: simhash.keep_one(d), set()),
    "similar_keep_one": (lambda d, m: similar.keep_one(d), set()),
    "keep_good": (lambda d, m: fertility.keep_good(d.withColumn("text", F.concat("text", F.lit(" " + " ".join(f"kept{i}" for i in range(60))))), queries.RANKS, queries.PIECES), {"text"}),
}
#: Operators that give rows of their own.
OWN = {
    "pack_documents": lambda d, m: packing.pack_documents(d, queries.VOCABULARY, 64, 1),
    "mix_copies": lambda d, m: mixing.mix_copies(d),
    "score": lambda d, m: toxicity.score(d, m),
    "media": lambda d, m: media.media_features(media.store_media(d)),
    "token_files": lambda d, m: tokenfile.read_token_files(*tokenfile.write_token_files(d, queries.VOCABULARY, 2, 1000)),
    "simhash": lambda d, m: simhash.simhash_components(d),
    "quality": lambda d, m: fertility.quality(d, queries.RANKS, queries.PIECES),
    "manifest": lambda d, m: merkle.manifest(d, ["doc_id", "source", "lang", "n_chars", "text"]).proofs(),
    "variants": lambda d, m: variants.variants(d, 2, 1),
}


def rows_of(df, columns):
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


@pytest.mark.parametrize("name", sorted(CARRY))
def test_clashing_columns_come_back(odd, model, name):
    run, sets = CARRY[name]
    plain, wide = run(odd, model), run(clashing(odd), model)
    given = ["doc_id", "text", "lang", "source", "n_chars", *sets]
    assert set(plain.columns) == {*odd.columns, *sets}
    assert sorted(set(wide.columns)) == sorted(wide.columns) and set(wide.columns) == {*clashing(odd).columns, *sets}
    stable = [c for c in given if c not in ("sequence_id", "offset")]
    assert rows_of(wide.select(*map(named, stable)), stable) == rows_of(plain, stable)
    others = [c for c in CLASHES if c not in sets]
    assert all(r[c] == f"<{c}>" for r in wide.select(*map(named, others)).collect() for c in others)


@pytest.mark.parametrize("name", sorted(OWN))
def test_clashing_columns_are_left_out(odd, model, name):
    plain, wide = OWN[name](odd, model), OWN[name](clashing(odd), model)
    columns = [c for c in plain.columns if c not in ("sequence_id", "offset")]
    assert wide.columns == plain.columns
    assert rows_of(wide, columns) == rows_of(plain, columns)


@pytest.mark.parametrize("name", sorted({**CARRY, **OWN}))
def test_empty_tables(odd, model, name):
    run = CARRY[name][0] if name in CARRY else OWN[name]
    assert run(clashing(odd).limit(0), model).count() == 0


def test_pages_and_vectors_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, None, "x" * 200), (2, "v", None), (None, "w", "")], "page_id long, url string, html string")
    read = lambda d: rows_of(warc.read_archives(warc.write_archives(d)), ["key", "record_type", "refers_to", "payload_bytes"])
    assert read(clashing(pages)) == read(pages) and len(read(pages)) == 4
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, None), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    near = lambda d: rows_of(vectors.near_vectors(d), ["vec_id", "n_links", "component_id", "kept"])
    assert near(clashing(vecs)) == near(vecs)
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "doc_id long, text string")
    assert toxicity.scored(clashing(docs), clashing(labels)).count() == 3


def test_unlike_texts_of_one_id_stay(spark):
    """A copy goes where its text is alike, whatever doc_id the other rows share."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1), (1, a, "en", "s", 1), (4, a + " iota", "en", "s", 1)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted((r.doc_id, r.text) for r in stage(spark, df, "").collect()) == [(1, a), (1, b)]
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(1, a), (1, b), (4, a + " iota")]
    # both texts of id 1 reach 0 through other rows, but not each other
    far = spark.createDataFrame([(1, a), (1, b), (0, a), (2, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(far).collect()) == [(0, 0), (1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, sf_dir, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    wide = clashing(odd)
    out = stage(spark, wide, sf_dir)
    rows = out.collect()
    assert stage(spark, wide.limit(0), sf_dir).count() == 0
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD} and sum(r.piece == 0 for r in rows) == len(ODD)
        return
    assert out.columns == wide.columns
    assert all(r[c] == f"<{c}>" for r in rows for c in CLASHES)
    ids = [r.doc_id for r in rows]
    if name == "toxicity":
        assert len(rows) == len(ODD)
    if name == "line_dedup":
        # both texts of id 1 begin alike at one place, so neither comes later; 8 loses all its lines, the row without an id none
        assert len(rows) == len(ODD) - 1 and 8 not in ids and {r.text for r in rows if r.doc_id == 1} == {ODD[0][1], ODD[2][1]}
    if name == "simhash_near_dedup":
        assert sorted(i for i in ids if i is not None) == [1, 2, 6, 7] and ids.count(None) == 2
    if name == "mix_sources":
        # 30,000 of all words are in one document, so its source's target is near all of them and it comes once at least
        size = {r[0]: len((r[1] or "").split()) for r in ODD}
        assert set(ids) <= {r[0] for r in ODD} and 1 <= ids.count(6) <= 3
        assert abs(sum(size[i] for i in ids) - sum(len((r[1] or "").split()) for r in ODD)) <= 30_000

"""Queries against their SQL on rows that the small tables lack: keys of many digits, copies, many parts."""

from __future__ import annotations

import duckdb
import pytest

from dialmart import plans


@pytest.fixture
def same_as_sql(spark, sf_dir, tmp_path):
    """Whether a query and its SQL give the same rows, with some tables made by SQL from the given ones."""

    def check(name, **made):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t in {"orders", "lineitem", "nation", "documents"} - set(made):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
        for t, sql in made.items():
            con.execute(f"copy ({sql.format(table=f"'{sf_dir}/{t}.parquet'")}) to '{tmp_path}/{t}.parquet' (format parquet)")
        for t in ("orders", "lineitem", "nation", "documents"):
            con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = plans.QUERIES[name](spark, str(tmp_path))
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        result = con.execute(plans.ORACLES[name])
        names = [d[0] for d in result.description]
        want = sorted((tuple(dict(zip(names, row, strict=True))[c] for c in sorted(names)) for row in result.fetchall()), key=repr)
        assert got and got == want

    return check


#: Keys of three to ten digits.
KEYS = "select * replace (o_orderkey * [1, 100, 10007, 123457, 9000011][o_orderkey % 5 + 1] as o_orderkey) from {table}"


def test_labels_with_long_numbers_in_a_word(same_as_sql):
    same_as_sql("call_type_labels", orders=KEYS)


def test_agents_with_numbers_of_six_digits(same_as_sql):
    same_as_sql("shown_agents", orders=KEYS)


def test_topics_of_copies_and_of_documents_without_words(same_as_sql):
    odd = ["!!!", "", "la² the", "pas‿y", "no‍ et", "The the_ eĺ EL", "٠ und"]
    more = " union all ".join(f"select {-1 - i} as doc_id, '{t}' as text, 'zz' as lang" for i, t in enumerate(odd))
    rows = "select doc_id, text, lang from {table}"
    same_as_sql("topic_hits", documents=f"{rows} union all {rows} where doc_id % 3 = 0 union all {more} union all select null, 'the', 'fr' union all select 1, null, 'xx'")


#: The keys of the test with orders, and calls of which one segment is missing or stands twice.
LINES = "select * replace (l_orderkey * [1, 100, 10007, 123457, 9000011][l_orderkey % 5 + 1] as l_orderkey) from {table}"


def test_calls_with_ids_of_many_digits(same_as_sql):
    same_as_sql("imported_calls", lineitem=f"{LINES} union all ({LINES} limit 20)")


def test_quoted_fields_beside_plain_ones(spark, tmp_path):
    from dialmart.sources import delimited

    (tmp_path / "a.csv").write_text('id,"b c",d,d\n1,x,y,z\n2,"x,1","y ""q""",z\n3\n4,"over\nlines",‏y,z,more,"and, more"\n,,,\n5,,,,,\n', encoding="utf-8")
    rows = delimited.read_any(spark, str(tmp_path / "a.csv")).orderBy("row_order").collect()
    assert [(r.fields["id"], r.fields["b c"], r.fields["d"], r.surplus) for r in rows] == [
        ("1", "x", "z", 0), ("2", "x,1", "z", 0), ("3", "", "", 0), ("4", "over\nlines", "z", 2), ("5", "", "", 2)
    ]


def test_contract_files_in_parts_are_one_file_each(spark, tmp_path):
    from dialmart.sources import delimited

    for k, head in {"interactions": "interaction_id,account_ref,started_at,channel,surplus", "call_segments": "call_key,file_name", "messages": "correspondence_id,message_id"}.items():
        (tmp_path / f"{k}.csv").mkdir()
        for part in range(3):
            (tmp_path / f"{k}.csv" / f"part-{part}.csv").write_text(f"{head}\n1,2,never,4,5\n")
    got = delimited.journey_contract(spark, str(tmp_path))
    assert sorted((r.code, r.n, r.examples) for r in got["issues"].collect()) == [("missing_columns", 1, ["messages: direction, sent_at"]), ("unreadable_start", 3, ["1"])]
    assert [tuple(r) for r in got["dropped"].collect()] == [("interactions", "surplus")]


def test_exact_tests_of_many_pairs_take_seconds(spark):
    import math
    import time

    from pyspark.sql import functions as F

    from dialmart.functions import stats

    pairs = [(0, 0), (0, 3), (5, 5), (12, 4), (700, 790)] + [(20_000 + 7 * k, 20_300) for k in range(35)]
    began = time.perf_counter()
    got = [r.p for r in spark.createDataFrame(pairs, "b long, c long").repartition(1).select("b", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).orderBy("b", "p").collect()]
    assert time.perf_counter() - began < 30
    whole = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, m) for m in range(min(b, c) + 1)) / 2 ** (b + c))
    logs = lambda b, c: min(1.0, 2 * math.fsum(math.exp(math.lgamma(b + c + 1) - math.lgamma(m + 1) - math.lgamma(b + c - m + 1) - (b + c) * math.log(2)) for m in range(min(b, c) + 1)))
    want = [p for _, p in sorted((b, (whole if b < 1000 else logs)(b, c)) for b, c in pairs)]
    assert got == pytest.approx(want, abs=1e-7)

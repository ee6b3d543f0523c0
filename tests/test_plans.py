"""Every registered query against its SQL in DuckDB, and the plans of the headline ones."""

from __future__ import annotations

import datetime
import io
from contextlib import redirect_stdout

import duckdb
import pandas as pd
import pytest

from dialmart import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["flagship", "next_events", "rows_in_sessions", "interruptions", "attributed_turns"])
def test_no_pairing_without_a_key(spark, sf_dir, name):
    plan = plan_of(plans.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_groups_meet_their_total_as_one_row(spark, sf_dir):
    """Where groups meet the whole, the side that goes to all tasks is an aggregate without a key."""
    plan = plan_of(plans.QUERIES["agents_against_rest"](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert plan.count("SinglePartition") >= plan.count("BroadcastNestedLoopJoin") // 2 > 0


def test_scans_read_what_is_used(spark, sf_dir):
    plan = plan_of(plans.QUERIES["story_numbers"](spark, sf_dir))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    plan = plan_of(plans.QUERIES["published_cards"](spark, sf_dir))
    assert "l_extendedprice" not in plan


def test_next_event_is_one_sorted_window(spark, sf_dir):
    assert "Join" not in plan_of(plans.QUERIES["next_events"](spark, sf_dir))


def test_quotes_are_not_sent_whole_to_the_driver(spark, sf_dir):
    """Texts and their words are far larger than their files, so their sizes tell nothing."""
    assert "BroadcastHashJoin" not in plan_of(plans.QUERIES["verified_evidence"](spark, sf_dir))


def test_counted_quotes_are_not_sent_whole_to_the_driver(spark, sf_dir):
    assert "BroadcastHashJoin" not in plan_of(plans.QUERIES["evidence_problems"](spark, sf_dir))

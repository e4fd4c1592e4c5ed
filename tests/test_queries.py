"""Registered queries against their SQL on the smallest tables (all of them: tools/check.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = (
    "flagship", "length_profile", "step_number", "topic_fanout", "mask_list", "encode_ids", "combo_headtail",
    "shorten_luhn", "rouge2", "length_hist", "score_quantiles", "improvements", "tfidf", "topic_coherence", "stream_metrics",
    "strategy_grid", "embedding_score", "tf_norm", "mask_words", "term_counts", "blacklist_filter", "rougeL",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_stream_windows_hold_all_events(spark, duck):
    out = entry.queries()["stream_windows_all"](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()["stream_windows_all"])
    cols = [d[0] for d in cur.description]
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(cols, cur.fetchall())
    rows = out.collect()
    assert sum(r["n_rows"] for r in rows) == spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert {r["closed"] for r in rows} == {True, False}


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {r["quantity"] for r in entry.entry(spark).collect()} == {"25", "35", "45"}

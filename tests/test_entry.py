"""Every query but the slow ones has columns and, where there is SQL, the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from embertrail import queries as detection

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["pred_eq_nocase", "pred_like_escape", "ruleset_detections", "navigator_techniques", "flatten_json", "corr_temporal", "parse_auditd", "tr_typosquat"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    out = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in out.fetchall()), key=repr)
    assert got == want


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["rule_idx", "query_idx", "event_id"]
    assert set(detection.oracle_sql()) <= set(detection.queries()) <= set(entry.queries())


def test_nested_json_leaves_out_rules_beyond_its_limit(spark, tmp_path):
    """One rule with a match more than the SQL lets through, one with exactly as many."""
    c = duckdb.connect()
    n = 100_000
    c.execute(
        f"""COPY (SELECT range AS event_id, TIMESTAMP '2024-01-01' AS ts, CASE WHEN range <= {n} THEN 3 ELSE 19 END AS user_id,
        CASE WHEN range <= {n} THEN 'view' ELSE 'error' END AS event_type, 1.0::DOUBLE AS value, '{{"k": 55}}' AS props FROM range({2 * n + 1})) TO '{tmp_path}/events.parquet'"""
    )
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in entry.queries()["export_nested_json"](spark, str(tmp_path)).collect()]
    assert got == c.execute(entry.oracle_sql()["export_nested_json"]).fetchall() == [("Error by low id", n, n)]

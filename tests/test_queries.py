"""Registered queries against their DuckDB oracles at sf0.001."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF

TABLES = ["customer", "events", "documents", "pages", "conversations"]
CHECK = ["detect_email", "detect_ssn", "detect_private_key", "detect_log_key_value", "detect_kv_token",
         "resolve_conflicts", "sanitize_fixed", "detect_literal_ci", "detect_regex_first", "pseudonym_email",
         "safe_hash", "mask_word", "is_json_events", "audit_stats", "audit_page", "sanitize_nested_customer",
         "stream_sanitize"]


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    items = sorted(repr(tuple(r[i] for i in order)) for r in rows)
    return hashlib.sha1("\n".join(items).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert sum(1 for k in qs if k.startswith("detect_")) >= 55


@pytest.mark.parametrize("name", CHECK)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    orows = cur.fetchall()
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    norm = lambda rs: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rs]
    assert _digest(norm(rows), df.columns) == _digest(norm(orows), ocols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"doc_id", "sanitized", "detections_count"} <= set(df.columns)

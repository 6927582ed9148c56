"""Queries against their SQL in DuckDB on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import ORACLE, QUERIES

SAMPLE = ["flt01_rule_projection", "flt05_window_positions", "str01_late_drop", "str03_alerts_in_order", "str05_detected_subjects", "str06_reorder_buffer", "dst01_exact_choice", "dst09_burst_delay", "swp01_ordering_sweep_keys", "agg16_evidence_measure", "agg08_spearman", "agg21_effect_rows", "str03_alert_rows", "str04_alerts_out_of_order", "hyp4_targeting_equivalence", "hyp5_staircase"]


@pytest.fixture(scope="module")
def duck(smoke):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(smoke):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{smoke}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) and not math.isnan(r[i]) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, smoke, duck, name):
    df = QUERIES[name](spark, smoke)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(map(tuple, df.collect()), df.columns) == plain(found.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule", "key", "first_t"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_drops_within_the_window(spark, smoke):
    r = QUERIES["hyp0a_no_drops_inside"](spark, smoke).first()
    assert r.runs > 0 and r.violations == 0
    r = QUERIES["hyp0b_full_buffer_harmless"](spark, smoke).first()
    assert r.full > 0 and r.violations == 0


def test_every_query_but_the_file_hash_has_sql():
    assert set(QUERIES) - set(ORACLE) == {"int01_file_hash"}

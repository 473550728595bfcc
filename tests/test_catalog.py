"""Registered queries against their SQL on the smallest driver tables."""

import duckdb
import pytest
from pathlib import Path

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["scorer_advantage", "probe_metrics", "supplier_spearman", "cluster_means", "quality_ledger", "leakage_exact", "matched_controls", "corruption_bank", "contact_edges", "ridge_two", "shapley", "valid_radius"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(row[names.index(c)] for c in cols) for row in cur.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-5) if all(isinstance(v, (int, float)) for v in a) else a == b
